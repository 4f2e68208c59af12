"""Per-key results although a handful of keys hold most rows.

Heavy keys are found in one pass by a mergeable frequent-items sketch over the keys' hashes. Rows of heavy keys are picked by a broadcast
join with the list of heavy hashes and spread over tasks by other columns; all other keys take the ordinary shuffle of their group-by; the
results are united. A key is heavy from a quarter of what an even shuffle gives one task, so what is left is light for any number of
rows, and there are at most four heavy keys for each task of a shuffle. The sketch only decides the route of a key, never its result: an
estimate that is off, or two keys of one hash, send a key the other way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparsemill.operators.ingest_log import has_value, latest_value

#: A key is heavy from 1 / PER_TASK of the rows that an even shuffle gives one task.
PER_TASK = 4
#: Heavy keys at most, eight bytes each, whatever the shuffle; they are broadcast.
MOST_KEYS = 65_536
#: Keys with fewer rows are never heavy.
LEAST_ROWS = 16
#: Sketches of the map tasks are merged in so many groups first, then these.
MERGE_GROUPS = 256


def _hash(keys: list[str]) -> Column:
    return F.xxhash64(F.lit(0), *[F.col(k) for k in keys])


def default_share(df: DataFrame) -> float:
    """The share of all rows from which a key is heavy in a shuffle of this session."""
    return 1.0 / (PER_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def heavy_hashes(df: DataFrame, keys: list[str], share: float | None = None) -> list[int]:
    """Hashes of the keys that hold about ``share`` of all rows or more, in one pass over the key columns; at most ``MOST_KEYS``.

    Null keys can be heavy like any other, and repeated rows count each time. The sketch holds every key above 3.5 / its size, which is
    half the share or less; its lower estimates decide. An empty table has none.
    """
    share = max(share or default_share(df), 2.0 / MOST_KEYS)
    items = 1 << min(20, max(10, int(8 / share).bit_length()))
    hashed = df.select(_hash(keys).alias("h"), F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("g"))
    parts = hashed.groupBy("g").agg(F.expr(f"approx_top_k_accumulate(h, {items})").alias("s"), F.count(F.lit(1)).alias("n"))
    # Grouped by a constant, as the merge of no sketch at all is an error.
    whole = parts.groupBy(F.lit(1).alias("one")).agg(F.expr(f"approx_top_k_combine(s, {items})").alias("s"), F.sum("n").alias("n"))
    found = whole.select(F.expr(f"approx_top_k_estimate(s, {min(MOST_KEYS, int(1 / share) + 1)})").alias("top"), "n").collect()
    return [e["item"] for r in found for e in r["top"] if e["count"] >= max(LEAST_ROWS, r["n"] * share)]


def split_heavy(df: DataFrame, keys: list[str], share: float | None = None, counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of heavy keys and all other rows, both with the columns of ``df``. No row is lost or doubled, as both use one list.

    Keys are counted in ``counted`` where it is given: any table with about the same keys that costs less to read.
    """
    hashes = heavy_hashes(df if counted is None else counted, keys, share)
    heavy = F.broadcast(df.sparkSession.createDataFrame([(h,) for h in hashes], "_heavy bigint"))
    match = _hash(keys) == heavy["_heavy"]
    return df.join(heavy, match, "left_semi"), df.join(heavy, match, "left_anti")


def per_key(
    df: DataFrame,
    keys: list[str],
    light: Callable[[DataFrame], DataFrame],
    heavy: Callable[[DataFrame], DataFrame],
    share: float | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """``light`` gets the rows of light keys, ``heavy`` those of heavy ones, as they lie; both return the same columns, one result per key."""
    hot, rest = split_heavy(df, keys, share, counted)
    return light(rest).unionByName(heavy(hot))


def _best(latest: DataFrame) -> DataFrame:
    """The row of the greatest weight of each list, of equal ones the smallest row_id."""
    top = F.max(F.struct(F.col("weight").alias("w"), (-F.col("row_id")).alias("r"))).alias("_t")
    return latest.groupBy("segment_id", "dim_id").agg(top).select("segment_id", "dim_id", (-F.col("_t.r")).alias("row_id"), F.col("_t.w").alias("weight"))


def best_of_lists(postings: DataFrame, share: float | None = None) -> DataFrame:
    """Greatest newest weight of each (segment_id, dim_id): ``(segment_id, dim_id, row_id, weight)``.

    Rows with a null or NaN weight or a null row_id are dropped; of each (segment_id, dim_id, row_id) the greatest opstamp counts (null
    lowest; of equal ones the greater weight). An empty table gives no rows; other columns are ignored.
    """
    clean = postings.select("segment_id", "dim_id", "row_id", F.col("weight").cast("float").alias("weight"), "opstamp")
    clean = clean.where(has_value(F.col("weight")) & F.col("row_id").isNotNull())

    def spread(rows: DataFrame) -> DataFrame:
        # Versions meet by (list, row), so that a hot list is spread by its rows, and its tasks send one best row each.
        return _best(latest_value(rows, ["segment_id", "dim_id", "row_id"], "weight", "opstamp"))

    def placed(rows: DataFrame) -> DataFrame:
        # Nearly every row is a (list, row) of its own, so combining first saves little: the lists are placed once, and both steps run there.
        return spread(rows.repartition("segment_id", "dim_id"))

    return per_key(clean, ["segment_id", "dim_id"], placed, spread, share)


def dim_summary(long: DataFrame, salts: int = 64, share: float | None = None, counted: DataFrame | None = None) -> DataFrame:
    """``(dim_id, n, n_values, w_min, w_max)`` of ``long(row_id, dim_id, weight)``; null and NaN weights count in n only.

    Both routes combine before their shuffles. ``counted(dim_id)`` may be a cheaper table to find the heavy dims in.
    """
    value = F.when(has_value(F.col("weight")), F.col("weight"))
    rows = long.select("row_id", "dim_id", value.alias("v"))

    def first(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy("dim_id", *by).agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_values"), F.min("v").alias("w_min"), F.max("v").alias("w_max"))

    def hot(df: DataFrame) -> DataFrame:
        parts = first(df.withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.lit(salts))), "_salt")
        return parts.groupBy("dim_id").agg(F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.min("w_min").alias("w_min"), F.max("w_max").alias("w_max"))

    return per_key(rows, ["dim_id"], first, hot, share, counted)
