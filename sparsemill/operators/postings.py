"""Posting lists in long form: rows ``(dim_id, row_id, weight[, opstamp])``; a list is all rows of one dim_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparsemill.functions import weights as W
from sparsemill.functions.vectors import explode_vectors, require_valid
from sparsemill.operators.ingest_log import latest_value

BLOCK_ROWS = 128


def build_postings(vectors: DataFrame, check: bool = True, weight_type: str = "f32", *carry: str) -> DataFrame:
    """Vectors ``(row_id, indices, vals)`` to postings. An invalid vector raises when ``check``; NaN and null weights are dropped."""
    if check:
        vectors = vectors.withColumn("indices", require_valid(F.col("indices"), F.col("vals")))
    long = explode_vectors(vectors, "row_id", *carry)
    long = long.where(F.col("weight").isNotNull() & ~F.isnan("weight"))
    return long.withColumn("weight", W.as_weight_type(F.col("weight"), weight_type))


def upsert(postings: DataFrame, keep_stamp: bool = False) -> DataFrame:
    """Last write wins per (dim_id, row_id) by opstamp."""
    return latest_value(postings, ["dim_id", "row_id"], "weight", "opstamp", keep_stamp)


def replace_rows(postings: DataFrame) -> DataFrame:
    """Last write wins per whole row: dims that the newest version of a row lacks are gone."""
    newest = postings.groupBy("row_id").agg(F.max("opstamp").alias("opstamp"))
    return upsert(postings.join(newest, ["row_id", "opstamp"], "left_semi"))


def delete_rows(postings: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Postings without the rows of ``tombstones(row_id)``; null ids delete nothing."""
    return postings.join(tombstones.select("row_id").where(F.col("row_id").isNotNull()), "row_id", "left_anti")


def delete_rows_extended(postings: DataFrame, tombstones: DataFrame, lowest: float = float("-inf")) -> DataFrame:
    """``delete_rows``, then suffix maxima anew, as those before a deleted row may fall."""
    return with_suffix_max(delete_rows(postings, tombstones), lowest)


def differing_postings(one: DataFrame, two: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """``(dim_id, row_id)`` in which two sets of lists are not approximately equal: held by one only, or with weights further apart than a code
    step of ``params(dim_id, q_diff)`` (half a percent without). Equal sets give no rows; equal nulls are equal.
    """
    a = one.select("dim_id", "row_id", F.col("weight").alias("_a"), F.lit(True).alias("_in_a"))
    b = two.select("dim_id", "row_id", F.col("weight").alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, ["dim_id", "row_id"], "full")
    if params is not None:
        both = both.join(params.select("dim_id", "q_diff"), "dim_id", "left")
    close = W.approximately_equal(F.col("_a"), F.col("_b"), None if params is None else F.coalesce("q_diff", F.lit(0.0)))
    same = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull() & F.coalesce(close, F.col("_a").isNull() & F.col("_b").isNull())
    return both.where(~same).select("dim_id", "row_id")


def with_suffix_max(postings: DataFrame, lowest: float = float("-inf"), chunk: int = 65_536) -> DataFrame:
    """Adds ``max_next_weight``: the greatest weight of later rows of the list, ``lowest`` for the last.

    Two levels: lists are cut into ranges of ``chunk`` row ids; the window runs inside a range, and a window over the (few) range maxima
    carries the rest. No task holds a whole hot list.
    """
    cut = postings.withColumn("_c", F.floor(F.col("row_id") / chunk))
    after = Window.partitionBy("dim_id").orderBy("_c").rowsBetween(1, Window.unboundedFollowing)
    ranges = cut.groupBy("dim_id", "_c").agg(F.max("weight").alias("_m")).select("dim_id", "_c", F.max("_m").over(after).alias("_later"))
    inner = Window.partitionBy("dim_id", "_c").orderBy("row_id").rowsBetween(1, Window.unboundedFollowing)
    local = cut.withColumn("_local", F.max("weight").over(inner))
    joined = local.join(ranges, ["dim_id", "_c"], "left")
    best = F.coalesce(F.greatest("_local", "_later"), F.lit(lowest).cast("float")).alias("max_next_weight")
    return joined.select(*postings.columns, best)


def quant_params(postings: DataFrame, *group: str) -> DataFrame:
    """``(…group, dim_id, q_min, q_diff)`` of each list."""
    lists = postings.groupBy(*group, "dim_id").agg(F.min("weight").cast("float").alias("q_min"), F.max("weight").cast("float").alias("_max"))
    return lists.select(*group, "dim_id", "q_min", W.quant_diff(F.col("q_min"), F.col("_max")).alias("q_diff"))


def quantize_postings(postings: DataFrame, params: DataFrame, *group: str) -> DataFrame:
    """Adds ``code`` and the list's parameters. Catalyst broadcasts the parameters only when small."""
    joined = postings.join(params, [*group, "dim_id"])
    return joined.withColumn("code", W.quantize(F.col("weight"), F.col("q_min"), F.col("q_diff")))


def dequantize_postings(coded: DataFrame) -> DataFrame:
    """``weight`` from ``code``, ``q_min`` and ``q_diff``."""
    return coded.withColumn("weight", W.dequantize(F.col("code"), F.col("q_min"), F.col("q_diff")))


def dim_stats(postings: DataFrame) -> DataFrame:
    """Per list: length, row range, weight range."""
    return postings.groupBy("dim_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_id").alias("min_row"), F.max("row_id").alias("max_row"),
        F.min("weight").alias("min_w"), F.max("weight").alias("max_w"),
    )


def index_metrics(postings: DataFrame) -> DataFrame:
    """One row: number of lists, of rows and of postings, id ranges."""
    return postings.agg(
        F.countDistinct("dim_id").alias("posting_count"), F.countDistinct("row_id").alias("vector_count"), F.count(F.lit(1)).alias("n_postings"),
        F.min("row_id").alias("min_row"), F.max("row_id").alias("max_row"), F.min("dim_id").alias("min_dim"), F.max("dim_id").alias("max_dim"),
    )


def scan_list(postings: DataFrame, dim_id: int) -> DataFrame:
    """One list; the predicate reaches the Parquet scan. An unknown dim gives no rows."""
    return postings.where(F.col("dim_id") == int(dim_id))


def seek(postings: DataFrame, row_id: int) -> DataFrame:
    """What remains of each list from the first row >= ``row_id``, with ``hit`` telling whether that row is there."""
    rest = postings.where(F.col("row_id") >= int(row_id))
    return rest.groupBy("dim_id").agg(F.count(F.lit(1)).alias("remains"), F.min("row_id").alias("at_row"), (F.min("row_id") == int(row_id)).alias("hit"))


def up_to_row(postings: DataFrame, bound: int) -> DataFrame:
    """Postings with row_id <= bound."""
    return postings.where(F.col("row_id") <= int(bound))


def block_stats(postings: DataFrame, block_rows: int = BLOCK_ROWS, chunk: int = 65_536) -> DataFrame:
    """Row range, count and greatest weight of each block of ``block_rows`` entries, the last one partial.

    Positions come from counts per range of row ids plus a position inside the range, so a hot list is spread over tasks.
    """
    cut = postings.withColumn("_c", F.floor(F.col("row_id") / chunk))
    before = Window.partitionBy("dim_id").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("dim_id", "_c").agg(F.count(F.lit(1)).alias("_n")).select("dim_id", "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = cut.withColumn("_i", F.row_number().over(Window.partitionBy("dim_id", "_c").orderBy("row_id")))
    placed = inside.join(starts, ["dim_id", "_c"]).withColumn("block_no", F.floor((F.col("_start") + F.col("_i") - 1) / block_rows))
    return placed.groupBy("dim_id", "block_no").agg(
        F.min("row_id").alias("row_start"), F.max("row_id").alias("row_end"), F.count(F.lit(1)).alias("n"), F.max("weight").alias("max_w")
    )
