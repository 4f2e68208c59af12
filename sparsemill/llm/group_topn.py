"""The N best rows of every group, however large a group is.

1. newest score per (group, row), spread by both; 2. a histogram of scores per group in monotone buckets; 3. per group the highest bucket
above which at least N rows lie is a safe threshold; 4. rows below it are dropped where they lie, before anything is shuffled by group;
5. the survivors are ranked exactly by score descending, then by the tie key. The ranking filter is a group limit below the shuffle, so
even a group whose scores are all equal sends at most N rows from each partition.

Thresholds are broadcast, those of the ``MOST_GROUPS`` largest groups: a group beyond them holds less than 1 / MOST_GROUPS of all rows,
and the group limit alone cuts it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparsemill.operators.ingest_log import latest_value

#: Buckets per power of two; scores beyond 2^±EXPONENT share the outer buckets. At most 2 * 2 * EXPONENT * PER_OCTAVE + 1 buckets a group.
PER_OCTAVE = 8
EXPONENT = 64
#: Groups that get a threshold, the largest ones: what is broadcast, some dozen bytes each.
MOST_GROUPS = 50_000


def score_bucket(score: Column) -> Column:
    """A bucket number that never falls as the score grows."""
    magnitude = F.floor((F.log2(F.greatest(F.abs(score), F.lit(2.0**-EXPONENT))) + EXPONENT) * PER_OCTAVE) + 1
    signed = F.when(score > 0, magnitude).when(score < 0, -magnitude).otherwise(F.lit(0))
    return F.least(F.greatest(signed, F.lit(-2 * EXPONENT * PER_OCTAVE)), F.lit(2 * EXPONENT * PER_OCTAVE)).cast("int")


def thresholds(rows: DataFrame, keys: list[str], n: int, most: int = MOST_GROUPS) -> DataFrame:
    """``keys`` and ``_min_bucket`` of the largest groups with more than n rows: at least n rows lie in that bucket or above."""
    histogram = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.partitionBy(*keys).orderBy(F.desc("_bucket"))
    counted = histogram.withColumn("_above", F.sum("_n").over(above))
    reached = F.max(F.when(F.col("_above") >= n, F.col("_bucket")))
    limits = counted.groupBy(*keys).agg(reached.alias("_min_bucket"), F.max("_above").alias("_rows")).where(F.col("_rows") > n)
    return limits.orderBy(F.desc("_rows"), *keys).limit(most).select(*keys, "_min_bucket")


def top_n(df: DataFrame, keys: list[str], n: int = 10, score: str = "score", row: str = "row_id", stamp: str = "opstamp", most: int = MOST_GROUPS) -> DataFrame:
    """``(keys, row, score, rank)`` of the n best rows of each group.

    Rows with a null, NaN or infinite score or a null row are dropped; of repeated (keys, row) the greatest stamp counts (null lowest; of
    equal stamps the greater score). Null keys form groups. n <= 0 or an empty table give no rows; other columns are ignored. ``most``
    bounds the thresholds that are broadcast and does not change the result.
    """
    value = F.col(score).cast("double")
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))) & F.col(row).isNotNull()
    rows = latest_value(df.select(*keys, row, value.alias(score), stamp).where(ok), [*keys, row], score, stamp)
    rows = rows.withColumn("_bucket", score_bucket(F.col(score)))
    limits = thresholds(rows, keys, max(n, 1), most).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_min_bucket")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    kept = rows.join(F.broadcast(limits), same, "left").where(F.col("_bucket") >= F.coalesce("_min_bucket", F.col("_bucket")))
    best = Window.partitionBy(*keys).orderBy(F.desc(score), F.col(row))
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select(*keys, row, score, "rank")
