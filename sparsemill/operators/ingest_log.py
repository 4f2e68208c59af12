"""Newest versions out of an append-only log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparsemill.functions.vectors import is_valid


def latest_value(df: DataFrame, keys: list[str], value: str, stamp: str, keep_stamp: bool = False) -> DataFrame:
    """``keys`` and the ``value`` (also the stamp, if ``keep_stamp``) of the greatest ``stamp`` (null stamps lowest; of equal stamps the greatest value).

    One shuffle, combined on the map side first, so a key that holds a third of all rows does not end in one task.
    """
    best = F.max(F.struct(F.col(stamp).alias("s"), F.col(value).alias("v"))).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, F.col("_b.v").alias(value), *([F.col("_b.s").alias(stamp)] if keep_stamp else []))


def live_vectors(vectors: DataFrame) -> DataFrame:
    """Live rows of an ingest log ``(row_id, indices, vals, segment_id, opstamp, ...)``.

    Invalid rows (see ``is_valid``; also a null row_id) go first, then each row_id keeps its greatest opstamp (null lowest), of equal
    ones the smallest segment_id, then the smallest content hash. Empty vectors stay. The row_number filter is pushed below the
    shuffle as a group limit, so many versions of one row_id are cut down before they move.
    """
    ok = vectors.where(F.col("row_id").isNotNull() & is_valid(F.col("indices"), F.col("vals"))).select("row_id", "indices", "vals", "segment_id", "opstamp")
    w = Window.partitionBy("row_id").orderBy(F.col("opstamp").desc_nulls_last(), F.col("segment_id"), F.xxhash64("indices", "vals"))
    return ok.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def has_value(weight: Column) -> Column:
    """Neither null nor NaN."""
    return weight.isNotNull() & ~F.isnan(weight)
