"""Row bitmaps: byte strings, lowest bit first; rows past the end are dead."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bitmap_from_rows(row_ids: Iterable[int]) -> bytes:
    """Driver-side bitmap of a caller's id list."""
    ids = list(row_ids)
    out = bytearray((max(ids) // 8 + 1) if ids else 0)
    for r in ids:
        out[r // 8] |= 1 << (r % 8)
    return bytes(out)


def is_alive(bitmap: Column, row_id: Column) -> Column:
    """Bit of ``row_id``; false past the end and for null ids."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(row_id / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), row_id % 8).cast("int")) != 0, F.lit(False))


def rows_from_bitmap(df: DataFrame, bitmap: str = "bitmap") -> DataFrame:
    """All alive row ids of a one-row bitmap column, ascending ids as ``row_id``; an empty bitmap gives no rows."""
    n = F.octet_length(F.col(bitmap)) * 8
    ids = df.where(n > 0).select(bitmap, F.explode(F.sequence(F.lit(0).cast("bigint"), (n - 1).cast("bigint"))).alias("row_id"))
    return ids.where(is_alive(F.col(bitmap), F.col("row_id"))).select("row_id")


def bitmap_frame(spark: SparkSession, bitmap: bytes) -> DataFrame:
    return spark.createDataFrame([(bytearray(bitmap),)], "bitmap binary")


def intersect_alive(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids alive in both sets."""
    return a.select("row_id").join(b.select("row_id"), "row_id", "left_semi").distinct()


def union_alive(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("row_id").unionByName(b.select("row_id")).distinct()


def deleted_rows(rows: DataFrame, alive: DataFrame) -> DataFrame:
    """Rows of a segment that its alive set lacks."""
    return rows.select("row_id").join(alive.select("row_id"), "row_id", "left_anti")


def packed_words(rows: DataFrame, bits: int = 1 << 15) -> DataFrame:
    """Distributed bit set ``(word_no, bitmap, n_alive)``: one binary of ``bits`` bits per range of ids."""
    in_range = rows.select("row_id").where(F.col("row_id").isNotNull()).withColumn("word_no", F.floor(F.col("row_id") / bits))
    packed = in_range.groupBy("word_no").agg(F.expr(f"bitmap_construct_agg(row_id % {bits})").alias("bitmap"))
    return packed.select("word_no", "bitmap", F.expr("bitmap_count(bitmap)").alias("n_alive"))
