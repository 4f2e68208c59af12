"""Readers of vectors from outside: JSON lines, tagged elements, rows of Python values; and generators for load tests."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsemill.functions.vectors import decode_tagged

VECTOR_SCHEMA = "row_id bigint, indices array<bigint>, vals array<float>"
ELEMENT = "struct<dim_id:bigint,weight_f32:float,weight_u8:smallint,weight_u32:bigint,value_type:smallint>"


def read_json_vectors(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``{"row": …, "indices": […], "values": […]}``; lines that are no such object give null arrays, which validation drops."""
    raw = spark.read.schema("row bigint, indices array<bigint>, values array<float>").json(path)
    return raw.select(F.col("row").alias("row_id"), "indices", F.col("values").alias("vals"))


def from_tagged(df: DataFrame, elements: str = "elements") -> DataFrame:
    """``(row_id, elements)`` of tagged elements to ``(row_id, indices, vals)``; a null list gives null arrays."""
    weight = lambda e: decode_tagged(e["value_type"], e["weight_f32"], e["weight_u8"], e["weight_u32"])
    return df.select("row_id", F.transform(elements, lambda e: e["dim_id"]).alias("indices"), F.transform(elements, weight).alias("vals"))


def from_rows(spark: SparkSession, rows: Iterable[tuple[int, Sequence[int], Sequence[float]]]) -> DataFrame:
    """Vectors of a caller's Python values."""
    return spark.createDataFrame([(int(r), [int(d) for d in i], [float(v) for v in w]) for r, i, w in rows], VECTOR_SCHEMA)


def load_vectors(spark: SparkSession, rows: int, nnz: int, dims: int, base: float = 0.1, step: float = 0.001 / 16) -> DataFrame:
    """Deterministic load: row i has the dims ``(i + j) % dims`` with weights ``base + (i + j) * step`` for j below ``nnz`` (at most ``dims``)."""
    places = F.sequence(F.lit(0), F.lit(min(nnz, dims) - 1))
    at = lambda j: F.col("id") + j
    return spark.range(rows).select(
        F.col("id").alias("row_id"), F.transform(places, lambda j: at(j) % dims).alias("indices"), F.transform(places, lambda j: (F.lit(base) + at(j) * F.lit(step)).cast("float")).alias("vals")
    )


def random_vectors(spark: SparkSession, rows: int, dims: int, fill: float = 0.02, most: int = 300, positive: bool = False, seed: int = 1) -> DataFrame:
    """Random sparse vectors of up to ``most`` values within ±100 (or 0 to 100), about ``fill`` of all dims."""
    n = max(1, min(most, int(dims * fill)))
    dims_of = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: F.pmod(F.xxhash64(F.col("id"), j, F.lit(seed)), F.lit(dims)))))
    unit = lambda d: F.pmod(F.xxhash64(d, F.col("id"), F.lit(seed + 1)), F.lit(1_000_003)) / 1_000_003.0
    value = (lambda d: unit(d) * 100.0) if positive else (lambda d: unit(d) * 200.0 - 100.0)
    return spark.range(rows).select(F.col("id").alias("row_id"), dims_of.alias("indices")).withColumn("id", F.col("row_id")).select(
        "row_id", "indices", F.transform("indices", lambda d: value(d).cast("float")).alias("vals")
    )
