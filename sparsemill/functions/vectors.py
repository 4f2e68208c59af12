"""Array-form vector expressions: two parallel arrays ``indices`` and ``vals``.

Null arrays give null (or false for predicates), empty arrays are legal vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids are unsigned 32-bit numbers kept as BIGINT.
ID_LIMIT = 2**32


def is_valid(indices: Column, vals: Column) -> Column:
    """Arrays present, of equal length, dims non-null, unique and within 0 <= dim < 2^32. Unsorted and empty are valid."""
    in_range = F.forall(indices, lambda d: F.coalesce((d >= 0) & (d < F.lit(ID_LIMIT)), F.lit(False)))
    return F.coalesce((F.size(indices) == F.size(vals)) & in_range & (F.size(F.array_distinct(indices)) == F.size(indices)), F.lit(False))


def require_valid(indices: Column, vals: Column) -> Column:
    """``indices`` unchanged, or a runtime error for an invalid vector."""
    return F.when(is_valid(indices, vals), indices).otherwise(F.raise_error(F.lit("invalid sparse vector")).cast("array<bigint>"))


def sort_entries(indices: Column, vals: Column) -> Column:
    """Entries ``struct(dim_id, weight)`` by ascending dim; values follow their dims."""
    return F.array_sort(F.zip_with(indices, vals, lambda d, w: F.struct(d.alias("dim_id"), w.alias("weight"))))


def is_sorted(indices: Column) -> Column:
    """Strictly ascending; vectors of less than two dims are sorted."""
    return F.when(F.size(indices) < 2, F.lit(True)).otherwise(
        F.forall(F.sequence(F.lit(1), F.greatest(F.size(indices) - 1, F.lit(1))), lambda i: F.get(indices, i) > F.get(indices, i - 1))
    )


def is_empty(indices: Column) -> Column:
    return F.size(indices) == 0


def dot(indices_a: Column, vals_a: Column, indices_b: Column, vals_b: Column) -> Column:
    """Sparse dot product in double; null when the two share no dim."""
    a, b = F.map_from_arrays(indices_a, vals_a), F.map_from_arrays(indices_b, vals_b)
    shared = F.array_intersect(indices_a, indices_b)
    total = F.aggregate(shared, F.lit(0.0), lambda acc, d: acc + F.element_at(a, d).cast("double") * F.element_at(b, d).cast("double"))
    return F.when(F.size(shared) > 0, total)


def combine(indices_a: Column, vals_a: Column, indices_b: Column, vals_b: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Full outer merge by dim, a missing side counting as 0; the result is sorted ``array<struct(dim_id, weight)>``."""
    a, b = F.map_from_arrays(indices_a, vals_a), F.map_from_arrays(indices_b, vals_b)
    merged = F.map_zip_with(a, b, lambda _, x, y: op(F.coalesce(x, F.lit(0.0).cast("float")), F.coalesce(y, F.lit(0.0).cast("float"))))
    return F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.struct(e["key"].alias("dim_id"), e["value"].alias("weight")))


def decode_tagged(value_type: Column, f32: Column, u8: Column, u32: Column) -> Column:
    """Weight of a tagged element: tag 0 float, 1 byte, 2 unsigned int, any other (or null) 0."""
    return F.when(value_type == 0, f32.cast("float")).when(value_type == 1, u8.cast("float")).when(value_type == 2, u32.cast("float")).otherwise(F.lit(0.0).cast("float"))


def explode_vectors(df: DataFrame, *carry: str, indices: str = "indices", vals: str = "vals") -> DataFrame:
    """Long form: the ``carry`` columns, ``dim_id`` and ``weight``, one row per entry; empty vectors give none."""
    entry = F.explode(F.arrays_zip(F.col(indices).alias("d"), F.col(vals).alias("w"))).alias("_e")
    return df.select(*carry, entry).select(*carry, F.col("_e.d").cast("bigint").alias("dim_id"), F.col("_e.w").cast("float").alias("weight"))


def collect_vectors(postings: DataFrame, dims: list[int] | None = None) -> DataFrame:
    """Postings back to ``(row_id, indices, vals)`` with ascending dims; ``dims`` keeps only those dims."""
    if dims is not None:
        postings = postings.where(F.col("dim_id").isin([int(d) for d in dims]))
    packed = postings.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("dim_id", "weight"))).alias("_e"))
    return packed.select("row_id", F.col("_e.dim_id").alias("indices"), F.col("_e.weight").alias("vals"))
