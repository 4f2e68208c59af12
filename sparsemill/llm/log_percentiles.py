"""Percentiles with bounded relative error from mergeable counts.

Values are counted in signed logarithmic buckets: bucket i of a sign holds magnitudes in (g^(i-1), g^i] with g = (1 + e) / (1 - e), and
its representative 2 g^i / (g + 1) is within the relative error e of each of them. Zero has its own bucket. Sketches are plain rows of
counts: those of files, days or partitions are merged by adding counts of equal buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative error of every percentile.
RELATIVE_ERROR = 0.005
#: Magnitudes beyond these count in the outer buckets; infinite ones too.
SMALLEST, LARGEST = 1e-300, 1e300


def _gamma(error: float) -> float:
    return (1 + error) / (1 - error)


def log_gamma(error: float = RELATIVE_ERROR) -> float:
    """The logarithm of a bucket's width."""
    return math.log(_gamma(error))


def shift(error: float = RELATIVE_ERROR) -> int:
    """What is added to a magnitude's bucket, so that all are positive."""
    return math.ceil(-math.log(SMALLEST) / log_gamma(error)) + 1


def bucket_of(value: Column, error: float = RELATIVE_ERROR) -> Column:
    """``struct(sign, i)``-like single number: i shifted so that the order of buckets is the order of values; 0 is zero."""
    size = F.least(F.greatest(F.abs(value), F.lit(SMALLEST)), F.lit(LARGEST))
    i = F.ceil(F.log(size) / F.lit(log_gamma(error))) + F.lit(shift(error))
    return F.when(value == 0, F.lit(0)).when(value > 0, i).otherwise(-i).cast("int")


def value_of(bucket: Column, error: float = RELATIVE_ERROR) -> Column:
    """The representative of a bucket."""
    g = _gamma(error)
    size = F.exp((F.abs(bucket) - F.lit(shift(error))) * F.lit(log_gamma(error))) * F.lit(2 / (g + 1))
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket.cast("double")) * size)


def sketch(df: DataFrame, keys: list[str], value: str, error: float = RELATIVE_ERROR) -> DataFrame:
    """``(keys, bucket, n)``. Null and NaN values are left out; null keys form groups. Partial counts are added before the shuffle."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, bucket_of(v, error).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Sketches of separate files as one; they must have the same error."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketched: DataFrame, keys: list[str], qs: dict[str, float], error: float = RELATIVE_ERROR) -> DataFrame:
    """``(keys, n, name…)``: percentile q is the value at place ceil(q * n) of the sorted values, within the relative error.

    A group's window is over its buckets, whose number the error bounds, not over its values.
    """
    place = Window.partitionBy(*keys).orderBy("bucket")
    whole = Window.partitionBy(*keys)
    ranked = sketched.withColumn("_upto", F.sum("n").over(place)).withColumn("_total", F.sum("n").over(whole))

    def at(q: float) -> Column:
        target = F.greatest(F.ceil(F.col("_total") * F.lit(q) - F.lit(1e-9)), F.lit(1))
        return F.min(F.when(F.col("_upto") >= target, F.col("bucket")))

    found = ranked.groupBy(*keys).agg(F.max("_total").alias("n"), *[at(q).alias(name) for name, q in qs.items()])
    return found.select(*keys, "n", *[value_of(F.col(name), error).alias(name) for name in qs])
