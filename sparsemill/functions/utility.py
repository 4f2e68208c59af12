"""Small helpers around values: time truncation, nested JSON paths, runs of equal keys, byte counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Timestamps have microseconds, so that nanoseconds leave them as they are.
_PRECISIONS = {"s": 1_000_000, "ms": 1_000, "us": 1, "ns": 1}


def truncate_time(ts: Column, precision: str) -> Column:
    """Timestamp cut to seconds, milliseconds, microseconds or nanoseconds, toward the epoch."""
    unit = _PRECISIONS[precision]
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(micros - (micros % F.lit(unit)))


def json_path(*parts: str, expand_dots: bool = False) -> str:
    """Path of a nested field; with ``expand_dots`` a dotted part counts as several."""
    flat = [p for part in parts for p in (part.split(".") if expand_dots else [part])]
    return "$" + "".join(f"['{p}']" for p in flat)


def key_runs(df: DataFrame, key: str, order: str, partition: str) -> DataFrame:
    """Consecutive rows of equal ``key`` in ``order`` within ``partition``: ``(partition, run_no, key, n)``."""
    w = Window.partitionBy(partition).orderBy(order)
    changed = (~F.col(key).eqNullSafe(F.lag(key).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    marked = df.select(partition, order, key, changed.alias("_c"))
    return marked.withColumn("run_no", F.sum("_c").over(w)).groupBy(partition, "run_no", key).agg(F.count(F.lit(1)).alias("n"))


def human_bytes(n: int) -> str:
    """Byte count with a decimal unit."""
    size = float(n)
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if size < 1000 or unit == "TB":
            return f"{n} B" if unit == "B" else f"{size:.2f} {unit}"
        size /= 1000
    return f"{n} B"
