"""Weight types as column expressions: f16 and u8 rounding, u8 quantization. No Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of a quantized list are 0..255.
CODE_MAX = 255


def quant_diff(w_min: Column, w_max: Column) -> Column:
    """Step of one code, in float arithmetic."""
    return ((w_max.cast("float") - w_min.cast("float")).cast("float") / F.lit(float(CODE_MAX))).cast("float")


def quantize(weight: Column, q_min: Column, q_diff: Column) -> Column:
    """Nearest code (half away from zero), clamped to 0..255; a list without spread has only code 0. Null gives null."""
    x = ((weight.cast("float") - q_min.cast("float")).cast("float").cast("double") / F.nullif(q_diff.cast("double"), F.lit(0.0))).cast("float").cast("double")
    code = F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(float(CODE_MAX))) + F.lit(0.5)).cast("smallint")
    return F.when(weight.isNull() | q_min.isNull() | q_diff.isNull(), F.lit(None).cast("smallint")).when(q_diff == 0, F.lit(0).cast("smallint")).otherwise(code)


def dequantize(code: Column, q_min: Column, q_diff: Column) -> Column:
    """``q_min + code * q_diff`` in float arithmetic."""
    return (q_min.cast("float") + (code.cast("float") * q_diff.cast("float")).cast("float")).cast("float")


def to_f16(weight: Column) -> Column:
    """The weight rounded to IEEE half precision (ties to even), kept as float."""
    x = weight.cast("double")
    exponent = F.greatest(F.floor(F.log2(F.nullif(F.abs(x), F.lit(0.0)))).cast("double"), F.lit(-14.0)) - F.lit(10.0)
    quantum = F.pow(F.lit(2.0), exponent)
    rounded = F.rint(x / quantum) * quantum
    infinite = F.signum(x) * F.lit(float("inf"))
    return F.when(x == 0, x).when(F.abs(x) >= 65520.0, infinite).otherwise(rounded).cast("float")


def to_u8(weight: Column) -> Column:
    """Saturate to 0..255 and truncate; NaN gives 0."""
    x = F.when(F.isnan(weight), F.lit(0.0)).otherwise(weight.cast("double"))
    return F.when(weight.isNull(), F.lit(None).cast("smallint")).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0)).cast("int").cast("smallint"))


def as_weight_type(weight: Column, kind: str) -> Column:
    """The weight as an index of that type stores it, as float."""
    return {"f32": lambda: weight.cast("float"), "f16": lambda: to_f16(weight), "u8": lambda: to_u8(weight).cast("float")}[kind]()


def lowest_weight(kind: str) -> float:
    """What ends a list's suffix maxima."""
    return 0.0 if kind == "u8" else float("-inf")


def approximately_equal(a: Column, b: Column, q_diff: Column | None = None) -> Column:
    """Equal within one code step (or within half a percent without parameters)."""
    step = F.lit(0.0) if q_diff is None else q_diff.cast("double") * 1.005
    slack = F.greatest(F.abs(a), F.abs(b)).cast("double") * (0.005 if q_diff is None else 0.0)
    return F.abs(a.cast("double") - b.cast("double")) <= F.greatest(step, slack)
