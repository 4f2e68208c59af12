"""Union of segments and the policies that choose which segments to merge."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsemill.config import IndexSettings, SettingsError
from sparsemill.operators import postings as P


def merge_postings(parts: Sequence[DataFrame]) -> DataFrame:
    """Exact union of the parts, newest weight per (dim_id, row_id)."""
    return P.upsert(reduce(lambda a, b: a.unionByName(b), parts))


def merge_extended(parts: Sequence[DataFrame], lowest: float = float("-inf")) -> DataFrame:
    """Union, then suffix maxima anew."""
    return P.with_suffix_max(merge_postings(parts), lowest)


def merge_quantized(parts: Sequence[DataFrame], params: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Each part is decoded with its own parameters, the union gets new ones: ``(coded postings, params)``."""
    plain = [P.dequantize_postings(p.join(q, "dim_id")).select("dim_id", "row_id", "weight", "opstamp") for p, q in zip(parts, params, strict=True)]
    merged = merge_postings(plain)
    fresh = P.quant_params(merged)
    return P.quantize_postings(merged, fresh).select("dim_id", "row_id", "code"), fresh


def check_mergeable(settings: Sequence[IndexSettings]) -> None:
    """At least two inputs, all of the same settings."""
    if len(settings) < 2:
        raise SettingsError("a merge needs at least two segments")
    if len(set(settings)) > 1:
        raise SettingsError("segments with different settings cannot be merged")


@dataclass(frozen=True)
class SegmentSize:
    segment_id: str
    rows_count: int


class NoMerge:
    """Never merges."""

    def candidates(self, segments: Sequence[SegmentSize]) -> list[list[str]]:
        return []


class MergeAll:
    """One merge of everything as soon as there are two segments."""

    def candidates(self, segments: Sequence[SegmentSize]) -> list[list[str]]:
        return [[s.segment_id for s in segments]] if len(segments) > 1 else []


@dataclass(frozen=True)
class LevelMerge:
    """Segments of similar size form a level (sizes within ``level_log`` powers of two, small ones counted as ``floor_rows``); a level of
    ``min_segments`` or more is merged. Segments above ``max_rows`` are left alone.
    """

    level_log: float = 0.75
    floor_rows: int = 10_000
    min_segments: int = 8
    max_rows: int = 10_000_000

    def candidates(self, segments: Sequence[SegmentSize]) -> list[list[str]]:
        ranked = sorted((s for s in segments if s.rows_count <= self.max_rows), key=lambda s: (-s.rows_count, s.segment_id))
        levels: list[list[str]] = []
        top = math.inf
        for s in ranked:
            size = math.log2(max(s.rows_count, self.floor_rows))
            if size < top - self.level_log:
                levels.append([])
                top = size
            elif not levels:
                levels.append([])
            levels[-1].append(s.segment_id)
        return [level for level in levels if len(level) >= self.min_segments]


def segment_sizes(manifest: DataFrame) -> list[SegmentSize]:
    """A manifest table ``(segment_id, rows_count, …)`` for a policy; null counts are 0, a null id is no segment."""
    rows = manifest.where(F.col("segment_id").isNotNull()).select("segment_id", F.coalesce("rows_count", F.lit(0)).alias("n")).collect()
    return [SegmentSize(r["segment_id"], int(r["n"])) for r in rows]
