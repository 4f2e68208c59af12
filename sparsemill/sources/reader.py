"""Point-in-time readers."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsemill.functions.vectors import collect_vectors
from sparsemill.operators import postings as P
from sparsemill.operators import search as S
from sparsemill.sources.index import Snapshot, SparseIndex


class Searcher:
    """One snapshot; commits after it do not change its results."""

    def __init__(self, index: SparseIndex, snapshot: Snapshot):
        self.index, self.snapshot = index, snapshot
        self._cached: DataFrame | None = None

    @property
    def generation(self) -> int:
        return self.snapshot.version

    def _stored(self) -> DataFrame:
        ids = [s.segment_id for s in self.snapshot.segments]
        if not ids:
            return self.index.spark.createDataFrame([], "dim_id bigint, row_id bigint, weight float, opstamp bigint")
        if self.index.settings.quantized:
            out = self.index.segment_postings(ids[0])
            for s in ids[1:]:
                out = out.unionByName(self.index.segment_postings(s))
            return out
        return self.index.spark.read.parquet(*[self.index.segment_path(s) for s in ids]).select("dim_id", "row_id", "weight", "opstamp")

    def postings(self, dims: list[int] | None = None) -> DataFrame:
        """``(dim_id, row_id, weight)``, newest weight of each; the last-wins shuffle is left out where the manifest says rows are unique."""
        if self._cached is not None:
            return self._cached if dims is None else self._cached.where(F.col("dim_id").isin(dims))
        stored = self._stored()
        if dims is not None:
            stored = stored.where(F.col("dim_id").isin(dims))
        stored = self.index.without_deleted(stored, self.snapshot.tombstones)
        return (stored if self.snapshot.unique_rows else P.upsert(stored)).select("dim_id", "row_id", "weight")

    def rows(self) -> DataFrame:
        ids = [s.segment_id for s in self.snapshot.segments]
        if not ids:
            return self.index.spark.createDataFrame([], "row_id bigint")
        stored = self.index.spark.read.parquet(*[self.index.segment_path(s, "rows") for s in ids])
        return self.index.without_deleted(stored, self.snapshot.tombstones).select("row_id").distinct()

    def num_rows(self) -> int:
        """From the manifest, unless rows were deleted or written again since the last merge."""
        if self.snapshot.tombstones or not self.snapshot.unique_rows:
            return self.rows().count()
        return sum(s.rows_count for s in self.snapshot.segments)

    def search(self, query: Mapping[int, float], k: int, alive: DataFrame | bytes | None = None, prune: bool = False) -> DataFrame:
        dims = [int(d) for d in query]
        postings = self.postings(dims)
        # Old or deleted weights only raise the stored maxima, so the bounds stay safe.
        stats = self.index.list_stats(self.snapshot, dims) if prune else None
        return S.search(postings, query, k, alive) if stats is None else S.search_pruned(postings, query, k, alive, stats)

    def search_batch(self, queries: DataFrame, k: int, alive: DataFrame | bytes | None = None) -> DataFrame:
        return S.search_batch(self.postings(), queries, k, alive)

    def brute_force(self, query: Mapping[int, float], k: int, alive: DataFrame | bytes | None = None, include_zero: bool = False) -> DataFrame:
        return S.brute_force(self.postings(), query, k, alive, self.rows() if include_zero else None)

    def row_content(self, row_id: int) -> DataFrame:
        """The stored vector of one row."""
        return collect_vectors(self.postings().where(F.col("row_id") == int(row_id)))

    def warm(self) -> Searcher:
        """Keep the postings in memory (spilling to disk) for many searches."""
        if self._cached is None:
            self._cached = self.postings().cache()
        return self

    def release(self) -> None:
        if self._cached is not None:
            self._cached.unpersist()
            self._cached = None


class IndexReader:
    """Gives searchers. ``reload_on_commit`` looks for a newer snapshot at every ``searcher()``; otherwise only ``reload`` does."""

    def __init__(self, index: SparseIndex, reload_on_commit: bool = False, warmer: Callable[[Searcher], None] | None = None):
        self.index, self.reload_on_commit, self._warmer = index, reload_on_commit, warmer
        self._searcher: Searcher | None = None
        self.reload()

    def reload(self) -> Searcher:
        snapshot = self.index.snapshot()
        if self._searcher is None or self._searcher.generation != snapshot.version:
            old, self._searcher = self._searcher, Searcher(self.index, snapshot)
            if self._warmer:
                self._warmer(self._searcher)
            if old:
                old.release()
        return self._searcher

    def searcher(self) -> Searcher:
        if self.reload_on_commit and self.index.version() != self._searcher.generation:
            self.reload()
        return self._searcher
