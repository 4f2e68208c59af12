"""The single writer of an index: appends, deletes, two-phase commit, rollback, compaction."""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsemill.config import IndexSettings
from sparsemill.functions.vectors import require_valid
from sparsemill.operators import merge as M
from sparsemill.operators import postings as P
from sparsemill.session import BROADCAST_ROWS
from sparsemill.sources.index import Deletes, Locked, Segment, Snapshot, SparseIndex

_LOCK = ".writer.lock"


class PreparedCommit:
    """Segments are on storage but invisible until ``commit``."""

    def __init__(self, writer: IndexWriter, opstamp: int):
        self._writer, self.opstamp, self._payload = writer, opstamp, None

    def set_payload(self, payload: str) -> None:
        self._payload = payload

    def commit(self) -> int:
        return self._writer._finish(self.opstamp, self._payload)

    def abort(self) -> int:
        return self._writer.rollback()


def _holder_is_gone(lock: dict) -> bool:
    """Whether the process that wrote the lock ran on this machine and no longer does."""
    if lock.get("host") != socket.gethostname():
        return False
    try:
        os.kill(int(lock["pid"]), 0)
    except (ProcessLookupError, KeyError, ValueError):
        return True
    except PermissionError:
        pass
    return False


class IndexWriter:
    """Only one writer can be open. Its lock names an owner and the time until which it holds; every operation renews it. A lock that has run
    out, whose process is gone, or that has the same owner's name is taken over, and a writer that lost its lock publishes nothing.

    ``insert`` keeps at most ``buffer_rows`` vectors of together about ``buffer_bytes`` on the driver before they become a segment; DataFrames
    are written by the executors.
    """

    def __init__(self, index: SparseIndex, policy=None, buffer_rows: int = 10_000, buffer_bytes: int = 64 << 20, owner: str | None = None, lease_seconds: float = 900.0):
        self.index, self.policy, self._buffer_rows, self._buffer_bytes = index, policy or M.LevelMerge(), buffer_rows, buffer_bytes
        self._owner, self._lease, self._token, self._until = owner, lease_seconds, uuid.uuid4().hex, 0.0
        if not index.folder.create_new(_LOCK, self._lock_text()) and not self._take_over():
            raise Locked(index.path)
        self._open = True
        self._base = index.snapshot()
        self._reset()

    def _lock_text(self) -> str:
        self._until = time.time() + self._lease
        return json.dumps({"token": self._token, "owner": self._owner, "host": socket.gethostname(), "pid": os.getpid(), "until": self._until})

    def _lock(self) -> dict:
        try:
            return json.loads(self.index.folder.read(_LOCK))
        except Exception:  # half written, or gone since
            return {}

    def _take_over(self) -> bool:
        lock = self._lock()
        if (self._owner is not None and lock.get("owner") == self._owner) or lock.get("until", 0.0) < time.time() or _holder_is_gone(lock):
            self.index.folder.replace(_LOCK, self._lock_text())
            return self._lock().get("token") == self._token
        return False

    def _hold(self) -> None:
        """Renew the lock once half of its time is over, and before anything is published."""
        if self._lock().get("token") != self._token:
            self._open = False
            raise Locked("another writer has taken over")
        if self._until - time.time() < self._lease / 2:
            self.index.folder.replace(_LOCK, self._lock_text())

    def _reset(self) -> None:
        self._stamp = self._base.opstamp
        self._staged: list[Segment] = []
        self._deletes: list[Deletes] = []
        self._cleared = False
        self._batch = self._base.stream_batch
        self._clear_buffer()

    def _clear_buffer(self) -> None:
        self._buffer: list[tuple[int, list[int], list[float], int]] = []
        self._held = 0
        self._replacing: list[tuple[int, int]] = []

    def _check(self) -> None:
        if not self._open:
            raise Locked("this writer is closed")

    # ---- adding

    def insert(self, row_id: int, vector: Mapping[int, float] | Sequence[tuple[int, float]], replace_row: bool = False) -> int:
        """One vector; returns its opstamp. Repeated dims or ids out of range are refused. A dim of an older version that the new one lacks
        keeps its weight, unless ``replace_row``.
        """
        self._check()
        entries = list(vector.items()) if isinstance(vector, Mapping) else list(vector)
        dims = [int(d) for d, _ in entries]
        if len(set(dims)) != len(dims) or any(not 0 <= x < 2**32 for x in [*dims, row_id]):
            raise ValueError(f"invalid sparse vector for row {row_id}")
        if any(w != w for _, w in entries):
            raise ValueError(f"NaN weight in row {row_id}")
        self._stamp += 1
        self._buffer.append((int(row_id), dims, [float(w) for _, w in entries], self._stamp))
        if replace_row:
            self._replacing.append((int(row_id), self._stamp - 1))
        self._held += 32 + 16 * len(dims)
        if len(self._buffer) >= self._buffer_rows or self._held >= self._buffer_bytes:
            self._flush()
        return self._stamp

    def run(self, vectors: Iterable[tuple[int, Mapping[int, float]]]) -> int:
        """A batch with consecutive opstamps in one segment; returns the batch's stamp, one past its rows."""
        self._check()
        self._flush()
        for row_id, vector in vectors:
            self.insert(row_id, vector)
        self._flush()
        self._stamp += 1
        return self._stamp

    def append(self, vectors: DataFrame, check: bool = True, replace_row: bool = False) -> int:
        """``vectors(row_id, indices, vals[, opstamp])`` as one segment. Without opstamps the whole batch has the next one. With
        ``replace_row`` nothing is left of a row's older versions; otherwise dims that a new version lacks keep their weight.
        """
        self._check()
        self._flush()
        self._stamp += 1
        if "opstamp" not in vectors.columns:
            vectors = vectors.withColumn("opstamp", F.lit(self._stamp))
        segment = self._store(vectors.select("row_id", "indices", "vals", "opstamp"), check, replace_row)
        if segment:
            self._stamp = max(self._stamp, segment.max_opstamp)
        return self._stamp

    def _store(self, vectors: DataFrame, check: bool = True, replace_row: bool = False) -> Segment | None:
        if check:
            vectors = vectors.withColumn("indices", require_valid(F.col("indices"), F.col("vals")))
        vectors = vectors.persist(StorageLevel.DISK_ONLY)  # read for postings and for rows
        built = P.build_postings(vectors, False, self.index.settings.weight, "opstamp")
        newest = vectors.groupBy("row_id").agg(F.max("opstamp").alias("opstamp"))
        if replace_row:
            built = built.join(newest, ["row_id", "opstamp"], "left_semi")
        segment = self.index.write_segment(str(uuid.uuid4()), P.upsert(built, keep_stamp=True), newest)
        if segment and replace_row:
            self._delete(newest.withColumn("opstamp", F.col("opstamp") - 1))
        vectors.unpersist()
        if segment:
            self._staged.append(segment)
        return segment

    def _flush(self) -> None:
        self._hold()
        if self._buffer:
            rows, replacing = self._buffer, self._replacing
            self._clear_buffer()
            spark = self.index.spark
            gone = spark.createDataFrame(replacing, "row_id bigint, opstamp bigint")
            vectors = spark.createDataFrame(rows, "row_id bigint, indices array<bigint>, vals array<float>, opstamp bigint")
            if replacing:
                # Earlier versions of the same buffer go before it becomes a segment.
                until = gone.groupBy("row_id").agg(F.max("opstamp").alias("_until"))
                vectors = vectors.join(F.broadcast(until), "row_id", "left").where(F.col("_until").isNull() | (F.col("opstamp") > F.col("_until"))).drop("_until")
            self._store(vectors, check=False)
            if replacing:
                self._delete(gone)

    def _delete(self, rows: DataFrame) -> None:
        made = self.index.write_deletes(rows)
        if made:
            self._deletes.append(made)

    def delete_rows(self, rows: DataFrame | Iterable[int]) -> int:
        """Delete rows by id (a DataFrame with ``row_id``, or ids); returns the opstamp. Unknown and null ids delete nothing; a row that is
        inserted again later lives.
        """
        self._check()
        self._flush()
        self._stamp += 1
        if not isinstance(rows, DataFrame):
            rows = self.index.spark.createDataFrame([(int(r),) for r in rows], "row_id bigint")
        self._delete(rows.select("row_id", F.lit(self._stamp).cast("bigint").alias("opstamp")))
        return self._stamp

    def new_segment(self) -> str:
        """Id of a segment that the caller will write with ``SparseIndex.write_segment`` and hand over with ``add_segment``."""
        self._check()
        return str(uuid.uuid4())

    def add_segment(self, segment: Segment) -> None:
        """Register a segment whose files are in place; it must have this index's settings."""
        self._check()
        M.check_mergeable([self.index.settings, self._settings(segment)])
        self._stamp = max(self._stamp, segment.max_opstamp)
        self._staged.append(segment)

    def _settings(self, segment: Segment) -> IndexSettings:
        return IndexSettings.from_json(segment.settings) if segment.settings else self.index.settings

    def delete_all(self) -> int:
        """Drop everything; seen by readers after the next commit."""
        self._check()
        self._staged, self._deletes, self._cleared = [], [], True
        self._clear_buffer()
        self._stamp = self._base.opstamp
        return self._stamp

    # ---- commit

    def prepare_commit(self) -> PreparedCommit:
        self._check()
        self._flush()
        self._stamp += 1
        return PreparedCommit(self, self._stamp)

    def commit(self, payload: str | None = None) -> int:
        prepared = self.prepare_commit()
        if payload is not None:
            prepared.set_payload(payload)
        return prepared.commit()

    def _finish(self, opstamp: int, payload: str | None) -> int:
        self._check()
        kept = () if self._cleared else self._base.segments
        deletes = (() if self._cleared else self._base.tombstones) + tuple(self._deletes)
        segments = tuple(sorted((*kept, *self._staged), key=lambda s: (-s.rows_count, s.segment_id)))
        unique = (self._cleared or self._base.unique_rows) and self._adds_no_row(kept, self._staged)
        self._publish(replace(
            self._base, version=self._base.version + 1, opstamp=opstamp, segments=segments, payload=payload, stream_batch=self._batch, unique_rows=unique,
            tombstones=deletes if segments else (),
        ))
        for group in self.policy.candidates([M.SegmentSize(s.segment_id, s.rows_count) for s in segments]):
            if len(group) > 1:
                self.compact(group)
        return opstamp

    def _adds_no_row(self, kept: Sequence[Segment], fresh: Sequence[Segment]) -> bool:
        """Whether no row of a fresh segment is in another one too; a reader then skips the last-wins step.

        Segments whose ranges of rows do not meet are not read at all; of others only the ids within the fresh segment's range.
        """
        seen = list(kept)
        for s in fresh:
            others = [o for o in seen if o.min_row <= s.max_row and s.min_row <= o.max_row]
            if others:
                own = self.index.segment_rows(s.segment_id).select("row_id")
                known = self.index.spark.read.parquet(*[self.index.segment_path(o.segment_id, "rows") for o in others]).where(F.col("row_id").between(s.min_row, s.max_row))
                own = F.broadcast(own) if s.rows_count <= BROADCAST_ROWS else own
                if not known.select("row_id").join(own, "row_id", "left_semi").isEmpty():
                    return False
            seen.append(s)
        return True

    def _publish(self, snapshot: Snapshot) -> None:
        self._hold()
        self.index._publish(snapshot)
        self._base = snapshot
        self._reset()

    def rollback(self) -> int:
        """Forget everything since the last commit; returns its opstamp."""
        self._check()
        for s in self._staged:
            self.index.folder.delete(f"segments/{s.segment_id}")
        for t in self._deletes:
            self.index.folder.delete(f"deletes/{t.delete_id}")
        self._reset()
        return self._base.opstamp

    # ---- merging

    def compact(self, segment_ids: Sequence[str]) -> Segment | None:
        """Merge committed segments into one and publish; results of searches stay the same."""
        self._check()
        chosen = [s for s in self._base.segments if s.segment_id in set(segment_ids)]
        if len(chosen) != len(set(segment_ids)):
            raise ValueError("only committed segments can be merged")
        gone = self._base.tombstones
        # One segment alone is worth a merge only for what was deleted from it.
        M.check_mergeable([self.index.settings] * bool(gone) + [self._settings(s) for s in chosen])
        postings = P.upsert(self.index.without_deleted(self._all(chosen, "postings"), gone), keep_stamp=True)
        stamps = self.index.without_deleted(self._all(chosen, "rows"), gone).groupBy("row_id").agg(F.max("opstamp").alias("opstamp"))
        merged = self.index.write_segment(str(uuid.uuid4()), postings, stamps)
        self._hold()
        rest = [s for s in self._base.segments if s not in chosen]
        segments = tuple(sorted(rest + ([merged] if merged else []), key=lambda s: (-s.rows_count, s.segment_id)))
        # Deletes are done with once every segment has gone through them; rows are unique again once there is one segment.
        self._base = replace(
            self._base, version=self._base.version + 1, segments=segments, unique_rows=self._base.unique_rows or len(segments) < 2, tombstones=gone if rest else ()
        )
        self.index._publish(self._base)
        return merged

    def _all(self, segments: Sequence[Segment], part: str) -> DataFrame:
        read = self.index.segment_postings if part == "postings" else self.index.segment_rows
        out = read(segments[0].segment_id)
        for s in segments[1:]:
            out = out.unionByName(read(s.segment_id))
        return out

    def vacuum(self, keep_versions: int = 1) -> list[str]:
        """Delete what no living snapshot names; staged segments stay."""
        self._check()
        if self._staged or self._deletes:
            raise Locked("commit or roll back before a vacuum")
        return self.index.vacuum(keep_versions)

    def close(self) -> None:
        """Release the lock; what was not committed is dropped."""
        if self._open:
            self.rollback()
            if self._lock().get("token") == self._token:
                self.index.folder.delete(_LOCK)
            self._open = False

    def __enter__(self) -> IndexWriter:
        return self

    def __exit__(self, *_) -> None:
        self.close()
