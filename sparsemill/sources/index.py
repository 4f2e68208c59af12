"""An index on storage: settings, immutable snapshots, a pointer to the newest one, segments in Parquet.

    <dir>/index_settings.json
    <dir>/_snapshots/<version>.json     segments, opstamp, payload, last stream batch
    <dir>/meta.json                     number of the newest snapshot, replaced whole
    <dir>/segments/<id>/postings/       clustered by range of dim_id, sorted by (dim_id, row_id)
    <dir>/segments/<id>/rows/           row_id, opstamp of each vector, empty ones included
    <dir>/segments/<id>/params/         quantized indexes: q_min and q_diff of each list
    <dir>/segments/<id>/stats/          extended indexes: size and greatest weight of each list
    <dir>/deletes/<id>/                 row_id, opstamp: what the row wrote up to that opstamp is gone
    <dir>/.writer.lock                  who writes, and until when

A commit writes segments first and swaps the pointer last: readers see the old or the new snapshot. Nothing in place is rewritten. The swap
needs a file system whose rename replaces a file in one step (HDFS, local disks, and the like; not a bare object store).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsemill.config import IndexSettings
from sparsemill.functions.weights import lowest_weight
from sparsemill.operators import postings as P
from sparsemill.session import broadcast_if_small, ensure_checkpoint_dir
from sparsemill.sources.filesystem import Folder


class StorageError(Exception):
    """Base of this package's storage errors."""


class AlreadyExists(StorageError):
    """There is an index in that folder."""


class NotFound(StorageError):
    """There is no index in that folder."""


class Locked(StorageError):
    """Another writer holds the index."""


class Corrupt(StorageError):
    """A file of the index cannot be understood."""


@dataclass(frozen=True)
class Segment:
    segment_id: str
    rows_count: int
    postings_count: int
    checksum: int
    min_opstamp: int
    max_opstamp: int
    min_row: int = 0
    max_row: int = 2**32 - 1
    #: Checksums of the parts beside the postings.
    parts: tuple[tuple[str, int, int], ...] = ()
    settings: str = ""


@dataclass(frozen=True)
class Deletes:
    """A table of (row_id, opstamp)."""

    delete_id: str
    rows_count: int


@dataclass(frozen=True)
class Snapshot:
    version: int = 0
    opstamp: int = 0
    segments: tuple[Segment, ...] = ()
    payload: str | None = None
    stream_batch: int = -1
    unique_rows: bool = True
    tombstones: tuple[Deletes, ...] = field(default=())

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Snapshot:
        try:
            raw = json.loads(text)
            raw["segments"] = tuple(Segment(**{**s, "parts": tuple(map(tuple, s.get("parts", ())))}) for s in raw["segments"])
            raw["tombstones"] = tuple(Deletes(**t) for t in raw["tombstones"])
            return cls(**raw)
        except (ValueError, KeyError, TypeError) as error:
            raise Corrupt(f"snapshot: {error}") from error


class SparseIndex:
    """Handle of an index folder."""

    def __init__(self, spark: SparkSession, path: str, settings: IndexSettings):
        self.spark, self.settings = spark, settings
        self.folder = Folder(spark, path)
        self.path = self.folder.path

    @classmethod
    def exists(cls, spark: SparkSession, path: str) -> bool:
        return Folder(spark, path).exists("meta.json")

    @classmethod
    def create(cls, spark: SparkSession, path: str, settings: IndexSettings | None = None) -> SparseIndex:
        """A new empty index; refuses a folder that has one."""
        if cls.exists(spark, path):
            raise AlreadyExists(path)
        index = cls(spark, path, settings or IndexSettings())
        index.folder.make("_snapshots")
        index.folder.replace("index_settings.json", index.settings.to_json())
        index._publish(Snapshot())
        return index

    @classmethod
    def create_temporary(cls, spark: SparkSession, settings: IndexSettings | None = None) -> SparseIndex:
        """A new index in a folder of its own under the session's shared checkpoint directory; ``drop`` removes it."""
        ensure_checkpoint_dir(spark)
        return cls.create(spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/index-{uuid.uuid4()}", settings)

    def drop(self) -> None:
        """Delete the whole folder."""
        self.folder.delete()

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SparseIndex:
        if not cls.exists(spark, path):
            raise NotFound(path)
        folder = Folder(spark, path)
        return cls(spark, path, IndexSettings.from_json(folder.read("index_settings.json")))

    def _publish(self, snapshot: Snapshot) -> None:
        self.folder.replace(f"_snapshots/{snapshot.version}.json", snapshot.to_json())
        self.folder.replace("meta.json", json.dumps({"version": snapshot.version}))

    def version(self) -> int:
        try:
            return int(json.loads(self.folder.read("meta.json"))["version"])
        except (ValueError, KeyError) as error:
            raise Corrupt(f"meta.json: {error}") from error

    def snapshot(self, version: int | None = None) -> Snapshot:
        return Snapshot.from_json(self.folder.read(f"_snapshots/{self.version() if version is None else version}.json"))

    def segments_frame(self, snapshot: Snapshot | None = None) -> DataFrame:
        """The manifest as a table (its rows are segments, not data)."""
        snapshot = snapshot or self.snapshot()
        rows = [(s.segment_id, s.rows_count, s.postings_count, s.checksum) for s in snapshot.segments]
        return self.spark.createDataFrame(rows, "segment_id string, rows_count bigint, postings_count bigint, checksum bigint")

    # ---- segments

    def segment_path(self, segment_id: str, part: str = "postings") -> str:
        return f"{self.path}/segments/{segment_id}/{part}"

    def write_segment(self, segment_id: str, postings: DataFrame, rows: DataFrame) -> Segment | None:
        """Store ``postings(dim_id, row_id, weight, opstamp)`` and ``rows(row_id, opstamp)``; None when there is no row.

        Range partitioning by dim_id keeps a list together for the scan; a hot dim is cut by row_id, as both are range keys.
        """
        # All segments have the same types, as they are read together.
        data = postings.select(*[F.col(c).cast(t).alias(c) for c, t in (("dim_id", "bigint"), ("row_id", "bigint"), ("weight", "float"), ("opstamp", "bigint"))])
        rows = rows.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("opstamp").cast("bigint").alias("opstamp"))
        if self.settings.quantized:
            params = P.quant_params(data)
            params.write.mode("overwrite").parquet(self.segment_path(segment_id, "params"))
            stored = self.spark.read.parquet(self.segment_path(segment_id, "params"))
            data = P.quantize_postings(data, stored).select("dim_id", "row_id", "code", "opstamp")
        elif self.settings.element == "extended":
            data = P.with_suffix_max(data, lowest_weight(self.settings.weight))
        data = data.persist(StorageLevel.DISK_ONLY)  # sampled for its ranges, then written
        writer = data.repartitionByRange("dim_id", "row_id").sortWithinPartitions("dim_id", "row_id").write.mode("overwrite")
        writer.options(**self.settings.writer_options()).parquet(self.segment_path(segment_id))
        data.unpersist()
        # Sorted, so that a later commit's check for its rows reads few row groups.
        rows.repartitionByRange("row_id").sortWithinPartitions("row_id").write.mode("overwrite").parquet(self.segment_path(segment_id, "rows"))
        counted = self.spark.read.parquet(self.segment_path(segment_id, "rows")).agg(
            F.count(F.lit(1)).alias("n"), F.min("opstamp").alias("lo"), F.max("opstamp").alias("hi"), F.min("row_id").alias("first"), F.max("row_id").alias("last"),
            F.bit_xor(F.xxhash64("opstamp", "row_id")).alias("x"),
        ).first()
        if not counted["n"]:
            self.folder.delete(f"segments/{segment_id}")
            return None
        parts = [("rows", counted["n"], counted["x"])]
        if self.settings.quantized:
            parts.append(("params", *self._checksum(segment_id, "params")))
        if self.settings.supports_pruning:
            stats = self.spark.read.parquet(self.segment_path(segment_id)).groupBy("dim_id").agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("min_w"), F.max("weight").alias("max_w"))
            stats.repartitionByRange("dim_id").sortWithinPartitions("dim_id").write.mode("overwrite").parquet(self.segment_path(segment_id, "stats"))
            parts.append(("stats", *self._checksum(segment_id, "stats")))
        n, checksum = self._checksum(segment_id)
        return Segment(
            segment_id, counted["n"], n, checksum, counted["lo"], counted["hi"], counted["first"], counted["last"], tuple(parts), self.settings.to_json()
        )

    def _checksum(self, segment_id: str, part: str = "postings") -> tuple[int, int]:
        """Rows and a checksum of what is stored, which does not depend on their order."""
        stored = self.spark.read.parquet(self.segment_path(segment_id, part))
        r = stored.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*sorted(stored.columns))).alias("x")).first()
        return r["n"], r["x"] or 0

    def validate_checksums(self) -> list[str]:
        """Ids of segments of which some part is not what the manifest says."""
        damaged = []
        for s in self.snapshot().segments:
            try:
                if any(self._checksum(s.segment_id, part) != (n, x) for part, n, x in (("postings", s.postings_count, s.checksum), *s.parts)):
                    damaged.append(s.segment_id)
            except Exception:  # unreadable files are damage too
                damaged.append(s.segment_id)
        return damaged

    # ---- deletes

    def write_deletes(self, rows: DataFrame) -> Deletes | None:
        """Store ``rows(row_id, opstamp)``; null ids delete nothing."""
        delete_id = str(uuid.uuid4())
        rows = rows.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("opstamp").cast("bigint").alias("opstamp"))
        newest = rows.where(F.col("row_id").isNotNull()).groupBy("row_id").agg(F.max("opstamp").alias("opstamp"))
        newest.write.mode("overwrite").parquet(f"{self.path}/deletes/{delete_id}")
        n = self.spark.read.parquet(f"{self.path}/deletes/{delete_id}").count()
        if not n:
            self.folder.delete(f"deletes/{delete_id}")
            return None
        return Deletes(delete_id, n)

    def without_deleted(self, df: DataFrame, deletes: tuple[Deletes, ...]) -> DataFrame:
        """``df(row_id, opstamp, …)`` without what a row wrote up to its delete; the list of deletes is broadcast if it is small."""
        if not deletes:
            return df
        gone = self.spark.read.parquet(*[f"{self.path}/deletes/{t.delete_id}" for t in deletes]).groupBy("row_id").agg(F.max("opstamp").alias("_until"))
        return df.join(broadcast_if_small(gone), "row_id", "left").where(F.col("_until").isNull() | (F.col("opstamp") > F.col("_until"))).drop("_until")

    def segment_postings(self, segment_id: str) -> DataFrame:
        """``(dim_id, row_id, weight, opstamp)`` of a segment, decoded where quantized."""
        stored = self.spark.read.parquet(self.segment_path(segment_id))
        if self.settings.quantized:
            params = self.spark.read.parquet(self.segment_path(segment_id, "params"))
            stored = P.dequantize_postings(stored.join(params, "dim_id"))
        return stored.select("dim_id", "row_id", "weight", "opstamp")

    def list_stats(self, snapshot: Snapshot, dims: list[int]) -> DataFrame | None:
        """``(dim_id, n, min_w, max_w)`` of some lists over all segments, from the stored statistics; None where there are none."""
        if not self.settings.supports_pruning or not snapshot.segments:
            return None
        stats = self.spark.read.parquet(*[self.segment_path(s.segment_id, "stats") for s in snapshot.segments]).where(F.col("dim_id").isin(dims))
        return stats.groupBy("dim_id").agg(F.sum("n").alias("n"), F.min("min_w").alias("min_w"), F.max("max_w").alias("max_w"))

    def segment_rows(self, segment_id: str) -> DataFrame:
        return self.spark.read.parquet(self.segment_path(segment_id, "rows")).select("row_id", "opstamp")

    def vacuum(self, keep_versions: int = 1) -> list[str]:
        """Delete segments that none of the newest ``keep_versions`` snapshots names; returns their ids. Needs the writer's lock."""
        newest = self.version()
        keep = range(max(0, newest - keep_versions + 1), newest + 1)
        living = {s.segment_id for v in keep if self.folder.exists(f"_snapshots/{v}.json") for s in self.snapshot(v).segments}
        dead = [s for s in self.folder.list("segments") if s not in living]
        for s in dead:
            self.folder.delete(f"segments/{s}")
        named = {t.delete_id for v in keep if self.folder.exists(f"_snapshots/{v}.json") for t in self.snapshot(v).tombstones}
        for t in self.folder.list("deletes"):
            if t not in named:
                self.folder.delete(f"deletes/{t}")
        for name in self.folder.list("_snapshots"):
            if name.endswith(".json") and int(name[:-5]) not in keep:
                self.folder.delete(f"_snapshots/{name}")
        return dead

    def writer(self, policy=None, buffer_rows: int = 10_000, **options):
        from sparsemill.sources.writer import IndexWriter

        return IndexWriter(self, policy, buffer_rows, **options)

    def reader(self):
        from sparsemill.sources.reader import IndexReader

        return IndexReader(self)
