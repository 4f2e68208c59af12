"""Path-keyed facade: create, insert, delete, commit, load, search."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from sparsemill.config import IndexSettings
from sparsemill.sources.index import NotFound, SparseIndex
from sparsemill.sources.reader import IndexReader
from sparsemill.sources.writer import IndexWriter

log = logging.getLogger("sparsemill")
_writers: dict[str, IndexWriter] = {}
_readers: dict[str, IndexReader] = {}


def _key(path: str) -> str:
    return path.rstrip("/")


def create_index(spark: SparkSession, path: str, settings: IndexSettings | Mapping | str | None = None) -> bool:
    """New index with an open writer; an open writer or reader of that path is closed first."""
    if isinstance(settings, str):
        settings = IndexSettings.from_json(settings)
    elif isinstance(settings, Mapping):
        settings = IndexSettings.from_json(json.dumps(dict(settings)))
    close_writer(path)
    close_reader(path)
    _writers[_key(path)] = SparseIndex.create(spark, _key(path), settings).writer()
    log.info("index created at %s", path)
    return True


def _writer(spark: SparkSession, path: str) -> IndexWriter:
    if _key(path) not in _writers:
        _writers[_key(path)] = SparseIndex.open(spark, _key(path)).writer()
    return _writers[_key(path)]


def insert(spark: SparkSession, path: str, row_id: int, vector: Mapping[int, float], replace_row: bool = False) -> int:
    return _writer(spark, path).insert(row_id, vector, replace_row)


def insert_df(spark: SparkSession, path: str, vectors: DataFrame, replace_row: bool = False) -> int:
    return _writer(spark, path).append(vectors, replace_row=replace_row)


def delete(spark: SparkSession, path: str, rows: DataFrame | Iterable[int]) -> int:
    """Delete rows by id; seen after the next commit."""
    return _writer(spark, path).delete_rows(rows)


def commit(spark: SparkSession, path: str) -> int:
    """Commit and let a loaded reader see it."""
    stamp = _writer(spark, path).commit()
    if _key(path) in _readers:
        _readers[_key(path)].reload()
    return stamp


def close_writer(path: str) -> bool:
    """False if there is none."""
    writer = _writers.pop(_key(path), None)
    if writer:
        writer.close()
    return writer is not None


def load_reader(spark: SparkSession, path: str) -> bool:
    _readers[_key(path)] = SparseIndex.open(spark, _key(path)).reader()
    return True


def close_reader(path: str) -> bool:
    return _readers.pop(_key(path), None) is not None


def search(path: str, query: Mapping[int, float], k: int, alive: DataFrame | bytes | None = None) -> DataFrame:
    """Top k of the loaded snapshot; an error if no reader is loaded."""
    if _key(path) not in _readers:
        raise NotFound(f"no reader is loaded for {path}")
    return _readers[_key(path)].searcher().search(query, k, alive)
