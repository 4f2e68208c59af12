"""How often every distinct term occurs and in how many records, by counting in burst tries.

A burst trie keeps terms, as byte strings, in small sorted containers; a container that grows past its limit bursts into one for each next
byte of its terms. Each worker counts into its own trie; subtrees travel by adaptive prefixes and meet in the tries of the receiving
workers, which add them up. The prefixes come from a bounded sample of terms: a prefix that would give one task too many distinct terms
is split by its next byte, again and again, while rare ones stay together under a short prefix. They only decide where terms meet, never
a count.

Terms are strings, or ids below 2^32, which are read as four bytes from the low one up, so that ids of one magnitude spread.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

from sparsemill.session import map_arrow

#: Entries of a container before it bursts, and of a worker's trie before it is sent off and starts anew.
CONTAINER_LIMIT = 4096
TRIE_LIMIT = 2_000_000
#: Terms of the sample that the routes come from, about, and routes for each task of the shuffle at least.
SAMPLE_TERMS = 50_000
ROUTES_PER_TASK = 4
#: Terms that are gathered before they go into a trie.
GATHER = 500_000


class BurstTrie:
    """Containers by prefix: sorted distinct keys with their counters. Adding is by sorted runs, not by single terms."""

    def __init__(self, limit: int = CONTAINER_LIMIT):
        self.limit = limit
        self._leaves: dict[bytes, pa.Table] = {}
        self._burst: set[bytes] = set()
        #: Keys that end where a container has burst.
        self._ends: dict[bytes, pa.Table] = {}

    def __len__(self) -> int:
        return sum(map(len, self._leaves.values())) + len(self._ends)

    def add(self, keys: pa.Array, occurrences: np.ndarray, records: np.ndarray) -> None:
        """``keys``: binary, any order, repeats allowed."""
        if len(keys):
            self._insert(b"", _compact(pa.table({"key": keys, "occ": occurrences, "rec": records})))

    def _insert(self, prefix: bytes, rows: pa.Table) -> None:
        if prefix not in self._burst:
            if prefix in self._leaves:
                rows = _compact(pa.concat_tables([self._leaves[prefix], rows]))
            if len(rows) <= self.limit:
                self._leaves[prefix] = rows
                return
            self._leaves.pop(prefix, None)
            self._burst.add(prefix)
        depth = len(prefix)
        lead = pc.binary_slice(rows["key"], depth, depth + 1).combine_chunks()
        for first, last in _runs(lead):
            byte = lead[first].as_py()
            part = rows.slice(first, last - first)
            if byte:
                self._insert(prefix + byte, part)
            else:
                self._ends[prefix] = _compact(pa.concat_tables([self._ends[prefix], part])) if prefix in self._ends else part

    def containers(self) -> Iterator[pa.Table]:
        yield from self._leaves.values()
        yield from self._ends.values()


def _runs(values: pa.Array) -> list[tuple[int, int]]:
    """(from, to) of equal neighbours."""
    if len(values) < 2:
        return [(0, len(values))] if len(values) else []
    changed = np.flatnonzero(pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)) + 1
    return list(zip([0, *changed.tolist()], [*changed.tolist(), len(values)]))


def _compact(rows: pa.Table) -> pa.Table:
    """Sorted keys with the counters of equal keys added."""
    added = rows.group_by("key").aggregate([("occ", "sum"), ("rec", "sum")])
    added = pa.table({"key": added["key"], "occ": added["occ_sum"], "rec": added["rec_sum"]})
    return added.sort_by("key").combine_chunks()


class Routes:
    """Adaptive prefixes: a term's route is its shortest prefix that is not split."""

    def __init__(self, sample: Sequence[bytes], most: int):
        """No route holds more than ``most`` of the distinct terms of the sample, unless they end there."""
        self.split: set[bytes] = set()
        waiting = [(b"", sorted(set(sample)))]
        while waiting:
            prefix, terms = waiting.pop()
            longer = [t for t in terms if len(t) > len(prefix)]
            if len(longer) <= most:
                continue
            self.split.add(prefix)
            n = len(prefix) + 1
            at = 0
            while at < len(longer):
                child = longer[at][:n]
                end = bisect_right(longer, child + b"\xff" * 64, at)
                waiting.append((child, longer[at:end]))
                at = end

    def of(self, term: bytes) -> bytes:
        n = 0
        while n < len(term) and term[:n] in self.split:
            n += 1
        return term[:n]

    def cut(self, keys: pa.Array) -> Iterator[tuple[bytes, int, int]]:
        """(route, from, to) of sorted keys; a route's keys lie together, so few of them are looked at."""
        first = 0
        while first < len(keys):
            route = self.of(keys[first].as_py())
            low, high = first, len(keys) - 1
            while low < high:
                middle = (low + high + 1) // 2
                if self.of(keys[middle].as_py()) == route:
                    low = middle
                else:
                    high = middle - 1
            yield route, first, low + 1
            first = low + 1


def _encode(terms: pa.Array, ids: bool) -> tuple[pa.Array, np.ndarray | None]:
    """Terms as binary keys, and which of them count."""
    if not ids:
        return terms.cast(pa.binary()), np.asarray(terms.is_valid())
    values = np.asarray(terms.cast(pa.int64()).fill_null(-1))
    ok = (values >= 0) & (values < 2**32)
    data = pa.py_buffer(np.ascontiguousarray(values[ok].astype("<u4")))
    return pa.Array.from_buffers(pa.binary(4), int(ok.sum()), [None, data]).cast(pa.binary()), ok


def _decode(keys: pa.Array, ids: bool) -> pa.Array:
    if not ids:
        return keys.cast(pa.string())
    return pa.array(np.frombuffer(b"".join(keys.to_pylist()), "<u4").astype(np.int64))


_PARTIAL = "route binary, terms array<binary>, occurrences array<bigint>, records array<bigint>"


def _counter(routes: Routes, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie()
        held, size, first_row = [], 0, 0
        for batch in batches:
            lists = batch.column(0)
            sizes = np.asarray(lists.value_lengths().fill_null(0))
            keys, ok = _encode(lists.flatten(), ids)
            record = np.repeat(np.arange(first_row, first_row + len(sizes), dtype=np.int64), sizes)[ok]
            first_row += len(sizes)
            held.append(pa.table({"row": record, "key": keys if ids else keys.filter(pa.array(ok))}))
            size += len(record)
            if size >= GATHER:
                _gather(trie, held)
                held, size = [], 0
                if len(trie) > TRIE_LIMIT:
                    yield from _send(trie, routes)
                    trie = BurstTrie()
        _gather(trie, held)
        yield from _send(trie, routes)

    return run


def _gather(trie: BurstTrie, held: list[pa.Table]) -> None:
    """Whole records: of each (record, term) the occurrences, of each term their sum and number."""
    if held:
        pairs = pa.concat_tables(held).group_by(["row", "key"]).aggregate([([], "count_all")])
        by_key = pairs.group_by("key").aggregate([("count_all", "sum"), ([], "count_all")])
        trie.add(by_key["key"].combine_chunks(), np.asarray(by_key["count_all_sum"]), np.asarray(by_key["count_all"]))


def _send(trie: BurstTrie, routes: Routes, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for table in trie.containers():
        keys = table["key"].combine_chunks()
        for route, first, last in routes.cut(keys):
            out.append((route, keys[first:last], np.asarray(table["occ"])[first:last], np.asarray(table["rec"])[first:last]))
        if len(out) >= rows:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(x[1]) for x in out])]).astype(np.int32)
    terms = pa.ListArray.from_arrays(offsets, pa.concat_arrays([x[1] for x in out]))
    counts = [pa.ListArray.from_arrays(offsets, np.concatenate([x[i] for x in out]).astype(np.int64)) for i in (2, 3)]
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), terms, *counts], names=["route", "terms", "occurrences", "records"])


def _merger(ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie()
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.table({"key": batch.column(1).flatten(), "occ": batch.column(2).flatten(), "rec": batch.column(3).flatten()}))
            if sum(map(len, held)) >= GATHER:
                rows, held = pa.concat_tables(held).combine_chunks(), []
                trie.add(rows["key"].combine_chunks(), np.asarray(rows["occ"]), np.asarray(rows["rec"]))
        if held:
            rows = pa.concat_tables(held).combine_chunks()
            trie.add(rows["key"].combine_chunks(), np.asarray(rows["occ"]), np.asarray(rows["rec"]))
        for table in trie.containers():
            columns = [_decode(table["key"].combine_chunks(), ids), *(table[c].combine_chunks().cast(pa.int64()) for c in ("occ", "rec"))]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "occurrences", "records"])

    return run


def sample_routes(lists: DataFrame, ids: bool) -> Routes:
    """Routes from about SAMPLE_TERMS terms of ``lists(terms)``: as many as give each task of the shuffle ROUTES_PER_TASK of them or more."""
    total = lists.agg(F.sum(F.size("terms"))).first()[0] or 0
    drawn = lists.select(F.explode("terms").alias("t")).where(F.col("t").isNotNull())
    sample = drawn.sample(fraction=min(1.0, SAMPLE_TERMS / max(total, 1)), seed=1).distinct().limit(4 * SAMPLE_TERMS).collect()
    keys, _ = _encode(pa.array([r["t"] for r in sample], pa.int64() if ids else None), ids) if sample else (pa.array([], pa.binary()), None)
    tasks = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Routes(keys.to_pylist(), max(1, len(sample) // (ROUTES_PER_TASK * tasks)))


def term_counts(df: DataFrame, terms: str, sampled: DataFrame | None = None) -> DataFrame:
    """``(term, occurrences, records)`` of every distinct term in the array column ``terms``, of ids or strings (or bytes in UTF-8).

    Null arrays and null elements count nothing; ids outside 0 <= id < 2^32 are left out; the empty string is a term. A row is a record; a
    term repeated in one row adds several occurrences and one record. An empty table gives no rows. ``sampled`` may be a cheaper table
    with the same column of about the same terms, to draw the routes from.
    """
    element = df.schema[terms].dataType.elementType if isinstance(df.schema[terms].dataType, ArrayType) else None
    ids = not isinstance(element, (StringType, BinaryType))
    kind = "bigint" if ids else "string"

    def lists(frame: DataFrame) -> DataFrame:
        return frame.select(F.col(terms).cast(f"array<{kind}>").alias("terms")).where(F.size("terms") > 0)

    routes = sample_routes(lists(df if sampled is None else sampled), ids)
    parts = map_arrow(lists(df), _counter(routes, ids), _PARTIAL)
    return map_arrow(parts.repartition(F.col("route")), _merger(ids), f"term {kind}, occurrences bigint, records bigint")


def mark_useless(counts: DataFrame, n_records: DataFrame, min_records: int = 5, max_share: float = 0.4) -> DataFrame:
    """Adds ``mark``: ``rare`` below ``min_records`` records, ``common`` above ``max_share`` of all records, else null.

    ``n_records`` is one row with the number of all records in ``n_records``.
    """
    total = n_records.first()["n_records"]
    records = F.col("records")
    return counts.withColumn("mark", F.when(records < min_records, F.lit("rare")).when(records > F.lit(max_share) * F.lit(total), F.lit("common")))
