"""The k most similar vectors of every sparse vector by cosine: from a least similarity on, or without one.

Every vector is coded once: each dim has random places among ``BITS`` coordinates, the vector is rotated at random there and kept as one
bit per coordinate plus the correction scalar <code, vector>. Inner products are estimated from packed bits and correction scalars; a pair is
reranked by its exact cosine where the estimate plus some standard errors (``SIGMAS``, ``LIST_SIGMAS``) leaves it a place in the result.

With a least similarity t (``similar_pairs``). Dims are put in one global order, rare ones first. Of a unit vector the leading dims up to
where the rest has a norm below t form its prefix. Two vectors with cosine >= t share a dim of both prefixes (otherwise all they share lies
in a rest of norm < t), so meeting within the cells "prefix dim" misses no pair, and cells of rare dims are small. A cell above ``CELL_ROWS``
is cut into blocks that meet pairwise in tasks of their own; one above ``GIANT_ROWS`` is first divided by bands of code bits, as many as let
a pair of cosine t share one with probability ``BAND_RECALL``.

Without one (``nearest_pairs``) the search has two steps. (1) Dims that at most ``CELL_ROWS`` vectors hold are met by cell, exactly; that
gives most lists, and the k-th cosine of each. (2) What shares no such dim can only be as near as the product of both norms in the common
dims. The vectors that this bound leaves in question look for neighbours among those it admits, by codes of their parts in the common dims:
coarse partitions are prefixes of the code as long as leave about ``CELL_ROWS`` rows each, and a query visits the ``PROBES`` prefixes that its
rotated coordinates make most likely. Lists that still lack cosines above 0 are filled from
the rows with the smallest ids.

Vectors of equal direction (to float precision) form a class with its smallest row_id as representative; only representatives are
compared, and a class enters others' lists with at most k + 1 members, which is all that a list of k can hold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparsemill.functions.vectors import explode_vectors
from sparsemill.session import broadcast_if_small, checkpoint, map_arrow

BITS = 256
SEED = 20_240_607
#: Coordinates among which a dim without one of its own is spread.
PLACES = 16
#: Standard errors that an estimate may fall short before a pair is left out: with a least cosine, and in lists.
SIGMAS = 5.0
LIST_SIGMAS = 3.0
#: Entries of vectors that are rotated at once.
ENTRIES = 20_000
#: Rows of a cell (or of both blocks that meet) that one step compares.
CELL_ROWS = 1024
#: Rows from which a cell is divided by bands of code bits, and the share of pairs at the least cosine that the bands bring together.
GIANT_ROWS = 65_536
BAND_RECALL = 0.999
#: Code prefixes that a query visits, and queries that one task compares with a prefix's rows.
PROBES = 8
QUERY_ROWS = 4096
#: Rows that short lists are filled from.
FILL_ROWS = 64
#: Dims whose number of vectors is looked up; the counts go to all workers (16 bytes each), all other dims count as rare.
LISTED_DIMS = 200_000
#: Slack for float rounding at the least cosine and in the prefixes.
SLACK = 1e-5


def common_dims(long: DataFrame, most: int = LISTED_DIMS) -> tuple[np.ndarray, np.ndarray]:
    """The dims that hold 1 / ``most`` of all entries or more, ascending, and how many each holds: at most ``most`` of them.

    The counts only order dims, so they may come from a log that still has old versions.
    """
    counts = long.groupBy("dim_id").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    listed = counts.where((F.col("n") > 1) & (F.col("n") * most >= total)).collect()
    dims = np.array([r["dim_id"] for r in listed], np.int64)
    order = np.argsort(dims)
    return dims[order], np.array([r["n"] for r in listed], np.int64)[order]


# ---- vectors and codes

_UNITS = "row_id bigint, dims array<bigint>, ws array<double>, cells array<bigint>, code binary, correction float, norm double"


def unit_vectors(live: DataFrame, order: tuple[np.ndarray, np.ndarray], least: float | None) -> DataFrame:
    """``(row_id, dims, ws, cells, code, correction, norm)``: unit vectors with their entries in the global order (rare dims first, equal ones
    by id), the dims in whose cells they meet, and their code.

    With a least cosine the cells are the prefix and the code is of the whole vector. Without one the cells are the dims that are not common,
    and code and ``norm`` are those of the part in the common dims. Elements without a value and zeros are left out; vectors without any
    entry or with an infinite norm do not appear.
    """
    listed, counts = order
    common = listed[counts > CELL_ROWS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(1).flatten(), dtype=np.int64)
            ws = np.array(batch.column(2).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=np.float64)
            sizes = np.asarray(batch.column(1).value_lengths())
            row = np.repeat(np.arange(len(sizes)), sizes)
            norm = np.sqrt(np.bincount(row, np.nan_to_num(ws, nan=0.0, posinf=np.inf, neginf=np.inf) ** 2, len(sizes)))
            ok = np.isfinite(ws) & (ws != 0) & np.isfinite(norm[row]) & (norm[row] > 0)
            dims, row, ws = dims[ok], row[ok], ws[ok] / norm[row[ok]]
            at = np.minimum(np.searchsorted(listed, dims), max(len(listed) - 1, 0))
            count = np.where(listed[at] == dims, counts[at], 0) if len(listed) else np.zeros(len(dims), np.int64)
            placed = np.lexsort((dims, count, row))
            dims, row, ws, count = dims[placed], row[placed], ws[placed], count[placed]
            start = np.searchsorted(row, np.arange(len(sizes) + 1))
            if least is None:
                met = count <= CELL_ROWS
                codes = Codes(dims[~met], ws[~met], np.searchsorted(row[~met], np.arange(len(sizes) + 1)), common)
            else:
                before = np.concatenate([[0.0], np.cumsum(ws**2)])
                met = 1.0 - (before[:-1] - before[start[row]]) >= (least - SLACK) ** 2
                codes = Codes(dims, ws, start)
            cells = np.concatenate([[0], np.cumsum(met)])[start]
            some = np.flatnonzero(np.diff(start))
            offsets = np.concatenate([start[some], start[-1:]]).astype(np.int32)
            cell_offsets = np.concatenate([cells[some], cells[-1:]]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, dims), pa.ListArray.from_arrays(offsets, ws), pa.ListArray.from_arrays(cell_offsets, dims[met])]
            code = [_binary(codes.packed[some]), pa.array(codes.correction[some].astype(np.float32)), pa.array(codes.true_norms[some])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), *lists, *code], names=["row_id", "dims", "ws", "cells", "code", "correction", "norm"])

    usable = live.where(F.col("row_id").isNotNull() & F.col("indices").isNotNull() & F.col("vals").isNotNull())
    return map_arrow(usable.select("row_id", "indices", "vals"), run, _UNITS)


def _binary(packed: np.ndarray) -> pa.Array:
    offsets = (np.arange(len(packed) + 1) * packed.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(packed))])


def _packed(codes: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, BITS // 8)


def with_content(units: DataFrame) -> DataFrame:
    """Adds ``_h`` and ``_m``, 128 bits of content hash: equal for equal directions (to float precision)."""
    light = F.transform("ws", lambda w: w.cast("float"))
    return units.withColumns({"_h": F.xxhash64(F.lit(1), "dims", light), "_m": F.xxhash64(F.lit(2), "dims", light)})


def with_classes(keyed: DataFrame) -> DataFrame:
    """Adds ``class_id``, the smallest row_id of an equal content, and ``copies``, whether there are others."""
    classes = keyed.groupBy("_h", "_m").agg(F.min("row_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")
    joined = keyed.join(broadcast_if_small(classes), ["_h", "_m"], "left")
    return joined.withColumns({"class_id": F.coalesce("_first", "row_id"), "copies": F.col("_first").isNotNull()}).drop("_h", "_m", "_first")


class Codes:
    """One-bit codes of sparse vectors. Dims in ``columns`` (at most BITS of them) have a coordinate of their own, so that nothing but the
    bits blurs the estimates; without columns, or with more of them, each dim is spread over PLACES coordinates by random signs.
    """

    def __init__(self, dims: np.ndarray, weights: np.ndarray, offsets: np.ndarray, columns: np.ndarray | None = None):
        n = len(offsets) - 1
        self.own = columns is not None and len(columns) <= BITS
        self.rotated = np.zeros((n, BITS), np.float32)
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + ENTRIES, side="right")) - 1)
            part = slice(offsets[first], offsets[last])
            placed = np.zeros((last - first, BITS), np.float32)
            row = np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1]))
            if self.own:
                placed[row, np.searchsorted(columns, dims[part])] = weights[part]
            elif len(row):
                at, sign = _places(dims[part])
                moved = sign * (weights[part] / np.sqrt(PLACES))[:, None]
                placed[:] = np.bincount((row[:, None] * BITS + at).ravel(), moved.ravel(), placed.size).reshape(placed.shape)
            self.rotated[first:last] = placed @ _rotation()
            first = last
        self.norms = np.maximum(np.linalg.norm(self.rotated, axis=1), 1e-12)
        #: Norms of the vectors themselves.
        self.true_norms = np.sqrt(np.bincount(np.repeat(np.arange(n), np.diff(offsets)), weights**2, n))
        self.packed = np.packbits(self.rotated > 0, axis=1)
        #: <code, direction>, the correction of the estimates.
        self.correction = np.maximum(np.abs(self.rotated).sum(1) / (np.sqrt(BITS) * self.norms), 1e-6)


def signs(packed: np.ndarray) -> np.ndarray:
    return np.unpackbits(packed, axis=1).astype(np.float32) * 2 - 1


def estimate_by_codes(one: np.ndarray, correction: np.ndarray, two: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of rows of two lists of packed codes (pairwise, or of all pairs where they broadcast), and their standard errors.

    Both sides are bits, so the angle's sine is overrated at large cosines, which only leaves more pairs in.
    """
    apart = np.bitwise_count(one.view(np.uint64) ^ two.view(np.uint64)).sum(-1, dtype=np.int64)
    scale = correction * other
    return (1.0 - 2.0 * apart / BITS) / scale, 1.0 / (np.sqrt(BITS) * scale)


def estimate_by_vectors(rotated: np.ndarray, packed: np.ndarray, correction: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of rotated queries (rows) with coded vectors of given norms (columns), and standard errors of the bits."""
    c2 = np.minimum(correction.astype(np.float64) ** 2, 1.0)
    estimate = (rotated @ signs(packed).T) * (norms / (np.sqrt(BITS) * correction))[None, :]
    error = np.linalg.norm(rotated, axis=1)[:, None] * (norms * np.sqrt((1 - c2) / c2 / (BITS - 1)))[None, :]
    return estimate, error


_ROTATION: list[np.ndarray] = []


def _rotation() -> np.ndarray:
    """A random orthogonal matrix, the same everywhere. Without it the bits of a vector of few dims would only show its largest one."""
    if not _ROTATION:
        q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((BITS, BITS)))
        _ROTATION.append((q * np.sign(np.diag(r))).astype(np.float32))
    return _ROTATION[0]


def _places(dims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """PLACES coordinates of each dim, one in each equal part of them, and a sign for each, the same everywhere."""
    x = dims.astype(np.uint64)[:, None] * np.uint64(PLACES) + np.arange(PLACES, dtype=np.uint64)[None, :] + np.uint64(SEED)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    width = BITS // PLACES
    at = (x >> np.uint64(1)) % np.uint64(width) + np.arange(PLACES, dtype=np.uint64) * np.uint64(width)
    return at.astype(np.int64), (x & np.uint64(1)).astype(np.float64) * 2 - 1


def _exact(dims: np.ndarray, weights: np.ndarray, offsets: np.ndarray, i: np.ndarray, j: np.ndarray, marked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of the row pairs (i, j), and whether they share a dim whose entries are ``marked``."""
    n_i, n_j = offsets[i + 1] - offsets[i], offsets[j + 1] - offsets[j]

    def gather(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair = np.repeat(np.arange(len(rows)), sizes)
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(offsets[rows], sizes)
        return pair, at

    pair_i, at_i = gather(i, n_i)
    pair_j, at_j = gather(j, n_j)
    width = np.uint64(32)
    key_i = pair_i.astype(np.uint64) << width | dims[at_i].astype(np.uint64)
    key_j = pair_j.astype(np.uint64) << width | dims[at_j].astype(np.uint64)
    _, a, b = np.intersect1d(key_i, key_j, assume_unique=True, return_indices=True)
    shared = np.zeros(len(i), bool)
    if marked is not None:
        shared[pair_i[a[marked[at_i[a]]]]] = True
    return np.bincount(pair_i[a], weights[at_i[a]] * weights[at_j[b]], len(i)), shared


# ---- cells


class Rows:
    """Some rows of ``_PLACED`` as arrays."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.key, self.side, self.cell, self.row_id = (np.asarray(table.column(c)) for c in ("key", "side", "cell", "row_id"))
        lists, ws = table.column("dims").combine_chunks(), table.column("ws").combine_chunks()
        self.dims, self.ws = np.asarray(lists.flatten()), np.asarray(ws.flatten())
        self.offsets = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
        self.row = np.repeat(np.arange(len(self.key)), np.diff(self.offsets))
        self._table = table

    @property
    def packed(self) -> np.ndarray:
        return _packed(self._table.column("code").combine_chunks())

    def column(self, name: str) -> np.ndarray:
        return np.asarray(self._table.column(name))


def in_cells(units: DataFrame, *carry: str, band: Callable[[int], tuple[int, int]] | None = None) -> DataFrame:
    """``(key, side, cell, row_id, dims, ws, carry)`` placed and sorted by key: one copy of a row for each of its cells.

    Side 0 meets all of its key. A cell above CELL_ROWS is cut into blocks; each pair of them has a key, where sides 1 and 2 meet. With
    ``band`` a cell above GIANT_ROWS is divided first: band(rows) gives the bits of a band and their number.
    """
    copies = units.select("row_id", F.explode("cells").alias("cell"), "dims", "ws", *carry)
    sizes = copies.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL_ROWS)
    cut = F.col("cell")
    if band is not None:
        giants = {r["cell"]: band(r["n"]) for r in sizes.where(F.col("n") > GIANT_ROWS).limit(LISTED_DIMS).collect()}
        if giants:
            banded = map_arrow(copies.where(F.col("cell").isin(list(giants))), _by_band(giants), f"{_schema(copies)}, cut bigint")
            copies = copies.where(~F.col("cell").isin(list(giants))).withColumn("cut", F.xxhash64("cell")).unionByName(banded)
            sizes = copies.groupBy("cut").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL_ROWS).withColumnRenamed("cut", "cell")
            cut = F.col("cut")
    half = max(CELL_ROWS // 2, 1)
    large = broadcast_if_small(sizes.select(F.col("cell").alias("_cut"), F.ceil(F.col("n") / half).cast("int").alias("blocks")))
    tagged = copies.join(large, cut == F.col("_cut"), "left")
    own = F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int")
    meet = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), F.when(own == other, 0).when(own < other, 1).otherwise(2).alias("side")),
    )
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")))
    spread = tagged.withColumn("m", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(meet)))
    keyed = spread.select(F.xxhash64(cut, "m.i", "m.j").alias("key"), F.col("m.side").alias("side"), "cell", "row_id", "dims", "ws", *carry)
    return keyed.repartition(F.col("key")).sortWithinPartitions("key", "side", "row_id")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def bands(least: float, rows: int) -> tuple[int, int]:
    """Bits of a band that leave about CELL_ROWS of the rows each, and the number of bands that bring BAND_RECALL of the pairs together."""
    bits = max(1, math.ceil(math.log2(rows / CELL_ROWS)))
    together = (1 - math.acos(min(max(least, -1.0), 1.0)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - BAND_RECALL) / math.log1p(-min(together, 1 - 1e-12))))


def _by_band(giants: dict[int, tuple[int, int]]):
    """A copy of each row for each band of its code, ``cut`` being cell, band and bits in one hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.asarray(batch.column(batch.schema.get_field_index("cell")))
            bits = np.unpackbits(_packed(batch.column(batch.schema.get_field_index("code"))), axis=1)
            for cell in np.unique(cells):
                width, count = giants[int(cell)]
                rows = np.flatnonzero(cells == cell)
                draw = np.random.default_rng(SEED)
                for b in range(count):
                    chosen = bits[rows][:, draw.choice(BITS, width, replace=False)].astype(np.uint64) @ (np.uint64(1) << np.arange(width, dtype=np.uint64))
                    mixed = (chosen * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(b)) * np.uint64(0xBF58476D1CE4E5B9) ^ np.uint64(int(cell) & (2**63 - 1))
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(mixed.view(np.int64))], names=[*batch.schema.names, "cut"])

    return run


def _by_key(compare: Callable[[Rows], pa.RecordBatch | None]):
    """Hands whole keys to ``compare``, a few thousand rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> pa.RecordBatch | None:
            table = pa.Table.from_batches(held)
            held.clear()
            key = np.asarray(table.column("key"))
            cut = len(key) if last else int(np.searchsorted(key != key[-1], False)) if key[0] == key[-1] else int(np.flatnonzero(key != key[-1])[-1]) + 1
            if cut < len(key):
                held.extend(table.slice(cut).to_batches())
            return compare(Rows(table.slice(0, cut))) if cut else None

        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(map(len, held)) >= 2 * CELL_ROWS and (out := flush(False)) is not None:
                yield out
        if held and (out := flush(True)) is not None:
            yield out

    return run


def _near_by_codes(least: float):
    """Pairs of a key's rows whose code estimate reaches ``least`` within SIGMAS errors and whose exact cosine does."""

    def compare(rows: Rows) -> pa.RecordBatch | None:
        packed, correction = rows.packed, rows.column("correction").astype(np.float64)
        starts = np.flatnonzero(np.concatenate([[True], rows.key[1:] != rows.key[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(rows.key)]]))
        left, right = [], []

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            estimate, error = estimate_by_codes(packed[i], correction[i], packed[j], correction[j])
            near = estimate + SIGMAS * error >= least - SLACK
            left.append(i[near])
            right.append(j[near])

        for size in np.unique(sizes[sizes > 1]):
            a, b = np.triu_indices(size, 1)
            step = max(1, 100_000 // len(a))
            first = starts[sizes == size]
            for s in range(0, len(first), step):
                for k in range(0, len(a), 100_000):
                    i, j = (first[s : s + step, None] + a[k : k + 100_000]).ravel(), (first[s : s + step, None] + b[k : k + 100_000]).ravel()
                    met = (rows.side[i] == 0) | (rows.side[i] != rows.side[j])
                    keep(i[met], j[met])
        if not left or not sum(map(len, left)):
            return None
        i, j = np.concatenate(left), np.concatenate(right)
        found: list[list[np.ndarray]] = [[], [], []]
        for k in range(0, len(i), 100_000):
            cosine, _ = _exact(rows.dims, rows.ws, rows.offsets, i[k : k + 100_000], j[k : k + 100_000])
            ok = cosine >= least
            a, b = rows.row_id[i[k : k + 100_000][ok]], rows.row_id[j[k : k + 100_000][ok]]
            for out, x in zip(found, (np.minimum(a, b), np.maximum(a, b), np.round(cosine[ok], 9)), strict=True):
                out.append(x)
        return _pairs(*map(np.concatenate, found))

    return compare


_PAIRS = "a bigint, b bigint, cosine double"


def _pairs(a: np.ndarray, b: np.ndarray, cosine: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(cosine + 0.0)], names=["a", "b", "cosine"])


def _best(i: np.ndarray, near: np.ndarray, cosine: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each i, equal cosines by smaller id."""
    placed = np.lexsort((near, -cosine, i))
    i = i[placed]
    return placed[np.arange(len(i)) - np.searchsorted(i, i) < k]


def similar_pairs(units: DataFrame, least: float) -> DataFrame:
    """``(a, b, cosine)``, a < b: all pairs of distinct rows with cosine >= least, the cosine in nine digits."""
    placed = in_cells(units, "code", "correction", band=lambda n: bands(least, n))
    return map_arrow(placed, _by_key(_near_by_codes(least)), _PAIRS).dropDuplicates(["a", "b"])


# ---- without a least cosine


def _split(dims: np.ndarray, ws: np.ndarray, row: np.ndarray, n: int, columns: np.ndarray) -> np.ndarray:
    """A matrix of the entries in ``columns``, by row."""
    dense = np.zeros((n, len(columns)))
    if len(columns):
        at = np.minimum(np.searchsorted(columns, dims), len(columns) - 1)
        known = columns[at] == dims
        dense[row[known], at[known]] = ws[known]
    return dense


def _near_by_dim(common: np.ndarray, k: int):
    """Of each row the k nearest in its key, both ways, counting pairs whose smallest shared dim outside ``common`` is the key's cell."""
    columns = common[:BITS]

    def compare(rows: Rows) -> pa.RecordBatch | None:
        dense = _split(rows.dims, rows.ws, rows.row, len(rows.key), columns)
        sparse = ~np.isin(rows.dims, columns)
        dims, row, ws = rows.dims[sparse], rows.row[sparse], rows.ws[sparse]
        group = np.cumsum(np.concatenate([[0], rows.key[1:] != rows.key[:-1]]))[row]
        order = np.lexsort((row, dims, group))
        dims, row, ws, group = dims[order], row[order], ws[order], group[order]
        starts = np.flatnonzero(np.concatenate([[True], (dims[1:] != dims[:-1]) | (group[1:] != group[:-1])])) if len(dims) else np.empty(0, np.int64)
        ends = np.repeat(np.append(starts[1:], len(dims)), np.diff(np.append(starts, len(dims))))
        later = ends - np.arange(len(dims)) - 1
        one = np.repeat(np.arange(len(dims)), later)
        two = np.arange(len(one)) - np.repeat(np.cumsum(later) - later, later) + one + 1
        i, j = row[one], row[two]
        met = (rows.side[i] == 0) | (rows.side[i] != rows.side[j])
        one, two, i, j = one[met], two[met], i[met], j[met]
        if not len(i):
            return None
        pair = i * len(rows.key) + j
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        cosine = np.add.reduceat(ws[one[order]] * ws[two[order]], first)
        shared = dims[one[order]]
        least = np.minimum.reduceat(np.where(np.isin(shared, common), np.iinfo(np.int64).max, shared) if len(common) > BITS else shared, first)
        i, j = i[order[first]], j[order[first]]
        here = least == rows.cell[i]
        i, j, cosine = i[here], j[here], cosine[here]
        for s in range(0, len(i), 100_000):
            part = slice(s, s + 100_000)
            cosine[part] += np.einsum("pc,pc->p", dense[i[part]], dense[j[part]])
        cosine = np.round(cosine, 9)
        a, b = np.concatenate([i, j]), np.concatenate([j, i])
        kept = _best(a, rows.row_id[b], np.tile(cosine, 2), k)
        return _pairs(rows.row_id[a[kept]], rows.row_id[b[kept]], np.tile(cosine, 2)[kept])

    return compare


def _prefixes(common: np.ndarray, bits: int, probes: int):
    """The code prefixes each row visits, most likely ones first: bits of small rotated coordinates are the ones to flip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _dense_codes(batch, common)
            lead = rows.rotated[:, :bits]
            base = (lead > 0).astype(np.int64) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
            unsure = np.argsort(np.abs(lead), axis=1)[:, : min(bits, 8)]
            subsets = np.array([[s >> b & 1 for b in range(unsure.shape[1])] for s in range(1 << unsure.shape[1])], np.float64)
            cost = np.take_along_axis(np.abs(lead), unsure, axis=1) @ subsets.T
            chosen = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            flips = (np.int64(1) << unsure.astype(np.int64)) @ subsets.T.astype(np.int64)
            prefix = base[:, None] ^ np.take_along_axis(flips, chosen, axis=1)
            offsets = (np.arange(len(batch) + 1) * prefix.shape[1]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, prefix.ravel())], names=[*batch.schema.names, "prefixes"])

    return run


def _dense_codes(batch: pa.RecordBatch, common: np.ndarray) -> Codes:
    lists = batch.column(batch.schema.get_field_index("dims"))
    dims, ws = np.asarray(lists.flatten()), np.asarray(batch.column(batch.schema.get_field_index("ws")).flatten())
    row = np.repeat(np.arange(len(batch)), np.asarray(lists.value_lengths()))
    known = np.isin(dims, common)
    return Codes(dims[known], ws[known], np.searchsorted(row[known], np.arange(len(batch) + 1)), common)


def _near_by_prefix(common: np.ndarray, k: int):
    """Queries (side 0) against the coded rows of a prefix (side 1): estimates and their bounds choose what is compared exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries = None, None
        for batch in batches:
            rows = Rows(pa.Table.from_batches([batch]))
            cuts = np.flatnonzero((rows.key[1:] != rows.key[:-1]) | (rows.side[1:] != rows.side[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows.key)], strict=True):
                if s == e:
                    continue
                part = batch.slice(s, e - s)
                if rows.key[s] != key:
                    key, queries = rows.key[s], []
                if rows.side[s] == 0:
                    queries.append((part, _dense_codes(part, common).rotated))
                    continue
                coded = pa.Table.from_batches([part])
                for asking, rotated in queries:
                    if (out := _look(asking, rotated, coded, common, k)) is not None:
                        yield out

    return run


def _look(asking: pa.RecordBatch, rotated: np.ndarray, coded: pa.Table, common: np.ndarray, k: int) -> pa.RecordBatch | None:
    both = Rows(pa.concat_tables([pa.Table.from_batches([asking]), coded]))
    n = len(asking)
    packed, correction, norms = both.packed[n:], both.column("correction")[n:], both.column("norm")[n:]
    floor = both.column("floor")[:n]
    dense, (one, two) = None, (None, None)
    if len(common) <= BITS:
        dense = _split(both.dims, both.ws, both.row, len(both.key), common)
        one, two = dense[:n], dense[n:]
    found: list[list[np.ndarray]] = [[], [], []]
    for s in range(0, n, 512):
        estimate, error = estimate_by_vectors(rotated[s : s + 512], packed, correction, norms)
        estimate[both.row_id[s : min(s + 512, n), None] == both.row_id[None, n:]] = -np.inf
        limit = floor[s : s + 512]
        if estimate.shape[1] > k:
            limit = np.maximum(limit, np.partition(estimate - LIST_SIGMAS * error, -k, axis=1)[:, -k])
        i, j = np.nonzero(estimate + LIST_SIGMAS * error >= limit[:, None] - 1e-9)
        some = np.isfinite(estimate[i, j])
        i, j = i[some] + s, j[some]
        for p in range(0, len(i), 100_000):
            part = slice(p, p + 100_000)
            near = _exact(both.dims, both.ws, both.offsets, i[part], j[part] + n)[0] if dense is None else np.einsum("pc,pc->p", one[i[part]], two[j[part]])
            ok = near >= floor[i[part]] - 1e-9
            for out, x in zip(found, (i[part][ok], j[part][ok] + n, near[ok]), strict=True):
                out.append(x)
    if not found[0]:
        return None
    i, j, near = map(np.concatenate, found)
    # Pairs that share a rarer dim have met by that, and may crowd out a few others here.
    kept = _best(i, both.row_id[j], near, 4 * k)
    i, j = i[kept], j[kept]
    cosine, met = _exact(both.dims, both.ws, both.offsets, i, j, ~np.isin(both.dims, common))
    cosine = np.round(cosine, 9)
    ok = ~met & (cosine >= floor[i])
    i, j, cosine = i[ok], j[ok], cosine[ok]
    kept = _best(i, both.row_id[j], cosine, k)
    return _pairs(both.row_id[i[kept]], both.row_id[j[kept]], cosine[kept]) if len(kept) else None


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """Of each ``a`` the k best; the rank filter is a group limit below the shuffle."""
    w = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return pairs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def nearest_pairs(units: DataFrame, order: tuple[np.ndarray, np.ndarray], k: int, probes: int | None = None) -> DataFrame:
    """``(a, b, cosine)``, each pair once: of every row its k nearest others whatever the cosine (nine digits), equal ones by smaller row_id,
    among at most 2 k + FILL_ROWS.

    Exact for neighbours that share a dim which at most CELL_ROWS vectors hold; others are found as far as their code prefix is among the
    ``probes`` (PROBES) that a row visits.
    """
    listed, counts = order
    common = listed[counts > CELL_ROWS]
    by_dim = checkpoint(_top(map_arrow(in_cells(units), _by_key(_near_by_dim(common, k)), _PAIRS), k))
    lists = by_dim.groupBy(F.col("a").alias("_a")).agg(F.when(F.count(F.lit(1)) >= k, F.min("cosine")).alias("floor"))
    rows = units.select("row_id", "dims", "ws", "code", "correction", "norm").join(lists, F.col("row_id") == F.col("_a"), "left").drop("_a")
    rows = checkpoint(rows.withColumn("floor", F.coalesce("floor", F.lit(-1.0))))
    lists = by_dim
    if len(common) and (by_code := _by_code(rows, common, k, probes or PROBES)) is not None:
        lists = lists.unionByName(checkpoint(_top(by_code, k)))
    return lists.unionByName(_fill(rows, lists, k))


def _by_code(rows: DataFrame, common: np.ndarray, k: int, probes: int) -> DataFrame | None:
    """Step (2): rows in question against the rows that may still enter a list."""
    largest = rows.agg(F.max("norm").alias("m")).first()["m"] or 0.0
    asking = rows.where((F.col("norm") > 0) & (F.col("norm") * largest >= F.col("floor") - SLACK))
    least = asking.agg(F.min(F.greatest("floor", F.lit(0.0)) / F.col("norm")).alias("m")).first()["m"]
    if least is None:
        return None
    admitted = rows.where((F.col("norm") > 0) & (F.col("norm") >= least - SLACK))
    bits = min(62, max(0, math.ceil(math.log2(max(admitted.count(), 1) / CELL_ROWS))))
    known = f"{_schema(rows)}, prefixes array<bigint>"
    visits = map_arrow(asking, _prefixes(common, bits, probes), known).withColumn("cell", F.explode("prefixes"))
    homes = map_arrow(admitted, _prefixes(common, bits, 1), known).withColumn("cell", F.explode("prefixes"))
    # A prefix's queries are cut into blocks, each of which meets its rows in a task of its own.
    blocks = visits.groupBy(F.col("cell").alias("_cell")).agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("blocks"))
    blocks = broadcast_if_small(blocks)
    tail = ["cell", "row_id", "dims", "ws", "code", "correction", "norm", "floor"]
    left = visits.join(blocks, F.col("cell") == F.col("_cell")).select(F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"), *tail)
    right = homes.join(blocks, F.col("cell") == F.col("_cell")).select(F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), *tail)
    keyed = left.unionByName(right).select(F.xxhash64("cell", "block").alias("key"), "side", *tail)
    placed = keyed.repartition(F.col("key")).sortWithinPartitions("key", "side", "row_id")
    return map_arrow(placed, _near_by_prefix(common, k), _PAIRS)


def _fill(rows: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """Pairs for rows with less than k neighbours above 0: they meet the FILL_ROWS rows with the smallest ids, with which they may share nothing."""
    full = lists.where(F.col("cosine") > 0).groupBy(F.col("a").alias("_a")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k)
    short = rows.select("row_id", "dims", "ws").join(full, F.col("row_id") == F.col("_a"), "left_anti")
    first = rows.orderBy("row_id").limit(FILL_ROWS).select(F.col("row_id").alias("b"), F.map_from_arrays("dims", "ws").alias("_b"))
    both = short.join(F.broadcast(first), F.col("row_id") != F.col("b"))
    terms = F.zip_with("dims", "ws", lambda d, w: F.coalesce(F.try_element_at("_b", d), F.lit(0.0)) * w)
    cosine = F.round(F.aggregate(terms, F.lit(0.0), lambda x, y: x + y), 9)
    fresh = both.select(F.col("row_id").alias("a"), "b", cosine.alias("cosine")).join(lists.select("a", "b"), ["a", "b"], "left_anti")
    return fresh.select("a", "b", "cosine")


def similar_vectors(live: DataFrame, k: int = 10, least: float | None = 0.8, log: DataFrame | None = None) -> DataFrame:
    """``(row_id, neighbour, cosine, rank)``: of every live vector the k most similar others with cosine >= least, equal ones by smaller row_id.

    If ``least`` is None the k most similar others come out whatever their cosine, also 0 or below, for every vector with a value.
    ``live(row_id, indices, vals)`` has one row per row_id; ``log`` may be any table of such vectors to count dims in, by default the
    live ones. Null rows and vectors without values have no neighbours. Cosines are rounded to nine digits before ranking, so that copies tie.
    """
    order = common_dims(explode_vectors(live if log is None else log, "row_id"))
    units = with_classes(checkpoint(with_content(unit_vectors(live, order, least))))
    first = units.where(F.col("class_id") == F.col("row_id"))
    if least is None:
        directed = nearest_pairs(first, order, k + 1)
    else:
        # Kept, as they are read in both directions.
        pairs = checkpoint(similar_pairs(first, least))
        directed = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    copied = units.where("copies").select("row_id", "class_id")
    own = first.where("copies").select(F.col("row_id").alias("a"), F.col("row_id").alias("b"), F.lit(1.0).alias("cosine"))
    both = directed.unionByName(own)
    # Of a class k + 1 members are enough to fill any list of k.
    shown = copied.withColumn("_n", F.row_number().over(Window.partitionBy("class_id").orderBy("row_id"))).where(F.col("_n") <= k + 1)
    members = shown.groupBy(F.col("class_id").alias("b")).agg(F.collect_list("row_id").alias("_members"))
    near = both.join(members, "b", "left").select("a", "cosine", F.explode(F.coalesce("_members", F.array("b"))).alias("neighbour"))
    # A class's list of k + 1 rows serves each of its members, which leaves itself out.
    if least is not None:
        top = Window.partitionBy("a").orderBy(F.desc("cosine"), F.col("neighbour"))
        near = near.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= k + 1)
    entry = F.struct((-F.col("cosine")).alias("c"), F.col("neighbour").alias("neighbour"))
    lists = checkpoint(near.groupBy("a").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k + 1).alias("_list")))
    rest = copied.where(F.col("class_id") != F.col("row_id"))
    every = lists.select(F.col("a").alias("row_id"), "_list").unionByName(rest.join(lists, F.col("class_id") == F.col("a")).select("row_id", "_list"))
    others = F.slice(F.filter("_list", lambda e: e["neighbour"] != F.col("row_id")), 1, max(k, 1))
    out = every.select("row_id", F.posexplode(others).alias("p", "e")).where(F.col("p") < k)
    return out.select("row_id", F.col("e.neighbour").alias("neighbour"), (-F.col("e.c")).alias("cosine"), (F.col("p") + 1).alias("rank"))
