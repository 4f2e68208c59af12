import math
import random

import numpy as np
import pytest

import sparsemill.llm.similar_vectors as N
from sparsemill.llm.queries import R
from sparsemill.operators.ingest_log import live_vectors
from sparsemill.session import table

SCHEMA = "row_id bigint, indices array<bigint>, vals array<float>, segment_id string, cells int"


def cosines(vectors):
    units = {}
    for r, (dims, vals) in vectors.items():
        v = {d: float(np.float32(x)) for d, x in zip(dims, vals) if x is not None and not math.isnan(x) and x != 0}
        norm = math.sqrt(sum(x * x for x in v.values()))
        if norm:
            units[r] = {d: x / norm for d, x in v.items()}
    return {(a, b): sum(x * units[b].get(d, 0) for d, x in units[a].items()) for a in units for b in units if a != b}


def brute(vectors, k, least):
    out = set()
    near = {}
    for (a, b), c in cosines(vectors).items():
        if c >= least:
            near.setdefault(a, []).append((-round(c, 9), b))
    for a, found in near.items():
        out |= {(a, b, i + 1) for i, (_, b) in enumerate(sorted(found)[:k])}
    return out


def make(rnd, n):
    vectors = {}
    for i in range(n):
        if i and rnd.random() < 0.5:
            dims, vals = vectors[rnd.choice(list(vectors))]
            vals = [None if v is None else v + rnd.choice([0, 0, rnd.gauss(0, 0.05)]) for v in vals]
        else:
            dims = rnd.sample(range(40), 3) + rnd.sample(range(10**6), rnd.randrange(6))
            vals = [rnd.choice([rnd.uniform(-2, 2), None, float("nan"), 0.0, 1.0]) for _ in dims]
        vectors[i] = (dims, vals)
    vectors[n] = ([], [])
    return vectors


@pytest.mark.parametrize("least,cell_rows", [(0.8, 2048), (0.5, 2048), (0.8, 16)])
def test_against_brute_force(spark, monkeypatch, least, cell_rows):
    monkeypatch.setattr(N, "CELL_ROWS", cell_rows)
    vectors = make(random.Random(5), 250)
    df = spark.createDataFrame([(r, d, v, "s", 1) for r, (d, v) in vectors.items()], SCHEMA)
    got = {(r["row_id"], r["neighbour"], r["rank"]) for r in N.similar_vectors(df, 10, least).collect()}
    want = brute(vectors, 10, least)
    assert {x[:2] for x in got} == {x[:2] for x in want}


def nearest(spark, vectors):
    df = spark.createDataFrame([(r, d, v, "s", 1) for r, (d, v) in vectors.items()], SCHEMA)
    return {(r["row_id"], r["neighbour"], r["rank"]) for r in N.similar_vectors(df, 10, None).collect()}


@pytest.mark.parametrize("cell_rows", [1024, 16])
def test_nearest_without_a_least_cosine(spark, monkeypatch, cell_rows):
    # With 16 rows a cell most of the 40 frequent dims are common; so many probes visit every prefix, so that nothing is lost.
    monkeypatch.setattr(N, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(N, "PROBES", 32)
    vectors = make(random.Random(5), 250)
    got, want = nearest(spark, vectors), brute(vectors, 10, -2)
    assert len({x[0] for x in want}) > 200 and len(want) == 10 * len({x[0] for x in want}) == len(got)
    assert got == want


def test_recall_with_few_probes(spark, monkeypatch):
    # Every dim is common and every cosine counts: the codes' prefixes decide alone what meets.
    monkeypatch.setattr(N, "CELL_ROWS", 64)
    monkeypatch.setattr(N, "PROBES", 12)
    rnd = np.random.default_rng(3)
    centres = rnd.standard_normal((40, 48))
    vectors = {i: (list(range(48)), (centres[i % 40] + 0.6 * rnd.standard_normal(48)).tolist()) for i in range(2000)}
    got = {x[:2] for x in nearest(spark, vectors)}
    matrix = np.array([v for _, v in vectors.values()], np.float32).astype(float)
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    cosine = matrix @ matrix.T
    np.fill_diagonal(cosine, -2)
    want = {(i, int(j)) for i in range(2000) for j in np.argsort(-cosine[i])[:10]}
    assert len(got) == 20_000 and len(got & want) >= 0.9 * len(want)


def test_giant_cells_are_divided_by_bands(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", 16)
    monkeypatch.setattr(N, "GIANT_ROWS", 64)
    rnd = np.random.default_rng(4)
    centres = rnd.standard_normal((60, 24))
    vectors = {i: (list(range(24)), (centres[i % 60] + 0.3 * rnd.standard_normal(24)).tolist()) for i in range(600)}
    df = spark.createDataFrame([(r, d, v, "s", 1) for r, (d, v) in vectors.items()], SCHEMA)
    got = {(r["row_id"], r["neighbour"]) for r in N.similar_vectors(df, 20, 0.8).collect()}
    want = {x[:2] for x in brute(vectors, 20, 0.8)}
    assert len(want) > 4000 and got <= want and len(got) >= 0.99 * len(want)
    bits, n = N.bands(0.8, 10**9)
    assert 2**bits >= 10**9 / 16 / 2 and n < 5000


def test_lists_are_filled_with_zeros_and_below(spark):
    rows = [(i, [1], [1.0 + i], "s", 1) for i in range(2)] + [(5, [2], [1.0], "s", 1), (6, [1], [-1.0], "s", 1), (7, [], [], "s", 1)]
    got = {}
    for r in N.similar_vectors(spark.createDataFrame(rows, SCHEMA), 3, None).collect():
        got.setdefault(r["row_id"], {})[r["rank"]] = (r["neighbour"], r["cosine"])
    assert got[0] == {1: (1, 1.0), 2: (5, 0.0), 3: (6, -1.0)}
    assert got[5] == {1: (0, 0.0), 2: (1, 0.0), 3: (6, 0.0)}
    assert set(got) == {0, 1, 5, 6}


def test_neighbours_query_has_ten_for_every_vector(spark):
    found = {}
    for r in R.queries["p4_neighbours"](spark, "/root/testdata/sf0.001").collect():
        found.setdefault(r["row_id"], []).append((-r["cosine"], r["neighbour"]))
    live = live_vectors(table(spark, "/root/testdata/sf0.001", "vectors")).collect()
    cosine = cosines({r["row_id"]: (r["indices"], r["vals"]) for r in live})
    want = {}
    for (a, b), c in cosine.items():
        want.setdefault(a, []).append((-round(c, 9), b))
    assert set(found) == set(want)
    for a, near in found.items():
        best = sorted(want[a])[:10]
        assert len(near) == 10 and np.allclose([c for c, _ in sorted(near)], [c for c, _ in best], atol=1e-6)


def test_copies_are_each_others_neighbours(spark):
    rows = [(i, [1, 2], [1.0, 2.0], "s", 1) for i in range(30)] + [(99, [1, 2], [2.0, 4.0], "s", 1), (100, [5], [1.0], "s", 1)]
    got = {}
    for r in N.similar_vectors(spark.createDataFrame(rows, SCHEMA), 3).collect():
        got.setdefault(r["row_id"], {})[r["rank"]] = r["neighbour"]
    assert got[0] == {1: 1, 2: 2, 3: 3} and got[2] == {1: 0, 2: 1, 3: 3} and got[99] == {1: 0, 2: 1, 3: 2}
    assert 100 not in got


def test_empty_table(spark):
    assert N.similar_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("columns", [None, np.arange(12)])
def test_estimates_keep_their_bounds(columns):
    rnd = np.random.default_rng(6)
    dims = np.concatenate([np.arange(12) if columns is not None or i % 2 else rnd.choice(10**6, 12, replace=False) for i in range(400)])
    weights = rnd.standard_normal((400, 12))
    weights[200:] = weights[:200] + 0.7 * rnd.standard_normal((200, 12))
    weights /= np.linalg.norm(weights, axis=1)[:, None]
    codes = N.Codes(dims, weights.ravel(), np.arange(0, 4801, 12), columns)
    i = np.arange(1, 400, 2)
    exact = weights[i] @ weights[i].T
    off = ~np.eye(len(i), dtype=bool)
    estimate, error = N.estimate_by_codes(codes.packed[i][:, None], codes.correction[i][:, None], codes.packed[i][None], codes.correction[i][None])
    # Large cosines are overrated, so only what falls short counts.
    assert np.mean(((exact - estimate) / error)[off] > N.SIGMAS) < 1e-3
    if columns is not None:
        estimate, error = N.estimate_by_vectors(codes.rotated[i], codes.packed[i], codes.correction[i], codes.true_norms[i])
        apart = (np.abs(estimate - exact) / error)[off]
        assert np.mean(apart > N.SIGMAS) < 1e-3 and np.median(apart) < 1.5
