"""Best matches of many query vectors against brute force, and the pairs that are looked at."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from sparsemill.operators import postings as P
from sparsemill.operators.best_match import best_matches
from sparsemill.plans.queries import all_queries
from tests.test_queries import connect, same

VECTORS = "row_id bigint, indices array<bigint>, vals array<float>"
LOG = VECTORS + ", segment_id string, opstamp bigint"
QUERY = "search_live_vectors"


def log_of(spark, tmp_path, rows):
    spark.createDataFrame([(i, d, w, "s", i) for i, d, w in rows], LOG).coalesce(1).write.parquet(str(tmp_path / "vectors.parquet"))
    c = connect()
    c.execute(f"CREATE OR REPLACE VIEW vectors AS SELECT * FROM '{tmp_path}/vectors.parquet/*.parquet'")
    return c


def as_float(w):
    return struct.unpack("f", struct.pack("f", w))[0]


def brute(rows):
    has = [(i, {d: w for d, w in zip(ds, ws) if w is not None and not math.isnan(w)}) for i, ds, ws in rows]
    best = {}
    for q, a in has:
        for r, b in has:
            if q % 5 == 0 and q != r and a.keys() & b.keys():
                score = sum(a[d] * b[d] for d in a.keys() & b.keys())
                if score > 0 or math.isnan(score):
                    old = best.get(q, score)
                    best[q] = score if math.isnan(score) else old if math.isnan(old) else max(old, score)
    return best


def drawn(kind, seed):
    pick = random.Random(seed)
    rows = []
    for i in range(150):
        dims = sorted({pick.choice([1, 2, 3, 4, pick.randrange(10, 90)]) for _ in range(5)}, key=lambda d: (d * 7) % 11)
        weight = lambda: round(pick.lognormvariate(-1, 1.5), 3) if kind == "positive" else round(pick.gauss(0, 1), 2)
        vals = [pick.choice([weight(), weight(), weight(), 0.0 if kind != "positive" else weight(), weight()]) for _ in dims]
        if kind == "gaps":
            vals = [pick.choice([w, w, w, None, math.nan]) for w in vals]
        if kind == "infinite" and i % 11 == 0 and vals:
            vals[0] = pick.choice([math.inf, -math.inf])
        if kind == "below":
            vals = [-abs(w) if i % 5 else abs(w) for w in vals]
        rows.append((i, dims, [None if w is None else float(w) for w in vals]))
    return [(i, d, [None if w is None else as_float(w) for w in ws]) for i, d, ws in rows]


@pytest.mark.parametrize("kind,list_rows,seed_rows", [("positive", 0, 1), ("gaps", 3, 1), ("infinite", 0, 2), ("below", 20, 4)])
def test_every_best_score_is_found(spark, kind, list_rows, seed_rows):
    rows = drawn(kind, list_rows + seed_rows)
    v = spark.createDataFrame(rows, VECTORS)
    p = P.build_postings(v, check=False)
    q = p.where(F.col("row_id") % 5 == 0).select(F.col("row_id").alias("query_id"), "dim_id", F.col("weight").alias("qw"))
    stale = spark.createDataFrame([(1, 900 + i, 50.0) for i in range(3)] + [(10, 901, -4.0)], "dim_id bigint, row_id bigint, weight float")
    found = best_matches(v, p, q, p.unionByName(stale), list_rows, seed_rows).collect()
    got, want = {r["query_id"]: r["best"] for r in found}, brute(rows)
    assert len(found) == len(got) and got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], rel=1e-9, nan_ok=True) for i in want)


def most_rows(spark, after):
    """Greatest number of rows that any operator gave out in the SQL executions from id ``after`` on; and the next id."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    runs, most, last = store.executionsList(), 0, after
    for n in range(runs.size()):
        run = runs.apply(n)
        if run.executionId() < after:
            continue
        last = max(last, run.executionId() + 1)
        values, metrics = store.executionMetrics(run.executionId()), run.metrics()
        for m in range(metrics.size()):
            value = values.get(metrics.apply(m).accumulatorId())
            if metrics.apply(m).name() == "number of output rows" and value.isDefined():
                most = max(most, int(value.get().replace(",", "")))
    return most, last


def test_a_list_that_all_rows_share_does_not_pair_them_all(spark, tmp_path):
    rows = [(i, [5, 7, 100 + i // 150], [0.01 + i % 90 / 1000, 0.5 if i % 97 == 0 else 0.02, 1.0 + i % 7]) for i in range(6000)]
    c = log_of(spark, tmp_path, rows)
    _, start = most_rows(spark, 0)
    df = all_queries().queries[QUERY](spark, str(tmp_path))
    assert df.count() == 60
    most, end = most_rows(spark, start)
    # 60 queries and 6000 rows share two lists, 360 000 pairs; the table has 18 000 postings.
    assert end > start and 6000 <= most <= 40_000
    same(df, all_queries().sql[QUERY], c)


def test_scores_are_rounded_once(spark, tmp_path):
    rows = [(0, [1], [0.01]), (100, [2], [1.0]), (200, [3], [1.0]), (300, [4], [1.0]), (1, [1], [0.03]), (2, [2], [0.0004999]), (3, [3], [0.0014999]), (4, [4], [-1.0])]
    rows = [(i, d, [as_float(w) for w in ws]) for i, d, ws in rows]
    c = log_of(spark, tmp_path, rows)
    df = all_queries().queries[QUERY](spark, str(tmp_path))
    same(df, all_queries().sql[QUERY], c)
    assert {r["query_id"]: r["best"] for r in df.collect()} == {200: 0.001}
