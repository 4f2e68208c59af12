import math
import random

from sparsemill.llm import log_percentiles as Q

QS = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}


def test_error_bound_against_exact(spark):
    rnd = random.Random(1)
    groups = {
        "wide": [rnd.choice([-1, 1]) * 10 ** rnd.uniform(-12, 12) for _ in range(501)], "same": [2.5] * 77, "zeros": [0.0, -0.0, 0.0, 1.0],
        "tiny": [5e-324, 1e-310, -1e-310], None: [1.0, None, float("nan"), 3.0],
    }
    df = spark.createDataFrame([(g, v, 1) for g, vs in groups.items() for v in vs], "g string, v double, n int")
    out = {r["g"]: r for r in Q.percentiles(Q.sketch(df, ["g"], "v"), ["g"], QS).collect()}
    for g, vs in groups.items():
        clean = sorted(v for v in vs if v is not None and not math.isnan(v))
        assert out[g]["n"] == len(clean)
        for name, q in QS.items():
            exact = clean[max(1, math.ceil(q * len(clean))) - 1]
            if abs(exact) < Q.SMALLEST:
                assert abs(out[g][name]) <= 2 * Q.SMALLEST
            else:
                assert abs(out[g][name] - exact) <= Q.RELATIVE_ERROR * abs(exact) * 1.000001


def test_merged_sketches_equal_the_whole(spark):
    rnd = random.Random(2)
    df = spark.createDataFrame([("a", rnd.gauss(0, 5), i % 3) for i in range(900)], "g string, v double, day int")
    parts = [Q.sketch(df.where(df.day == i), ["g"], "v") for i in range(3)]
    whole = Q.sketch(df, ["g"], "v")
    assert sorted(Q.merge_sketches(parts, ["g"]).collect()) == sorted(whole.collect())


def test_infinite_values_and_empty_table(spark):
    df = spark.createDataFrame([("a", float("inf")), ("a", float("-inf")), ("a", 1.0)], "g string, v double")
    r = Q.percentiles(Q.sketch(df, ["g"], "v"), ["g"], QS).first()
    assert r["p100"] > 1e299 and r["p0"] < -1e299
    assert Q.percentiles(Q.sketch(df.limit(0), ["g"], "v"), ["g"], QS).collect() == []
