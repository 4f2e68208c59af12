"""Literal fixtures of the blueprint."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsemill.config import IndexSettings, SettingsError
from sparsemill.functions import bitmap as B
from sparsemill.functions import utility as U
from sparsemill.functions import vectors as V
from sparsemill.functions import weights as W
from sparsemill.operators import heavy_keys as H
from sparsemill.operators import merge as M
from sparsemill.operators import postings as P
from sparsemill.operators import search as S
from sparsemill.operators.ingest_log import latest_value, live_vectors

VEC = "indices array<bigint>, vals array<float>"
POST = "dim_id bigint, row_id bigint, weight float"
FIXTURE = [(7, 6, 70.0), (7, 18, 30.0), (7, 21, 20.0), (7, 17, 10.0), (7, 14, 45.0)]


def one(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_validation(spark):
    rows = [([], []), ([1, 2, 3], [1.0, 2.0]), ([1, 3, 2], [1.0, 2.0, 3.0]), ([1, 2, 3, 2], [1.0, 2.0, 3.0, 4.0]), (None, [1.0]), ([1], None), ([None], [1.0]), ([-1], [1.0]), ([2**32], [1.0]), ([2**32 - 1], [None])]
    assert one(spark, V.is_valid(F.col("indices"), F.col("vals")), rows, VEC) == [True, False, True, False, False, False, False, False, False, True]
    with pytest.raises(Exception, match="invalid sparse vector"):
        spark.createDataFrame(rows[1:2], VEC).select(V.require_valid(F.col("indices"), F.col("vals"))).collect()


def test_sorting(spark):
    rows = [([1, 3, 2], [1.0, 2.0, 3.0]), ([], []), ([4], [1.0]), ([1, 2], [1.0, 2.0])]
    assert one(spark, V.is_sorted(F.col("indices")), rows, VEC) == [False, True, True, True]
    entries = one(spark, V.sort_entries(F.col("indices"), F.col("vals")), rows[:1], VEC)[0]
    assert [(e["dim_id"], e["weight"]) for e in entries] == [(1, 1.0), (2, 3.0), (3, 2.0)]


@pytest.mark.parametrize("ib,vb", [([2, 3, 4], [2.0, 3.0, 4.0]), ([4, 2, 3], [4.0, 2.0, 3.0])])
def test_combine(spark, ib, vb):
    schema = "ia array<bigint>, va array<float>, ib array<bigint>, vb array<float>"
    rows = [([1, 2, 3], [0.1, 0.2, 0.3], ib, vb)]
    op = lambda x, y: x + F.lit(2.0) * y
    ab = one(spark, V.combine(F.col("ia"), F.col("va"), F.col("ib"), F.col("vb"), op), rows, schema)[0]
    ba = one(spark, V.combine(F.col("ib"), F.col("vb"), F.col("ia"), F.col("va"), op), rows, schema)[0]
    assert [round(e["weight"], 5) for e in ab] == [0.1, 4.2, 6.3, 8.0]
    assert [round(e["weight"], 5) for e in ba] == [0.2, 2.4, 3.6, 4.0]


def test_dot_has_no_value_without_overlap(spark):
    schema = "ia array<bigint>, va array<float>, ib array<bigint>, vb array<float>"
    rows = [([1, 2], [1.0, 2.0], [2, 3], [3.0, 1.0]), ([1], [1.0], [2], [1.0]), ([], [], [], [])]
    assert one(spark, V.dot(F.col("ia"), F.col("va"), F.col("ib"), F.col("vb")), rows, schema) == [6.0, None, None]


def test_suffix_max(spark):
    for chunk in (4, 65_536):
        rows = P.with_suffix_max(spark.createDataFrame(FIXTURE, POST), chunk=chunk).orderBy("row_id").collect()
        assert [r["row_id"] for r in rows] == [6, 14, 17, 18, 21]
        assert [r["max_next_weight"] for r in rows] == [45.0, 30.0, 30.0, 20.0, float("-inf")]


def test_quantized_fixture(spark):
    df = spark.createDataFrame(FIXTURE, POST)
    back = P.dequantize_postings(P.quantize_postings(df, P.quant_params(df))).orderBy("row_id").collect()
    assert back[0]["weight"] == 70.0
    same = spark.createDataFrame([(1, 1, 3.5), (1, 2, 3.5)], POST)
    assert [r["weight"] for r in P.dequantize_postings(P.quantize_postings(same, P.quant_params(same))).collect()] == [3.5, 3.5]


def test_seek_and_remains(spark):
    df = spark.createDataFrame(FIXTURE, POST)
    hits = {r: (x[0]["hit"] if (x := P.seek(df, r).collect()) else False) for r in (6, 18, 21, 24, 14)}
    assert hits == {6: True, 18: True, 21: True, 24: False, 14: True}
    assert P.seek(df, 0).first()["remains"] == 5 and P.seek(df, 17).first()["remains"] == 3
    assert [r["weight"] for r in P.up_to_row(df, 18).orderBy("row_id").collect()] == [70.0, 45.0, 10.0, 30.0]


@pytest.mark.parametrize("n,want", [(0, []), (1, [1]), (300, [128, 128, 44])])
def test_blocks(spark, n, want):
    df = spark.createDataFrame([(1, 3 * i, 1.0) for i in range(n)], POST)
    assert [r["n"] for r in P.block_stats(df, chunk=100).orderBy("block_no").collect()] == want


@pytest.mark.parametrize("scores,want", [([1, 4, 2, 5, 3, 6], [6, 5, 4]), ([1, 3, 2, 4], [4, 3, 2]), ([1, 2], [2, 1])])
def test_top_k(spark, scores, want):
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "row_id bigint, score double")
    assert [r["score"] for r in S.top_k(df, 3).collect()] == want


def test_ties_by_smallest_row(spark):
    df = spark.createDataFrame([(i, 2.0 if i == 5 else 1.0) for i in range(9)], "row_id bigint, score double")
    assert [r["row_id"] for r in S.top_k(df, 3).collect()] == [5, 0, 1]


def test_f16_like_numpy(spark):
    rnd = random.Random(1)
    values = [0.0, -0.0, 65504.0, 65519.0, 65520.0, -1e9, 6e-8, 3e-8, 5.96e-8, 1.0009765625, float("inf")] + [rnd.gauss(0, 10 ** rnd.randrange(-9, 6)) for _ in range(2000)]
    values = [struct.unpack("f", struct.pack("f", v))[0] for v in values]
    with np.errstate(over="ignore"):
        want = [float(np.float16(np.float32(v))) for v in values]
    assert one(spark, W.to_f16(F.col("w")), [(v,) for v in values], "w float") == want


def test_u8(spark):
    rows = [(-3.0,), (0.9,), (255.9,), (1e9,), (float("nan"),), (None,)]
    assert one(spark, W.to_u8(F.col("w")), rows, "w float") == [0, 0, 255, 255, 0, None]


def test_tagged(spark):
    rows = [(0, 1.5, 7, 9), (1, 1.5, 7, 9), (2, 1.5, 7, 9), (3, 1.5, 7, 9), (None, 1.5, 7, 9)]
    assert one(spark, V.decode_tagged(F.col("t"), F.col("f"), F.col("b"), F.col("u")), rows, "t int, f float, b int, u bigint") == [1.5, 7.0, 9.0, 0.0, 0.0]


def test_bitmaps(spark):
    ids = [0, 3, 8, 17, 4000]
    bitmap = B.bitmap_from_rows(ids)
    assert [r["row_id"] for r in B.rows_from_bitmap(B.bitmap_frame(spark, bitmap)).orderBy("row_id").collect()] == ids
    assert B.rows_from_bitmap(B.bitmap_frame(spark, b"")).collect() == []
    probe = spark.createDataFrame([(i,) for i in [0, 1, 3, 17, 4000, 4001, 99_999, None]], "row_id bigint")
    assert [r[0] for r in probe.select(B.is_alive(F.lit(bitmap), F.col("row_id"))).collect()] == [True, False, True, True, True, False, False, False]
    words = B.packed_words(spark.createDataFrame([(i,) for i in ids + [40_000, None]], "row_id bigint")).collect()
    assert {r["word_no"]: r["n_alive"] for r in words} == {0: 5, 1: 1}


def test_settings():
    assert IndexSettings() == IndexSettings.from_json("{}") == IndexSettings.from_json(IndexSettings().to_json())
    for bad in ({"quantized": True, "element": "extended"}, {"quantized": True, "weight": "u8"}, {"storage": "ram"}, {"weight": "f64"}, {"element": "x"}):
        with pytest.raises(SettingsError):
            IndexSettings(**bad)
    with pytest.raises(SettingsError):
        IndexSettings.from_json('{"wieght": "f32"}')
    assert IndexSettings(element="extended").supports_pruning and not IndexSettings().supports_pruning


def test_merge_policies():
    sizes = [M.SegmentSize(f"s{i}", n) for i, n in enumerate([100] * 8 + [50_000] * 7 + [20_000_000])]
    assert [len(g) for g in M.LevelMerge().candidates(sizes)] == [8]
    assert M.NoMerge().candidates(sizes) == [] and len(M.MergeAll().candidates(sizes)[0]) == 16
    assert M.MergeAll().candidates(sizes[:1]) == [] and M.LevelMerge().candidates([]) == []
    with pytest.raises(SettingsError):
        M.check_mergeable([IndexSettings()])
    with pytest.raises(SettingsError):
        M.check_mergeable([IndexSettings(), IndexSettings(weight="f16")])


def test_utilities(spark):
    rows = [("2001-02-03 04:05:06.789123",)]
    assert str(one(spark, U.truncate_time(F.col("t").cast("timestamp"), "ms").cast("string"), rows, "t string")[0]) == "2001-02-03 04:05:06.789"
    assert U.json_path("a", "b.c") == "$['a']['b.c']" and U.json_path("a", "b.c", expand_dots=True) == "$['a']['b']['c']"
    assert U.human_bytes(5) == "5 B" and U.human_bytes(1_234_567) == "1.23 MB"


SEARCH = [(1, 1, 1.0), (2, 1, 2.0), (1, 2, 3.0), (3, 3, -1.0), (2, 4, 0.5)]


def test_search_semantics(spark):
    df = spark.createDataFrame(SEARCH, POST)
    rows = lambda q, k=10, **a: [(r["row_id"], r["score"]) for r in S.search(df, q, k, **a).collect()]
    assert rows({1: 1.0, 2: 1.0}) == [(1, 3.0), (2, 3.0), (4, 0.5)]
    assert rows({3: 1.0}) == [] and rows({3: -2.0}) == [(3, 2.0)]
    assert rows({}) == [] and rows({1: 1.0}, 0) == [] and rows({9: 1.0}) == []
    assert rows({1: 1.0}, alive=B.bitmap_from_rows([2])) == [(2, 3.0)]
    assert rows({1: 1.0}, alive=spark.createDataFrame([(1,)], "row_id bigint")) == [(1, 1.0)]
    assert [(r["row_id"], r["score"]) for r in S.brute_force(df, {3: 1.0}, 9).collect()] == [(3, -1.0)]
    assert len(S.brute_force(df, {3: 1.0}, 9, all_rows=df).collect()) == 4


def test_pruning_changes_nothing(spark):
    rnd = random.Random(2)
    df = spark.createDataFrame([(d, r, float(rnd.randrange(1, 50))) for d in range(6) for r in rnd.sample(range(300), 20 * (d + 1))], POST)
    for _ in range(4):
        q = {d: float(rnd.randrange(0, 9)) for d in rnd.sample(range(6), 4)}
        for stats in (None, P.dim_stats(df)):
            assert S.search_pruned(df, q, 7, stats=stats, least_saved=0).collect() == S.search(df, q, 7).collect()


def test_latest_value_and_live_vectors(spark):
    rows = [("a", 1.0, 1), ("a", 2.0, None), ("a", 3.0, 1), ("b", None, 5), (None, 4.0, 1)]
    got = {r["k"]: r["v"] for r in latest_value(spark.createDataFrame(rows, "k string, v double, s bigint"), ["k"], "v", "s").collect()}
    assert got == {"a": 3.0, "b": None, None: 4.0}
    log = [(1, [1], [1.0], "s", 1, 0), (1, [2], [1.0], "s", 2, 0), (1, [3, 3], [1.0, 2.0], "s", 3, 0), (2, None, None, "s", 1, 0), (3, [], [], "b", 1, 0), (3, [], [], "a", 1, 0), (None, [1], [1.0], "s", 9, 0)]
    live = live_vectors(spark.createDataFrame(log, "row_id bigint, indices array<bigint>, vals array<float>, segment_id string, opstamp bigint, _rn int"))
    assert sorted((r["row_id"], r["indices"], r["segment_id"]) for r in live.collect()) == [(1, [2], "s"), (3, [], "a")]
    assert live_vectors(spark.createDataFrame([], "row_id bigint, indices array<bigint>, vals array<float>, segment_id string, opstamp bigint")).collect() == []


LISTS = "segment_id string, dim_id bigint, row_id bigint, weight float, opstamp bigint, _heavy string"


@pytest.mark.parametrize("share", [0.001, 0.2, 2.0])
def test_best_of_lists(spark, share):
    rnd = random.Random(3)
    values = [1.0, 2.0, 2.0, -1.0, None, float("nan"), float("inf")]
    rows = [(rnd.choice(["a", None]), rnd.choice([7, 7, 7, 7, *range(30), None]), rnd.choice([None, *range(50)]), rnd.choice(values), rnd.choice([None, 1, 2, 3]), "x") for _ in range(4000)]
    newest, best = {}, {}
    for s, d, r, w, o, _ in rows:
        if w is not None and w == w and r is not None:
            stamp = (-1 if o is None else o, w)
            newest[s, d, r] = max(newest.get((s, d, r), stamp), stamp)
    for (s, d, r), (_, w) in newest.items():
        best[s, d] = min(best.get((s, d), (-w, r)), (-w, r))
    got = {(r["segment_id"], r["dim_id"]): (-r["weight"], r["row_id"]) for r in H.best_of_lists(spark.createDataFrame(rows, LISTS), share).collect()}
    assert got == best


def test_heavy_keys_are_bounded_and_splits_are_whole(spark):
    df = spark.createDataFrame([(i % 3 if i % 2 else None, i) for i in range(3000)], "k bigint, v bigint")
    assert 1 <= len(H.heavy_hashes(df, ["k"], 0.1)) <= 10 and H.heavy_hashes(df.where("v < 0"), ["k"]) == []
    hot, rest = H.split_heavy(df, ["k"], 0.3)
    assert sorted(r["v"] for r in hot.unionByName(rest).collect()) == list(range(3000))
    assert H.best_of_lists(spark.createDataFrame([], LISTS)).collect() == []


def test_a_key_of_equal_rows_is_heavy(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, -7).otherwise(F.col("id")).alias("k"), F.lit(1).alias("v"))
    hot, rest = H.split_heavy(df, ["k"])
    assert [r["k"] for r in hot.distinct().collect()] == [-7] and hot.count() == 10_000 and rest.count() == 10_000
    other, whole = H.split_heavy(df, ["k"], counted=df.where("k >= 0"))
    assert other.count() == 0 and whole.count() == 20_000
