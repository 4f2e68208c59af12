"""Sources of vectors."""

from pyspark.sql import functions as F

from sparsemill.functions.vectors import is_sorted, is_valid
from sparsemill.sources import datasets as D


def test_json(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"row": 1, "indices": [3, 1], "values": [0.5, 2]}\n{"row": 2}\nnonsense\n')
    got = sorted(((r["row_id"], r["indices"], r["vals"]) for r in D.read_json_vectors(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(1, [3, 1], [0.5, 2.0]), (2, None, None), (None, None, None)], key=str)


def test_tagged(spark):
    rows = [(1, [(5, 1.5, 0, 0, 0), (6, 0.0, 7, 0, 1), (7, 0.0, 0, 9, 2), (8, 1.0, 1, 1, 9)]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, f"row_id bigint, elements array<{D.ELEMENT}>")
    assert [(r["indices"], r["vals"]) for r in D.from_tagged(df).orderBy("row_id").collect()] == [([5, 6, 7, 8], [1.5, 7.0, 9.0, 0.0]), ([], []), (None, None)]


def test_generators(spark):
    v = D.load_vectors(spark, 50, 8, 16).orderBy("row_id").collect()
    assert v[3]["indices"] == [(3 + j) % 16 for j in range(8)] and abs(v[3]["vals"][2] - (0.1 + 5 * 0.001 / 16)) < 1e-6
    for positive in (False, True):
        r = D.random_vectors(spark, 40, 2000, positive=positive)
        assert r.where(~is_valid(F.col("indices"), F.col("vals")) | ~is_sorted(F.col("indices"))).count() == 0
        low, high, n = r.select(F.explode("vals").alias("v")).agg(F.min("v"), F.max("v"), F.count("v")).first()
        assert (0 if positive else -100) <= low < high <= 100 and n > 1000
    assert D.from_rows(spark, [(1, [2], [3])]).first()["vals"] == [3.0]
