"""Physical plans of the operators that matter at scale."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from sparsemill.operators import heavy_keys as H
from sparsemill.operators import search as S
from sparsemill.operators.ingest_log import live_vectors
from sparsemill.sources.index import SparseIndex

VECTORS = "row_id bigint, indices array<bigint>, vals array<float>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def index(spark, path):
    made = SparseIndex.create(spark, str(path))
    with made.writer() as w:
        w.append(spark.createDataFrame([(i, [i % 7, 9], [1.0, 2.0]) for i in range(50)], VECTORS))
        w.commit()
    return made


def test_search_prunes_and_aggregates_before_the_shuffle(spark, tmp_path):
    text = plan(index(spark, tmp_path / "i").reader().searcher().search({3: 1.0, 9: 2.0}, 5))
    assert "PushedFilters: [In(dim_id, [3,9])" in text or "In(dim_id, [3,9])" in text
    assert "BroadcastHashJoin" in text and "TakeOrderedAndProject" in text and "partial_sum" in text
    assert "ReadSchema: struct<dim_id:bigint,row_id:bigint,weight:float>" in text
    assert "Python" not in text and "InArrow" not in text
    assert text.count("Exchange hashpartitioning") == 1


def test_batch_search_limits_groups_below_the_shuffle(spark, tmp_path):
    postings = index(spark, tmp_path / "i").reader().searcher().postings()
    queries = postings.where(F.col("row_id") % 10 == 0).select(F.col("row_id").alias("query_id"), "dim_id", F.col("weight").alias("qw"))
    assert plan(S.search_batch(postings, queries, 3)).count("WindowGroupLimit") == 2


def test_live_vectors_limit_versions_below_the_shuffle(spark):
    log = spark.createDataFrame([(1, [1], [1.0], "s", 1)], VECTORS + ", segment_id string, opstamp bigint")
    assert plan(live_vectors(log)).count("WindowGroupLimit") == 2


def test_light_lists_take_one_shuffle(spark):
    rows = spark.createDataFrame([("a", i % 40, i, 1.0, 1) for i in range(400)], "segment_id string, dim_id bigint, row_id bigint, weight float, opstamp bigint")
    text = plan(H.best_of_lists(rows))
    light = text.split("Union")[1].split("BroadcastHashJoin")[0]
    assert light.count("Exchange hashpartitioning") == 1 and "LeftAnti" in text and "LeftSemi" in text


def test_summaries_combine_before_the_shuffle(spark):
    rows = spark.createDataFrame([(i, i % 40, 1.0) for i in range(400)], "row_id bigint, dim_id bigint, weight float")
    light = plan(H.dim_summary(rows)).split("Union")[1].split("LeftAnti")[0]
    assert light.count("Exchange hashpartitioning") == 1 and light.index("partial_count") > light.index("Exchange hashpartitioning")


def test_the_core_stands_alone():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['sparsemill.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p5_found' in q and 'p1_found' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
    for folder, _, files in os.walk(os.path.join(root, "sparsemill")):
        for f in files:
            if f.endswith(".py") and os.path.basename(folder) != "llm":
                with open(os.path.join(folder, f)) as text:
                    assert "sparsemill.llm" not in text.read(), f
