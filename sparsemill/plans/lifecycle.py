"""Registered queries that run an index through its life: ingest, commit, roll back, compact, stream, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsemill import api
from sparsemill.config import IndexSettings
from sparsemill.functions.vectors import collect_vectors
from sparsemill.operators.merge import MergeAll, NoMerge
from sparsemill.plans.queries import (
    _BACK_SQL, _CODE_SQL, _F16_SQL, _PARAMS_SQL, _TOP, _U8_SQL, QUERY, SIGNED, SQL_E, SQL_L, SQL_V, R, _search_sql, _values, alive_orders,
    embedding_postings, event_postings, line_vectors,
)
from sparsemill.session import checkpoint
from sparsemill.sources.index import SparseIndex
from sparsemill.streaming.ingest import commit_batch


def _line_index(spark: SparkSession, d: str, settings: IndexSettings | None = None, parts: int = 3) -> SparseIndex:
    """Index over all line item vectors, committed in ``parts`` segments."""
    index = SparseIndex.create_temporary(spark, settings)
    vectors = checkpoint(collect_vectors(line_vectors(spark, d)))
    with index.writer(NoMerge()) as writer:
        for part in range(parts):
            writer.append(vectors.where(F.col("row_id") % parts == part))
        writer.commit()
    return index


@R.add(_search_sql(SQL_L, "L", QUERY, 10))
def committed_visible(spark, d):
    return _line_index(spark, d).reader().searcher().search(QUERY, 10)


@R.add(_search_sql(SQL_L, "L", QUERY, 10))
def rollback_invisible(spark, d):
    index = _line_index(spark, d)
    doubled = collect_vectors(line_vectors(spark, d).withColumn("weight", F.col("weight") * 2))
    with index.writer(NoMerge()) as writer:
        writer.append(doubled)
        writer.rollback()
        writer.commit()
    return index.reader().searcher().search(QUERY, 10)


@R.add(_search_sql(SQL_L, "L", QUERY, 10))
def compaction_invariant(spark, d):
    index = _line_index(spark, d, IndexSettings(storage="compressed"))
    with index.writer(NoMerge()) as writer:
        writer.compact([s.segment_id for s in index.snapshot().segments])
        writer.vacuum()
    return index.reader().searcher().search(QUERY, 10)


@R.add(_search_sql(SQL_L, "L", QUERY, 10))
def extended_index_search(spark, d):
    return _line_index(spark, d, IndexSettings(element="extended")).reader().searcher().search(QUERY, 10, prune=True)


@R.add(
    f"""WITH {SQL_V}, U AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dim_id, row_id ORDER BY opstamp DESC) AS rn FROM V) WHERE rn = 1),
 S AS (SELECT row_id, round(SUM(CAST(weight AS DOUBLE) * (1 + dim_id)), 6) AS score FROM U GROUP BY 1) SELECT row_id, score FROM S WHERE score > 0 ORDER BY score DESC, row_id LIMIT 10"""
)
def streaming_ingest(spark, d):
    """Events as a stream of batches in order of event_id; a batch given twice counts once."""
    index = SparseIndex.create_temporary(spark)
    events = event_postings(spark, d).select("row_id", F.array("dim_id").alias("indices"), F.array("weight").alias("vals"), "opstamp")
    half = events.agg(F.percentile_approx("opstamp", 0.5)).first()[0] or 0
    for batch_id, batch in enumerate((events.where(F.col("opstamp") <= half), events.where(F.col("opstamp") > half))):
        commit_batch(index, batch, batch_id)
        commit_batch(index, batch, batch_id)
    return index.reader().searcher().search({c: 1.0 + c for c in range(5)}, 10)


@R.add("SELECT CAST(NULL AS VARCHAR) AS segment_id WHERE false")
def checksum_validation(spark, d):
    """Damaged segments of a fresh index: none."""
    index = _line_index(spark, d)
    return spark.createDataFrame([(s,) for s in index.validate_checksums()], "segment_id string")


@R.add(f"WITH {SQL_L} SELECT count(*) AS postings, count(DISTINCT row_id) AS rows, 3::BIGINT AS segments FROM L")
def manifest_totals(spark, d) -> DataFrame:
    m = _line_index(spark, d).segments_frame()
    return m.agg(F.sum("postings_count").alias("postings"), F.sum("rows_count").alias("rows"), F.count(F.lit(1)).alias("segments"))


# ---- deletes and replacement


@R.add(_search_sql(SQL_L, "L", QUERY, 10, "WHERE row_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"))
def index_deleted_rows(spark, d):
    index = _line_index(spark, d)
    with index.writer(NoMerge()) as writer:
        writer.delete_rows(alive_orders(spark, d))
        writer.commit()
    return index.reader().searcher().search(QUERY, 10)


@R.add(f"WITH {SQL_L} SELECT count(DISTINCT row_id) AS rows FROM L WHERE row_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def index_deleted_and_compacted(spark, d):
    index = _line_index(spark, d)
    with index.writer(NoMerge()) as writer:
        writer.delete_rows(alive_orders(spark, d))
        writer.commit()
        writer.compact([s.segment_id for s in index.snapshot().segments])
    return index.reader().searcher().rows().agg(F.count(F.lit(1)).alias("rows"))


@R.add(
    f"""WITH {SQL_V}, N AS (SELECT row_id, max(opstamp) AS opstamp FROM V GROUP BY 1), U AS (SELECT dim_id, row_id, weight FROM V JOIN N USING (row_id, opstamp)),
 S AS (SELECT row_id, round(SUM(CAST(weight AS DOUBLE) * (1 + dim_id)), 6) AS score FROM U GROUP BY 1) SELECT row_id, score FROM S WHERE score > 0 ORDER BY score DESC, row_id LIMIT 10"""
)
def index_replaced_rows(spark, d):
    """Events in two batches, each replacing the whole rows it names."""
    index = SparseIndex.create_temporary(spark)
    events = event_postings(spark, d).select("row_id", F.array("dim_id").alias("indices"), F.array("weight").alias("vals"), "opstamp")
    half = events.agg(F.percentile_approx("opstamp", 0.5)).first()[0] or 0
    with index.writer(NoMerge()) as writer:
        for batch in (events.where(F.col("opstamp") <= half), events.where(F.col("opstamp") > half)):
            writer.append(batch, replace_row=True)
            writer.commit()
    return index.reader().searcher().search({c: 1.0 + c for c in range(5)}, 10)


# ---- weight types, policies, readers, facade


def _embedding_index(spark: SparkSession, d: str, settings: IndexSettings) -> SparseIndex:
    index = SparseIndex.create_temporary(spark, settings)
    with index.writer(NoMerge()) as writer:
        writer.append(collect_vectors(embedding_postings(spark, d)))
        writer.commit()
    return index


@R.add(_search_sql(SQL_E, "E", SIGNED, 10, weight=_F16_SQL.format(x="weight")))
def index_f16_search(spark, d):
    return _embedding_index(spark, d, IndexSettings(weight="f16", storage="compressed")).reader().searcher().search(SIGNED, 10)


@R.add(_search_sql(SQL_L, "L", QUERY, 10, weight=_U8_SQL.format(x="weight")))
def index_u8_search(spark, d):
    return _line_index(spark, d, IndexSettings(weight="u8")).reader().searcher().search(QUERY, 10)


@R.add(
    f"""WITH {SQL_L}, {_values(QUERY)}, {_PARAMS_SQL.format(t='L')}, C AS (SELECT *, {_CODE_SQL} AS code FROM L JOIN PARAMS USING (dim_id)), W AS (SELECT row_id, dim_id, {_BACK_SQL} AS weight FROM C),
 S AS (SELECT row_id, round(SUM(CAST(weight AS DOUBLE) * qw), 6) AS score FROM W JOIN Q USING (dim_id) GROUP BY row_id) SELECT row_id, score FROM S WHERE score > 0 {_TOP.format(k=10)}"""
)
def index_quantized_search(spark, d):
    return _line_index(spark, d, IndexSettings(quantized=True), parts=1).reader().searcher().search(QUERY, 10)


@R.add(_search_sql(SQL_L, "L", QUERY, 10))
def index_merged_on_commit(spark, d):
    index = SparseIndex.create_temporary(spark)
    vectors = checkpoint(collect_vectors(line_vectors(spark, d)))
    with index.writer(MergeAll()) as writer:
        for part in range(2):
            writer.append(vectors.where(F.col("row_id") % 2 == part))
            writer.commit()
    return index.reader().searcher().search(QUERY, 10)


@R.add(_search_sql(SQL_L, "L", QUERY, 10, "WHERE row_id % 3 = 1"))
def index_cleared_and_prepared(spark, d):
    """All rows dropped, a third of them inserted anew by a commit in two steps."""
    index = _line_index(spark, d)
    with index.writer(NoMerge()) as writer:
        writer.delete_all()
        writer.append(collect_vectors(line_vectors(spark, d).where(F.col("row_id") % 3 == 1)))
        prepared = writer.prepare_commit()
        prepared.set_payload("a third")
        prepared.commit()
    return index.reader().searcher().search(QUERY, 10)


@R.add(_search_sql(SQL_L, "L", QUERY, 10, "WHERE row_id % 2 = 0"))
def reader_point_in_time(spark, d):
    """A searcher opened before a commit does not see it; it is kept in memory meanwhile."""
    index = SparseIndex.create_temporary(spark)
    vectors = checkpoint(collect_vectors(line_vectors(spark, d)))
    with index.writer(NoMerge()) as writer:
        writer.append(vectors.where(F.col("row_id") % 2 == 0))
        writer.commit()
        searcher = index.reader().searcher().warm()
        writer.append(vectors.where(F.col("row_id") % 2 == 1))
        writer.commit()
    return searcher.search(QUERY, 10)


@R.add(_search_sql(SQL_L, "L", QUERY, 10))
def facade_search(spark, d):
    api.create_index(spark, path := SparseIndex.create_temporary(spark).path + "-api", {"weight": "f32"})
    api.insert_df(spark, path, collect_vectors(line_vectors(spark, d)))
    api.load_reader(spark, path)
    api.commit(spark, path)
    found = api.search(path, QUERY, 10)
    api.close_writer(path)
    api.close_reader(path)
    return found
