"""Registered queries of this subpackage over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparsemill.llm import eval_leaks as E
from sparsemill.llm import group_topn as T
from sparsemill.llm import log_percentiles as Q
from sparsemill.llm import moderation as M
from sparsemill.llm import similar_vectors as N
from sparsemill.llm import term_frequency as C
from sparsemill.llm.tokenizer_encode import encode_texts
from sparsemill.functions.vectors import explode_vectors, is_valid
from sparsemill.operators.ingest_log import live_vectors
from sparsemill.plans.queries import SQL_LIVE
from sparsemill.plans.registry import Registry
from sparsemill.session import table

R = Registry()

_TOP_SQL = """WITH C AS (SELECT segment_id, query_id, row_id, score, row_number() OVER (PARTITION BY segment_id, query_id, row_id ORDER BY opstamp DESC NULLS LAST, score DESC) AS rn
 FROM results WHERE score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score) AND row_id IS NOT NULL),
 B AS (SELECT *, CAST(row_number() OVER (PARTITION BY segment_id, query_id ORDER BY score DESC, row_id) AS INTEGER) AS rank FROM C WHERE rn = 1)
 SELECT segment_id, query_id, row_id{} FROM B WHERE rank <= 10"""


@R.add(_TOP_SQL.format(""))
def p1_found(spark, d):
    return T.top_n(table(spark, d, "results"), ["segment_id", "query_id"]).select("segment_id", "query_id", "row_id")


@R.add(_TOP_SQL.format(", score, rank"))
def p1_ranked(spark, d):
    return T.top_n(table(spark, d, "results"), ["segment_id", "query_id"])


_PERCENTILES = {"p50": 0.5, "p95": 0.95}


def _value_sketch(spark, d):
    return Q.sketch(explode_vectors(live_vectors(table(spark, d, "vectors")), "segment_id"), ["segment_id", "dim_id"], "weight")


def _param_sketch(spark, d):
    whole = table(spark, d, "quant_params").where(F.col("q_min").isNotNull()).distinct()
    return Q.sketch(whole.withColumn("dim_id", F.lit(-1).cast("bigint")), ["segment_id", "dim_id"], "q_min")


def _long_tails(spark, d):
    both = _value_sketch(spark, d).unionByName(_param_sketch(spark, d))
    return Q.percentiles(both, ["segment_id", "dim_id"], _PERCENTILES)


_TAILS_SQL = f"""WITH {SQL_LIVE}, X AS (SELECT segment_id, unnest(indices) AS dim_id, unnest(vals) AS v FROM LIVE UNION ALL
 SELECT segment_id, -1, q_min FROM (SELECT DISTINCT * FROM quant_params WHERE q_min IS NOT NULL)), Y AS (SELECT *, row_number() OVER (PARTITION BY segment_id, dim_id ORDER BY v) AS rn,
 count(*) OVER (PARTITION BY segment_id, dim_id) AS n FROM X WHERE v IS NOT NULL AND NOT isnan(v)),
 P AS (SELECT segment_id, dim_id, n, max(v) FILTER (rn = ceil(0.5::DOUBLE * n)) AS p50, max(v) FILTER (rn = ceil(0.95::DOUBLE * n)) AS p95 FROM Y GROUP BY 1, 2, 3)
 """


@R.add(_TAILS_SQL + "SELECT segment_id, dim_id FROM P WHERE n >= 50 AND p95 >= 4 * p50")
def p2_found(spark, d):
    tails = _long_tails(spark, d)
    return tails.where((F.col("n") >= 50) & (F.col("p95") >= 4 * F.col("p50"))).select("segment_id", "dim_id")


@R.add(_TAILS_SQL + "SELECT segment_id, dim_id, n FROM P")
def p2_group_sizes(spark, d):
    return _long_tails(spark, d).select("segment_id", "dim_id", "n")


@R.add()
def p2_percentiles(spark, d):
    """Within the stated relative error of the exact values (tests), so there is no equal SQL."""
    return _long_tails(spark, d)


_BUCKET = f"""CAST(CASE WHEN {{v}} = 0 THEN 0 ELSE sign({{v}}) * (ceil(ln(least(greatest(abs(CAST({{v}} AS DOUBLE)), {Q.SMALLEST}), {Q.LARGEST})) / {Q.log_gamma()!r}::DOUBLE) + {Q.shift()}) END AS INTEGER)"""


@R.add(_TAILS_SQL + f"SELECT segment_id, dim_id, {_BUCKET.format(v='p50')} AS p50_bucket, {_BUCKET.format(v='p95')} AS p95_bucket FROM P")
def p2_percentile_buckets(spark, d):
    """The buckets of the percentiles: those that the exact percentiles fall into."""
    return _long_tails(spark, d).select("segment_id", "dim_id", *[Q.bucket_of(F.col(p)).alias(f"{p}_bucket") for p in _PERCENTILES])


def _dims(spark, d):
    log = table(spark, d, "vectors")
    live = live_vectors(log)
    return C.mark_useless(C.term_counts(live, "indices", log), live.agg(F.count(F.lit(1)).alias("n_records")))


_DIMS_SQL = f"""WITH {SQL_LIVE}, X AS (SELECT row_id, unnest(indices) AS term FROM LIVE), F AS (SELECT term, count(*) AS occurrences, count(DISTINCT row_id) AS records FROM X GROUP BY 1),
 M AS (SELECT *, CASE WHEN records < 5 THEN 'rare' WHEN records > 0.4 * (SELECT count(*) FROM LIVE) THEN 'common' END AS mark FROM F) """


@R.add(_DIMS_SQL + "SELECT term AS dim_id FROM M WHERE mark IS NOT NULL")
def p3_found(spark, d):
    return _dims(spark, d).where(F.col("mark").isNotNull()).select(F.col("term").alias("dim_id"))


@R.add(_DIMS_SQL + "SELECT term AS dim_id, occurrences, records, mark FROM M")
def p3_counts(spark, d):
    return _dims(spark, d).withColumnRenamed("term", "dim_id")


@R.add(
    """WITH X AS (SELECT doc_id, unnest(string_split(text, ' ')) AS term FROM documents WHERE text IS NOT NULL), F AS (SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM X GROUP BY 1)
 SELECT *, CASE WHEN records < 5 THEN 'rare' WHEN records > 0.4 * (SELECT count(*) FROM documents) THEN 'common' END AS mark FROM F"""
)
def p3_words(spark, d):
    """Words of the documents, as they stand between blanks."""
    documents = table(spark, d, "documents")
    words = documents.select(F.split("text", " ").alias("words"))
    return C.mark_useless(C.term_counts(words, "words"), documents.agg(F.count(F.lit(1)).alias("n_records")))


@R.add(
    f"""WITH {SQL_LIVE}, X AS (SELECT row_id, unnest(indices) AS d, CAST(unnest(vals) AS DOUBLE) AS w FROM LIVE), E AS (SELECT * FROM X WHERE w IS NOT NULL AND NOT isnan(w)),
 N AS (SELECT row_id, sqrt(sum(w * w)) AS n FROM E GROUP BY 1), U AS (SELECT row_id, d, w / n AS w FROM E JOIN N USING (row_id) WHERE n > 0)
 SELECT a.row_id AS row_id_a, b.row_id AS row_id_b FROM U a JOIN U b ON a.d = b.d AND a.row_id < b.row_id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.8"""
)
def p4_found(spark, d):
    log = table(spark, d, "vectors")
    near = N.similar_vectors(live_vectors(log), log=log.where(is_valid(F.col("indices"), F.col("vals"))))
    return near.select(F.least("row_id", "neighbour").alias("row_id_a"), F.greatest("row_id", "neighbour").alias("row_id_b")).distinct()


@R.add()
def p4_neighbours(spark, d):
    log = table(spark, d, "vectors")
    return N.similar_vectors(live_vectors(log), least=None, log=log.where(is_valid(F.col("indices"), F.col("vals"))))


@R.add(
    f"""WITH {SQL_LIVE}, X AS (SELECT row_id, unnest(indices) AS d, CAST(unnest(vals) AS DOUBLE) AS w FROM LIVE), E AS (SELECT * FROM X WHERE w IS NOT NULL AND NOT isnan(w)),
 N AS (SELECT row_id, sqrt(sum(w * w)) AS n FROM E GROUP BY 1), U AS (SELECT row_id, d, w / n AS w FROM E JOIN N USING (row_id) WHERE n > 0),
 C AS (SELECT a.row_id, b.row_id AS neighbour, round(sum(a.w * b.w), 9) AS cosine FROM U a JOIN U b ON a.d = b.d AND a.row_id <> b.row_id WHERE a.row_id % 100 = 0 GROUP BY 1, 2)
 SELECT row_id, neighbour, CAST(row_number() OVER (PARTITION BY row_id ORDER BY cosine DESC, neighbour) AS INTEGER) AS rank FROM C QUALIFY rank <= 10"""
)
def p4_neighbours_of_hundredths(spark, d):
    """The lists of ids divisible by 100 out of the search of all, against all pairs that share a dim."""
    return p4_neighbours(spark, d).where(F.col("row_id") % 100 == 0).select("row_id", "neighbour", "rank")


@R.add()
def p6_ids(spark, d):
    return encode_texts(table(spark, d, "documents"))


def _leaks(spark, d):
    return E.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@R.add()
def p7_found(spark, d):
    return _leaks(spark, d).select("doc_id", "item_id")


@R.add()
def p7_leak_lengths(spark, d):
    return _leaks(spark, d)


@R.add()
def p8_found(spark, d):
    return M.page_scores(table(spark, d, "documents")).where(F.col("score") >= M.FOUND).select("doc_id")


@R.add()
def p8_scores(spark, d):
    return M.page_scores(table(spark, d, "documents"))


@R.add()
def p8_source_rates(spark, d):
    return M.source_rates(M.page_scores(table(spark, d, "documents")))
