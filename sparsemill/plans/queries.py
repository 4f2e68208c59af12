"""Registered queries of the engine's operators over whole tables.

``L`` below are the line items as vectors (row = order, dim = supplier, weight = quantity: exact sums); ``E`` the embeddings as signed
vectors; ``V`` the events (row = user, dim = event type, last value wins); ``D`` the documents' words (dim = first 24 bits of MD5).
The tables vectors, postings, quant_params, results and segments are the engine's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsemill.functions import bitmap as B
from sparsemill.functions import vectors as V
from sparsemill.functions import weights as W
from sparsemill.functions.utility import key_runs, truncate_time
from sparsemill.operators import heavy_keys as H
from sparsemill.operators import merge as M
from sparsemill.operators import postings as P
from sparsemill.operators import search as S
from sparsemill.operators.best_match import best_matches
from sparsemill.operators.ingest_log import has_value, latest_value, live_vectors
from sparsemill.plans.registry import Registry
from sparsemill.session import table

R = Registry()

#: Query vectors of the single searches: dims are supplier keys, or positions of an embedding.
QUERY = {3: 2.0, 7: 1.0, 11: 3.0, 19: 1.0, 42: 2.0, 57: 1.0, 88: 4.0}
SIGNED = {0: 1.0, 5: -1.0, 9: 2.0, 21: -0.5, 33: 1.5, 60: -2.0}

SQL_L = "L AS (SELECT l_orderkey AS row_id, l_suppkey AS dim_id, CAST(SUM(l_quantity) AS FLOAT) AS weight FROM lineitem GROUP BY 1, 2)"
SQL_E = "E AS (SELECT vec_id AS row_id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS dim_id, unnest(embedding) AS weight FROM embeddings)"
_CODE = "CASE event_type WHEN 'view' THEN 0 WHEN 'signup' THEN 1 WHEN 'error' THEN 2 WHEN 'click' THEN 3 ELSE 4 END"
SQL_V = f"V AS (SELECT user_id AS row_id, CAST({_CODE} AS BIGINT) AS dim_id, CAST(value AS FLOAT) AS weight, event_id AS opstamp FROM events)"
SQL_VALID = """VALID AS (SELECT * FROM vectors WHERE row_id IS NOT NULL AND indices IS NOT NULL AND vals IS NOT NULL AND len(indices) = len(vals)
 AND len(list_distinct(indices)) = len(indices) AND len(list_filter(indices, lambda x: x IS NULL OR x < 0 OR x >= 4294967296)) = 0)"""
SQL_LIVE = SQL_VALID + """, LIVE AS (SELECT row_id, indices, vals, segment_id, opstamp FROM (SELECT *, row_number() OVER (PARTITION BY row_id
 ORDER BY opstamp DESC NULLS LAST, segment_id) AS rn FROM VALID) WHERE rn = 1)"""


def _values(query: dict[int, float]) -> str:
    return "Q(dim_id, qw) AS (VALUES " + ", ".join(f"(CAST({d} AS BIGINT), CAST({w} AS DOUBLE))" for d, w in query.items()) + ")"


def line_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("row_id"), F.col("l_suppkey").alias("dim_id"))
    return rows.agg(F.sum("l_quantity").cast("float").alias("weight"))


def embedding_postings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("dim_id", "weight"))
    return e.withColumn("dim_id", F.col("dim_id").cast("bigint"))


def event_postings(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", 2)
    code = kind.when(F.col("event_type") == "click", 3).otherwise(4).cast("bigint")
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("row_id"), code.alias("dim_id"), F.col("value").cast("float").alias("weight"), F.col("event_id").alias("opstamp"))


def document_postings(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.explode(F.split(F.col("text"), " ")).alias("w")).where(F.col("w") != "")
    dims = words.select("row_id", F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 6), 16, 10).cast("bigint").alias("dim_id"))
    return dims.groupBy("row_id", "dim_id").agg(F.count(F.lit(1)).cast("float").alias("weight"))


def alive_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("row_id"))


_TOP = "ORDER BY score DESC, row_id LIMIT {k}"


def _search_sql(source: str, name: str, query: dict, k: int, alive: str = "", having: str = "WHERE score > 0", weight: str = "weight") -> str:
    return f"""WITH {source}, {_values(query)}, S AS (SELECT row_id, round(SUM(CAST({weight} AS DOUBLE) * qw), 6) AS score FROM {name} JOIN Q USING (dim_id)
 {alive} GROUP BY row_id) SELECT row_id, score FROM S {having} {_TOP.format(k=k)}"""


# ---- search


@R.add(_search_sql(SQL_L, "L", QUERY, 10))
def search_topk(spark, d):
    return S.search(line_vectors(spark, d), QUERY, 10)


@R.add(_search_sql(SQL_L, "L", QUERY, 10))
def search_pruned(spark, d):
    return S.search_pruned(line_vectors(spark, d), QUERY, 10)


@R.add(_search_sql(SQL_L, "L", QUERY, 10))
def search_pruned_lists(spark, d):
    rows = line_vectors(spark, d)
    return S.search_pruned(rows, QUERY, 10, stats=P.dim_stats(rows), least_saved=1)


@R.add(_search_sql(SQL_E, "E", SIGNED, 10))
def search_signed_weights(spark, d):
    return S.search(embedding_postings(spark, d), SIGNED, 10)


_NEGATIVE = {3: 2.0, 7: -1.0, 11: 3.0, 19: -4.0}


@R.add(_search_sql(SQL_L, "L", _NEGATIVE, 20))
def search_negative_query(spark, d):
    return S.search(line_vectors(spark, d), _NEGATIVE, 20)


@R.add(_search_sql(SQL_L, "L", QUERY, 10, "WHERE row_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"))
def search_filtered_rowids(spark, d):
    return S.search(line_vectors(spark, d), QUERY, 10, alive_orders(spark, d))


#: Alive bitmap of a caller: rows 0, 3, 6, … below 60 000; later rows are past its end.
BITMAP = B.bitmap_from_rows(range(0, 60_000, 3))


@R.add(_search_sql(SQL_L, "L", QUERY, 10, "WHERE row_id % 3 = 0 AND row_id < 60000"))
def search_filtered_bitmap(spark, d):
    return S.search(line_vectors(spark, d), QUERY, 10, BITMAP)


def _batch_sql(source: str, name: str, k: int) -> str:
    return f"""WITH {source}, S AS (SELECT q.row_id AS query_id, p.row_id, round(SUM(CAST(p.weight AS DOUBLE) * CAST(q.weight AS DOUBLE)), 6) AS score
 FROM {name} p JOIN {name} q USING (dim_id) WHERE q.row_id % 100 = 0 GROUP BY 1, 2), T AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC,
 row_id) AS INTEGER) AS rank FROM S WHERE score > 0) SELECT query_id, row_id, score, rank FROM T WHERE rank <= {k}"""


def _batch(postings: DataFrame, k: int) -> DataFrame:
    queries = postings.where(F.col("row_id") % 100 == 0).select(F.col("row_id").alias("query_id"), "dim_id", F.col("weight").alias("qw"))
    return S.search_batch(postings, queries, k)


@R.add(_batch_sql(SQL_L, "L", 5))
def search_batch_topk(spark, d):
    return _batch(line_vectors(spark, d), 5)


@R.add(_batch_sql(SQL_E, "E", 5))
def search_batch_signed(spark, d):
    return _batch(embedding_postings(spark, d), 5)


@R.add(_search_sql(SQL_E, "E", SIGNED, 15, having=""))
def brute_force_topk(spark, d):
    return S.brute_force(embedding_postings(spark, d), SIGNED, 15)


_RARE = {3: -1.0, 1_000_000: 1.0}


@R.add(
    f"""WITH {SQL_L}, {_values(_RARE)}, S AS (SELECT row_id, round(SUM(CAST(weight AS DOUBLE) * qw), 6) AS score FROM L JOIN Q USING (dim_id) GROUP BY row_id)
 SELECT r.row_id, coalesce(score, 0.0) AS score FROM (SELECT DISTINCT row_id FROM L) r LEFT JOIN S USING (row_id) {_TOP.format(k=15)}"""
)
def brute_force_with_zero(spark, d):
    rows = line_vectors(spark, d)
    return S.brute_force(rows, _RARE, 15, all_rows=rows)


@R.add(_search_sql(SQL_L, "L", {1_000_000: 1.0}, 10))
def search_no_match(spark, d):
    return S.search(line_vectors(spark, d), {1_000_000: 1.0}, 10)


@R.add(_search_sql(SQL_L, "L", QUERY, 0))
def search_k_zero(spark, d):
    return S.search(line_vectors(spark, d), QUERY, 0)


@R.add(_search_sql(SQL_L, "L", {3: 1.0}, 1_000_000))
def search_k_large(spark, d):
    return S.search(line_vectors(spark, d), {3: 1.0}, 1_000_000)


@R.add(_search_sql(SQL_L, "L", QUERY, 10))
def partial_topk_combine(spark, d):
    rows = line_vectors(spark, d)
    return S.combine_top_k([S.search(rows.where(F.col("row_id") % 3 == part), QUERY, 10) for part in range(3)], 10)


@R.add(
    f"""WITH {SQL_LIVE}, P AS (SELECT row_id, unnest(indices) AS dim_id, unnest(vals) AS weight FROM LIVE), W AS (SELECT * FROM P WHERE weight IS NOT NULL AND NOT isnan(weight)),
 S AS (SELECT q.row_id AS query_id, p.row_id, round(SUM(CAST(p.weight AS DOUBLE) * CAST(q.weight AS DOUBLE)), 3) AS score FROM W p JOIN W q USING (dim_id)
 WHERE q.row_id % 100 = 0 AND p.row_id <> q.row_id GROUP BY 1, 2) SELECT query_id, max(score) AS best FROM S WHERE score > 0 GROUP BY 1"""
)
def search_live_vectors(spark, d):
    log = table(spark, d, "vectors")
    live = live_vectors(log)
    q = P.build_postings(live_vectors(log.where(F.col("row_id") % 100 == 0)), check=False)
    q = q.select(F.col("row_id").alias("query_id"), "dim_id", F.col("weight").alias("qw"))
    valid = log.where(F.col("row_id").isNotNull() & V.is_valid(F.col("indices"), F.col("vals")))
    found = best_matches(live, P.build_postings(live, check=False), q, P.build_postings(valid, check=False))
    return found.select("query_id", F.round("best", 3).alias("best")).where(F.col("best") > 0)


@R.add(
    f"""WITH T AS (SELECT doc_id AS row_id, unnest(string_split(text, ' ')) AS w FROM documents), D AS (SELECT row_id, ('0x' || substr(md5(w), 1, 6))::BIGINT AS dim_id, CAST(count(*) AS FLOAT) AS weight
 FROM T WHERE w <> '' GROUP BY 1, 2), Q AS (SELECT ('0x' || substr(md5(w), 1, 6))::BIGINT AS dim_id, 1.0::DOUBLE AS qw FROM (VALUES ('harbour'), ('schooner'), ('wheat,')) v(w)),
 S AS (SELECT row_id, round(SUM(CAST(weight AS DOUBLE) * qw), 6) AS score FROM D JOIN Q USING (dim_id) GROUP BY row_id) SELECT row_id, score FROM S WHERE score > 0 {_TOP.format(k=20)}"""
)
def document_search(spark, d):
    import hashlib

    query = {int(hashlib.md5(w.encode()).hexdigest()[:6], 16): 1.0 for w in ("harbour", "schooner", "wheat,")}
    return S.search(document_postings(spark, d), query, 20)


# ---- vectors


@R.add(
    """SELECT row_id, opstamp, coalesce(len(indices) = len(vals) AND len(list_distinct(indices)) = len(indices)
 AND len(list_filter(indices, lambda x: x IS NULL OR x < 0 OR x >= 4294967296)) = 0, false) AS valid FROM vectors"""
)
def vector_validate(spark, d):
    return table(spark, d, "vectors").select("row_id", "opstamp", V.is_valid(F.col("indices"), F.col("vals")).alias("valid"))


@R.add(f"WITH {SQL_LIVE} SELECT row_id, segment_id, opstamp, len(indices) AS nnz FROM LIVE")
def live_vector_log(spark, d):
    return live_vectors(table(spark, d, "vectors")).select("row_id", "segment_id", "opstamp", F.size("indices").cast("bigint").alias("nnz"))


@R.add(f"WITH {SQL_VALID} SELECT row_id, opstamp, segment_id, list_sort(indices) AS dims FROM VALID")
def vector_sort(spark, d):
    v = table(spark, d, "vectors").where(F.col("row_id").isNotNull() & V.is_valid(F.col("indices"), F.col("vals")))
    return v.select("row_id", "opstamp", "segment_id", V.sort_entries(F.col("indices"), F.col("vals"))["dim_id"].alias("dims"))


@R.add(f"WITH {SQL_VALID} SELECT row_id, opstamp, segment_id, indices = list_sort(indices) AS is_sorted, len(indices) = 0 AS is_empty FROM VALID")
def vector_is_sorted(spark, d):
    v = table(spark, d, "vectors").where(F.col("row_id").isNotNull() & V.is_valid(F.col("indices"), F.col("vals")))
    return v.select("row_id", "opstamp", "segment_id", V.is_sorted(F.col("indices")).alias("is_sorted"), V.is_empty(F.col("indices")).alias("is_empty"))


_PAIRS_SQL = "PAIRS AS (SELECT o_orderkey AS row_a, o_orderkey + 1 AS row_b FROM orders)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("row_a"), (F.col("o_orderkey") + 1).alias("row_b"))


@R.add(
    f"""WITH {SQL_L}, {_PAIRS_SQL} SELECT row_a, row_b, round(SUM(CAST(a.weight AS DOUBLE) * CAST(b.weight AS DOUBLE)), 6) AS score
 FROM PAIRS JOIN L a ON a.row_id = row_a JOIN L b ON b.row_id = row_b AND a.dim_id = b.dim_id GROUP BY 1, 2"""
)
def vector_pair_score(spark, d):
    return S.pair_scores(line_vectors(spark, d), _pairs(spark, d))


@R.add(
    f"""WITH {SQL_L}, {_PAIRS_SQL}, A AS (SELECT row_a, row_b, dim_id, weight AS x FROM PAIRS JOIN L ON row_id = row_a), B AS (SELECT row_a, row_b, dim_id, weight AS y FROM PAIRS JOIN L ON row_id = row_b),
 SHARED AS (SELECT row_a FROM A INTERSECT SELECT row_a FROM B)
 SELECT row_a, dim_id, CAST(coalesce(x, 0) + 2 * coalesce(y, 0) AS FLOAT) AS weight FROM A FULL JOIN B USING (row_a, row_b, dim_id) WHERE row_a IN (SELECT row_a FROM SHARED)"""
)
def vector_combine_add_scaled(spark, d):
    v = V.collect_vectors(line_vectors(spark, d))
    a = v.select(F.col("row_id").alias("row_a"), F.col("indices").alias("ia"), F.col("vals").alias("va"))
    b = v.select(F.col("row_id").alias("row_b"), F.col("indices").alias("ib"), F.col("vals").alias("vb"))
    both = _pairs(spark, d).join(a, "row_a").join(b, "row_b")
    merged = V.combine(F.col("ia"), F.col("va"), F.col("ib"), F.col("vb"), lambda x, y: (x + y * F.lit(2.0)).cast("float"))
    return both.select("row_a", F.inline(merged)).select("row_a", "dim_id", "weight")


@R.add(
    f"""WITH {SQL_L}, A AS (SELECT row_id, list(dim_id ORDER BY dim_id) AS i, list(weight ORDER BY dim_id) AS v FROM L GROUP BY 1)
 SELECT row_id, i AS indices, v AS vals FROM A"""
)
def reconstruct_vectors(spark, d):
    return V.collect_vectors(line_vectors(spark, d))


@R.add(
    """SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN CAST(value AS FLOAT) WHEN 1 THEN user_id % 256 WHEN 2 THEN user_id ELSE 0 END AS FLOAT) AS weight FROM events"""
)
def tuple_decode(spark, d):
    w = V.decode_tagged(F.col("event_id") % 4, F.col("value"), F.col("user_id") % 256, F.col("user_id"))
    return table(spark, d, "events").select("event_id", w.alias("weight"))


# ---- postings


@R.add(f"WITH {SQL_LIVE}, X AS (SELECT row_id, unnest(indices) AS dim_id, unnest(vals) AS weight FROM LIVE) SELECT * FROM X WHERE weight IS NOT NULL AND NOT isnan(weight)")
def postings_build(spark, d):
    return P.build_postings(live_vectors(table(spark, d, "vectors")))


@R.add(
    """SELECT segment_id, dim_id, row_id, weight FROM (SELECT *, row_number() OVER (PARTITION BY segment_id, dim_id, row_id ORDER BY opstamp DESC, weight DESC) AS rn
 FROM postings WHERE weight IS NOT NULL AND NOT isnan(weight)) WHERE rn = 1"""
)
def postings_upsert_lists(spark, d):
    clean = table(spark, d, "postings").where(has_value(F.col("weight")))
    return latest_value(clean, ["segment_id", "dim_id", "row_id"], "weight", "opstamp")


@R.add(f"WITH {SQL_V} SELECT dim_id, row_id, weight FROM (SELECT *, row_number() OVER (PARTITION BY dim_id, row_id ORDER BY opstamp DESC) AS rn FROM V) WHERE rn = 1")
def postings_upsert_last_wins(spark, d):
    return P.upsert(event_postings(spark, d))


@R.add(
    f"""WITH {SQL_V}, N AS (SELECT row_id, max(opstamp) AS opstamp FROM V GROUP BY 1) SELECT dim_id, row_id, weight FROM V JOIN N USING (row_id, opstamp)"""
)
def postings_replace_rows(spark, d):
    return P.replace_rows(event_postings(spark, d))


@R.add(f"WITH {SQL_L} SELECT row_id, dim_id, weight FROM L WHERE row_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def postings_delete(spark, d):
    return P.delete_rows(line_vectors(spark, d), alive_orders(spark, d))


@R.add(
    f"""WITH {SQL_L} SELECT row_id, dim_id, weight, coalesce(max(weight) OVER (PARTITION BY dim_id ORDER BY row_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
 CAST('-infinity' AS FLOAT)) AS max_next_weight FROM L"""
)
def max_next_weight(spark, d):
    return P.with_suffix_max(line_vectors(spark, d), chunk=1000)


@R.add(
    f"""WITH {SQL_L}, K AS (SELECT * FROM L WHERE row_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) SELECT row_id, dim_id, weight,
 coalesce(max(weight) OVER (PARTITION BY dim_id ORDER BY row_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), CAST('-infinity' AS FLOAT)) AS max_next_weight FROM K"""
)
def postings_delete_extended(spark, d):
    return P.delete_rows_extended(line_vectors(spark, d), alive_orders(spark, d))


_STATS_SQL = "count(*) AS n, min(row_id) AS min_row, max(row_id) AS max_row, min(weight) AS min_w, max(weight) AS max_w"


@R.add(f"WITH {SQL_L} SELECT dim_id, {_STATS_SQL} FROM L GROUP BY 1")
def dim_stats(spark, d):
    return P.dim_stats(line_vectors(spark, d))


@R.add(
    """WITH T AS (SELECT doc_id AS row_id, unnest(string_split(text, ' ')) AS w FROM documents), D AS (SELECT row_id, ('0x' || substr(md5(w), 1, 6))::BIGINT AS dim_id, CAST(count(*) AS FLOAT) AS weight
 FROM T WHERE w <> '' GROUP BY 1, 2) SELECT dim_id, count(*) AS n, min(row_id) AS min_row, max(row_id) AS max_row, min(weight) AS min_w, max(weight) AS max_w FROM D GROUP BY 1"""
)
def dim_stats_documents(spark, d):
    return P.dim_stats(document_postings(spark, d))


@R.add(
    f"""WITH {SQL_L} SELECT count(DISTINCT dim_id) AS posting_count, count(DISTINCT row_id) AS vector_count, count(*) AS n_postings, min(row_id) AS min_row, max(row_id) AS max_row,
 min(dim_id) AS min_dim, max(dim_id) AS max_dim FROM L"""
)
def index_metrics(spark, d):
    return P.index_metrics(line_vectors(spark, d))


@R.add(f"WITH {SQL_L} SELECT row_id, dim_id, weight FROM L WHERE dim_id = 42")
def posting_scan(spark, d):
    return P.scan_list(line_vectors(spark, d), 42)


@R.add(f"WITH {SQL_L} SELECT dim_id, count(*) AS remains, min(row_id) AS at_row, min(row_id) = 5000 AS hit FROM L WHERE row_id >= 5000 GROUP BY 1")
def posting_seek(spark, d):
    return P.seek(line_vectors(spark, d), 5000)


@R.add(f"WITH {SQL_L} SELECT row_id, dim_id, weight FROM L WHERE row_id <= 5000")
def posting_range(spark, d):
    return P.up_to_row(line_vectors(spark, d), 5000)


@R.add(
    f"""WITH {SQL_L}, B AS (SELECT *, (row_number() OVER (PARTITION BY dim_id ORDER BY row_id) - 1) // 128 AS block_no FROM L)
 SELECT dim_id, CAST(block_no AS BIGINT) AS block_no, min(row_id) AS row_start, max(row_id) AS row_end, count(*) AS n, max(weight) AS max_w FROM B GROUP BY 1, 2"""
)
def posting_blocks(spark, d):
    return P.block_stats(line_vectors(spark, d), chunk=1000)


# ---- weights

_PARAMS_SQL = "PARAMS AS (SELECT dim_id, min(weight) AS q_min, CAST(CAST(max(weight) - min(weight) AS FLOAT) / CAST(255 AS FLOAT) AS FLOAT) AS q_diff FROM {t} GROUP BY 1)"
_CODE_SQL = "CAST(CASE WHEN q_diff = 0 THEN 0 ELSE floor(least(greatest(CAST(CAST(CAST(weight - q_min AS FLOAT) AS DOUBLE) / CAST(q_diff AS DOUBLE) AS FLOAT)::DOUBLE, 0.0), 255.0) + 0.5) END AS SMALLINT)"
_BACK_SQL = "CAST(q_min + CAST(CAST(code AS FLOAT) * q_diff AS FLOAT) AS FLOAT)"


@R.add(f"WITH {SQL_E}, {_PARAMS_SQL.format(t='E')} SELECT * FROM PARAMS")
def quantize_params(spark, d):
    return P.quant_params(embedding_postings(spark, d))


@R.add(f"WITH {SQL_E}, {_PARAMS_SQL.format(t='E')} SELECT row_id, dim_id, {_CODE_SQL} AS code FROM E JOIN PARAMS USING (dim_id)")
def quantize_codes(spark, d):
    e = embedding_postings(spark, d)
    return P.quantize_postings(e, P.quant_params(e)).select("row_id", "dim_id", "code")


@R.add(f"WITH {SQL_E}, {_PARAMS_SQL.format(t='E')}, C AS (SELECT *, {_CODE_SQL} AS code FROM E JOIN PARAMS USING (dim_id)) SELECT row_id, dim_id, {_BACK_SQL} AS weight FROM C")
def dequantize(spark, d):
    e = embedding_postings(spark, d)
    return P.dequantize_postings(P.quantize_postings(e, P.quant_params(e))).select("row_id", "dim_id", "weight")


@R.add(
    f"""WITH P AS (SELECT DISTINCT segment_id, dim_id, q_min, q_diff FROM quant_params WHERE q_min IS NOT NULL AND q_diff IS NOT NULL), C AS (SELECT segment_id, dim_id, row_id, opstamp, {_CODE_SQL} AS code
 FROM (SELECT DISTINCT * FROM postings) JOIN P USING (segment_id, dim_id) WHERE weight IS NOT NULL AND NOT isnan(weight)) SELECT segment_id, code, count(*) AS n FROM C GROUP BY 1, 2"""
)
def quantize_stored_params(spark, d):
    params = table(spark, d, "quant_params").where(F.col("q_min").isNotNull() & F.col("q_diff").isNotNull()).distinct()
    clean = table(spark, d, "postings").distinct().where(has_value(F.col("weight")))
    return P.quantize_postings(clean, params, "segment_id").groupBy("segment_id", "code").agg(F.count(F.lit(1)).alias("n"))


@R.add(
    f"""WITH {SQL_L}, {_values(QUERY)}, {_PARAMS_SQL.format(t='L')}, C AS (SELECT *, {_CODE_SQL} AS code FROM L JOIN PARAMS USING (dim_id)), W AS (SELECT row_id, dim_id, {_BACK_SQL} AS weight FROM C),
 S AS (SELECT row_id, round(SUM(CAST(weight AS DOUBLE) * qw), 6) AS score FROM W JOIN Q USING (dim_id) GROUP BY row_id) SELECT row_id, score FROM S WHERE score > 0 {_TOP.format(k=10)}"""
)
def search_quantized(spark, d):
    rows = line_vectors(spark, d)
    coded = P.quantize_postings(rows, P.quant_params(rows))
    return S.search(P.dequantize_postings(coded).select("row_id", "dim_id", "weight"), QUERY, 10)


_F16_SQL = """CAST(CASE WHEN {x} = 0 THEN {x} WHEN abs({x}) >= 65520 THEN sign({x}) * CAST('infinity' AS DOUBLE) ELSE
 CAST(round_even(CAST({x} AS DOUBLE) / pow(2.0, greatest(floor(log2(abs(CAST({x} AS DOUBLE)))), -14.0) - 10.0), 0) AS DOUBLE) * pow(2.0, greatest(floor(log2(abs(CAST({x} AS DOUBLE)))), -14.0) - 10.0) END AS FLOAT)"""
_U8_SQL = "CAST(trunc(least(greatest(CAST({x} AS DOUBLE), 0.0), 255.0)) AS SMALLINT)"


@R.add(f"WITH {SQL_E} SELECT row_id, dim_id, {_F16_SQL.format(x='weight')} AS weight FROM E")
def weight_f16(spark, d):
    return embedding_postings(spark, d).select("row_id", "dim_id", W.to_f16(F.col("weight")).alias("weight"))


@R.add(f"WITH {SQL_L} SELECT row_id, dim_id, {_U8_SQL.format(x='weight * 3 - 20')} AS weight FROM L")
def weight_u8(spark, d):
    return line_vectors(spark, d).select("row_id", "dim_id", W.to_u8((F.col("weight") * 3 - 20).cast("float")).alias("weight"))


@R.add(_search_sql(SQL_E, "E", SIGNED, 10, weight=_F16_SQL.format(x="weight")))
def search_f16(spark, d):
    return S.search(embedding_postings(spark, d).withColumn("weight", W.to_f16(F.col("weight"))), SIGNED, 10)


@R.add(_search_sql(SQL_L, "L", QUERY, 10, weight=_U8_SQL.format(x="weight")))
def search_u8(spark, d):
    return S.search(line_vectors(spark, d).withColumn("weight", W.as_weight_type(F.col("weight"), "u8")), QUERY, 10)


@R.add(
    f"""WITH {SQL_E}, {_PARAMS_SQL.format(t='E')}, C AS (SELECT *, {_CODE_SQL} AS code FROM E JOIN PARAMS USING (dim_id)), B AS (SELECT row_id, dim_id, weight, {_BACK_SQL} AS back FROM C)
 SELECT dim_id, row_id FROM B WHERE NOT abs(CAST(weight AS DOUBLE) - CAST(back AS DOUBLE)) <= CAST(greatest(abs(weight), abs(back)) AS DOUBLE) * 0.005"""
)
def lists_differing_after_codes(spark, d):
    e = embedding_postings(spark, d)
    back = P.dequantize_postings(P.quantize_postings(e, P.quant_params(e)))
    return P.differing_postings(e, back)


@R.add("SELECT CAST(NULL AS BIGINT) AS dim_id, CAST(NULL AS BIGINT) AS row_id WHERE false")
def lists_equal_within_a_code(spark, d):
    e = embedding_postings(spark, d)
    params = P.quant_params(e)
    return P.differing_postings(e, P.dequantize_postings(P.quantize_postings(e, params)), params)


# ---- bitmaps


@R.add("SELECT CAST(range AS BIGINT) AS row_id FROM range(0, 60000, 3)")
def bitmap_to_rowids(spark, d):
    return B.rows_from_bitmap(B.bitmap_frame(spark, BITMAP))


@R.add("SELECT o_orderkey AS row_id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def bitmap_intersect(spark, d):
    returned = table(spark, d, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("row_id"))
    return B.intersect_alive(alive_orders(spark, d), returned)


@R.add("SELECT o_orderkey AS row_id FROM orders WHERE o_orderstatus = 'F' UNION SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def bitmap_union(spark, d):
    returned = table(spark, d, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("row_id"))
    return B.union_alive(alive_orders(spark, d), returned)


@R.add("SELECT DISTINCT row_id FROM vectors WHERE row_id IS NOT NULL AND row_id NOT IN (SELECT row_id FROM postings WHERE weight > 1)")
def bitmap_deleted(spark, d):
    alive = table(spark, d, "postings").where((F.col("weight") > 1)).select("row_id")
    return B.deleted_rows(table(spark, d, "vectors").where(F.col("row_id").isNotNull()).select("row_id").distinct(), alive)


@R.add("SELECT row_id // 32768 AS word_no, count(DISTINCT row_id) AS n_alive FROM vectors WHERE row_id IS NOT NULL GROUP BY 1")
def bitmap_words(spark, d):
    return B.packed_words(table(spark, d, "vectors")).select("word_no", "n_alive")


# ---- merge


def _thirds(rows: DataFrame) -> list[DataFrame]:
    """The table as three segments; every row is in one of them."""
    stamped = rows.withColumn("opstamp", F.col("row_id"))
    return [stamped.where(F.col("row_id") % 3 == i) for i in range(3)]


@R.add(f"WITH {SQL_L} SELECT dim_id, row_id, weight FROM L")
def merge_postings(spark, d):
    return M.merge_postings(_thirds(line_vectors(spark, d)))


@R.add(
    f"""WITH {SQL_L} SELECT dim_id, row_id, weight, coalesce(max(weight) OVER (PARTITION BY dim_id ORDER BY row_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
 CAST('-infinity' AS FLOAT)) AS max_next_weight FROM L"""
)
def merge_extended(spark, d):
    return M.merge_extended(_thirds(line_vectors(spark, d)))


_PART_SQL = "PARTS AS (SELECT *, row_id % 3 AS part FROM L), PP AS (SELECT part, dim_id, min(weight) AS q_min, CAST(CAST(max(weight) - min(weight) AS FLOAT) / CAST(255 AS FLOAT) AS FLOAT) AS q_diff FROM PARTS GROUP BY 1, 2)"


@R.add(
    f"""WITH {SQL_L}, {_PART_SQL}, C AS (SELECT *, {_CODE_SQL} AS code FROM PARTS JOIN PP USING (part, dim_id)), D AS (SELECT dim_id, row_id, {_BACK_SQL} AS weight FROM C), {_PARAMS_SQL.format(t='D')}
 SELECT dim_id, row_id, {_CODE_SQL} AS code FROM D JOIN PARAMS USING (dim_id)"""
)
def merge_requantize(spark, d):
    parts = _thirds(line_vectors(spark, d))
    params = [P.quant_params(p) for p in parts]
    coded = [P.quantize_postings(p, q).select("dim_id", "row_id", "code", "opstamp") for p, q in zip(parts, params, strict=True)]
    return M.merge_quantized(coded, params)[0]


@R.add()
def merge_candidates(spark, d):
    policy = M.LevelMerge(level_log=2.0, floor_rows=16, min_segments=2)
    groups = policy.candidates(M.segment_sizes(table(spark, d, "segments")))
    return spark.createDataFrame([(i, s) for i, g in enumerate(groups) for s in g], "merge_no int, segment_id string")


# ---- utility


@R.add("SELECT event_id, date_trunc('second', ts) AS at_second FROM events")
def truncate_event_time(spark, d):
    return table(spark, d, "events").select("event_id", truncate_time(F.col("ts"), "s").cast("timestamp_ntz").alias("at_second"))


@R.add(
    """WITH C AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), R AS (SELECT *, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run_no FROM C)
 SELECT user_id, run_no, event_type, count(*) AS n FROM R GROUP BY 1, 2, 3"""
)
def consecutive_runs(spark, d):
    return key_runs(table(spark, d, "events"), "event_type", "event_id", "user_id")


# ---- problem 5: few keys, most records

_SQL_BEST = """WITH C AS (SELECT *, row_number() OVER (PARTITION BY segment_id, dim_id, row_id ORDER BY opstamp DESC NULLS LAST, weight DESC) AS rn FROM postings
 WHERE weight IS NOT NULL AND NOT isnan(weight) AND row_id IS NOT NULL), B AS (SELECT *, row_number() OVER (PARTITION BY segment_id, dim_id ORDER BY weight DESC, row_id) AS best FROM C WHERE rn = 1)
 SELECT segment_id, dim_id, row_id{} FROM B WHERE best = 1"""


@R.add(_SQL_BEST.format(""))
def p5_found(spark, d):
    return H.best_of_lists(table(spark, d, "postings")).select("segment_id", "dim_id", "row_id")


@R.add(
    f"""WITH {SQL_LIVE}, X AS (SELECT row_id, unnest(indices) AS dim_id, unnest(vals) AS w FROM LIVE), Y AS (SELECT dim_id, CASE WHEN isnan(w) THEN NULL ELSE w END AS v FROM X)
 SELECT dim_id, count(*) AS n, count(v) AS n_values, min(v) AS w_min, max(v) AS w_max FROM Y GROUP BY 1"""
)
def p5_dims(spark, d):
    log = table(spark, d, "vectors")
    return H.dim_summary(V.explode_vectors(live_vectors(log), "row_id"), counted=log.select(F.explode("indices").alias("dim_id")))


def all_queries() -> Registry:
    from sparsemill.plans import lifecycle  # noqa: F401  (registers on import)

    return R
