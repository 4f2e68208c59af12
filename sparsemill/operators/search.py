"""Maximum inner product search as DataFrame plans.

Scores add up in double over float weights and are rounded to ``SCORE_DIGITS`` before they are filtered or ordered, so that ties do not
depend on the order of addition. Results are ordered by score descending, row_id ascending.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparsemill.functions.bitmap import is_alive
from sparsemill.session import broadcast_if_small

SCORE_DIGITS = 6
#: A query vector given as Python values may have so many dims; larger ones come as a DataFrame.
MAX_LITERAL_DIMS = 100_000
#: Postings that pruning must spare to be worth a job of its own.
PRUNE_POSTINGS = 10_000_000

Query = Mapping[int, float] | DataFrame


def _query_frame(postings: DataFrame, query: Query) -> tuple[DataFrame, list[int] | None]:
    if isinstance(query, DataFrame):
        return query, None
    if len(query) > MAX_LITERAL_DIMS:
        raise ValueError("pass a query of that size as a DataFrame (dim_id, qw)")
    rows = [(int(d), float(w)) for d, w in query.items()]
    return postings.sparkSession.createDataFrame(rows, "dim_id bigint, qw float"), sorted(d for d, _ in rows)


def keep_alive(df: DataFrame, alive: DataFrame | bytes | None) -> DataFrame:
    """Row filter before any aggregation: ids as a DataFrame, a bitmap, or None for all rows."""
    if alive is None:
        return df
    if isinstance(alive, (bytes, bytearray)):
        return df.where(is_alive(F.lit(bytes(alive)), F.col("row_id")))
    return df.join(alive.select("row_id"), "row_id", "left_semi")


def _score() -> Column:
    return F.round(F.sum(F.col("weight").cast("double") * F.col("qw").cast("double")), SCORE_DIGITS).alias("score")


def _matches(postings: DataFrame, query: Query) -> DataFrame:
    q, dims = _query_frame(postings, query)
    if dims is not None:
        # The list of dims prunes row groups in the scan; the frame has at most MAX_LITERAL_DIMS rows.
        return postings.where(F.col("dim_id").isin(dims)).join(F.broadcast(q), "dim_id")
    return postings.join(broadcast_if_small(q), "dim_id")


def scores(postings: DataFrame, query: Query, alive: DataFrame | bytes | None = None) -> DataFrame:
    """Score of every row that shares a dim with the query."""
    return keep_alive(_matches(postings, query), alive).groupBy("row_id").agg(_score())


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """k best rows (fewer if there are fewer; none for k = 0)."""
    return scored.orderBy(F.desc_nulls_last("score"), "row_id").limit(max(0, k))


def search(postings: DataFrame, query: Query, k: int, alive: DataFrame | bytes | None = None) -> DataFrame:
    """Top k rows with a positive score. An empty query or k = 0 gives no rows."""
    return top_k(scores(postings, query, alive).where(F.col("score") > 0), k)


def brute_force(postings: DataFrame, query: Query, k: int, alive: DataFrame | bytes | None = None, all_rows: DataFrame | None = None) -> DataFrame:
    """Top k without the sign filter; with ``all_rows(row_id)`` the rows without overlap take part at score 0."""
    scored = scores(postings, query, alive)
    if all_rows is not None:
        rows = keep_alive(all_rows.select("row_id").distinct(), alive)
        scored = rows.join(scored, "row_id", "left").select("row_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return top_k(scored, k)


def search_batch(postings: DataFrame, queries: DataFrame, k: int, alive: DataFrame | bytes | None = None, positive: bool = True) -> DataFrame:
    """``queries(query_id, dim_id, qw)`` -> ``(query_id, row_id, score, rank)``; the rank filter is a group limit below the shuffle."""
    matched = keep_alive(postings.join(broadcast_if_small(queries), "dim_id"), alive)
    scored = matched.groupBy("query_id", "row_id").agg(_score())
    if positive:
        scored = scored.where(F.col("score") > 0)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def combine_top_k(parts: list[DataFrame], k: int) -> DataFrame:
    """Top k of partial results with disjoint rows (one per segment)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top_k(out, k)


def search_pruned(postings: DataFrame, query: Mapping[int, float], k: int, alive: DataFrame | bytes | None = None, stats: DataFrame | None = None, least_saved: int = PRUNE_POSTINGS) -> DataFrame:
    """Same result as ``search`` with bound pruning by ``stats(dim_id, n, min_w, max_w)``, upper bounds of each list (an extended index
    stores them; at most the query's dims are read).

    The k-th weight of the list with the greatest bound bounds the k-th score from below; lists whose bounds cannot reach it together only
    score the rows that another list has found, so that rows of theirs alone never move. That takes a job of its own: it is left out where
    no such choice of lists could spare ``least_saved`` postings, where a weight is negative, and without stats.
    """
    if stats is None or k <= 0 or not query or min(query.values()) < 0:
        return search(postings, query, k, alive)
    lists = {r["dim_id"]: r for r in stats.where(F.col("dim_id").isin([int(d) for d in query])).collect()}
    if not lists or min(r["min_w"] for r in lists.values()) < 0:
        return search(postings, query, k, alive)
    bounds = {d: float(r["max_w"]) * float(query[d]) for d, r in lists.items()}
    order = sorted(bounds, key=lambda d: (bounds[d], d))
    if sum(lists[d]["n"] for d in order[:-1]) < least_saved:
        return search(postings, query, k, alive)
    best = keep_alive(postings.where(F.col("dim_id") == order[-1]), alive).orderBy(F.desc("weight"), "row_id").limit(k)
    weakest = best.agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("w")).first()
    floor = float(weakest["w"]) * float(query[order[-1]]) * (1 - 1e-6) if weakest["n"] == k else 0.0
    total, rest = 0.0, []
    for d in order:
        total += bounds[d]
        if total >= floor:
            break
        rest.append(d)
    if sum(lists[d]["n"] for d in rest) < max(least_saved, 1):
        return search(postings, query, k, alive)
    live = keep_alive(postings, alive)
    essential = live.where(F.col("dim_id").isin([d for d in order if d not in rest]))
    late = live.where(F.col("dim_id").isin(rest)).join(essential.select("row_id").distinct(), "row_id", "left_semi")
    return search(essential.unionByName(late), query, k)


def pair_scores(postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Dot products of ``pairs(row_a, row_b)``; pairs without a common dim are absent."""
    a = pairs.join(postings.select(F.col("row_id").alias("row_a"), "dim_id", F.col("weight").alias("weight")), "row_a")
    b = postings.select(F.col("row_id").alias("row_b"), "dim_id", F.col("weight").alias("qw"))
    return a.join(b, ["row_b", "dim_id"]).groupBy("row_a", "row_b").agg(_score())
