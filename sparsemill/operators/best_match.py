"""The best other row of each query vector of a large batch, exactly, without the score of every pair that shares a dim.

A dim that half of all rows hold makes queries times rows pairs; nearly all of them score far below the best. Pairs that share a dim with a short
list are few and scored outright, with the rows of greatest weight in the long lists. Their best score is a floor for the query; a row that
shares long lists only can pass it only if one of its products passes that list's share of the floor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparsemill.operators.ingest_log import has_value
from sparsemill.session import broadcast_if_small, checkpoint

#: Lists up to this length meet whole.
LIST_ROWS = 1024
#: Rows of each end of a long list that give the floors.
SEED_ROWS = 16


def _bucket(weight: Column) -> Column:
    """Signed half-octave of a weight; never falls where weights rise."""
    octave = F.least(F.greatest(F.floor(F.log2(F.abs(weight)) * 2).cast("double") + 300, F.lit(1.0)), F.lit(600.0))
    return F.when(weight == 0, F.lit(0)).otherwise((F.signum(weight) * octave).cast("int"))


def _best(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, best)`` over ``pairs(query_id, row_id)``; elements of a row without a value count nothing."""
    product = lambda d, w: F.when(has_value(w), w.cast("double") * F.try_element_at("_query", d.cast("bigint")))
    score = F.aggregate(F.zip_with("indices", "vals", product), F.lit(0.0), lambda total, x: total + F.coalesce(x, F.lit(0.0)))
    entry = F.struct("dim_id", F.col("qw").cast("double").alias("qw"))
    of_query = queries.groupBy("query_id").agg(F.map_from_entries(F.collect_list(entry)).alias("_query"))
    both = pairs.where(F.col("query_id") != F.col("row_id")).join(vectors.select("row_id", "indices", "vals"), "row_id").join(broadcast_if_small(of_query), "query_id")
    return both.groupBy("query_id").agg(F.max(score).alias("best"))


def _marks(queries: DataFrame, lists: DataFrame, floors: DataFrame) -> DataFrame:
    """``(query_id, dim_id, bucket, qw, least)``: where in the long lists a row must have a product above ``least`` to pass the query's floor.

    The floor is shared out over a query's lists by their greatest products, so a floor above their sum leaves nothing. Without a bound
    (infinite weights) every row of the lists stays, with ``least`` null.
    """
    qw = F.col("qw").cast("double")
    bounded = queries.join(broadcast_if_small(lists), "dim_id").withColumn("_most", F.greatest(qw * F.col("max_w"), qw * F.col("min_w"), F.lit(0.0)))
    bounded = bounded.withColumn("_sum", F.sum("_most").over(Window.partitionBy("query_id"))).join(floors, "query_id", "left")
    floor = F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(0.0))
    endless = F.isnan("_sum") | (F.col("_sum") == float("inf"))
    open_ = bounded.where((F.col("_most") > 0) & ((F.col("_sum") > floor) | endless))
    # Rounding of sums must not hide a row, hence a little less than the share.
    share = F.when(~endless, F.try_divide(floor * F.col("_most"), F.col("_sum")) * (1 - 1e-9))
    open_ = open_.withColumn("least", share).withColumn("_at", _bucket(F.try_divide(F.col("least"), qw)))
    low, high = _bucket(F.col("min_w").cast("double")), _bucket(F.col("max_w").cast("double"))
    first = F.when(F.col("least").isNotNull() & (qw > 0), F.greatest(low, "_at")).otherwise(low)
    last = F.when(F.col("least").isNotNull() & (qw < 0), F.least(high, "_at")).otherwise(high)
    found = open_.withColumn("_first", first).withColumn("_last", last).where(F.col("_first") <= F.col("_last"))
    return found.select("query_id", "dim_id", F.explode(F.sequence("_first", "_last")).alias("bucket"), qw.alias("qw"), "least")


def best_matches(vectors: DataFrame, postings: DataFrame, queries: DataFrame, bounds: DataFrame, list_rows: int = LIST_ROWS, seed_rows: int = SEED_ROWS) -> DataFrame:
    """``(query_id, best)``: greatest unrounded score of ``queries(query_id, dim_id, qw)`` with any row of another id, where it is above 0.

    ``vectors(row_id, indices, vals)`` hold unique rows, ``postings`` are theirs; ``bounds(dim_id, row_id, weight)`` hold these postings and
    may hold more (outdated versions), so that lists are measured before the newest versions are known.
    """
    queries = checkpoint(queries)
    own = bounds.join(broadcast_if_small(queries.select("dim_id").distinct()), "dim_id", "left_semi")
    lists = own.groupBy("dim_id").agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("min_w"), F.max("weight").alias("max_w"))
    lists = checkpoint(lists.where(F.col("n") > list_rows).drop("n"))
    known = broadcast_if_small(lists.select("dim_id"))
    long = queries.join(known, "dim_id").where(F.col("qw") != 0).withColumn("side", F.signum("qw"))
    end = Window.partitionBy("dim_id", "side").orderBy(F.desc(F.col("weight") * F.col("side")), "row_id")
    ends = bounds.join(broadcast_if_small(long.select("dim_id", "side").distinct()), "dim_id").withColumn("_n", F.row_number().over(end))
    seeds = long.join(ends.where(F.col("_n") <= seed_rows).select("dim_id", "side", "row_id"), ["dim_id", "side"]).select("query_id", "row_id")
    short = broadcast_if_small(queries.join(known, "dim_id", "left_anti"))
    # Where the other side is not small, postings that cannot match are dropped before they move.
    met = postings.join(known, "dim_id", "left_anti").join(short, "dim_id").select("query_id", "row_id").distinct()
    floors = checkpoint(_best(met.unionByName(seeds), vectors, queries))
    marks = checkpoint(_marks(queries, lists, floors))
    at = postings.withColumn("bucket", _bucket(F.col("weight").cast("double")))
    at = at.join(broadcast_if_small(marks.select("dim_id", "bucket").distinct()), ["dim_id", "bucket"], "left_semi")
    passes = F.col("least").isNull() | (F.col("weight").cast("double") * F.col("qw") > F.col("least"))
    rest = at.join(broadcast_if_small(marks), ["dim_id", "bucket"]).where(passes).select("query_id", "row_id").distinct()
    best = floors.unionByName(_best(rest, vectors, queries)).groupBy("query_id").agg(F.max("best").alias("best"))
    return best.where(F.col("best") > 0)
