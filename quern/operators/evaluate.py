"""Evaluation of rankings: recall at k, mean reciprocal rank, median rank, spread of scores.

Graded hits have query_id, rank (from 1), score and hit (whether the hit is one that was looked for).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def graded(hits: DataFrame, wanted: DataFrame, found: DataFrame) -> DataFrame:
    """hits (query_id, id, ...) with `hit`: whether the label of id (found: id, label) is the query's (wanted: query_id, label)."""
    rows = hits.join(found.select("id", F.col("label").alias("__found")), "id")
    rows = rows.join(wanted.select("query_id", F.col("label").alias("__wanted")), "query_id")
    return rows.withColumn("hit", F.col("__found") == F.col("__wanted")).drop("__found", "__wanted")


def first_hits(rows: DataFrame) -> DataFrame:
    """(query_id, first): the rank of each query's first hit, null without one."""
    return rows.groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))


def recall(first: DataFrame, queries: int, ks: list[int]) -> DataFrame:
    """(k, hits, n, recall): how many of all queries have a hit within the first k."""
    at = first.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).groupBy("k").agg(F.sum((F.col("first") <= F.col("k")).cast("long")).alias("hits"))
    return at.select("k", "hits", F.lit(queries).cast("long").alias("n"), F.round(F.col("hits") / F.lit(queries), 6).alias("recall"))


def reciprocal_rank(first: DataFrame) -> DataFrame:
    """(n, mrr, first_hits): queries, their mean reciprocal rank (0 without a hit), and those whose first hit comes first."""
    mean = F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6)
    return first.agg(F.count(F.lit(1)).alias("n"), mean.alias("mrr"), F.count_if(F.col("first") == 1).alias("first_hits"))


def median_rank(first: DataFrame, missing: int) -> DataFrame:
    """(median, n): the middle element (index n div 2) of the first ranks; queries without a hit rank `missing`.

    Works on the counts of the ranks, of which there are at most `missing`, so no task sees all queries.
    """
    counts = first.groupBy(F.coalesce("first", F.lit(missing)).alias("median")).agg(F.count(F.lit(1)).alias("k"))
    upto = counts.withColumn("upto", F.sum("k").over(Window.orderBy("median"))).withColumn("n", F.sum("k").over(Window.partitionBy()))
    return upto.where(F.col("upto") > F.floor(F.col("n") / 2)).orderBy("median").limit(1).select("median", "n")


def spread(rows: DataFrame) -> DataFrame:
    """(hit, n, mean, most): the scores of hits that were looked for, and of the others."""
    return rows.groupBy("hit").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 5).alias("mean"), F.max("score").alias("most"))
