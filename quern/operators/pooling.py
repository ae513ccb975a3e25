"""Pooling of vectors by key. Vectors are exploded to components, so that any group is summed by partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.vectors import cosine, l2_normalised


def _gathered(parts: DataFrame) -> DataFrame:
    """(key, pooled) from (key, place, value), L2-normalised."""
    whole = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("c"))
    return whole.select("key", l2_normalised(F.col("c.value")).alias("pooled"))


def _components(rows: DataFrame, key: str, *more: str) -> DataFrame:
    return rows.select(F.col(key).alias("key"), *more, F.posexplode(F.col("embedding").cast("array<double>")).alias("place", "x"))


def mean(rows: DataFrame, key: str) -> DataFrame:
    return _gathered(_components(rows, key).groupBy("key", "place").agg(F.avg("x").alias("value")))


def last(rows: DataFrame, key: str, order: str) -> DataFrame:
    best = rows.groupBy(F.col(key).alias("key")).agg(F.max_by("embedding", order).alias("e"))
    return best.select("key", l2_normalised(F.col("e")).alias("pooled"))


def softmax(rows: DataFrame, key: str, order: str, temperature: float) -> DataFrame:
    """Weights exp(cosine with the key's last vector / temperature), normalised; over the raw vectors."""
    anchors = rows.groupBy(F.col(key).alias("__key")).agg(F.max_by("embedding", order).alias("__last"))
    near = cosine(F.col("embedding"), F.col("__last"))
    weighed = rows.join(anchors, rows[key] == F.col("__key")).withColumn("w", F.exp(near / temperature))
    parts = _components(weighed, key, "w").groupBy("key", "place")
    return _gathered(parts.agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("value")))


def centered(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """(id, centered): each vector without the mean vector of its key."""
    means = _components(rows, key).groupBy("key", "place").agg(F.avg("x").alias("value"))
    means = means.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("c"))
    joined = rows.join(means.select(F.col("key").alias("__key"), F.col("c.value").alias("__mean")), rows[key] == F.col("__key"))
    minus = F.zip_with(F.col("embedding").cast("array<double>"), "__mean", lambda a, b: a - b)
    return joined.select(F.col(id_col).alias("id"), minus.alias("centered"))


def exploded(pooled: DataFrame) -> DataFrame:
    """(key, place, value) with values rounded to 6 places."""
    return pooled.select("key", F.posexplode("pooled").alias("place", "value")).withColumn("value", F.round("value", 6))
