"""Incremental indexing: comparing snapshots by content hash, and batches of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, old_hash, new_hash, status: new, changed, unchanged, deleted) from two tables (path, file_hash)."""
    a = before.select("path", F.col("file_hash").alias("old_hash"))
    b = now.select("path", F.col("file_hash").alias("new_hash"))
    status = (
        F.when(F.col("old_hash").isNull(), "new")
        .when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged")
        .otherwise("changed")
    )
    return a.join(b, "path", "full_outer").withColumn("status", status)


def stale(indexed: DataFrame, present: DataFrame) -> DataFrame:
    """Indexed paths that are no longer there."""
    return indexed.select("path").distinct().join(present.select("path"), "path", "left_anti")


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The newest row of each key: an upsert of batches."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def applied(chunks: DataFrame, changes: DataFrame, fresh: DataFrame, path_col: str = "file_path") -> DataFrame:
    """chunks after a batch of changes (path, type): rows of changed and deleted files go, fresh ones come; atomic per file."""
    touched = changes.select(F.col("path").alias(path_col)).distinct()
    live = changes.where("type <> 'delete'").select(F.col("path").alias(path_col)).distinct()
    return chunks.join(touched, path_col, "left_anti").unionByName(fresh.join(live, path_col, "left_semi"))
