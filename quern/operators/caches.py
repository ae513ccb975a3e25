"""Caches as tables: file snapshots, analyses and summaries by content hash, with limits and a time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of the analysis cache (nodes of a file, bytes of a file, days) and of the summary cache (blocks of a file,
#: characters of a summary, bytes of a file's summaries).
NODES, BYTES, DAYS, BLOCKS, CHARS, SUMMARY_BYTES = 1000, 10 << 20, 30, 500, 5000, 1 << 20


def valid_analyses(cache: DataFrame, files: DataFrame, fingerprint: str, days: int = DAYS) -> DataFrame:
    """Cached analyses (path, file_hash, fingerprint, n_nodes, size, analysed) that still hold for files (path, file_hash)."""
    fresh = F.col("analysed") >= F.current_timestamp() - F.make_dt_interval(F.lit(days))
    held = cache.where((F.col("fingerprint") == fingerprint) & (F.col("n_nodes") <= NODES) & (F.col("size") <= BYTES) & fresh)
    return held.join(files.select("path", "file_hash"), ["path", "file_hash"], "left_semi")


def to_analyse(cache: DataFrame, files: DataFrame, fingerprint: str, days: int = DAYS) -> DataFrame:
    return files.join(valid_analyses(cache, files, fingerprint, days).select("path"), "path", "left_anti")


def summary_states(blocks: DataFrame, cache: DataFrame, fingerprint: str) -> DataFrame:
    """blocks (file, file_hash, code_hash, ...) with `summary` and `state`: hit, miss, or stale under another fingerprint.

    Where the cache has file_hash and a file's is unchanged, all its blocks are hits, with a summary or without one.
    """
    c = cache.select(F.col("file").alias("__f"), F.col("code_hash").alias("__h"), F.col("fingerprint").alias("__p"), "summary")
    joined = blocks.join(c, (F.col("file") == F.col("__f")) & (F.col("code_hash") == F.col("__h")), "left")
    state = F.when(F.col("__h").isNull(), "miss").when(F.col("__p") == fingerprint, "hit").otherwise("stale")
    if "file_hash" in cache.columns:
        same = cache.where(F.col("fingerprint") == fingerprint).select(F.col("file").alias("__g"), F.col("file_hash").alias("__fh")).distinct()
        joined = joined.join(same, (F.col("file") == F.col("__g")) & (F.col("file_hash") == F.col("__fh")), "left")
        state = F.when(F.col("__fh").isNotNull(), "hit").otherwise(state)
    joined = joined.withColumn("state", state)
    return joined.withColumn("summary", F.when(F.col("state") == "hit", F.col("summary"))).drop("__f", "__h", "__p", "__g", "__fh")


def storable_summaries(fresh: DataFrame) -> DataFrame:
    """What of fresh summaries (file, code_hash, summary) is kept: at most BLOCKS of a file, by hash, CHARS each, and only of
    files whose summaries take at most SUMMARY_BYTES together."""
    from pyspark.sql.window import Window

    rows = fresh.where(F.char_length("summary") <= CHARS).dropDuplicates(["file", "code_hash"])
    w = Window.partitionBy("file").orderBy("code_hash")
    rows = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= BLOCKS)
    size = rows.groupBy(F.col("file").alias("__f")).agg(F.sum(F.octet_length("summary")).alias("__b")).where(F.col("__b") <= SUMMARY_BYTES)
    return rows.join(size, F.col("file") == F.col("__f"), "left_semi").drop("__n")


def hit_rates(states: DataFrame) -> DataFrame:
    return states.groupBy("file").agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("state") == "hit").alias("hits"),
        F.round(F.avg((F.col("state") == "hit").cast("double")), 6).alias("rate"),
    )


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(kind, project, files, bytes, newest) of the caches below root: root/kind/project/..., without reading the files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    bare = root.rstrip("/").split("://")[-1]
    parts = F.split(F.substring_index("path", bare + "/", -1), "/")
    rows = rows.select(F.get(parts, F.lit(0)).alias("kind"), F.get(parts, F.lit(1)).alias("project"), "length", "modificationTime")
    return rows.groupBy("kind", "project").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest")
    ).orderBy("kind", "project")


def chosen(rows: DataFrame, which: str) -> DataFrame:
    """The caches of an inventory that a request names by number: '1,3-5' or 'all'."""
    from quern.plans.requests import index_ranges

    listed = rows.select("kind", "project").orderBy("kind", "project").collect()  # one row a cache, as shown to the user
    names = [(listed[i - 1].kind, listed[i - 1].project) for i in index_ranges(which, len(listed))]
    return rows.join(rows.sparkSession.createDataFrame(names, "kind string, project string"), ["kind", "project"], "left_semi")


def clear(spark: SparkSession, root: str, which: str) -> list[tuple[str, str, int]]:
    """Removes the caches below root that a request names by number; what was removed: (kind, project, bytes), in order.

    A request outside the list is an error, and then nothing is removed.
    """
    gone = chosen(inventory(spark, root), which).select("kind", "project", "bytes").orderBy("kind", "project").collect()  # as shown to the user
    for kind, project, _ in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{kind}/{project}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return [tuple(r) for r in gone]


def expired(rows: DataFrame, at: str = "accessed", days: int = DAYS) -> DataFrame:
    return rows.where(F.col(at) < F.current_timestamp() - F.make_dt_interval(F.lit(days)))
