"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Character classes of the contracts: white space is 0x20 and 0x09 to 0x0D, a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names, or in local mode (tests) a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quern-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that a lost executor costs no recomputation of its inputs."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Arrow batches of at most `rows` rows for what is executed inside, so that a worker holds few texts at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def code_points(text: Column) -> Column:
    return F.char_length(text).cast("long")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(df: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """A hash of the columns of a row but some. A null counts by its place, which xxhash64 alone passes over."""
    parts = [F.lit(0)]
    for f in df.schema.fields:
        if f.name not in but:
            c = F.col(f"`{f.name}`")
            nested = isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
            parts += [c.isNull(), F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}) if nested else c]
    return F.xxhash64(*parts)


def ranked(df: DataFrame, order: list[Column], within: list[str] | None = None) -> DataFrame:
    """df with `rank` (long, from 1) by `order` inside each `within` group, without gathering a group in one task.

    The rows are range-partitioned, numbered inside their partition, and shifted by the sizes of the
    partitions before it (a table of at most partitions x groups rows). `order` should begin with the
    columns of `within`; df is materialised because a range partitioning must not be drawn twice.
    """
    spark, within = df.sparkSession, within or []
    placed = cut(df.repartitionByRange(partitions(spark), *order).withColumn("__part", F.spark_partition_id()))
    counts = placed.groupBy("__part", *within).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("__part", *within, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    shift = shift.select(*[F.col(c).alias(f"__s_{c}") for c in ["__part", *within]], "__shift")
    local = placed.withColumn("__local", F.row_number().over(Window.partitionBy("__part", *within).orderBy(*order)))
    on = [F.col(c).eqNullSafe(F.col(f"__s_{c}")) for c in ["__part", *within]]
    joined = local.join(shift, on, "left")
    return joined.withColumn("rank", (F.col("__local") + F.col("__shift")).cast("long")).drop(
        "__part", "__local", "__shift", *[f"__s_{c}" for c in ["__part", *within]]
    )


def connected(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, root), root the smallest node of the component.

    Alternating large-star and small-star steps; each is one partial aggregation and one join on the same key,
    so a hub of any degree is split by the adaptive skew join and never gathered. Every round is checkpointed.
    """
    spark = edges.sparkSession
    pairs = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    for _ in range(64):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, both.a == least.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(low, large.a == low.u).select("b", "m", "u")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("u", "m").toDF("a", "b"))
        pairs = cut(small.where("a <> b").distinct())
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle in 64 rounds")
    roots = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def empty_like(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
