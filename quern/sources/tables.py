"""The driver's tables, and how they stand in for a corpus."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def snapshot(spark: SparkSession, sf_dir: str, table: str) -> tuple:
    """What a table consists of now: its files with their lengths and times. Another snapshot is another table."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(sf_dir, f"{table}.parquet"))
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, folders = [], [at]
    while folders:
        for s in files.listStatus(folders.pop()):
            if s.isDirectory():
                folders.append(s.getPath())
            else:
                found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return tuple(sorted(found))


def document_path() -> Column:
    """A document as a file: source/lang/doc_id.md."""
    return F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores; a no-op for any input that is not a few small files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
