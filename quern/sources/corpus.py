"""Scanning a source tree with Spark's file readers: extensions, sizes, ignore rules, hashes."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.ids import content_hash
from quern.operators.chunk import PARSED
from quern.sources import ignore

#: Largest file that is indexed, and that is analysed.
INDEX_BYTES, ANALYSE_BYTES = 1 << 20, 10 << 20
#: Extensions (fixed values): what is indexed, and what is only ever chunked by lines.
EXTENSIONS = (
    "tla js mjs jsx ts vue tsx py rs go c h cpp hpp cs rb java php swift sol kt kts ex exs el html htm md markdown json css rdl"
    " ml mli lua scala toml zig elm ejs erb vb"
).split()
LINE_ONLY = ("vb", "scala", "swift")
LANGUAGES = PARSED | {"rb": "ruby", "php": "php"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column) -> Column:
    ext = extension(path)
    out = F.lit(None).cast("string")
    for e, name in LANGUAGES.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def is_test(path: Column) -> Column:
    return path.rlike(r"\.(test|spec)\.[^/]*$")


def relative(path: Column, root: str) -> Column:
    """A path below root, without scheme and root."""
    bare = root.rstrip("/").split("://")[-1]
    plain = F.regexp_replace(path, r"^\w+:/*(?=/)", "")
    at = F.instr(plain, bare.rstrip("/") + "/")
    return F.when(at > 0, F.substring(plain, at + len(bare) + 1, F.lit(1 << 20))).otherwise(plain)


def refused(root: str) -> bool:
    """Whether a folder is one that nobody means to read as a whole: the root of the file system, or the home folder."""
    bare = root.split("://")[-1].rstrip("/")
    return bare in ("", os.path.expanduser("~").rstrip("/"))


def listing(spark: SparkSession, root: str, most: int | None = None, recursive: bool = True) -> DataFrame:
    """(path, length, modified) of the files below root, without reading them; of a refused folder only itself."""
    if refused(root):
        return spark.createDataFrame([(root, None, None)], "path string, length long, modified timestamp")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    rows = rows.select(relative(F.col("path"), root).alias("path"), "length", F.col("modificationTime").alias("modified"))
    return rows if most is None else rows.orderBy("path").limit(most)


def scan(spark: SparkSession, root: str, rules: list[tuple[str, bool]] | None = None, most_bytes: int = INDEX_BYTES,
         extensions: list[str] | None = None, tests: bool = True) -> DataFrame:
    """(path, text, file_hash, length) of the files that count: the length filter is pushed down to the reader."""
    if refused(root):
        raise ValueError(f"{root} is not indexed as a whole")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = rows.where(F.col("length") <= most_bytes).withColumn("path", relative(F.col("path"), root))
    keep = extension(F.col("path")).isin(extensions or EXTENSIONS) & ~ignore.column(F.col("path"), rules if rules is not None else ignore.default_rules())
    if not tests:
        keep = keep & ~is_test(F.col("path"))
    text = F.decode("content", "utf-8")
    return rows.where(keep).select("path", text.alias("text"), content_hash(text).alias("file_hash"), "length")


def moved(table: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """A table of an index for another workspace: the prefix of its paths rewritten."""
    inside = F.startswith(F.col(column), F.lit(old))
    return table.withColumn(column, F.when(inside, F.concat(F.lit(new), F.substring(F.col(column), len(old) + 1, F.lit(1 << 20)))).otherwise(F.col(column)))
