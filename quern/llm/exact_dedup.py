"""Exact deduplication with a heavy-hitter split (native).

1. One pass over the texts keeps a narrow table: key, digest of the normalised text, code points.
2. Misra-Gries summaries over hashes of the digests (Spark's frequent-items sketches) are merged in two steps, tasks
   into groups of tasks and those into one, so no task reads more than about the square root of them at large sizes.
   The result names at most 2/support hashes, among them that of every digest held by more than `support` of the rows.
3. Those candidates (a proven broadcast bound) are verified by an exact partial aggregation, which also finds the row
   that stays. The verified ones are broadcast, and their rows are settled where they lie, without a shuffle.
4. The rest, in which no digest holds more than `support` of the rows, is shuffled by digest: a partial aggregation
   finds the row that stays and the group's size, a join brings both to its rows.

Defined results: null text counts as the empty text, and empty texts are equal to one another. Of equal texts stays
the row with the most code points, then the smallest doc_id (null last), then (where whole rows stay) the smallest hash
of all its columns; of wholly repeated rows exactly one stays. An empty table gives an empty result. Other columns are
carried along unchanged whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import cut, partitions, ranked, row_hash

SUPPORT = 0.001


def normalised(text: Column) -> Column:
    """The text without any character of [\\x20\\x09-\\x0D]; null gives ''."""
    out = F.coalesce(text, F.lit(""))
    for c in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def frequent(hashes: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(h): at most 2/support values of the column h (long), among them all that more than `support` of the rows hold.

    With 10/support counters a sketch errs by less than 0.35 support, so such a value's count is at least 0.65 support
    in it, and fewer than 2/support values reach that.
    """
    counters, most = math.ceil(10 / support), math.ceil(2 / support)
    group = F.pmod(F.spark_partition_id(), F.lit(partitions(hashes.sparkSession)))
    state = F.expr(f"approx_top_k_accumulate(h, {counters})")
    parts = hashes.where("h IS NOT NULL").select("h", group.alias("g")).groupBy("g").agg(state.alias("state"))
    # by a constant, for there is nothing to combine in an empty table
    whole = parts.groupBy(F.lit(0).alias("one")).agg(F.expr(f"approx_top_k_combine(state, {counters})").alias("state"))
    return whole.select(F.explode(F.expr(f"approx_top_k_estimate(state, {most})")).alias("i")).select(F.col("i.item").alias("h"))


def _rank() -> Column:
    """The least of a group is the row that stays."""
    return F.struct(-F.col("__n"), F.col("__id").isNull(), F.col("__id"))


def _best(rows: DataFrame) -> DataFrame:
    return rows.groupBy("__digest").agg(F.count(F.lit(1)).alias("__rows"), F.min(_rank()).alias("__best"))


def heavy_digests(keys: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(__digest, __rows, __best) of the digests that the summary names and that several rows hold; at most 2/support."""
    hashed = keys.withColumn("h", F.xxhash64("__digest"))
    found = cut(frequent(hashed.select("h"), support))
    return _best(hashed.join(F.broadcast(found), "h", "left_semi")).where(F.col("__rows") > 1)


def _keys(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("__id"),
        digest(F.col(text_col)).alias("__digest"),
        F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("__n"),
        *more,
    )


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of docs: __id, __digest (binary), __keep, __rows (group size), __kept."""
    keys = cut(_keys(docs, id_col, text_col))
    heavy = F.broadcast(cut(heavy_digests(keys, support)))
    light = keys.join(heavy.select("__digest"), "__digest", "left_anti")
    settled = keys.join(heavy, "__digest").unionByName(light.join(_best(light), "__digest"))
    settled = cut(settled.withColumn("__first", _rank() == F.col("__best")).drop("__n"))
    out = settled.withColumn("__kept", F.col("__first"))
    first = settled.where("__first")
    if not first.groupBy("__digest").count().where("count > 1").isEmpty():
        # wholly repeated rows tie; which of them is called kept is the same, so numbers may be drawn in many tasks
        drawn = ranked(first.withColumn("__any", F.rand(7)), [F.col("__digest"), F.col("__any")], ["__digest"])
        drawn = drawn.withColumn("__kept", F.col("rank") == 1)
        out = out.where("not __first").unionByName(drawn.select(*out.columns))
    return out.select("__id", "__digest", F.col("__best.__id").alias("__keep"), "__rows", "__kept")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of docs that stay, with the columns of docs."""
    cols = docs.columns
    heavy = F.broadcast(cut(heavy_digests(cut(_keys(docs, id_col, text_col)), support)))
    row = F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row")
    full = _keys(docs, id_col, text_col, row, row_hash(docs).alias("__hash"))
    tied = full.join(heavy, "__digest").where(_rank() == F.col("__best"))
    light = full.join(heavy.select("__digest"), "__digest", "left_anti")
    # the first of each group is found in each task before anything is shuffled
    w = Window.partitionBy("__digest").orderBy(F.col("__n").desc(), F.col("__id").asc_nulls_last(), "__hash")
    one = tied.select(*full.columns).unionByName(light.select(*full.columns)).withColumn("__rn", F.row_number().over(w))
    return one.where("__rn = 1").select("__row.*")


def report(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    return groups(docs, support=support).select(
        F.col("__id").alias("doc_id"),
        F.col("__keep").alias("keep_id"),
        F.col("__rows").cast("long").alias("group_size"),
        F.col("__kept").alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )
