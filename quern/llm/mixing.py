"""Mixing sources to target weights by systematic sampling.

Sizes are words. The mix takes `share` of all words; sources, in code-point order with null last, weigh 3, 1, 2,
repeating. No target exceeds `most` times its source's size: the excess is reshared by weight among the others until
none is above. Within a source every document expects target / size copies; documents are ordered by size (then
doc_id), the expected copies are prefix-summed, one random offset of the source is added, and a document is emitted
once for each integer boundary its interval crosses. Ordering by size makes the taken words follow the target closely.

The prefix sum is a distributed rank (see common.ranked), so a source with a third of all rows is spread over many
tasks. Reruns agree: the offset is derived from the seed and the source.

Defined results: null text has size 0; a source of size 0 has target 0; null is a source of its own; repeated rows
count as documents of their own, also those that differ in other columns than id and text; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import cut, partitions, ranked, row_hash, word_count

WEIGHTS = (3, 1, 2)
#: Copies of one row that are given out by one task.
TOGETHER = 1000


def targets(sizes: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target, rate) from (source, source_size): water-filling by weight under a cap."""
    placed = ranked(sizes, [F.col("source").asc_nulls_last()])
    turn = (F.col("rank") - 1) % len(weights)
    table = cut(
        placed.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), turn.cast("int") + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("capped", F.col("source_size") == 0)
    )
    while True:
        free = ~F.col("capped")
        total, spent, w = table.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)),
            F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(free, F.col("w"))), F.lit(0)),
        ).first()
        rest = share * total - spent
        even = F.lit(rest) * F.col("w") / F.lit(float(max(w, 1)))
        over = table.where(free & (even > F.col("cap")))
        if not w or over.isEmpty():
            break
        table = cut(table.withColumn("capped", F.col("capped") | (even > F.col("cap"))))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(even)
    return table.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") == 0, 0.0).otherwise(F.col("target") / F.col("source_size"))
    )


def offset(source: Column, seed: str) -> Column:
    """A number in [0, 1) for each source, from the first 8 hex digits of an md5."""
    text = F.concat(F.lit(seed), F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def copies(
    docs: DataFrame,
    share: float = 1.5,
    most: int = 2,
    weights: tuple[int, ...] = WEIGHTS,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rest: Column | None = None,
) -> DataFrame:
    """(doc_id, source, size, key, source_size, target, copies) for each row of docs; key tells texts of one doc_id apart.

    A column `rest`, if given, comes out too; it orders rows of one source, doc_id and text.
    """
    more = [] if rest is None else [rest.alias("rest")]
    narrow = docs.select(
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("key"),
        *more,
    )
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_last(), F.col("key")]
    order += [F.col("rest")] if more else []
    placed = cut(ranked(narrow, order, ["source"]))
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(sizes, share, most, weights).withColumnRenamed("source", "__source")
    rated = placed.join(aims, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    u = offset(F.col("source"), seed)
    crossed = F.floor(F.col("rank") * F.col("rate") + u) - F.floor((F.col("rank") - 1) * F.col("rate") + u)
    return rated.withColumn("copies", crossed.cast("long")).drop("rank", "rate")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs."""
    return copies(docs, **options).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (0 to `most` times), with the columns of docs."""
    cols = docs.columns
    rest = row_hash(docs, (id_col, text_col, source_col))
    # Rows that are equal in all columns share one decision each time they occur: their copies are summed, and one of
    # the rows, the first that each task sees before anything is shuffled, is given out that often.
    dealt = copies(docs, id_col=id_col, text_col=text_col, source_col=source_col, rest=rest, **options).where("copies > 0")
    dealt = cut(dealt.groupBy(F.struct("doc_id", "source", "key", "rest").alias("__dealt")).agg(F.sum("copies").alias("__copies")))
    key = F.struct(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(F.col(text_col)).alias("key"), rest.alias("rest")
    )
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row"), key.alias("__key"))
    row = row.withColumn("__rn", F.row_number().over(Window.partitionBy("__key").orderBy(F.lit(0)))).where("__rn = 1").drop("__rn")
    taken = row.join(dealt, F.col("__key") == F.col("__dealt"))
    few = taken.where(F.col("__copies") <= TOGETHER).withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    if dealt.where(F.col("__copies") > TOGETHER).isEmpty():
        return few.select("__row.*")
    # a row that is repeated without number is given out by many tasks
    many = taken.where(F.col("__copies") > TOGETHER).withColumn("__at", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1, F.lit(TOGETHER).cast("long"))))
    many = many.withColumn("__any", F.xxhash64("__at")).repartition(partitions(docs.sparkSession), "__any")
    many = many.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(TOGETHER), F.col("__copies") - F.col("__at")))))
    return few.select("__row.*").unionByName(many.select("__row.*"))
