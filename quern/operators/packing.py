"""Greedy packing of an ordered table into batches of bounded size, without a task that sees the whole order.

What a loop does item by item is here a few sorts: prefix sums tell where the batch that begins at an item would end, so
every item knows the start of the batch after its own; doubling these pointers marks the true starts from the first item
on, in as many rounds as the logarithm of the number of batches; counting the marks numbers the batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators.graph import materialised


def running(df: DataFrame, order: list[Column], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with running values in an order: name -> ('sum' or 'max', column). Ties of the order are given any order.

    Rows are range-partitioned, kept, and run inside their partitions; what comes from the partitions before is a table
    of one row each.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = {f"__v_{n}": c for n, (_, c) in values.items()}
    placed = df.select("*", *[c.alias(n) for n, c in named.items()]).repartitionByRange(parts, *order)
    placed = materialised(placed.withColumn("__part", F.spark_partition_id()))
    whole = {n: (F.sum if how == "sum" else F.max) for n, (how, _) in values.items()}
    ends = placed.groupBy("__part").agg(*[agg(f"__v_{n}").alias(f"__e_{n}") for n, agg in whole.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    carry = ends.select(F.col("__part").alias("__of"), *[agg(f"__e_{n}").over(before).alias(f"__c_{n}") for n, agg in whole.items()])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = placed.select("*", *[agg(f"__v_{n}").over(inside).alias(f"__r_{n}") for n, agg in whole.items()])
    rows = rows.join(F.broadcast(carry), F.col("__part") == F.col("__of"))
    out = []
    for n, (how, _) in values.items():
        own, prior = F.col(f"__r_{n}"), F.col(f"__c_{n}")
        both = F.coalesce(own, F.lit(0)) + F.coalesce(prior, F.lit(0)) if how == "sum" else F.greatest(own, prior)
        out.append(both.alias(n))
    return rows.select(*df.columns, *out)


def batches(items: DataFrame, order: list[str], size: str = "size", most: int = 100_000, each: int = 8191) -> DataFrame:
    """items with `batch`, from 0: the next item joins the open batch while their sizes stay within `most`, else it opens
    another. Items larger than `each` have no batch and do not close one; nor do null sizes. `order` must be total.
    """
    fits = F.coalesce(F.col(size) <= each, F.lit(False))
    one = F.when(fits, 1).otherwise(0)
    rows = running(items.withColumn("__fits", fits), [F.col(c) for c in order], {"__i": ("sum", one.cast("long")), "__p": ("sum", F.when(fits, F.col(size)).otherwise(0).cast("long"))})
    rows = materialised(rows)
    seq = rows.where("__fits").select(F.col("__i").alias("i"), F.col(size).cast("long").alias("n"), F.col("__p").alias("p"))
    # after = the start of the batch that follows one that begins at i: the place after the last p within its reach
    ends = seq.select(F.col("p").alias("at"), F.lit(0).alias("asks"), "i")
    reach = seq.select((F.col("p") - F.col("n") + most).alias("at"), F.lit(1).alias("asks"), "i")
    met = running(ends.union(reach), [F.col("at"), F.col("asks")], {"last": ("max", F.when(F.col("asks") == 0, F.col("i")))})
    jump = met.where("asks = 1").select("i", (F.greatest("last", "i") + 1).alias("after"))
    total = seq.agg(F.max("i")).first()[0]
    if total is None:
        return items.withColumn("batch", F.lit(None).cast("long"))
    jump = materialised(jump.where(F.col("after") <= total))
    starts = items.sparkSession.createDataFrame([(1,)], "i long")
    while not jump.isEmpty():
        reached = starts.join(jump, "i").select(F.col("after").alias("i"))
        starts = materialised(starts.union(reached))
        second = jump.select(F.col("i").alias("after"), F.col("after").alias("then"))
        jump = materialised(jump.join(second, "after").select("i", F.col("then").alias("after")))
    marked = rows.join(starts.select(F.col("i").alias("__i"), F.lit(1).alias("__start"), F.lit(True).alias("__fits")), ["__i", "__fits"], "left")
    done = running(marked, [F.col(c) for c in order], {"__k": ("sum", F.coalesce("__start", F.lit(0)).cast("long"))})
    return done.select(*items.columns, F.when(F.col("__fits"), F.col("__k") - 1).alias("batch"))
