"""Points in ranges of lines: which definition a line lies in, within one file, never across files.

A file of at most PAIRED ranges (nearly every file) pairs its points with its ranges. The lines of the others are the leaves
of a tree of aligned blocks of 4**level lines: a range is cut into the few blocks that cover it exactly, a block keeps
only the best range that covers it, and a point asks the blocks above it, one a level. So the work grows with points
plus ranges, however many of them a file has and however they overlap, and no group is gathered: blocks are
pre-aggregated before they move, and a join key has one block. Both ways give the same rows. Null bounds, null lines,
null files and ranges that end before they start match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a level, levels enough for every line number of an int, and the ranges of a file up to which they are paired.
BITS, LEVELS, PAIRED = 2, 16, 64


def _blocks(ranges: DataFrame) -> DataFrame:
    """ranges with `level` and `block`: the aligned blocks that cover the lines start_line to end_line exactly, each line once."""
    top = f"cast(floor(ln(end_line - cast(start_line as bigint) + 1.5D) / ln({1 << BITS}D)) as int)"
    rows = ranges.withColumn("level", F.explode(F.expr(f"sequence(0, {top})")))
    rows = rows.withColumn("low", F.expr(f"-shiftright(-cast(start_line as bigint), {BITS} * level)"))
    rows = rows.withColumn("high", F.expr(f"shiftright(cast(end_line as bigint) + 1, {BITS} * level)")).where("low < high")
    # what the blocks of the next level take, if the range has any
    rows = rows.withColumn("left", F.expr(f"shiftleft(-shiftright(-low, {BITS}), {BITS})")).withColumn("right", F.expr(f"shiftleft(shiftright(high, {BITS}), {BITS})"))
    side = F.array(*map(F.lit, range((1 << BITS) - 1)))
    before = F.filter(F.transform(side, lambda i: F.col("low") + i), lambda x: x < F.least("left", "high"))
    after = F.filter(F.transform(side, lambda i: F.col("right") + i), lambda x: (F.col("left") <= F.col("right")) & (x < F.col("high")))
    return rows.withColumn("block", F.explode(F.concat(before, after))).drop("low", "high", "left", "right")


def _paired(points: DataFrame, ranges: DataFrame, by: str) -> DataFrame:
    found = points.join(ranges, by).where((F.col("start_line") <= F.col("line")) & (F.col("line") <= F.col("end_line")))
    return found.groupBy(by, "line").agg(F.min("o").alias("b"))


def _asked(points: DataFrame, ranges: DataFrame, by: str) -> DataFrame:
    held = _blocks(ranges).groupBy(by, "level", "block").agg(F.min("o").alias("o"))
    asked = points.where(F.col("line").isNotNull()).distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    asked = asked.withColumn("block", F.expr(f"shiftright(cast(line as bigint), {BITS} * level)"))
    return asked.join(held, [by, "level", "block"]).groupBy(by, "line").agg(F.min("o").alias("b"))


def _best(points: DataFrame, ranges: DataFrame, by: str, order: Column) -> DataFrame:
    """(by, line, b): the least `order` (a struct of a range's columns) of the ranges around each point."""
    points, sound = points.select(by, "line"), ranges.where(F.col("start_line") <= F.col("end_line"))
    many = sound.groupBy(by).count().where(F.col("count") > PAIRED).select(by)
    sound = sound.select(by, "start_line", "end_line", order.alias("o"))
    few = _paired(points.join(many, by, "left_anti"), sound, by)
    return few.unionByName(_asked(points.join(many, by, "left_semi"), sound.join(many, by, "left_semi"), by))


def smallest_around(points: DataFrame, ranges: DataFrame, by: str = "path") -> DataFrame:
    """(by, line, node, span): the range (node, seq, start_line, end_line) around each point (line) with the fewest lines,
    the first inserted among equals; points outside all ranges are left out."""
    found = _best(points, ranges, by, F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "seq", "node"))
    return found.select(by, "line", F.col("b.node").alias("node"), F.col("b.span").alias("span"))


def first_around(points: DataFrame, ranges: DataFrame, by: str = "path") -> DataFrame:
    """(by, line, node): the first inserted range around each point."""
    return _best(points, ranges, by, F.struct("seq", "node")).select(by, "line", F.col("b.node").alias("node"))
