"""Operators on lines of texts: grep with context, line scores, kept groups, fuzzy path search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import is_symbol_line, truncated_line


#: How many stretches a search of a tree shows.
MATCHES = 300


def lines_of(texts: DataFrame) -> DataFrame:
    """(id, line_number from 1, line) from (id, text)."""
    parts = texts.select("id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return parts.select("id", (F.col("at") + 1).cast("long").alias("line_number"), "line")


def grep(texts: DataFrame, pattern: str, context: int = 1) -> DataFrame:
    """(id, first_line, last_line, matches, text): matching lines with context, touching stretches merged.

    Works inside each text's own array of lines: no window over exploded lines, so a long text stays in its row and
    texts without a match are dropped before anything is exploded.
    """
    rows = texts.where(F.col("text").rlike("(?m)" + pattern)).select("id", F.split("text", "\n", -1).alias("ls"))
    at = F.filter(F.sequence(F.lit(1), F.size("ls")), lambda i: F.get(F.col("ls"), i - 1).rlike(pattern))
    rows = rows.withColumn("at", at).where(F.size("at") > 0)
    start = F.filter(F.sequence(F.lit(0), F.size("at") - 1), lambda k: (k == 0) | (F.get(F.col("at"), k) - F.get(F.col("at"), k - 1) > 2 * context + 1))
    rows = rows.withColumn("starts", start)
    rows = rows.select("id", "ls", "at", "starts", F.explode(F.sequence(F.lit(0), F.size("starts") - 1)).alias("g"))
    low = F.get("starts", F.col("g"))
    high = F.coalesce(F.get("starts", F.col("g") + 1), F.size("at")) - 1
    rows = rows.select("id", "ls", F.get("at", low).alias("first_match"), F.get("at", high).alias("last_match"), (high - low + 1).cast("long").alias("matches"))
    rows = rows.withColumn("first_line", F.greatest(F.lit(1), F.col("first_match") - context)).withColumn("last_line", F.least(F.size("ls"), F.col("last_match") + context))
    shown = F.transform(F.slice("ls", F.col("first_line"), F.col("last_line") - F.col("first_line") + 1), lambda x: truncated_line(x))
    return rows.select("id", F.col("first_line").cast("long"), F.col("last_line").cast("long"), "matches", F.array_join(shown, "\n").alias("text"))


def scored(lines: DataFrame, terms: list[str]) -> DataFrame:
    """Lines with a lexical score: distinct query terms in the line over all terms; symbol lines count a hundredth."""
    low = F.lower("line")
    hits = sum((F.contains(low, F.lit(t.lower())).cast("double") for t in terms), F.lit(0.0)) / len(terms)
    return lines.withColumn("score", F.when(is_symbol_line(F.col("line")), hits * 0.01).otherwise(hits))


def best_lines(lines: DataFrame, k: int | None = None, least: float | None = None) -> DataFrame:
    """Lines (id, line_number, line, score) that are kept: the k best of each text, or those of at least a score."""
    rows = lines.where(F.col("score") > 0)
    if least is not None:
        rows = rows.where(F.col("score") >= least)
    if k is None:
        return rows
    w = Window.partitionBy("id").orderBy(F.desc("score"), "line_number")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("place")


def without_lonely_symbols(lines: DataFrame) -> DataFrame:
    """Kept lines without symbol lines that have no kept line next to them."""
    w = Window.partitionBy("id").orderBy("line_number")
    near = (F.lag("line_number").over(w) == F.col("line_number") - 1) | (F.lead("line_number").over(w) == F.col("line_number") + 1)
    return lines.withColumn("__near", F.coalesce(near, F.lit(False))).where(F.col("__near") | ~is_symbol_line(F.col("line"))).drop("__near")


def kept_groups(lines: DataFrame) -> DataFrame:
    """(id, groups, text): kept lines as `  12  text`, runs of neighbours apart by ` ---`."""
    rows = lines.where(F.trim("line") != "")
    w = Window.partitionBy("id").orderBy("line_number")
    rows = rows.withColumn("island", F.col("line_number") - F.row_number().over(w))
    number = F.col("line_number").cast("string")
    text = F.concat(F.when(F.length(number) < 4, F.lpad(number, 4, " ")).otherwise(number), F.lit("  "), F.col("line"))
    rows = rows.withColumn("shown", F.struct("line_number", text.alias("t")))
    runs = rows.groupBy("id", "island").agg(F.min("line_number").alias("first"), F.array_sort(F.collect_list("shown")).alias("ls"))
    runs = runs.select("id", F.struct("first", F.array_join(F.col("ls.t"), "\n").alias("t")).alias("run"))
    whole = runs.groupBy("id").agg(F.count(F.lit(1)).alias("groups"), F.array_sort(F.collect_list("run")).alias("runs"))
    return whole.select("id", "groups", F.array_join(F.col("runs.t"), "\n ---\n").alias("text"))


def fuzzy_paths(paths: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(path, kind, score): files and their ancestor folders whose path holds the query as a subsequence, best first.

    Ancestors come from each path's own parts. The score rewards characters that follow one another and the starts of
    path parts; ties go to the shorter path.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = paths.where(F.instr("path", "/") > 0).select(F.explode(above).alias("path")).where("path <> ''").distinct().withColumn("kind", F.lit("folder"))
    rows = paths.select("path").distinct().withColumn("kind", F.lit("file")).unionByName(folders)
    low = F.lower("path")

    def step(s: F.Column, c: F.Column) -> F.Column:
        at = F.call_function("locate", c, low, s["at"] + 1)
        after = F.substring(low, at - 1, F.lit(1)).isin("/", ".", "-", "_")
        bonus = F.when((at == s["at"] + 1) & (s["at"] > 0), 3).when((at == 1) | after, 2).otherwise(1)
        lost = F.struct(F.lit(1 << 30).alias("at"), F.lit(-1).alias("score"))
        return F.when((s["score"] < 0) | (at == 0), lost).otherwise(F.struct(at.alias("at"), (s["score"] + bonus).alias("score")))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("score"))
    score = F.aggregate(F.array(*map(F.lit, query.lower())), start, step, lambda s: s["score"])
    rows = rows.withColumn("score", score).where("score >= 0").select("path", "kind", "score")
    return rows.orderBy(F.desc("score"), F.length("path"), "path").limit(limit)
