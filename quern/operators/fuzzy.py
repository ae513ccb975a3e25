"""Fuzzy path search by the best alignment: the query as a subsequence of a path, placed where it scores most.

Each matched character scores `MATCH`, more at the start of a part of the path (`START`) and right after the character
matched before (`NEXT`); characters skipped between two matches cost `OPEN` for the first and `EXTEND` for each further
one. Two rows of a table over the path hold the best score with the last match at a place and the best with a gap open
there, so a path costs query times path steps. A mask of the characters of each path, which can be stored with it,
drops most paths inside the JVM before any of that.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH, START, NEXT, OPEN, EXTEND = 16, 8, 4, 3, 1
BREAKS = "/._- "
NEVER = -(10**9)


def mask(text: Column) -> Column:
    """A bit for each residue mod 64 of the code points of a lower-case text."""
    codes = F.transform(F.filter(F.split(F.lower(text), ""), lambda c: c != ""), lambda c: F.ascii(c) % 64)
    return F.aggregate(F.array_distinct(codes), F.lit(0).cast("long"), lambda m, b: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))


def masked(paths: DataFrame) -> DataFrame:
    """paths (path, ...) with their `mask`."""
    return paths.withColumn("mask", mask(F.col("path")))


def alignment(query: str, path: str) -> int | None:
    """The score of the best alignment; None if the query is no subsequence of the path."""
    low = path.lower()
    best: list[int] = []
    for k, c in enumerate(query.lower()):
        row, gap = [], NEVER
        for i, d in enumerate(low):
            if k and i > 1:  # a gap before i: open after the match two places back, or longer by one
                gap = max(gap - EXTEND, best[i - 2] - OPEN)
            if d != c:
                row.append(NEVER)
                continue
            own = MATCH + (START if i == 0 or low[i - 1] in BREAKS else 0)
            before = max(gap, best[i - 1] + NEXT if i else NEVER) if k else 0
            row.append(before + own if before > NEVER // 2 else NEVER)
        best = row
    top = max(best, default=0 if not query else NEVER)
    return top if top > NEVER // 2 else None


def best_paths(paths: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(path, kind, score): files and their ancestor folders in which the query can be aligned, best first; ties go to
    the shorter path. Paths with a stored `mask` are filtered by it."""
    rows = paths if "mask" in paths.columns else masked(paths)
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    # a folder's characters are among those of its files, so files that cannot match are dropped before folders are made
    wanted = mask(F.lit(query))
    held = rows.where((F.col("mask").bitwiseAND(wanted) == wanted) if query else F.lit(True)).select("path").distinct()
    folders = held.where(F.instr("path", "/") > 0).select(F.explode(above).alias("path")).where("path <> ''").distinct()
    every = held.withColumn("kind", F.lit("file")).unionByName(folders.withColumn("kind", F.lit("folder")))
    score = F.pandas_udf(lambda s: pd.Series([alignment(query, p) for p in s], dtype="Int64"), "long")
    found = every.withColumn("score", score("path")).where(F.col("score").isNotNull())
    return found.orderBy(F.desc("score"), F.length("path"), "path", "kind").limit(limit)
