"""An inverted index of path segments: which paths have a segment at a position, and which lie beneath a folder.

Positions count from 0 at the root. A folder is a row of segments, so `a/b` never matches `a/bc`. Null paths have no
postings and lie beneath nothing; empty segments and `.` do not count, `..` goes up by one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (position, segment, path), and what else a caller keeps of a path.
POSTINGS = "position int, segment string, file_path string, bucket int"


def parts_of(folder: str) -> list[str]:
    """The segments of a folder; a folder that leads above the root is an error."""
    out: list[str] = []
    for part in folder.replace("\\", "/").split("/"):
        if part == "..":
            if not out:
                raise ValueError(f"above the root: {folder!r}")
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return out


def postings(paths: DataFrame, path_col: str = "file_path") -> DataFrame:
    """(position, segment, and the columns of paths): one row for each segment of each path."""
    segments = F.filter(F.split(path_col, "/"), lambda s: ~s.isin("", "."))
    rows = paths.select(F.posexplode(segments).alias("position", "segment"), *paths.columns)
    return rows.withColumn("position", F.col("position").cast("int"))


def beneath(found: DataFrame, folders: Iterable[str], path_col: str = "file_path") -> DataFrame:
    """The columns of postings but position and segment, once each, of the paths that lie in one of the folders (or are one).

    Only postings of a segment that a folder names at that place are read (the filter reaches the scan), and a path
    counts for a folder when it has all its segments. The root names nothing, so it is refused here.
    """
    wanted = sorted({tuple(parts_of(f)) for f in folders})
    if () in wanted:
        raise ValueError("the root holds every path")
    keep = [c for c in found.columns if c not in ("position", "segment")]
    if not wanted:
        return found.select(*keep).limit(0)
    named = sorted({(i, s) for parts in wanted for i, s in enumerate(parts)})
    at = F.concat_ws("/", "position", "segment")
    rows = found.where(F.col("segment").isin([s for _, s in named]) & at.isin([f"{i}/{s}" for i, s in named]))
    mine = rows.groupBy(*keep).agg(F.collect_set(at).alias("have"))  # at most one entry a position
    holds = [F.forall(F.array(*[F.lit(f"{i}/{s}") for i, s in enumerate(parts)]), lambda x: F.array_contains("have", x)) for parts in wanted]
    return mine.where(F.exists(F.array(*holds), lambda x: x)).select(*keep)
