"""Shaping of results for people: hits by file, tables with wide characters, JSON."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.search import by_file, without_contained


def width(text: str) -> int:
    """Columns of a text on a terminal: wide characters count two, combining ones none."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def padded(text: str, columns: int) -> str:
    return text + " " * max(0, columns - width(text))


def table(rows: list[list[str]]) -> str:
    sizes = [max(width(r[i]) for r in rows) for i in range(len(rows[0]))] if rows else []
    return "\n".join("  ".join(padded(c, n) for c, n in zip(r, sizes, strict=True)).rstrip() for r in rows)


def numbered(text: str, first: int) -> str:
    return "\n".join(f"{i:>4}  {line}" for i, line in enumerate(text.split("\n"), first))


def search_text(hits: DataFrame, query: str, limit: int = 50) -> str:
    """Hits (path, id, start_line, end_line, score, content, highlighted) as text, by file, the best file first.

    Hits whose highlight came out empty are not related and left out. At most `limit` hits reach the driver.
    """
    hits = hits.orderBy(F.desc("score"), "id").limit(limit)
    if "highlighted" in hits.columns:
        hits = hits.where(F.col("highlighted").isNull() | (F.col("highlighted") != ""))
    files, shown = by_file(hits).collect(), {}
    for r in without_contained(hits).orderBy("start_line", "end_line").collect():
        shown.setdefault(r["path"], []).append(r)
    out = [f"Found {sum(len(v) for v in shown.values())} results in {len(files)} files for: {query!r}"]
    for f in files:
        more = f" ({f.removed} duplicates removed)" if f.removed else ""
        out.append(f"\n{f.path}  best {f.top_score:.3f}, mean {f.avg_score:.3f}{more}")
        for r in shown.get(f.path, []):
            body = (r["highlighted"] if "highlighted" in r and r["highlighted"] else None) or numbered(r["content"], r["start_line"])
            out.append(f"L{r['start_line']}-{r['end_line']}  {r['score']:.3f}\n{body}")
    return "\n".join(out)


def search_json(hits: DataFrame, query: str, limit: int = 50) -> str:
    rows = without_contained(hits.orderBy(F.desc("score"), "id").limit(limit)).orderBy(F.desc("score"), "id").collect()
    return json.dumps({"query": query, "total": len(rows), "snippets": [r.asDict(True) for r in rows]}, ensure_ascii=False, default=str)
