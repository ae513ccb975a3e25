"""Search requests: validation, budgets, path filters and query strings, compiled on the driver."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Defaults and caps of a request.
DEFAULT_LIMIT, MAX_LIMIT, DEFAULT_MIN_SCORE = 20, 50, 0.4


def _number(x) -> float | None:
    if isinstance(x, bool) or not isinstance(x, int | float) or not math.isfinite(x):
        return None
    return float(x)


def valid_limit(x) -> int:
    """A whole number of hits from 1 to MAX_LIMIT; anything that is no number of at least 1 gives the default."""
    n = _number(x)
    return DEFAULT_LIMIT if n is None or n < 1 else min(int(n), MAX_LIMIT)


def valid_min_score(x) -> float:
    n = _number(x)
    return DEFAULT_MIN_SCORE if n is None else min(1.0, max(0.0, n))


def effective_min_score(user=None, model=None) -> float:
    """The user's threshold, else the model's, else the default."""
    return next((valid_min_score(x) for x in (user, model) if _number(x) is not None), DEFAULT_MIN_SCORE)


def leg_budgets(limit: int, dense_weight: float = 1.0, sparse_weight: float = 0.3) -> tuple[int, int]:
    """How many hits each leg of a hybrid search contributes."""
    total = dense_weight + sparse_weight
    return tuple(max(1, math.ceil(2 * limit * w / total)) for w in (dense_weight, sparse_weight))


def split_filters(text: str | None) -> list[str]:
    """A comma list with braces: commas inside braces do not split; a leading = of the option is dropped."""
    parts, depth, current = [], 0, ""
    for c in (text or "").removeprefix("="):
        depth += (c == "{") - (c == "}")
        if c == "," and depth <= 0:
            parts.append(current)
            current = ""
        else:
            current += c
    return [p for p in map(str.strip, [*parts, current]) if p]


def expand_braces(pattern: str) -> list[str]:
    """The alternatives of a pattern: its first group of braces that closes is spread out, then what comes of it.

    Empty options are dropped; a group that has no other option stands for itself, and ends the expansion.
    """
    waiting, done = [pattern], []
    while waiting:
        p = waiting.pop(0)
        opens = [i for i, c in enumerate(p) if c == "{" and p[i + 1 : i + 2] != "}"]
        start = opens[0] if opens else -1
        close = p.find("}", start) if opens else -1
        if close < 0:
            done.append(p)
            continue
        options = [x.strip() for x in p[start + 1 : close].split(",") if x.strip()]
        if not options:
            done.append(p)
            continue
        waiting[:0] = [p[:start] + x + p[close + 1 :] for x in options]
    return done


def literals(pattern: str) -> list[str]:
    """The parts of a glob that must occur in a path."""
    return [p for p in re.split(r"\*+", pattern) if p not in ("", "/", "\\") and "[" not in p and "]" not in p]


@dataclass(frozen=True)
class PathFilter:
    includes: list[list[str]] = field(default_factory=list)
    excludes: list[list[str]] = field(default_factory=list)

    @classmethod
    def compile(cls, patterns: list[str] | None) -> PathFilter:
        groups: dict[bool, list[list[str]]] = {False: [], True: []}
        for pattern in filter(None, patterns or []):
            out = pattern.startswith("!")
            groups[out] += [parts for p in expand_braces(pattern[out:]) if (parts := literals(p))]
        return cls(groups[False], groups[True])

    def column(self, path: Column, include_mode: str = "or") -> Column:
        """The predicate on a path; `include_mode` says whether one include is enough ("or") or all must hold ("and")."""
        low = F.lower(path)

        def all_of(group: list[str]) -> Column:
            return reduce(lambda a, b: a & b, (F.contains(low, F.lit(s.lower())) for s in group))

        keep = F.lit(True)
        if self.includes:
            join = (lambda a, b: a | b) if include_mode == "or" else (lambda a, b: a & b)
            keep = reduce(join, map(all_of, self.includes))
        for group in self.excludes:
            keep = keep & ~all_of(group)
        return keep


@dataclass(frozen=True)
class TextQuery:
    """A lexical query: quoted phrases first, then single terms; every part counts on its own."""

    phrases: list[str]
    terms: list[str]

    @classmethod
    def parse(cls, raw: str | None) -> TextQuery:
        phrases = [m[1].replace('""', '"') for m in re.finditer(r'"((?:[^"]|"")*)"', raw or "")]
        rest = re.sub(r'"(?:[^"]|"")*"', " ", raw or "")
        return cls([p for p in phrases if p.strip()], rest.split())

    def text(self) -> str:
        """The query as one string of parts joined with OR; parts with reserved characters are quoted."""
        quoted = ['"' + p.replace('"', '""') + '"' for p in self.phrases]
        bare = [t if re.fullmatch(r"\w+", t) else '"' + t.replace('"', '""') + '"' for t in self.terms]
        return " OR ".join(quoted + bare)


def glob_regex(pattern: str) -> str:
    """A whole-name glob (* and ?) as a case-insensitive regular expression."""
    return "(?i)^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def file_glob(pattern: str) -> str:
    """A file pattern as a regular expression on a path: * and ? stay within a part, ** crosses parts, [..] and {a,b} as usual.

    A pattern without a slash is matched with the last part, one with a slash with the whole path.
    """
    tokens = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}

    def one(p: str) -> str:
        parts = re.findall(r"\*\*/|\*\*|\*|\?|\[[!^]?\]?[^\]]*\]|.", p, re.S)
        return "".join(tokens.get(x) or ("[" + ("^" if x[1] in "!^" else "") + x[1:-1].lstrip("!^").replace("\\", "\\\\") + "]" if len(x) > 2 and x[0] == "[" else re.escape(x)) for x in parts)

    options = expand_braces(pattern.lstrip("/"))
    start = "^" if "/" in pattern else "(?:^|/)"
    return start + "(?:" + "|".join(map(one, options)) + ")$"


def index_ranges(text: str, n: int) -> list[int]:
    """'1,3-5' or 'all' as sorted indexes from 1 to n; what lies outside is an error."""
    if text.strip().lower() == "all":
        return list(range(1, n + 1))
    found: set[int] = set()
    for part in filter(None, map(str.strip, text.split(","))):
        m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part)
        if not m:
            raise ValueError(f"no index or range: {part!r}")
        a, b = int(m[1]), int(m[2] or m[1])
        if not 1 <= a <= b <= n:
            raise ValueError(f"outside 1..{n}: {part!r}")
        found.update(range(a, b + 1))
    return sorted(found)
