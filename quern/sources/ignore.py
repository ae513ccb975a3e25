"""Ignore rules with the semantics of .gitignore: later rules win, `!` takes back, a trailing `/` means folders."""

from __future__ import annotations

import re
from functools import lru_cache

#: Folders that are never scanned (fixed values); hidden folders in which tools keep their caches go by their ending.
DEFAULT_FOLDERS = (
    ".git", ".svn", ".hg", "node_modules", "vendor", "deps", "pkg", "Pods", "dist", "build", "out", "bundle", "coverage",
    ".cache", ".nyc_output", ".*-cache", ".pytest_cache", "__pycache__", "env", "venv", "tmp", "temp",
)


def _translated(glob: str) -> str:
    """A glob as a regular expression: `**` crosses folders, `*` and `?` do not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.+", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif glob[i] == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


@lru_cache(maxsize=4096)
def rule(line: str) -> tuple[str, bool] | None:
    """(regular expression over a relative path, whether it ignores); None for blank lines and comments."""
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    keeps = line.startswith("!")
    line = line[keeps:].removeprefix("\\") if line[keeps:].startswith(("\\#", "\\!")) else line[keeps:]
    folder = line.endswith("/")
    body = line.rstrip("/")
    anchored = "/" in body
    body = body.removeprefix("/")
    if not body:
        return None
    head = "" if anchored else "(?:[^/]+/)*"
    tail = "/.*" if folder else "(?:/.*)?"
    return f"^{head}{_translated(body)}{tail}$", not keeps


def rules(text: str) -> list[tuple[str, bool]]:
    return [r for line in text.splitlines() if (r := rule(line))]


def default_rules(*files: str) -> list[tuple[str, bool]]:
    """The default folders, then the rules of ignore files in order."""
    return rules("\n".join(f"{d}/" for d in DEFAULT_FOLDERS)) + [r for f in files for r in rules(f)]


def ignored(path: str, table: list[tuple[str, bool]]) -> bool:
    """Whether a relative path is ignored; the last rule that matches decides."""
    verdict = False
    for pattern, ignores in table:
        if re.match(pattern, path):
            verdict = ignores
    return verdict


def column(path, table: list[tuple[str, bool]]):
    """The same as a Column predicate: true where the path is ignored."""
    from pyspark.sql import functions as F

    verdict = F.lit(False)
    for pattern, ignores in table:
        verdict = F.when(path.rlike(pattern), ignores).otherwise(verdict)
    return verdict
