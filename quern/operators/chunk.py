"""Chunking of files: packing lines into chunks, and Markdown sections.

The packer is order-dependent and runs per file in Arrow batches; its core is plain Python. Lengths are UTF-16 units.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.parse import Node, parsed

#: Languages whose definitions are found, by extension.
PARSED = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go",
    "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cs": "csharp",
}
#: Sizes in UTF-16 units: least and most of a block, tolerance, least remainder after a split.
LEAST, MOST, TOLERANCE, REMAINDER = 100, 2000, 1.15, 200
#: Characters of files whose chunks a task holds before it hands them on.
HELD = 1 << 20
SCHEMA = (
    "file_path string, identifier string, type string, start_line int, end_line int, content string, segment_hash string,"
    " chunk_source string, parent_chain array<struct<identifier:string,type:string>>, hierarchy_display string"
)


def units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


@dataclass
class Chunk:
    type: str
    start_line: int
    end_line: int
    content: str
    start_char: int | None = None  # set for segments of an oversized line
    identifier: str | None = None
    source: str = "fallback"
    parents: tuple[tuple[str, str], ...] = ()
    display: str | None = None

    def hash(self, path: str) -> str:
        head = self.content.encode("utf-16-le", "surrogatepass")[:200].decode("utf-16-le", "replace")
        places = [self.start_line, self.end_line] + ([] if self.start_char is None else [self.start_char])
        return hashlib.sha256("-".join([path, *map(str, places), str(units(self.content)), head]).encode("utf-8", "replace")).hexdigest()


def pack_lines(lines: list[str], kind: str, first: int = 1, source: str | None = None) -> list[Chunk]:
    """Lines packed into chunks of at most MOST * TOLERANCE units.

    A line beyond that is cut into segments of MOST units. Where the rest of the file would be a small remainder, the
    line numbers of the boundary move up so that the remainder has enough lines, while the text stays as it was packed;
    and after a cut line that had nothing before it, the next chunk counts from that line. Both keep line numbers and
    hashes equal to those of indexes built the same way. Chunks of less than LEAST units are dropped.
    """
    most = int(MOST * TOLERANCE)
    sizes = [units(line) + (i < len(lines) - 1) for i, line in enumerate(lines)]
    after = [0] * (len(lines) + 1)
    for i in range(len(lines) - 1, -1, -1):
        after[i] = after[i + 1] + sizes[i]
    chunks: list[Chunk] = []
    held: list[str] = []
    size, start, i = 0, 0, 0

    def close(last: int) -> None:
        nonlocal held, size, start
        if held and size >= LEAST:
            chunks.append(Chunk(kind, first + start, first + last, "\n".join(held), source=source or "fallback"))
        held, size, start = [], 0, last + 1

    while i < len(lines):
        if sizes[i] > most:
            if held:
                close(i - 1)
            raw = lines[i].encode("utf-16-le", "surrogatepass")
            for at in range(0, len(raw), 2 * MOST):
                part = raw[at : at + 2 * MOST].decode("utf-16-le", "surrogatepass")
                chunks.append(Chunk(f"{kind}_segment", first + i, first + i, part, at // 2, source=source or "line-segment"))
        elif size and size + sizes[i] > most:
            split = i - 1
            if size >= LEAST and after[i] < REMAINDER and len(held) > 1:
                for k in range(i - 2, start - 1, -1):
                    # +1 where the last of the lines before the split is not the last line of the file
                    before, rest = after[start] - after[k + 1], after[k + 1] + 1
                    if before >= LEAST and rest >= REMAINDER:
                        split = k
                        break
            close(split)
            held.append(lines[i])
            size += sizes[i]
        else:
            held.append(lines[i])
            size += sizes[i]
        i += 1
    if held:
        close(len(lines) - 1)
    return chunks


_ATX, _UNDERLINE = re.compile(r"(#{1,6})\s+(.+)"), re.compile(r"(={3,}|-{3,})\s*")
_PLAIN = re.compile(r"\s*[^#<>!\[\]`\t]+[^\n]")


def headers(lines: list[str]) -> list[tuple[int, int, str]]:
    """(line index, level, text) of the headers of a Markdown text; no notion of code fences."""
    found = []
    for i, line in enumerate(lines):
        if m := _ATX.fullmatch(line):
            found.append((i, len(m[1]), m[2].strip()))
        elif i and (m := _UNDERLINE.fullmatch(line)) and _PLAIN.fullmatch(lines[i - 1]):
            found.append((i - 1, 1 if m[1][0] == "=" else 2, lines[i - 1].strip()))
    return sorted(found, key=lambda h: h[0])


def sections(lines: list[str]) -> list[Chunk]:
    """Markdown sections before packing: a header's section ends before the next header."""
    found = headers(lines)
    if not found:
        return [Chunk("markdown_content", 1, len(lines), "\n".join(lines), source="markdown")]
    out = []
    if found[0][0] > 0:
        out.append(Chunk("markdown_content", 1, found[0][0], "\n".join(lines[: found[0][0]]), source="markdown"))
    above: list[tuple[int, str]] = []  # the headers that are open, outermost first
    for n, (at, level, text) in enumerate(found):
        end = found[n + 1][0] if n + 1 < len(found) else len(lines)
        parents, want = [], level - 1
        for other, name in reversed(above):
            if other == want:
                parents.insert(0, (name, f"header_{other}"))
                want -= 1
        above = [h for h in above if h[0] < level] + [(level, text)]
        shown = " > ".join(f"{kind} {name}" for name, kind in [*parents, (text, f"header_{level}")])
        body = "\n".join(lines[at:end])
        out.append(Chunk(f"markdown_header_h{level}", at + 1, end, body, None, text, "markdown", tuple(parents), shown))
    return out


def markdown(text: str) -> list[Chunk]:
    out, most = [], MOST * TOLERANCE
    for s in sections(text.split("\n")):
        if units(s.content.strip()) < LEAST:
            continue
        parts = [s]
        lines = s.content.split("\n")
        if units(s.content) > most or any(units(line) > most for line in lines):
            parts = pack_lines(lines, s.type, s.start_line, "markdown")
        for p in parts:
            p.identifier, p.parents, p.display = s.identifier, s.parents, s.display
        out += parts
    return out


def code(path: str, text: str, language: str) -> list[Chunk]:
    """Chunks of a source file by its definitions; packed lines where there are none.

    A definition of a fitting size is a block. A function or method that is too large, or a class without definitions
    in it, is packed by lines; a larger class is left to its members. Blocks inside an earlier kept one are dropped.
    """
    lines, most = text.split("\n"), MOST * TOLERANCE
    nodes = sorted((n for n in parsed(path, text, language).nodes if n.type != "module"), key=lambda n: (n.start, -n.end))
    if not nodes:
        return pack_lines(lines, "fallback_chunk")

    def around(n: Node) -> list[Node]:
        return [o for o in nodes if o is not n and o.start <= n.start and n.end <= o.end]

    out: list[Chunk] = []
    for n in nodes:
        body = lines[n.start - 1 : n.end]
        content = "\n".join(body)
        size = units(content)
        if size < LEAST:
            continue
        parents = tuple((o.name, o.type) for o in around(n))
        shown = " > ".join(f"{kind} {name}" for name, kind in [*parents, (n.name, n.type)])
        if size <= most:
            made = [Chunk(n.type, n.start, n.end, content, source="definition")]
        elif n.type == "class" and any(n in around(o) for o in nodes):
            continue
        else:
            made = pack_lines(body, n.type, n.start, "definition")
        for c in made:
            c.identifier, c.parents, c.display = n.name, parents, shown
        out += made
    stays = contained([(c.start_line, c.end_line, c.content) for c in out])
    return [c for c, ok in zip(out, stays, strict=True) if ok]


def chunk_text(path: str, text: str) -> list[Chunk]:
    """Chunks of a file by its extension: Markdown sections, definitions, else packed lines."""
    ending = path.lower().rsplit(".", 1)[-1]
    if ending in ("md", "markdown"):
        return markdown(text)
    if ending in PARSED:
        return code(path, text, PARSED[ending])
    return pack_lines(text.split("\n"), "fallback_chunk")


def chunks(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """The chunks of files, one row each (SCHEMA); of chunks of one file with equal hashes the first stays."""

    parent = pa.struct([("identifier", pa.string()), ("type", pa.string())])
    kinds = {"int": pa.int32(), "string": pa.string()}
    names, types = zip(*[f.strip().split(" ", 1) for f in re.split(r",(?![^<]*>)", SCHEMA)], strict=True)
    schema = pa.schema([(n, kinds.get(t, pa.list_(parent))) for n, t in zip(names, types, strict=True)])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).mapInArrow(lambda batches: map(made, rows_of(batches)), SCHEMA)


def rows_of(batches: Iterator[pa.RecordBatch], most: int = HELD) -> Iterator[list[tuple]]:
    """Rows of SCHEMA for files (path, text), in lists that end with the file that brings them to `most` characters."""
    rows, held = [], 0
    for batch in batches:
        for path, text in zip(batch.column("path"), batch.column("text"), strict=True):
            path, text = path.as_py(), text.as_py() or ""
            seen = set()
            for c in chunk_text(path, text):
                if (h := c.hash(path)) in seen:
                    continue
                seen.add(h)
                parents = [{"identifier": a, "type": b} for a, b in c.parents]
                rows.append((path, c.identifier, c.type, c.start_line, c.end_line, c.content, h, c.source, parents, c.display))
            held += len(text)
            if rows and held >= most:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def section_table(texts: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """(id, n, type, start_line, end_line, identifier, display, content): the sections of Markdown texts before packing,
    numbered from 0; identifier and display (the chain of open headers) are null where no header is. Null counts as empty."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (key, n, s.type, s.start_line, s.end_line, s.identifier, s.display, s.content)
                for key, text in zip(batch["id"], batch["text"], strict=True)
                for n, s in enumerate(sections((text or "").split("\n")))
            ]
            yield pd.DataFrame(rows, columns=["id", "n", "type", "start_line", "end_line", "identifier", "display", "content"])

    schema = f"id {texts.schema[id_col].dataType.simpleString()}, n int, type string, start_line int, end_line int, identifier string, display string, content string"
    return texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(work, schema)


def contained(blocks: list[tuple[int, int, str]]) -> list[bool]:
    """For blocks (start, end, content) in order, whether each stays: not inside an earlier kept block that holds its text."""
    kept: list[tuple[int, int, str]] = []
    out = []
    for start, end, content in blocks:
        stays = not any(s <= start and end <= e and content in text for s, e, text in kept)
        out.append(stays)
        if stays:
            kept.append((start, end, content))
    return out


def batches(sizes: list[int], most: int = 100_000, each: int = 8191) -> list[int | None]:
    """Greedy batches by estimated tokens: the batch number of each item; None for an item that is too large."""
    out: list[int | None] = []
    number, used = 0, 0
    for n in sizes:
        if n > each:
            out.append(None)
            continue
        if used and used + n > most:
            number, used = number + 1, 0
        out.append(number)
        used += n
    return out


def shortened(text: str, most: int = 800) -> str:
    """Whole lines from the start of a text up to `most` characters; a first line beyond that is cut."""
    if len(text) <= most:
        return text
    out, size = [], 0
    for line in text.split("\n"):
        if size + len(line) + bool(out) > most:
            break
        size += len(line) + bool(out)
        out.append(line)
    return "\n".join(out) if out else text[:most]


def retry_sizes(start: int = 800, factor: float = 0.7, least: int = 200, attempts: int = 3) -> list[int]:
    """The lengths to try after an input was too long."""
    sizes, n = [], start
    while len(sizes) < attempts and n >= least:
        sizes.append(n)
        n = int(n * factor)
    return sizes
