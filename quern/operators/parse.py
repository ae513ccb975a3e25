"""Definitions, imports and calls of source files, and outlines of them.

Python is parsed with its own grammar (ast). Languages with braces go through a small lexer: strings and comments are
blanked out, then headers before a brace are read as classes or functions, and names before parentheses as calls. It
knows no types and no macros; that is its fidelity. Everything runs per file in Arrow batches.
"""

from __future__ import annotations

import ast
import bisect
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = "kind string, id string, name string, component_type string, path string, start_line int, end_line int, parameters array<string>, callee string, call_line int, language string"
#: Callables of a language that are not worth an edge. A language that is not here filters nothing.
BUILTINS = {
    "python": """
        print input open str int float bool list dict tuple set frozenset bytes bytearray complex bin oct hex range
        enumerate zip reversed sorted filter map len max min sum abs round pow divmod isinstance issubclass hasattr
        getattr setattr delattr type callable dir vars id hash repr ascii next iter any all chr ord format eval exec
        compile staticmethod classmethod property super object slice help
    """,
    "javascript": """
        setTimeout setInterval clearTimeout clearInterval setImmediate clearImmediate queueMicrotask parseInt parseFloat
        isNaN isFinite String Number Boolean BigInt Symbol encodeURI decodeURI encodeURIComponent decodeURIComponent
        btoa atob eval fetch alert confirm prompt requestAnimationFrame cancelAnimationFrame requestIdleCallback
        cancelIdleCallback Array Object Map Set WeakMap WeakSet Promise Proxy Reflect Error TypeError RangeError
        SyntaxError Date RegExp require console.log console.error console.warn console.info console.debug console.trace
        console.table console.time console.timeEnd console.assert JSON.parse JSON.stringify Math.abs Math.floor
        Math.ceil Math.round Math.trunc Math.max Math.min Math.random Math.sqrt Math.pow Object.keys Object.values
        Object.entries Object.assign Object.fromEntries Object.create Object.freeze Array.from Array.isArray Array.of
        Promise.resolve Promise.reject Promise.all Promise.race Promise.allSettled Promise.any Number.isNaN
        Number.isFinite Number.isInteger Number.parseFloat Number.parseInt
    """,
    "go": "append cap close copy delete len make new panic print println recover",
    "c": """
        printf scanf sprintf sscanf fprintf fscanf malloc calloc realloc free strlen strcpy strncpy strcmp strcat strncat
        memcpy memmove memcmp memset assert exit abort atoi atof atol pow sqrt sin cos tan abs
    """,
}
BUILTINS = {language: frozenset(names.split()) for language, names in BUILTINS.items()}
BUILTINS["typescript"] = BUILTINS["javascript"]
#: Receivers that stand for the object of the method itself.
OWN = ("self.", "this.")


@dataclass
class Node:
    id: str
    name: str
    type: str
    start: int
    end: int
    parameters: list[str] = field(default_factory=list)


@dataclass
class Parsed:
    nodes: list[Node]
    calls: list[tuple[str, str, int]]  # caller, callee, line
    imports: dict[str, str]


def module_of(path: str) -> str:
    return re.sub(r"\.[^./]+$", "", path)


def resolved_import(path: str, target: str) -> str:
    """A relative import as a module path from the root; others stay."""
    if not target.startswith("."):
        return target
    return posixpath.normpath(posixpath.join(posixpath.dirname(path), target))


def enclosing(nodes: list[Node], line: int) -> Node | None:
    """The smallest node around a line; the first inserted among equals."""
    around = [n for n in nodes if n.start <= line <= n.end]
    return min(around, key=lambda n: n.end - n.start, default=None)


def named(callee: str, imports: dict[str, str], local: dict[str, str]) -> str:
    """A callee by its full id where an import or the same file defines its first part."""
    if callee in local:
        return local[callee]
    head, _, rest = callee.partition(".")
    if callee in imports:
        return imports[callee]
    return f"{imports[head]}.{rest}" if head in imports and rest else callee


def python_file(path: str, text: str) -> Parsed:
    module, nodes, calls, imports = module_of(path), [], [], {}
    found = ast.parse(text)

    def dotted(e: ast.expr) -> str | None:
        if isinstance(e, ast.Name):
            return e.id
        if isinstance(e, ast.Attribute):
            head = dotted(e.value)
            return f"{head}.{e.attr}" if head else e.attr
        return dotted(e.func) if isinstance(e, ast.Call) else None

    def walk(body: list, inside: str | None) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef):
                nodes.append(Node(f"{module}.{node.name}", node.name, "class", node.lineno, node.end_lineno))
                walk(node.body, node.name)
            elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                a = node.args
                names = [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs]]
                kind = "method" if inside else "function"
                nodes.append(Node(".".join(filter(None, (module, inside, node.name))), node.name, kind, node.lineno, node.end_lineno, names))
                walk(node.body, inside)
            elif hasattr(node, "body") and isinstance(node.body, list):
                walk(node.body, inside)

    walk(found.body, None)
    for node in ast.walk(found):
        if isinstance(node, ast.Import):
            for n in node.names:
                imports[n.asname or n.name] = n.name.replace(".", "/")
        elif isinstance(node, ast.ImportFrom):
            base = (node.module or "").replace(".", "/")
            if node.level:
                base = resolved_import(path, "./" + "../" * (node.level - 1) + base)
            for n in node.names:
                imports[n.asname or n.name] = f"{base}.{n.name}"
        elif isinstance(node, ast.Call) and (name := dotted(node.func)):
            calls.append(("", name, node.lineno))
    return Parsed(nodes, calls, imports)


_BLANKED = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_CLASS = re.compile(r"\b(?:class|interface|struct|trait|enum|impl)\s+([A-Za-z_]\w*)[^{};()]*$")
_FUNC = re.compile(r"(?:\b(?:function\*?|func|fn)\s+(?:\([^)]*\)\s*)?)?([A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\s*\(([^()]*)\)[^;{}()=]*$")
_ARROW = re.compile(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]*)?=\s*(?:async\s*)?(?:function\b[^(]*)?\(([^()]*)\)[^;{}]*$")
_CALL = re.compile(r"(?<![\w$.])((?:[A-Za-z_$][\w$]*\s*(?:\.|::)\s*)*[A-Za-z_$][\w$]*!?)\s*\(")
_KEYWORDS = set("if for while switch catch return function func fn new else do try sizeof typeof match loop await super throw case in of".split())
_IMPORTS = [
    re.compile(r"import\s+(?:([\w$]+)\s*,?\s*)?(?:\{([^}]*)\})?(?:\*\s+as\s+([\w$]+))?\s*from\s*['\"]([^'\"]+)['\"]"),
    re.compile(r"(?:const|let|var)\s+(?:([\w$]+)|\{([^}]*)\})()\s*=\s*require\(\s*['\"]([^'\"]+)['\"]"),
]


def blanked(text: str) -> str:
    """The text with comments and strings as blanks; lines and columns stay."""
    return _BLANKED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def brace_file(path: str, text: str) -> Parsed:
    module, plain = module_of(path), blanked(text)
    line_of = [0]
    for m in re.finditer("\n", plain):
        line_of.append(m.end())

    def line(at: int) -> int:
        return bisect.bisect_right(line_of, at)

    nodes, stack, heads = [], [], set()
    start = 0
    for m in re.finditer(r"[{};]", plain):
        if m[0] == "{":
            head = plain[start : m.start()]
            owner = next((n.name for n in reversed(stack) if n and n.type == "class"), None)
            node = None
            if c := _CLASS.search(head):
                node = Node(f"{module}.{c[1]}", c[1], "class", line(start + c.start()), 0)
            elif (c := _ARROW.search(head) or _FUNC.search(head)) and c[1] not in _KEYWORDS:
                names = [re.split(r"[:=\s]", p.strip().lstrip(".&*"))[0] for p in c[2].split(",") if p.strip()]
                node = Node(".".join(filter(None, (module, owner, c[1]))), c[1], "method" if owner else "function", line(start + c.start()), 0, names)
                heads.add((start + c.start(1), c[1]))
            if node:
                nodes.append(node)
            stack.append(node)
        elif m[0] == "}" and stack:
            if node := stack.pop():
                node.end = line(m.start())
        start = m.end()
    last = line(max(0, len(plain) - 1))
    for n in nodes:
        n.end = n.end or last
    calls = []
    for m in _CALL.finditer(plain):
        name = re.sub(r"\s+", "", m[1])
        if name.split(".")[0] not in _KEYWORDS and (m.start(1), name) not in heads:
            calls.append(("", name.replace("::", "."), line(m.start())))
    imports = {}
    for pattern in _IMPORTS:
        for m in pattern.finditer(text):
            target = module_of(resolved_import(path, m[4])) if m[4].startswith(".") else m[4]
            for single in (m[1], m[3]):
                if single:
                    imports[single] = target
            for part in (m[2] or "").split(","):
                names = re.split(r"\s+as\s+|\s*:\s*", part.strip().removeprefix("type "))
                if names[0]:
                    imports[names[-1]] = f"{target}.{names[0]}"
    return Parsed(nodes, calls, imports)


#: Analyzers by language (see operators.analyzers); others are read by their braces.
ANALYZERS = {"python": python_file} | dict.fromkeys(("javascript", "typescript", "go", "rust", "c", "cpp", "java"), brace_file)


def parsed(path: str, text: str, language: str) -> Parsed:
    """Nodes, calls with their callers, and imports of a file; builtin calls are left out.

    A call outside every definition belongs to a node of the file itself, which exists only if there is such a call.
    """
    try:
        p = ANALYZERS.get(language, brace_file)(path, text)
    except SyntaxError:
        return Parsed([], [], {})
    local = {n.name: n.id for n in p.nodes if n.type != "method"}
    known = BUILTINS.get(language, set())
    calls, top = [], False
    for _, callee, at in p.calls:
        if callee in known:
            continue
        node = enclosing(p.nodes, at)
        top = top or node is None
        for own in OWN:
            callee = callee.removeprefix(own)
        calls.append((node.id if node else module_of(path), named(callee, p.imports, local), at))
    if top:
        name = module_of(path)
        p.nodes.append(Node(name, name.rsplit("/", 1)[-1], "module", 1, text.count("\n") + 1))
    return Parsed(p.nodes, calls, p.imports)


def analysed(files: DataFrame) -> DataFrame:
    """Rows of NODE for files (path, text, language): kind `node` for definitions, kind `call` for calls."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.strip().split(" ")[0] for f in NODE.split(", ")]
        for batch in batches:
            rows = []
            for path, text, language in zip(batch["path"], batch["text"], batch["language"], strict=True):
                p = parsed(path, text or "", language)
                rows += [("node", n.id, n.name, n.type, path, n.start, n.end, n.parameters, None, None, language) for n in p.nodes]
                rows += [("call", caller, None, None, path, None, None, None, callee, at, language) for caller, callee, at in p.calls]
            out = pd.DataFrame(rows, columns=names)
            for c in ("start_line", "end_line", "call_line"):
                out[c] = out[c].astype("Int32")
            yield out

    return files.select("path", "text", "language").mapInPandas(work, NODE)


def in_order(definitions: DataFrame) -> DataFrame:
    """definitions (id, path, start_line, end_line) with seq, their order of insertion: by file, then line, the outer first.

    seq is a string that compares in that order, so nothing is numbered and nothing moves; ids of whole numbers are written
    with all their digits, from the least one on, so that they compare as numbers.
    """
    place = F.format_string("%010d%010d", F.col("start_line"), F.lit(2**31 - 1) - F.col("end_line"))
    last = F.col("id")
    if isinstance(definitions.schema["id"].dataType, T.IntegralType):
        last = F.lpad((F.col("id").cast("decimal(20,0)") + F.expr("9223372036854775808BD")).cast("string"), 20, "0")
    return definitions.withColumn("seq", F.concat("path", F.lit("\0"), place, last))


def call_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, seq, name, component_type, path, start_line, end_line) and raw edges (caller, callee, call_line).

    Of definitions of one id the last one counts, at the place of the first (`in_order`), as an insertion into a map does.
    """
    rows = analysed(files)
    one = F.struct("seq", "path", "start_line", "end_line", "name", "component_type")
    nodes = in_order(rows.where("kind = 'node'")).groupBy("id").agg(F.max(one).alias("f"), F.min("seq").alias("seq"))
    vertices = nodes.select("id", "seq", "f.name", "f.component_type", "f.path", "f.start_line", "f.end_line")
    edges = rows.where("kind = 'call'").groupBy(F.col("id").alias("caller"), "callee").agg(F.min("call_line").alias("call_line"))
    return vertices, edges


def outline(path: str, text: str, language: str, least_lines: int = 2) -> list[tuple[int, int, str, str]]:
    """(start, end, type, name) of the definitions of a file with at least `least_lines` lines, in order."""
    p = parsed(path, text, language)
    rows = {(n.start, n.end): (n.start, n.end, n.type, n.name) for n in reversed(p.nodes) if n.type != "module" and n.end - n.start + 1 >= least_lines}
    return sorted(rows.values())


def outline_text(path: str, text: str, language: str) -> str:
    """The outline as text: a title, then `start--end | type name`, a blank line where the type changes."""
    out, before = [f"# {path} ({text.count(chr(10)) + 1} lines)"], None
    for start, end, kind, name in outline(path, text, language):
        if before not in (None, kind):
            out.append("")
        out.append(f"{start}--{end} | {kind} {name}")
        before = kind
    return "\n".join(out)
