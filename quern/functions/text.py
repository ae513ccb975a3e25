"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_.$]+"


def _bare_letters() -> tuple[str, str]:
    """Letters that are a Latin letter with marks, and those letters; the marks themselves come last, without a partner."""
    pairs = []
    for c in map(chr, range(0xC0, 0x2000)):
        head, *marks = unicodedata.normalize("NFD", c)
        if marks and head.isascii() and head.isalpha() and all(map(unicodedata.combining, marks)):
            pairs.append((c, head))
    return "".join(c for c, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(h for _, h in pairs)


MARKED, BARE = _bare_letters()
_FOLDS = str.maketrans(dict(zip(MARKED, BARE, strict=False)) | dict.fromkeys(MARKED[len(BARE) :], None))


def folded(text: Column) -> Column:
    """The text in lower case and without accents, as the lexical index sees it."""
    low = F.lower(text)
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.translate(low, MARKED, BARE))


def folded_str(text: str) -> str:
    return text.lower().translate(_FOLDS)


def tokens(text: Column) -> Column:
    """Lower-case tokens of letters (without accents), digits, `_`, `.` and `$`."""
    return F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.char_length(text) / 4).cast("long")


def embedding_text(path: Column, kind: Column, name: Column, parents: Column, content: Column, prefix: str | None = None) -> Column:
    """What is embedded of a chunk: optional prefix, file, name, chain of named parents, a blank line, the content."""
    named = F.transform(F.filter(parents, lambda p: p["identifier"].isNotNull()), lambda p: F.concat(F.lit("["), p["type"], F.lit("]"), p["identifier"]))
    lines = [
        F.lit(prefix) if prefix else F.lit(None).cast("string"),
        F.concat(F.lit("File: "), path),
        F.when(name.isNotNull() & (name != ""), F.concat(F.lit("Name: ["), kind, F.lit("]"), name)),
        F.when(F.size(named) > 0, F.concat(F.lit("Parent: "), F.array_join(named, "."))),
    ]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"), content)


#: Readable names of syntax node types (fixed values); other types keep their own.
NODE_TYPES = {
    "class_declaration": "class",
    "class_definition": "class",
    "interface_declaration": "interface",
    "interface_definition": "interface",
    "namespace_declaration": "namespace",
    "namespace_definition": "namespace",
    "module_declaration": "module",
    "module_definition": "module",
    "function_declaration": "function",
    "function_definition": "function",
    "method_definition": "method",
    "object_expression": "object",
    "object_pattern": "object",
    "object": "object",
    "pair": "property",
}


def node_type(kind: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in NODE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, kind), kind)


def with_prefix(text: Column, prefix: str) -> Column:
    """The text with a prefix, put once."""
    return F.when(F.startswith(text, F.lit(prefix)), text).otherwise(F.concat(F.lit(prefix), text))


def escape_controls(text: Column) -> Column:
    """C0 controls and DEL in caret notation; tab, line feed and carriage return stay."""
    out = text
    for code in [*range(32), 127]:
        if code not in (9, 10, 13):
            out = F.replace(out, F.lit(chr(code)), F.lit("^" + chr(code ^ 64)))
    return out


def truncated_line(line: Column, most: int = 500) -> Column:
    return F.when(F.char_length(line) > most, F.concat(F.substring(line, 1, most), F.lit(" [truncated...]"))).otherwise(line)


def safe_filename(title: Column) -> Column:
    """Characters that files cannot have become _, white space one blank; at most 200 characters."""
    plain = F.regexp_replace(title, r'[<>:"/\\|?*\x00-\x1F]', "_")
    return F.substring(F.trim(F.regexp_replace(plain, r"\s+", " ")), 1, 200)


def hierarchy_display(parents: Column, kind: Column, name: Column) -> Column:
    """`type ident > type ident`, types by their readable names; null without any part."""
    above = F.transform(F.filter(parents, lambda p: p["identifier"].isNotNull()), lambda p: F.concat_ws(" ", node_type(p["type"]), p["identifier"]))
    own = F.when(name.isNotNull(), F.array(F.concat_ws(" ", node_type(kind), name))).otherwise(F.array().cast("array<string>"))
    whole = F.concat(above, own)
    return F.when(F.size(whole) > 0, F.array_join(whole, " > "))


def is_symbol_line(line: Column) -> Column:
    """Short lines without a letter, digit or underscore."""
    bare = F.trim(line)
    return F.char_length(bare).between(1, 3) & ~bare.rlike(r"[\p{L}\p{N}_]")


def recoverable(message: Column) -> Column:
    """Errors that shortening the input may mend (fixed values)."""
    cues = ["context length", "exceeds", "too long", "input length", "invalid input", "token limit", "failed to get embeddings"]
    return F.lower(message).rlike("|".join(cues))
