"""Identities as Column expressions: content hashes, segment hashes and version-5 UUIDs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name space of point ids (a fixed value).
NAMESPACE = "f47ac10b-58cc-4372-a567-0e02b2c3d479"


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def segment_hash(path: Column, start: Column, end: Column, content: Column) -> Column:
    parts = [path, start.cast("string"), end.cast("string"), F.char_length(content).cast("string"), F.substring(content, 1, 100)]
    return F.sha2(F.concat_ws("-", *parts), 256)


def line_segment_hash(path: Column, line: Column, start_char: Column, content: Column) -> Column:
    parts = [path, line.cast("string"), line.cast("string"), start_char.cast("string")]
    return F.sha2(F.concat_ws("-", *parts, F.char_length(content).cast("string"), F.substring(content, 1, 100)), 256)


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """The version-5 UUID of a name: sha1 over name space and name, with the version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(F.lower(F.hex(variant.cast("long"))), F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def workspace_id(path: Column) -> Column:
    return F.concat(F.lit("ws-"), F.substring(F.sha2(path, 256), 1, 16))
