r"""Conversation structure repair by a forward Viterbi pass over four grammar states.

The initials of a repaired conversation's roles read `(s?(ua)+)?`, so the states are: nothing kept yet, after `s`, after
`u`, after `a`; the first and the last accept. Every row is kept (0), given the role user or assistant (2) or deleted
(3); rows without a user's or assistant's turn between them are inserted (2), after each row and before the first, at
most two in a row, because a third leads back. A state carries its least (cost, audit string); at equal costs neither
of two strings begins the other (an insert more costs more), so the least string stays least whatever follows.

Rows are dealt by conversation and sorted by turn, both by Spark, and then read as a stream: a task holds the four
states of one conversation, each with its running digest of the repaired text, and no rows. What all states agree on
leaves the compared strings. A state is dropped once another is so much cheaper that nothing can follow from it.

Defined results: null roles and texts count as one space, and so do null ids and turns in the name that decides the
damage. Rows of a null conv_id form one conversation. Rows of equal turn are ordered by role and text. Roles of any
other initial, an empty one too, fit nowhere and are legal neighbours of nothing. A conversation is one value of the
result (audit and digest are sequential), so it is one task's by contract, in bounded memory but for its audit string;
other conversations do not wait for it. Texts may have any length, other columns are not read, repeated rows are
duplicates, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from quern.llm.common import WORD

#: What an edit costs, and an undeleted truncated row more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States, where a user's or assistant's turn leads from them and its role, and by which initial a row may be kept.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {EMPTY: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
KEEP = {(EMPTY, "s"): SYSTEM, **{(state, role[0]): to for state, (to, role) in NEXT.items()}}
#: Characters of the compared strings after which what they share is put aside.
SHARED = 64


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy) after damage by crc32(`conv_id:turn`) % 20; a dropped row has copy null."""

    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).when(kind != 0, F.array(F.lit(0)))
    named = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    return named.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode_outer(copies).alias("copy"))


def faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, copy), dealt by conversation and in order, with `fault`: b, d, t or empty."""
    order = [F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    dealt = rows.repartition("conv_id").withColumn("digest", F.sha2("text", 256)).withColumn("gone", F.col("copy").isNull())
    nth = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "digest").orderBy(*order))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = (
        F.when(F.col("gone"), "")
        .when(~F.col("text").rlike(WORD), "b")
        .when(F.col("nth") > 1, "d")
        .when(~last.isin(".", "!", "?"), "t")
        .otherwise("")
    )
    marked = dealt.withColumn("nth", nth).select("conv_id", "turn", "role", "text", "copy", fault.alias("fault"))
    return marked.sortWithinPartitions("conv_id", F.col("copy").isNull(), *order)


class Path:
    """The cheapest way into a state: cost, the end of its audit string and the digest of what it has kept."""

    __slots__ = ("audit", "cost", "digest", "rows")

    def __init__(self, cost: int, audit: str, digest, rows: int) -> None:
        self.cost, self.audit, self.digest, self.rows = cost, audit, digest, rows

    def then(self, edit: str, cost: int, role: str | None = None, text: str = "") -> tuple[int, str, Path, str | None, str]:
        return self.cost + cost, self.audit + edit, self, role, text


def _grown(found: tuple) -> Path:
    cost, audit, path, role, text = found
    digest, rows = path.digest, path.rows
    if role is not None:
        digest = digest.copy()
        digest.update((("\n" if rows else "") + role + ":" + text).encode())
        rows += 1
    return Path(cost, audit, digest, rows)


class Repair:
    """The forward pass over the rows of one conversation."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.layer = self._closed({EMPTY: Path(0, "", hashlib.sha256(), 0)})

    def _closed(self, layer: dict[int, Path]) -> dict[int, Path]:
        for _ in range(2):
            found = {}
            for state, path in layer.items():
                to, role = NEXT[state]
                way, now = path.then("I", INSERT, role), layer.get(to)
                if now is None or way[:2] < (now.cost, now.audit):
                    if to not in found or way[:2] < found[to][:2]:
                        found[to] = way
            if not found:
                break
            layer = layer | {to: _grown(way) for to, way in found.items()}
        return layer

    def row(self, role: str, text: str, fault: str) -> None:
        found: dict[int, tuple] = {}

        def offer(to: int, way: tuple) -> None:
            if to not in found or way[:2] < found[to][:2]:
                found[to] = way

        more = TRUNCATED if fault == "t" else 0
        for state, path in self.layer.items():
            offer(state, path.then("D", DELETE))
            if fault not in ("b", "d"):
                to, given = NEXT[state]
                offer(to, path.then("R", REROLE + more, given, text))
                if (to := KEEP.get((state, role[:1]))) is not None:
                    offer(to, path.then("K", more, role, text))
        layer = self._closed({to: _grown(way) for to, way in found.items()})
        best = layer[ASSISTANT].cost
        # from `nothing kept` only a system row (3 less than deleting it) goes further than from `after a`; from
        # `after s` nothing does
        if EMPTY in layer and layer[EMPTY].cost > best + DELETE:
            del layer[EMPTY]
        if SYSTEM in layer and layer[SYSTEM].cost > best:
            del layer[SYSTEM]
        if len(layer[ASSISTANT].audit) > SHARED:
            same = len(os.path.commonprefix([p.audit for p in layer.values()]))
            self.done.append(layer[ASSISTANT].audit[:same])
            for path in layer.values():
                path.audit = path.audit[same:]
        self.layer = layer

    def end(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the cheapest repair."""
        best = min((p for s, p in self.layer.items() if s in (EMPTY, ASSISTANT)), key=lambda p: (p.cost, p.audit))
        return best.cost, "".join(self.done) + best.audit, best.digest.hexdigest()


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 from `faults`.

    A row of copy null only names its conversation.
    """
    kind = rows.schema["conv_id"].dataType
    ids = to_arrow_type(kind)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        schema = pa.schema([("conv_id", ids)] + [(n, pa.int64()) for n in names[:6]] + [(n, pa.string()) for n in names[6:]])
        now, started = None, False

        def close() -> None:
            span = highest - lowest + 1 - turns if turns else 0
            out.append((now, span, count["b"], count["d"], count["t"], illegal, *repair.end()))

        def flush() -> pa.RecordBatch:
            cols = [pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for conv, turn, role, text, copy, fault in zip(*cols, strict=True):
                if not started or conv != now:
                    if started:
                        close()
                        if len(out) >= 1000:
                            yield flush()
                    now, started, repair = conv, True, Repair()
                    count, illegal, before = {"b": 0, "d": 0, "t": 0, "": 0}, 0, None
                    lowest = highest = last = None
                    turns = 0
                if copy is None:
                    continue
                count[fault] += 1
                if before is not None and before + role[:1] not in ("su", "ua", "au"):
                    illegal += 1
                before = role[:1]
                if turn is not None and turn != last:
                    lowest, highest, last, turns = turn if lowest is None else lowest, turn, turn, turns + 1
                repair.row(role, text, fault)
        if started:
            close()
        if out:
            yield flush()

    longs = ", ".join(f"{n} long" for n in names[:6])
    return rows.select("conv_id", "turn", "role", "text", "copy", "fault").mapInArrow(work, f"conv_id {kind.simpleString()}, {longs}, audit string, repaired_sha256 string")


def report(rows: DataFrame) -> DataFrame:
    """The repairs of all damaged conversations (conv_id, turn, role, text)."""
    return repaired(faults(damaged(rows)))
