r"""Chat formatting of reply trees.

Messages form trees by their parents. Iterative self-joins with doubling steps enumerate for each leaf all messages up
to its root, in as many rounds as the logarithm of the deepest path; the branches of a tree are ranked by the mean score
of their messages, and the best `branches` of each tree are formatted as one conversation each.

Template: every turn is `<s>[ROLE] role [/ROLE] [INST] text [/INST]</s>` and a newline. A control string inside a role or
text is escaped by one backslash before it, or one more if backslashes stand there already; a control string counts as
such only without a backslash before it, and the template always writes a space between a text and a control string
(roles end in `[/ROLE]` after a space as well), so reading back is exact. The loss mask covers the texts of assistants.

Defined results: a null text or role counts as empty. Rows of equal (conversation, turn) are ordered by role and text
and follow one another. A message whose parent is missing is a root. Of messages with equal (conversation, id) the one
of the least (parent, role, text, score) counts, nulls first; a null score ranks as 0. Parents that run in a circle are
an error. Rows with a null conversation form the conversation null. Other columns are not read. A conversation is one
value of the result, so its turns come together in one task by contract; texts may be of any length that a value may
have. An empty table gives only what the caller adds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import cut

#: Control strings of the template.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"]
_ANY = "|".join(map(re.escape, CONTROLS))
ESCAPE = rf"(\\*)({_ANY})"
_UNESCAPE = re.compile(rf"\\(\\*)({_ANY})")
_TURN = re.compile(
    r"<s>\[ROLE\] (?P<role>(?s:.)*?) \[/ROLE\] \[INST\] (?P<text>(?s:.)*?) \[/INST\]</s>\n(?=<s>|\Z)"
)
LOSS_ROLES = ("assistant",)


def parents(rows: DataFrame) -> DataFrame:
    """Messages (conv, id, parent, role, text, score) of flat conversations: each turn answers the one before it."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    numbered = rows.withColumn("id", F.row_number().over(w))
    return numbered.select(
        F.col("conv_id").alias("conv"),
        "id",
        F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(1.0).alias("score"),
    )


def one_each(messages: DataFrame) -> DataFrame:
    """One message (conv, id, parent, role, text, score) for each (conv, id)."""
    rest = F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return messages.groupBy("conv", "id").agg(F.min(rest).alias("m")).select("conv", "id", "m.*")


def paths(messages: DataFrame) -> DataFrame:
    """(conv, leaf, id, up) for each leaf and each message on its path; up counts steps from the leaf to the message.

    A path cannot have more messages than its conversation: jumps that long mean a circle, and raise ValueError.
    """
    link = cut(messages.select("conv", "id", "parent"))
    most = link.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    known = link.select(F.col("conv").alias("c"), F.col("id").alias("i"))
    up = link.where(F.col("parent").isNotNull()).join(known, F.col("conv").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("i")), "left_semi")
    answered = up.select(F.col("conv").alias("c"), F.col("parent").alias("i")).distinct()
    leaves = link.join(answered, F.col("conv").eqNullSafe(F.col("c")) & (F.col("id") == F.col("i")), "left_anti")
    found = leaves.select("conv", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up"))
    jump = cut(up.select(F.col("conv").alias("jc"), F.col("id").alias("jf"), F.col("parent").alias("jt")))
    step = 1
    while not jump.isEmpty():
        if step >= most:
            raise ValueError("the parents run in a circle")
        more = found.join(jump, F.col("conv").eqNullSafe(F.col("jc")) & (F.col("id") == F.col("jf")))
        found = cut(found.unionByName(more.select("conv", "leaf", F.col("jt").alias("id"), (F.col("up") + step).alias("up"))))
        second = jump.select(F.col("jc").alias("kc"), F.col("jf").alias("kf"), F.col("jt").alias("kt"))
        jump = jump.join(second, F.col("jc").eqNullSafe(F.col("kc")) & (F.col("jt") == F.col("kf")))
        jump = cut(jump.select("jc", "jf", F.col("kt").alias("jt")))
        step *= 2
    return found


def chosen(messages: DataFrame, found: DataFrame, branches: int | None = 1) -> DataFrame:
    """The paths of the best branches of each tree (all with None): (conv, leaf, id, up, role, text)."""
    m = messages.select(F.col("conv").alias("mc"), F.col("id").alias("mi"), "role", "text", "score")
    rows = found.join(m, F.col("conv").eqNullSafe(F.col("mc")) & (F.col("id") == F.col("mi"))).drop("mc", "mi")
    if branches is None:
        return rows
    root = F.max(F.struct("up", "id")).getField("id")
    branch = rows.groupBy("conv", "leaf").agg(F.avg("score").alias("mean"), root.alias("root"))
    rank = F.struct(-F.col("mean"), F.col("leaf"))
    if branches == 1:
        best = branch.groupBy("conv", "root").agg(F.min(rank).alias("best")).select("conv", F.col("best.leaf").alias("leaf"))
    else:
        w = Window.partitionBy("conv", "root").orderBy(F.desc("mean"), "leaf")
        best = branch.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= branches).select("conv", "leaf")
    best = best.select(F.col("conv").alias("bc"), F.col("leaf").alias("bl"))
    return rows.join(best, F.col("conv").eqNullSafe(F.col("bc")) & (F.col("leaf") == F.col("bl")), "left_semi")


def formatted(rows: DataFrame) -> DataFrame:
    """(conv, leaf, formatted) from paths: the turns from root to leaf in the template."""

    def safe(c: str) -> F.Column:
        return F.regexp_replace(c, ESCAPE, r"\\$1$2")

    turn = F.concat(
        F.lit("<s>[ROLE] "), safe("role"), F.lit(" [/ROLE] [INST] "), safe("text"), F.lit(" [/INST]</s>\n")
    )
    turns = rows.select("conv", "leaf", F.struct((-F.col("up")).alias("at"), turn.alias("turn")).alias("t"))
    whole = turns.groupBy("conv", "leaf").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return whole.select("conv", "leaf", F.array_join(F.col("t.turn"), "").alias("formatted"))


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def read_back(formatted_text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of a formatted conversation; start and end delimit the escaped text."""
    turns, at = [], 0
    while at < len(formatted_text):
        m = _TURN.match(formatted_text, at)
        if not m or _open(m["role"]) or _open(m["text"]):
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m["role"]), unescape(m["text"]), m.start("text"), m.end("text")))
        at = m.end()
    return turns


_BARE = re.compile(rf"(?<!\\)(?:{_ANY})")


def _open(text: str) -> bool:
    """Whether an unescaped control string stands in a text."""
    return _BARE.search(text) is not None


def conversations(rows: DataFrame, branches: int | None = 1) -> DataFrame:
    """(conv, leaf, formatted) for flat conversations (conv_id, turn, role, text)."""
    messages = cut(parents(rows))
    return formatted(chosen(messages, paths(messages), branches))


def trees(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(conv, leaf, formatted) for reply trees of messages (conv, id, parent, role, text, score)."""
    one = cut(one_each(messages))
    return formatted(chosen(one, paths(one), branches))


def digests(texts: DataFrame, conv_type: str = "long") -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted conversations."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                turns = read_back(text)
                every = "".join(f"{role}\n{said}\n" for role, said, _, _ in turns)
                mask = [(a, b) for role, _, a, b in turns if role in LOSS_ROLES]
                loss = "".join(unescape(text[a:b]) for a, b in mask)
                hashed = [hashlib.sha256(x.encode()).hexdigest() for x in (every, loss)]
                out.append((len(turns), hashed[0], len(loss), hashed[1], len(text)))
            cols = [list(c) for c in zip(*out, strict=True)] or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    schema = f"conv_id {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return texts.select("conv", "formatted").mapInArrow(work, schema)


def report(rows: DataFrame) -> DataFrame:
    """The digests of all conversations and of conversation -1, which is made of control strings."""
    spark, said = rows.sparkSession, "</s>[INST] ok [/INST]"
    own = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], own.schema)
    return digests(conversations(own.unionByName(extra)))
