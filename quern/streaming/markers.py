"""Whether a reply begins with a marker, decided as its pieces come.

A marker is the first line after line breaks: `<<<NEEDS_` and a kind, then `>>>`, or a colon, a reason without `>` that
is not blank, and `>>>`. The automaton reads one character at a time and decides at the first that settles the matter,
so every cutting of a text into pieces gives one verdict: `need-more` while a marker is still possible, `no-marker`, or
`matched-` and the kind in lower case. Its state is a short string: the line so far, with the reason as one mark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed values of the format.
LEAD, KINDS, CLOSE = "<<<NEEDS_", ("PRO", "FLASH"), ">>>"
MORE, NONE = "need-more", "no-marker"
HEADS = tuple(LEAD + k for k in KINDS)


def step(line: str, c: str) -> tuple[str, str]:
    """The line and the verdict after one more character; the reason is `_` while blank and `r` once it is not."""
    if not line and c in "\n\r":
        return line, MORE
    head = next((h for h in HEADS if line.startswith(h)), None)
    if head is None:
        line += c
        return line, MORE if any(h.startswith(line) for h in HEADS) else NONE
    tail = line[len(head) :]
    if c == "\n":
        return line, NONE
    closing = len(tail) - len(tail.rstrip(">"))
    if c == ">" and closing < len(CLOSE) and not tail.startswith(CLOSE):
        line += c
        if closing + 1 == len(CLOSE) and tail[:1] != ":":
            return line, "matched-" + head[len(LEAD) :].lower()
        if closing + 1 == len(CLOSE) and "r" in tail:
            return line, "matched-" + head[len(LEAD) :].lower()
        return line, MORE
    if closing:
        return line, NONE
    if not tail:
        return (line + c, MORE) if c == ":" else (line, NONE)
    mark = "_" if c.isspace() else "r"
    if tail == ":":
        return line + mark, MORE
    return (line[:-1] + "r" if mark == "r" else line), MORE


def feed(line: str, verdict: str, piece: str) -> tuple[str, str]:
    """The line and verdict after a piece; a verdict that is settled stays."""
    for c in piece:
        if verdict != MORE:
            break
        line, verdict = step(line, c)
    return line, verdict


def verdicts(pieces: DataFrame) -> DataFrame:
    """(stream, seq, verdict) for text pieces (stream, seq, piece) of replies, a batch or a stream in order of seq."""
    if not pieces.isStreaming:

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, line, verdict = None, "", MORE  # of the stream that the rows are in; a null one comes first
            for batch in batches:
                said = []
                for stream, piece in zip(batch["stream"].tolist(), batch["piece"].tolist(), strict=True):
                    if stream != at:
                        at, line, verdict = stream, "", MORE
                    line, verdict = feed(line, verdict, piece or "")
                    said.append(verdict)
                yield pd.DataFrame({"stream": batch["stream"], "seq": batch["seq"], "verdict": said})

        dealt = pieces.select("stream", "seq", "piece").repartition("stream").sortWithinPartitions("stream", F.asc_nulls_last("seq"))
        return dealt.mapInPandas(whole, "stream string, seq long, verdict string")

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        line, verdict = state.get if state.exists else ("", MORE)
        out = []
        for r in pd.concat(batches).sort_values("seq").itertuples():
            line, verdict = feed(line, verdict, r.piece or "")
            out.append((key[0], r.seq, verdict))
        state.update((line, verdict))
        yield pd.DataFrame(out, columns=["stream", "seq", "verdict"])

    return pieces.groupBy("stream").applyInPandasWithState(
        work, "stream string, seq long, verdict string", "line string, verdict string", "append", GroupStateTimeout.NoTimeout
    )
