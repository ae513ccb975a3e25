"""Stateful streams: sticky conversation prefixes with a time to live, and lines framed from pieces of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.streaming.conversations import TTL_SECONDS, Framer


def framed(pieces: DataFrame) -> DataFrame:
    """(stream, seq, field, value): the lines of byte pieces (stream, seq, piece), a partial line waiting as state."""

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        framer = Framer()
        if state.exists:
            framer.rest = bytes(state.get[0])
        rows = []
        for piece in pd.concat(batches).sort_values("seq").itertuples():
            rows += [(key[0], piece.seq, field, value) for field, value in framer.feed(bytes(piece.piece))]
        state.update((framer.rest,))
        yield pd.DataFrame(rows, columns=["stream", "seq", "field", "value"])

    return pieces.groupBy("stream").applyInPandasWithState(
        work, "stream string, seq long, field string, value string", "rest binary", "append", GroupStateTimeout.NoTimeout
    )


def sticky(requests: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """(key, at, known): for requests (key, at, upgraded) whether the key was upgraded within `ttl` seconds before.

    Keys are prefix fingerprints (see conversations.prefixes); a request that upgrades renews its key.
    """

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else float("-inf")
        rows = []
        for r in pd.concat(batches).sort_values("at").itertuples():
            at = r.at.timestamp()
            rows.append((key[0], r.at, at < until))
            if r.upgraded:
                until = at + ttl
        if until > float("-inf"):
            state.update((until,))
            watermark = state.getCurrentWatermarkMs()
            state.setTimeoutTimestamp(max(int(until * 1000), watermark + 1))
        yield pd.DataFrame(rows, columns=["key", "at", "known"])

    return requests.withWatermark("at", f"{ttl} seconds").groupBy("key").applyInPandasWithState(
        work, "key string, at timestamp, known boolean", "until double", "append", GroupStateTimeout.EventTimeTimeout
    )


def renumbered(blocks: DataFrame) -> DataFrame:
    """Content blocks (stream, part, index, ...) of streams joined from parts, with one running `block` from 0."""
    from pyspark.sql.window import Window

    return blocks.withColumn("block", F.row_number().over(Window.partitionBy("stream").orderBy("part", "index")) - 1)


def route(rows: DataFrame) -> DataFrame:
    """Requests (advisor_mode, known, marker) with `route`: the advisor's loop, the upper tier, a switch, or the lower one."""
    where = F.when(F.col("advisor_mode"), "advisor").when(F.col("known"), "upper").when(F.col("marker") != "", "switch").otherwise("lower")
    return rows.withColumn("route", where)
