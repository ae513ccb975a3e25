"""Operators on Spark's arbitrary state with timers and time to live (transformWithState, on the RocksDB state store)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quern.streaming.conversations import TTL_SECONDS

#: The quiet time after which what has come is handed on.
QUIET_MS = 500
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Debounce(StatefulProcessor):
    """Holds the last event of each path; a timer that every event sets anew hands all of them on at once."""

    def __init__(self, quiet_ms: int, clock: Callable[[object], int] | None = None) -> None:
        self.quiet_ms = quiet_ms
        self.clock = clock or (lambda timers: timers.getCurrentProcessingTimeInMs())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "path string", "type string, seq long")
        self.due = handle.getValueState("due", "ms long")
        self.flushes = handle.getValueState("flushes", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            for path, kind, seq in zip(batch["path"], batch["type"], batch["seq"], strict=True):
                before = self.last.getValue((path,))
                if before is None or before[1] <= seq:
                    self.last.updateValue((path,), (kind, int(seq)))
        at = self.clock(timerValues) + self.quiet_ms
        before = self.due.get()
        if before is None or before[0] != at:
            if before is not None:
                self.handle.deleteTimer(before[0])
            self.handle.registerTimer(at)
            self.due.update((at,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = self.flushes.get()
        n = 1 if n is None else n[0] + 1
        rows = sorted((k[0], v[0], v[1]) for k, v in self.last.iterator())
        self.last.clear()
        self.due.clear()
        self.flushes.update((n,))
        if rows:
            yield pd.DataFrame([(n, *r) for r in rows], columns=["flush", "path", "type", "seq"])

    def close(self) -> None:
        pass


def debounced(events: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """(flush, path, type, seq): once no event (path, type, seq) of any path has come for `quiet_ms` of processing time,
    the last event of every path since the flush before. One flush concerns all paths, so all meet under one key; a
    batch brings one row a path there.
    """
    last = events.groupBy("path").agg(F.max_by("type", "seq").alias("type"), F.max("seq").alias("seq")) if not events.isStreaming else events
    return last.select(F.lit(0).alias("all"), "path", "type", "seq").groupBy("all").transformWithStateInPandas(
        statefulProcessor=Debounce(quiet_ms), outputStructType="flush long, path string, type string, seq long", outputMode="append", timeMode="processingTime"
    )


class LivePrefix(StatefulProcessor):
    """Until when each prefix of a conversation stays upgraded; a lookup walks from the longest proper prefix down."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        # the store forgets a prefix some time after its end in the requests' own time, which decides
        self.until = handle.getMapState("until", "key string", "until double", ttlDurationMs=max(60_000, 2000 * self.ttl))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "request"]).itertuples():
            at, known = r.at.timestamp(), 0
            for n in range(len(r.keys), 0, -1):
                kept = self.until.getValue((r.keys[n - 1],))
                if kept is not None and at < kept[0]:
                    known = n
                    break
            out.append((r.request, known))
            if r.upgraded and len(r.keys):
                self.until.updateValue((r.keys[-1],), (at + self.ttl,))
        yield pd.DataFrame(out, columns=["request", "known"])

    def close(self) -> None:
        pass


def live_prefixes_stream(requests: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """(request, known) for requests (request long, at timestamp, keys, upgraded) in their order of time: the length of
    the longest proper prefix (keys, the shortest first) that a request before upgraded less than `ttl` seconds ago.

    Conversations that can share a prefix share the first one, so that is the key of the state.
    """
    rows = requests.select(F.coalesce(F.get("keys", F.lit(0)), F.lit("")).alias("root"), "request", "at", "keys", "upgraded")
    return rows.groupBy("root").transformWithStateInPandas(
        statefulProcessor=LivePrefix(ttl), outputStructType="request long, known int", outputMode="append", timeMode="processingTime"
    )


def live_prefixes(requests: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """The batch form of live_prefixes_stream: a join of the keys that are looked up with those that were upgraded."""
    asked = requests.select("request", "at", F.posexplode("keys").alias("n", "key"))
    kept = requests.where(F.col("upgraded") & (F.size("keys") > 0))
    kept = kept.select(F.element_at("keys", -1).alias("key"), F.struct("at", "request").alias("w"))
    # of the upgrades of a key only the last one before a request matters: a running maximum over both
    both = asked.select("key", F.struct("at", "request").alias("w"), "n", F.lit(None).cast("timestamp").alias("up"))
    both = both.unionByName(kept.select("key", "w", F.lit(None).cast("int").alias("n"), F.col("w.at").alias("up")))
    from pyspark.sql.window import Window

    w = Window.partitionBy("key").orderBy("w", F.col("n").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("last", F.max("up").over(w)).where(F.col("n").isNotNull())
    live = seen.where(F.col("w.at").cast("double") < F.col("last").cast("double") + ttl)
    best = live.groupBy(F.col("w.request").alias("request")).agg((F.max("n") + 1).alias("known"))
    return requests.select("request").join(best, "request", "left").select("request", F.coalesce("known", F.lit(0)).alias("known"))


def requests_of(prefixes: DataFrame, upgraded) -> DataFrame:
    """(request, at, keys, upgraded) from prefixes (conv_id, n, size, key) of conversations, one request a second."""
    keys = F.array_sort(F.collect_list(F.when(F.col("n") < F.col("size"), F.struct("n", "key"))))
    rows = prefixes.groupBy(F.col("conv_id").alias("request")).agg(keys.getField("key").alias("keys"))
    return rows.select("request", F.timestamp_seconds("request").alias("at"), "keys", upgraded.alias("upgraded"))
