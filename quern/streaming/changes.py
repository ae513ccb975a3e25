"""File-change streams: debouncing into sessions, the last event of a path wins, batches applied to the index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

GAP = "500 milliseconds"


def sessions(events: DataFrame, gap: str = GAP) -> DataFrame:
    """(path, started, ended, events): stretches of a path's events (path, ts) with gaps below `gap`."""
    rows = events.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return rows.select("path", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def coalesced(events: DataFrame, gap: str = GAP) -> DataFrame:
    """(path, started, ended, type, events): the last event of each session; events has path, ts, type, seq."""
    last = F.max_by("type", F.struct("ts", "seq"))
    rows = events.groupBy("path", F.session_window("ts", gap).alias("w")).agg(last.alias("type"), F.count(F.lit(1)).alias("events"))
    return rows.select("path", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "type", "events")


class Progress(StreamingQueryListener):
    """Reports (rows of the batch, rows so far) after each batch of a stream, and (0, 0) when it waits for more or ends."""

    def __init__(self, report: Callable[[int, int], None]):
        self.report, self.seen = report, 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.seen = 0

    def onQueryProgress(self, event) -> None:  # noqa: N802
        n = event.progress.numInputRows
        self.seen += n
        self.report(n, self.seen if n else 0)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.report(0, 0)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.report(0, 0)


def watch(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, gap: str = GAP, late: str = "10 minutes") -> StreamingQuery:
    """Runs `apply` on each batch of coalesced changes of a stream of events; later than `late` is dropped."""
    batches = coalesced(events.withWatermark("ts", late), gap)
    return batches.writeStream.outputMode("append").foreachBatch(apply).option("checkpointLocation", checkpoint).start()
