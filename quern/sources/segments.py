"""What the stored indexes share: immutable segments on a commit log, tombstones, and merging by size tiers.

A write adds one segment of its own rows and the ids (`dead`) that count no more in older segments, so nothing that is
there is rewritten. A row counts unless a later segment has its id among the dead. When `FAN` neighbouring segments are
of about one size they can be merged into one, without their dead rows; each row is so rewritten once a tier.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.commits import RETRIES, Conflict, Log

#: Neighbouring segments of one tier that are merged, and the factor between tiers.
FAN = 4


#: While an index is written: shuffle files go when the action ends that made them, not when the driver's garbage is
#: collected; and a union of single partitions keeps them apart.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.unionOutputPartitioning": "false"}


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Segments:
    """State: config (of the index) and segments, each with seq (its place in time), folder, rows and dead (whether any)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = Log(spark, self.folder)

    def state(self) -> dict:
        entry = self.log.latest()
        if entry is None:
            raise ValueError("the index is empty")
        return entry["state"]

    def exists(self) -> bool:
        return self.log.latest() is not None

    def _read(self, segment: dict, table: str, schema: str) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{segment['folder']}/{table}")
        return rows.withColumns({"seq": F.lit(segment["seq"]), "of": F.lit(segment["folder"])})

    def _all(self, segments: list[dict], table: str, schema: str) -> DataFrame:
        """The rows of a table in all segments, with seq and of (the segment's folder)."""
        out = self.spark.createDataFrame([], f"{schema}, seq int, of string")
        for s in segments:
            out = out.unionByName(self._read(s, table, schema))
        return out

    def _killed(self, state: dict) -> DataFrame | None:
        """Ids that segments have killed in all older ones (id, upto: the newest such segment); None if there is no such segment."""
        killers = [s for s in state["segments"] if s["dead"]]
        return self._all(killers, "dead", f"id {state['config']['id_type']}").groupBy("id").agg(F.max("seq").alias("upto")) if killers else None

    def _alive(self, rows: DataFrame, state: dict) -> DataFrame:
        """rows (id, seq, ...) that no later segment has killed."""
        dead = self._killed(state)
        if dead is None:
            return rows
        joined = rows.join(dead, "id", "left")
        return joined.where(F.col("upto").isNull() | (F.col("seq") >= F.col("upto"))).drop("upto")

    def _append(
        self,
        config: dict,
        write: Callable[[str], dict],
        killed: DataFrame | None,
        anew: bool,
        batch: tuple[str, int] | None,
        settle: Callable[[dict, DataFrame, str], dict] | None = None,
    ) -> None:
        """One commit of a new segment: write(folder) gives what its entry says; killed (id) are dead in older ones.

        The files are written once; only what depends on the older segments (`settle`) is done again after a conflict.
        """
        if self.log.has(batch, self.log.latest()):
            return
        with tidy(self.spark):
            self._commit(config, write, killed, anew, batch, settle)

    def _commit(self, config: dict, write: Callable, killed: DataFrame | None, anew: bool, batch: tuple[str, int] | None, settle: Callable | None) -> None:
        folder = f"seg-{uuid.uuid4().hex}"
        said = {"folder": folder, **write(f"{self.folder}/{folder}"), "dead": killed is not None}
        if killed is not None:
            killed.select("id").distinct().write.parquet(f"{self.folder}/{folder}/dead")
            killed = self.spark.read.schema(f"id {config['id_type']}").parquet(f"{self.folder}/{folder}/dead")
        for attempt in range(RETRIES):
            entry = self.log.latest()
            if self.log.has(batch, entry):
                break
            old = entry["state"] if entry and not anew else {"config": config, "segments": []}
            more = settle(old, killed, f"{folder}/{attempt}") if settle and killed is not None and old["segments"] else {}
            seq = 1 + max((s["seq"] for s in old["segments"]), default=0)
            dead = said["dead"] and bool(old["segments"])
            try:
                self.log.create(entry, {"config": old["config"], "segments": [*old["segments"], said | more | {"seq": seq, "dead": dead}]}, batch)
                return
            except Conflict:
                continue
        else:
            raise Conflict("too many writers")
        self.log.remove(folder)

    @staticmethod
    def due(segments: list[dict]) -> list[dict]:
        """The first FAN or more neighbours that are all of the lowest tier that has so many, or below it; or none."""
        tiers = [int(math.log(max(1, s["rows"]), FAN)) for s in segments]
        for most in sorted(set(tiers)):
            run: list[dict] = []
            for s, tier in zip([*segments, None], [*tiers, most + 1], strict=True):
                if tier <= most:
                    run.append(s)
                elif len(run) >= FAN:
                    return run
                else:
                    run = []
        return []

    def merge(self, whole: bool = False) -> bool:
        """Merges neighbours of one tier, or (`whole`) all segments, into one segment; whether there was anything to do."""
        with tidy(self.spark):
            return self._merge(whole)

    def _merge(self, whole: bool) -> bool:
        for _ in range(RETRIES):
            entry = self.log.latest()
            state = entry["state"]
            run = state["segments"] if whole else self.due(state["segments"])
            if len(run) < (1 if whole and any(s["dead"] for s in run) else 2):
                return False
            folder = f"seg-{uuid.uuid4().hex}"
            older = state["segments"][: state["segments"].index(run[0])]
            said = {"folder": folder, **self._merged(state, run, older, folder), "seq": run[-1]["seq"], "dead": False}
            if older and any(s["dead"] for s in run):  # still dead in what is older than the run
                dead = self._all([s for s in run if s["dead"]], "dead", f"id {state['config']['id_type']}")
                dead.select("id").distinct().write.parquet(f"{self.folder}/{folder}/dead")
                said["dead"] = True
            later = state["segments"][len(older) + len(run) :]
            try:
                self.log.create(entry, state | {"segments": [*older, said, *later]})
                return True
            except Conflict:
                self.log.remove(folder)
        raise Conflict("too many writers")

    def _merged(self, state: dict, run: list[dict], older: list[dict], folder: str) -> dict:
        raise NotImplementedError

    def _folders(self, state: dict) -> set[str]:
        return {s["folder"] for s in state["segments"]} | {v for k, v in state["config"].items() if k.endswith("folder")}

    def expire(self, keep: int = 5, grace: float = 3600.0) -> list[str]:
        return self.log.expire(self._folders, keep, grace)
