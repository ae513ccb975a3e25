"""A transactional store of chunks and vectors in buckets of file paths: a write makes new files for the buckets it touches.

An entry of the commit log says which folder counts for each bucket, so a write is one commit, a reader never sees half
of it, and untouched buckets stay as they are. Two writers lose nothing: the one that comes second keeps its files if
the other touched neither its buckets nor its ids, and works on the new state otherwise. A batch of a stream that is
replayed changes nothing. Folders that no kept entry names leave with `expire`. All rows move through Spark; a lost
executor costs a retry of a task.

Beside its rows each folder keeps an inverted index of the segments of their paths, with the bucket of each path, sorted
so that a scan skips what lies elsewhere. Reading or deleting what lies beneath folders asks it first, and then opens
only the buckets that hold such a path.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.vectors import is_valid
from quern.operators import paths as segments
from quern.sources.commits import RETRIES, Conflict, Log


#: The index of a folder's paths; Spark does not take a folder of such a name for rows.
PATHS = "_paths"


class Part(NamedTuple):
    bucket: int
    folder: str
    rows: int


class Store:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.log = Log(spark, self.folder)

    @staticmethod
    def _opened(entry: dict | None) -> dict | None:
        if entry is None:
            return None
        return {"version": entry["version"], **entry["state"], "parts": [Part(*p) for p in entry["state"]["parts"]]}

    def state(self, version: int | None = None) -> dict | None:
        """What counts now, or counted at a version that is still kept: version, state (complete, incomplete or error),
        dimension, rows, schema, parts."""
        return self._opened(self.log.latest() if version is None else self.log.read(version))

    @staticmethod
    def _said(state: str, dimension: int | None, schema: str | None, parts: list[Part]) -> dict:
        return {"state": state, "dimension": dimension, "rows": sum(p.rows for p in parts), "schema": schema, "parts": [list(p) for p in parts]}

    def _bucket(self, path: Column) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    def _rows(self, now: dict, only: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(now["schema"]))
        at = [f"{self.folder}/{p.folder}/bucket={p.bucket}" for p in now["parts"] if only is None or p.bucket in only]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows (id, file_path, embedding, ...) that count; None for a store that was never written."""
        now = self.state(version)
        return self._rows(now) if now and now["schema"] else None

    def write(
        self,
        rows: DataFrame | None = None,
        gone: DataFrame | Callable[[dict], DataFrame] | None = None,
        state: str = "complete",
        anew: bool = False,
        batch: tuple[str, int] | None = None,
    ) -> None:
        """One commit: the rows of `gone` paths (file_path; or what gives them for a state) leave, `rows` come by id in place
        of older ones.

        rows are computed once, to the store's own folder, and checked there. Vectors must be finite and of the store's
        dimension; another dimension, or `anew`, rebuilds the store. A `batch` (stream, number) that is in already, or
        one of a higher number of its stream, makes this a no-op.
        """
        if self.log.has(batch, self.log.latest()):
            return
        staged, fresh, dimension = f"new-{uuid.uuid4().hex}", None, None
        try:
            if rows is not None:
                rows.write.parquet(f"{self.folder}/{staged}")
                fresh = self.spark.read.parquet(f"{self.folder}/{staged}").withColumn("bucket", self._bucket(F.col("file_path")))
                bad = F.count_if(F.col("file_path").isNull() | ~is_valid(F.col("embedding")))
                bad, least, dimension = fresh.agg(bad, F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
                if bad:
                    raise ValueError("rows need a file_path and a finite vector")
                if least != dimension:
                    raise ValueError("vectors differ in dimension")
            self._merge(fresh, gone, dimension, state, anew, batch)
        finally:
            self.log.remove(staged)

    def _merge(self, fresh: DataFrame | None, gone: DataFrame | Callable[[dict], DataFrame] | None, dimension: int | None, state: str, anew: bool, batch: tuple[str, int] | None) -> None:
        for _ in range(RETRIES):
            entry = self.log.latest()
            if self.log.has(batch, entry):
                return
            now = self._opened(entry)
            made = self._made(now, fresh, gone, dimension, anew)
            if made is None:
                return
            target, touched, dim, schema, parts, old = made
            while True:
                kept = [p for p in (now["parts"] if old else []) if p.bucket not in touched]
                try:
                    self.log.create(entry, self._said(state, dim, schema, kept + parts), batch)
                    return
                except Conflict:
                    entry, before = self.log.latest(), now
                    now = self._opened(entry)
                    if self.log.has(batch, entry) or not (old and self._apart(before, now, touched, fresh, schema)):
                        break
            self.log.remove(target)
        raise Conflict("too many writers")

    def _made(self, now: dict | None, fresh: DataFrame | None, gone: DataFrame | Callable[[dict], DataFrame] | None, dimension: int | None, anew: bool) -> tuple | None:
        """Writes the buckets that change: (folder, buckets touched, dimension, schema, new parts, whether the old count)."""
        touched: set[int] = set()
        if fresh is not None:
            touched |= {r[0] for r in fresh.select("bucket").distinct().collect()}  # at most `buckets` rows
        old = bool(now and now["schema"] and not anew and (dimension is None or now["dimension"] in (None, dimension)))
        if not old and fresh is None:
            return None
        kept = None
        if old:
            dimension = dimension or now["dimension"]
            if callable(gone):
                gone = gone(now)
            whole = self._rows(now).withColumn("bucket", self._bucket(F.col("file_path")))
            if gone is not None:
                touched |= {r[0] for r in gone.select(self._bucket(F.col("file_path"))).distinct().collect()}
            if fresh is not None:  # an id may have moved to another path
                touched |= {r[0] for r in whole.select("id", "bucket").join(fresh.select("id"), "id", "left_semi").select("bucket").distinct().collect()}
            if fresh is None and not touched:
                return None
            kept = self._rows(now, touched).withColumn("bucket", self._bucket(F.col("file_path")))
            if gone is not None:
                kept = kept.join(gone.select("file_path").distinct(), "file_path", "left_anti")
            if fresh is not None:
                kept = kept.join(fresh.select("id").distinct(), "id", "left_anti")
        out = kept if fresh is None else fresh.dropDuplicates(["id"])
        if kept is not None and fresh is not None:
            out = out.unionByName(kept, allowMissingColumns=True)
        schema, target = out.drop("bucket").schema.json(), f"data-{uuid.uuid4().hex}"
        out.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{target}")
        written = self.spark.read.schema("file_path string, bucket int").parquet(f"{self.folder}/{target}")
        counts = written.groupBy("bucket").count().collect()
        index = segments.postings(written.distinct()).repartitionByRange("position", "segment").sortWithinPartitions("position", "segment")
        index.write.parquet(f"{self.folder}/{target}/{PATHS}")
        return target, touched, dimension, schema, [Part(r["bucket"], target, r["count"]) for r in counts], old

    def _apart(self, before: dict, now: dict, touched: set[int], fresh: DataFrame | None, schema: str) -> bool:
        """Whether what others committed since `before` leaves a write on other buckets as it is."""
        if (now["schema"], now["dimension"]) != (before["schema"], before["dimension"]) or now["schema"] != schema:
            return False
        changed = {p.bucket for p in set(now["parts"]) ^ set(before["parts"])}
        if changed & touched:
            return False
        return fresh is None or not changed or self._rows(now, changed).join(fresh.select("id"), "id", "left_semi").isEmpty()

    def upsert(self, rows: DataFrame, state: str = "complete", batch: tuple[str, int] | None = None) -> None:
        self.write(rows, state=state, batch=batch)

    def delete_paths(self, paths: list[str] | DataFrame) -> None:
        if isinstance(paths, list):
            paths = self.spark.createDataFrame([(p,) for p in paths], "file_path string")
        self.write(gone=paths)

    def _beneath(self, now: dict, folders: Iterable[str]) -> DataFrame:
        """(file_path, bucket) of the paths that lie in one of the folders, from the indexes of the folders that count."""
        held: dict[str, list[int]] = {}
        for p in now["parts"]:
            held.setdefault(p.folder, []).append(p.bucket)
        found = self.spark.createDataFrame([], segments.POSTINGS)
        for name, buckets in sorted(held.items()):  # at most one a bucket
            part = self.spark.read.schema(segments.POSTINGS).parquet(f"{self.folder}/{name}/{PATHS}")
            found = found.unionByName(part.where(F.col("bucket").isin(buckets)))
        return segments.beneath(found, folders)

    def buckets_beneath(self, folders: Iterable[str]) -> set[int]:
        """The buckets that hold a path in one of the folders, without a look at the rows."""
        now = self.state()
        return {r[0] for r in self._beneath(now, folders).select("bucket").distinct().collect()} if now and now["schema"] else set()

    def beneath(self, folders: Iterable[str]) -> DataFrame | None:
        """The rows that count and lie in one of the folders; only buckets that hold such a path are opened."""
        now = self.state()
        if not now or not now["schema"]:
            return None
        found = self._beneath(now, folders)
        buckets = {r[0] for r in found.select("bucket").distinct().collect()}  # at most `buckets` rows
        return self._rows(now, buckets).join(found.select("file_path"), "file_path", "left_semi")

    def delete_beneath(self, folders: Iterable[str]) -> None:
        """One commit that drops what lies in the folders; no commit where nothing does."""
        folders = list(folders)
        self.write(gone=lambda now: self._beneath(now, folders).select("file_path"))

    def clear(self) -> None:
        self.log.update(lambda now: self._said("complete", now["dimension"], now["schema"], []) if now and now["schema"] else None)

    def mark(self, state: str) -> None:
        """Marks the index complete, incomplete or in error without touching its rows."""
        self.log.update(lambda now: (now or self._said(state, None, None, [])) | {"state": state})

    def expire(self, keep: int = 5, grace: float = 3600.0) -> list[str]:
        """Keeps the last versions, and removes the folders that only older ones name; gives their names."""
        return self.log.expire(lambda s: {p[1] for p in s["parts"]}, keep, grace)

    def has_data(self) -> bool:
        now = self.state()
        return bool(now and now["state"] == "complete" and now["rows"])

    def paths(self) -> DataFrame:
        old = self.read()
        return old.select("file_path").distinct() if old is not None else self.spark.createDataFrame([], "file_path string")
