"""A stored inverted-file index of vectors: approximate nearest neighbours that read only the probed lists.

Unit vectors are dealt to lists by the nearest of `lists` coarse centroids. A list keeps a byte a component of what is
left of a vector (its residual, in steps of `scale`), the columns that filters need, and the vector itself, each in
columns of its own. A search reads the codes of the `probes` nearest lists, as many as the data need (below), drops what a filter or a tombstone excludes,
ranks the rest by their codes, and ranks the `refine` * k best again by their vectors, so scores are exact cosines.
A search over all lists spares no list, so it ranks by the vectors alone, and its result is the exact one whatever the
data (codes cannot tell near copies apart, and a group of them may be larger than any number of candidates).

The centroids and the scale are fitted on at most `SAMPLE` vectors, chosen by hash; every vector is indexed. The number
of lists that a search probes unless told otherwise is measured: at most `ASKED` of the sampled vectors are compared with
all vectors, and the least number of lists that hold a share of `REACH` of their nearest neighbours is kept with the
model. Vectors that fall into groups need few lists, vectors without structure many. The number of lists is the square root of that of the vectors, at most `MOST_LISTS`, so what the driver and the tasks hold of the
model is bounded. Upserts and deletes add segments (sources.segments); nothing is fitted again. Vectors that are null,
not finite, of another length or zero have no direction and are not indexed.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.vectors import cosine, is_valid
from quern.operators.search import ROUND, block_topk, dense
from quern.sources.segments import Segments

#: Vectors that the model is fitted on, rounds of fitting, and the largest number of lists.
SAMPLE, ROUNDS, MOST_LISTS = 20_000, 12, 16_384
#: Queries, neighbours of each and the share of these by which the number of probed lists is measured.
ASKED, NEIGHBOURS, REACH = 256, 10, 0.96
#: Candidates for each hit that are ranked by their vectors.
REFINE = 4
#: Queries and vectors that one task compares at a time in a search for many; pairs of a row and a list that it holds.
BLOCK, SLICE, PROBED = 512, 8192, 1 << 17


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fitted(x: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of unit vectors by Lloyd's rounds from evenly chosen starts, and the step of each component's residual."""
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy()
    for _ in range(ROUNDS):
        to = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        n = np.bincount(to, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, to, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    rest = np.abs(x - c[(x @ c.T - (c * c).sum(1) / 2).argmax(1)])
    return c, np.maximum(rest.max(0), 1e-6) / 127


class VectorIndex(Segments):
    """(id, embedding) and the columns `keep` of rows, by which a search can filter."""

    def fit(self, rows: DataFrame, lists: int | None = None, keep: tuple[str, ...] = ()) -> None:
        """Fits the model on a sample of rows and indexes all of them; what was indexed before counts no more."""
        dim = rows.where(is_valid(F.col("embedding"))).select(F.size("embedding")).first()
        if dim is None:
            raise ValueError("no vector to fit an index on")
        dim = dim[0]
        rows = rows.select("id", "embedding", *keep)
        good = self._good(rows, dim)
        n = good.count()
        share = min(1.0, 1.1 * SAMPLE / max(n, 1))
        some = good.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
        some = some.select(F.xxhash64("id").alias("h"), "embedding").limit(SAMPLE).toPandas().sort_values("h")
        lists = lists or min(MOST_LISTS, max(1, round(math.sqrt(n))))
        x = unit(np.stack(some["embedding"].to_numpy()).astype(np.float64)) if len(some) else np.zeros((1, dim))
        c, scale = fitted(x, lists)
        folder = f"model-{uuid.uuid4().hex}"
        told = [(i, v.tolist()) for i, v in enumerate(c)] + [(-1, scale.tolist())]
        self.spark.createDataFrame(told, "list int, v array<double>").coalesce(1).write.parquet(f"{self.folder}/{folder}")
        kept = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
        probes = self._needed(good.select("embedding"), x[:: max(1, len(x) // ASKED)][:ASKED], c)
        config = {"model_folder": folder, "probes": probes, "dim": dim, "id_type": rows.schema["id"].dataType.simpleString(), "keep": list(keep), "kept": kept}
        self._append(config, lambda at: self._write(rows, at, config), None, True, None)

    @staticmethod
    def _needed(vectors: DataFrame, asked: np.ndarray, c: np.ndarray) -> int:
        """How many lists hold REACH of the nearest neighbours of asked. A task keeps a few rows for each asked vector."""
        most = NEIGHBOURS + 1  # the vector itself is one of them
        step = min(SLICE, max(1, PROBED * 8 // len(c)))

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            score, at = np.full((len(asked), 0), -np.inf), np.zeros((len(asked), 0), np.int64)
            for batch in batches:
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    x = unit(part.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1))
                    lists = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
                    score, at = np.c_[score, asked @ x.T], np.c_[at, np.broadcast_to(lists, (len(asked), len(lists)))]
                    top = np.argsort(-score, 1)[:, :most]
                    score, at = np.take_along_axis(score, top, 1), np.take_along_axis(at, top, 1)
            q = np.repeat(np.arange(len(asked)), score.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(score.ravel()), pa.array(at.ravel(), pa.int32())], ["q", "score", "list"])

        w = Window.partitionBy("q").orderBy(F.desc("score"))
        rows = vectors.mapInArrow(nearest, "q int, score double, list int").withColumn("k", F.row_number().over(w))
        rows = rows.where((F.col("k") > 1) & (F.col("k") <= most)).select("q", "list").collect()  # at most ASKED * NEIGHBOURS
        if not rows:
            return 1
        order = np.argsort(-(asked @ c.T - (c * c).sum(1) / 2), 1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(len(c)), order.shape), 1)
        return 1 + int(np.quantile([place[r["q"], r["list"]] for r in rows], REACH, method="higher"))

    @staticmethod
    def _good(rows: DataFrame, dim: int) -> DataFrame:
        v = F.col("embedding")
        return rows.where(is_valid(v) & (F.size(v) == dim) & F.exists(v, lambda x: x != 0))

    def model(self, config: dict) -> tuple[np.ndarray, np.ndarray]:
        rows = self.spark.read.schema("list int, v array<double>").parquet(f"{self.folder}/{config['model_folder']}").orderBy("list").collect()
        return np.array([r.v for r in rows[1:]]), np.array(rows[0].v)

    @staticmethod
    def _schema(config: dict) -> str:
        return f"list int, id {config['id_type']}, code binary, embedding array<float>" + (f", {config['kept']}" if config["kept"] else "")

    def _write(self, rows: DataFrame, at: str, config: dict) -> dict:
        c, scale = self.model(config)
        names = ["id", "embedding", *config["keep"]]
        step = max(1, PROBED * 8 // len(c))

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
                x = unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))
                to = (x @ c.T - (c * c).sum(1) / 2).argmax(1) if batch.num_rows else np.zeros(0, int)
                code = np.clip(np.rint((x - c[to]) / scale), -127, 127).astype(np.int8)
                cols = [pa.array(to, pa.int32()), batch.column(0), pa.array([r.tobytes() for r in code], pa.binary()), *batch.columns[1:]]
                yield pa.RecordBatch.from_arrays(cols, ["list", "id", "code", *names[1:]])

        good = self._good(rows.select(*names), config["dim"]).withColumn("embedding", F.col("embedding").cast("array<float>"))
        dealt = good.mapInArrow(coded, self._schema(config)).hint("rebalance", "list")  # a large list takes several tasks
        dealt.sortWithinPartitions("list", "id").write.partitionBy("list").parquet(f"{at}/rows")
        return {"rows": self.spark.read.schema("list int, id " + config["id_type"]).parquet(f"{at}/rows").count()}

    def upsert(self, rows: DataFrame, gone: DataFrame | None = None, batch: tuple[str, int] | None = None) -> None:
        """rows come in place of older ones of their ids; the ids of gone (id) leave."""
        config = self.state()["config"]
        killed = rows.select("id") if gone is None else rows.select("id").union(gone.select("id"))
        self._append(config, lambda at: self._write(rows, at, config), killed, False, batch)

    def delete(self, ids: DataFrame, batch: tuple[str, int] | None = None) -> None:
        config = self.state()["config"]
        none = self.spark.createDataFrame([], ", ".join(f"{p}" for p in [f"id {config['id_type']}", "embedding array<float>", config["kept"]] if p))
        self._append(config, lambda at: self._write(none, at, config), ids.select("id"), False, batch)

    def _merged(self, state: dict, run: list[dict], older: list[dict], folder: str) -> dict:
        config = state["config"]
        rows = self._alive(self._all(run, "rows", self._schema(config)), state).drop("seq", "of").hint("rebalance", "list")
        rows.sortWithinPartitions("list", "id").write.partitionBy("list").parquet(f"{self.folder}/{folder}/rows")
        return {"rows": self.spark.read.schema("list int, id " + config["id_type"]).parquet(f"{self.folder}/{folder}/rows").count()}

    def _lists(self, state: dict, columns: list[str], only: list[int] | None = None) -> DataFrame:
        """The columns of the rows that count, of all lists or only some; other lists' files are not opened."""
        rows = self._all(state["segments"], "rows", self._schema(state["config"])).select("list", "id", "seq", *columns)
        return rows if only is None else rows.where(F.col("list").isin(only))

    def search(self, query: list[float], k: int, probes: int | None = None, refine: int = REFINE, where: Column | None = None) -> DataFrame:
        """(id, score) of the k nearest of the probed lists, best first; `where` is a predicate over `keep`."""
        state = self.state()
        config = state["config"]
        c, scale = self.model(config)
        if (probes or config["probes"]) >= len(c):
            rows = self._lists(state, ["embedding", *config["keep"]])
            return dense(self._alive(rows if where is None else rows.where(where), state), [float(x) for x in query], k)
        q = unit(np.array([query], np.float64))[0]
        near = np.argsort(-(c @ q - (c * c).sum(1) / 2), kind="stable")[: probes or config["probes"]].tolist()
        base, step = {i: float(c[i] @ q) for i in near}, q * scale

        def approx(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int8).reshape(batch.num_rows, -1)
                at = np.array([base[i] for i in batch.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at + code @ step)], ["list", "id", "about"])

        held = self._lists(state, ["code", *config["keep"]], near)
        held = self._alive(held if where is None else held.where(where), state).select("list", "id", "code")
        best = held.mapInArrow(approx, f"list int, id {config['id_type']}, about double").orderBy(F.desc("about"), "id").limit(refine * k).collect()
        if not best:
            return self.spark.createDataFrame([], f"id {config['id_type']}, score double")
        # at most refine * k ids, so that only the pages that hold them are read
        exact = self._lists(state, ["embedding"], sorted({r["list"] for r in best})).where(F.col("id").isin([r["id"] for r in best]))
        v = F.array(*map(F.lit, map(float, query)))
        scored = self._alive(exact, state).select("id", F.round(cosine(F.col("embedding"), v), ROUND).alias("score"))
        return scored.orderBy(F.desc("score"), "id").limit(k)

    def search_all(self, queries: DataFrame, k: int, probes: int | None = None, refine: int = REFINE) -> DataFrame:
        """(query_id, id, score, rank) of the k nearest for each query (id, embedding), from 1.

        Queries meet the lists that they probe. A list is dealt into slices and its queries into blocks of bounded size;
        a task compares one block with one slice by codes and keeps refine * k rows a query. Only these are shuffled to
        the ranking by codes, and of them refine * k a query to the ranking by vectors.
        """
        state = self.state()
        config = state["config"]
        c, scale = self.model(config)
        probes, id_type = min(probes or config["probes"], len(c)), config["id_type"]
        kind = queries.schema["id"].dataType.simpleString()

        step = max(1, PROBED // len(c))  # queries at a time, so that a batch is of one size however many lists there are

        def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
                x = unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))
                near = np.argsort(-(x @ c.T - (c * c).sum(1) / 2), 1, kind="stable")[:, :probes]
                at = np.repeat(np.arange(batch.num_rows), probes)
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], ["list", "query_id", "embedding"])

        asked = self._good(queries.select("id", F.col("embedding").cast("array<float>").alias("embedding")), config["dim"])
        if probes == len(c):
            return block_topk(asked, self._alive(self._lists(state, ["embedding"]), state), k)
        asked = asked.mapInArrow(probing, f"list int, query_id {kind}, embedding array<float>")
        rows = self._alive(self._lists(state, ["code"]), state)
        # a row a list, of which there are at most MOST_LISTS
        sizes = rows.groupBy("list").agg(F.count(F.lit(1)).alias("n")).join(asked.groupBy("list").agg(F.count(F.lit(1)).alias("m")), "list")
        sizes = F.broadcast(sizes.select("list", F.ceil(F.col("n") / SLICE).cast("int").alias("slices"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))

        def dealt(table: DataFrame, key: str, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
            mine = F.pmod(F.xxhash64(key), F.col(own_n)).cast("int").alias(own)
            each = F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)).alias(other)
            return table.join(sizes, "list").select("*", mine).select(*table.columns, own, each)

        no = F.lit(None)
        q = dealt(asked, "query_id", "block", "blocks", "slice", "slices")
        q = q.select("list", "block", "slice", "query_id", "embedding", no.cast(id_type).alias("id"), no.cast("binary").alias("code"))
        v = dealt(rows.select("list", "id", "code"), "id", "slice", "slices", "block", "blocks")
        v = v.select("list", "block", "slice", no.cast(kind).alias("query_id"), no.cast("array<float>").alias("embedding"), "id", "code")
        most = refine * k

        def best(group: pd.DataFrame) -> pd.DataFrame:
            has = group["code"].notna()
            a, b = group[~has], group[has].sort_values("id")
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": a["query_id"][:0], "id": b["id"][:0], "about": np.zeros(0)})
            x = unit(np.stack(a["embedding"].to_numpy()).astype(np.float64))
            code = np.frombuffer(b"".join(b["code"]), np.int8).reshape(len(b), -1)
            s = x @ (c[int(group["list"].iloc[0])] + code * scale).T
            top = np.argsort(-s, axis=1, kind="stable")[:, :most]
            return pd.DataFrame({"query_id": np.repeat(a["query_id"].to_numpy(), top.shape[1]), "id": b["id"].to_numpy()[top].ravel(), "about": np.take_along_axis(s, top, 1).ravel()})

        near = q.unionByName(v).groupBy("list", "block", "slice").applyInPandas(best, f"query_id {kind}, id {id_type}, about double")
        w = Window.partitionBy("query_id").orderBy(F.desc("about"), "id")
        near = near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("query_id", "id")
        stored = self._alive(self._lists(state, ["embedding"]), state).select("id", F.col("embedding").alias("a"))
        own = queries.select(F.col("id").alias("query_id"), F.col("embedding").alias("b"))
        scored = near.join(stored, "id").join(own, "query_id").select("query_id", "id", F.round(cosine(F.col("a"), F.col("b")), ROUND).alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
