"""Centroid clustering (Lloyd's rounds) by filtering over partition-local ball trees.

Every task builds metric trees over its own vectors, at most `TREE` a tree, once; they are kept in the shared checkpoint
folder. A ball stores its centre, radius, count, integer sum and sum of squared norms. In a round a ball whose distance
to one centroid plus its radius is less than that of every other centroid minus its radius goes to that centroid whole,
by its count and sum; centroids that cannot be nearest anywhere in a ball are dropped on the way down; in leaves that
are still undecided each vector is compared with what centroids are left. Radii and bounds are widened by `SLACK`, so
rounding can only make a ball descend, and distances in leaves are integers, so the result is exact, ties included.
A round moves only counts and sums, one row a centroid and task; the driver holds the centroids alone.

Defined results: vectors of another length, null vectors and vectors with a null, NaN or infinite component are left
out. A null id counts as the empty string in the order of the start vectors and stays null in the result; rows of equal
ids are separate vectors, ordered among the start vectors by their components. Fewer vectors than centroids: as many
centroids as vectors. Components beyond `MOST` after scaling are an error, because squared distances and their sums
would no longer be exact longs. Vectors that occur often lie wherever they are read; nothing is shuffled by value.
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, LongType

from quern.llm.common import cut

#: The contract's values: components, scale, centroids, rounds, salt of the start order.
WIDTH, SCALE, CENTROIDS, ROUNDS, SALT = 64, 64, 16, 3, "1"
#: Vectors a tree and a leaf.
TREE, LEAF = 4096, 32
#: Relative margin by which bounds are widened.
SLACK = 1e-9
#: The largest integer component: 64 squared differences stay below 2**53, where float64 products are exact.
MOST = 1 << 22


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>) of the rows that are kept, each component floor(scale * x) with x as double."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    kept = rows.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(v.isNotNull() & (F.size(v) == width) & ~bad)
    return kept.select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def starts(kept: DataFrame, k: int = CENTROIDS, salt: str = SALT) -> list[list[int]]:
    """The k vectors of the least sha256 of `salt:id`, in that order; a top-k, so each task sends k rows."""
    named = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = kept.select(F.sha2(named, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return [list(r["v"]) for r in first]


def ball_tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """A tree over the rows of points: their order, the points in it, and per ball its range, children and totals."""
    order = np.arange(len(points))
    low, high, left, right = [0], [len(points)], [-1], [-1]
    at = 0
    while at < len(low):
        a, b = low[at], high[at]
        if b - a > LEAF:
            own = points[order[a:b]].astype(np.float64)
            far = own[np.argmax(((own - own.mean(0)) ** 2).sum(1))]
            axis = own[np.argmax(((own - far) ** 2).sum(1))] - far
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own @ axis, half)]
            left[at], right[at] = len(low), len(low) + 1
            low += [a, a + half]
            high += [a + half, b]
            left += [-1, -1]
            right += [-1, -1]
        at += 1
    wide = points[order]
    sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(wide, 0)])
    squares = np.r_[0, np.cumsum((wide * wide).sum(1))]
    tree = {"order": order, "points": wide.astype(np.int16 if np.abs(wide).max() < 1 << 15 else np.int32)}
    tree |= {"low": np.array(low), "high": np.array(high), "left": np.array(left), "right": np.array(right)}
    tree["count"] = tree["high"] - tree["low"]
    tree["sum"], tree["squares"] = sums[high] - sums[low], squares[high] - squares[low]
    tree["centre"] = tree["sum"] / tree["count"][:, None]
    gap = [np.sqrt(((wide[a:b] - c) ** 2).sum(1).max()) for a, b, c in zip(low, high, tree["centre"], strict=True)]
    tree["radius"] = np.array(gap) * (1 + SLACK) + SLACK
    return tree


def filtered(tree: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Balls that go whole and the centroid of each; places of the other vectors and the nearest centroid of each."""
    balls, left = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    c, whole, to, open_, masks = centroids.astype(np.float64), [], [], [], []
    while len(balls):
        far = np.sqrt(((tree["centre"][balls][:, None, :] - c[None, :, :]) ** 2).sum(2))
        far = np.where(left, far, np.inf)
        nearest = (far * (1 + SLACK) + SLACK).min(1) + 2 * tree["radius"][balls]
        left &= far * (1 - SLACK) - SLACK <= nearest[:, None]
        one = left.sum(1) == 1
        whole.append(balls[one])
        to.append(left[one].argmax(1))
        leaf = ~one & (tree["left"][balls] < 0)
        open_.append(balls[leaf])
        masks.append(left[leaf])
        deeper = ~one & ~leaf
        balls, left = np.r_[tree["left"][balls[deeper]], tree["right"][balls[deeper]]], np.r_[left[deeper], left[deeper]]
    leaves = np.concatenate(open_)
    sizes = tree["count"][leaves]
    places = np.arange(sizes.sum()) + np.repeat(tree["low"][leaves] - (np.cumsum(sizes) - sizes), sizes)
    own = tree["points"][places].astype(np.float64)
    # whole numbers below 2**53, so these distances (less a vector's own norm) are exact and ties are ties
    distance = np.where(np.repeat(np.concatenate(masks), sizes, 0), (c * c).sum(1)[None, :] - 2 * (own @ c.T), np.inf)
    return np.concatenate(whole), np.concatenate(to), places, distance.argmin(1)


def totals(tree: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, sum and sum of squared norms of what goes to each centroid."""
    k = len(centroids)
    whole, to, places, near = filtered(tree, centroids)
    own = tree["points"][places].astype(np.int64)
    norms = (own * own).sum(1)
    count, total, squares = np.zeros(k, np.int64), np.zeros((k, own.shape[1]), np.int64), np.zeros(k, np.int64)
    for j in range(k):
        balls, some = whole[to == j], near == j
        count[j] = tree["count"][balls].sum() + some.sum()
        total[j] = tree["sum"][balls].sum(0) + own[some].sum(0)
        squares[j] = tree["squares"][balls].sum() + norms[some].sum()
    return count, total, squares


def nearest(tree: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroid and squared distance of each vector, in the order of the tree's points."""
    whole, to, places, near = filtered(tree, centroids)
    found = np.zeros(len(tree["points"]), np.int32)
    for ball, j in zip(whole, to, strict=True):
        found[tree["low"][ball] : tree["high"][ball]] = j
    found[places] = near
    return found, ((tree["points"].astype(np.int64) - centroids[found]) ** 2).sum(1)


def forest(kept: DataFrame, width: int = WIDTH) -> DataFrame:
    """(tree binary): ball trees over the vectors of each task, in the shared folder."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points = [], []

        def packed() -> pa.RecordBatch:
            every = np.concatenate(points)
            if every.max() > MOST or every.min() < -MOST:
                raise ValueError(f"a component beyond {MOST} after scaling")
            tree = ball_tree(every)
            blob = pickle.dumps(tree | {"ids": [ids[i] for i in tree["order"]]}, protocol=5)
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["tree"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, TREE - len(ids))
                ids += part.column(0).to_pylist()
                points.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
                at += part.num_rows
                if len(ids) >= TREE:
                    yield packed()
                    ids, points = [], []
        if ids:
            yield packed()

    return cut(kept.select("vec_id", "v").mapInArrow(build, "tree binary"))


def _totals(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int], int]]:
    """By centroid: count, sum and sum of squared norms over all trees; at most one row a centroid comes here."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, squares = 0, 0, 0
        for batch in batches:
            for blob in batch.column(0):
                a, b, c = totals(pickle.loads(blob.as_py()), centroids)
                count, total, squares = count + a, total + b, squares + c
        if not isinstance(count, int):
            seen = np.flatnonzero(count)
            sums = pa.array(total[seen].tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(count[seen]), sums, pa.array(squares[seen])], ["c", "n", "s", "q"])

    parts = trees.mapInArrow(work, "c int, n long, s array<long>, q long")
    if not len(centroids):
        return {}
    whole: list[Column] = [F.sum(F.col("s")[i].cast("decimal(38,0)")) for i in range(centroids.shape[1])]
    rows = parts.groupBy("c").agg(F.sum("n").alias("n"), F.array(*whole).alias("s"), F.sum(F.col("q").cast("decimal(38,0)")).alias("q")).collect()
    return {r["c"]: (r["n"], [int(x) for x in r["s"]], int(r["q"])) for r in rows}


def cluster(trees: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after so many rounds; one that nothing is nearest to stays where it is."""
    c = np.array(centroids, np.int64)
    for _ in range(rounds):
        for k, (n, total, _) in _totals(trees, c).items():
            c[k] = [x // n for x in total]
    return c


def assigned(trees: DataFrame, centroids: np.ndarray, id_type: DataType = LongType()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector."""
    of = {k: q - 2 * sum(map(int.__mul__, total, c)) + n * sum(x * x for x in c) for k, (n, total, q) in _totals(trees, centroids).items() for c in [centroids[k].tolist()]}
    inertia = sum(of.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                tree = pickle.loads(blob.as_py())
                to, distance = nearest(tree, centroids)
                own = pa.array([of[k] for k in to.tolist()], pa.int64())
                cols = [pa.array(tree["ids"]), pa.array(to), pa.array(distance), own, pa.array([inertia] * len(to), pa.int64()), pa.array([digests[k] for k in to.tolist()])]
                yield pa.RecordBatch.from_arrays([cols[0].cast(kind), *cols[1:]], ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    kind = to_arrow_type(id_type)
    return trees.mapInArrow(work, f"vec_id {id_type.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def report(rows: DataFrame) -> DataFrame:
    """The clusters of all vectors of embeddings (vec_id, embedding)."""
    kept = vectors(rows)
    trees = forest(kept)
    return assigned(trees, cluster(trees, starts(kept)), kept.schema["vec_id"].dataType)
