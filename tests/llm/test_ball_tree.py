"""Centroid clustering against a plain reading of its contract."""

import hashlib
import random

import numpy as np
import pytest

from quern.llm import ball_tree

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    kept = [(i, [int(np.floor(64 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:16]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(3):
        to = [near(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            own = [v for (_, v), t in zip(kept, to) if t == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own)]
    last = [near(v) for _, v in kept]
    inertia = {k: sum(d for d, t in last if t == k) for k in range(16)}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, k, d, inertia[k], sum(inertia.values()), shas[k]) for (i, _), (d, k) in zip(kept, last)]


def data(kind: str):
    rnd = random.Random(kind)
    if kind == "blobs":
        middles = [[rnd.uniform(-1, 1) for _ in range(64)] for _ in range(9)]
        return [(i, [x + rnd.gauss(0, 0.05) for x in rnd.choice(middles)]) for i in range(700)]
    if kind == "noise":
        return [(i, [rnd.gauss(0, 0.2) for _ in range(64)]) for i in range(400)]
    if kind == "copies":  # a common vector, few others, many ties, repeated and null ids
        few = [[rnd.choice([-0.5, 0.0, 0.5]) if j < 3 else 0.0 for j in range(64)] for _ in range(12)]
        return [(rnd.choice([None, i % 50]), few[0] if i % 3 else rnd.choice(few)) for i in range(500)]
    if kind == "few":
        return [(i, [float(i)] * 64) for i in range(5)]
    odd = [None, [], [1.0] * 63, [1.0] * 65, [None] + [0.0] * 63, [float("nan")] * 64, [float("-inf")] + [0.0] * 63]
    return [(i, v) for i, v in enumerate(odd)] + [(i, [rnd.uniform(-3, 3) for _ in range(64)]) for i in range(40)]


@pytest.mark.parametrize("kind", ["blobs", "noise", "copies", "few", "odd"])
def test_equals_plain_rounds(spark, kind):
    rows = data(kind)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    found = sorted(map(tuple, ball_tree.report(df).collect()), key=str)
    assert found == sorted(plain(rows), key=str)


def test_empty(spark):
    assert ball_tree.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_balls_are_used(spark):
    rnd = np.random.default_rng(3)
    points = np.concatenate([rnd.normal(c, 1, (500, 64)) for c in (-40, 0, 40)]).round().astype(np.int64)
    tree = ball_tree.ball_tree(points)
    centroids = np.array([[-40] * 64, [0] * 64, [40] * 64])
    whole, to, places, _ = ball_tree.filtered(tree, centroids)
    assert len(places) <= 4 * ball_tree.LEAF and len(whole) < 60  # only the balls across two groups are opened
    assert ball_tree.totals(tree, centroids)[0].tolist() == [500, 500, 500]


def test_many_trees_and_large_components(spark, monkeypatch):
    monkeypatch.setattr(ball_tree, "TREE", 50)
    rows = data("blobs")
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert sorted(map(tuple, ball_tree.report(df).collect())) == sorted(plain(rows))
    with pytest.raises(Exception, match="after scaling"):
        ball_tree.report(spark.createDataFrame([(1, [1e30] * 64, 0)], SCHEMA)).collect()
