"""Greedy packing against the loop that it stands for."""

import random

import pytest

from quern.operators import chunk, packing


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_equals_the_loop(spark, seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([0, 1, 5, 30, 60, 99, 100, 101, 5000]) if seed else 1 for _ in range(rnd.randint(150, 400))]
    rows = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "k long, size int, batch_of string").repartition(5)
    got = {r.k: r.batch for r in packing.batches(rows, ["k"], most=[7, 100, 250, 10_000][seed], each=100).collect()}
    assert [got[i] for i in range(len(sizes))] == chunk.batches(sizes, most=[7, 100, 250, 10_000][seed], each=100)


def test_edges(spark):
    schema = "k long, size long"
    assert packing.batches(spark.createDataFrame([], schema), ["k"]).count() == 0
    only = spark.createDataFrame([(1, 9000), (2, None)], schema)
    assert [r.batch for r in packing.batches(only, ["k"]).collect()] == [None, None]
    rows = spark.createDataFrame([(1, 60), (2, 9000), (3, 40), (4, None), (5, 1)], schema)
    got = {r.k: r.batch for r in packing.batches(rows, ["k"], most=100, each=100).collect()}
    assert got == {1: 0, 2: None, 3: 0, 4: None, 5: 1}

