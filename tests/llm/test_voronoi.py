"""The recursion over Voronoi cells alone, and the whole join where regions are large, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import jaccard_join as j
from quern.llm.common import connected, cut
from quern.llm.shingles import class_of, shingle_set


def words(rng, n):
    return [rng.choice("bcdfglmnprst") + rng.choice("aeiou") + rng.choice("xyz") + str(rng.randrange(30)) for _ in range(n)]


def corpus(seed, clusters, size, passage):
    """Clusters of edited copies, most of them around one text, some in chains; all share a passage of so many words."""
    rng = random.Random(seed)
    shared, texts = words(rng, passage), []
    for c in range(clusters):
        base = words(rng, 60)
        for i in range(size):
            own = base if c % 3 else texts[-1].split()[passage:] if i else base  # every third cluster drifts along a chain
            texts.append(" ".join(shared + [w if rng.random() > 0.03 else rng.choice("uvw") + str(rng.randrange(99)) for w in own]))
    return texts + [" ".join(shared + words(rng, 60)) for _ in range(size)]


def brute(texts):
    sets = [set(map(int, shingle_set(t))) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(texts)):
        for y in range(x):
            if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def same(found, want):
    """Whether two labellings are the same partition."""
    return len(set(zip(found, want, strict=True))) == len(set(found)) == len(set(want))


@pytest.mark.parametrize(("seed", "clusters", "size", "passage", "leaf", "helps"), [(1, 6, 25, 40, 4, 0.75), (2, 5, 30, 3, 2, 0.95), (3, 1, 60, 0, 4, 0.1), (4, 8, 12, 80, 32, 0.75)])
def test_voronoi_cells_against_brute_force(spark, monkeypatch, seed, clusters, size, passage, leaf, helps):
    for name, value in (("LEAF", leaf), ("HELPS", helps), ("MEASURED_TOGETHER", 16), ("OUTSIDE_BLOCK", 512), ("HOME_BLOCK", 2048)):
        monkeypatch.setattr(j, name, value)
    texts = list(dict.fromkeys(corpus(seed, clusters, size, passage)))
    sets = [shingle_set(t) for t in texts]
    names = [class_of(s) for s in sets]
    held = spark.createDataFrame([(n, bytearray(s.tobytes())) for n, s in zip(names, sets, strict=True)], "node long, shingles binary").repartition(3)
    split = []
    tests = j._tests
    monkeypatch.setattr(j, "_tests", lambda cells: split.append(1) or tests(cells))
    region = held.select(F.lit(7).cast("long").alias("cell"), "node", (F.length("shingles") / 8).cast("int").alias("n"))
    links = cut(j.voronoi(region, held))
    real = {frozenset(x) for x in links.collect() if x[0] != x[1]}
    number = {n: i for i, n in enumerate(names)}
    for x, y in map(tuple, real):  # every link is one
        a, b = sets[number[x]], sets[number[y]]
        common = len(np.intersect1d(a, b))
        assert 100 * common >= 75 * (len(a) + len(b) - common)
    roots = {r.node: r.root for r in connected(links).collect()}
    assert same([roots.get(n, n) for n in names], brute(texts))
    assert len(split) >= 2


@pytest.mark.parametrize("hot", [1, 1 << 40])
def test_the_join_with_large_regions(spark, monkeypatch, hot):
    """Regions that lie in many tasks (hot) and others, and that both are entered."""
    for name, value in (("LEAF", 6), ("HOT", hot), ("FREQUENT", 2), ("MEASURED_TOGETHER", 16)):
        monkeypatch.setattr(j, name, value)
    entered = []
    voronoi = j.voronoi
    monkeypatch.setattr(j, "voronoi", lambda regions, sets: entered.append(regions.count()) or voronoi(regions, sets))
    texts = corpus(9, 7, 22, 20)
    texts += texts[:30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in j.components(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    assert entered and entered[0] > 20


def test_links_of_a_block_are_fewer_than_its_texts():
    import pyarrow as pa

    from quern.llm import jaccard_join as J

    rng = np.random.default_rng(3)
    groups = [rng.integers(0, 1 << 62, 100, dtype=np.uint64) for _ in range(2)]
    sets = [np.sort(np.r_[groups[i % 2], rng.integers(0, 1 << 62, 5, dtype=np.uint64)]) for i in range(40)]
    rows = [(side, i, i, [], sets[i].tobytes()) for i in range(40) for side in (0, 1)]
    group = pa.table(dict(zip(("side", "node", "root", "far", "shingles"), map(list, zip(*rows, strict=True)), strict=True)))
    links = [(a, b) for out in J._cells(group) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
    assert len(links) == 38 and all((a - b) % 2 == 0 for a, b in links)
    joined = J.Joined()
    assert all(joined.add(a, b) for a, b in links)
    assert len({joined.root(i) for i in range(40)}) == 2
