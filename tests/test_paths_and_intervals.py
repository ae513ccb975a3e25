"""Folders through the index of path segments, in tables and in the store; points in ranges against brute force."""

import random

import pytest

from quern.operators import intervals, paths
from quern.sources.store import Store

ROWS = "id string, file_path string, embedding array<float>"


def _inside(path: str, folder: str) -> bool:
    have, want = paths.parts_of(path), paths.parts_of(folder)
    return have[: len(want)] == want


def test_segments():
    assert paths.parts_of("/a//./b/../c/") == ["a", "c"] and paths.parts_of("") == []
    with pytest.raises(ValueError):
        paths.parts_of("a/../..")


def test_paths_beneath_folders(spark):
    rng = random.Random(3)
    names = [*{"/".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(150)}, "a/bc", "ab/c", "b/a", "/a/b/x", "", None]
    rows = paths.postings(spark.createDataFrame([(n,) for n in names] + [("a/b",)], "file_path string"))
    for folders in (["a/b"], ["a", "c/c/b"], ["b/a", "a/b/c"], ["a/a/a/a/a/a/a"], ["/a//b/"], []):
        got = [r[0] for r in paths.beneath(rows, folders).collect()]
        assert sorted(got) == sorted({n for n in [*names, "a/b"] if n and any(_inside(n, f) for f in folders)})
    with pytest.raises(ValueError):
        paths.beneath(rows, ["a", "/"])
    assert paths.beneath(rows.limit(0), ["a"]).isEmpty()


def test_a_folder_opens_only_its_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=32)
    assert store.beneath(["a"]) is None and store.buckets_beneath(["a"]) == set()
    made = [(f"i{k}", f"src/m{k % 60}/f{k}.py", [1.0, float(k)]) for k in range(240)]
    store.upsert(spark.createDataFrame(made, ROWS))
    store.upsert(spark.createDataFrame([("new", "src/m7/late.py", [3.0, 3.0]), ("i8", "src/m7/moved.py", [4.0, 4.0])], ROWS))
    got = store.beneath(["src/m7"])
    assert sorted(r.id for r in got.collect()) == sorted(["new", "i8", "i7", "i67", "i127", "i187"])
    opened = store.buckets_beneath(["src/m7"])
    read = {int(f.split("bucket=")[1].split("/")[0]) for f in got.inputFiles() if "bucket=" in f}  # the others are the index's
    assert len(opened) <= 6 and read == opened
    before = store.state()
    store.delete_beneath(["src/m7", "src/m9"])
    after = store.state()
    changed = {p.bucket for p in set(before["parts"]) ^ set(after["parts"])}
    assert len(changed) <= 10 and after["rows"] == before["rows"] - 6 - 4
    left = {r.file_path for r in store.read().collect()}
    assert left == {p for i, p, _ in made if not p.startswith(("src/m7/", "src/m9/")) and i != "i8"}
    store.delete_beneath(["nowhere"])
    assert store.state()["version"] == after["version"]


def test_a_folder_leaves_while_another_writes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    store.upsert(spark.createDataFrame([(f"i{k}", f"d{k % 2}/f{k}", [1.0]) for k in range(20)], ROWS))
    other, made = Store(spark, str(tmp_path / "s"), buckets=4), store._made

    def late(*args):
        out = made(*args)
        if store._made is not made:
            store._made = made
            other.upsert(spark.createDataFrame([("x", "d0/x", [2.0]), ("y", "d1/y", [2.0])] + [(f"z{k}", f"d1/z{k}", [2.0]) for k in range(12)], ROWS))
        return out

    store._made = late
    store.delete_beneath(["d0"])
    assert {r.id for r in store.read().collect()} == {f"i{k}" for k in range(1, 20, 2)} | {"y"} | {f"z{k}" for k in range(12)}


@pytest.mark.parametrize("paired", [0, 64, 10**6])
def test_ranges_around_points(spark, monkeypatch, paired):
    monkeypatch.setattr(intervals, "PAIRED", paired)
    rng = random.Random(5)
    ranges, points = [], [("none", 3), (None, 5), ("f1", None)]
    for p in range(3):
        for i in range((20, 150, 150)[p]):
            a = rng.randint(-5, 900) if p else rng.randint(1, 2**31 - 2000)
            ranges.append((f"f{p}", f"n{i}", i, a, a + rng.choice([-1, 0, 1, 3, 7, 30, 200, 900])))
            points += [(f"f{p}", rng.randint(-10, 1100) if p else a + rng.randint(0, 3))] * rng.randint(1, 2)
    rows = [*ranges, ("f1", "open", 0, None, 9), (None, "lost", 0, 1, 9)]
    q = spark.createDataFrame(points, "path string, line int")
    r = spark.createDataFrame(rows, "path string, node string, seq int, start_line int, end_line int")
    around = {k: [x for x in ranges if x[0] == k[0] and x[3] <= k[1] <= x[4]] for k in points if None not in k}
    around = {k: v for k, v in around.items() if v}
    least = {k: min((e - a, i, n) for _, n, i, a, e in v) for k, v in around.items()}
    got = intervals.smallest_around(q, r).collect()
    assert {(x.path, x.line): (x.span, x.node) for x in got} == {k: (v[0], v[2]) for k, v in least.items()} and len(got) == len(least)
    first = {(x.path, x.line): x.node for x in intervals.first_around(q, r).collect()}
    assert first == {k: min((i, n) for _, n, i, _, _ in v)[1] for k, v in around.items()}
    assert intervals.smallest_around(q, r.limit(0)).isEmpty()
