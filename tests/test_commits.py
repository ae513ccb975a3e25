"""The commit log and the store on it: writers at once, replayed batches, conflicts in all orders, expiry."""

import os
import threading

import pytest

from quern.sources.commits import Conflict, Log
from quern.sources.store import Store

ROWS = "id string, file_path string, embedding array<float>"


def rows(spark, *numbers, value=1.0):
    return spark.createDataFrame([(f"i{n}", f"p{n}.py", [value, float(n)]) for n in numbers], ROWS)


def held(store):
    return {r.id: r.embedding[0] for r in store.read().collect()}


def test_one_creator(spark, tmp_path):
    log = Log(spark, str(tmp_path / "s"))
    assert log.latest() is None
    first = log.create(None, {"n": 0})
    with pytest.raises(Conflict):
        log.create(None, {"n": 1})
    won = []

    def race(k):
        try:
            log.create(first, {"n": k})
            won.append(k)
        except Conflict:
            pass

    threads = [threading.Thread(target=race, args=(k,)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and log.latest()["state"] == {"n": won[0]}
    for _ in range(3):
        log.update(lambda s: {"n": s["n"] + 1})
    assert log.latest()["state"]["n"] == won[0] + 3
    assert not [f for f in os.listdir(tmp_path / "s/_log") if f.startswith(".") and not f.endswith(".crc")]


def test_two_writers_lose_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    store.upsert(rows(spark, *range(8)))
    failed = []

    def write(numbers, value):
        try:
            Store(spark, str(tmp_path / "s"), buckets=4).upsert(rows(spark, *numbers, value=value))
        except Exception as e:  # shown below
            failed.append(e)

    threads = [threading.Thread(target=write, args=([20 + k, k], 2.0 + k)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    assert held(store) == {f"i{n}": 1.0 for n in range(8)} | {f"i{n}": 2.0 + n % 20 for n in (0, 1, 2, 20, 21, 22)}
    assert store.state()["rows"] == 11 and not [f for f in os.listdir(tmp_path / "s") if f.startswith("new-")]


@pytest.mark.parametrize("other", [[5], [0], [100]])
def test_overtaken_between_reading_and_commit(spark, tmp_path, monkeypatch, other):
    """Another writer commits while the first has its files ready: on other buckets, on the same row, with a new row."""
    store, second = Store(spark, str(tmp_path / "s"), buckets=64), Store(spark, str(tmp_path / "s"), buckets=64)
    store.upsert(rows(spark, *range(6)))
    made, calls = store._made, []

    def slow(*args):
        out = made(*args)
        if not calls:
            second.upsert(rows(spark, *other, value=7.0))
        calls.append(1)
        return out

    monkeypatch.setattr(store, "_made", slow)
    store.write(rows(spark, 0, value=3.0), spark.createDataFrame([("p4.py",)], "file_path string"))
    want = {f"i{n}": 1.0 for n in (0, 1, 2, 3, 5)} | {f"i{n}": 7.0 for n in other} | {"i0": 3.0}
    assert held(store) == want
    assert len(calls) == (2 if other == [0] else 1)  # files are written anew only where the writers met


def test_an_id_that_another_writer_moved(spark, tmp_path, monkeypatch):
    store, second = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    store.upsert(rows(spark, 1, 2))
    made, calls = store._made, []

    def slow(*args):
        out = made(*args)
        if not calls:
            second.upsert(spark.createDataFrame([("i9", "theirs.py", [5.0, 5.0])], ROWS))
        calls.append(1)
        return out

    monkeypatch.setattr(store, "_made", slow)
    store.upsert(spark.createDataFrame([("i9", "mine.py", [6.0, 6.0])], ROWS))
    assert [(r.id, r.file_path) for r in store.read().where("id = 'i9'").collect()] == [("i9", "mine.py")]


def test_replayed_batches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.upsert(rows(spark, 1), batch=("q", 0))
    store.upsert(rows(spark, 1, value=4.0), batch=("q", 1))
    version = store.state()["version"]
    store.upsert(rows(spark, 1, value=9.0), batch=("q", 0))
    store.upsert(rows(spark, 1, value=9.0), batch=("q", 1))
    assert held(store) == {"i1": 4.0} and store.state()["version"] == version
    store.upsert(rows(spark, 2), batch=("other", 0))
    store.mark("error")
    assert store.state()["state"] == "error" and len(held(store)) == 2


def test_a_stream_that_starts_again(spark, tmp_path):
    src, store = tmp_path / "in", Store(spark, str(tmp_path / "s"))
    seen = []

    def run():
        def each(df, number):
            seen.append(number)
            store.upsert(df, batch=("stream", number))

        q = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(src))
        q = q.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    for n in range(2):
        rows(spark, n).coalesce(1).write.mode("append").parquet(str(src))
    run()
    version = store.state()["version"]
    for f in os.listdir(tmp_path / "c/commits"):  # as if the driver had died before Spark noted the last batch
        if f.strip(".").split(".")[0] == "1":
            os.unlink(tmp_path / "c/commits" / f)
    run()
    assert seen.count(1) == 2 and store.state()["version"] == version and held(store) == {"i0": 1.0, "i1": 1.0}


def test_expiry(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    for k in range(4):
        store.upsert(rows(spark, 1, 2, value=float(k)))
    os.makedirs(tmp_path / "s/new-of-a-writer-at-work")
    assert store.expire(keep=2) == []
    assert held(store) == {"i1": 3.0, "i2": 3.0} and {r.embedding[0] for r in store.read(2).collect()} == {2.0}
    gone = store.expire(keep=1, grace=0)
    assert "new-of-a-writer-at-work" in gone and len(gone) >= 3
    left = {p.folder for p in store.state()["parts"]}
    assert {f for f in os.listdir(tmp_path / "s") if not f.startswith(("_", "."))} == left and len(held(store)) == 2
