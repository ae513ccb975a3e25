"""Sources, the store, streams, and the contract of the driver."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quern.sources import corpus
from quern.sources.store import Store
from quern.streaming import changes, conversations


def test_scan(spark, tmp_path):
    files = {"src/a.py": "x = 1\n", "src/a.test.py": "y", "node_modules/b.js": "z", "notes.txt": "n", "README.md": "# t", "big.py": "q" * 3000}
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    got = {r.path: r.text for r in corpus.scan(spark, str(tmp_path), most_bytes=2000).collect()}
    assert set(got) == {"src/a.py", "src/a.test.py", "README.md"} and got["src/a.py"] == "x = 1\n"
    assert {r.path for r in corpus.scan(spark, str(tmp_path), tests=False, extensions=["py"]).collect()} == {"src/a.py", "big.py"}
    assert corpus.listing(spark, str(tmp_path)).count() == 6
    t = spark.createDataFrame([("/old/x",), ("/other/x",)], "path string")
    assert {r.path for r in corpus.moved(t, "path", "/old/", "/new/").collect()} == {"/new/x", "/other/x"}


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.read() is None and not store.has_data()
    rows = lambda *r: spark.createDataFrame(r, "id string, file_path string, embedding array<float>")
    store.upsert(rows(("a", "x.py", [1.0, 0.0]), ("b", "y.py", [0.0, 1.0])))
    store.upsert(rows(("a", "x.py", [0.5, 0.5]), ("c", "x.py", [1.0, 1.0])))
    assert {r.id: list(r.embedding) for r in store.read().collect()} == {"a": [0.5, 0.5], "b": [0.0, 1.0], "c": [1.0, 1.0]}
    store.delete_paths(["x.py"])
    assert [r.id for r in store.read().collect()] == ["b"] and store.has_data()
    store.mark("incomplete")
    assert not store.has_data()
    store.upsert(rows(("z", "w.py", [1.0, 2.0, 3.0])))
    assert [r.file_path for r in store.paths().collect()] == ["w.py"] and store.state()["dimension"] == 3
    with pytest.raises(ValueError):
        store.upsert(rows(("q", "w.py", [float("nan")])))
    store.clear()
    assert store.read().count() == 0 and not store.has_data()


def test_change_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", 0, "create", 1), ("a", 100, "change", 2), ("b", 50, "change", 3), ("a", 3000, "delete", 4), ("z", 3_600_000, "create", 5)]
    data = [(p, t0 + dt.timedelta(milliseconds=ms), k, n) for p, ms, k, n in rows]
    schema = "path string, ts timestamp, type string, seq long"
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = changes.watch(events, lambda df, _: seen.extend(df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted((r.path, r.type, r.events) for r in seen) == [("a", "change", 2), ("a", "delete", 1), ("b", "change", 1)]


def test_conversations():
    m = [{"role": "user", "content": "hi"}, {"role": "assistant", "content": [{"type": "text", "text": "x"}]}, {"role": "user", "content": "go"}]
    s = conversations.Sticky(ttl=10)
    s.store(m, now=0)
    assert s.lookup([*m, {"role": "user", "content": "more"}], now=5) == 2 and s.lookup(m, now=11) == 0
    s.sweep(11)
    assert not s.kept and len(conversations.fingerprint(m)) == 16
    assert conversations.trigger(m) == "user-turn" and conversations.trigger(m[:2]) is None
    result = lambda text, **k: {"role": "user", "content": [{"type": "tool_result", "content": text, **k}]}
    uses = {"role": "assistant", "content": [{"type": "tool_use", "name": "t"}] * 5 + [{"type": "tool_use", "name": "advisor"}]}
    assert conversations.trigger([uses, result("Error: x")]) == "tool-error" and conversations.trigger([uses, result("ok")]) == "tool-count"
    assert conversations.trigger([uses, uses, {"role": "assistant", "content": [{"type": "tool_use", "name": "t"}]}, result("ok")]) is None
    f = conversations.Framer()
    got = [x for piece in (b"event: a\r\nda", b"ta: {\"x\":", b"1}\n\n: c\n", b"rest") for x in f.feed(piece)]
    assert got == [("event", "a"), ("data", '{"x":1}'), ("", ""), ("", ": c")] and f.rest == b"rest"


def test_markers(spark):
    t = spark.createDataFrame([("\n \nGO now",), (" GO",), ("x\nGO",)], "t string")
    assert [r.m for r in t.select(conversations.marker(F.col("t"), "(GO|STAY)").alias("m")).collect()] == ["GO", "", ""]
    odd = spark.createDataFrame([("GOö",), ("GOt",), ("GO",), ("\x0b\nGO",), (" \f\r\nGO.",)], "t string")
    assert [r.m for r in odd.select(conversations.marker(F.col("t"), "(GO|STAY)").alias("m")).collect()] == ["GO", "", "GO", "", "GO"]


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
