"""The front, caches, configuration, display, late chunking and stateful streams."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.api import Engine
from quern.operators import caches, display, late
from quern.plans.config import Config, as_json, layered, pooling_layer, query_prefix
from quern.streaming import stateful

GREET = "def greet(name):\n    message = 'hello ' + name\n" + "".join(f"    step_{i} = message + str({i})\n" for i in range(8)) + "    return shout(message)\n\n\ndef shout(text):\n    return text.upper()\n"


def test_engine(spark, tmp_path):
    root = tmp_path / "ws"
    (root / "src").mkdir(parents=True)
    (root / "src/hello.py").write_text(GREET)
    (root / "src/other.py").write_text("from .hello import greet\n\ndef main():\n" + "".join(f"    value_{i} = {i} * {i}\n" for i in range(12)) + "    return greet('x')\n")
    (root / "README.md").write_text("# Demo\n\n" + "This project greets people in many ways. " * 6)
    e = Engine(spark, str(tmp_path / "store"), Config(dimension=32))
    assert e.index(str(root), dry_run=True) == {"new": 3} and not e.store.has_data()
    assert e.index(str(root)) == {"new": 3}
    hits = e.search("greet shout message", limit=2).collect()
    assert hits and any(h.path == "src/hello.py" for h in hits)
    assert {h.path for h in e.search("greet", paths=["*.md"]).collect()} == {"README.md"}
    (root / "src/hello.py").unlink()
    (root / "README.md").write_text("# Demo\n\n" + "Now it says goodbye to everyone in every way. " * 6)
    assert e.index(str(root)) == {"changed": 1, "deleted": 1, "unchanged": 1}
    assert sorted(r.file_path for r in e.store.paths().collect()) == ["README.md", "src/other.py"]
    assert "goodbye" in display.search_text(e.search("goodbye"), "goodbye") and json.loads(display.search_json(e.search("goodbye"), "goodbye"))["total"] >= 1
    (root / "src/hello.py").write_text(GREET)
    assert "1--11 | function greet" in e.outline(str(root), ["hello*"])["src/hello.py"]
    got = {(r.direction, r.id, r.depth) for r in e.call(str(root), ["greet"]).collect()}
    assert {("callees", "src/hello.shout", 1), ("callers", "src/other.main", 1)} <= got
    chain = e.call(str(root), ["main", "shout"]).collect()
    assert all(r.length >= 1 for r in chain)
    assert e.highlight("a line\nthe greet line\nnothing", "greet", 1) == "   2  the greet line"


def test_configuration():
    c = layered('{"search_limit": 7, // few\n "model": "a//b", }', '{"model": null, "sparse_weight": 0.5}')
    assert (c.search_limit, c.model, c.sparse_weight) == (7, "a//b", 0.5) and json.loads(as_json(c))["dimension"] == 64
    with pytest.raises(ValueError):
        layered('{"nope": 1}')
    assert query_prefix("x", "llamacpp", "jina-v5-small") == "Query: x" and query_prefix("Query: x", "llamacpp", "jina-v5") == "Query: x" and query_prefix("x", "other") == "x"
    assert [pooling_layer(s, 24) for s in (None, "last", "-2", "3", "1/2", "24/24")] == [23, 23, 22, 3, 11, 23]
    with pytest.raises(ValueError):
        pooling_layer("99", 24)


def test_caches(spark, tmp_path):
    now, old = dt.datetime.now(), dt.datetime.now() - dt.timedelta(days=40)
    cache = spark.createDataFrame([("a", "1", "v1", 5, 10, now), ("b", "1", "v1", 5, 10, old), ("c", "1", "v0", 5, 10, now), ("d", "0", "v1", 5, 10, now), ("e", "1", "v1", 5000, 10, now)],
                                  "path string, file_hash string, fingerprint string, n_nodes int, size long, analysed timestamp")
    files = spark.createDataFrame([(p, "1") for p in "abcdef"], "path string, file_hash string")
    assert [r.path for r in caches.valid_analyses(cache, files, "v1").collect()] == ["a"]
    assert sorted(r.path for r in caches.to_analyse(cache, files, "v1").collect()) == list("bcdef")
    blocks = spark.createDataFrame([("f", "x", "1"), ("f", "x", "2"), ("f", "x", "3")], "file string, file_hash string, code_hash string")
    have = spark.createDataFrame([("f", "1", "p", "one"), ("f", "2", "q", "two")], "file string, code_hash string, fingerprint string, summary string")
    states = caches.summary_states(blocks, have, "p")
    assert {r.code_hash: (r.state, r.summary) for r in states.collect()} == {"1": ("hit", "one"), "2": ("stale", None), "3": ("miss", None)}
    assert caches.hit_rates(states).first().hits == 1
    fresh = spark.createDataFrame([("f", "1", "s" * 6000), ("f", "2", "ok")], "file string, code_hash string, summary string")
    assert [r.code_hash for r in caches.storable_summaries(fresh).collect()] == ["2"]
    for name in ("index/p1/a.json", "index/p1/b.json", "summary/p2/c.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("xy")
    assert [(r.kind, r.project, r.files, r.bytes) for r in caches.inventory(spark, str(tmp_path)).collect()] == [("index", "p1", 2, 4), ("summary", "p2", 1, 2)]


def test_display():
    assert display.width("a日e\u0301") == 4 and display.table([["日", "x"], ["abc", "y"]]) == "日   x\nabc  y"


def test_late_chunks(spark):
    assert late.windows([50, 40, 10, 200, 5], 100) == [[0, 1], [2], [3], [4]]
    assert late.spans(["a b", "c"], str.split) == [(0, 2), (2, 3)]
    v = np.array([[1.0, 0.0], [0.0, 1.0]])
    assert np.allclose(late.pooled(v, (0, 2)), [2**-0.5] * 2) and np.allclose(late.pooled(v, (0, 2), "last"), [0, 1])
    chunks = spark.createDataFrame([("f", 1, 1, "a b"), ("f", 2, 5, "c")], "file_path string, id long, start_line int, content string")
    rows = late.late_chunks(chunks, str.split, lambda t: [[float(ord(w[0])), 1.0] for w in t.split()]).collect()
    assert {r.id for r in rows} == {1, 2} and all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in rows)


def run(df, mode="append"):
    q = df.writeStream.format("memory").queryName("seen").outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table("seen").collect()


def test_stateful_streams(spark, tmp_path):
    pieces = [("s", 1, b"event: a\nda"), ("s", 2, b"ta: 1\nrest"), ("t", 1, b"data: z\n")]
    for i, p in enumerate(pieces):
        spark.createDataFrame([p], "stream string, seq long, piece binary").coalesce(1).write.parquet(str(tmp_path / f"p/{i}"))
    schema = "stream string, seq long, piece binary"
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "p"))
    assert sorted((r.stream, r.field, r.value) for r in run(stateful.framed(src))) == [("s", "data", "1"), ("s", "event", "a"), ("t", "data", "z")]
    t0 = dt.datetime(2024, 1, 1)
    reqs = [("k", t0, True), ("k", t0 + dt.timedelta(seconds=100), False), ("k", t0 + dt.timedelta(seconds=500), False), ("m", t0, False)]
    spark.createDataFrame(reqs, "key string, at timestamp, upgraded boolean").coalesce(1).write.parquet(str(tmp_path / "r"))
    src = spark.readStream.schema("key string, at timestamp, upgraded boolean").parquet(str(tmp_path / "r"))
    assert sorted((r.key, (r.at - t0).seconds, r.known) for r in run(stateful.sticky(src))) == [("k", 0, False), ("k", 100, True), ("k", 500, False), ("m", 0, False)]
    blocks = spark.createDataFrame([("s", 0, 0), ("s", 1, 0), ("s", 1, 1)], "stream string, part int, index int")
    assert [r.block for r in stateful.renumbered(blocks).orderBy("part", "index").collect()] == [0, 1, 2]
    rows = spark.createDataFrame([(True, True, ""), (False, True, ""), (False, False, "UP"), (False, False, "")], "advisor_mode boolean, known boolean, marker string")
    assert [r.route for r in stateful.route(rows).select(F.col("route")).collect()] == ["advisor", "upper", "switch", "lower"]
