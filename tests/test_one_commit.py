"""The store's single commits, the front's trees and connections, refusals, highlighters, summary caches, import maps."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.api import Engine
from quern.operators import caches, graph, rerank
from quern.plans.config import Config
from quern.sources import corpus
from quern.sources.store import Store
from quern.streaming.changes import Progress

ROWS = "id string, file_path string, embedding array<float>"


def test_a_write_touches_only_its_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=8)
    store.upsert(spark.createDataFrame([(f"i{k}", f"p{k}.py", [1.0, float(k)]) for k in range(40)], ROWS))
    before = {p.bucket: p.folder for p in store.state()["parts"]}
    gone = spark.createDataFrame([("p3.py",)], "file_path string")
    store.write(spark.createDataFrame([("i5", "p5.py", [9.0, 9.0])], ROWS), gone)
    after = {p.bucket: p.folder for p in store.state()["parts"]}
    assert sum(before[b] != after.get(b) for b in before) <= 2 and len(before) > 4
    rows = {r.id: list(r.embedding) for r in store.read().collect()}
    assert len(rows) == 39 == store.state()["rows"] and rows["i5"] == [9.0, 9.0] and "i3" not in rows
    store.upsert(spark.createDataFrame([("i7", "elsewhere.py", [2.0, 2.0])], ROWS))
    assert [r.file_path for r in store.read().where("id = 'i7'").collect()] == ["elsewhere.py"]


def test_the_front(spark, tmp_path):
    class Counted(rerank.HashingEmbedder):
        def embed(self, texts: pd.Series) -> pd.Series:
            with open(tmp_path / "calls", "a") as f:
                f.write("x" * len(texts))
            return super().embed(texts)

    root = tmp_path / "ws"
    root.mkdir()
    body = "".join(f"    value_{i} = {i} * {i}\n" for i in range(12))
    (root / "a.py").write_text(f"def one():\n{body}    return two()\n\n\ndef two():\n{body}    return three()\n\n\ndef three():\n{body}    return 1\n")
    e = Engine(spark, str(tmp_path / "store"), Config(dimension=8), Counted(8))
    assert e.status() == "standby"
    e.index(str(root))
    assert e.status() == "indexed" and len((tmp_path / "calls").read_text()) == e.store.state()["rows"] == 3
    text = e.described(str(root), "two")
    assert "└── a.three" in text and "└── a.one" in text and text.startswith("a.two L")
    got = {(r.kind, r.src, r.dst) for r in e.connections(str(root), ["one", "two"]).collect()}
    assert {("direct", "a.one", "a.two"), ("involved", "a.one", None), ("matched", "a.two", None)} <= got


def test_refused_folders(spark):
    assert corpus.refused("/") and corpus.refused(os.path.expanduser("~")) and not corpus.refused("/srv/x")
    assert [r.path for r in corpus.listing(spark, "/").collect()] == ["/"]
    with pytest.raises(ValueError):
        corpus.scan(spark, "/")


def test_highlights_and_progress(spark):
    hits = spark.createDataFrame([(1, "a\nthe word\nb"), (2, "none"), (3, None)], "id int, content string")
    got = {r.id: r.highlighted for r in rerank.highlighted(hits, "Word", rerank.OverlapHighlighter()).collect()}
    assert got == {1: "the word", 2: "", 3: ""}
    said = []
    p = Progress(lambda n, seen: said.append((n, seen)))
    for n in (3, 2, 0):
        p.onQueryProgress(type("E", (), {"progress": type("P", (), {"numInputRows": n})}))
    assert said == [(3, 3), (2, 5), (0, 0)]


def test_summary_cache_by_file_hash_and_size(spark):
    blocks = spark.createDataFrame([("f", "h1", "a"), ("f", "h1", "b"), ("g", "h2", "a")], "file string, file_hash string, code_hash string")
    cache = spark.createDataFrame([("f", "h1", "a", "p", "A"), ("g", "old", "z", "p", "Z")], "file string, file_hash string, code_hash string, fingerprint string, summary string")
    got = {(r.file, r.code_hash): (r.state, r.summary) for r in caches.summary_states(blocks, cache, "p").collect()}
    assert got == {("f", "a"): ("hit", "A"), ("f", "b"): ("hit", None), ("g", "a"): ("miss", None)}
    fresh = spark.range(400).select(F.lit("big").alias("file"), F.col("id").cast("string").alias("code_hash"), F.lit("s" * 4000).alias("summary"))
    fresh = fresh.union(spark.createDataFrame([("small", "1", "s")], fresh.schema))
    assert [r.file for r in caches.storable_summaries(fresh).collect()] == ["small"]
    listed = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "p")], "kind string, project string")
    assert sorted(r.kind for r in caches.chosen(listed, "1,3").collect()) == ["a", "c"]


def test_import_map(spark):
    calls = spark.createDataFrame([(1, "fmt"), (2, "u.go.on"), (3, "x.y"), (4, "u")], "n int, callee string")
    names = spark.createDataFrame([("fmt", "lib/f.fmt"), ("u", "lib/u")], "name string, target string")
    assert {r.n: r.callee for r in graph.imported(calls, names).collect()} == {1: "lib/f.fmt", 2: "lib/u.go.on", 3: "x.y", 4: "lib/u"}
