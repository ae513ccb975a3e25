"""The stored indexes under random upserts, deletes and merges, against what a scan of all rows gives."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import search
from quern.plans.requests import TextQuery
from quern.sources import ann, lexicon
from quern.sources.ann import VectorIndex
from quern.sources.lexicon import LexicalIndex

TEXTS = "id long, text string"


def text(rnd):
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "épée", "x.y", "rare"]
    return " ".join(rnd.choices(words, [3, 2, 2, 1, 9, 9, 1, 1, 0.2], k=rnd.choice([0, 1, 3, 8, 30, 90])))


QUERIES = ["alpha rare", '"of the" beta', "the of", "missing", '"alpha beta" "the of the"', "épée x.y gamma delta"]


def same(spark, index, live, limit):
    rows = spark.createDataFrame(sorted(live.items()), TEXTS).coalesce(2)
    for q in QUERIES if limit is None else QUERIES[:3]:
        query = TextQuery.parse(q)
        want = sorted((r.id, r.score) for r in search.bm25(rows, query, limit).collect())
        got = sorted((r.id, r.score) for r in index.search(query, limit).collect())
        assert got == want, (q, limit)


@pytest.mark.parametrize("few", [0, 50_000])
def test_lexical_index_under_random_changes(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(lexicon, "FEW", few)
    rnd = random.Random(few)
    live = {i: text(rnd) for i in range(120)}
    index = LexicalIndex(spark, str(tmp_path / "x"))
    index.build(spark.createDataFrame(sorted(live.items()), TEXTS), buckets=4)
    for step in range(4):
        fresh = {rnd.randrange(160): text(rnd) for _ in range(12)}
        gone = rnd.sample(sorted(live), 5)
        live = {i: t for i, t in live.items() if i not in gone} | fresh
        index.upsert(spark.createDataFrame(sorted(fresh.items()), TEXTS), spark.createDataFrame([(i,) for i in gone], "id long"))
        if step == 2:
            index.delete(spark.createDataFrame([(i,) for i in sorted(live)[:3]], "id long"))
            live = dict(sorted(live.items())[3:])
    n, mean = index.counts(index.state())
    assert n == len(live) and abs(mean * n - sum(len(search.split_tokens(t)) for t in live.values())) < 1e-6
    same(spark, index, live, 7)
    assert index.merge() and not index.merge()  # the small ones become one, the first stays
    assert len(index.state()["segments"]) == 2
    same(spark, index, live, 7)
    assert index.merge(whole=True)
    state = index.state()
    assert len(state["segments"]) == 1 and state["segments"][0]["rows"] == len(live) and not state["segments"][0]["dead"]
    same(spark, index, live, None)
    assert len(index.expire(keep=1, grace=0)) >= 6
    same(spark, index, live, 3)


def test_postings_that_cannot_reach_the_top_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexicon, "FEW", 0)
    rows = [(i, "needle " + "hay " * (i % 400)) for i in range(2000)]
    df = spark.createDataFrame(rows, TEXTS)
    index = LexicalIndex(spark, str(tmp_path / "x"))
    index.build(df, buckets=4)
    query = TextQuery.parse("needle")
    got = [(r.id, r.score) for r in index.search(query, 3).collect()]
    assert got == [(r.id, r.score) for r in search.bm25(df, query, 3).collect()]
    assert index.last_read["postings"] == 2000 and index.last_read["read"] < 200
    keep = df.where("id % 400 > 390").select("id")
    got = [(r.id, r.score) for r in index.search(query, 3, keep).collect()]
    assert got == [(r.id, r.score) for r in search.bm25(df, query, 3, F.col("id") % 400 > 390).collect()]


def test_replayed_batches_and_no_texts(spark, tmp_path):
    index = LexicalIndex(spark, str(tmp_path / "x"))
    with pytest.raises(ValueError):
        index.search(TextQuery.parse("a"), 1)
    index.build(spark.createDataFrame([], TEXTS))
    assert index.search(TextQuery.parse("a"), 5).count() == 0
    one = spark.createDataFrame([(1, "a b")], TEXTS)
    for _ in range(2):
        index.upsert(one, batch=("q", 3))
    assert len(index.state()["segments"]) == 2 and index.counts(index.state())[0] == 1
    assert [r.id for r in index.search(TextQuery.parse("b"), 5).collect()] == [1]


def blobs(n, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(20, 16))
    return middles[rng.integers(0, 20, n)] + rng.normal(scale=0.35, size=(n, 16))


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist(), f"g{i % 3}") for i, v in enumerate(x)], "id long, embedding array<float>, path string")


def pairs(rows):
    return {(r.query_id, r.id) for r in rows.collect()}


def test_vector_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "SLICE", 100)  # several slices and blocks a list
    monkeypatch.setattr(ann, "BLOCK", 7)
    rows = vectors(spark, blobs(900))
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.fit(rows, keep=("path",))
    lists = len(index.model(index.state()["config"])[0])
    assert lists == 30
    queries = rows.where("id % 20 = 0")
    want = pairs(search.block_topk(queries, rows, 10))
    assert len(want & pairs(index.search_all(queries, 10))) >= 0.9 * len(want)
    assert 1 <= index.state()["config"]["probes"] < lists
    full = {(r.query_id, r.id, r.score, r["rank"]) for r in index.search_all(queries, 10, probes=lists, refine=50).collect()}
    assert full == {(r.query_id, r.id, r.score, r["rank"]) for r in search.block_topk(queries, rows, 10).collect()}
    q = [float(v) for v in rows.where("id = 40").first().embedding]
    got = index.search(q, 5, probes=lists, refine=40, where=F.col("path") == "g1").collect()
    assert [(r.id, r.score) for r in got] == [(r.id, r.score) for r in search.dense(rows.where("path = 'g1'"), q, 5).collect()]


def test_vector_index_reads_only_probed_lists(spark, tmp_path):
    rows = vectors(spark, blobs(400))
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.fit(rows)
    state = index.state()
    plan = index._lists(state, ["code"], [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
    assert "embedding" not in plan.split("ReadSchema")[1].split("\n")[0]
    kept = {f"list={i}" for i in (1, 2)}
    for name in os.listdir(tmp_path / "v" / state["segments"][0]["folder"] / "rows"):
        if name.startswith("list=") and name not in kept:  # a search that probes lists 1 and 2 does without the others
            for f in os.listdir(d := tmp_path / "v" / state["segments"][0]["folder"] / "rows" / name):
                os.unlink(d / f)
    assert index._lists(state, ["code"], [1, 2]).count() > 0


def test_vector_index_under_changes(spark, tmp_path):
    x = blobs(300)
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.fit(vectors(spark, x), keep=("path",))
    model = index.state()["config"]["model_folder"]
    live = {i: v for i, v in enumerate(x)}
    y = blobs(40, seed=2)
    index.upsert(vectors(spark, y, 290), spark.createDataFrame([(3,), (4,)], "id long"))
    live = {i: v for i, v in live.items() if i not in (3, 4)} | {290 + i: v for i, v in enumerate(y)}
    index.delete(spark.createDataFrame([(300,), (7,)], "id long"))
    live = {i: v for i, v in live.items() if i not in (300, 7)}
    odd = spark.createDataFrame([(900, None, "g"), (901, [0.0] * 16, "g"), (902, [1.0], "g"), (903, [float("nan")] * 16, "g")], "id long, embedding array<float>, path string")
    index.upsert(odd)

    def exact():
        rows = spark.createDataFrame([(i, v.tolist(), "") for i, v in sorted(live.items())], "id long, embedding array<float>, path string")
        queries = rows.where("id % 20 = 0")
        got = {(r.query_id, r.id, r.score) for r in index.search_all(queries, 5, probes=100, refine=40).collect()}
        assert got == {(r.query_id, r.id, r.score) for r in search.block_topk(queries, rows, 5).collect()}
        q = live[290].tolist()
        assert [r.id for r in index.search(q, 4, probes=100, refine=40).collect()] == [r.id for r in search.dense(rows, [float(np.float32(v)) for v in q], 4).collect()]

    exact()
    assert index.state()["config"]["model_folder"] == model and len(index.state()["segments"]) == 4
    assert index.merge(whole=True)
    assert [s["rows"] for s in index.state()["segments"]] == [len(live)]
    exact()
    index.expire(keep=1, grace=0)
    exact()


def test_probes_follow_the_data(spark, tmp_path):
    """Groups far apart need one list or two; noise needs most of them, and the recall holds for both."""
    rng = np.random.default_rng(5)
    apart = np.eye(16)[rng.integers(0, 16, 640)] + rng.normal(scale=0.01, size=(640, 16))
    noise = rng.normal(size=(640, 16))
    found = []
    for name, x in (("apart", apart), ("noise", noise)):
        rows = vectors(spark, x)
        index = VectorIndex(spark, str(tmp_path / name))
        index.fit(rows, lists=16)
        queries = rows.where("id % 20 = 0")
        want = pairs(search.block_topk(queries, rows, 10))
        assert len(want & pairs(index.search_all(queries, 10))) >= 0.9 * len(want)
        found.append(index.state()["config"]["probes"])
    assert found[0] <= 3 < found[1] <= 16


def test_vectors_without_direction(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "v"))
    with pytest.raises(ValueError):
        index.fit(vectors(spark, np.zeros((0, 16))))
    index.fit(vectors(spark, np.zeros((5, 16))))
    assert index.search([1.0] * 16, 3).count() == 0 and index.search_all(vectors(spark, blobs(3)), 2).count() == 0
    index.upsert(vectors(spark, blobs(3)))
    assert index.search([1.0] * 16, 5).count() == 3


def test_near_copies_over_all_lists(spark, tmp_path):
    """A group of near copies that codes cannot tell apart, larger than the candidates, keeps its exact order over all lists."""
    rng = np.random.default_rng(5)
    x = np.concatenate([blobs(300), blobs(1)[:1] + rng.normal(size=(600, 16)) * 1e-3])
    rows = vectors(spark, x)
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.fit(rows)
    queries = rows.where("id % 20 = 0")
    got = {(r.query_id, r.id, r.score, r["rank"]) for r in index.search_all(queries, 6, probes=ann.MOST_LISTS).collect()}
    assert got == {(r.query_id, r.id, r.score, r["rank"]) for r in search.block_topk(queries, rows, 6).collect()}
    q = [float(v) for v in rows.where("id = 400").first().embedding]
    got = index.search(q, 6, probes=ann.MOST_LISTS).collect()
    assert [(r.id, r.score) for r in got] == [(r.id, r.score) for r in search.dense(rows, q, 6).collect()]


def test_few_pairs_of_row_and_list_at_a_time(spark, tmp_path, monkeypatch):
    rows = vectors(spark, blobs(400))
    queries = rows.where("id % 20 = 0")
    seen = []
    for i, held in enumerate((ann.PROBED, 30)):  # all queries of a batch at once, or one at a time
        monkeypatch.setattr(ann, "PROBED", held)
        index = VectorIndex(spark, str(tmp_path / f"v{i}"))
        index.fit(rows)
        seen.append((index.state()["config"]["probes"], pairs(index.search_all(queries, 10))))
    assert seen[0] == seen[1]


def test_words_are_counted_text_by_text():
    """Counting words of a text groups nothing across texts: what one batch gives are whole texts, however it is sliced."""
    import pyarrow as pa

    from quern.sources import lexicon

    texts = [["a", "b", "a"], None, [], ["b"]]
    batch = pa.RecordBatch.from_arrays([pa.array([4, 5, 6, 7]), pa.array(texts, pa.list_(pa.string()))], ["id", "ts"])
    for cut in (batch, batch.slice(1)):
        found = pa.Table.from_batches(lexicon._counted(iter([cut]))).to_pylist()
        want = {"id": 7, "dl": 1, "terms": ["b"], "tfs": [1], "positions": [0]}
        assert found[-1] == want and found[-2]["terms"] == [] and found[-3]["dl"] == 0
    first = pa.Table.from_batches(lexicon._counted(iter([batch])))
    rows = pa.Table.from_batches(lexicon._posted(iter(first.to_batches()))).to_pylist()
    assert sorted((r["term"], r["id"], r["dl"], r["positions"]) for r in rows) == [("a", 4, 3, [0, 2]), ("b", 4, 3, [1]), ("b", 7, 1, [0])]
