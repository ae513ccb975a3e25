"""What the lexical index keeps on disk while it is written and merged."""

import random
import time

import pytest

from quern.operators import search
from quern.plans.requests import TextQuery
from quern.sources import lexicon
from quern.sources.lexicon import LexicalIndex

TEXTS = "id long, text string"
WORDS = ["alpha", "beta", "gamma", "of", "the", "x.y", "Épée", "straße", "中文", "-", "$a_1"]


def some(rnd, n, first=0):
    return {first + i: None if i == 3 else " ".join(rnd.choices(WORDS, k=rnd.choice([0, 1, 4, 20, 60]))) for i in range(n)}


def frame(spark, texts):
    return spark.createDataFrame(sorted(texts.items()), TEXTS).coalesce(2)


def left_over(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


@pytest.mark.parametrize("gone", [0, 1000])
def test_merging_leaves_no_shuffle_files(spark, tmp_path, monkeypatch, gone):
    """Few dead ids go to the tasks and postings are not shuffled; many meet the postings in rounds. The results are the same."""
    for name, value in (("GONE", gone), ("HELD", 300), ("BLOCK", 8), ("READ", (1, 1 << 20)), ("TOGETHER", 7)):
        monkeypatch.setattr(lexicon, name, value)
    plans, put = [], LexicalIndex._put

    def seen(blocks, at):
        plan = blocks._jdf.queryExecution().executedPlan().toString()
        plans.append((plan, 0 if "Exchange" in plan else blocks.rdd.getNumPartitions()))
        put(blocks, at)

    rnd = random.Random(gone)
    live = some(rnd, 80)
    before = left_over(spark)
    index = LexicalIndex(spark, str(tmp_path / "x"))
    index.build(frame(spark, live), buckets=8)
    for k in range(3):
        fresh = some(rnd, 20, 15 * k)
        live |= fresh
        index.upsert(frame(spark, fresh))
    index.delete(spark.createDataFrame([(i,) for i in range(0, 80, 6)], "id long"))
    live = {i: t for i, t in live.items() if i % 6}
    monkeypatch.setattr(LexicalIndex, "_put", staticmethod(seen))
    assert index.merge(whole=True)
    if gone:
        [(plan, tasks)] = plans
        assert "Exchange" not in plan and tasks > 1
    else:
        assert len(plans) > 1
    until = time.time() + 20
    while left_over(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not left_over(spark) - before
    assert [s["rows"] for s in index.state()["segments"]] == [len(live)]
    for q in ("alpha", '"of the" beta', "epee x.y", "straße 中文 $a_1", "-"):
        query = TextQuery.parse(q)
        want = sorted((r.id, r.score) for r in search.bm25(frame(spark, live), query, None).collect())
        assert sorted((r.id, r.score) for r in index.search(query, None).collect()) == want, q


def test_terms_share_rows():
    """A term's texts of about one length are one row, cut where it would grow large."""
    import numpy as np
    import pyarrow as pa

    n = 50
    arrays = (np.zeros(n, np.int32), pa.array(["b", "a"] * 25), pa.array(range(n)), pa.array([2] * n, pa.int32()), pa.array([64] * n, pa.int32()), pa.array(range(2 * n), pa.int32()))
    rows = pa.Table.from_batches(lexicon._blocks(iter([arrays]))).to_pylist()
    assert [(r["term"], r["n"], r["most"], r["least"], r["ids"][:2], r["positions"][:4]) for r in rows] == [("a", 25, 2, 64, [1, 3], [2, 3, 6, 7]), ("b", 25, 2, 64, [0, 2], [0, 1, 4, 5])]


def test_an_older_form_is_built_anew(spark, tmp_path):
    index = LexicalIndex(spark, str(tmp_path / "x"))
    index.log.create(None, {"config": {"buckets": 4, "id_type": "bigint"}, "segments": []})
    assert not index.exists()
    with pytest.raises(ValueError, match="older form"):
        index.search(TextQuery.parse("a"), 1)
    index.build(frame(spark, {1: "a"}))
    assert [r.id for r in index.search(TextQuery.parse("a"), 1).collect()] == [1]
