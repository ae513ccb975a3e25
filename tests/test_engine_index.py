"""The engine's lexical index follows the tree: segments come with each run, searches equal a scan of the chunks."""

import pytest

from quern.api import Engine
from quern.operators import search
from quern.plans.config import Config
from quern.plans.requests import TextQuery, leg_budgets
from quern.queries import search as queries
from quern.sources.tables import snapshot


def body(name, word, n=14):
    return f"def {name}():\n" + "".join(f"    {word}_{i} = lookup({i})\n" for i in range(n)) + f"    return {word}_0\n"


def test_index_and_search(spark, tmp_path):
    root = tmp_path / "ws"
    root.mkdir()
    for i in range(5):
        (root / f"m{i}.py").write_text(body(f"fn{i}", f"apple{i}"))
    e = Engine(spark, str(tmp_path / "store"), Config(dimension=8))
    assert e.index(str(root))["new"] == 5 and e.status() == "indexed"

    def check():
        rows = e.store.read().select("id", "content").withColumnRenamed("content", "text")
        for q in ("lookup", "apple3_1", '"lookup 3" apple1_2', "nothing"):
            query, n = TextQuery.parse(q), leg_budgets(20)[1]
            assert sorted(map(tuple, e.lexicon.search(query, n).collect())) == sorted(map(tuple, search.bm25(rows, query, n).collect())), q

    check()
    (root / "m1.py").write_text(body("other", "pear"))
    (root / "m2.py").unlink()
    (root / "m9.py").write_text(body("fn9", "plum"))
    assert e.index(str(root)) == {"changed": 1, "deleted": 1, "new": 1, "unchanged": 3} or len(e.lexicon.state()["segments"]) == 2
    check()
    hits = e.search("plum_3 fn9", limit=3).collect()
    assert hits[0].path == "m9.py"
    assert {r.path for r in e.search("pear_1", ["m9*"]).collect()} == {"m9.py"}
    before = e.lexicon.state()
    e.index(str(root))
    assert e.lexicon.state() == before  # nothing changed, no segment came
    for k in range(4):
        (root / f"extra{k}.py").write_text(body(f"extra{k}", f"fig{k}"))
        e.index(str(root))
    assert len(e.lexicon.state()["segments"]) < 6  # neighbours were merged
    check()


def test_search_reads_no_text(spark, tmp_path, monkeypatch):
    root = tmp_path / "ws"
    root.mkdir()
    (root / "a.py").write_text(body("fn", "kiwi"))
    e = Engine(spark, str(tmp_path / "store"), Config(dimension=8))
    e.index(str(root))
    monkeypatch.setattr(search, "bm25", lambda *a, **k: pytest.fail("a scan"))
    assert [r.path for r in e.search("kiwi_1").collect()] == ["a.py"]


def test_another_table_gets_another_index(spark, tmp_path):
    where = str(tmp_path / "documents.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "worthless estion", "en", "s", 1)], schema).write.parquet(where)
    first = snapshot(spark, str(tmp_path), "documents")
    assert [r.id for r in queries.indexed_topk(spark, str(tmp_path)).collect()] == [1]
    spark.createDataFrame([(2, "worthless estion thing", "en", "s", 1)], schema).write.mode("append").parquet(where)
    assert snapshot(spark, str(tmp_path), "documents") != first
    assert [r.id for r in queries.indexed_topk(spark, str(tmp_path)).collect()] == [2, 1]
