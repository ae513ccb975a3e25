"""Prefixes and thresholds by model, file patterns, clearing of caches, reranking and summaries in batches."""

import json
import re

import pandas as pd
import pytest

from quern.api import Engine
from quern.operators import caches, models, rerank
from quern.plans.config import MODEL_MIN_SCORES, Config, document_prefix, query_prefix
from quern.plans.requests import effective_min_score, file_glob


def test_prefixes_and_thresholds():
    long = "Instruct: Given a search query, retrieve relevant passages that answer the query.\nQuery: "
    assert query_prefix("x", "ollama", "qwen3-embedding:4b") == long + "x" == query_prefix(long + "x", "ollama", "qwen3-embedding:4b")
    assert query_prefix("x", "ollama", "nomic-embed-text") == "x" == query_prefix("x", "llamacpp-llm", "any")
    assert query_prefix("x", "llamacpp-llm", "any", instruct=True) == long + "x"
    assert query_prefix("x", "llamacpp-llm", "F2LLM-v2", instruct=True) == "Instruct: find relevant passages\nQuery: x"
    assert query_prefix("x", "llm2vec") == "Generate a passage that best answers this question: x"
    assert document_prefix("llm2vec") == "Summarize the following passage: " and document_prefix("ollama", "qwen3-embedding:4b") == ""
    assert document_prefix("llamacpp", "models/jina-embeddings-v5-small.gguf") == "Query: "
    assert (document_prefix("llamacpp-llm", "jina-embeddings-v5"), document_prefix("llamacpp-llm", "jina-embeddings-v5", True)) == ("", "Query: ")
    assert effective_min_score(None, MODEL_MIN_SCORES.get("all-minilm")) == 0.5 and effective_min_score(None, MODEL_MIN_SCORES.get("unknown")) == 0.4


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("*.py", ["a.py", "x/y/a.py"], ["a.pyc", "a.py/b"]),
        ("src/*.ts", ["src/a.ts"], ["src/b/a.ts", "lib/src/a.ts"]),
        ("src/**/*.{ts,js}", ["src/a.ts", "src/b/c/a.js"], ["src/a.go"]),
        ("[!a]?.c", ["b1.c", "x/bb.c"], ["a1.c", "b.c"]),
        ("a+b(1).md", ["a+b(1).md"], ["aab1.md"]),
    ],
)
def test_file_patterns(pattern, yes, no):
    found = re.compile(file_glob(pattern))
    assert all(found.search(p) for p in yes) and not any(found.search(p) for p in no)


def test_grep_of_a_tree(spark, tmp_path):
    root = tmp_path / "ws"
    (root / "lib").mkdir(parents=True)
    for k in range(4):
        (root / "lib" / f"m{k}.py").write_text(f"one\nneedle {k}\nthree\nfour\nfive\nneedle again\n")
    (root / "notes.md").write_text("needle\n")
    e = Engine(spark, str(tmp_path / "store"))
    got = [(r.path.split("/")[-1], r.first_line, r.matches) for r in e.grep(str(root), "needle", "*.py").collect()]
    assert got == [(f"m{k}.py", n, 1) for k in range(4) for n in (1, 5)]
    assert e.grep(str(root), "needle", "lib/*.py", limit=3).count() == 3 and e.grep(str(root), "needle").count() == 9


def test_caches_are_cleared_by_number(spark, tmp_path):
    for kind, project in (("analysis", "a"), ("analysis", "b"), ("summary", "a")):
        (tmp_path / kind / project).mkdir(parents=True)
        (tmp_path / kind / project / "x.json").write_text("{}")
    with pytest.raises(ValueError):
        caches.clear(spark, str(tmp_path), "2,9")
    assert caches.clear(spark, str(tmp_path), "2-3") == [("analysis", "b", 2), ("summary", "a", 2)]
    assert [tuple(r)[:2] for r in caches.inventory(spark, str(tmp_path)).collect()] == [("analysis", "a")]


def test_a_model_reranks_in_batches(spark):
    def answer(prompt):
        n = prompt.count("## snippet ")
        if "[File: p12]" in prompt:
            raise OSError("away")
        wanted = [int(x) % 7 for x in re.findall(r"text (\d+)", prompt)]
        return "noise " + json.dumps({"scores": wanted[: n - 1] if n == 5 else wanted})

    hits = spark.createDataFrame([(k, f"p{k}", "class X" if k % 2 else None, f"text {k}", 1 - k / 100) for k in range(25)], "id int, path string, hierarchy_display string, content string, score double")
    rows = rerank.model_reranked(hits, "q", answer, pause=0.0).collect()
    want = {k: float(k % 7) for k in range(10)} | {k: 9.9 - 0.01 * (k - 10) for k in range(10, 20)} | {k: float(k % 7) for k in range(20, 24)} | {24: 0.0}
    assert {r.id: round(r.score, 6) for r in rows} == {k: round(v, 6) for k, v in want.items()}
    assert [r.id for r in rows] == sorted(want, key=lambda k: (-want[k], k)) and rows[0].original_score == 0.9
    assert rerank.model_reranked(hits, "q", answer, least=9.85, pause=0.0).count() == 6
    assert rerank.model_reranked(hits.limit(0), "q", answer).isEmpty()
    prompt = rerank.scoring_prompt("find", [("[File: a]", "one"), ("[File: b]", "two")])
    assert "Search: find" in prompt and prompt.index("## snippet 1 [File: a]\n") < prompt.index("## snippet 2 [File: b]\n")


def test_summaries_in_batches(spark):
    class Fragile:
        def summarize(self, texts: pd.Series) -> pd.Series:
            if any("bad" in t for t in texts):
                raise ValueError
            return texts.str.upper()

    blocks = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "x\n" * 2000), (5, "b")], "id int, content string")
    rows = models.summarised(blocks, Fragile())
    assert {r.id: r.summary for r in rows.collect()} == {1: "A", 2: None, 3: None, 4: None, 5: "B"}
    assert tuple(models.outcomes(rows).first()) == (4, 2, 2)


def test_document_prefix_reaches_the_index(spark, tmp_path):
    class Seen(rerank.HashingEmbedder):
        def embed(self, texts: pd.Series) -> pd.Series:
            with open(tmp_path / "seen", "a") as f:
                f.writelines(t.split("\n")[0] + "\n" for t in texts)
            return super().embed(texts)

    root = tmp_path / "ws"
    root.mkdir()
    (root / "a.md").write_text("some words that fill a chunk of plain text\n" * 5)
    Engine(spark, str(tmp_path / "store"), Config(provider="llm2vec", dimension=8), Seen(8)).index(str(root))
    seen = [x for x in (tmp_path / "seen").read_text().splitlines() if x]
    assert seen and all(x.startswith("Summarize the following passage: ") for x in seen)
