"""Every language is learned, or training is refused."""

import pytest

from quern.llm import language_id


def test_every_language_is_learned(spark, monkeypatch):
    n = 210
    rows = [(i, " ".join(chr(0x4E00 + 20 * (i % n) + (i + j) % 7) * 2 for j in range(12)), f"l{i % n:03}") for i in range(8 * n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = {r.doc_id: r.lang_pred for r in language_id.report(docs).collect()}
    assert len(set(got.values())) == n
    assert sum(got[i] == lang for i, _, lang in rows) > 0.97 * len(rows)
    monkeypatch.setattr(language_id, "LANGUAGES", n - 1)
    with pytest.raises(ValueError, match="more than 209"):
        language_id.train(docs)
