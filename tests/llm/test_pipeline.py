"""The pipeline against a plain version of its stages on a small corpus."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    def text(i):
        return " ".join(f"the{(i * k) % 89}a and{(i + k) % 61}b" for k in range(20))

    rows = [(i, text(i), "en", f"s{i % 3}") for i in range(40)]
    rows += [(100, text(3).replace(" ", "\n"), "en", "s1"), (101, text(4) + " more", "en", "s0"), (102, "123 456", "en", "s0"), (103, None, "en", "s0"), (104, "", None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    where = str(tmp_path)
    docs.write.parquet(f"{where}/documents.parquet")
    steps = {}
    current = spark.read.parquet(f"{where}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, where)
        current.write.parquet(f"{where}/{name.replace(' ', '_')}")
        current = spark.read.parquet(f"{where}/{name.replace(' ', '_')}")
        steps[name] = current
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(steps[n].columns == docs.columns for n in names[:-1])
    ids = [sorted(r.doc_id for r in steps[n].select("doc_id").collect()) for n in names]
    assert ids[0] == sorted(r[0] for r in rows if re.search("[a-z]", r[1] or ""))
    assert ids[1] == [i for i in ids[0] if i != 100]
    assert ids[2] == [i for i in ids[1] if i != 101]
    assert set(ids[3]) <= set(ids[2]) and all(ids[3].count(i) <= 2 for i in ids[2])
    assert ids[4] == ids[3] and all(r.round_trip for r in steps[names[-1]].collect())
    again = corpus_pipeline.run(spark, where)
    assert sorted(r.doc_id for r in again.collect()) == ids[4]


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, key string, rank long, component_id long, copies int, `a.b` string"


@pytest.mark.parametrize("empty", [False, True])
def test_stages_bear_odd_rows(spark, empty, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, clashing and odd column names, no rows at all."""
    rows = [(i, f"the quick{i} brown fox jumps over the lazy dog number {i} again " * 3, "en", "s", 1, "k", i, i, i, "x") for i in range(30)]
    rows += [rows[0], rows[0], (None,) * 10, (50, "", None, None, None, None, None, None, None, None), (51, "word " * 30000, "en", None, 1, "k", 1, 1, 1, "y")]
    rows += [(None, "another text without an id that has some words in it", "en", "s", 1, "k", 1, 1, 1, "z")]
    docs = spark.createDataFrame([] if empty else rows, EXTRA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        found = out.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            assert {tuple(r) for r in found} <= {tuple(r) for r in rows}
        assert bool(found) != empty
    kept = corpus_pipeline.STAGES[1][1](spark, docs, "").collect()
    assert sum(r.doc_id == 0 for r in kept) == (0 if empty else 1)
