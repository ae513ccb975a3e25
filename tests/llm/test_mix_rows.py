"""Rows that differ in any column are mixed each for itself."""

from collections import Counter

from quern.llm import mixing


def test_mixing_keeps_rows_that_differ_in_any_column(spark):
    rows = []
    for i in range(20):
        text = "w " * (i + 1)
        rows += [(i, text, s, lang, tag, [tag, lang]) for s in ("a", "b", None) for lang, tag in (("x", None), (None, "x"), ("x", "y"))]
    rows += rows[:5]  # equal in all columns
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, `t.g` string, list array<string>")
    mixed = mixing.mix(docs.repartition(3), share=2.0)  # every source at its cap: each row twice
    assert mixed.columns == docs.columns
    assert Counter(map(str, mixed.collect())) == Counter({k: 2 * v for k, v in Counter(map(str, docs.collect())).items()})


def test_mix_and_report_take_the_same_words_from_each_source(spark):
    """Rows that share id and text across sources, and one row repeated more often than one task gives out."""
    rows = [(i % 7, "w " * (i % 7 + 3), f"s{i % 3}", i % 2) for i in range(60)] + [(99, "a b c", None, 0)] * 2500
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, flag int").repartition(5)
    wanted = {}
    for r in mixing.report(docs).collect():
        wanted[r.source_size] = wanted.get(r.source_size, 0) + r.taken
    sizes, got = Counter(), Counter()
    for _, text, source, _ in rows:
        sizes[source] += len(text.split())
    mixed = sorted(map(str, mixing.mix(docs).collect()))
    for r in mixing.mix(docs).collect():
        got[sizes[r.source]] += len(r.text.split())
    assert {k: v for k, v in wanted.items() if v} == dict(got)
    assert mixed == sorted(map(str, mixing.mix(docs.repartition(2)).collect()))
    assert all(n <= 2 * Counter(map(str, docs.collect()))[row] for row, n in Counter(mixed).items())
