"""The heavy-hitter split of exact dedup: which digests are heavy, and rows that tie."""

import random
from collections import Counter

from quern.llm import exact_dedup


def test_frequent_misses_no_frequent_value(spark):
    rng = random.Random(1)
    values = [rng.randrange(30) if rng.random() < 0.5 else 1000 + i for i in range(20_000)]
    found = {r.h for r in exact_dedup.frequent(spark.createDataFrame([(v,) for v in values], "h long").repartition(9), 0.01).collect()}
    often = {v for v, n in Counter(values).items() if n > 0.01 * len(values)}
    assert len(often) > 10 and often <= found and len(found) <= 200
    assert exact_dedup.frequent(spark.createDataFrame([], "h long"), 0.01).count() == 0


def test_ties_in_heavy_and_light_groups(spark):
    """Rows that differ in no column, or only in one that the report does not show; two runs keep the same."""
    rows = [(1, "same text", "x")] * 400 + [(1, "same  text", "y")] * 3 + [(2, "other", c) for c in "abcabc"] + [(i, f"t{i}", "z") for i in range(10, 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    got = [sorted(map(str, exact_dedup.deduplicate(docs.repartition(n), support=0.05).collect())) for n in (2, 5)]
    assert got[0] == got[1] and len(got[0]) == 592
    report = exact_dedup.report(docs.repartition(4), support=0.05).collect()
    assert len(report) == len(rows) and sum(r.kept for r in report) == 592
    assert {(r.keep_id, r.group_size) for r in report if r.doc_id == 1} == {(1, 403)}
    assert {(r.keep_id, r.group_size) for r in report if r.doc_id == 2} == {(2, 6)}
