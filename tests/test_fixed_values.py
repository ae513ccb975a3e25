"""Values and rules that must be as an index built by the original rules has them."""

import pytest
from pyspark.sql import functions as F

from quern.functions import text as t
from quern.operators.search import bm25
from quern.plans.requests import PathFilter, TextQuery, expand_braces
from quern.sources import corpus, ignore


def test_extensions_and_folders():
    assert len(corpus.EXTENSIONS) == 42 and corpus.EXTENSIONS[2] == "mjs"
    rules = ignore.default_rules()
    for path in ("build/x.py", "a/coverage/x.js", ".nyc_output/x", "x/.pytest_cache/y", ".some-cache/z", "node_modules/a/b.ts"):
        assert ignore.ignored(path, rules), path
    for path in ("target/x.rs", ".idea/x", ".vscode/x", "src/build.py", "some-cache/z"):
        assert not ignore.ignored(path, rules), path


@pytest.mark.parametrize(
    ("pattern", "out"),
    [
        ("a", ["a"]), ("{a,b}", ["a", "b"]), ("{,}", ["{,}"]), ("{}x{a, b}", ["{}xa", "{}xb"]), ("a{,b}c", ["abc"]), ("{a", ["{a"]),
        ("src/{a,{b,c}}/x", ["src/a}/x", "src/b/x", "src/c}/x"]),
    ],
)
def test_braces(pattern, out):
    assert expand_braces(pattern) == out


def test_a_filter_of_empty_options_lets_nothing_through_that_lacks_it(spark):
    rows = spark.createDataFrame([("a/b.py",), ("a/{,}/b.py",)], "path string")
    assert [r.path for r in rows.where(PathFilter.compile(["{,}"]).column(F.col("path"))).collect()] == ["a/{,}/b.py"]


def test_recoverable_errors(spark):
    said = ["Context length exceeded", "Invalid input", "failed to get embeddings: 500", "timeout", "maximum context", "Token Limit"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    assert [r.i for r in rows.where(t.recoverable(F.col("s"))).orderBy("i").collect()] == [0, 1, 2, 5]


def test_tokens_have_no_accents(spark):
    rows = spark.createDataFrame([(1, "Café CAFÉ naïve_x ø ß ệ"), (2, None), (3, "cafe")], "id long, text string")
    got = {r.id: r.ts for r in rows.select("id", t.tokens(F.col("text")).alias("ts")).collect()}
    assert got[1] == ["cafe", "cafe", "naive_x", "ø", "ß", "e"] and got[2] is None
    assert {r.id for r in bm25(rows, TextQuery.parse("CAFÉ"), 5).collect()} == {1, 3}


def test_node_types(spark):
    rows = spark.createDataFrame([("class_definition",), ("pair",), ("section",), (None,)], "k string")
    assert [r[0] for r in rows.select(t.node_type(F.col("k"))).collect()] == ["class", "property", "section", None]
