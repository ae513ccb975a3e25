"""Driver-side plans: validation, path filters, query strings, ignore rules."""

import math

import pytest
from pyspark.sql import functions as F

from quern.plans.requests import (
    PathFilter,
    TextQuery,
    effective_min_score,
    expand_braces,
    glob_regex,
    index_ranges,
    leg_budgets,
    literals,
    split_filters,
    valid_limit,
    valid_min_score,
)
from quern.sources import ignore


def test_limits_and_scores():
    assert [valid_limit(x) for x in (None, math.nan, 0, -3, 0.5, 7.9, 51, "9", True)] == [20, 20, 20, 20, 20, 7, 50, 20, 20]
    assert [valid_min_score(x) for x in (None, math.nan, -1, 0.25, 7)] == [0.4, 0.4, 0.0, 0.25, 1.0]
    assert (effective_min_score(), effective_min_score(None, 0.2), effective_min_score(0.1, 0.2)) == (0.4, 0.2, 0.1)
    assert leg_budgets(20) == (31, 10) and leg_budgets(1, 1, 0.001) == (2, 1)


def test_path_lists():
    assert split_filters("a,b") == ["a", "b"] and split_filters(" a , ,b ") == ["a", "b"] and split_filters("={a,b},!x") == ["{a,b}", "!x"]
    assert split_filters(None) == [] and expand_braces("s/{a, b,}/x") == ["s/a/x", "s/b/x"]
    assert literals("src/**/*.ts") == ["src/", ".ts"] and literals("**/*") == [] and literals("*[ab]*x") == ["x"]


def test_path_filter(spark):
    paths = spark.createDataFrame([("src/a.ts",), ("lib/b.ts",), ("src/c.test.ts",), ("SRC/d.TS",)], "p string")

    def kept(patterns, mode="or"):
        return sorted(r.p for r in paths.where(PathFilter.compile(patterns).column(F.col("p"), mode)).collect())

    assert kept(["src/**/*.ts", "!**/*.test.ts"]) == ["SRC/d.TS", "src/a.ts"]
    assert kept(["src/*", "lib/*"]) == ["SRC/d.TS", "lib/b.ts", "src/a.ts", "src/c.test.ts"]
    assert kept(["src/*", "lib/*"], "and") == [] and len(kept([])) == 4 and len(kept(["**"])) == 4


def test_text_query():
    q = TextQuery.parse('say "Clear index mode" foo-bar "a ""b"" c"')
    assert q.phrases == ["Clear index mode", 'a "b" c'] and q.terms == ["say", "foo-bar"]
    assert q.text() == '"Clear index mode" OR "a ""b"" c" OR say OR "foo-bar"'
    assert TextQuery.parse("  ").text() == "" and TextQuery.parse(None).terms == []


def test_names_and_ranges():
    import re

    assert re.match(glob_regex("src/*.f?o"), "SRC/x.Foo") and not re.match(glob_regex("a"), "ab")
    assert index_ranges("1, 3-5", 6) == [1, 3, 4, 5] and index_ranges("all", 2) == [1, 2]
    for bad in ("0", "7", "x", "5-3"):
        with pytest.raises(ValueError):
            index_ranges(bad, 6)


def test_ignore_rules(spark):
    table = ignore.default_rules("*.log\n!keep.log\n/made\ndocs/**/tmp\n# note\n\nsecret?.txt\nfolder/\n", "keep.log")
    cases = {
        "a.log": True, "x/b.log": True, "keep.log": True, "made/x": True, "src/made/x": False, "src/build/x": True, "docs/a/tmp/f": True, "secret1.txt": True,
        "secret12.txt": False, "folder/x/y": True, "node_modules/a.js": True, "src/a.py": False, ".git/config": True,
    }
    assert {p: ignore.ignored(p, table) for p in cases} == cases
    rows = spark.createDataFrame([(p,) for p in cases], "p string").select("p", ignore.column(F.col("p"), table).alias("i")).collect()
    assert {r.p: r.i for r in rows} == cases
