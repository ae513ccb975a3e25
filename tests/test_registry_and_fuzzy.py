"""A language that is added by one call, table functions in SQL, and alignments against all placings."""

import itertools
import random

from pyspark.sql import functions as F

from quern.api import Engine
from quern.operators import analyzers, fuzzy, parse
from quern.sources import corpus


def ini_file(path, text):
    nodes, calls = [], []
    for n, line in enumerate(text.split("\n"), 1):
        if line.startswith("["):
            nodes.append(parse.Node(f"{parse.module_of(path)}.{line.strip('[]')}", line.strip("[]"), "class", n, n + 1))
        elif line.startswith("use="):
            calls.append(("", line[4:], n))
    return parse.Parsed(nodes, calls, {})


def test_a_new_language(spark, tmp_path):
    analyzers.add("ini", [".ini"], ini_file, builtins=("skip",))
    try:
        assert "ini" in analyzers.languages() and corpus.LANGUAGES["ini"] == "ini"
        analyzers.register(spark)
        text = "[one]\nuse=two\n[two]\nuse=skip\n"
        spark.createDataFrame([("a.ini", text, "ini"), ("b.py", "def f(x):\n    return g(x)\n", "python"), ("c", None, None)], "path string, text string, language string").createOrReplaceTempView("files")
        rows = spark.sql("SELECT f.path, d.id, d.start_line, d.parameters FROM files f, LATERAL definitions(f.path, f.text, f.language) d").collect()
        assert sorted((r.path, r.id, r.start_line) for r in rows) == [("a.ini", "a.one", 1), ("a.ini", "a.two", 3), ("b.py", "b.f", 1)]
        calls = spark.sql("SELECT c.caller, c.callee FROM files f, LATERAL calls(f.path, f.text, f.language) c").collect()
        assert sorted(map(tuple, calls)) == [("a.one", "a.two"), ("b.f", "g")]
        (tmp_path / "x.ini").write_text(text)
        got = Engine(spark, str(tmp_path / "s")).call(str(tmp_path), ["one", "two"]).collect()
        assert [(r.src, r.dst) for r in got] == [("x.one", "x.two")]
    finally:
        parse.ANALYZERS.pop("ini")
        parse.BUILTINS.pop("ini")
        corpus.LANGUAGES.pop("ini")
        corpus.EXTENSIONS.remove("ini")


def every_placing(query, path):
    low, best = path.lower(), None
    for at in itertools.combinations(range(len(low)), len(query)):
        if all(low[i] == c for i, c in zip(at, query)):
            score = sum(fuzzy.MATCH + (fuzzy.START if i == 0 or low[i - 1] in fuzzy.BREAKS else 0) for i in at)
            for a, b in itertools.pairwise(at):
                score += fuzzy.NEXT if b == a + 1 else -fuzzy.OPEN - fuzzy.EXTEND * (b - a - 2)
            best = score if best is None else max(best, score)
    return best


def test_alignment_equals_all_placings(spark):
    rnd = random.Random(3)
    paths = ["".join(rnd.choice("abc/._A") for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    for query in ("a", "ab", "abc", "cab", "aab/"):
        assert [fuzzy.alignment(query, p) for p in paths] == [every_placing(query, p) for p in paths]
    df = spark.createDataFrame([(p,) for p in paths if p], "path string")
    got = {r.path: r.score for r in fuzzy.best_paths(df, "abc", 1000).where("kind = 'file'").collect()}
    assert got == {p: s for p in paths if p and (s := every_placing("abc", p)) is not None}


def test_masks_and_folders(spark):
    df = spark.createDataFrame([("src/main/App.java",), ("src/map.py",), ("doc/é.md",), ("x",)], "path string")
    kept = fuzzy.masked(df)
    assert [(r.path, r.kind) for r in fuzzy.best_paths(kept, "srcm").collect()] == [("src/main", "folder"), ("src/map.py", "file"), ("src/main/App.java", "file")]
    want = fuzzy.mask(F.lit("map"))
    assert {r.path for r in kept.where(F.col("mask").bitwiseAND(want) == want).collect()} == {"src/main/App.java", "src/map.py"}
    assert [r.path for r in fuzzy.best_paths(df, "é").collect()] == ["doc/é.md"] and fuzzy.best_paths(df, "zzz").count() == 0
