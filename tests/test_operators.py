"""Operators on small inputs, against brute force where order or recursion matters."""

import random
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import ids, text, vectors
from quern.operators import chunk, graph, incremental, lines, parse, rerank, search
from quern.plans.requests import TextQuery


def unit(v):
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v]


def lcg(seed, dim=16):
    out, s = [], seed
    for _ in range(dim):
        s = (s * 1664525 + 1013904223) % 2**32
        out.append((s % 1000) / 1000 - 0.5)
    return unit(out)


def test_dense_search(spark):
    base = lcg(1)
    rows = [("a", base), ("b", lcg(2)), ("c", [-x for x in base])]
    v = spark.createDataFrame(rows, "id string, embedding array<float>")
    got = search.dense(v, base, 3).collect()
    assert got[0].id == "a" and got[0].score > 0.99
    assert [r.id for r in search.dense(v, base, 3, min_score=0.5).collect()] == ["a"]


def test_lexical_guarantee(spark):
    base = lcg(7)
    vecs = [(i, [x + 0.01 * (i % 5) for x in base]) for i in range(60)] + [(99, [-x for x in base])]
    texts = [(i, f"filler {i}") for i in range(60)] + [(99, "call Clear index mode now")]
    v, t = spark.createDataFrame(vecs, "id int, embedding array<float>"), spark.createDataFrame(texts, "id int, text string")
    q = TextQuery.parse('literal"Clear index mode"')
    with_it = {r.id for r in search.hybrid(v, t, base, q, 20).collect()}
    assert 99 in with_it and 99 in {r.id for r in search.bm25(t, q, 10).collect()}
    assert search.bm25(t, TextQuery.parse(""), 10).count() == 0


def test_containment_and_grouping(spark):
    rows = [("f", 1, 1, 10, 0.9), ("f", 2, 2, 5, 0.8), ("f", 3, 1, 10, 0.7), ("g", 4, 1, 3, 0.95)]
    hits = spark.createDataFrame(rows, "path string, id int, start_line int, end_line int, score double")
    assert {r.id for r in search.without_contained(hits).collect()} == {1, 3, 4}
    got = [tuple(r) for r in search.by_file(hits).collect()]
    assert got == [("g", 1, 0.95, 0.95, 0), ("f", 2, 0.9, 0.8, 1)]


def test_block_topk(spark):
    rows = [(i, lcg(i + 1)) for i in range(90)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = {}
    for r in search.block_topk(v.where("id % 10 = 0"), v, 4, block=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    for q, found in got.items():
        best = sorted(range(90), key=lambda i: (-round(sum(a * b for a, b in zip(rows[q][1], rows[i][1], strict=True)), 5), i))[:4]
        assert [i for _, i in sorted(found)] == best


def test_identities(spark):
    row = spark.range(1).select(
        ids.uuid5(F.lit("héllo")).alias("u"), ids.segment_hash(F.lit("p"), F.lit(1), F.lit(2), F.lit("x" * 150)).alias("s"), ids.workspace_id(F.lit("/w")).alias("w")
    ).first()
    import hashlib

    assert row.u == str(uuid.uuid5(uuid.UUID(ids.NAMESPACE), "héllo"))
    assert row.s == hashlib.sha256(f"p-1-2-150-{'x' * 100}".encode()).hexdigest()
    assert row.w == "ws-" + hashlib.sha256(b"/w").hexdigest()[:16]


def test_text_functions(spark):
    row = spark.range(1).select(
        text.escape_controls(F.lit("a\x01\x7f\tb")).alias("e"), text.truncated_line(F.lit("y" * 501)).alias("t"), text.safe_filename(F.lit(' a/b:  "c" ')).alias("f"),
        text.tokens(F.lit("Foo.bar_$x baz-2")).alias("k"), text.with_prefix(F.lit("q: x"), "q: ").alias("p"), text.is_symbol_line(F.lit(" }); ")).alias("s"),
        vectors.is_valid(F.array(F.lit(1.0), F.lit(float("inf")))).alias("v"),
    ).first()
    assert row.e == "a^A^?\tb" and row.t == "y" * 500 + " [truncated...]" and row.f == "a_b_ _c_"
    assert row.k == ["foo.bar_$x", "baz", "2"] and row.p == "q: x" and row.s and not row.v


def test_packing_examples():
    assert chunk.pack_lines(["short"], "fallback_chunk") == []
    long = chunk.pack_lines(["a" * 30, "b" * 2400, "c" * 120], "fallback_chunk")
    assert [(c.type, len(c.content)) for c in long] == [("fallback_chunk_segment", 2000), ("fallback_chunk_segment", 400), ("fallback_chunk", 120)]
    hundred = chunk.pack_lines([f"{i}: line" for i in range(400)], "x")
    assert all(100 <= len(c.content) <= 2300 for c in hundred)
    rest = chunk.pack_lines(["p" * 700] * 3 + ["q" * 150] * 2, "x")
    assert [(c.start_line, c.end_line, len(c.content)) for c in rest] == [(1, 3, 2253), (4, 5, 150)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=30))
def test_packing_invariants(sizes):
    lines_ = ["x" * n for n in sizes]
    out = chunk.pack_lines(lines_, "t")
    assert all(c.content and c.start_line <= c.end_line <= max(1, len(lines_)) for c in out)
    assert all(chunk.units(c.content) <= 2300 for c in out)
    whole = [n for n in sizes if n >= 100]
    assert sum(len(c.content) for c in out) >= sum(n for n in whole if n > 2300) and (not whole or out)


def test_markdown_sections():
    body = "\n".join(["intro " * 30, "# One", "x" * 120, "## Two", "y" * 120, "Three", "---", "z" * 120, "### Four", "w" * 120])
    got = [(c.type, c.identifier, c.start_line, c.end_line, c.display) for c in chunk.markdown(body)]
    assert got == [
        ("markdown_content", None, 1, 1, None),
        ("markdown_header_h1", "One", 2, 3, "header_1 One"),
        ("markdown_header_h2", "Two", 4, 5, "header_1 One > header_2 Two"),
        ("markdown_header_h2", "Three", 6, 8, "header_1 One > header_2 Three"),
        ("markdown_header_h3", "Four", 9, 10, "header_1 One > header_2 Three > header_3 Four"),
    ]


def test_code_chunks():
    small = "def small():\n    return 1\n"
    fit = "class Fit:\n    def one(self):\n" + "".join(f"        a{i} = {i}\n" for i in range(12)) + "        return a1\n"
    large = "class Large:\n" + "".join(f"    def m{k}(self):\n" + "".join(f"        value_{i} = {i} * {k}\n" for i in range(40)) for k in range(4))
    long = "def long():\n" + "".join(f"    statement_{i} = {i} + {i}\n" for i in range(150))
    got = chunk.chunk_text("a.py", small + fit + large + long)
    kinds = [(c.type, c.identifier) for c in got]
    assert kinds[:5] == [("class", "Fit"), *[("method", f"m{k}") for k in range(4)]] and set(kinds[5:]) == {("function", "long")} and len(kinds) > 6
    assert got[1].display == "class Large > method m0" and got[1].source == "definition"
    assert chunk.chunk_text("a.py", "x = 1\n" * 40)[0].type == "fallback_chunk" and chunk.chunk_text("a.py", "def (\n" * 40)[0].type == "fallback_chunk"


def test_batches_and_retries():
    assert chunk.batches([50, 60, 9000, 40], most=100) == [0, 1, None, 1]
    assert chunk.shortened("aa\nbb\ncc", 5) == "aa\nbb" and chunk.shortened("abcdef", 3) == "abc"
    assert chunk.retry_sizes() == [800, 560, 392]
    assert chunk.contained([(1, 10, "abc def"), (2, 3, "abc"), (2, 3, "zzz"), (1, 12, "abc")]) == [True, False, True, True]


def test_incremental(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "path string, file_hash string")
    b = spark.createDataFrame([("y", "1"), ("z", "2"), ("n", "1")], "path string, file_hash string")
    assert {r.path: r.status for r in incremental.diff(a, b).collect()} == {"x": "deleted", "y": "unchanged", "z": "changed", "n": "new"}
    chunks = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "file_path string, v int")
    changes = spark.createDataFrame([("x", "delete"), ("z", "change")], "path string, type string")
    fresh = spark.createDataFrame([("z", 30), ("x", 10)], "file_path string, v int")
    assert {tuple(r) for r in incremental.applied(chunks, changes, fresh).collect()} == {("y", 2), ("z", 30)}


def test_grep_merges_context(spark):
    t = spark.createDataFrame([(1, "\n".join(["a", "hit", "b", "c", "hit", "hit", "d", "e", "f"])), (2, "none")], "id int, text string")
    got = [(r.first_line, r.last_line, r.matches) for r in lines.grep(t, "hit").orderBy("first_line").collect()]
    assert got == [(1, 7, 3)]
    assert [(r.first_line, r.last_line) for r in lines.grep(t, "hit", 0).orderBy("first_line").collect()] == [(2, 2), (5, 6)]


def test_fuzzy_paths(spark):
    p = spark.createDataFrame([("src/app/main.py",), ("src/util.py",), ("docs/readme.md",)], "path string")
    got = [(r.path, r.kind) for r in lines.fuzzy_paths(p, "srcmain").collect()]
    assert got == [("src/app/main.py", "file")] and ("src/app", "folder") in [(r.path, r.kind) for r in lines.fuzzy_paths(p, "app").collect()]


def reach(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    done = {}
    for s in {x for e in edges for x in e}:
        seen, todo = set(), [s]
        while todo:
            for n in out.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        done[s] = seen
    return done


def test_cycles_levels_and_paths(spark):
    rng = random.Random(11)
    edges = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(34)})
    v = spark.createDataFrame([(i, i) for i in range(30)], "id long, seq long")
    e = spark.createDataFrame(edges, "caller long, callee long")
    far = reach(edges)
    want = {}
    for i in range(30):
        mates = [j for j in range(30) if j != i and j in far.get(i, ()) and i in far.get(j, ())]
        if mates:
            want[i] = min([i, *mates])
    assert {r.id: r.component for r in graph.cycles(v, e).collect()} == want
    level, left, rest, n = {}, set(range(30)), set(edges), 0
    while free := left - {b for _, b in rest}:
        level |= dict.fromkeys(free, n)
        left -= free
        rest = {x for x in rest if x[0] not in free}
        n += 1
    assert {r.id: r.level for r in graph.levels(v, e).collect()} == level
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(30)], "src long, dst long")
    got = {(r.src, r.dst): r.path for r in graph.shortest_paths(e, pairs, 30).collect()}
    assert set(got) == {(a, b) for a in range(6) for b in range(30) if a == b or b in far.get(a, ())}
    assert all(all(x in edges for x in zip(p, p[1:], strict=False)) for p in got.values())


def test_resolution(spark):
    v = spark.createDataFrame([("src/a.f", 1), ("src/b.f", 2), ("lib/x/c.f", 3), ("src/a.g", 4), ("lib/d.h", 5), ("src/a.C.m", 6)], "id string, seq long")
    e = spark.createDataFrame([("src/a.g", "f"), ("lib/x/z.q", "f"), ("src/k.z", "f"), ("src/a.g", "lib/d.h"), ("src/a.g", "gone"), ("src/b.f", "x.h")], "caller string, callee string")
    got = {(r.caller, r.callee): (r.target, r.is_resolved, r.confidence) for r in graph.resolve(v, e).collect()}
    assert got == {
        ("src/a.g", "f"): ("src/a.f", True, 1.0), ("lib/x/z.q", "f"): ("lib/x/c.f", True, 0.6), ("src/k.z", "f"): ("src/a.f", True, 0.6),
        ("src/a.g", "lib/d.h"): ("lib/d.h", True, 1.0), ("src/a.g", "gone"): ("gone", False, None), ("src/b.f", "x.h"): ("lib/d.h", True, 1.0),
    }


def test_tree():
    rows = graph.tree([("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "a")], "a", 3)
    assert [(n, d) for n, d, _ in rows] == [("b", 1), ("c", 2), ("d", 3), ("c", 1)]
    assert graph.render("a", rows).splitlines()[1] == "├── b"


def test_parsing(spark):
    py = "import os\nfrom .util import fmt as f\nclass A:\n    def m(self, x):\n        return f(x) + helper(x)\n\ndef helper(y):\n    print(y)\n    return os.getcwd()\n\nhelper(1)\n"
    js = "import { fmt as f } from './util';\n// call(x)\nclass B {\n  go(a, b) {\n    return f(a) + this.run(b);\n  }\n}\nconst run = (x) => {\n  console.log(x);\n  return make(x);\n};\n"
    files = spark.createDataFrame([("src/a.py", py, "python"), ("src/b.ts", js, "typescript")], "path string, text string, language string")
    rows = parse.analysed(files).collect()
    assert {(r.id, r.component_type) for r in rows if r.kind == "node"} == {
        ("src/a.A", "class"), ("src/a.A.m", "method"), ("src/a.helper", "function"), ("src/a", "module"),
        ("src/b.B", "class"), ("src/b.B.go", "method"), ("src/b.run", "function"),
    }
    calls = {(r.id, r.callee) for r in rows if r.kind == "call"}
    assert {("src/a.A.m", "src/util.fmt"), ("src/a.A.m", "src/a.helper"), ("src/a", "src/a.helper"), ("src/b.B.go", "src/util.fmt"), ("src/b.run", "make")} <= calls
    assert not any(c in ("print", "console.log") for _, c in calls)
    assert "4--5 | method m" in parse.outline_text("src/a.py", py, "python")
    vertices, edges = parse.call_graph(files)
    assert graph.resolve(vertices, edges).where("is_resolved").count() >= 3


def test_rerank(spark):
    assert rerank.scores_from_object('x ```json\n{"scores": [11, -2, "a"]}``` y', 4) == [10.0, 0.0, 0.0, 0.0]
    assert rerank.scores_from_lines('<think>{}</think>\n{"index": 2, "score": 7}\n{"index": 2, "score": 1}\nz', 2) == [0.0, 7.0]
    assert rerank.scores_from_lines("nothing", 2) is None and rerank.salvage_json("so {\"a\": [1]} end") == {"a": [1]}
    assert rerank.line_range("START 2 END 4\nL3-L5", 5) == (3, 5) and rerank.line_range("0 0", 5) is None
    assert rerank.token_lines("ab cd\nef", ["ab", " cd", "ef"]) == [0, 0, 1] and rerank.line_scores([0, 0, 1], [1, 3, 5], 3) == [2.0, 5.0, 0.0]
    hits = spark.createDataFrame([(1, "alpha beta", 0.9), (2, "beta gamma", 0.5)], "id int, text string, score double")
    assert [r.id for r in rerank.reranked(hits, "gamma beta", rerank.OverlapScorer()).collect()] == [2, 1]
    e = rerank.embedded(hits, rerank.HashingEmbedder(8)).collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in e)
    raw = spark.createDataFrame([(1, 0.5), (1, 2.0), (2, 0.5)], "query_id int, raw double")
    assert sorted(round(r.score, 3) for r in rerank.cross_encoder_scores(raw).collect()) == [5.0, 6.225, 8.808]
    s = spark.createDataFrame([(0, 1.0), (1, 2.0), (5, 4.0)], "pos int, score double")
    r = spark.createDataFrame([("a", 0, 1), ("b", 4, 9), ("c", 7, 8)], "chunk string, first int, last int")
    assert {x.chunk: x.score for x in rerank.chunk_scores(s, r).collect()} == {"a": 3.0, "b": 4.0, "c": 0.0}


def test_batch_search_agrees_with_single(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    texts = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randrange(0, 40)))) for i in range(80)], "id long, text string").repartition(3)
    queries = [(q, " ".join(rng.sample(words, 3))) for q in range(7)] + [(90, ""), (91, None)]
    got = {}
    for r in search.bm25_batch(texts, spark.createDataFrame(queries, "id long, text string"), 5, block=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    assert set(got) <= set(range(7))
    for q, text_ in queries[:7]:
        want = [(r.id, r.score) for r in search.bm25(texts, TextQuery.parse(text_), 5).collect()]
        assert [(i, s) for _, i, s in sorted(got.get(q, []))] == want
