"""The call graph keeps its definitions in order of insertion, and filters the fixed lists of builtins."""

from quern.api import Engine
from quern.operators import parse


def test_every_chain_of_twenty_files(spark, tmp_path):
    for i in range(20):
        (tmp_path / f"m{i}.py").write_text(f"def caller{i}():\n    return callee{i}()\n\n\ndef callee{i}():\n    return 1\n")
    e = Engine(spark, str(tmp_path / "store"))
    rows = e.call(str(tmp_path), ["*caller*", "*callee*"]).collect()
    assert sorted((r.src, r.dst) for r in rows) == sorted((f"m{i}.caller{i}", f"m{i}.callee{i}") for i in range(20))
    assert e.call(str(tmp_path), ["*caller3", "*callee3"]).count() == 1
    kinds = [r.kind for r in e.connections(str(tmp_path), ["*caller*", "*callee*"]).collect()]
    assert kinds.count("chain") == 20 and kinds.count("direct") == 20


def test_order_and_last_definition(spark):
    rows = [("b.py", "def f():\n    pass\n\n\ndef f(x):\n    return x\n"), ("a.py", "class A:\n    def g(self):\n        pass\n\n\ndef z():\n    pass\n")]
    files = spark.createDataFrame([(p, t, "python") for p, t in rows], "path string, text string, language string")
    vertices, _ = parse.call_graph(files)
    found = vertices.orderBy("seq").collect()
    assert [r.id for r in found] == ["a.A", "a.A.g", "a.z", "b.f"]
    assert found[-1].start_line == 5 and found[-1].seq.startswith("b.py\0" + "0" * 9 + "1")


def test_numbers_order_as_numbers(spark):
    rows = spark.createDataFrame([(i, "a.py", 1, 1) for i in (13, 1013, -2, -13, 2)], "id long, path string, start_line int, end_line int")
    assert [r.id for r in parse.in_order(rows).orderBy("seq").collect()] == [-13, -2, 2, 13, 1013]


def test_builtins():
    text = "def f():\n    print(len([]))\n    frozenset()\n    other()\n    self.print()\n"
    assert [c[1] for c in parse.parsed("a.py", text, "python").calls] == ["other", "print"]
    text = "function f() { console.table(1); Promise.any([]); helper(); this.fetch(); sizeof(x); }"
    assert [c[1] for c in parse.parsed("a.ts", text, "typescript").calls] == ["helper", "fetch"]
    text = "fn f() { println!(\"x\"); Ok(1); }"
    assert [c[1] for c in parse.parsed("a.rs", text, "rust").calls] == ["println!", "Ok"]
    assert {k: len(v) for k, v in parse.BUILTINS.items()} == {"python": 64, "javascript": 90, "go": 12, "c": 32, "typescript": 90}
