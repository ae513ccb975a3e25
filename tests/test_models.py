"""What surrounds models."""

import pytest

from quern.operators import models, rerank


def test_retries():
    pauses, tries = [], []

    def call(x):
        tries.append(x)
        if len(tries) < 3:
            raise OSError
        return x

    assert models.retried(call, 7, sleep=pauses.append) == 7 and pauses == [0.5, 1.0]
    with pytest.raises(ZeroDivisionError):
        models.retried(lambda: 1 / 0, sleep=pauses.append)


def test_shortening():
    def call(text):
        if len(text) > 400:
            raise ValueError("too long")
        return len(text)

    text = "\n".join(["x" * 99] * 20)
    assert models.shortening(call, text, lambda e: "too long" in str(e)) == 299
    with pytest.raises(ValueError):
        models.shortening(call, text, lambda e: False)


def test_batches():
    def call(part):
        if "bad" in part:
            raise ValueError
        return [x.upper() for x in part]

    assert models.in_batches(["a", "b", "bad", "c", "d"], call) == ["A", "B", None, "C", "D"]


def test_repair():
    assert models.repaired_json('noise {"summaries": [{"summary": "a]"}, {"summary": "b') == {"summaries": [{"summary": "a]"}, {"summary": "b"}]}
    assert models.repaired_json('{"a": [1, 2,') == {"a": [1, 2]} and models.repaired_json('{"a": 1]}') == {"a": 1} and models.repaired_json("none") is None


def test_columns(spark):
    blocks = spark.createDataFrame([(1, "First one. Second."), (2, "\n" * 2000)], "id int, content string")
    got = {r.id: r.summary for r in models.summarised(blocks, rerank.FirstSentence()).collect()}
    assert got == {1: "First one.", 2: None}
    w = spark.createDataFrame([(h, q, p, float(h + q + p)) for h in range(2) for q in range(3) for p in range(2)], "head int, query int, pos int, weight double")
    assert {r.pos: r.score for r in models.attention_scores(w).collect()} == {0: 1.5, 1: 2.5}
    lines = spark.createDataFrame([("f", 0.5, True), ("f", 0.25, False)], "file string, score double, kept boolean")
    assert tuple(models.highlight_summary(lines).first()) == ("f", 0.75, 1)
    assert models.outline_targets("src/, lib, !x.py, {a,b}.ts", ["lib"]) == ["src/*", "lib/*", "!x.py", "{a,b}.ts"]
