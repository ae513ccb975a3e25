"""BPE encoding against the library, which the operator itself does not use."""

import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import word_bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(word_bpe.TOKENIZER)


def hostile() -> list:
    rnd = random.Random(11)
    alphabet = "abcdefg'stvrelmd ÉéΣσςİ̧́ \n\t\x85\xa0\x1c1２٣🙂힣가漢字𐐀𝟙<|endoftext|>"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    texts += [None, "", " ", "\n\x0b", "it's 'sing we'LL", "<|startoftext|>a<|endoftext|><|STARTOFTEXT|>", "x" * 50_000, "word " * 40_000]
    return texts


def test_every_code_point(library):
    rules, splitter = word_bpe.load(word_bpe.TOKENIZER), word_bpe.Splitter(word_bpe.word_pattern(), {})
    for start in range(0, 0x110000, 0x800):
        text = " ".join(f"a{chr(c)}1 {chr(c)}" for c in range(start, start + 0x800) if not 0xD800 <= c < 0xE000)
        ids = [i for words in splitter.pieces(text) for w in words for i in word_bpe.merged(w, rules)]
        assert ids == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("distinct", "block"), [(word_bpe.DISTINCT, 30), (20, word_bpe.BLOCK), (1, 1)])
def test_equals_library(spark, library, distinct, block, monkeypatch):
    monkeypatch.setattr(word_bpe, "DISTINCT", distinct)
    monkeypatch.setattr(word_bpe, "BLOCK", block)
    monkeypatch.setattr(word_bpe, "ANSWERS", block)
    texts = hostile()
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "again", "y"), (3, "again", "z")], "doc_id long, text string, ids string")
    found = word_bpe.decoded(word_bpe.encode(rows)).collect()
    assert len(found) == len(texts) + 2
    seen = {(r["doc_id"], tuple(r["ids"])): r for r in found}
    for i, text in [*enumerate(texts), (None, "again"), (3, "again")]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        row = seen[(i, tuple(ids))]
        assert row["n_tokens"] == len(ids)
        assert row["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_report(spark, library):
    texts = hostile()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in word_bpe.report(rows).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["n_tokens"] == len(ids)
    assert word_bpe.report(rows.where(F.lit(False))).count() == 0


def test_each_distinct_word_once(spark, monkeypatch):
    rules = word_bpe.load(word_bpe.TOKENIZER)
    rows = spark.createDataFrame([(1, "b a b"), (2, "a b c"), (3, None)], "id long, text string").repartition(2)
    asked = word_bpe.asked_words(word_bpe.chunked(rows, rules))
    words = [(r["word"], r["chunk"]) for r in asked.collect()]
    assert len(words) == len(set(words)) and {w for w, _ in words} == {"a", "b", "c"}
    marks = asked.repartition("word").sortWithinPartitions("word", "chunk")  # as encoded_words deals them
    parts = marks.selectExpr("word", "spark_partition_id() AS p").collect()
    assert all(len({r["p"] for r in parts if r["word"] == w}) == 1 for w in "abc")


def test_chunks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(word_bpe, "LIMIT", 3)
    rows = spark.createDataFrame([(i, f"w{i} a") for i in range(10)], "id long, text string").coalesce(1)
    chunks = word_bpe.chunked(rows, word_bpe.load(word_bpe.TOKENIZER)).collect()
    assert sorted(sum(len(ids) for ids, _, _ in word_bpe.texts_of(r["body"])) for r in chunks) == [1, 3, 3, 3]


def test_foreign_ids(spark):
    rows = spark.createDataFrame([(1, [320, -1, 10**8, 320]), (2, None)], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in word_bpe.decoded(rows).orderBy("doc_id").collect()] == ["a</w> a</w>", ""]


def test_short_numbers():
    rnd = random.Random(2)
    numbers = np.array([0, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1] + [rnd.randrange(2 ** rnd.randint(1, 28)) for _ in range(999)])
    assert word_bpe.long_numbers(word_bpe.short_numbers(numbers)).tolist() == numbers.tolist()
    assert len(word_bpe.long_numbers(word_bpe.short_numbers(numbers[:0]))) == 0


def test_a_chunk_is_shuffled_once(spark):
    rows = spark.createDataFrame([(i, f"w{i} a") for i in range(50)], "doc_id long, text string")
    done = word_bpe.encode(rows)
    done.collect()
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("Initial Plan")[0] or "ReusedExchange" in plan


def test_equal_chunks(spark, library):
    rows = spark.createDataFrame([(1, "the same words"), (2, None)], "doc_id long, text string").coalesce(1)
    ids = library.encode("the same words", add_special_tokens=False).ids
    found = sorted((r["doc_id"], r["ids"]) for r in word_bpe.encode(rows.union(rows).union(rows)).collect())
    assert found == [(1, ids)] * 3 + [(2, [])] * 3


@pytest.mark.parametrize("n", [0, 1, 63, 64, 5000])
def test_answers(n):
    rnd = random.Random(n)
    places = sorted(rnd.sample(range(10**6), n))
    ids = [bytes(2 * rnd.randrange(5)) for _ in places]
    got = word_bpe._answered(word_bpe._answer(places, ids))
    assert got[0].tolist() == places and got[1].tolist() == [len(x) for x in ids] and got[2] == b"".join(ids)
