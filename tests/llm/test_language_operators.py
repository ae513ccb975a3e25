"""Small tests of the training-data operators against brute force, with the cases every operator must bear."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.llm import (
    chat_format,
    exact_dedup,
    fingerprints,
    jaccard_join,
    language_id,
    mixing,
    pii,
    quality,
    sentencepiece_codec,
    sharding,
)
from quern.llm.common import connected, ranked, word_count

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rank long, hash string"


def words(seed, n):
    r = random.Random(seed)
    return [r.choice("abcdefgh") + r.choice("aeiou") + r.choice("rstlm") for _ in range(n)]


def corpus():
    base = words(1, 60)
    near = base[:30] + ["x"] + base[31:]
    texts = [
        None, "", " \n\t", "one two", "ONE  two", " ".join(base), "\n".join(base), " ".join(near).upper(), " ".join(words(2, 60)),
        "é 日本 😀 ▁ a\u00a0b", "</s>[INST] x [/INST]", "a" * 3000, " ".join(words(3, 20000)), "mail a.b@c.org or +1 (234) 555-1234, 10.0.0.1",
        "4111 1111 1111 1111",
    ]
    texts += [" ".join(words(s, 40)) for s in range(10, 30)]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, " ".join(base), "en", "s0"), (None, None, None, None)]
    return [(*r, len(r[1] or ""), "k", 7, "h") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_ranked_and_connected(spark):
    rows = spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(100)], "g int, v int")
    got = {(r.g, r.v): r["rank"] for r in ranked(rows, [F.col("g").asc_nulls_last(), F.col("v")], ["g"]).collect()}
    for g in (0, 1, 2, None):
        mine = sorted(v for (h, v) in got if h == g)
        assert [got[g, v] for v in mine] == list(range(1, len(mine) + 1))
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(70)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    roots = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_exact_dedup(spark, docs, none):
    got = exact_dedup.report(docs, support=0.1).collect()
    assert len(got) == docs.count()
    by = {}
    for r in corpus():
        by.setdefault(squeezed(r[1]), []).append(r)
    want = {}
    for t, rows in by.items():
        best = min(rows, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        want[hashlib.sha256(t.encode()).hexdigest()] = (best[0], len(rows))
    assert all(want[r.text_sha256] == (r.keep_id, r.group_size) for r in got)
    assert sum(r.kept for r in got) == len(by)
    kept = exact_dedup.deduplicate(docs, support=0.1)
    assert kept.columns == docs.columns
    assert sorted(squeezed(r.text) for r in kept.collect()) == sorted(by)
    assert exact_dedup.report(none).count() == 0 and exact_dedup.deduplicate(none).count() == 0


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, (_, a)), (j, (_, b)) in itertools.combinations(enumerate(sets), 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d if d is not None else -1, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(sets))


def edited(rng, base, rate):
    return [w if rng.random() > rate else rng.choice("xyz") + str(rng.randrange(99)) for w in base]


@pytest.mark.parametrize("leaf", [64, 3])
def test_jaccard_join(spark, none, leaf, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    rng = random.Random(leaf)
    rows = [(r[0], r[1]) for r in corpus()]
    passage = words(77, 30)
    for i in range(60):
        base = words(100 + i // 12, 80)
        rows.append((1000 + i, " ".join(edited(rng, base, 0.02 if i % 3 else 0.06) + passage)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.components(docs).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, [(-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in got])) == sorted(map(key, brute_components(rows)))
    assert jaccard_join.components(none).count() == 0
    kept = jaccard_join.representatives(docs)
    stays = {r.doc_id for r in got if r.doc_id is not None and r.doc_id == r.component_id}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == stays


def test_mixing(spark, docs, none):
    rows = mixing.report(docs).collect()
    assert len(rows) == docs.count()
    total, by = 0, {}
    for r in corpus():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        by[r[3]] = by.get(r[3], 0) + n
        total += n
    targets = {r.source_size: r.target for r in rows}
    assert set(targets) == set(by.values())
    assert all(t <= 2 * s for s, t in targets.items()) and sum(targets.values()) <= 1.5 * total + 1e-6
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    again = sorted(map(str, mixing.report(docs.repartition(2)).collect()))
    assert again == sorted(map(str, rows))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(word_count(F.col("text")))).first()[0] == sum(r.taken for r in rows)
    assert mixing.report(none).count() == 0 and mixing.mix(none).count() == 0


def test_mixing_is_close_to_its_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * i % 97)), f"s{i % 6}") for i in range(3000)]
    got = mixing.report(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) < 0.01 * r.target + 200


def test_sharding(spark, docs, none):
    limit = 5000
    rows = sharding.shards(docs, limit).collect()
    assert len(rows) == docs.count()
    size = {}
    for r in rows:
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
    assert all(r.shard_bytes == size[r.shard] for r in rows)
    assert all(s <= limit or sum(r.shard == k for r in rows) == 1 for k, s in size.items())
    names = [k for k in size if "." not in k]
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    assert sharding.shards(none).count() == 0
    copies = spark.createDataFrame([(1, "x" * 100)] * 50, "doc_id long, text string")
    pages = sharding.shards(copies, 1000).groupBy("shard").agg(F.sum("n_bytes").alias("n")).collect()
    assert sorted(p.n for p in pages) == [1000] * 5


def test_sharding_stops_at_single_documents_and_deep_buckets(spark):
    """An oversized document is alone, wholly repeated rows are paged, the rest is as plain splitting has it."""
    rng = random.Random(8)
    rows = [(i, "x" * rng.randrange(1, 400)) for i in range(120)] + [(500, "y" * 9000), (501, "z" * 700)] + [(501, "z" * 700)] * 4 + [(None, None)] * 3
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 1500).collect()

    def code(i, t):
        inner = hashlib.md5((t or "").encode()).hexdigest()
        return int(hashlib.md5(f"{'' if i is None else i}:{inner}".encode()).hexdigest()[:15], 16)

    def split(items, depth, prefix):
        size = sum(len(t or "") for _, t in items)
        if not items or size <= 1500 or len({code(*r) for r in items}) == 1:
            return [(r, prefix, size) for r in items]
        halves = [[r for r in items if code(*r) >> (59 - depth) & 1 == bit] for bit in (0, 1)]
        return [x for bit, half in enumerate(halves) for x in split(half, depth + 1, prefix + str(bit))]

    want = split(rows, 0, "")
    plain = sorted((str(r[0]), len(r[1] or ""), p, n) for r, p, n in want if r[0] != 501)
    assert sorted((str(r.doc_id), r.n_bytes, r.shard, r.shard_bytes) for r in got if r.doc_id != 501) == plain
    pages = sorted((r.shard, r.shard_bytes) for r in got if r.doc_id == 501)
    bits = next(p for r, p, _ in want if r[0] == 501)
    assert pages == [(f"{bits}.0", 1400)] * 2 + [(f"{bits}.1", 1400)] * 2 + [(f"{bits}.2", 700)]


def test_language_id(spark, none):
    rng = random.Random(3)
    sound = {"aa": "the and of ing", "bb": "der und ich ung", "cc": "que les eau çon"}
    rows = []
    for i in range(240):
        lang = list(sound)[i % 3]
        rows.append((i, " ".join(rng.choice(sound[lang].split()) + rng.choice(sound[lang].split()) for _ in range(30)), lang))
    rows += [(900, None, "aa"), (901, "123 !!", "aa"), (None, "the and of", "bb"), (902, "derich " * 20000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in language_id.report(docs).collect()}
    held = [i for i in range(240) if got[i].held_out]
    assert 40 < len(held) < 120 and all(got[i].lang_pred == rows[i][2] for i in held)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0
    assert got[902].lang_pred == "bb" and got[None].held_out is False
    kept = language_id.identified(docs, language_id.train(docs))
    assert kept.columns == docs.columns and {900, 901}.isdisjoint(r.doc_id for r in kept.collect())
    assert language_id.report(none).count() == 0
    unlabelled = language_id.report(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in unlabelled] == ["und"]


def test_quality(spark, docs, none):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(200):
        good = i % 4 > 0
        text = " ".join(words(i, 60)) + "." if good else " ".join(w + "###" for w in words(rng.randrange(5), 4)) * 9
        rows.append((i, text, "en", f"h{i % 4}"))
        labels.append((i, int(good), 0))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.report(d, lab).collect()}
    assert all(got[i].kept == bool(labels[i][1]) for i in got)
    assert got[1].host_posterior > got[0].host_posterior
    assert quality.report(docs, lab).count() == docs.count()
    assert quality.report(docs, lab.limit(0)).where("kept").count() == docs.count()
    assert quality.report(none, lab).count() == 0


def test_sentencepiece(spark, docs, none):
    rows = sentencepiece_codec.encode(docs).collect()
    assert len(rows) == docs.count() and all(r.round_trip for r in rows)
    assert all((r.ids is None) == (r.doc_id in (0,) or (r.doc_id is None and r.ids is None)) for r in rows)
    back = {r.doc_id: r.decoded for r in sentencepiece_codec.decoded(sentencepiece_codec.encode(docs)).collect() if r.doc_id is not None}
    assert all(back[r[0]] == r[1] for r in corpus() if r[0] is not None)
    assert sentencepiece_codec.encode(none).count() == 0
    v = sentencepiece_codec.load()
    e = sentencepiece_codec.Encoder(v)
    score = {v.spelling[i].replace(b" ", b"\xff"): s for i, s in zip(v.ids.tolist(), v.scores, strict=True)}

    def best(unit):  # over all ways to cut it
        if not unit:
            return 0.0
        ways = [score[unit[:n]] + best(unit[n:]) for n in range(1, len(unit) + 1) if unit[:n] in score]
        return max([*ways, v.fallback + best(unit[1:])])

    value = dict(zip(v.ids.tolist(), v.scores, strict=True))
    for unit in (b"\xffthe", b"\xffqzxj", b"\xff\xc3\xa9t", b"ab1", b"\xff\xff\xffa"):
        ids = e._many([unit])[0].tolist()
        assert ids == e._one(unit)
        assert abs(sum(value.get(i, v.fallback) for i in ids) - best(unit)) < 1e-9


def test_chat_format(spark):
    said = ["", "hello", "</s>[INST] ok [/INST]", "\\</s> \\\\[ROLE]", " [/INST]</s>\n<s>[ROLE] user [/ROLE] [INST] x [/INST]</s>\n", "é😀\n", None, "end\\"]
    rows = [(c, t, ["user", "assistant", "system", None, "[/ROLE]"][(c + t) % 5], said[(c * 3 + t) % 8]) for c in range(6) for t in range(c + 1)]
    rows += [(99, i, "user" if i % 2 else "assistant", f"m{i}") for i in range(70)] + [(7, 0, "user", "a"), (7, 0, "user", "a"), (None, 0, "user", "n")]
    got = {r.conv_id: r for r in chat_format.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c))
        every = "".join(f"{r}\n{x}\n" for _, r, x in mine)
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert got[c].n_turns == len(mine) and got[c].turns_sha256 == hashlib.sha256(every.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len("</s>[INST] ok [/INST]")
    assert chat_format.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 1


def test_reply_trees(spark):
    rows = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 5.0), (1, 4, 2, 9.0), (1, 5, 3, 2.0), (2, 1, None, 1.0), (2, 9, 404, 1.0)]
    m = spark.createDataFrame([(c, i, p, "user", f"t{i}", s) for c, i, p, s in rows], "conv long, id long, parent long, role string, text string, score double")
    found = chat_format.paths(m)
    paths = {}
    for r in found.collect():
        paths.setdefault((r.conv, r.leaf), {})[r.up] = r.id
    assert {k: [v[n] for n in sorted(v, reverse=True)] for k, v in paths.items()} == {(1, 4): [1, 2, 4], (1, 5): [1, 3, 5], (2, 1): [1], (2, 9): [9]}
    assert {r.leaf for r in chat_format.chosen(m, found, 1).where("conv = 1").collect()} == {4}
    assert {r.leaf for r in chat_format.chosen(m, found, 2).where("conv = 1").collect()} == {4, 5}


def test_fingerprints(spark, docs, none):
    rows = fingerprints.report(docs).collect()
    assert len(rows) == docs.count()
    texts = {r[0]: r[1] or "" for r in corpus() if r[0] is not None}
    assert len({r.fingerprint for r in rows if (r.doc_id is not None and texts[r.doc_id].lower().split() == texts[5].split())}) == 1
    ids = sorted(texts, reverse=True)
    after = dict(zip(ids, ids[1:], strict=False))
    got = {r.doc_id: r for r in rows}
    for d, n in after.items():
        t = texts[d]
        m = len(t) // 3
        e = t[: len(t) - m] + texts[n][:m]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        low = lambda x: shingles(x.lower())
        a, b, c = low(t), low(e), low(texts[n])
        for near, x in ((got[d].near_edited, b), (got[d].near_next, c)):
            exact = len(a & x) / len(a | x) if a | x else 1.0
            assert abs(near - exact) < (1e-9 if max(len(a), len(x)) < 128 else 0.2)
    assert fingerprints.report(none).count() == 0
    a, b = (spark.range(1).select(F.array_sort(F.transform(F.sequence(F.lit(x), F.lit(x + 999)), lambda i: F.xxhash64(i))).alias("s")) for x in (0, 500))
    ab = a.select(F.slice("s", 1, 128).alias("a")).join(b.select(F.slice("s", 1, 128).alias("b")))
    r = ab.select(fingerprints.resemblance(F.col("a"), F.col("b")), fingerprints.containment(F.col("a"), F.col("b")), fingerprints.distinct_count(F.col("a"))).first()
    assert abs(r[0] - 1 / 3) < 0.13 and abs(r[1] - 0.5) < 0.2 and abs(r[2] / 1000 - 1) < 0.3


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def counts_as(kind, x):
    d = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(d[::-1])]
        return 12 <= len(d) <= 19 and sum(n - 9 if n > 9 else n for n in twice) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def test_pii(spark, docs, none):
    rng = random.Random(9)
    odd = ["a@b.c%d@e.f.g", "x@y@z.com 1.2.3.4.5.6.7.8 999.1.1.1 0001.002.3.255", "+1 (234) 555-1234x +12 +123456789012345678", "5" * 20000,
           "a" * 50000 + "@", "1." * 20000, "+1" * 5000, "a@b.cc " * 500, "1 2 3 4 5 6 7 8 9 " * 300]
    odd += ["".join(rng.choice("01234569.@+-() ab") for _ in range(300)) for _ in range(150)]
    extra = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    rows = pii.report(both).collect()
    texts = {r[0]: r[1] or "" for r in corpus() if r[0] is not None} | {5000 + i: t for i, t in enumerate(odd) if i != 4}
    for r in rows:
        if r.doc_id not in texts:
            continue
        found = sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(KINDS) for m in re.finditer(p, texts[r.doc_id]) if counts_as(k, m[0]))
        base = [f"{KINDS[i][0]}:{a}:{b}" for a, i, b in found]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), texts[r.doc_id][:80]
        assert set(base) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(i == k for _, i, _ in found) for k in range(4)]
    assert len(rows) == both.count() and pii.report(none).count() == 0
