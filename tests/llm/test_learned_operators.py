"""What is learned, against plain versions: posteriors and fit of the quality classifier, FTRL, idf and temperature."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from quern.llm import language_id as lid
from quern.llm import quality


@pytest.fixture(scope="module")
def sites(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        host, path = [("h0", "a"), ("h0", "b"), ("h1", "a"), (None, "c"), (f"rare{i}", None)][min(4, rng.randrange(6))]
        good = rng.random() < {"h0": 0.9, "h1": 0.2}.get(host, 0.6)
        text = " ".join(rng.choice(["plain", "words", "here."]) if good or rng.random() < 0.4 else "#%$ 7 7" for _ in range(rng.randrange(3, 40)))
        rows.append((i % 390 if i % 50 else None, text if i % 37 else None, host, path, "clash", 1.0))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string, score string, p double").repartition(3)
    return docs, spark.createDataFrame(labels + [(5, 1), (None, 1)], "doc_id long, quality int")


def test_posteriors_against_a_plain_version(sites):
    docs, labels = sites
    from pyspark.sql import functions as F

    got = quality.scores(docs, labels, F.col("host"), F.col("path")).collect()
    assert len(got) == docs.count()
    hosts, paths = {}, {}
    for r in got:
        hosts.setdefault(r.host, []).append(r.p)
        paths.setdefault((r.host, r.path), []).append(r.p)
    mean = sum(r.p for r in got) / len(got)

    def strength(groups, prior):
        spread = base = n = 0.0
        for key, ps in groups.items():
            m = sum(ps) / len(ps)
            var = sum((x - m) ** 2 for x in ps) / len(ps)
            spread += len(ps) * ((m - prior[key]) ** 2 - var / len(ps))
            base += len(ps) * prior[key] * (1 - prior[key])
            n += len(ps)
        return quality.STRENGTH[1] if spread <= 0 else min(max(base / spread - 1, quality.STRENGTH[0]), quality.STRENGTH[1])

    k = strength(hosts, dict.fromkeys(hosts, mean))
    host_post = {h: (sum(ps) + k * mean) / (len(ps) + k) for h, ps in hosts.items()}
    j = strength(paths, {key: host_post[key[0]] for key in paths})
    logit = lambda x: math.log(min(max(x, 1e-4), 1 - 1e-4) / (1 - min(max(x, 1e-4), 1 - 1e-4)))
    for r in got:
        ps, prior = paths[r.host, r.path], host_post[r.host]
        assert r.host_posterior == pytest.approx(prior, abs=1e-9)
        assert r.path_posterior == pytest.approx((sum(ps) + j * prior) / (len(ps) + j), abs=1e-9)
        rest = (sum(ps) - r.p + j * prior) / (len(ps) - 1 + j)
        score = 1 / (1 + math.exp(-(logit(r.p) + logit(rest) - logit(mean))))
        assert r.score == pytest.approx(score, abs=1e-9) and r.kept == (r.score >= quality.LEAST_SCORE)
    lone = [r for r in got if r.host and r.host.startswith("rare")]
    assert lone and all(abs(r.host_posterior - mean) < abs(r.p - mean) + 1e-12 for r in lone)


def test_the_regression_is_at_its_minimum():
    rng = np.random.default_rng(1)
    x = np.c_[np.ones(300), rng.normal(size=(300, 3)) * [1, 5, 0.1]]
    y = (x @ [0.3, 1.0, -0.4, 2.0] + rng.normal(size=300) > 0).astype(float)
    w, scale = quality.fit(x, y), np.abs(x).max(axis=0)

    def loss(v):
        z = (x / scale) @ v
        return np.mean(np.logaddexp(0, z) - y * z) + quality.RIDGE / 2 * v @ v

    best = w * scale
    for i in range(4):
        for step in (-1e-3, 1e-3):
            assert loss(best + step * np.eye(4)[i]) > loss(best)
    assert quality.fit(x, np.ones(300)) is None


def test_a_label_that_many_rows_share_is_learned_from_once(spark, monkeypatch):
    rows = [(1, f"text {i}") for i in range(500)] + [(i, "a b c." if i % 2 else "#### 1 2") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(y)) or fit(x, y))
    quality.train(docs, labels)
    assert seen == [39]


def plain_ftrl(rows, y, n_classes, epochs):
    """FTRL-proximal one coordinate at a time."""
    z, n = {}, {}

    def weight(key):
        a, b = z.get(key, 0.0), n.get(key, 0.0)
        if abs(a) <= lid.L1:
            return 0.0
        return -(a - math.copysign(lid.L1, a)) / ((lid.BETA + math.sqrt(b)) / lid.ALPHA + lid.L2)

    for _ in range(epochs):
        for (at, value), label in zip(rows, y, strict=True):
            w = {(i, c): weight((i, c)) for i in at.tolist() for c in range(n_classes)}
            logits = [sum(v * w[i, c] for i, v in zip(at.tolist(), value.tolist(), strict=True)) for c in range(n_classes)]
            top = max(logits)
            e = [math.exp(x - top) for x in logits]
            for c in range(n_classes):
                error = e[c] / sum(e) - (c == label)
                for i, v in zip(at.tolist(), value.tolist(), strict=True):
                    g = v * error
                    old = n.get((i, c), 0.0)
                    sigma = (math.sqrt(old + g * g) - math.sqrt(old)) / lid.ALPHA
                    z[i, c] = z.get((i, c), 0.0) + g - sigma * w[i, c]
                    n[i, c] = old + g * g
    return {key: weight(key) for key in z}


def test_ftrl_against_a_plain_version():
    rng = np.random.default_rng(3)
    rows, y = [], []
    for i in range(60):
        at = np.sort(rng.choice(40, size=rng.integers(3, 12), replace=False))
        value = rng.random(len(at))
        rows.append((at, value / np.linalg.norm(value)))
        y.append(i % 3)
    w = lid.train_ftrl(rows, np.array(y), 3, epochs=2)
    plain = plain_ftrl(rows, y, 3, 2)
    for (i, c), x in plain.items():
        assert w[i, c] == pytest.approx(x, abs=1e-5)
    assert not w[40:].any()


def test_the_penalty_makes_weights_sparse(monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(np.sort(rng.choice(200, 20, replace=False)), np.full(20, 20**-0.5)) for _ in range(50)]
    y = np.arange(50) % 2
    zeros = []
    for penalty in (0.0, 0.05, 50.0):
        monkeypatch.setattr(lid, "L1", penalty)
        zeros.append(int((lid.train_ftrl(rows, y, 2)[:200] == 0).sum()))
    assert zeros[0] < zeros[1] < zeros[2] == 400


def test_temperature_against_a_grid():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 400)
    logits = 6 * (np.eye(3)[y] + rng.normal(scale=0.8, size=(400, 3)))
    loss = lambda t: -np.log(lid.softmax(logits / t)[np.arange(400), y] + 1e-12).mean()
    t = lid.fit_temperature(logits, y)
    assert t > 1.5 and loss(t) <= min(loss(x) for x in np.geomspace(0.01, 20, 4000)) + 1e-9
    assert lid.fit_temperature(logits[:0], y[:0]) == 1.0


def test_document_frequencies_and_counts(spark):
    texts = ["Aa b", "a-a!", "", None, "123", "ß é", "b b b"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {r.bucket: r.n for r in rows.mapInArrow(lid._frequencies, "bucket long, n long").groupBy("bucket").agg({"n": "sum"}).toDF("bucket", "n").collect()}
    each = [c for t in texts if (c := lid.counts(t)) is not None]
    assert got[-1] == len(each) == 4
    assert all(got[b] == sum(c[b] > 0 for c in each) for b in range(lid.BUCKETS))
    # runs of anything but letters are one boundary, so these agree; n characters with their boundaries have 3n + 3 n-grams
    assert (lid.counts("a-1!b") == lid.counts("A  B")).all()
    assert lid.counts("abc").sum() == 5 + 4 + 3


def test_an_id_that_many_rows_share_is_drawn_once(spark, monkeypatch):
    rows = [(3, f"the and number {i}", "aa") for i in range(400)] + [(i, "der und das", "bb") for i in range(1000, 1060)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    seen = spark.sparkContext.accumulator(0)
    made = lid._trainer

    def counted(*args):
        work = made(*args)

        def run(batches):
            def through():
                for b in batches:
                    seen.add(b.num_rows)
                    yield b

            return work(through())

        return run

    monkeypatch.setattr(lid, "_trainer", counted)
    model = lid.train(docs)
    import zlib

    ids = Counter(i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1)
    assert seen.value == len(ids) and model.languages == (["aa", "bb"] if 3 in ids else ["bb"])
