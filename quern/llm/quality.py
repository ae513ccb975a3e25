"""Quality classification with hierarchical empirical Bayes over sites.

A logistic regression on statistics of the text (fitted on at most about SAMPLE labelled documents) gives each
document its own evidence p. Hosts and paths are summed up by grouped aggregation of that evidence over all documents.
A host's posterior is shrunk toward the global mean by a prior strength estimated from the spread between hosts
(method of moments), and a path's posterior toward its host's in the same way: sparse sites stay near their prior. A
document's score puts the posterior of its path, without the document's own share, in place of the global prior of its
own evidence: logit(score) = logit(p) + logit(path posterior without it) - logit(global mean).

Defined results: null text counts as empty; a null host or path is a site of its own. Documents with equal ids are
rows of their own (one of them is learned from); of several labels of one id the highest counts. Without labels of both kinds p is 0.5 for every
document, and all stay. An empty table gives an empty result. Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut

#: Labelled documents to fit on at most (about).
SAMPLE = 8000
#: Ridge penalty of the regression, least score of a document that is kept, bounds of a prior's strength.
RIDGE, LEAST_SCORE, STRENGTH = 1e-3, 0.5, (1.0, 1e6)
_EDGE = 1e-4
#: Bytes that are letters, digits, or belong to characters beyond ASCII.
_WORD_BYTE = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])
_FEATURES = 14


def features(text: str | None) -> np.ndarray:
    """Statistics of a text that tell prose from tables, symbol noise, repetition and fragments."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.zeros(_FEATURES)
    b = np.frombuffer(raw, np.uint8)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.fromiter((w[-1] for w in words), np.uint8, n)
    heads = np.fromiter((w[0] for w in words), np.uint8, n)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    distinct_lines = len(set(lines)) / len(lines)
    symbols = ~_WORD_BYTE[b] & (b > 32)
    return np.array(
        [
            1.0,
            np.log1p(n),
            np.log1p(n) ** 2 / 10,
            min(lengths.mean() / 10, 3.0),
            min(lengths.std() / 10, 3.0),
            symbols.mean(),
            ((b >= 48) & (b <= 57)).mean(),
            (~_WORD_BYTE[ends]).mean(),
            ((ends == 46) | (ends == 33) | (ends == 63)).mean(),
            (~_WORD_BYTE[heads]).mean(),
            ((heads >= 65) & (heads <= 90)).mean(),
            len(set(words)) / n,
            distinct_lines,
            min(np.log1p(n / len(lines)) / 5, 2.0),
        ]
    )


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """Weights of a ridge logistic regression by Newton steps; None unless both kinds occur."""
    if len(set(y.tolist())) < 2:
        return None
    w = np.zeros(x.shape[1])
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z = x / scale
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) / len(y) + RIDGE * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z / len(y) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([r.tolist() for r in rows], pa.list_(pa.float64())), batch.column(1)], ["x", "y"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray | None:
    """Weights of the document classifier, from a bounded sample of labels and one text (of the least hash) for each."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    one = one.groupBy(F.col(id_col).alias("__label_id")).agg(F.max(label_col).cast("double").alias("y"))
    n = one.count()
    if not n:
        return None
    drawn = one.where(F.pmod(F.xxhash64("__label_id", F.lit("quality")), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30)))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(drawn), F.col("__id") == F.col("__label_id"))
    # one row a label, so that an id that many rows share cannot make the sample grow
    rows = rows.groupBy("__id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"), F.first("y").alias("y"))
    got = rows.select("t.text", "y").mapInArrow(_features, "x array<double>, y double").collect()
    if not got:
        return None
    return fit(np.array([r["x"] for r in got]), np.array([r["y"] for r in got]))


def evidence(docs: DataFrame, weights: np.ndarray | None, id_col: str, text_col: str, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, p) for every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            if weights is None:
                p = np.full(len(texts), 0.5)
            else:
                p = 1 / (1 + np.exp(-np.clip(np.array([features(t) for t in texts]).reshape(-1, _FEATURES) @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.clip(p, _EDGE, 1 - _EDGE))], ["doc_id", "host", "path", "p"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"doc_id {kind}, host string, path string, p double")


def _strength(groups: DataFrame, prior: str) -> float:
    """Prior strength from the spread of group means (n, s, q: count, sum, sum of squares) around their priors."""
    m, around = F.col("s") / F.col("n"), F.col(prior)
    within = (F.col("q") / F.col("n") - m * m) / F.col("n")
    spread, base = groups.agg(
        F.sum(F.col("n") * ((m - around) * (m - around) - within)) / F.sum("n"), F.sum(F.col("n") * around * (1 - around)) / F.sum("n")
    ).first()
    if spread is None or spread <= 0:
        return STRENGTH[1]
    return float(np.clip(base / spread - 1, *STRENGTH))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(_EDGE), F.least(F.lit(1 - _EDGE), p))
    return F.log(p / (1 - p))


def scores(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_SCORE
) -> DataFrame:
    """doc_id, host, path, p, host_posterior, path_posterior, score, kept for every row of docs."""
    rows = cut(evidence(docs, train(docs, labels, id_col, text_col), id_col, text_col, host, path))
    sums = [F.count(F.lit(1)).cast("double").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")]
    paths = cut(rows.groupBy("host", "path").agg(*sums))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    total = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    mean = 0.5 if total is None else total
    hosts = cut(hosts.withColumn("mean", F.lit(mean)))
    k_host = _strength(hosts, "mean")
    post = (F.col("s") + k_host * mean) / (F.col("n") + k_host)
    hosts = hosts.select(F.col("host").alias("__host"), post.alias("host_posterior"))
    paths = cut(paths.join(hosts, F.col("host").eqNullSafe(F.col("__host"))).drop("__host"))
    k_path = _strength(paths, "host_posterior")
    paths = paths.select(F.col("host").alias("__h"), F.col("path").alias("__p"), "n", "s", "host_posterior")
    joined = rows.join(paths, F.col("host").eqNullSafe(F.col("__h")) & F.col("path").eqNullSafe(F.col("__p")), "left")
    pull = F.lit(k_path) * F.col("host_posterior")
    rest = (F.col("s") - F.col("p") + pull) / (F.col("n") - 1 + k_path)
    score = 1 / (1 + F.exp(-(_logit(F.col("p")) + _logit(rest) - _logit(F.lit(mean)))))
    out = joined.withColumn("score", score)
    return out.select(
        "doc_id", "host", "path", "p", "host_posterior", ((F.col("s") + pull) / (F.col("n") + k_path)).alias("path_posterior"),
        "score", (F.col("score") >= least).alias("kept"),
    )


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A document's host is its source, its path the language folder below it."""
    return scores(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))
