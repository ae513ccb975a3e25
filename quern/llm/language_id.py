"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: the text in lower case, every run of characters other than letters as one boundary; n-grams of 1 to 3
characters hashed into 2^BITS buckets; tf = log(1 + count), times idf, L2-normalised. Document frequencies come from
every learnable document. The weights are trained with FTRL-proximal under an elastic-net penalty (L1 makes them
sparse) on a bounded sample of at most about SAMPLE learnable documents (or EACH for each language, if that is more),
spread evenly over the languages; a fifth of the sample, but never the only document of a language, is kept back to fit
the softmax temperature. Sample, order and result are deterministic.

Every language of a learnable document is learned. The weights grow with the languages, so more than LANGUAGES of them
are an error: none is left out in silence.

A document is learnable when its language is known and crc32 of its id (as text) leaves a remainder other than 1 by 3.
A prediction looks at the text alone.

Defined results: `und` with score 0 for a null text and for one without a letter, and for all texts when there is
nothing to learn from. Rows with a null id are predicted but not learned from. Repeated rows are rows of their own, but of rows
that share an id (and language) one is drawn to learn from. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BITS = 14
BUCKETS = 1 << BITS
#: Documents to learn from at most (about), but so many of each language; languages beyond which training is refused.
SAMPLE, EACH, LANGUAGES = 6000, 10, 1000
#: FTRL-proximal: learning rate, its smoothing, L1 and L2 penalties, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.1, 2
#: Least score of a document that the filter keeps.
LEAST_SCORE = 0.5

_SIDES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a text; None without a letter."""
    if not text:
        return None
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[chars]
    if not is_letter.any():
        return None
    chars = np.where(is_letter, chars, 0).astype(np.uint32)
    keep = np.ones(len(chars), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    chars = np.concatenate([[0], chars[keep], [0]]).astype(np.uint32)
    shift = np.uint32(32 - BITS)

    def bucket(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        return ((x ^ (x >> np.uint32(13))) * np.uint32(0x297A2D39)) >> shift

    one = chars * _SIDES[0]
    two = one[:-1] + chars[1:] * _SIDES[1] + np.uint32(1)
    three = two[:-1] + chars[2:] * _SIDES[2] + np.uint32(1)
    return np.bincount(bucket(np.concatenate([one, two, three])), minlength=BUCKETS)


def weigh(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(n, dtype=np.float32) * idf
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    idf: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None], block: int = 128) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        for start in range(0, len(texts), block):
            known = [(i, n) for i, t in enumerate(texts[start : start + block], start) if (n := counts(t)) is not None]
            found = ["und"] * len(texts[start : start + block])
            if known and self.languages:
                p = softmax(weigh(np.stack([n for _, n in known]), self.idf) @ self.weights / self.temperature)
                for (i, _), best, row in zip(known, p.argmax(axis=1), p, strict=True):
                    found[i - start], scores[i] = self.languages[best], float(row[best])
            names += found
        return names, scores


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from sparse rows (buckets, values), one FTRL-proximal step a row."""
    z, n = np.zeros((BUCKETS, n_classes)), np.zeros((BUCKETS, n_classes))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for (at, value), label in zip(x, y, strict=True):
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            error = softmax(value @ w)
            error[label] -= 1
            g = value[:, None] * error
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[at] = more
    # in blocks, for the intermediate arrays would be several times the weights
    return np.concatenate([weights(z[i : i + 1024], n[i : i + 1024]).astype(np.float32) for i in range(0, BUCKETS, 1024)])


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature that minimises the negative log-likelihood, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()

    a, b, r = -5.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, documents) over a task; bucket -1 counts the documents."""
    df, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if (c := counts(text)) is not None:
                df += c > 0
                n += 1
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.r_[np.arange(BUCKETS), -1].astype(np.int64)), pa.array(np.r_[df, n])], ["bucket", "n"]
    )


def _trainer(languages: list[str], idf: np.ndarray):
    """Trains on all rows (text, lang, turn) that come to its task: a bounded sample."""
    number = {name: i for i, name in enumerate(languages)}

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for text, lang, turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (c := counts(text)) is not None:
                    at = np.flatnonzero(c)
                    rows.append((turn, number[lang], at, weigh(c[at], idf[at]).astype(np.float64)))
        if not rows:
            return
        rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
        y = np.array([r[1] for r in rows])
        apart = np.arange(len(rows)) % 5 == 4
        apart[np.unique(y, return_index=True)[1]] = False
        fit = np.flatnonzero(~apart)
        w = train_ftrl([rows[i][2:] for i in fit], y[fit], len(languages))
        held = np.flatnonzero(apart)
        logits = np.array([rows[i][3] @ w[rows[i][2]] for i in held]).reshape(len(held), len(languages))
        t = fit_temperature(logits, y[held])
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([t])], ["weights", "temperature"])

    return train


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    rest = F.crc32(F.col(id_col).cast("string")) % 3
    known = docs.where((rest != 1) & F.col(lang_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.lit("language")).alias("turn")
    )
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} values of {lang_col} to learn: their weights grow too large for a task")
    languages = sorted(r["lang"] for r in sizes)
    blank = Model([], np.zeros((BUCKETS, 0), np.float32), np.ones(BUCKETS, np.float32), 1.0)
    if not languages:
        return blank
    df = known.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n = int(df.loc[df["bucket"] == -1, "n"].sum())
    by_bucket = np.zeros(BUCKETS)
    df = df[df["bucket"] >= 0]
    by_bucket[df["bucket"].to_numpy()] = df["n"].to_numpy()
    idf = (np.log((1 + n) / (1 + by_bucket)) + 1).astype(np.float32)
    quota = max(EACH, SAMPLE // len(languages))
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, quota / r["count"])))])
    drawn = known.where(F.pmod("turn", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    # one row an id, so that an id that many rows share cannot make the sample grow
    drawn = drawn.groupBy("lang", "turn").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("t.text", "lang", "turn")
    rows = drawn.repartition(1).mapInArrow(_trainer(languages, idf), "weights binary, temperature double").collect()
    if not rows:
        return blank
    w = np.frombuffer(bytes(rows[0]["weights"]), np.float32).reshape(BUCKETS, len(languages))
    return Model(languages, w, idf, rows[0]["temperature"])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col).mapInArrow(work, f"doc_id {kind}, lang_pred string, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, model: Model, least: float = LEAST_SCORE, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is known with a score of at least `least`; same columns, one pass, no shuffle."""
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    # by place instead of by name, since a name may hold a dot
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(work, plain.schema).toDF(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))
