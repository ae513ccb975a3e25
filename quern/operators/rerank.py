"""Reranking and highlighting: score arithmetic, parsing of model answers, and local stand-ins behind the protocols."""

from __future__ import annotations

import bisect
import hashlib
import json
import math
import re
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: How many hits a language model scores at once.
BATCH = 10


class Embedder(Protocol):
    def embed(self, texts: pd.Series) -> pd.Series: ...


class Scorer(Protocol):
    def score(self, query: str, texts: pd.Series) -> pd.Series: ...


class Summarizer(Protocol):
    def summarize(self, texts: pd.Series) -> pd.Series: ...


class Highlighter(Protocol):
    def highlight(self, query: str, texts: pd.Series) -> pd.Series: ...


class OverlapHighlighter:
    """The lines of a text that hold a word of the query; empty where none does."""

    def highlight(self, query: str, texts: pd.Series) -> pd.Series:
        wanted = set(re.findall(r"\w+", query.lower()))
        return texts.map(lambda t: "\n".join(x for x in (t or "").split("\n") if wanted & set(re.findall(r"\w+", x.lower()))))


class HashingEmbedder:
    """A deterministic embedder without a model: signed hashes of words, L2-normalised."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def one(self, text: str) -> list[float]:
        v = [0.0] * self.dimension
        for word in re.findall(r"\w+", (text or "").lower()):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            v[h % self.dimension] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / n for x in v]

    def embed(self, texts: pd.Series) -> pd.Series:
        return texts.map(self.one)


class OverlapScorer:
    """Share of the query's words that a text holds, from 0 to 10."""

    def score(self, query: str, texts: pd.Series) -> pd.Series:
        wanted = set(re.findall(r"\w+", query.lower()))
        return texts.map(lambda t: 10.0 * len(wanted & set(re.findall(r"\w+", (t or "").lower()))) / max(1, len(wanted)))


class FirstSentence:
    def summarize(self, texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: re.split(r"(?<=[.!?])\s", (t or "").strip(), maxsplit=1)[0])


def embedded(rows: DataFrame, embedder: Embedder, text_col: str = "text") -> DataFrame:
    """rows with `embedding`; null texts have null vectors, aligned with their rows."""
    to = F.pandas_udf(lambda s: embedder.embed(s.fillna("")), "array<float>")
    return rows.withColumn("embedding", F.when(F.col(text_col).isNotNull(), to(F.col(text_col))))


def reranked(hits: DataFrame, query: str, scorer: Scorer, text_col: str = "text", least: float | None = None) -> DataFrame:
    """hits with `original_score` and the scorer's `score`, best first."""
    to = F.pandas_udf(lambda s: scorer.score(query, s).astype("float64"), "double")
    rows = hits.withColumn("original_score", F.col("score")).withColumn("score", F.round(to(F.col(text_col)), 6))
    if least is not None:
        rows = rows.where(F.col("score") >= least)
    return rows.orderBy(F.desc("score"), F.desc("original_score"), "id")


def scoring_prompt(query: str, snippets: list[tuple[str, str]]) -> str:
    """What a language model is asked about snippets (context header, text): one score from 0 to 10 each, as one JSON object."""
    shown = [f"## snippet {i} {head}\n```\n{text}\n```\n---" for i, (head, text) in enumerate(snippets, 1)]
    wanted = ", ".join(f"score of snippet {i}" for i in range(1, len(snippets) + 1))
    ask = (
        "Judge how well each snippet answers the search. Give a number from 0 (has nothing to do with it) to 10 (is what was asked for);"
        " what only touches the subject gets less than 4, what treats it at least 7."
    )
    return "\n".join([ask, f"Search: {query}", *shown, f'Answer with one JSON object and nothing else: {{"scores": [{wanted}]}}'])


def model_reranked(
    hits: DataFrame, query: str, answer: Callable[[str], str], size: int = BATCH, least: float | None = None, attempts: int = 3, pause: float = 1.0
) -> DataFrame:
    """hits (id, path, hierarchy_display, content, score, ...) with `original_score` and a language model's `score`, best first.

    The hits are a page of results. They go to the model in batches by their order, each batch a task of its own; a batch
    that fails is tried again after pauses that double, and at last gets scores that keep its place and order. What the
    model leaves out counts 0.
    """
    order = Window.orderBy(F.desc("score"), "id")  # a page of hits, never a table
    head = context_header(F.col("hierarchy_display"), F.col("path"))
    rows = hits.withColumn("__n", F.row_number().over(order) - 1).withColumn("__batch", F.floor(F.col("__n") / size).cast("int")).withColumn("__head", head)

    def work(part: pd.DataFrame) -> pd.DataFrame:
        from quern.operators.models import retried

        part = part.sort_values("__n")
        prompt = scoring_prompt(query, list(zip(part["__head"], part["content"].fillna(""), strict=True)))

        def once(text: str) -> list[float]:
            got = scores_from_object(answer(text), len(part))
            if got is None:
                raise ValueError("no scores in the answer")
            return got

        try:
            scores = retried(once, prompt, attempts=attempts, pause=pause)
        except Exception:
            scores = [fallback_score(int(part["__batch"].iloc[0]), i) for i in range(len(part))]
        return pd.DataFrame({"__n": part["__n"], "__score": scores})

    scored = rows.select("__n", "__batch", "__head", "content").groupBy("__batch").applyInPandas(work, "__n int, __score double")
    out = rows.join(scored, "__n").withColumn("original_score", F.col("score")).withColumn("score", F.col("__score")).orderBy(F.desc("score"), "__n")
    if least is not None:
        out = out.where(F.col("score") >= least)
    return out.drop("__n", "__batch", "__head", "__score")


def highlighted(hits: DataFrame, query: str, highlighter: Highlighter, text_col: str = "content") -> DataFrame:
    """hits with `highlighted`; what a highlighter leaves empty is not related to the query."""
    to = F.pandas_udf(lambda s: highlighter.highlight(query, s), "string")
    return hits.withColumn("highlighted", to(F.coalesce(F.col(text_col), F.lit(""))))


def cross_encoder_scores(rows: DataFrame, raw: str = "raw", by: str = "query_id") -> DataFrame:
    """rows with `score`: raw scores by 10, through a sigmoid where a query has any outside 0 to 1."""
    w = Window.partitionBy(by)
    outside = (F.min(raw).over(w) < 0) | (F.max(raw).over(w) > 1)
    return rows.withColumn("score", 10 * F.when(outside, 1 / (1 + F.exp(-F.col(raw)))).otherwise(F.col(raw)))


def head_score(cls: Column, w: list[list[float]], b: list[float], out: list[float]) -> Column:
    """sigmoid(tanh(W x + b) . out) of a vector."""
    from quern.functions.vectors import dot, linear

    hidden = F.transform(linear(cls, w, b), F.tanh)
    return 1 / (1 + F.exp(-dot(hidden, F.array(*map(F.lit, out)))))


def two_class_probability(no: Column, yes: Column) -> Column:
    return 1 / (1 + F.exp(no - yes))


def fallback_score(batch: int, place: int) -> float:
    """The score of a hit whose batch could not be scored: keeps the order of hits."""
    return 10 - 0.1 * batch - 0.01 * place


def context_header(hierarchy: Column, path: Column) -> Column:
    return F.concat_ws(" ", F.when(hierarchy.isNotNull(), F.concat(F.lit("[Context: "), hierarchy, F.lit("]"))), F.concat(F.lit("[File: "), path, F.lit("]")))


def _clamped(x) -> float:
    return min(10.0, max(0.0, float(x))) if isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x) else 0.0


def salvage_json(text: str):
    """JSON from a model's answer: as it is, in a code fence, or the first balanced object; None if there is none."""
    fenced = re.findall(r"```(?:json)?\s*(.*?)```", text, re.S)
    for t in [text, *fenced]:
        try:
            return json.loads(t)
        except ValueError:
            pass
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", text):
        try:
            return decoder.raw_decode(text[m.start() :])[0]
        except ValueError:
            continue
    return None


def scores_from_object(text: str, n: int) -> list[float] | None:
    """n scores from an answer {"scores": [...]}, clamped to 0..10, missing ones 0; None without such an object."""
    got = salvage_json(text)
    if not isinstance(got, dict) or not isinstance(got.get("scores"), list):
        return None
    return [_clamped(x) for x in [*got["scores"], *[0] * n][:n]]


def scores_from_lines(text: str, n: int) -> list[float] | None:
    """n scores from lines {"index": i, "score": s} with i from 1; the first of an index counts; None without any."""
    out: dict[int, float] = {}
    for line in re.sub(r"<think>.*?</think>", "", text, flags=re.S).splitlines():
        try:
            row = json.loads(line.strip())
        except ValueError:
            continue
        if isinstance(row, dict) and isinstance(row.get("index"), int) and 1 <= row["index"] <= n:
            out.setdefault(row["index"], _clamped(row.get("score")))
    return [out.get(i, 0.0) for i in range(1, n + 1)] if out else None


def line_range(text: str, n: int) -> tuple[int, int] | None:
    """The last valid range of lines in an answer: START a END b, La-Lb, or a b; 0 0 means none."""
    found = None
    for m in re.finditer(r"START\s+(\d+)\s+END\s+(\d+)|L(\d+)\s*-\s*L?(\d+)|^\s*(\d+)\s+(\d+)\s*$", text, re.M):
        a, b = (int(x) for x in m.groups() if x is not None)
        if a == b == 0:
            found = None
        elif 1 <= a <= b <= n:
            found = (a, b)
    return found


def token_lines(text: str, tokens: list[str]) -> list[int]:
    """The line (from 0) of each token, by a cursor that looks for the token near where it should be."""
    ends, at = [], 0
    for line in text.split("\n"):
        at += len(line) + 1
        ends.append(at)
    out, cursor = [], 0
    for token in tokens:
        bare = token.strip()
        low = max(0, cursor - 5)
        found = text.find(bare, low, cursor + len(token) + 10 + len(bare)) if bare else -1
        start = found if found >= 0 else cursor
        out.append(min(bisect.bisect_right(ends, start), len(ends) - 1))
        cursor = start + len(bare or token)
    return out


def line_scores(lines: list[int], scores: list[float], n: int) -> list[float]:
    """Mean score of the tokens of each line; 0 for lines without a token."""
    total, count = [0.0] * n, [0] * n
    for line, s in zip(lines, scores, strict=True):
        total[line] += s
        count[line] += 1
    return [t / c if c else 0.0 for t, c in zip(total, count, strict=True)]


def chunk_scores(token_scores: DataFrame, ranges: DataFrame) -> DataFrame:
    """(chunk, score): sums of token scores (pos, score) over ranges (chunk, first, last); what lies beyond counts 0."""
    places = ranges.withColumn("pos", F.explode(F.sequence("first", "last")))
    joined = places.join(token_scores, "pos", "left")
    return joined.groupBy("chunk").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("score"))
