"""What surrounds models: retries, batches with a fallback, repair of cut-off answers, averages of attention."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.chunk import retry_sizes, shortened
from quern.operators.rerank import Summarizer

ATTEMPTS, PAUSE = 3, 0.5


def retried(call: Callable, *args, attempts: int = ATTEMPTS, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep):
    """call(*args), tried again after pauses that double; the last error is raised."""
    for n in range(attempts):
        try:
            return call(*args)
        except Exception:
            if n + 1 == attempts:
                raise
            sleep(pause * 2**n)


def shortening(call: Callable[[str], object], text: str, recoverable: Callable[[Exception], bool]) -> object:
    """call(text); where the error says that the text is too long, again with its first lines, ever fewer of them."""
    try:
        return call(text)
    except Exception as first:
        if not recoverable(first):
            raise
        error = first
    for most in retry_sizes():
        try:
            return call(shortened(text, most))
        except Exception as e:
            error = e
    raise error


def in_batches(items: list, call: Callable[[list], list], size: int = 2) -> list:
    """Results of items in batches; a batch that fails or answers short is done item by item, and an item that fails is None."""
    out: list = []
    for at in range(0, len(items), size):
        part = items[at : at + size]
        try:
            got = call(part)
            if len(got) != len(part):
                raise ValueError("an answer is missing")
        except Exception:
            got = []
            for x in part:
                try:
                    got += call([x])[:1] or [None]
                except Exception:
                    got.append(None)
        out += got
    return out


def summarised(blocks: DataFrame, summarizer: Summarizer, text_col: str = "content", most_lines: int = 1000, size: int = 2) -> DataFrame:
    """blocks with `summary`, asked for in batches; blocks of more lines than `most_lines` have none, nor have those for which
    the summarizer fails alone."""

    def work(texts: pd.Series) -> pd.Series:
        asked = [i for i, x in enumerate(texts) if x is not None]
        got = in_batches([texts.iloc[i] for i in asked], lambda part: list(summarizer.summarize(pd.Series(part))), size)
        out: list = [None] * len(texts)
        for i, x in zip(asked, got, strict=True):
            out[i] = x
        return pd.Series(out, dtype=object)

    lines = F.size(F.split(text_col, "\n", -1))
    fitting = F.when(lines <= most_lines, F.col(text_col))
    return blocks.withColumn("summary", F.pandas_udf(work, "string")(fitting))


def outcomes(rows: DataFrame, answer: str = "summary", asked: str = "content") -> DataFrame:
    """(asked, done, failed): how many rows had something to ask, and how many of those have an answer or none."""
    there = F.col(asked).isNotNull()
    done = F.count_if(there & F.col(answer).isNotNull())
    return rows.agg(F.count_if(there).alias("asked"), done.alias("done"), F.count_if(there & F.col(answer).isNull()).alias("failed"))


def repaired_json(text: str):
    """JSON whose end is missing or whose brackets do not match: closed by what is still open; None if that fails."""
    start = next((i for i, c in enumerate(text) if c in "{["), None)
    if start is None:
        return None
    open_, out, quoted, escaped = [], "", False, False
    for c in text[start:]:
        if quoted:
            quoted, escaped = (c != '"' or escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            if not open_ or open_[-1] != c:
                continue  # a stray bracket
            open_.pop()
        out += c
        if not open_ and not quoted:
            break
    for tail in ('"' if quoted else "", ""):
        body = (out + tail).rstrip().rstrip(",")
        try:
            return json.loads(body + "".join(reversed(open_)))
        except ValueError:
            continue
    return None


def attention_scores(weights: DataFrame) -> DataFrame:
    """(pos, score): attention (head, query, pos, weight) averaged over all heads and queries."""
    n = weights.agg(F.count_distinct("head", "query")).first()[0]
    return weights.groupBy("pos").agg((F.sum("weight") / F.lit(max(n, 1))).alias("score"))


def highlight_summary(lines: DataFrame) -> DataFrame:
    """(file, score, kept): sums of line scores and counts of kept lines (file, score, kept boolean)."""
    return lines.groupBy("file").agg(F.round(F.sum("score"), 4).alias("score"), F.count_if("kept").alias("kept"))


def outline_targets(text: str, folders: Iterable[str] = ()) -> list[str]:
    """Path patterns of a comma list of targets; a folder stands for the files in it, ! excludes."""
    from quern.plans.requests import split_filters

    known = {f.rstrip("/") for f in folders}
    out = []
    for t in split_filters(text):
        out.append(t.rstrip("/") + "/*" if t.rstrip("/") in known or t.endswith("/") else t)
    return out
