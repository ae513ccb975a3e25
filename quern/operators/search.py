"""Dense, lexical and hybrid search over chunks, and the shaping of hits.

A chunk table has `id` and `path`; vectors and texts come beside it. Scores are rounded to 6 places before they rank,
ties go to the smaller id, so equal inputs give equal results in any partitioning. Path predicates are applied before
ranking: a selective filter never starves the result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import TOKEN, folded, folded_str, tokens
from quern.functions.vectors import cosine
from quern.operators.graph import materialised
from quern.plans.requests import TextQuery, leg_budgets

K1, B = 1.2, 0.75
ROUND = 6


def dense(vectors: DataFrame, query: Column | list[float], limit: int, min_score: float | None = None, where: Column | None = None) -> DataFrame:
    """(id, score) of the nearest vectors by cosine, best first; `vectors` has id and embedding."""
    q = F.array(*map(F.lit, query)) if isinstance(query, list) else query
    rows = vectors if where is None else vectors.where(where)
    rows = rows.select("id", F.round(cosine(F.col("embedding"), q), ROUND).alias("score"))
    if min_score is not None:
        rows = rows.where(F.col("score") >= min_score)
    return rows.orderBy(F.desc("score"), "id").limit(limit)


def postings(texts: DataFrame, positions: bool = True) -> DataFrame:
    """(term, id, tf, dl, positions) from (id, text): an inverted index with document lengths."""
    words = texts.select("id", tokens(F.col("text")).alias("ts")).withColumn("dl", F.size("ts").cast("long"))
    each = words.select("id", "dl", F.posexplode("ts").alias("pos", "term"))
    aggs = [F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl")]
    if positions:
        aggs.append(F.array_sort(F.collect_list("pos")).alias("positions"))
    return each.groupBy("term", "id").agg(*aggs)


def lengths(texts: DataFrame) -> tuple[int, float]:
    """Number of texts and their mean length in tokens."""
    n, mean = texts.select(F.size(tokens(F.col("text"))).alias("dl")).agg(F.count(F.lit(1)), F.avg("dl")).first()
    return n, float(mean or 0.0)


def bm25(texts: DataFrame, query: TextQuery, limit: int | None, where: Column | None = None) -> DataFrame:
    """(id, score): BM25 over the query's parts; a phrase counts as one term that occurs where its words follow in order.

    One pass over the texts counts their tokens and every part (a text that lacks a part's first token is not searched
    for it); that narrow table is materialised, and gives document frequencies and scores.
    """
    parts = [tuple(p) for p in (split_tokens(t) for t in [*query.phrases, *query.terms]) if p]
    parts = list(dict.fromkeys(parts))
    schema = texts.select("id").schema["id"].dataType.simpleString()
    if not parts:
        return texts.sparkSession.createDataFrame([], f"id {schema}, score double")
    low = folded(F.coalesce(F.col("text"), F.lit("")))
    kept = [c for c in texts.columns if c != "text"]
    counts = materialised(
        texts.withColumn("__low", low).select(
            *kept, F.regexp_count("__low", F.lit(TOKEN)).cast("long").alias("__dl"),
            *[_times(F.col("__low"), p).cast("long").alias(f"__tf{i}") for i, p in enumerate(parts)],
        )
    )
    stats = counts.agg(
        F.count(F.lit(1)), F.avg("__dl"), *[F.coalesce(F.sum((F.col(f"__tf{i}") > 0).cast("long")), F.lit(0)) for i in range(len(parts))]
    ).first()
    n, mean, dfs = stats[0], stats[1] or 1.0, stats[2:]
    total = F.lit(0.0)
    for i, df in enumerate(dfs):
        idf = F.log(F.lit(1 + (n - df + 0.5) / (df + 0.5)))
        tf = F.col(f"__tf{i}").cast("double")
        total = total + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__dl") / F.lit(mean)))
    hit = F.greatest(*[F.col(f"__tf{i}") for i in range(len(parts))], F.lit(0)) > 0
    rows = counts.where(hit if where is None else hit & where).select("id", F.round(total, ROUND).alias("score"))
    return rows if limit is None else rows.orderBy(F.desc("score"), "id").limit(limit)


def split_tokens(text: str) -> list[str]:
    if text.isascii():
        return re.findall("[a-z0-9_.$]+", text.lower())
    import regex

    return regex.findall(TOKEN, folded_str(text))


def _times(low: Column, part: tuple[str, ...]) -> Column:
    """How often a sequence of tokens occurs in a lower-case text; overlaps count."""
    inside = TOKEN.rstrip("+")
    between = "[^" + inside.strip("[]") + "]+"
    pattern = f"(?<!{inside})(?={between.join(map(re.escape, part))}(?!{inside}))"
    return F.when(F.contains(low, F.lit(part[0])), F.regexp_count(low, F.lit(pattern))).otherwise(0)


def bm25_batch(texts: DataFrame, queries: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """(query_id, id, score, rank): the k best texts of every query (id, text) by BM25 over its distinct tokens, exactly.

    Queries come in blocks of bounded size. For a block, one pass over the texts counts its tokens; that narrow table is
    materialised. It gives document frequencies and lengths (at most one row a token and task), then scores: each text
    against all queries of the block at once, with k rows a query and task, and only those are shuffled to the final ranking.
    """
    import numpy as np
    import pandas as pd

    spark = texts.sparkSession
    n_blocks = max(1, -(-queries.count() // block))
    dealt = queries.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("b"))
    kind = texts.schema["id"].dataType.simpleString()
    schema = "query_id long, id long, score double"
    out = spark.createDataFrame([], schema)
    for b in range(n_blocks):
        asked = [(r.id, sorted(set(split_tokens(r.text or "")))) for r in dealt.where(F.col("b") == b).orderBy("id").collect()]
        words = sorted({w for _, ws in asked for w in ws})
        number = {w: i for i, w in enumerate(words)}
        if not words:
            continue
        lists: list[list[int]] = [[] for _ in words]
        for q, (_, ws) in enumerate(asked):
            for w in ws:
                lists[number[w]].append(q)
        starts = np.r_[0, np.cumsum([len(x) for x in lists])]
        of = np.array([q for x in lists for q in x])
        ids = np.array([i for i, _ in asked])

        def count(batches, number=number, find=split_tokens):
            for batch in batches:
                rows = []
                for text in batch["text"]:
                    found = find(text or "")
                    at, tf = np.unique(np.array([number[w] for w in found if w in number], dtype=np.int64), return_counts=True)
                    rows.append((len(found), at, tf))
                yield pd.DataFrame({"id": batch["id"]} | {c: [r[i] for r in rows] for i, c in enumerate(("dl", "at", "tf"))})

        counts = materialised(texts.select("id", "text").mapInPandas(count, f"id {kind}, dl long, at array<long>, tf array<long>"))

        def survey(batches, size=len(words)):
            df, n, length = np.zeros(size, np.int64), 0, 0
            for batch in batches:
                n, length = n + len(batch), length + int(batch["dl"].sum())
                for at in batch["at"]:
                    df[at] += 1
            yield pd.DataFrame({"at": np.r_[np.arange(size), -1, -2], "n": np.r_[df, n, length]})

        stats = counts.select("dl", "at").mapInPandas(survey, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas().set_index("at")["n"]
        n, mean = int(stats[-1]), stats[-2] / max(1, stats[-1]) or 1.0
        df = stats.reindex(range(len(words))).to_numpy(dtype=float)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))

        def score(batches, idf=idf, mean=mean, starts=starts, of=of, ids=ids, k=k):
            best: list[tuple] = []
            held = 0

            def top(parts):
                rows = pd.DataFrame({c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(("query_id", "id", "score"))})
                return rows.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(k)

            for batch in batches:
                for i, dl, at, tf in zip(batch["id"], batch["dl"], batch["at"], batch["tf"], strict=True):
                    if not len(at):
                        continue
                    w = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
                    sizes = starts[at + 1] - starts[at]
                    ends = np.cumsum(sizes)
                    places = np.arange(ends[-1]) + np.repeat(starts[at] - (ends - sizes), sizes)
                    total = np.bincount(of[places], weights=np.repeat(w, sizes), minlength=len(ids))
                    hit = np.flatnonzero(total > 0)
                    best.append((ids[hit], np.full(len(hit), i), np.round(total[hit], ROUND)))
                    held += len(hit)
                    if held > 200_000:
                        t = top(best)
                        best, held = [(t["query_id"].to_numpy(), t["id"].to_numpy(), t["score"].to_numpy())], len(t)
            if best:
                yield top(best)

        out = out.unionByName(counts.mapInPandas(score, schema))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranks(hits: DataFrame, name: str) -> DataFrame:
    """(id, name): ranks from 0. hits is already limited to a leg's budget, so one task suffices."""
    w = Window.orderBy(F.desc("score"), "id")
    return hits.select("id", (F.row_number().over(w) - 1).alias(name))


def fused(legs: list[DataFrame], k: int = 2) -> DataFrame:
    """(id, score, rank0, rank1, ...): reciprocal rank fusion of legs (id, score): sum of 1 / (rank + k)."""
    out = None
    for i, leg in enumerate(legs):
        r = ranks(leg, f"rank{i}")
        out = r if out is None else out.join(r, "id", "full_outer")
    score = sum((F.coalesce(1.0 / (F.col(f"rank{i}") + k), F.lit(0.0)) for i in range(len(legs))), F.lit(0.0))
    return out.withColumn("score", F.round(score, ROUND))


def hybrid_of(dense_hits: DataFrame, sparse_hits: DataFrame, limit: int, guarantee: bool = True) -> DataFrame:
    """(id, score, dense_rank, sparse_rank, place): two legs (id, score) fused; lexical hits beyond the limit are appended if guaranteed."""
    rows = fused([dense_hits, sparse_hits]).withColumnsRenamed({"rank0": "dense_rank", "rank1": "sparse_rank"})
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    keep = F.col("place") <= limit
    return rows.where(keep | F.col("sparse_rank").isNotNull() if guarantee else keep)


def hybrid(vectors: DataFrame, texts: DataFrame, query: list[float], text: TextQuery, limit: int, guarantee: bool = True,
           weights: tuple[float, float] = (1.0, 0.3), where: Column | None = None) -> DataFrame:
    """hybrid_of a dense and a lexical search, each with its share of hits."""
    n_dense, n_sparse = leg_budgets(limit, *weights)
    return hybrid_of(dense(vectors, query, n_dense, where=where), bm25(texts, text, n_sparse, where=where), limit, guarantee)


def two_hop(texts: DataFrame, question: str, first: int = 10, passages: int = 3, chars: int = 500, limit: int = 50, k: int = 60) -> DataFrame:
    """(id, score, rank0, rank1): the hits of a question and of the question with its best passages, fused at k, best first.

    The second query is the question, "Relevant context:" and the texts of the first `passages` hits, each cut to `chars`
    characters and apart by `---`; only those few texts reach the driver. Without a first hit there is none at all.
    """
    spark = texts.sparkSession

    def ask(text: str, most: int) -> DataFrame:
        rows = bm25_batch(texts, spark.createDataFrame([(0, text)], "id long, text string"), most)
        return materialised(rows.select("id", "score"))

    one = ask(question, first)
    best = one.orderBy(F.desc("score"), "id").limit(passages).join(texts, "id").orderBy(F.desc("score"), "id").select("text").collect()
    context = [t if len(t) <= chars else t[:chars] + "..." for (t,) in best if t]
    wide = question + "\n\nRelevant context:\n" + "\n---\n".join(context) if context else question
    two = ask(wide, limit) if best else one
    return fused([one, two], k).select("id", "score", "rank0", "rank1").orderBy(F.desc("score"), "id")


def without_contained(hits: DataFrame) -> DataFrame:
    """Hits (path, id, start_line, end_line, ...) without those strictly inside another hit of their file.

    With a file's distinct ranges ordered by start, the longer first, a range lies inside another one exactly if some
    range before it ends no earlier: a running maximum instead of a join of a file's hits with each other.
    """
    ranges = hits.select("path", "start_line", "end_line").distinct()
    w = Window.partitionBy("path").orderBy("start_line", F.desc("end_line")).rowsBetween(Window.unboundedPreceding, -1)
    inner = ranges.withColumn("__reach", F.max("end_line").over(w)).where(F.col("__reach") >= F.col("end_line"))
    return hits.join(inner, ["path", "start_line", "end_line"], "left_anti")


def by_file(hits: DataFrame) -> DataFrame:
    """(path, hits, top_score, avg_score, removed): files of hits, the best first; the mean is over what containment leaves."""
    kept = without_contained(hits).groupBy("path").agg(F.count(F.lit(1)).alias("kept"), F.avg("score").alias("avg_score"))
    every = hits.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top_score"))
    out = every.join(kept, "path").select("path", F.col("kept").alias("hits"), "top_score", F.round("avg_score", ROUND).alias("avg_score"), (F.col("n") - F.col("kept")).alias("removed"))
    return out.orderBy(F.desc("top_score"), "path")


def block_topk(queries: DataFrame, vectors: DataFrame, k: int, block: int = 512, slice_: int = 8192) -> DataFrame:
    """(query_id, id, score, rank) of the k nearest vectors of each query, exactly, in blocks.

    Queries are dealt into blocks, vectors into slices of bounded size; a group is one block against one slice, as a
    matrix product, and keeps k rows a query; only those are shuffled to the final ranking. A vector is sent once for
    each block, a query once for each slice. Both tables have id and embedding.
    """
    import numpy as np
    import pandas as pd

    blocks = max(1, -(-queries.count() // block))
    slices = max(1, -(-vectors.count() // slice_))
    q = queries.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("asks"), "id", "embedding")
    q = q.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    v = vectors.select(F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"), F.lit(False).alias("asks"), "id", "embedding")
    v = v.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["asks"]], rows[~rows["asks"]].sort_values("id")
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": a["id"][:0], "id": b["id"][:0], "score": np.zeros(0)})
        x, y = (np.stack(t["embedding"].to_numpy()).astype(np.float64) for t in (a, b))
        scale = [np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-300) for t in (x, y)]
        s = np.round((x / scale[0]) @ (y / scale[1]).T, ROUND)
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        ids = b["id"].to_numpy()
        return pd.DataFrame({"query_id": np.repeat(a["id"].to_numpy(), top.shape[1]), "id": ids[top].ravel(), "score": np.take_along_axis(s, top, 1).ravel()})

    kinds = [table.schema["id"].dataType.simpleString() for table in (queries, vectors)]
    near = q.unionByName(v).groupBy("block", "slice").applyInPandas(best, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
