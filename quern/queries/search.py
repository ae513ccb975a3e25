"""Search queries: a document is a chunk, its vector that of the same id, its path source/lang/doc_id.md."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import ids, vectors
from quern.operators import evaluate, pooling, search
from quern.operators.graph import shared_dir
from quern.plans.requests import PathFilter, TextQuery
from quern.sources.ann import MOST_LISTS, VectorIndex
from quern.sources.lexicon import LexicalIndex
from quern.sources.tables import document_path, read, snapshot, spread

LIMIT = 20
TEXT = '"of the" worthless estion'
PATHS = ["src1*/**/en/*.md", "src2/{fr,de}/*", "!**/*7.md"]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents"))
    return docs.select(F.col("doc_id").alias("id"), "text", document_path().alias("path"))


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = _vectors(spark, sf_dir).where("id = 0").select("embedding").first()
    return [float(x) for x in row[0]]


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.dense(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), LIMIT)


def dense_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.dense(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 50, min_score=0.4)


def dense_topk_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _texts(spark, sf_dir).select("id", "path")
    keep = paths.where(PathFilter.compile(PATHS).column(F.col("path"))).select("id")
    return search.dense(_vectors(spark, sf_dir).join(keep, "id"), _query_vector(spark, sf_dir), LIMIT)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(_texts(spark, sf_dir), TextQuery.parse("worthless estion thing"), LIMIT)


def bm25_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(_texts(spark, sf_dir), TextQuery.parse(TEXT), LIMIT)


def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a query against all documents, 10 hits each."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return search.bm25_batch(_texts(spark, sf_dir).select("id", "text"), items, 10)


def bm25_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = search.postings(_texts(spark, sf_dir), positions=False)
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _hybrid(spark: SparkSession, sf_dir: str, guarantee: bool) -> DataFrame:
    q = _query_vector(spark, sf_dir)
    return search.hybrid(_vectors(spark, sf_dir), _texts(spark, sf_dir), q, TextQuery.parse(TEXT), LIMIT, guarantee)


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, False)


def rrf_hybrid_guarantee(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hybrid(spark, sf_dir, True)
    payload = _texts(spark, sf_dir).select("id", "path", F.substring("text", 1, 80).alias("preview"))
    return hits.join(payload, "id")


def two_hop_rrf60(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question, then the question with the first hop's best passages, fused at 60."""
    return search.two_hop(_texts(spark, sf_dir).select("id", "text"), "worthless estion", first=10, passages=3, chars=200, limit=50).limit(LIMIT)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def build_lexical_index(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    """A stored index of the documents."""
    index = LexicalIndex(spark, _folder(spark, "lexicon"))
    index.build(_texts(spark, sf_dir).select("id", "text"))
    return index


def build_vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """A stored index of the vectors, with their labels to filter by."""
    index = VectorIndex(spark, _folder(spark, "vectors"))
    index.fit(_vectors(spark, sf_dir), keep=("label",))
    return index


def _stored(spark: SparkSession, sf_dir: str, table: str, build: Callable) -> LexicalIndex | VectorIndex:
    """The index of a table as it is now; a table whose files have changed gets a new one."""
    key = (spark.sparkContext.applicationId, build.__name__, snapshot(spark, sf_dir, table))
    if key not in _INDEXES:
        _INDEXES[key] = build(spark, sf_dir)
    return _INDEXES[key]


def _index(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    return _stored(spark, sf_dir, "documents", build_lexical_index)


def _lists(spark: SparkSession, sf_dir: str) -> VectorIndex:
    return _stored(spark, sf_dir, "embeddings", build_vector_index)


_INDEXES: dict[tuple, LexicalIndex | VectorIndex] = {}


def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as bm25_topk, asked of the stored index."""
    return _index(spark, sf_dir).search(TextQuery.parse("worthless estion thing"), LIMIT)


def indexed_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as bm25_phrase, asked of the stored index."""
    return _index(spark, sf_dir).search(TextQuery.parse(TEXT), LIMIT)


def indexed_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as rrf_hybrid, its lexical leg asked of the stored index."""
    legs = search.leg_budgets(LIMIT)
    dense = search.dense(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), legs[0])
    return search.hybrid_of(dense, _index(spark, sf_dir).search(TextQuery.parse(TEXT), legs[1]), LIMIT, guarantee=False)


def indexed_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bm25_topk of an index that has seen changes: older texts of all documents, then their texts source by source, then
    the French ones leave, and small segments are merged."""
    docs = read(spark, sf_dir, "documents")
    index = LexicalIndex(spark, _folder(spark, "changes"))
    index.build(docs.select(F.col("doc_id").alias("id"), F.concat_ws(" ", F.lit("worthless"), "lang", "source").alias("text")))
    for own in (F.col("source").rlike("[0-3]$"), F.col("source").rlike("[4-6]$"), ~F.coalesce(F.col("source").rlike("[0-6]$"), F.lit(False))):
        index.upsert(docs.where(own).select(F.col("doc_id").alias("id"), "text"))
    index.delete(docs.where("lang = 'fr'").select(F.col("doc_id").alias("id")))
    index.merge()
    return index.search(TextQuery.parse("worthless estion thing"), LIMIT)


def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dense_topk of one label, asked of the vector index over all lists, so that its result is the exact one."""
    index = _lists(spark, sf_dir)
    return index.search(_query_vector(spark, sf_dir), LIMIT, probes=MOST_LISTS, refine=20, where=F.col("label") < 3)


def ann_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """knn_all, asked of the vector index over all lists."""
    v = _vectors(spark, sf_dir)
    near = _lists(spark, sf_dir).search_all(v.where(F.col("id") % 20 == 0), 6, probes=MOST_LISTS, refine=20).where("query_id <> id")
    rank = F.row_number().over(search.Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", rank).where("rank <= 5").select("query_id", "id", "score", "rank")


def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index by its usual number of probed lists finds at least 0.9 of the 10 nearest vectors of all queries
    (ids divisible by 20, the stated set) that an exhaustive search finds."""
    v = _vectors(spark, sf_dir)
    queries = v.where(F.col("id") % 20 == 0)
    want = search.block_topk(queries, v, 10).select("query_id", "id")
    got = _lists(spark, sf_dir).search_all(queries, 10).select("query_id", "id", F.lit(1).alias("found"))
    both = want.join(got, ["query_id", "id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("wanted"), (F.avg(F.coalesce("found", F.lit(0))) >= 0.9).alias("enough"))


def _paths(spark: SparkSession, sf_dir: str, patterns: list[str], mode: str = "or") -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return pages.where(PathFilter.compile(patterns).column(F.col("url"), mode)).select("page_id", "url")


def path_filter_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir, ["http*/EN/*", "**blog.**/fr/**"])


def path_filter_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir, ["**blog.**", "**/en/**"], "and")


def path_filter_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir, ["**example.{com,net}**", "!**/{en,de}/*"])


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ranges of files as hits: an order is a file, its line items are ranges of lines."""
    start = F.col("l_linenumber") * 6
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("path"),
        F.col("l_linenumber").alias("id"),
        start.alias("start_line"),
        (start + F.col("l_quantity").cast("int")).alias("end_line"),
        F.round("l_discount", 2).alias("score"),
    )


def containment_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.without_contained(_hits(spark, sf_dir))


def file_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_file(_hits(spark, sf_dir))


def knn_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every vector whose id is divisible by 20 (the stated query set), itself left out."""
    v = _vectors(spark, sf_dir)
    near = search.block_topk(v.where(F.col("id") % 20 == 0), v, 6).where("query_id <> id")
    rank = F.row_number().over(search.Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", rank).where("rank <= 5").select("query_id", "id", "score", "rank")


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = _vectors(spark, sf_dir).select("id", "label")
    return evaluate.graded(knn_all(spark, sf_dir), label.withColumnRenamed("id", "query_id"), label)


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of queries with a hit of their own label within the first k, for k of 1, 2, 5."""
    n = _vectors(spark, sf_dir).where(F.col("id") % 20 == 0).count()
    return evaluate.recall(evaluate.first_hits(_graded(spark, sf_dir)), n, [1, 2, 5])


def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.reciprocal_rank(evaluate.first_hits(_graded(spark, sf_dir)))


def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooling.exploded(pooling.mean(_vectors(spark, sf_dir), "label"))


def softmax_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooling.exploded(pooling.softmax(_vectors(spark, sf_dir), "label", "id", temperature=0.5))


def last_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooling.exploded(pooling.last(_vectors(spark, sf_dir), "label", "id"))


def centered_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooling.centered(_vectors(spark, sf_dir), "label", "id").select("id", F.round(vectors.norm(F.col("centered")), 5).alias("norm"))


def vector_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    unit = F.abs(vectors.norm(F.col("embedding")) - 1) < 1e-4
    return v.select("id", vectors.is_valid(F.col("embedding")).alias("valid"), unit.alias("unit"), F.size("embedding").cast("long").alias("dim"))


def file_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", ids.content_hash(F.col("text")).alias("file_hash"))


def segment_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.size(F.split("text", "\n", -1))
    h = ids.segment_hash(document_path(), F.lit(1), lines, F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", h.alias("segment_hash"))


def point_uuid5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_hash(spark, sf_dir).select("doc_id", ids.uuid5(F.col("segment_hash")).alias("point_id"))


QUERIES = {
    f.__name__: f
    for f in (
        dense_topk, dense_min_score, dense_topk_prefilter, bm25_topk, bm25_phrase, bm25_batch, bm25_statistics, rrf_hybrid,
        rrf_hybrid_guarantee, two_hop_rrf60, indexed_topk, indexed_phrase, indexed_hybrid,
        indexed_after_changes, ann_topk, ann_all, ann_recall, path_filter_or, path_filter_and, path_filter_exclude, containment_dedup,
        file_grouping, knn_all, recall_at_k, mrr, mean_pool, softmax_pool, last_pool, centered_norms, vector_validity,
        file_hash, segment_hash, point_uuid5,
    )
}

_DOC = "source || '/' || lang || '/' || doc_id || '.md'"
_DENSE = """
    SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score
    FROM embeddings
"""
_TOKENS = r"SELECT doc_id AS id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_.$]+') AS ts FROM documents"


def _bm25_sql(parts: list[list[str]], limit: int, where: str = "true") -> str:
    """BM25 over parts (lists of tokens)."""
    tokens = f"{_TOKENS} WHERE {where}"

    def times(p: list[str]) -> str:
        if len(p) == 1:
            return f"len(list_filter(ts, lambda x: x = '{p[0]}'))"
        same = " AND ".join(f"ts[i + {k}] = '{t}'" for k, t in enumerate(p))
        return f"len(list_filter(range(1, len(ts) - {len(p) - 2}), lambda i: {same}))"

    cols = ", ".join(f"{times(p)} AS tf{i}" for i, p in enumerate(parts))
    dfs = ", ".join(f"count_if(tf{i} > 0) AS df{i}" for i in range(len(parts)))
    total = " + ".join(
        f"ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE"
        f" / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))"
        for i in range(len(parts))
    )
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(parts)))
    return f"""
        SELECT id, round({total}, 6) AS score
        FROM (SELECT id, len(ts) AS dl, {cols} FROM ({tokens})) c,
             (SELECT count(*) AS n, avg(dl) AS mean, {dfs} FROM (SELECT len(ts) AS dl, {cols} FROM ({tokens})))
        WHERE {hit} ORDER BY score DESC, id LIMIT {limit}
    """


_PARTS = [["of", "the"], ["worthless"], ["estion"]]
_LEGS = f"""
    d AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS dense_rank FROM (SELECT * FROM ({_DENSE}) ORDER BY score DESC, id LIMIT 31)),
    s AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS sparse_rank FROM ({_bm25_sql(_PARTS, 10)})),
    f AS (
        SELECT id, dense_rank, sparse_rank,
               round(coalesce(1.0::DOUBLE / (dense_rank + 2), 0) + coalesce(1.0::DOUBLE / (sparse_rank + 2), 0), 6) AS score
        FROM d FULL JOIN s USING (id)),
    p AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM f)
"""
_KNN = """
    q AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
    near AS (
        SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.e, b.e), 6) AS score, a.label = b.label AS hit
        FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near QUALIFY rank <= 5),
    f AS (SELECT query_id, min(CASE WHEN hit THEN rank END) AS first FROM k GROUP BY query_id)
"""
_HITS = """
    h AS (
        SELECT l_orderkey AS path, l_linenumber AS id, l_linenumber * 6 AS start_line,
               l_linenumber * 6 + l_quantity::INTEGER AS end_line, round(l_discount, 2) AS score FROM lineitem),
    kept AS (
        SELECT * FROM h WHERE NOT EXISTS (
            SELECT 1 FROM h o WHERE o.path = h.path AND o.start_line <= h.start_line AND o.end_line >= h.end_line
                                AND (o.start_line <> h.start_line OR o.end_line <> h.end_line)))
"""
_COMPONENTS = "SELECT label, vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings"
_NORMED = "SELECT label AS key, i - 1 AS place, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 6) AS value"

ORACLE_SQL = {
    "dense_topk": f"{_DENSE} ORDER BY score DESC, id LIMIT 20",
    "dense_min_score": f"SELECT * FROM ({_DENSE}) WHERE score >= 0.4 ORDER BY score DESC, id LIMIT 50",
    "dense_topk_prefilter": f"""
        SELECT h.id, score FROM ({_DENSE}) h JOIN (SELECT doc_id AS id, lower({_DOC}) AS p FROM documents) USING (id)
        WHERE ((contains(p, 'src1') AND contains(p, '/en/') AND contains(p, '.md'))
               OR contains(p, 'src2/fr/') OR contains(p, 'src2/de/')) AND NOT contains(p, '7.md')
        ORDER BY score DESC, id LIMIT 20
    """,
    "bm25_topk": _bm25_sql([["worthless"], ["estion"], ["thing"]], LIMIT),
    "bm25_phrase": _bm25_sql(_PARTS, LIMIT),
    "bm25_batch": f"""
        WITH t AS ({_TOKENS}), c AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM t),
        p AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM t) GROUP BY ALL),
        d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}_.$]+')) AS term FROM benchmark),
        s AS (SELECT item_id AS query_id, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
                     / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS score
              FROM q JOIN p USING (term) JOIN d USING (term), c GROUP BY ALL)
        SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10
    """,
    "bm25_statistics": f"""
        SELECT t AS term, count(DISTINCT id) AS df, count(*) AS cf FROM (SELECT id, unnest(ts) AS t FROM ({_TOKENS})) GROUP BY t
    """,
    "rrf_hybrid": f"WITH {_LEGS} SELECT * FROM p WHERE place <= 20",
    "rrf_hybrid_guarantee": f"""
        WITH {_LEGS} SELECT p.*, {_DOC} AS path, substr(text, 1, 80) AS preview
        FROM p JOIN documents ON doc_id = id WHERE place <= 20 OR sparse_rank IS NOT NULL
    """,
    "indexed_topk": _bm25_sql([["worthless"], ["estion"], ["thing"]], LIMIT),
    "indexed_phrase": _bm25_sql(_PARTS, LIMIT),
    "indexed_hybrid": f"WITH {_LEGS} SELECT * FROM p WHERE place <= 20",
    "indexed_after_changes": _bm25_sql([["worthless"], ["estion"], ["thing"]], LIMIT, "lang IS DISTINCT FROM 'fr'"),
    "ann_topk": f"SELECT id, score FROM ({_DENSE} WHERE label < 3) ORDER BY score DESC, id LIMIT 20",
    "ann_all": f"WITH {_KNN} SELECT query_id, id, score, rank FROM k",
    "ann_recall": """
        SELECT count(*) AS queries, CAST(sum(least(10, n)) AS BIGINT) AS wanted, true AS enough
        FROM (SELECT vec_id, (SELECT count(*) FROM embeddings) AS n FROM embeddings WHERE vec_id % 20 = 0)
    """,
    "two_hop_rrf60": f"""
        WITH t AS MATERIALIZED ({_TOKENS}), c AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM t),
        p AS MATERIALIZED (
            SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM t) GROUP BY ALL),
        d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        w AS (SELECT id, term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
                     / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)) AS x FROM p JOIN d USING (term), c),
        a AS (SELECT id, round(sum(x), 6) AS score FROM w WHERE term IN ('worthless', 'estion') GROUP BY id ORDER BY score DESC, id LIMIT 10),
        r0 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank0 FROM a),
        e AS (SELECT 'worthless estion' || chr(10) || chr(10) || 'Relevant context:' || chr(10) || string_agg(
                  CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END, chr(10) || '---' || chr(10) ORDER BY rank0) AS q
              FROM r0 JOIN documents ON doc_id = id WHERE rank0 < 3 AND text <> ''),
        q AS (SELECT DISTINCT unnest(regexp_extract_all(strip_accents(lower(q)), '[\\p{{L}}\\p{{N}}_.$]+')) AS term FROM e),
        b AS (SELECT id, round(sum(x), 6) AS score FROM w JOIN q USING (term) GROUP BY id ORDER BY score DESC, id LIMIT 50),
        r1 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank1 FROM b)
        SELECT id, rank0, rank1,
               round(coalesce(1.0::DOUBLE / (rank0 + 60), 0) + coalesce(1.0::DOUBLE / (rank1 + 60), 0), 6) AS score
        FROM r0 FULL JOIN r1 USING (id) ORDER BY score DESC, id LIMIT 20
    """,
    "path_filter_or": """
        SELECT page_id, url FROM pages WHERE (contains(lower(url), 'http') AND contains(lower(url), '/en/'))
           OR (contains(lower(url), 'blog.') AND contains(lower(url), '/fr/'))
    """,
    "path_filter_and": "SELECT page_id, url FROM pages WHERE contains(lower(url), 'blog.') AND contains(lower(url), '/en/')",
    "path_filter_exclude": """
        SELECT page_id, url FROM pages WHERE (contains(lower(url), 'example.com') OR contains(lower(url), 'example.net'))
           AND NOT contains(lower(url), '/en/') AND NOT contains(lower(url), '/de/')
    """,
    "containment_dedup": f"WITH {_HITS} SELECT * FROM kept",
    "file_grouping": f"""
        WITH {_HITS}
        SELECT path, k.hits, top_score, avg_score, n - k.hits AS removed
        FROM (SELECT path, count(*) AS n, max(score) AS top_score FROM h GROUP BY path)
        JOIN (SELECT path, count(*) AS hits, round(avg(score), 6) AS avg_score FROM kept GROUP BY path) k USING (path)
        ORDER BY top_score DESC, path
    """,
    "knn_all": f"WITH {_KNN} SELECT query_id, id, score, rank FROM k",
    "recall_at_k": f"""
        WITH {_KNN} SELECT k.k, CAST(count_if(first <= k.k) AS BIGINT) AS hits, count(*) AS n, round(count_if(first <= k.k) / count(*)::DOUBLE, 6) AS recall
        FROM f, (SELECT unnest([1, 2, 5]) AS k) k GROUP BY k.k
    """,
    "mrr": f"WITH {_KNN} SELECT count(*) AS n, round(avg(coalesce(1 / first::DOUBLE, 0)), 6) AS mrr, CAST(count_if(first = 1) AS BIGINT) AS first_hits FROM f",
    "mean_pool": f"{_NORMED} FROM (SELECT label, i, avg(x) AS v FROM ({_COMPONENTS}) GROUP BY ALL)",
    "last_pool": f"{_NORMED} FROM (SELECT label, i, arg_max(x, vec_id) AS v FROM ({_COMPONENTS}) GROUP BY ALL)",
    "softmax_pool": f"""
        WITH l AS (SELECT label, arg_max(embedding, vec_id)::DOUBLE[] AS e FROM embeddings GROUP BY label),
        w AS (SELECT vec_id, label, exp(list_cosine_similarity(embedding::DOUBLE[], e) / 0.5::DOUBLE) AS w FROM embeddings JOIN l USING (label))
        {_NORMED} FROM (SELECT c.label, i, sum(w * x) / sum(w) AS v FROM ({_COMPONENTS}) c JOIN w USING (vec_id) GROUP BY ALL)
    """,
    "centered_norms": f"""
        SELECT vec_id AS id, round(sqrt(sum((x - m) * (x - m))), 5) AS norm
        FROM (SELECT *, avg(x) OVER (PARTITION BY label, i) AS m FROM ({_COMPONENTS})) GROUP BY vec_id
    """,
    "vector_validity": """
        SELECT vec_id AS id, embedding IS NOT NULL AND len(embedding) > 0 AS valid, len(embedding) AS dim,
               abs(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) - 1) < 1e-4 AS unit FROM embeddings
    """,
    "file_hash": "SELECT doc_id, sha256(text) AS file_hash FROM documents",
    "segment_hash": f"""
        SELECT doc_id, sha256({_DOC} || '-1-' || len(string_split(text, chr(10))) || '-' || length(text) || '-' || substr(text, 1, 100)) AS segment_hash
        FROM documents
    """,
    "point_uuid5": f"""
        WITH s AS (SELECT doc_id, sha1(unhex('f47ac10b58cc4372a5670e02b2c3d479') || encode(sha256(
            {_DOC} || '-1-' || len(string_split(text, chr(10))) || '-' || length(text) || '-' || substr(text, 1, 100)))) AS h FROM documents)
        SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
            || substr('89ab', 1 + ((('0x' || substr(h, 17, 1))::INTEGER) & 3), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM s
    """,
}
