"""More queries of the inventory: interval joins, conditional counts with examples, score arithmetic, cached analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import caches, evaluate, graph, intervals, rerank, search
from quern.queries.graph import edge_resolve, vertices
from quern.queries.search import _graded, _vectors
from quern.sources.tables import document_path, read


def smallest_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For a line of each order (a file) the smallest range of lines around it, the first among equals."""
    items = read(spark, sf_dir, "lineitem")
    start = F.col("l_linenumber") * 6
    end = start + F.col("l_quantity").cast("int")
    ranges = items.select("l_orderkey", F.col("l_linenumber").alias("node"), F.col("l_linenumber").alias("seq"), start.alias("start_line"), end.alias("end_line"))
    lines = items.groupBy("l_orderkey").agg((F.max("l_linenumber") * 7).alias("line"))
    return intervals.smallest_around(lines, ranges, "l_orderkey").select("l_orderkey", "line", "node", "span")


def first_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every line of an order (a file) the first of its ranges of lines around it, in the order of insertion."""
    items = read(spark, sf_dir, "lineitem")
    start = F.col("l_linenumber") * 6
    end = start + F.col("l_quantity").cast("int")
    ranges = items.select("l_orderkey", F.col("l_linenumber").alias("node"), F.col("l_linenumber").alias("seq"), start.alias("start_line"), end.alias("end_line"))
    lines = items.select("l_orderkey", (F.col("l_linenumber") * 9).alias("line")).distinct()
    return intervals.first_around(lines, ranges, "l_orderkey").select("l_orderkey", "line", "node")


def component_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices by type with the first 20 of each."""
    return graph.examples(vertices(spark, sf_dir), "component_type", "id")


def unresolved_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unresolved(edge_resolve(spark, sf_dir))


def confidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_resolve(spark, sf_dir).groupBy("is_resolved", "confidence").agg(F.count(F.lit(1)).alias("n"))


def median_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle element (index n div 2) of the queries' first ranks; queries without a hit rank 6."""
    return evaluate.median_rank(evaluate.first_hits(_graded(spark, sf_dir)), missing=6)


def score_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.spread(_graded(spark, sf_dir))


def cross_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account balances as raw scores of a nation's customers: through a sigmoid where any lies outside 0 to 1."""
    raw = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("query_id"), (F.col("c_acctbal") / 5000).alias("raw"))
    return rerank.cross_encoder_scores(raw).select("c_custkey", F.round("score", 6).alias("score"))


def span_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of tokens summed over ranges: discounts by line number over the first, middle and last lines of orders."""
    tokens = read(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("pos")).agg(F.sum("l_tax").alias("score"))
    ranges = spark.createDataFrame([("head", 1, 2), ("middle", 3, 5), ("tail", 6, 9), ("beyond", 10, 12)], "chunk string, first int, last int")
    return rerank.chunk_scores(tokens, ranges).select("chunk", F.round("score", 4).alias("score"))


def nearest_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest centroid of every vector: a small table as vocabulary."""
    v = _vectors(spark, sf_dir)
    parts = v.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    table = parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).select(F.col("label").alias("nearest"), F.col("c.x").alias("c"))
    entries = table.select(F.col("nearest").cast("long").alias("id"), F.col("c").alias("embedding"))
    near = search.block_topk(v.select("id", F.col("embedding").cast("array<double>").alias("embedding")), entries, 1)
    return near.select(F.col("query_id").alias("id"), F.col("id").cast("int").alias("nearest"), "score")


def context_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("source "), F.col("source")))
    return read(spark, sf_dir, "documents").select("doc_id", rerank.context_header(shown, document_path()).alias("header"))


def file_best_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A host's score is the best of its pages' (longer pages score higher)."""
    pages = read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^\w+://([^/]*)", 1).alias("host"), F.char_length("html").cast("long").alias("score"))
    return pages.groupBy("host").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("pages"))


def analysis_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents' analyses hold: cached under the same hash, of at most 10 000 characters."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("file_hash"), F.char_length("text").cast("long").alias("n"))
    # a cache that lacks ids divisible by 4, holds files of up to 10 000 characters (as nodes: ten a node), and knows those
    # divisible by 5 under another hash and those by 7 under another fingerprint
    stale = F.when(F.col("path") % 5 == 0, F.lit("?")).otherwise(F.col("file_hash"))
    cache = docs.where("path % 4 <> 0").select(
        "path", stale.alias("file_hash"), F.when(F.col("path") % 7 == 0, "old").otherwise("now").alias("fingerprint"),
        F.ceil(F.col("n") / 10).alias("n_nodes"), F.col("n").alias("size"), F.current_timestamp().alias("analysed"),
    )
    held = caches.valid_analyses(cache, docs, "now").select("path", F.lit(True).alias("cached"))
    joined = docs.join(held, "path", "left")
    return joined.groupBy(F.coalesce("cached", F.lit(False)).alias("cached")).agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("chars"))


def imported_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by an import map: brands as they are, or by what comes before their first dot."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    table = parts.groupBy("p_brand").agg(F.min("p_partkey").alias("first")).where(F.col("first") % 2 == 0).select(F.col("p_brand").alias("b"), "first")
    names = table.select(F.col("b").alias("name"), F.concat("b", F.lit("@"), F.col("first").cast("string")).alias("target"))
    names = names.unionByName(table.where("first % 3 = 0").select(F.regexp_replace("b", "#", "").alias("name"), F.concat(F.lit("half/"), "b").alias("target")))
    calls = parts.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.concat(F.regexp_replace("p_brand", "#", ""), F.lit(".part"))).alias("callee"))
    return graph.imported(calls, names).select("p_partkey", F.col("callee").alias("name"))


def hybrid_missing_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion where a leg is empty: the other one's order stays."""
    legs = [search.dense(_vectors(spark, sf_dir), [float(i % 7) - 3 for i in range(64)], 15), _vectors(spark, sf_dir).where("id < 0").select("id", F.lit(1.0).alias("score"))]
    return search.fused(legs).select("id", "score", "rank0")


QUERIES = {
    f.__name__: f
    for f in (
        smallest_enclosing, first_around, component_examples, unresolved_examples, confidence_counts, median_rank, score_spread, cross_encoder, span_scores,
        nearest_labels, context_headers, file_best_scores, analysis_cache, imported_names, hybrid_missing_leg,
    )
}


def _oracles() -> dict[str, str]:
    from quern.queries import graph as g
    from quern.queries import search as s

    graded = f"WITH {s._KNN}"
    return {
        "smallest_enclosing": """
            WITH r AS (SELECT l_orderkey, l_linenumber AS node, l_linenumber * 6 AS s, l_linenumber * 6 + l_quantity::INTEGER AS e FROM lineitem),
            l AS (SELECT l_orderkey, max(l_linenumber) * 7 AS line FROM lineitem GROUP BY 1)
            SELECT l_orderkey, line, arg_min(node, (e - s) * 100 + node) AS node, min(e - s) AS span
            FROM r JOIN l USING (l_orderkey) WHERE line BETWEEN s AND e GROUP BY ALL
        """,
        "first_around": """
            WITH r AS (SELECT l_orderkey, l_linenumber AS node, l_linenumber * 6 AS s, l_linenumber * 6 + l_quantity::INTEGER AS e FROM lineitem),
            l AS (SELECT DISTINCT l_orderkey, l_linenumber * 9 AS line FROM lineitem)
            SELECT l_orderkey, line, min(node) AS node FROM r JOIN l USING (l_orderkey) WHERE line BETWEEN s AND e GROUP BY ALL
        """,
        "component_examples": f"""
            WITH {g._V} SELECT component_type, max(n) AS n, string_agg(id, ',' ORDER BY id) AS examples
            FROM (SELECT *, row_number() OVER (PARTITION BY component_type ORDER BY id) AS k, count(*) OVER (PARTITION BY component_type) AS n FROM v)
            WHERE k <= 20 GROUP BY component_type
        """,
        "unresolved_examples": f"WITH {g._V} SELECT callee, count(*) AS n FROM r WHERE NOT is_resolved GROUP BY 1 ORDER BY n DESC, callee LIMIT 20",
        "confidence_counts": f"WITH {g._V} SELECT is_resolved, confidence, count(*) AS n FROM r GROUP BY ALL",
        "median_rank": f"""
            {graded}, o AS (SELECT coalesce(first, 6) AS first, row_number() OVER (ORDER BY coalesce(first, 6), query_id) - 1 AS i, count(*) OVER () AS n FROM f)
            SELECT first AS median, n FROM o WHERE i = n // 2
        """,
        "score_spread": f"{graded} SELECT hit, count(*) AS n, round(avg(score), 5) AS mean, max(score) AS most FROM k GROUP BY hit",
        "cross_encoder": """
            WITH r AS (SELECT c_custkey, c_acctbal / 5000 AS raw, min(c_acctbal / 5000) OVER w AS low, max(c_acctbal / 5000) OVER w AS high
                       FROM customer WINDOW w AS (PARTITION BY c_nationkey))
            SELECT c_custkey, round(10 * CASE WHEN low < 0 OR high > 1 THEN 1 / (1 + exp(-raw)) ELSE raw END, 6) AS score FROM r
        """,
        "span_scores": """
            WITH t AS (SELECT l_linenumber AS pos, sum(l_tax) AS score FROM lineitem GROUP BY 1),
            r AS (SELECT * FROM (VALUES ('head', 1, 2), ('middle', 3, 5), ('tail', 6, 9), ('beyond', 10, 12)) x(chunk, first, last))
            SELECT chunk, round(coalesce(sum(score), 0), 4) AS score FROM r LEFT JOIN t ON pos BETWEEN first AND last GROUP BY chunk
        """,
        "nearest_labels": """
            WITH p AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
            a AS (SELECT label, i, avg(x) AS x FROM p GROUP BY ALL),
            c AS (SELECT label AS nearest, list(x ORDER BY i) AS c FROM a GROUP BY label),
            s AS (SELECT vec_id AS id, nearest, round(list_cosine_similarity(embedding::DOUBLE[], c), 6) AS score FROM embeddings, c)
            SELECT id, nearest, score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, nearest) = 1
        """,
        "context_headers": f"""
            SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '[Context: source ' || source || '] ' ELSE '' END || '[File: ' || {s._DOC} || ']' AS header FROM documents
        """,
        "file_best_scores": r"""
            SELECT regexp_extract(url, '^\w+://([^/]*)', 1) AS host, max(length(html)) AS best, count(*) AS pages FROM pages GROUP BY 1
        """,
        "analysis_cache": """
            SELECT doc_id % 4 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND length(text) <= 10000 AS cached,
                   count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1
        """,
        "imported_names": """
            WITH t AS (SELECT p_brand AS b, min(p_partkey) AS first FROM part GROUP BY 1 HAVING min(p_partkey) % 2 = 0)
            SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN coalesce(b || '@' || first, p_brand)
                                   WHEN first % 3 = 0 THEN 'half/' || b || '.part' ELSE replace(p_brand, '#', '') || '.part' END AS name
            FROM part LEFT JOIN t ON b = p_brand
        """,
        "hybrid_missing_leg": """
            WITH d AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], list_transform(range(0, 64), lambda i: (i % 7 - 3)::DOUBLE)), 6) AS s FROM embeddings),
            r AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) - 1 AS rank0 FROM d QUALIFY rank0 < 15)
            SELECT id, rank0, round(1.0::DOUBLE / (rank0 + 2), 6) AS score FROM r
        """,
    }


ORACLE_SQL = _oracles()
