"""Chunking and incremental-index queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as t
from quern.functions.ids import content_hash
from quern.operators import caches, chunk, incremental, packing, paths
from quern.sources.tables import document_path, read


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", document_path().alias("path"), "text")


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as plain text, packed into chunks."""
    files = _files(spark, sf_dir).withColumn("path", F.concat(F.col("path"), F.lit(".txt")))
    return chunk.chunks(files).drop("parent_chain")


def md_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunks(_files(spark, sf_dir)).drop("parent_chain")


def md_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with their chains of headers, of a Markdown text an order: its items are headers of levels 1 to 3, marked
    by signs or underlined, in the order of their lines; every other text has a line before its first header."""
    level, title = F.col("l_suppkey") % 3 + 1, F.concat(F.lit("part "), F.col("l_partkey"))
    underlined = F.concat(title, F.lit("\n"), F.when(level == 1, "=====").otherwise("---"))
    marked = F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), title)
    head = F.when((F.col("l_partkey") % 2 == 0) & (level < 3), underlined).otherwise(marked)
    body = F.concat(head, F.lit("\nquantity "), F.col("l_quantity").cast("int"))
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", body.alias("text"))  # line numbers may repeat
    orders = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))  # what one order holds
    text = F.concat(F.when(F.col("l_orderkey") % 2 == 1, "items:\n").otherwise(""), F.array_join(F.col("items.text"), "\n"))
    found = chunk.section_table(orders.select("l_orderkey", text.alias("text")), "l_orderkey")
    return found.select(F.col("id").alias("l_orderkey"), "n", "type", "start_line", "end_line", "identifier", "display", F.char_length("content").cast("long").alias("chars"))


def paths_beneath(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of pages that lie in two folders, by the index of their segments."""
    pages = read(spark, sf_dir, "pages").select(F.regexp_replace("url", r"^\w+://|[?#].*$", "").alias("file_path"))
    first = F.split("file_path", "/")[0]
    rows = pages.select(F.concat(F.substring_index(first, ".", -2), F.lit("/"), "file_path").alias("file_path"))
    return paths.beneath(paths.postings(rows), ["example.com", "/example.org/"])


def line_chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = line_chunks(spark, sf_dir).groupBy("type", "chunk_source")
    return sizes.agg(F.count(F.lit(1)).alias("n"), F.min(F.char_length("content")).alias("least"), F.max(F.char_length("content")).alias("most"))


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"), F.array_max(F.transform(lines, F.char_length)).cast("long").alias("longest"),
        F.char_length("text").cast("long").alias("n_chars"),
    )


def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = F.array(F.struct(F.col("source").alias("identifier"), F.lit("host").alias("type")), F.struct(F.lit(None).cast("string").alias("identifier"), F.lit("x").alias("type")))
    made = t.embedding_text(document_path(), F.lit("document"), F.col("lang"), parents, F.col("text"), "Document: ")
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(made, 256).alias("h"), t.token_estimate(made).alias("tokens"))


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = F.array(F.struct(F.col("r_name").alias("identifier"), F.lit("region").alias("type")))
    rows = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", t.hierarchy_display(parents, F.lit("nation"), F.col("n_name")).alias("display"))


def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("tokens", t.token_estimate(F.col("text")))
    return docs.groupBy("lang").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > 8191).alias("too_large"))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the corpus: before, no id divisible by 11; now, none divisible by 13, and those by 7 altered."""
    docs = read(spark, sf_dir, "documents").select("doc_id", document_path().alias("path"), "text")
    before = docs.where(F.col("doc_id") % 11 != 0)
    now = docs.where(F.col("doc_id") % 13 != 0).withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return tuple(d.select("path", content_hash(F.col("text")).alias("file_hash")) for d in (before, now))


def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.diff(*_snapshots(spark, sf_dir))


def dry_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental_diff(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def reconcile_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, now = _snapshots(spark, sf_dir)
    return incremental.stale(before, now)


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user and type: batches of writes merged by key."""
    return incremental.latest(read(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select(
        "user_id", "event_type", "event_id", F.round("value", 6).alias("value")
    )


def summary_cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as blocks of their sources (files): the cache lacks ids divisible by 5, and knows those by 3 under another
    fingerprint; the file hash of one source in seven is unchanged."""
    docs = read(spark, sf_dir, "documents").where("source IS NOT NULL")
    blocks = docs.select("doc_id", F.col("source").alias("file"), F.lit("now").alias("file_hash"), content_hash(F.col("text")).alias("code_hash"))
    held = blocks.where(F.col("doc_id") % 5 != 0).groupBy("file", "code_hash").agg(F.min("doc_id").alias("first"))
    same = F.when(F.regexp_extract("file", "([0-9]*)$", 1).cast("int") % 7 == 0, "now").otherwise("before")
    cache = held.select(
        "file", "code_hash", same.alias("file_hash"), F.when(F.col("first") % 3 == 0, "old").otherwise("p").alias("fingerprint"),
        F.concat(F.lit("summary of "), F.col("first").cast("string")).alias("summary"),
    )
    return caches.summary_states(blocks, cache, "p").select("doc_id", "file", "summary", "state")


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caches.hit_rates(summary_cache_join(spark, sf_dir))


def safe_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for files from addresses, numbered where several would be equal."""
    names = read(spark, sf_dir, "pages").select("page_id", t.safe_filename(F.regexp_extract("url", r"^\w+://([^/]*/[a-z]*)", 1)).alias("base"))
    k = F.row_number().over(Window.partitionBy("base").orderBy("page_id"))
    return names.select("page_id", F.concat("base", F.when(k > 1, F.concat(F.lit("_"), k)).otherwise("")).alias("name"))


def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches in which the documents, in order of their ids, would be embedded: at most 20000 estimated tokens each;
    a document of more than 8191 is in none."""
    docs = read(spark, sf_dir, "documents").select("doc_id", t.token_estimate(F.coalesce("text", F.lit(""))).alias("size"))
    return packing.batches(docs, ["doc_id"], most=20_000)


QUERIES = {
    f.__name__: f
    for f in (
        line_chunks, md_chunks, line_chunk_sizes, line_counts, embedding_text, hierarchy, token_totals, incremental_diff, dry_run_counts,
        reconcile_stale, upsert_latest, summary_cache_join, cache_stats, safe_filenames, embed_batches, md_sections, paths_beneath,
    )
}

_P = "source || '/' || lang || '/' || doc_id || '.md'"
_SNAP = f"""
    a AS (SELECT {_P} AS path, sha256(text) AS old_hash FROM documents WHERE doc_id % 11 <> 0),
    b AS (SELECT {_P} AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS new_hash FROM documents WHERE doc_id % 13 <> 0),
    d AS (SELECT path, old_hash, new_hash, CASE WHEN old_hash IS NULL THEN 'new' WHEN new_hash IS NULL THEN 'deleted'
                 WHEN old_hash = new_hash THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b USING (path))
"""
_CACHE = """
    k AS (SELECT doc_id, source AS file, sha256(text) AS h FROM documents WHERE source IS NOT NULL),
    c AS (SELECT file, h, min(doc_id) AS first FROM k WHERE doc_id % 5 <> 0 GROUP BY ALL),
    g AS (SELECT DISTINCT file FROM c WHERE first % 3 <> 0 AND TRY_CAST(regexp_extract(file, '([0-9]*)$', 1) AS INTEGER) % 7 = 0),
    t AS (SELECT doc_id, file, first, CASE WHEN g.file IS NOT NULL THEN 'hit' WHEN first IS NULL THEN 'miss' WHEN first % 3 = 0 THEN 'stale' ELSE 'hit' END AS state
          FROM k LEFT JOIN c USING (file, h) LEFT JOIN g USING (file)),
    s AS (SELECT doc_id, file, CASE WHEN state = 'hit' THEN 'summary of ' || first END AS summary, state FROM t)
"""
ORACLE_SQL = {
    "md_sections": """
        WITH i AS (SELECT l_orderkey, l_linenumber, l_suppkey % 3 + 1 AS level, 'part ' || l_partkey AS title, l_partkey % 2 = 0 AND l_suppkey % 3 < 2 AS under,
                   'quantity ' || l_quantity::INTEGER AS body, l_partkey, l_suppkey, l_quantity FROM lineitem),
        s AS (SELECT *, l_orderkey % 2 AS lead, row_number() OVER w AS k, CASE WHEN under THEN 3 ELSE 2 END AS lines,
              length(title) + length(body) + CASE WHEN NOT under THEN level + 2 WHEN level = 1 THEN 7 ELSE 5 END AS chars
              FROM i WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)),
        o AS (SELECT *, sum(lines) OVER w AS upto, max(CASE WHEN level = 1 THEN k END) OVER b AS k1, max(CASE WHEN level = 2 THEN k END) OVER b AS k2
              FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY k), b AS (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        c AS (SELECT o.*, h1.title AS t1, h2.title AS t2 FROM o LEFT JOIN s h1 ON h1.l_orderkey = o.l_orderkey AND h1.k = o.k1
              LEFT JOIN s h2 ON h2.l_orderkey = o.l_orderkey AND h2.k = o.k2 AND o.k2 > coalesce(o.k1, 0))
        SELECT l_orderkey, (k - 1 + lead)::INTEGER AS n, 'markdown_header_h' || level AS type, (upto - lines + 1 + lead)::INTEGER AS start_line,
               (upto + lead)::INTEGER AS end_line, title AS identifier,
               CASE WHEN level = 2 AND t1 IS NOT NULL OR level = 3 AND t2 IS NOT NULL AND t1 IS NOT NULL THEN 'header_1 ' || t1 || ' > ' ELSE '' END
               || CASE WHEN level = 3 AND t2 IS NOT NULL THEN 'header_2 ' || t2 || ' > ' ELSE '' END || 'header_' || level || ' ' || title AS display, chars
        FROM c
        UNION ALL
        SELECT DISTINCT l_orderkey, 0, 'markdown_content', 1, 1, NULL, NULL, 6 FROM i WHERE l_orderkey % 2 = 1
    """,
    "paths_beneath": r"""
        WITH p AS (SELECT regexp_replace(url, '^\w+://|[?#].*$', '', 'g') AS p FROM pages),
        f AS (SELECT array_to_string(string_split(string_split(p, '/')[1], '.')[-2:], '.') || '/' || p AS file_path FROM p)
        SELECT DISTINCT file_path FROM f WHERE starts_with(file_path, 'example.com/') OR starts_with(file_path, 'example.org/')
    """,
    "line_counts": """
        SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS longest,
               length(text) AS n_chars FROM documents
    """,
    "embedding_text": f"""
        WITH m AS (SELECT doc_id, 'Document: ' || chr(10) || 'File: ' || {_P} || chr(10) || 'Name: [document]' || lang || chr(10)
            || 'Parent: [host]' || source || chr(10) || chr(10) || text AS x FROM documents)
        SELECT doc_id, sha256(x) AS h, CAST(ceil(length(x) / 4) AS BIGINT) AS tokens FROM m
    """,
    "hierarchy": "SELECT n_nationkey, 'region ' || r_name || ' > nation ' || n_name AS display FROM nation JOIN region ON n_regionkey = r_regionkey",
    "token_totals": """
        SELECT lang, CAST(sum(t) AS BIGINT) AS tokens, CAST(count_if(t > 8191) AS BIGINT) AS too_large
        FROM (SELECT lang, CAST(ceil(length(text) / 4) AS BIGINT) AS t FROM documents) GROUP BY lang
    """,
    "incremental_diff": f"WITH {_SNAP} SELECT * FROM d",
    "dry_run_counts": f"WITH {_SNAP} SELECT status, count(*) AS n FROM d GROUP BY status",
    "reconcile_stale": f"WITH {_SNAP} SELECT path FROM d WHERE status = 'deleted'",
    "upsert_latest": """
        SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
    """,
    "summary_cache_join": f"WITH {_CACHE} SELECT * FROM s",
    "cache_stats": f"""
        WITH {_CACHE} SELECT file, count(*) AS blocks, CAST(count_if(state = 'hit') AS BIGINT) AS hits,
               round(avg(CASE WHEN state = 'hit' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS rate FROM s GROUP BY file
    """,
    "safe_filenames": r"""
        WITH n AS (SELECT page_id, substr(trim(regexp_replace(regexp_replace(regexp_extract(url, '^\w+://([^/]*/[a-z]*)', 1),
            '[<>:"/\\|?*\x00-\x1F]', '_', 'g'), '\s+', ' ', 'g')), 1, 200) AS base FROM pages),
        k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY page_id) AS k FROM n)
        SELECT page_id, base || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS name FROM k
    """,
    "embed_batches": """
        WITH RECURSIVE d AS (SELECT doc_id, ceil(length(coalesce(text, '')) / 4.0)::BIGINT AS size FROM documents),
        p AS (
            SELECT *, row_number() OVER (ORDER BY doc_id) AS i, sum(size) OVER (ORDER BY doc_id)::BIGINT AS upto FROM d WHERE size <= 8191),
        s AS (
            SELECT 1::BIGINT AS i, 0::BIGINT AS before, 0::BIGINT AS batch
            UNION ALL
            SELECT n.i, n.upto - n.size, batch + 1
            FROM (SELECT min(p.i) AS i, any_value(batch) AS batch FROM s JOIN p ON p.upto > s.before + 20000) m JOIN p n ON n.i = m.i)
        SELECT d.doc_id, d.size, (SELECT max(batch) FROM s WHERE s.i <= p.i) AS batch FROM d LEFT JOIN p USING (doc_id)
    """,
}
