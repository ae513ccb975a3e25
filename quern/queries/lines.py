"""Queries on lines: grep, highlights, Markdown headers, fuzzy paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import escape_controls, is_symbol_line
from quern.operators import analyzers, fuzzy, lines, models
from quern.sources.tables import read

TERMS = ["worthless", "the", "estion"]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def grep_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.grep(_texts(spark, sf_dir), "(pathetic|worthless|@mail)", 1)


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.best_lines(lines.scored(lines.lines_of(_texts(spark, sf_dir)), TERMS), k=3)


def line_highlight_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).select("id", "line_number", F.round("score", 6).alias("score"))


def line_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.best_lines(lines.scored(lines.lines_of(_texts(spark, sf_dir)), TERMS), least=0.6)
    return models.highlight_summary(rows.select(F.col("id").alias("file"), "score", F.lit(True).alias("kept")))


def kept_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.kept_groups(_best(spark, sf_dir))


def lonely_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_lonely_symbols(_best(spark, sf_dir)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def symbol_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.lines_of(_texts(spark, sf_dir)).withColumn("symbols", is_symbol_line(F.col("line")))
    return rows.groupBy("id").agg(F.count_if("symbols").alias("symbol_lines"), F.count_if(F.trim("line") == "").alias("blank_lines"))


def control_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("id", F.sha2(escape_controls(F.concat("text", F.lit("\x00\x1b\x7f\t"))), 256).alias("h"))


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.lines_of(_texts(spark, sf_dir)).where(F.trim("line") != "")
    return rows.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("docs")).orderBy(F.desc("n"), "line").limit(50)


def tag_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of pages from one heading to the next, by position: a section ends where the next begins."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.split("html", "<h[1-6]>", -1).alias("parts"))
    rows = pages.select("page_id", F.posexplode("parts").alias("n", "part")).withColumn("len", F.char_length("part").cast("long"))
    w = Window.partitionBy("page_id").orderBy("n")
    return rows.select("page_id", "n", "len", F.lead("len").over(w).alias("next_len"))


def fuzzy_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = read(spark, sf_dir, "pages").select(F.regexp_replace("url", r"^\w+://|[?#].*$", "").alias("path"))
    return lines.fuzzy_paths(paths, "blogfr1")


def fuzzy_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fuzzy_paths by the best alignment of the query instead of the first."""
    paths = read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^\w+://(.*)$", 1).alias("path"))
    return fuzzy.best_paths(paths, FUZZY)


def table_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions and calls of a small Python file for each part, by the lateral table functions."""
    text = F.concat(F.lit("class P:\n    def made(self, x):\n        return size"), "p_size", F.lit("(len(x))\n\n\ndef all_"), "p_partkey", F.lit("():\n    return other.f()\n"))
    files = read(spark, sf_dir, "part").select(F.concat(F.lit("parts/p"), "p_partkey", F.lit(".py")).alias("path"), text.alias("text"), F.lit("python").alias("language"))
    analyzers.register(spark)
    nodes = analyzers.table(files, "definitions").select("path", "id", F.col("component_type").alias("what"), F.col("start_line").alias("line"))
    calls = analyzers.table(files, "calls").select("path", F.col("caller").alias("id"), F.col("callee").alias("what"), "line")
    return nodes.unionByName(calls)


QUERIES = {
    f.__name__: f
    for f in (
        grep_context, line_highlight_topk, line_threshold, kept_groups, lonely_symbols, symbol_lines, control_escapes, repeated_lines,
        tag_sections, fuzzy_paths, fuzzy_best, table_functions,
    )
}

_LINES = """
    l AS (SELECT id, line_number, ls[line_number] AS line FROM (
        SELECT doc_id AS id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_number FROM documents))
"""
_SYMBOL = r"(length(trim(line, ' ')) BETWEEN 1 AND 3 AND NOT regexp_matches(trim(line, ' '), '[\p{L}\p{N}_]'))"
_SCORED = f"""
    {_LINES},
    s AS (SELECT *, (contains(lower(line), 'worthless')::INT + contains(lower(line), 'the')::INT + contains(lower(line), 'estion')::INT)::DOUBLE / 3
                    * CASE WHEN {_SYMBOL} THEN 0.01::DOUBLE ELSE 1.0::DOUBLE END AS score FROM l),
    b AS (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, line_number) <= 3)
"""
FUZZY = "blogfr1"


def _fuzzy_sql(query: str) -> str:
    """The best alignment by one step a character: each place of it, from the best place of the one before."""
    steps = [f"s0 AS (SELECT path, i, own AS score FROM c WHERE ch = '{query[0]}')"]
    for k, ch in enumerate(query[1:], 1):
        steps.append(f"""s{k} AS (
            SELECT c.path, c.i, max(s.score + CASE WHEN c.i = s.i + 1 THEN 4 ELSE 1 + s.i - c.i - 2 END) + any_value(c.own) AS score
            FROM s{k - 1} s JOIN c ON c.path = s.path AND c.i > s.i AND c.ch = '{ch}' GROUP BY c.path, c.i)""")
    return ", ".join(steps)


ORACLE_SQL = {
    "fuzzy_best": rf"""
        WITH f AS (SELECT DISTINCT regexp_extract(url, '^\w+://(.*)$', 1) AS path FROM pages),
        g AS (SELECT string_split(path, '/') AS a FROM f),
        d AS (SELECT DISTINCT array_to_string(a[1:n], '/') AS path FROM (SELECT a, unnest(range(1, len(a))) AS n FROM g)),
        p AS (SELECT path, 'file' AS kind FROM f UNION ALL SELECT path, 'folder' FROM d WHERE path <> ''),
        l AS (SELECT path, string_split(lower(path), '') AS cs FROM (SELECT DISTINCT path FROM p)),
        c AS (SELECT path, i, cs[i] AS ch, 16 + CASE WHEN i = 1 OR cs[i - 1] IN ('/', '.', '_', '-', ' ') THEN 8 ELSE 0 END AS own
              FROM (SELECT path, cs, unnest(range(1, len(cs) + 1)) AS i FROM l)),
        {_fuzzy_sql(FUZZY)}
        SELECT * FROM (SELECT path, kind, max(score)::BIGINT AS score FROM s{len(FUZZY) - 1} JOIN p USING (path) GROUP BY ALL)
        ORDER BY score DESC, length(path), path, kind LIMIT 20
    """,
    "table_functions": """
        WITH p AS (SELECT p_partkey AS k, p_size AS n, 'parts/p' || p_partkey AS m FROM part)
        SELECT m || '.py' AS path, m || '.P' AS id, 'class' AS what, 1 AS line FROM p
        UNION ALL SELECT m || '.py', m || '.P.made', 'method', 2 FROM p
        UNION ALL SELECT m || '.py', m || '.all_' || k, 'function', 6 FROM p
        UNION ALL SELECT m || '.py', m || '.P.made', 'size' || n, 3 FROM p
        UNION ALL SELECT m || '.py', m || '.all_' || k, 'other.f', 7 FROM p
    """,
    "grep_context": f"""
        WITH {_LINES},
        m AS (SELECT *, max(line_number) OVER (PARTITION BY id) AS n,
                     lag(line_number) OVER (PARTITION BY id ORDER BY line_number) AS before
              FROM (SELECT *, regexp_matches(line, '(pathetic|worthless|@mail)') AS hit FROM l)),
        h AS (SELECT id, line_number, n FROM m WHERE hit),
        g AS (SELECT *, sum(CASE WHEN line_number - prev <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY line_number) AS grp
              FROM (SELECT *, lag(line_number) OVER (PARTITION BY id ORDER BY line_number) AS prev FROM h)),
        r AS (SELECT id, grp, greatest(1, min(line_number) - 1) AS first_line, least(any_value(n), max(line_number) + 1) AS last_line,
                     count(*) AS matches FROM g GROUP BY id, grp)
        SELECT r.id, first_line, last_line, matches,
               string_agg(CASE WHEN length(line) > 500 THEN substr(line, 1, 500) || ' [truncated...]' ELSE line END, chr(10) ORDER BY line_number) AS text
        FROM r JOIN l ON l.id = r.id AND l.line_number BETWEEN first_line AND last_line GROUP BY ALL
    """,
    "line_highlight_topk": f"WITH {_SCORED} SELECT id, line_number, round(score, 6) AS score FROM b",
    "line_threshold": f"WITH {_SCORED} SELECT id AS file, count(*) AS kept, round(sum(score), 4) AS score FROM s WHERE score >= 0.6 GROUP BY id",
    "kept_groups": f"""
        WITH {_SCORED},
        k AS (SELECT *, line_number - row_number() OVER (PARTITION BY id ORDER BY line_number) AS island FROM b WHERE trim(line, ' ') <> ''),
        g AS (SELECT id, island, min(line_number) AS first, string_agg(CASE WHEN length(line_number::VARCHAR) < 4 THEN lpad(line_number::VARCHAR, 4, ' ')
              ELSE line_number::VARCHAR END || '  ' || line, chr(10) ORDER BY line_number) AS t FROM k GROUP BY ALL)
        SELECT id, count(*) AS groups, string_agg(t, chr(10) || ' ---' || chr(10) ORDER BY first) AS text FROM g GROUP BY id
    """,
    "lonely_symbols": f"""
        WITH {_SCORED},
        n AS (SELECT *, coalesce(lag(line_number) OVER w = line_number - 1, FALSE) OR coalesce(lead(line_number) OVER w = line_number + 1, FALSE) AS near
              FROM b WINDOW w AS (PARTITION BY id ORDER BY line_number))
        SELECT id, count(*) AS n FROM n WHERE near OR NOT {_SYMBOL} GROUP BY id
    """,
    "symbol_lines": f"WITH {_LINES} SELECT id, CAST(count_if({_SYMBOL}) AS BIGINT) AS symbol_lines, CAST(count_if(trim(line, ' ') = '') AS BIGINT) AS blank_lines FROM l GROUP BY id",
    "control_escapes": """
        SELECT doc_id AS id, sha256(text || '^@^[^?' || chr(9)) AS h FROM documents
    """,
    "repeated_lines": f"""
        WITH {_LINES} SELECT line, count(*) AS n, count(DISTINCT id) AS docs FROM l WHERE trim(line, ' ') <> ''
        GROUP BY line ORDER BY n DESC, line LIMIT 50
    """,
    "fuzzy_paths": r"""
        WITH RECURSIVE f AS (SELECT DISTINCT regexp_replace(url, '^\w+://|[?#].*$', '', 'g') AS path FROM pages),
        d AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:n], '/') AS path
              FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS n FROM f)),
        p AS (SELECT path, 'file' AS kind FROM f UNION ALL SELECT path, 'folder' FROM d WHERE path <> ''),
        q AS (SELECT string_split('blogfr1', '') AS cs),
        w AS (SELECT path, kind, 0 AS k, 0::BIGINT AS pos, 0 AS score FROM p
              UNION ALL
              SELECT path, kind, k + 1, nxt, score + CASE WHEN nxt = pos + 1 AND pos > 0 THEN 3 WHEN nxt = 1 OR substr(lower(path), nxt - 1, 1) IN ('/', '.', '-', '_') THEN 2 ELSE 1 END
              FROM (SELECT w.*, pos + instr(substr(lower(path), pos + 1), cs[k + 1]) AS nxt FROM w, q WHERE k < len(cs)) x WHERE nxt > pos)
        SELECT path, kind, score FROM w WHERE k = 7 ORDER BY score DESC, length(path), path LIMIT 20
    """,
    "tag_sections": """
        WITH p AS (SELECT page_id, regexp_split_to_array(html, '<h[1-6]>') AS parts FROM pages),
        r AS (SELECT page_id, (i - 1)::INTEGER AS n, length(parts[i]) AS len FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM p))
        SELECT page_id, n, len, lead(len) OVER (PARTITION BY page_id ORDER BY n) AS next_len FROM r
    """,
}
