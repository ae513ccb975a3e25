"""Graph queries. Vertices are parts, as functions in modules; line items are calls from a part to a supplier's name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import graph, parse
from quern.sources.tables import read

_ID = "concat('src', p % 5, '/lib', p % 11, '/mod', p % 17, '.F', p % 97, '_', p % 3)"


def _name(p: str) -> str:
    return _ID.replace("p %", f"{p} %")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("class", "function", "method"))), (F.col("p_size") % 3 + 1).cast("int"))
    rows = read(spark, sf_dir, "part").select(F.expr(_name("p_partkey")).alias("id"), F.col("p_partkey").alias("seq"), "p_name", kind.alias("component_type"))
    first = rows.groupBy("id").agg(F.min(F.struct("seq", "p_name", "component_type")).alias("f"))
    return first.select("id", F.col("f.seq").alias("seq"), F.col("f.p_name").alias("name"), F.col("f.component_type").alias("component_type"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line item 1 of an order names its callee in full; the others by simple name, or by one that no vertex has."""
    full, simple = F.expr(_name("(l_suppkey * 7)")), F.expr("concat('F', l_suppkey % 100, '_', l_suppkey % 3)")
    callee = F.when(F.col("l_linenumber") == 1, full).otherwise(simple)
    return read(spark, sf_dir, "lineitem").select(F.expr(_name("l_partkey")).alias("caller"), callee.alias("callee")).distinct()


def edge_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolve(vertices(spark, sf_dir), edges(spark, sf_dir))


def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.summary(vertices(spark, sf_dir), edge_resolve(spark, sf_dir))


def viz_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.elements(vertices(spark, sf_dir), edge_resolve(spark, sf_dir))


def edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first call line of each caller and callee."""
    calls = read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("caller"), F.col("l_suppkey").alias("callee"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line")
    )
    rows = graph.first_lines(calls)
    return rows.select(F.col("caller").alias("l_partkey"), F.col("callee").alias("l_suppkey"), F.col("file").alias("call_file"), F.col("line").alias("call_line"))


def module_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies by module, the 20 largest."""
    rows = edge_resolve(spark, sf_dir).where("is_resolved").groupBy(graph.module_path(F.col("caller")).alias("module"))
    return rows.agg(F.count_distinct("caller", "target").alias("n")).orderBy(F.desc("n"), "module").limit(20)


def module_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vertices(spark, sf_dir).select(graph.module_path(F.col("id")).alias("m")).distinct()
    here = F.lit("src1/lib2/mod3")
    return v.select("m", graph.module_distance(F.col("m"), here).cast("long").alias("d"))


def _numbers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A plain digraph: customers, each with an edge to the customer 2c+1 (if there is one) and one to c*c mod n + 1."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    n = c.agg(F.max("id").alias("n"))
    both = c.join(F.broadcast(n)).select(F.col("id").alias("caller"), F.expr("(id * id + c_nationkey) % n + 1").alias("x"), F.expr("2 * id + 1").alias("y"), "n")
    e = both.select("caller", F.col("x").alias("callee")).union(both.where("y <= n").select("caller", "y")).distinct()
    return c.select("id", F.col("id").alias("seq")), e


def degree_and_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(*_numbers(spark, sf_dir))


def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = _numbers(spark, sf_dir)
    return graph.bfs(e, v.where("id = 1"), 6)


def bfs_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = _numbers(spark, sf_dir)
    return graph.bfs(e, v.where("id = 31"), 4, reverse=True)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    return nation.select((F.col("n_nationkey") + 1).cast("long").alias("src"), (F.col("n_nationkey") * 3 + 2).cast("long").alias("dst"))


def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, e = _numbers(spark, sf_dir)
    rows = graph.shortest_paths(e, _pairs(spark, sf_dir), 10)
    return rows.select("src", "dst", "length", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains between the first 10 customers, in one direction."""
    v, e = _numbers(spark, sf_dir)
    rows = graph.chains(e, v.where("id <= 10"), 10)
    return rows.select("src", "dst", "length", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


def direct_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = _numbers(spark, sf_dir)
    return graph.direct(e, v.where("id <= 100"))


def depends_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each vertex calls, as one line."""
    rows = graph.depends_on(*_numbers(spark, sf_dir))
    return rows.select("id", F.array_join(F.col("depends_on").cast("array<string>"), ",").alias("depends_on"))


def all_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full answer on connections between the customers whose name ends in 77: matched, direct, chains, involved."""
    v, e = _numbers(spark, sf_dir)
    named = read(spark, sf_dir, "customer").where(F.col("c_name").rlike("77$")).select(F.col("c_custkey").alias("id"))
    rows = graph.connections(e, v.join(named, "id", "left_semi"), 8)
    return rows.select("kind", "src", "dst", "length", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


def chains_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains between the customers whose name ends in 3, as definitions in the files of their nations: their order is
    that of file and line, which is not that of their ids."""
    _, e = _numbers(spark, sf_dir)
    lines = (F.lit(1000) - F.col("c_custkey") % 1000).cast("int")
    found = read(spark, sf_dir, "customer").where(F.col("c_name").rlike("3$")).select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("src/n"), F.col("c_nationkey"), F.lit(".py")).alias("path"), lines.alias("start_line"), lines.alias("end_line")
    )
    rows = graph.chains(e, parse.in_order(found), 6)
    return rows.select("src", "dst", "length", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


def callee_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The callee trees of the first level (roots that nobody calls and whose id is below 200), depth 3."""
    v, e = _numbers(spark, sf_dir)
    roots = graph.degrees(v, e).where("is_root AND id < 200").select("id")
    rows = graph.trees(e, roots, 2)
    return rows.select("root", "id", "depth", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.levels(*_numbers(spark, sf_dir))


def scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(*_numbers(spark, sf_dir))


def glob_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.plans.requests import glob_regex

    patterns = ["SRC1/*/mod1?.F5*", "*.f96_2"]
    keep = F.lit(False)
    for p in patterns:
        keep = keep | F.col("id").rlike(glob_regex(p))
    return vertices(spark, sf_dir).where(keep).select("id", "seq")


QUERIES = {
    f.__name__: f
    for f in (
        edge_resolve, summary_counts, viz_elements, edge_dedup, module_totals, module_distances, degree_and_roots, bfs_depth,
        bfs_callers, shortest_path, connections, direct_connections, depends_on, all_connections, chains_in_order, callee_trees, topo_levels, scc, glob_names,
    )
}


def _sql_name(p: str) -> str:
    return f"('src' || {p} % 5 || '/lib' || {p} % 11 || '/mod' || {p} % 17 || '.F' || {p} % 97 || '_' || {p} % 3)"


_V = f"""
    v0 AS (SELECT {_sql_name('p_partkey')} AS id, p_partkey AS seq, p_name AS name,
                  ['class', 'function', 'method'][p_size % 3 + 1] AS component_type FROM part),
    v AS (SELECT id, min(seq) AS seq, arg_min(name, seq) AS name, arg_min(component_type, seq) AS component_type,
                 split_part(id, '.', 2) AS simple, split_part(id, '.', 1) AS module FROM v0 GROUP BY id),
    e AS (SELECT DISTINCT {_sql_name('l_partkey')} AS caller,
                 CASE WHEN l_linenumber = 1 THEN {_sql_name('(l_suppkey * 7)')}
                      ELSE 'F' || l_suppkey % 100 || '_' || l_suppkey % 3 END AS callee FROM lineitem),
    x AS (SELECT caller, callee, callee AS target, TRUE AS is_resolved, 1.0::DOUBLE AS confidence FROM e SEMI JOIN v ON v.id = e.callee),
    loose AS (SELECT caller, callee, split_part(callee, '.', -1) AS simple, split_part(caller, '.', 1) AS module
              FROM e ANTI JOIN v ON v.id = e.callee),
    parts AS (SELECT module, string_split(module, '/') AS p FROM (SELECT DISTINCT module FROM v UNION SELECT DISTINCT module FROM loose)),
    far AS (SELECT a.module AS m, b.module AS o,
                   len(a.p) + len(b.p) - 2 * len(list_filter(range(1, 4), lambda n: n <= len(a.p) AND n <= len(b.p) AND a.p[1:n] = b.p[1:n])) AS d
            FROM parts a, parts b),
    asked AS (SELECT DISTINCT simple, module FROM loose),
    best AS (SELECT a.simple, a.module, arg_min(v.id, d * 1000000000 + v.seq) AS near, count(*) AS n,
                    count_if(v.module = a.module) AS here, min(CASE WHEN v.module = a.module THEN v.id END) AS mine
             FROM asked a JOIN v USING (simple) JOIN far ON far.m = a.module AND far.o = v.module GROUP BY ALL),
    r AS (SELECT * FROM x UNION ALL
          SELECT caller, callee, CASE WHEN n IS NULL THEN callee WHEN here = 1 THEN mine ELSE near END, n IS NOT NULL,
                 CASE WHEN n IS NULL THEN NULL WHEN here = 1 OR n = 1 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END
          FROM loose LEFT JOIN best USING (simple, module))
"""
_N = """
    c AS (SELECT c_custkey AS id, c_nationkey, max(c_custkey) OVER () AS n FROM customer),
    e AS (SELECT id AS caller, (id * id + c_nationkey) % n + 1 AS callee FROM c
          UNION SELECT id, 2 * id + 1 FROM c WHERE 2 * id + 1 <= n)
"""


def _walk(pairs: str, longest: int, more: str = "") -> str:
    """Least shortest paths by breadth-first rounds over sets of paths."""
    return f"""
        WITH RECURSIVE {_N}, {more} w AS ({pairs}),
        p AS (
            SELECT DISTINCT src, src AS here, 0 AS length, [src] AS path FROM w
            UNION ALL
            SELECT src, here, length, path FROM (
                SELECT p.src, e.callee AS here, p.length + 1 AS length, list_append(p.path, e.callee) AS path,
                       row_number() OVER (PARTITION BY p.src, e.callee ORDER BY list_append(p.path, e.callee)) AS k
                FROM p JOIN e ON e.caller = p.here WHERE p.length < {longest} AND NOT list_contains(p.path, e.callee)) x
            WHERE k = 1),
        b AS (SELECT src, here, min(length) AS length FROM p GROUP BY ALL)
        SELECT w.src, w.dst, b.length, array_to_string(min(p.path), '>') AS path
        FROM (SELECT DISTINCT * FROM w) w JOIN b ON b.src = w.src AND b.here = w.dst
        JOIN p ON p.src = b.src AND p.here = b.here AND p.length = b.length GROUP BY ALL
    """


ORACLE_SQL = {
    "edge_resolve": f"WITH {_V} SELECT * FROM r",
    "summary_counts": f"""
        WITH {_V} SELECT 'vertex' AS kind, component_type AS name, count(*) AS n FROM v GROUP BY component_type
        UNION ALL SELECT 'edge', CASE WHEN is_resolved THEN 'resolved' ELSE 'unresolved' END, count(*) FROM r GROUP BY ALL
    """,
    "viz_elements": f"""
        WITH {_V} SELECT 0 AS ord, '{{"data":{{"id":"' || id || '","name":"' || name || '"}},"classes":"node-' || component_type || '"}}' AS json FROM v
        UNION ALL SELECT 1, '{{"data":{{"id":"' || caller || '->' || target || '","source":"' || caller || '","target":"' || target
            || '"}},"classes":"edge"}}' FROM r WHERE is_resolved
    """,
    "edge_dedup": """
        SELECT l_partkey, l_suppkey, min(l_orderkey) AS call_file, arg_min(l_linenumber, l_orderkey * 10 + l_linenumber) AS call_line
        FROM lineitem GROUP BY ALL
    """,
    "module_totals": f"""
        WITH {_V} SELECT split_part(caller, '.', 1) AS module, count(DISTINCT (caller, target)) AS n FROM r WHERE is_resolved
        GROUP BY 1 ORDER BY n DESC, module LIMIT 20
    """,
    "module_distances": f"""
        WITH v AS (SELECT DISTINCT split_part({_sql_name('p_partkey')}, '.', 1) AS m FROM part),
        p AS (SELECT m, string_split(m, '/') AS a, ['src1', 'lib2', 'mod3'] AS b FROM v)
        SELECT m, 6 - 2 * len(list_filter(range(1, 4), lambda n: a[1:n] = b[1:n])) AS d FROM p
    """,
    "degree_and_roots": f"""
        WITH {_N} SELECT id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, i.n IS NULL AS is_root
        FROM c LEFT JOIN (SELECT callee, count(*) AS n FROM e GROUP BY 1) i ON i.callee = id
        LEFT JOIN (SELECT caller, count(*) AS n FROM e GROUP BY 1) o ON o.caller = id
    """,
    "bfs_depth": f"""
        WITH RECURSIVE {_N}, b AS (SELECT 1::BIGINT AS id, 0 AS depth UNION SELECT callee, depth + 1 FROM b JOIN e ON caller = id WHERE depth < 6)
        SELECT id, min(depth) AS depth FROM b GROUP BY id
    """,
    "bfs_callers": f"""
        WITH RECURSIVE {_N}, b AS (SELECT 31::BIGINT AS id, 0 AS depth UNION SELECT caller, depth + 1 FROM b JOIN e ON callee = id WHERE depth < 4)
        SELECT id, min(depth) AS depth FROM b GROUP BY id
    """,
    "shortest_path": _walk("SELECT (n_nationkey + 1)::BIGINT AS src, (n_nationkey * 3 + 2)::BIGINT AS dst FROM nation", 10),
    "connections": _walk("SELECT a.id AS src, b.id AS dst FROM c a JOIN c b ON a.id < b.id WHERE b.id <= 10", 10),
    "chains_in_order": _walk(
        """SELECT a.id AS src, b.id AS dst FROM m a JOIN m b ON (a.path, a.line, a.id) < (b.path, b.line, b.id)""", 6,
        "m AS (SELECT c_custkey AS id, 'src/n' || c_nationkey || '.py' AS path, 1000 - c_custkey % 1000 AS line FROM customer WHERE c_name LIKE '%3'),"),
    "direct_connections": f"WITH {_N} SELECT * FROM e WHERE caller <= 100 AND callee <= 100",
    "depends_on": f"""
        WITH {_N} SELECT id, coalesce(d, '') AS depends_on FROM c
        LEFT JOIN (SELECT caller, string_agg(callee::VARCHAR, ',' ORDER BY callee) AS d FROM e GROUP BY caller) ON caller = id
    """,
    "all_connections": f"""
        WITH m AS (SELECT c_custkey AS id FROM customer WHERE c_name LIKE '%77'),
        ch AS ({_walk("SELECT a.c_custkey AS src, b.c_custkey AS dst FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey WHERE a.c_name LIKE '%77' AND b.c_name LIKE '%77'", 8)}),
        ed AS (WITH {_N} SELECT caller, callee FROM e WHERE caller IN (FROM m) AND callee IN (FROM m)),
        inv AS (SELECT caller AS id FROM ed UNION SELECT callee FROM ed UNION SELECT unnest(string_split(path, '>'))::BIGINT FROM ch)
        SELECT 'matched' AS kind, id AS src, NULL::BIGINT AS dst, NULL::INTEGER AS length, NULL::VARCHAR AS path FROM m
        UNION ALL SELECT 'direct', caller, callee, 1, caller || '>' || callee FROM ed
        UNION ALL SELECT 'chain', src, dst, length, path FROM ch
        UNION ALL SELECT 'involved', id, NULL, NULL, NULL FROM inv
    """,
    "callee_trees": f"""
        WITH {_N},
        r AS (SELECT id FROM c WHERE id < 200 AND id NOT IN (SELECT callee FROM e)),
        one AS (SELECT r.id AS root, callee AS id FROM r JOIN e ON caller = r.id)
        SELECT root, id, 1 AS depth, root || '>' || id AS path FROM one
        UNION ALL SELECT root, callee, 2, root || '>' || id || '>' || callee FROM one JOIN e ON caller = id
    """,
    "topo_levels": f"""
        WITH RECURSIVE {_N},
        r AS (SELECT caller AS a, callee AS b FROM e UNION SELECT r.a, e.callee FROM r JOIN e ON e.caller = r.b),
        stuck AS (SELECT a AS id FROM r WHERE a = b UNION SELECT y.b FROM r x JOIN r y ON y.a = x.a WHERE x.a = x.b),
        l AS (SELECT id, 0 AS level FROM c WHERE id NOT IN (SELECT callee FROM e)
              UNION SELECT e.callee, level + 1 FROM l JOIN e ON e.caller = l.id WHERE e.callee NOT IN (FROM stuck))
        SELECT id, max(level) AS level FROM l GROUP BY id
    """,
    "scc": f"""
        WITH RECURSIVE {_N}, r AS (SELECT caller AS a, callee AS b FROM e WHERE caller <> callee
                                   UNION SELECT r.a, e.callee FROM r JOIN e ON e.caller = r.b)
        SELECT x.a AS id, min(x.b) AS component FROM (SELECT * FROM r UNION SELECT id, id FROM c) x
        JOIN (SELECT * FROM r UNION SELECT id, id FROM c) y ON y.a = x.b AND y.b = x.a
        GROUP BY x.a HAVING count(DISTINCT x.b) > 1
    """,
    "glob_names": f"""
        WITH {_V} SELECT id, seq FROM v WHERE regexp_full_match(id, '(?i)SRC1/.*/mod1.\\.F5.*') OR regexp_full_match(id, '(?i).*\\.f96_2')
    """,
}
