"""Call-graph operators on vertex and edge DataFrames.

Vertices: id (and seq, the order of insertion, which breaks ties). Edges: caller, callee. Everything iterative works on
frontiers with joins and checkpoints each round, so no graph is gathered; rounds are bounded by depth or path length.
What a request shows (the tree of a root) is put in order in one task for each root, as it is one answer.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How edges come to their callee: certain, or the nearest of several.
SURE, NEAREST = 1.0, 0.6


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; in local mode a temporary one where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quern-graph-"))
    return sc.getCheckpointDir()


def materialised(df: DataFrame) -> DataFrame:
    """df in the checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def simple_name(i: Column) -> Column:
    return F.substring_index(i, ".", -1)


def module_path(i: Column) -> Column:
    """An id up to the first dot after its last slash."""
    return F.regexp_extract(i, r"^(?:.*/)?[^./]*", 0)


def module_distance(a: Column, b: Column) -> Column:
    """Steps from one module path to another over their common prefix."""
    def parts(p: Column) -> Column:
        return F.when(p == "", F.array().cast("array<string>")).otherwise(F.split(p, "/"))

    x, y = parts(a), parts(b)
    both = F.least(F.size(x), F.size(y))
    same = F.filter(F.sequence(F.lit(1), both), lambda n: F.slice(x, 1, n) == F.slice(y, 1, n))
    common = F.when(both == 0, 0).otherwise(F.size(same))
    return F.size(x) + F.size(y) - 2 * common


def first_lines(edges: DataFrame) -> DataFrame:
    """One edge for each caller and callee, with its first call (file and line) where edges have `file` or `line`."""
    more = [c for c in ("file", "line") if c in edges.columns]
    if not more:
        return edges.select("caller", "callee").distinct()
    first = edges.groupBy("caller", "callee").agg(F.min(F.struct(*more)).alias("__f"))
    return first.select("caller", "callee", *[F.col(f"__f.{c}").alias(c) for c in more])


def resolve(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with callee resolved, is_resolved and confidence; equal edges once, with their first call line if they have one.

    An exact id wins; else the only vertex of that simple name in the caller's own module; else the nearest one by module
    distance, the first inserted among equals. The nearest is found once for each name and module that asks, without
    pairing it with all vertices of its name: an index holds, for each name and each prefix of a module path, the first
    vertex among the shallowest below that prefix, and an asker looks it up once for each prefix of its own path.
    """
    def parts(module: str) -> Column:
        return F.when(F.col(module) == "", F.array().cast("array<string>")).otherwise(F.split(module, "/"))

    def prefixes(rows: DataFrame) -> DataFrame:
        cuts = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda n: F.struct(n.alias("c"), F.array_join(F.slice(F.col("parts"), 1, n), "/").alias("prefix")))
        return rows.withColumn("p", F.explode(cuts)).withColumns({"c": F.col("p.c"), "prefix": F.col("p.prefix")})

    v = vertices.select("id", "seq", simple_name(F.col("id")).alias("name"), module_path(F.col("id")).alias("module")).withColumn("parts", parts("module"))
    e = first_lines(edges)
    more = [c for c in e.columns if c not in ("caller", "callee")]
    known = v.select(F.col("id").alias("callee"), F.lit(True).alias("exact"))
    e = e.join(known, "callee", "left").withColumn("name", simple_name(F.col("callee"))).withColumn("module", module_path(F.col("caller")))
    asks = e.where("exact IS NULL").select("name", "module").distinct()
    names = v.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    own = v.groupBy("name", "module").agg(F.count(F.lit(1)).alias("here"), F.min("id").alias("mine"))
    index = prefixes(v.withColumn("len", F.size("parts"))).groupBy("name", "c", "prefix").agg(F.min(F.struct("len", "seq", "id")).alias("best"))
    looks = prefixes(asks.withColumn("parts", parts("module")).withColumn("own_len", F.size("parts")))
    rank = F.struct((F.col("own_len") + F.col("best.len") - 2 * F.col("c")).alias("d"), F.col("best.seq").alias("seq"), F.col("best.id").alias("id"))
    near = looks.join(index, ["name", "c", "prefix"]).groupBy("name", "module").agg(F.min(rank).getField("id").alias("near"))
    answers = near.join(names, "name").join(own, ["name", "module"], "left")
    alone = F.col("here") == 1
    answers = answers.select("name", "module", F.when(alone, F.col("mine")).otherwise(F.col("near")).alias("found"), (F.coalesce(alone, F.lit(False)) | (F.col("n") == 1)).alias("sure"))
    out = e.join(answers, ["name", "module"], "left")
    exact = F.col("exact").isNotNull()
    return out.select(
        "caller", "callee", F.when(exact, F.col("callee")).otherwise(F.coalesce("found", "callee")).alias("target"),
        (exact | F.col("found").isNotNull()).alias("is_resolved"),
        F.when(exact, SURE).when(F.col("found").isNull(), F.lit(None).cast("double")).when(F.col("sure"), SURE).otherwise(NEAREST).alias("confidence"), *more,
    )


def imported(calls: DataFrame, names: DataFrame) -> DataFrame:
    """calls with their callee by an import map (name, target): its own entry, else that of what comes before its first dot."""
    table = names.groupBy("name").agg(F.min("target").alias("target"))
    head, rest = F.substring_index("callee", ".", 1), F.regexp_extract("callee", r"^[^.]*\.(.+)$", 1)
    rows = calls.withColumn("__head", head).withColumn("__rest", rest)
    rows = rows.join(table.select(F.col("name").alias("callee"), F.col("target").alias("__own")), "callee", "left")
    rows = rows.join(table.select(F.col("name").alias("__head"), F.col("target").alias("__of_head")), "__head", "left")
    by_head = F.when((F.col("__rest") != "") & F.col("__of_head").isNotNull(), F.concat("__of_head", F.lit("."), "__rest"))
    return rows.withColumn("callee", F.coalesce("__own", by_head, "callee")).select(*calls.columns)


def depends_on(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, depends_on): for each vertex the distinct vertices that it calls, sorted."""
    called = adjacency(vertices, edges).groupBy(F.col("caller").alias("id")).agg(F.array_sort(F.collect_list("callee")).alias("depends_on"))
    kind = vertices.schema["id"].dataType.simpleString()
    return vertices.select("id").join(called, "id", "left").select("id", F.coalesce("depends_on", F.array().cast(f"array<{kind}>")).alias("depends_on"))


def adjacency(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges whose ends both exist."""
    ids = vertices.select("id")
    out = edges.select("caller", "callee").distinct()
    return out.join(ids.withColumnRenamed("id", "caller"), "caller", "left_semi").join(ids.withColumnRenamed("id", "callee"), "callee", "left_semi")


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, is_root): roots are never called."""
    adj = adjacency(vertices, edges)
    into = adj.groupBy(F.col("callee").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    out = adj.groupBy(F.col("caller").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    rows = vertices.select("id").join(into, "id", "left").join(out, "id", "left").fillna(0, ["in_degree", "out_degree"])
    return rows.withColumn("is_root", F.col("in_degree") == 0)


def bfs(edges: DataFrame, starts: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(id, depth) of all vertices within `depth` steps of the starts (id), by frontiers."""
    step = edges.select("callee", "caller").toDF("a", "b") if reverse else edges.select("caller", "callee").toDF("a", "b")
    seen = materialised(starts.select("id").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for d in range(1, depth + 1):
        reached = step.join(front.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        front = materialised(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def _paths(edges: DataFrame, starts: DataFrame, wanted, longest: int) -> DataFrame:
    """(src, dst, length, path) by frontiers from starts (src); wanted(rows) keeps those of (src, at, path) that are asked for."""
    step = edges.select(F.col("caller").alias("at"), F.col("callee").alias("next"))
    front = materialised(starts.select("src").distinct().select("src", F.col("src").alias("at"), F.array("src").alias("path")))
    seen, found = front.select("src", "at"), wanted(front).select("src", F.col("at").alias("dst"), F.lit(0).alias("length"), "path")
    for n in range(1, longest + 1):
        onward = front.join(step, "at").select("src", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path"))
        onward = onward.join(seen, ["src", "at"], "left_anti").groupBy("src", "at").agg(F.min("path").alias("path"))
        front = materialised(onward)
        if front.isEmpty():
            break
        found = found.unionByName(wanted(front).select("src", F.col("at").alias("dst"), F.lit(n).alias("length"), "path"))
        seen = materialised(seen.unionByName(front.select("src", "at")))
    return found


def shortest_paths(edges: DataFrame, pairs: DataFrame, longest: int) -> DataFrame:
    """(src, dst, length, path): one shortest directed path of at most `longest` edges for each reachable pair.

    Among equally short paths the one that is least as an array stays. A vertex reaches itself by the path of itself.
    """
    asked = materialised(pairs.select("src", F.col("dst").alias("at")).distinct())
    return _paths(edges, asked, lambda rows: rows.join(asked, ["src", "at"], "left_semi"), longest)


def chains(edges: DataFrame, matched: DataFrame, longest: int = 10) -> DataFrame:
    """Shortest paths between matched vertices (id, seq), from the earlier to the later one, shortest first.

    The frontiers start from the matched vertices; pairs come about only where one has reached another.
    """
    m = materialised(matched.select("id", "seq").distinct())
    a, b = m.select(F.col("id").alias("src"), F.col("seq").alias("i")), m.select(F.col("id").alias("at"), F.col("seq").alias("j"))
    rows = _paths(edges, a, lambda r: r.join(b, "at").join(a, "src").where("i < j"), longest)
    return rows.orderBy("length", "src", "dst")


def direct(edges: DataFrame, matched: DataFrame) -> DataFrame:
    """Edges with both ends among the matched vertices."""
    return adjacency(matched, edges)


def connections(edges: DataFrame, matched: DataFrame, longest: int = 10) -> DataFrame:
    """(kind, src, dst, length, path) of matched vertices (id, seq): all that a request for connections answers.

    kind is `matched` (src alone), `direct` (an edge with both ends matched), `chain` (a shortest path from an earlier to
    a later matched vertex) or `involved` (src alone: a vertex of a direct edge or a chain).
    """
    m = materialised(matched.select("id", "seq").distinct())
    edge, chain = materialised(direct(edges, m)), materialised(chains(edges, m, longest))
    ends = edge.select(F.col("caller").alias("id")).union(edge.select("callee")).union(chain.select(F.explode("path").alias("id")))
    kind = m.schema["id"].dataType.simpleString()
    none, no_path = F.lit(None).cast(kind), F.lit(None).cast(f"array<{kind}>")

    def alone(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.lit(name).alias("kind"), F.col("id").alias("src"), none.alias("dst"), F.lit(None).cast("int").alias("length"), no_path.alias("path"))

    straight = edge.select(F.lit("direct").alias("kind"), F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit(1).alias("length"), F.array("caller", "callee").alias("path"))
    long = chain.select(F.lit("chain").alias("kind"), "src", "dst", "length", "path")
    return alone(m, "matched").unionByName(straight).unionByName(long).unionByName(alone(ends.distinct(), "involved"))


def tree(edges: list[tuple], root, depth: int) -> list[tuple]:
    """The callee tree of one root as (id, depth, path from the root): depth first, a vertex is expanded once."""
    below: dict = {}
    for a, b in edges:
        below.setdefault(a, []).append(b)
    out, opened = [], set()
    stack = [(root, 0, [root])]
    while stack:
        node, d, path = stack.pop()
        if d:
            out.append((node, d, path))
        if d >= depth or node in opened:
            continue
        opened.add(node)
        stack += [(n, d + 1, [*path, n]) for n in reversed(below.get(node, []))]
    return out


def trees(edges: DataFrame, roots: DataFrame, depth: int, reverse: bool = False, order: DataFrame | None = None) -> DataFrame:
    """(root, place, id, depth, path) of the callee (or caller) tree of each root (id): depth first, a vertex expanded once.

    Children come in the order of `order` (id, seq), by id without it. The edges within reach are found by frontiers of
    all roots at once; a root's own are put in order in one task, which holds no more than the tree it answers with.
    """
    import pandas as pd

    step = edges.select("callee", "caller").toDF("a", "b") if reverse else edges.select("caller", "callee").toDF("a", "b")
    step = materialised(step.distinct())
    front = materialised(roots.select(F.col("id").alias("root"), F.col("id").alias("a")).distinct())
    seen, near = front, None
    for d in range(depth):
        taken = materialised(front.join(step, "a").select("root", "a", "b"))
        near = taken if near is None else near.unionByName(taken)
        if d == depth - 1 or taken.isEmpty():
            break
        front = materialised(taken.select("root", F.col("b").alias("a")).distinct().join(seen, ["root", "a"], "left_anti"))
        seen = seen.unionByName(front)
    place = F.col("b") if order is None else F.col("seq")
    if order is not None:
        near = near.join(order.select(F.col("id").alias("b"), "seq"), "b", "left")
    kind = roots.schema["id"].dataType.simpleString()

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "b"])
        out = tree(list(zip(rows["a"], rows["b"], strict=True)), key[0], depth)
        return pd.DataFrame([(key[0], i, n, d, path) for i, (n, d, path) in enumerate(out)], columns=["root", "place", "id", "depth", "path"])

    return near.select("root", "a", "b", place.alias("place")).groupBy("root").applyInPandas(grow, f"root {kind}, place int, id {kind}, depth int, path array<{kind}>")


def described(root: str, callees: list[tuple], callers: list[tuple], names: dict[str, str] | None = None) -> str:
    """A vertex with its trees as text; names say how a vertex is shown (its id with its lines)."""
    def lines(rows: list[tuple]) -> list[str]:
        return ["  " + x for x in render(root, rows, names).split("\n")[1:]] if rows else ["    (none)"]

    return "\n".join([(names or {}).get(root, root), "", "  ↓ calls (callee)", *lines(callees), "", "  ↑ called by (caller)", *lines(callers)])


def levels(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): callers before callees, by peeling off vertices that nobody left calls; cycles and what only they
    lead to have no level."""
    adj = materialised(adjacency(vertices, edges))
    left = materialised(vertices.select("id"))
    out = None
    level = 0
    while True:
        called = adj.select(F.col("callee").alias("id")).distinct()
        free = materialised(left.join(called, "id", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            return out if out is not None else free
        out = free if out is None else out.unionByName(free)
        gone = free.select("id")
        left = materialised(left.join(gone, "id", "left_anti"))
        adj = materialised(adj.join(gone.withColumnRenamed("id", "caller"), "caller", "left_anti"))
        level += 1


def cycles(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): vertices of strongly connected components of more than one vertex; component is its least id.

    Thin vertices are bridged first (`_bridged`), which keeps who reaches whom and leaves a small core of short paths
    however long the paths of the graph are. In the core labels (least id reachable from) spread forward until they
    settle, and backward among equal labels from the label's own vertex: what both reach is its component. The components
    found leave and the rest goes on. At the end the bridged vertices come back in reverse order: one is of the component
    of a caller that is also that of a callee.
    """
    adj = materialised(adjacency(vertices, edges).where("caller <> callee"))
    found, bridges = None, []
    while True:
        n = adj.count()
        while n:
            adj, into, onward = _bridged(adj, len(bridges))
            bridges.append((into, onward))
            before, n = n, adj.count()
            if n > 0.9 * before:
                break
        if not n:
            break
        label = materialised(_ends(adj).withColumn("label", F.col("id")))
        while True:  # the least id that reaches each vertex
            come = adj.join(label.withColumnRenamed("id", "caller"), "caller").select(F.col("callee").alias("id"), F.col("label").alias("now"), F.lit(None).cast(label.schema["label"].dataType).alias("label"))
            wide = label.select("id", F.col("label").alias("now"), "label").unionByName(come)
            wide = materialised(wide.groupBy("id").agg(F.min("now").alias("now"), F.max("label").alias("label")))
            moved = not wide.where("now <> label").isEmpty()
            label = wide.select("id", F.col("now").alias("label"))
            if not moved:
                break
        same = adj.join(label.withColumnRenamed("id", "caller"), "caller").withColumnRenamed("label", "x")
        same = materialised(same.join(label.select(F.col("id").alias("callee"), F.col("label").alias("y")), "callee").where("x = y").select("caller", "callee"))
        back = bfs_all(same, label.where("id = label").select("id"))
        part = materialised(label.join(back, "id", "left_semi"))
        found = part if found is None else found.unionByName(part)
        adj = adj.join(part.select(F.col("id").alias("caller")), "caller", "left_anti")
        adj = materialised(adj.join(part.select(F.col("id").alias("callee")), "callee", "left_anti"))
    if found is None:
        found = vertices.select("id", F.col("id").alias("label")).limit(0)
    for into, onward in reversed(bridges):
        a = into.join(found.toDF("caller", "x"), "caller", "left").select("via", F.coalesce("x", "caller").alias("label"))
        b = onward.join(found.toDF("callee", "y"), "callee", "left").select("via", F.coalesce("y", "callee").alias("label"))
        met = a.join(b, ["via", "label"]).select(F.col("via").alias("id"), "label").distinct()
        ends = F.explode(F.array(F.struct("id", "label"), F.struct(F.col("label").alias("id"), "label"))).alias("e")
        found = materialised(found.union(met.select(ends).select("e.id", "e.label")).distinct())
    size = found.groupBy("label").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("component")).where("k > 1")
    return found.join(size, "label").select("id", "component")


def _ends(adj: DataFrame) -> DataFrame:
    return adj.select(F.col("caller").alias("id")).union(adj.select("callee")).distinct()


def _bridged(adj: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct edges without loops after one round of taking vertices out, and the edges into (caller, via) and out of
    (via, callee) those that are bridged.

    Vertices without callers or without callees leave. A vertex is thin if bridging it, an edge from each caller to each
    callee in its place, makes no more edges than it has; of thin neighbours only the one of the higher hash is bridged.
    """
    def side(end: str, into: int) -> DataFrame:
        return adj.select(F.col(end).alias("id"), F.lit(into).alias("i"), F.lit(1 - into).alias("o"))

    degree = side("callee", 1).union(side("caller", 0)).groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).where("i > 0 AND o > 0")
    rank = F.when(F.col("i") * F.col("o") <= F.col("i") + F.col("o"), F.struct(F.xxhash64("id", F.lit(seed)).alias("h"), "id"))
    degree = degree.select("id", rank.alias("rank"))
    live = adj.join(degree.toDF("caller", "a"), "caller").join(degree.toDF("callee", "b"), "callee")
    live = materialised(live.select("caller", "callee", "a", "b"))
    lower = live.where("a IS NOT NULL AND b IS NOT NULL").select(F.when(F.col("a") < F.col("b"), F.col("caller")).otherwise(F.col("callee")).alias("id")).distinct()
    flags = live.join(lower.select(F.col("id").alias("caller"), F.lit(True).alias("x")), "caller", "left").join(lower.select(F.col("id").alias("callee"), F.lit(True).alias("y")), "callee", "left")
    gone = [(F.col(rank).isNotNull() & F.col(beaten).isNull()).alias(name) for rank, beaten, name in (("a", "x", "from_gone"), ("b", "y", "to_gone"))]
    flags = materialised(flags.select("caller", "callee", *gone))
    into = flags.where("to_gone").select("caller", F.col("callee").alias("via"))
    onward = flags.where("from_gone").select(F.col("caller").alias("via"), "callee")
    bridges = into.join(onward, "via").where("caller <> callee").select("caller", "callee")
    return materialised(flags.where("NOT from_gone AND NOT to_gone").select("caller", "callee").union(bridges).distinct()), into, onward


def bfs_all(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """All vertices from which a start is reached (backward search without a depth bound)."""
    return bfs(edges, starts, 1 << 30, reverse=True).select("id")


def summary(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): vertices by component type and edges by whether they are resolved."""
    kinds = vertices.groupBy("component_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("vertex").alias("kind"), F.col("component_type").alias("name"), "n")
    state = F.when(F.col("is_resolved"), "resolved").otherwise("unresolved")
    return kinds.unionByName(edges.groupBy(state.alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "name", "n"))


def examples(rows: DataFrame, by: str, shown: str, most: int = 20) -> DataFrame:
    """(by, n, examples): the rows of each value of a column, and the first of them by another, joined by commas.

    The first are kept in each task before anything is shuffled, so a value may hold any share of the rows.
    """
    n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by).orderBy(shown)
    few = rows.select(by, shown).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).groupBy(by)
    return n.join(few.agg(F.array_join(F.array_sort(F.collect_list(shown)), ",").alias("examples")), by)


def unresolved(edges: DataFrame, most: int = 20) -> DataFrame:
    """(callee, n): the names that most edges could not be resolved to."""
    rows = edges.where(~F.col("is_resolved")).groupBy("callee").agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("n"), "callee").limit(most)


def elements(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, json): a graph for display, vertices first, then resolved edges named caller->callee."""
    node = F.to_json(F.struct(F.struct("id", "name").alias("data"), F.concat(F.lit("node-"), "component_type").alias("classes")))
    edge = F.to_json(F.struct(F.struct(F.concat("caller", F.lit("->"), "target").alias("id"), F.col("caller").alias("source"), F.col("target").alias("target")).alias("data"), F.lit("edge").alias("classes")))
    return vertices.select(F.lit(0).alias("ord"), node.alias("json")).unionByName(edges.where("is_resolved").select(F.lit(1).alias("ord"), edge.alias("json")))


def render(root, rows: list[tuple], names: dict | None = None) -> str:
    """A tree as text with box-drawing lines."""
    names = names or {}
    children: dict[tuple, list[tuple]] = {}
    for _, _, path in rows:
        children.setdefault(tuple(path[:-1]), []).append(tuple(path))
    out, stack = [str(names.get(root, root))], [((root,), "", None)]
    while stack:
        at, indent, last = stack.pop()
        if last is not None:
            out.append(f"{indent}{'└── ' if last else '├── '}{names.get(at[-1], at[-1])}")
            indent += "    " if last else "│   "
        below = children.pop(at, [])
        stack += [(path, indent, i == len(below) - 1) for i, path in reversed(list(enumerate(below)))]
    return "\n".join(out)
