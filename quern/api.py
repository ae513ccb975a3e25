"""The engine's front: index a tree, search it, outline it, highlight a text, ask its call graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.ids import uuid5
from quern.functions.text import embedding_text
from quern.operators import chunk, graph, incremental, lines, parse, rerank, search
from quern.operators.graph import materialised
from quern.operators.parse import outline_text
from quern.plans.config import MODEL_MIN_SCORES, Config, document_prefix, query_prefix
from quern.plans.requests import PathFilter, TextQuery, effective_min_score, file_glob, glob_regex, leg_budgets, valid_limit
from quern.sources import corpus
from quern.sources.lexicon import LexicalIndex
from quern.sources.store import Store


class Engine:
    def __init__(self, spark: SparkSession, store: str, config: Config | None = None, embedder: rerank.Embedder | None = None):
        self.spark, self.config = spark, config or Config()
        self.store, self.embedder = Store(spark, store), embedder or rerank.HashingEmbedder(self.config.dimension)
        self.lexicon = LexicalIndex(spark, f"{store.rstrip('/')}/_lexicon")

    def index(self, root: str, force: bool = False, dry_run: bool = False) -> dict[str, int]:
        """Brings the store and the lexical index up to date with a tree; files whose hash has not changed are not parsed.
        Counts by status."""
        files = materialised(corpus.scan(self.spark, root, most_bytes=self.config.file_bytes))
        old = None if force else self.store.read()
        known = self.spark.createDataFrame([], "path string, file_hash string") if old is None else old.select(F.col("file_path").alias("path"), "file_hash").distinct()
        changes = incremental.diff(known, files)
        counts = {r.status: r["count"] for r in changes.groupBy("status").count().collect()}
        if dry_run:
            return counts
        todo = files.join(changes.where("status IN ('new', 'changed')").select("path"), "path", "left_semi")
        made = chunk.chunks(todo).join(todo.select(F.col("path").alias("file_path"), "file_hash"), "file_path")
        prefix = document_prefix(self.config.provider, self.config.model, self.config.instruct)
        shown = embedding_text(F.col("file_path"), F.col("type"), F.col("identifier"), F.col("parent_chain"), F.col("content"))
        made = made.withColumn("text", F.concat(F.lit(prefix), shown) if prefix else shown)
        made = rerank.embedded(made, self.embedder).drop("text").withColumn("id", uuid5(F.col("segment_hash")))
        gone = materialised(changes.where("status IN ('changed', 'deleted')").select(F.col("path").alias("file_path")))
        fresh = bool(counts.get("new") or counts.get("changed"))
        left = None if old is None else materialised(old.join(gone, "file_path", "left_semi").select("id"))
        before = self.store.state()
        self.store.mark("incomplete")
        try:
            self.store.write(made if fresh else None, gone, state="incomplete", anew=force)
            rows, now = self.store.read(), self.store.state()
            if rows is not None:
                texts = rows.select("id", "file_path", F.col("content").alias("text"))
                if left is None or before["dimension"] != now["dimension"] or not self.lexicon.exists():
                    self.lexicon.build(texts.select("id", "text"))
                elif fresh or counts.get("deleted"):
                    came = texts.join(todo.select(F.col("path").alias("file_path")), "file_path", "left_semi")
                    self.lexicon.upsert(came.select("id", "text"), left)
                    self.lexicon.merge()
            self.store.mark("complete")
        except Exception:
            self.store.mark("error")
            raise
        return counts

    def status(self) -> str:
        """standby before the first run, indexing during one, then indexed or error."""
        now = self.store.state()
        return {"incomplete": "indexing", "complete": "indexed", "error": "error"}[now["state"]] if now else "standby"

    def search(
        self,
        query: str,
        paths: list[str] | None = None,
        limit: int | None = None,
        min_score: float | None = None,
        hybrid: bool = True,
        folders: list[str] | None = None,
    ) -> DataFrame:
        """Hits with their chunks, best first. The lexical leg asks the stored index and reads no text; the threshold holds
        for dense search. With `folders` only the buckets of the store that hold a path in one of them are opened."""
        rows, limit = self.store.beneath(folders) if folders else self.store.read(), valid_limit(limit)
        if rows is None:
            raise ValueError("the index is empty")
        c = self.config
        where = PathFilter.compile(paths).column(F.col("file_path"), c.include_mode)
        vector = self.embedder.embed(pd.Series([query_prefix(query, c.provider, c.model, instruct=c.instruct)]))[0]
        if hybrid:
            n_dense, n_sparse = leg_budgets(limit, c.dense_weight, c.sparse_weight)
            sparse = self.lexicon.search(TextQuery.parse(query), n_sparse, rows.where(where).select("id") if paths or folders else None)
            hits = search.hybrid_of(search.dense(rows, vector, n_dense, where=where), sparse, limit, c.sparse_guarantee)
        else:
            wanted = c.search_min_score if min_score is None else min_score
            hits = search.dense(rows, vector, limit, effective_min_score(wanted, MODEL_MIN_SCORES.get(c.model)), where)
        payload = rows.select("id", F.col("file_path").alias("path"), "start_line", "end_line", "type", "identifier", "hierarchy_display", "content")
        return hits.select("id", "score").join(payload, "id").orderBy(F.desc("score"), "id")

    def grep(self, root: str, pattern: str, files: str | None = None, limit: int = lines.MATCHES) -> DataFrame:
        """(path, first_line, last_line, matches, text): matches of a regular expression in the files of a tree that fit a
        file pattern, with a line around them; the first `limit` by path and line."""
        found = corpus.scan(self.spark, root)
        if files:
            found = found.where(F.col("path").rlike(file_glob(files)))
        rows = lines.grep(found.select(F.col("path").alias("id"), "text"), pattern)
        return rows.withColumnRenamed("id", "path").orderBy("path", "first_line").limit(limit)

    def highlight(self, text: str, query: str, k: int | None = None) -> str:
        """The lines of a text that answer a query best, in runs."""
        rows = self.spark.createDataFrame([(0, text)], "id int, text string")
        best = lines.best_lines(lines.scored(lines.lines_of(rows), query.lower().split()), k=k or self.config.highlight_lines)
        got = lines.kept_groups(best).first()
        return got.text if got else ""

    def outline(self, root: str, only: list[str] | None = None, limit: int | None = None) -> dict[str, str]:
        """Outlines of the files that match, by path; at most `limit` files (all without)."""
        files = corpus.scan(self.spark, root).where(PathFilter.compile(only).column(F.col("path")))
        files = files.withColumn("language", corpus.language(F.col("path"))).where("language IS NOT NULL")
        make = F.pandas_udf(lambda p, t, g: p.combine(t, lambda a, b: (a, b)).combine(g, lambda x, c: outline_text(x[0], x[1], c)), "string")
        rows = files.select("path", make("path", "text", "language").alias("outline")).orderBy("path")
        return {r.path: r.outline for r in (rows if limit is None else rows.limit(limit)).collect()}

    def graph(self, root: str) -> tuple[DataFrame, DataFrame]:
        """Vertices and resolved edges (caller, callee) of a tree."""
        files = corpus.scan(self.spark, root, most_bytes=self.config.analysis_bytes, tests=False)
        files = files.withColumn("language", corpus.language(F.col("path"))).where("language IS NOT NULL")
        vertices, edges = parse.call_graph(files)
        vertices = materialised(vertices)
        resolved = graph.resolve(vertices, edges).where("is_resolved").select("caller", F.col("target").alias("callee")).distinct()
        return vertices, materialised(resolved)

    def call(self, root: str, patterns: list[str], depth: int | None = None) -> DataFrame:
        """One pattern: the trees of callees and callers of its matches (direction, root, place, id, depth, path).
        Several: chains between their matches."""
        vertices, edges = self.graph(root)
        matched = self._matched(vertices, patterns)
        if len(patterns) > 1:
            return graph.chains(edges, matched, depth or 10)
        return self._trees(vertices, edges, matched, depth or 3)

    def connections(self, root: str, patterns: list[str], depth: int | None = None) -> DataFrame:
        """(kind, src, dst, length, path): the matches of patterns, the edges and chains between them, and all involved."""
        vertices, edges = self.graph(root)
        return graph.connections(edges, self._matched(vertices, patterns), depth or 10)

    def described(self, root: str, pattern: str, depth: int | None = None) -> str:
        """The trees of each match of a pattern as text; a vertex is shown with its lines."""
        vertices, edges = self.graph(root)
        matched = self._matched(vertices, [pattern])
        rows = self._trees(vertices, edges, matched, depth or 3).orderBy("root", "direction", "place").collect()  # what is shown
        shown = {r.root for r in rows} | {r.id for r in rows} | {r.id for r in matched.select("id").collect()}
        held = vertices.join(self.spark.createDataFrame([(i,) for i in shown], "id string"), "id") if shown else vertices.limit(0)
        names = {r.id: f"{r.id} L{r.start_line}-{r.end_line}" for r in held.collect()}
        out = []
        for m in sorted(r.id for r in matched.select("id").collect()):
            mine = {d: [(r.id, r.depth, r.path) for r in rows if r.root == m and r.direction == d] for d in ("callees", "callers")}
            out.append(graph.described(m, mine["callees"], mine["callers"], names))
        return "\n\n".join(out)

    @staticmethod
    def _matched(vertices: DataFrame, patterns: list[str]) -> DataFrame:
        keep = F.lit(False)
        for p in patterns:
            low = p.lower()
            keep = keep | F.col("id").rlike(glob_regex(p)) | (F.lower("id") == low) | (F.lower("name") == low)
        return vertices.where(keep).select("id", "seq")

    @staticmethod
    def _trees(vertices: DataFrame, edges: DataFrame, matched: DataFrame, depth: int) -> DataFrame:
        down = graph.trees(edges, matched, depth, order=vertices).withColumn("direction", F.lit("callees"))
        up = graph.trees(edges, matched, depth, reverse=True, order=vertices).withColumn("direction", F.lit("callers"))
        return down.unionByName(up).select("direction", "root", "place", "id", "depth", "path")
