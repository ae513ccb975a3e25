"""Steps whose work or memory must not follow the length of paths, the number of passes or the size of a batch."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from quern.operators import analyzers, chunk, graph, search


def test_cycles_take_few_rounds_on_long_paths(spark, monkeypatch):
    calls, real = [], graph.materialised
    monkeypatch.setattr(graph, "materialised", lambda df: calls.append(1) or real(df))
    n = 60
    ids = list(range(n))
    random.Random(5).shuffle(ids)
    edges = [(ids[i], ids[(i + 1) % n]) for i in range(n)] + [(ids[0], 100)] + [(100 + i, 101 + i) for i in range(20)] + [(200, 201), (201, 200), (200, 200), (201, 300), (7, 7)]
    v = spark.createDataFrame([(i, i) for i in [*range(n), *range(100, 121), 200, 201, 300]], "id long, seq long")
    got = {r.id: r.component for r in graph.cycles(v, spark.createDataFrame(edges, "caller long, callee long")).collect()}
    assert got == dict.fromkeys(range(n), 0) | {200: 200, 201: 200}
    assert len(calls) < n


def test_table_functions_work_on_all_cores(spark):
    text = F.concat(F.lit("def f"), F.col("id"), F.lit("():\n    return g()\n"))
    files = spark.range(40).coalesce(1).select(F.concat(F.lit("p"), F.col("id"), F.lit(".py")).alias("path"), text.alias("text"), F.lit("python").alias("language"))
    analyzers.register(spark)
    nodes = analyzers.table(files, "definitions")
    assert nodes.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in nodes.collect()) == sorted(f"p{i}.f{i}" for i in range(40))


def test_chunks_leave_in_small_lists():
    text = "\n".join(["x" * 99] * 200)
    one = chunk.pack_lines(text.split("\n"), "fallback_chunk")
    batch = pa.RecordBatch.from_pydict({"path": [f"p{i}.txt" for i in range(400)], "text": [text] * 399 + [None]})
    lists = list(chunk.rows_of(iter([batch])))
    assert [r[5] for rows in lists for r in rows] == [c.content for c in one] * 399
    assert max(sum(len(r[5]) for r in rows) for rows in lists) < chunk.HELD + len(text)


def test_two_hops_read_each_text_once_a_hop(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    texts = [(i, f"alpha{i % 3} beta word{i} Caf\u00e9" if i else None) for i in range(30)]
    df = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    rows = search.two_hop(df.mapInPandas(seen, df.schema), "alpha1 beta", first=5, passages=2, limit=10).collect()
    assert [r.id for r in rows][:2] == [1, 4]
    assert read.value <= 3 * len(texts)  # two hops, and the texts of the best passages
