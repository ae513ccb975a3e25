"""Registered queries return all of their result, whatever the size of their tables."""

from pyspark.sql import functions as F

from quern.queries import search


def test_file_grouping_has_every_file(spark, tmp_path):
    lines = spark.range(2500).select(
        (F.col("id") % 1250).alias("l_orderkey"),
        (F.col("id") % 3 + 1).cast("int").alias("l_linenumber"),
        F.lit(2.0).alias("l_quantity"),
        ((F.col("id") % 10) / 100).alias("l_discount"),
    )
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = search.file_grouping(spark, str(tmp_path)).collect()
    assert sorted(r.path for r in got) == list(range(1250))
    assert all(r.hits + r.removed == 2 for r in got)
    assert [(-r.top_score, r.path) for r in got] == sorted((-r.top_score, r.path) for r in got)
