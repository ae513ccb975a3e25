"""Relational operators on the star schema: joins, set operators, grouping sets, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.sources.tables import read


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return rows.agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


def segment_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def parts_never_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, sf_dir, "part").join(used, "p_partkey", "left_anti").select("p_partkey")


def customers_with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


def shared_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s)


def only_customer_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.subtract(s)


def last_order_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: for each order the customer's order before it."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.row_number().over(w).alias("nth"))


def region_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = o.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name")
    return rows.agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


QUERIES = {
    f.__name__: f
    for f in (pricing_summary, segment_rollup, order_cube, parts_never_ordered, customers_with_orders, shared_nations, only_customer_nations, last_order_before, region_revenue)
}
ORACLE_SQL = {
    "pricing_summary": """
        SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_price,
               round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY ALL
    """,
    "segment_rollup": """
        SELECT n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)
    """,
    "order_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "parts_never_ordered": "SELECT p_partkey FROM part ANTI JOIN lineitem ON l_partkey = p_partkey",
    "customers_with_orders": "SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON o_custkey = c_custkey",
    "shared_nations": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "only_customer_nations": "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier",
    "last_order_before": """
        SELECT o_orderkey, lag(o_orderkey) OVER w AS before, row_number() OVER w AS nth FROM orders
        WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
    """,
    "region_revenue": """
        SELECT r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
    """,
}
