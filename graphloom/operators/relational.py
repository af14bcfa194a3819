"""Relational support: star-schema aggregates, grouping sets, set operations, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.tables import table


def q_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(net), 2).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


def q_unshipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    exact = lambda c: F.col(c).cast("decimal(12,2)")
    revenue = F.sum(exact("l_extendedprice") * (1 - exact("l_discount"))).cast("double")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_custkey").agg(revenue.alias("revenue"), F.count("*").alias("n"))


def q_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of orders whose customer and supplier share a nation."""
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def q_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by what they hold: union, intersection and difference of customers' and suppliers' nations."""
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    tagged = lambda df, name: df.withColumn("kind", F.lit(name))
    return tagged(c.union(s).distinct(), "union").unionByName(tagged(c.intersect(s), "intersect")).unionByName(tagged(c.subtract(s), "except"))


QUERIES = {
    "pricing_summary": q_pricing,
    "customer_revenue": q_unshipped,
    "local_supplier_volume": q_by_nation,
    "forecast_revenue": lambda s, d: table(s, d, "lineitem").where("l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"), F.count("*").alias("n")),
    "cube_flags": lambda s, d: table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.grouping_id().cast("int").alias("gid")),
    "rollup_orders": lambda s, d: table(s, d, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n")),
    "semi_anti_orders": lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("without_orders")),
    "set_operations": q_sets,
}
ORACLE_SQL = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "customer_revenue": "SELECT c_mktsegment, o_custkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))) AS DOUBLE) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "local_supplier_volume": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "forecast_revenue": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "cube_flags": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, CAST(grouping(l_returnflag, l_linestatus) AS INTEGER) AS gid FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rollup_orders": "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)",
    "semi_anti_orders": "SELECT c_mktsegment, count(*) AS without_orders FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') GROUP BY c_mktsegment",
    "set_operations": "SELECT k, 'union' AS kind FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'intersect' FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'except' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)",
}
