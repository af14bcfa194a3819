"""The triple store as bucketed tables: hops along properties join without moving a triple."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.kb import path
from graphloom.sources.scratch import scratch_dir
from graphloom.sources.tables import table, triples


def compile_triples(found: DataFrame, name: str, path_: str, buckets: int | None = None) -> DataFrame:
    """Write triples (subject, property, object) as a table of the catalog, by property, in sorted buckets of the subject; and read it.

    A frontier of nodes that joins it is shuffled to its buckets, the triples stay.  buckets: as many as the session
    has shuffle partitions if not given; with fewer Spark would rather shuffle both sides.  Repeated triples count once.
    """
    spark = found.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = found.select("subject", "property", "object").distinct().repartition(buckets, "subject")
    distinct.write.partitionBy("property").bucketBy(buckets, "subject").sortBy("subject").option("path", path_).mode("overwrite").saveAsTable(name)
    return spark.table(name)


def compile_names(entities: DataFrame, name: str, path_: str, buckets: int | None = None) -> DataFrame:
    """Write names (id, name, kind) as a table bucketed by the folded name, for lookups by name; and read it."""
    spark = entities.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = entities.select("id", "name", "kind", F.lower("name").alias("key"))
    keyed.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").option("path", path_).mode("overwrite").saveAsTable(name)
    return spark.table(name)


def _drop(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # noqa: BLE001  the session has ended already, and its catalog with it
        pass


def temporary(spark: SparkSession) -> tuple[str, str]:
    """A new table name, dropped when the process ends, and a folder for it in the shared scratch folder."""
    name = f"compiled_{uuid.uuid4().hex}"
    atexit.register(_drop, spark, name)
    return name, f"{scratch_dir(spark)}/{name}"


def q_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to regions over the compiled store."""
    t = compile_triples(triples(spark, sf_dir), *temporary(spark))
    start = table(spark, sf_dir, "orders").select(F.concat(F.lit("O:"), "o_orderkey").alias("node"))
    return path(t, start, ["CUSTOMER", "NATION", "REGION"])


def q_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers by name over the compiled names, asked for in capitals."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"))
    names = compile_names(c.unionByName(s), *temporary(spark))
    asked = c.where("id % 5 = 0").unionByName(s.where("id % 7 = 0")).select(F.upper("name").alias("asked"), F.lower("name").alias("key"))
    return asked.join(names, "key").select("asked", "id", "name", "kind")


QUERIES = {"path_compiled": q_path, "names_compiled": q_names}
ORACLE_SQL = {
    "path_compiled": "SELECT 'O:' || o_orderkey AS root, 'R:' || n_regionkey AS node FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "names_compiled": "WITH n AS (SELECT c_custkey AS id, c_name AS name, 'customer' AS kind, c_custkey % 5 = 0 AS q FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier', s_suppkey % 7 = 0 FROM supplier) SELECT upper(a.name) AS asked, b.id, b.name, b.kind FROM n a JOIN n b ON lower(a.name) = lower(b.name) WHERE a.q",
}
