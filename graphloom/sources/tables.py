"""Input tables and the derived views that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table (by Spark's statistics) up to which `spread` deals its rows out.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """df for work that is heavy on each row: a small table, which may lie in one row group and so in one task, is dealt out over all cores; larger ones stay as they are."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, property, object: the tables' foreign keys as a triple store."""
    t = lambda name: table(spark, sf_dir, name)
    tag = lambda kind, column: F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))

    def link(df: DataFrame, kind: str, key: str, prop: str, other: str, ref: str) -> DataFrame:
        return df.select(tag(kind, key).alias("subject"), F.lit(prop).alias("property"), tag(other, ref).alias("object"))

    parts = [
        link(t("customer"), "C", "c_custkey", "NATION", "N", "c_nationkey"),
        link(t("supplier"), "S", "s_suppkey", "NATION", "N", "s_nationkey"),
        link(t("nation"), "N", "n_nationkey", "REGION", "R", "n_regionkey"),
        link(t("orders"), "O", "o_orderkey", "CUSTOMER", "C", "o_custkey"),
        link(t("lineitem"), "O", "l_orderkey", "PART", "P", "l_partkey"),
        link(t("lineitem"), "O", "l_orderkey", "SUPPLIER", "S", "l_suppkey"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def quaternary(x: Column) -> Column:
    """A number as one of the four slot values: 1 for large, 2 for small, 3 for weak evidence, 0 for none."""
    return F.when(x >= 0.1, 1).when(x <= -0.1, 2).when(F.abs(x) >= 0.05, 3).otherwise(0)


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, slot, v: embeddings in four-valued long form."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("slot", "x"))
    return e.select(F.col("vec_id").alias("id"), "label", "slot", quaternary(F.col("x").cast("double")).alias("v"))


def slot_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, words: the slots packed 32 to a 64-bit word, two bits each."""
    value = lambda x: quaternary(x.cast("double")).cast("long")
    n = F.size("embedding")

    def word(k: Column) -> Column:
        part = F.slice("embedding", k * 32 + 1, 32)
        return F.aggregate(F.reverse(F.transform(part, value)), F.lit(0).cast("long"), lambda acc, v: F.shiftleft(acc, 2).bitwiseOR(v))

    words = F.transform(F.sequence(F.lit(0), F.ceil(n / 32).cast("int") - 1), word)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", words.alias("words"))


def fluents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, slot, value, t_start, t_end (null: open): half-open intervals, each closed by the next event of its user."""
    from graphloom.operators.temporal import close_intervals

    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity"), F.lit("last_event").alias("slot"), F.col("event_type").alias("value"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("t_start"), F.col("event_id").alias("seq")
    )
    return close_intervals(e)
