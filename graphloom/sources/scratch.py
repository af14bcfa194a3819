"""Scratch tables in the folder that the cluster shares: loops cut their lineage with them."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one in a session of one process (master local) that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has ended already; the folder is the cluster's to clean
        pass


def cut(df: DataFrame, name: str = "rows") -> DataFrame:
    """df written as Parquet and read again; the files go with `drop` or when the process ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables made by `cut` that nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, df.scratch_path)


def grow(start: DataFrame, step: Callable[[DataFrame], DataFrame], key: list[str]) -> DataFrame:
    """All rows that `step` leads to from start, each key once: the frontier moves on until it finds no new key.

    Rows that start holds must have different keys; step must return the columns of start.
    """
    found = frontier = cut(start, "found")
    while not frontier.isEmpty():
        frontier = cut(step(frontier).dropDuplicates(key).join(found.select(*key), key, "left_anti").select(found.columns), "frontier")
        found = found.unionByName(frontier)
    return found


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """step applied until the rows no longer change (told by their number and a hash of them)."""
    state, now = None, cut(start, "state")
    while True:
        h = F.xxhash64(*now.columns)
        seen = tuple(now.agg(F.count("*"), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(h, 32))).first())
        if seen == state:
            return now
        before, state = now, seen
        now = cut(step(now), "state")
        drop(before)
