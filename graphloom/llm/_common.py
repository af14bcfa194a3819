"""Shared helpers: table access, scratch tables in the cluster's shared folder, Arrow batches."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: with texts of a few KB a batch stays at a few MB.
BATCH_ROWS = 1000


#: Bytes of documents up to which their rows are dealt out over all cores.
SPREAD_BYTES = 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables.

    Few documents may lie in one row group and so in one task, though each is much work; they are dealt out.
    Larger tables are read as they lie, without a shuffle.
    """
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    small = name == "documents" and int(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SPREAD_BYTES
    return found.repartition(spark.sparkContext.defaultParallelism) if small else found


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a Python worker's memory doesn't grow with the texts.

    Spark reads both settings when a plan runs, so they stay set in the session; smaller ones of the caller are kept.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = int(re.sub(r"[^0-9-]", "", spark.conf.get(key)) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a session inside one process (master local) makes a temporary one; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has ended already; the folder is the cluster's to clean
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared scratch folder and read it again.

    This cuts the lineage: a lost executor costs a re-read of the file, and what a task decided
    (such as its row numbers) is fixed from here on.  The files go with `discard`, or when the Python
    process ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    spark.sparkContext._jvm.System.gc()  # shuffle files of the finished job go when the JVM notices that nothing refers to them
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, df.scratch_path)


#: A key that holds more rows than this share of a table is hot; so there are at most as many hot keys as this number, and they can be broadcast.
HOT_KEYS = 10_000
#: Rows of a key that are never too many for a task.
HOT_ROWS = 400


def join_skewed(many: DataFrame, one: DataFrame, key: list[str]) -> DataFrame:
    """Inner join of many with one, whose keys are unique, that gathers no key's rows in a task.

    many should be a written table: its keys are counted first.  Keys with more than max(HOT_ROWS, rows / HOT_KEYS)
    rows, HOT_KEYS of them at most, come to the driver; their rows of `one` are broadcast to where their
    partners lie, and the other keys are shuffled.
    """
    total = many.count()
    if total <= HOT_ROWS:
        return many.join(one, key)
    counted = many.groupBy(*key).agg(F.count("*").alias("_n"))
    found = counted.where(F.col("_n") > max(HOT_ROWS, total // HOT_KEYS)).select(*key).collect()
    if not found:
        return many.join(one, key)
    hot = F.broadcast(many.sparkSession.createDataFrame(found, many.select(*key).schema))
    columns = [*many.columns, *(c for c in one.columns if c not in key)]
    near = many.join(F.broadcast(one.join(hot, key)), key).select(columns)
    return near.unionByName(many.join(hot, key, "left_anti").join(one, key).select(columns))


#: Bits of a key filter: about 16 for each key, between these bounds.  At the upper one (128 MB) fuller filters let more rows through, never fewer.
FILTER_BITS = (1 << 20, 1 << 30)


def key_filter(keys: DataFrame) -> Broadcast:
    """A bitmap of the long column key of a written table, for `may_contain` in the tasks; its size follows the number of rows up to a bound.

    The bits are combined by word on the executors; the driver gets the words that aren't zero.
    """
    size = min(max(FILTER_BITS[0], 1 << (16 * keys.count()).bit_length()), FILTER_BITS[1])
    bit = F.pmod(F.col("key"), F.lit(size))
    words = keys.select(F.shiftright(bit, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(key, {size}L) & 63 as int))").alias("b"))
    bitmap = np.zeros(size // 64, np.int64)
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bitmap[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(bitmap.view(np.uint8))


def may_contain(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (64-bit) the filter may hold."""
    bit = keys.view(np.uint64) & np.uint64(8 * len(bitmap) - 1)
    return bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1


def texts(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (len + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n, off = len(column), np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if n == 0:
        return buf[:0], np.zeros(1, np.int64)
    return buf[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes of text; a longer text makes a range of its own."""
    _, off = texts(column)
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def hex_of(column: Column) -> Column:
    return F.lower(F.hex(column))
