"""Nodes as packed records of 128 bytes: a data source that reads files by byte ranges and writes them by tasks.

`register(spark)` makes the format "packed" known.  A file is cut into splits of whole records, so one file is read by
several tasks.  Filters on the fixed columns are applied to the packed numbers before rows are made (where
spark.sql.python.filterPushdown.enabled is true); with the option `sorted`, splits whose first and last record show
that nothing can match aren't read at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from graphloom.sources.scratch import scratch_dir
from graphloom.sources.tables import table

#: The layout of a record (little-endian); free slots of edges are 0.
RECORD = np.dtype([
    ("node_id", "<u4"), ("passage_id", "<u4"), ("span_start", "<u2"), ("span_end", "<u2"), ("concept_code", "<u2"), ("belnap_lattice", "u1"), ("confidence", "u1"), ("intent_band5", "u1"), ("epistemic_band6", "u1"), ("outgoing_edges", "<u4", (4,)), ("pad", "u1", (94,)),
])
FIXED = [n for n in RECORD.names if n not in ("outgoing_edges", "pad")]
SCHEMA = ", ".join(f"{n} bigint" for n in FIXED) + ", outgoing_edges array<bigint>"
#: Bytes of a split, and records that become one batch.
SPLIT_BYTES, BATCH = 64 << 20, 50_000
_TESTS: dict[type, Callable] = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


def _system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Split(InputPartition):
    path: str
    start: int
    stop: int


@dataclass
class Written(WriterCommitMessage):
    file: str


class PackedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.split_bytes, self.sorted = options["path"], int(options.get("split_bytes", SPLIT_BYTES)), options.get("sorted")
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (*_TESTS, In)) and len(f.attribute) == 1 and f.attribute[0] in FIXED and getattr(f, "value", 0) is not None:
                self.tests.append((f.attribute[0], type(f), list(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def _may_hold(self, low: int, high: int) -> bool:
        """Whether values from low to high can pass the tests on the sorted column."""
        for name, kind, value in self.tests:
            if name == self.sorted:
                lowest, highest = (min(value), max(value)) if kind is In else (value, value)
                if kind in (EqualTo, In) and (highest < low or lowest > high) or kind is GreaterThan and high <= value or kind is GreaterThanOrEqual and high < value or kind is LessThan and low >= value or kind is LessThanOrEqual and low > value:
                    return False
        return True

    def partitions(self) -> list[Split]:
        system, path = _system(self.path)
        info = system.get_file_info(path)
        files = [f for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", "."))] if info.type == fs.FileType.Directory else [info]
        out, step = [], max(1, self.split_bytes // RECORD.itemsize) * RECORD.itemsize
        for f in sorted(files, key=lambda f: f.path):
            if f.size is None or f.size % RECORD.itemsize:
                raise ValueError(f"{f.path}: {f.size} bytes are no whole number of records of {RECORD.itemsize}")
            splits = [(a, min(a + step, f.size)) for a in range(0, f.size, step)]
            if self.sorted and any(name == self.sorted for name, _, _ in self.tests):
                with system.open_input_file(f.path) as file:
                    value = lambda at, file=file: int(np.frombuffer(file.read_at(RECORD.itemsize, at), RECORD)[self.sorted][0])
                    splits = [(a, b) for a, b in splits if self._may_hold(value(a), value(b - RECORD.itemsize))]
            out += [Split(f.path, a, b) for a, b in splits]
        return out or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = _system(self.path)
        with system.open_input_file(partition.path) as file:
            for at in range(partition.start, partition.stop, BATCH * RECORD.itemsize):
                rows = np.frombuffer(file.read_at(min(BATCH * RECORD.itemsize, partition.stop - at), at), RECORD)
                keep = np.ones(len(rows), bool)
                for name, kind, value in self.tests:
                    keep &= np.isin(rows[name], value) if kind is In else _TESTS[kind](rows[name].astype(np.int64), value)
                rows = rows[keep]
                edges = rows["outgoing_edges"].astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum((edges > 0).sum(axis=1))]).astype(np.int32)
                columns = [pa.array(rows[n].astype(np.int64)) for n in FIXED] + [pa.ListArray.from_arrays(pa.array(offsets), pa.array(edges[edges > 0]))]
                yield pa.RecordBatch.from_arrays(columns, [*FIXED, "outgoing_edges"])


class PackedWriter(DataSourceArrowWriter):
    """Tasks write into a folder beside the files; what was committed is moved to its place, the rest goes."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite, self.attempt = options["path"], overwrite, f"_attempt-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = _system(self.path)
        name = f"part-{uuid.uuid4().hex}.bin"
        system.create_dir(f"{path}/{self.attempt}")
        with system.open_output_stream(f"{path}/{self.attempt}/{name}") as out:
            for batch in iterator:
                rows = np.zeros(batch.num_rows, RECORD)
                for n in FIXED:
                    values = batch.column(n).fill_null(0).to_numpy(zero_copy_only=False)
                    if len(values) and (values.min() < 0 or values.max() > np.iinfo(RECORD[n]).max):
                        raise ValueError(f"{n}: a value doesn't fit into {RECORD[n]}")
                    rows[n] = values
                for k, found in enumerate(batch.column("outgoing_edges").to_pylist()):
                    if found and (len(found) > 4 or min(found) < 1 or max(found) > 0xFFFFFFFF):
                        raise ValueError("a record holds four edges at most, to nodes from 1 on")
                    rows["outgoing_edges"][k, : len(found or [])] = found or []
                out.write(rows.tobytes())
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _system(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(path)):
                if f.is_file:
                    system.delete_file(f.path)
        for m in messages:
            if m is not None:
                system.move(f"{path}/{self.attempt}/{m.file}", f"{path}/{m.file}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, path = _system(self.path)
        if system.get_file_info(f"{path}/{self.attempt}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.attempt}")


class PackedRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PackedReader:
        return PackedReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> PackedWriter:
        return PackedWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed into it."""
    spark.dataSource.register(PackedRecords)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_packed(nodes: DataFrame, path: str) -> None:
    """Nodes with the columns of SCHEMA as packed records in path; nulls count as 0 and no edges, values that don't fit raise an error."""
    register(nodes.sparkSession)
    nodes.select(*[F.col(n).cast("bigint").alias(n) for n in FIXED], F.col("outgoing_edges").cast("array<bigint>").alias("outgoing_edges")).write.format("packed").mode("append").save(path)


def read_packed(spark: SparkSession, path: str, *, split_bytes: int = SPLIT_BYTES, sorted_by: str | None = None) -> DataFrame:
    """The records of a file or folder.  sorted_by: a column that each file ascends by."""
    register(spark)
    reader = spark.read.format("packed").option("split_bytes", split_bytes)
    return (reader.option("sorted", sorted_by) if sorted_by else reader).load(path)


def q_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as nodes with edges to their part and supplier, written as packed records and read back where they are confident and false."""
    li = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("node_id"), F.col("l_orderkey").alias("passage_id"), F.col("l_linenumber").alias("span_start"), (F.col("l_linenumber") + F.col("l_quantity").cast("int")).alias("span_end"),
        (F.col("l_partkey") % 640).alias("concept_code"), (F.col("l_orderkey") % 4).alias("belnap_lattice"), (F.col("l_suppkey") % 256).alias("confidence"), (F.col("l_linenumber") % 6).alias("intent_band5"), (F.col("l_linenumber") % 8).alias("epistemic_band6"),
        F.when(F.col("l_linenumber") % 3 > 0, F.array(F.col("l_partkey") + 1, F.col("l_suppkey") + 1)).otherwise(F.array(F.col("l_partkey") + 1)).alias("outgoing_edges"),
    )
    path = f"{scratch_dir(spark)}/packed-{uuid.uuid4().hex}"
    write_packed(li, path)
    found = read_packed(spark, path).where("belnap_lattice = 2 AND confidence >= 20")
    return found.withColumn("outgoing_edges", F.array_join("outgoing_edges", ","))


QUERIES = {"packed_records": q_packed}
ORACLE_SQL = {
    "packed_records": """SELECT l_orderkey * 8 + l_linenumber AS node_id, l_orderkey AS passage_id, l_linenumber AS span_start, l_linenumber + CAST(floor(l_quantity) AS BIGINT) AS span_end, l_partkey % 640 AS concept_code, l_orderkey % 4 AS belnap_lattice, l_suppkey % 256 AS confidence, l_linenumber % 6 AS intent_band5, l_linenumber % 8 AS epistemic_band6,
CASE WHEN l_linenumber % 3 > 0 THEN (l_partkey + 1) || ',' || (l_suppkey + 1) ELSE CAST(l_partkey + 1 AS VARCHAR) END AS outgoing_edges FROM lineitem WHERE l_orderkey % 4 = 2 AND l_suppkey % 256 >= 20""",
}
