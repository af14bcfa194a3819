"""Packed records and bucketed tables: round trips, splits, pushed filters, plans without a shuffle of the stored side."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators.kb import path
from graphloom.sources import bucketed, packed_records


def nodes(spark, n):
    return spark.range(n).selectExpr(
        "id + 1 AS node_id", "id % 7 AS passage_id", "id % 100 AS span_start", "65535 - id % 3 AS span_end", "id % 640 AS concept_code", "id % 4 AS belnap_lattice", "id % 256 AS confidence", "id % 6 AS intent_band5",
        "id % 8 AS epistemic_band6", "CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN array() ELSE transform(sequence(1, id % 5), x -> x + 4294967000) END AS outgoing_edges",
    )


def test_packed_round_trip(spark, tmp_path):
    packed_records.write_packed(nodes(spark, 1000).repartitionByRange(2, "node_id").sortWithinPartitions("node_id"), str(tmp_path))
    files = sorted(tmp_path.glob("*.bin"))
    assert sum(f.stat().st_size for f in files) == 128_000 and not list(tmp_path.glob("_*"))
    read = packed_records.read_packed(spark, str(tmp_path), split_bytes=12_900)  # rounded down to whole records
    assert read.rdd.getNumPartitions() >= 10
    want = nodes(spark, 1000).withColumn("outgoing_edges", F.coalesce("outgoing_edges", F.array().cast("array<bigint>")))
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, want.select(*read.columns).collect()))
    raw = np.frombuffer(b"".join(f.read_bytes() for f in files), packed_records.RECORD)
    assert raw.itemsize == 128 and sorted(raw["node_id"].tolist()) == list(range(1, 1001))
    packed_records.write_packed(nodes(spark, 3), str(tmp_path))  # another write adds
    assert packed_records.read_packed(spark, f"file://{tmp_path}").count() == 1003


def test_pushed_filters(spark, tmp_path):
    packed_records.write_packed(nodes(spark, 1000).coalesce(1).sortWithinPartitions("node_id"), str(tmp_path))
    reader = packed_records.PackedReader({"path": str(tmp_path), "split_bytes": "12800", "sorted": "node_id"})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull

    left = list(reader.pushFilters([GreaterThan(("node_id",), 950), In(("belnap_lattice",), (1, 2)), IsNotNull(("node_id",)), EqualTo(("outgoing_edges",), 3)]))
    assert len(left) == 2 and len(reader.partitions()) == 1
    assert sum(b.num_rows for s in reader.partitions() for b in reader.read(s)) == sum(k % 4 in (1, 2) for k in range(950, 1000))
    df = packed_records.read_packed(spark, str(tmp_path), split_bytes=12_800, sorted_by="node_id")
    assert {r[0] for r in df.where("node_id BETWEEN 100 AND 120 AND confidence < 110 AND concept_code IN (105, 106, 300)").select("node_id").collect()} == {106, 107}
    assert df.where("node_id > 5000").count() == 0


def test_packed_refuses_what_does_not_fit(spark, tmp_path):
    with pytest.raises(Exception, match="doesn't fit"):
        packed_records.write_packed(nodes(spark, 3).withColumn("confidence", F.lit(300)), f"{tmp_path}/a")
    with pytest.raises(Exception, match="four edges"):
        packed_records.write_packed(nodes(spark, 3).withColumn("outgoing_edges", F.expr("array(1, 2, 3, 4, 5)")), f"{tmp_path}/b")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.bin").write_bytes(b"1" * 200)
    with pytest.raises(Exception, match="whole number of records"):
        packed_records.read_packed(spark, f"{tmp_path}/c").count()


def test_hops_move_no_triples(spark, tmp_path):
    rows = [(f"a{k}", "P", f"b{k % 50}") for k in range(400)] + [(f"b{k}", "Q", f"c{k % 7}") for k in range(50)] + [(f"c{k}", "R", f"d{k % 2}") for k in range(7)]
    name, folder = bucketed.temporary(spark)
    t = bucketed.compile_triples(spark.createDataFrame(rows + rows[:9], "subject string, property string, object string"), name, f"{tmp_path}/t")
    assert t.count() == len(rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = path(t, spark.createDataFrame([(f"a{k}",) for k in range(400)], "node string"), ["P", "Q", "R"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in found.collect()} == {(f"a{k}", f"d{k % 50 % 7 % 2}") for k in range(400)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scans = [m.start() for m in re.finditer(r"FileScan parquet", plan)]
    assert len(scans) == 3 and plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") == 3
    lines = plan.splitlines()
    for k, line in enumerate(lines):
        if "FileScan parquet" in line:
            above = [x for x in lines[max(0, k - 4) : k] if re.search(r"Exchange|Join", x)]
            assert not above or "Exchange" not in above[-1], plan
            assert "Bucketed: true" in line and "PartitionFilters: [isnotnull(property" in line
