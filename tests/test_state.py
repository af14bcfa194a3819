"""Stateful stream operators give what their batch forms give, across triggers, late events and a restart."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators.temporal import close_by_arrival, close_intervals
from graphloom.streaming import state, windows

SCHEMA = "entity long, slot string, value string, t_start double, seq long, ts timestamp"


def events(spark, rows):
    df = spark.createDataFrame(rows, "entity long, slot string, value string, t_start double, seq long")
    return df.withColumn("ts", F.timestamp_millis((F.col("t_start") * 3_600_000).cast("long")))


def made(late=True):
    rng, t, out = random.Random(2), 0.0, []
    for seq in range(240):
        t += rng.choice([0.25, 0.5, 1.0])
        out.append((rng.randrange(4), "at", rng.choice("abc"), t - (2.0 if late and seq % 9 == 8 else 0.0), seq))
    return out


def fed(spark, folder, df, parts):
    """df in files by ranges of seq, one a trigger; as a stream."""
    n = df.count()
    for k in range(parts):
        df.where(F.floor(F.col("seq") * parts / n) == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def drained(df, folder, mode="append"):
    """All that a stream gives out, as written by its triggers."""
    out = []

    def keep(batch, _):
        out.extend(tuple(r) for r in batch.collect())

    df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return out


@pytest.fixture()
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("late", ["keep", "drop"])
def test_arrival_order_and_restart(spark, tmp_path, few_partitions, late):
    df = events(spark, made())
    want = close_by_arrival(df, late).where("t_end IS NOT NULL")
    first, rest = df.where("seq < 120"), df.where("seq >= 120")
    stream = fed(spark, tmp_path, first, 2)
    got = drained(state.closed_intervals(stream, late=late), tmp_path)
    rest.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    again = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got += drained(state.closed_intervals(again, late=late), tmp_path)  # goes on from the checkpoint
    columns = ["entity", "slot", "value", "t_start", "t_end", "seq"]
    assert sorted(got) == sorted(tuple(r) for r in want.select(*columns).collect())
    assert any(r[4] < r[3] for r in got) == (late == "keep")


def test_event_order_waits_for_the_watermark(spark, tmp_path, few_partitions):
    df = events(spark, [*made(), *[(k, "at", "end", 900.0 + k, 240 + k) for k in range(4)], *[(k, "at", "end", 990.0, 250 + k) for k in range(4)]])
    stream = fed(spark, tmp_path, df, 4)
    events(spark, [(99, "at", "z", 995.0, 260)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # one more trigger, behind the watermark of the last
    got = drained(state.closed_intervals(stream, "event", wait="3 hours"), tmp_path)
    want = close_intervals(df.where("seq < 244")).where("t_end IS NOT NULL")
    assert sorted(got) == sorted(tuple(r) for r in want.select("entity", "slot", "value", "t_start", "t_end", "seq").collect())


def test_idle_states_expire(spark, tmp_path, few_partitions):
    rows = [(1, "at", "a", 1.0, 0), (2, "at", "b", 2.0, 1), (2, "at", "c", 50.0, 2), (2, "at", "d", 51.0, 3), (1, "at", "e", 52.0, 4)]
    got = drained(state.closed_intervals(fed(spark, tmp_path, events(spark, rows), 5), idle_hours=10), tmp_path)
    assert (1, "at", "a", 1.0, None, 0) in [tuple(None if x != x else x for x in r) for r in got]
    assert (2, "at", "c", 50.0, 51.0, 2) in got and not any(r[0] == 1 and r[4] == 52.0 for r in got)


def test_cache_equals_batch(spark, tmp_path, few_partitions):
    rng = random.Random(4)
    rows = [(rng.randrange(3), k, rng.choice("abcdefg")) for k in range(200)]
    df = spark.createDataFrame(rows, "session long, seq long, key string")
    got = drained(state.cache_faults(fed(spark, tmp_path, df, 3), 3, ["a"]), tmp_path, "update")
    last = {s: (n, f, e) for s, n, f, e in sorted(got)}
    want = {r["session"]: (r["faults"], r["evictions"]) for r in windows.lru_faults(df, 3, ["a"]).collect()}
    assert {s: v[1:] for s, v in last.items()} == want and sum(v[0] for v in last.values()) == 200 and len(got) == 9


def test_choices_are_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        state.closed_intervals(events(spark, made()), "sideways")
