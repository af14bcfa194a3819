"""Operators with state of their own on streams: state intervals by arrival or by event time, and a cache replayed as accesses come.

They run on Spark's arbitrary state (value and list states, timers, expiry) in the RocksDB store, so state is
kept between triggers, survives a restart from the checkpoint and is spread by key.  What a trigger brings for a key is put
in order; the source's options (maxFilesPerTrigger) bound how much that is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSED = "entity long, slot string, value string, t_start double, t_end double, seq long"
_FIELDS = ["value", "t_start", "seq"]


def use_state_store(spark: SparkSession) -> None:
    """The store that arbitrary state needs; it holds for streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def _frame(key: tuple, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(*key, *r) for r in rows], columns=["entity", "slot", "value", "t_start", "t_end", "seq"]).astype({"t_end": "float64", "t_start": "float64"})


class ArrivalIntervals(StatefulProcessor):
    """Each event closes the one that arrived before it; late: whether one that starts before the newest start so far is kept (and inverts an interval) or dropped."""

    def __init__(self, late: str, idle_ms: int | None) -> None:
        self.late, self.idle_ms = late, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "value string, t_start double, seq long, newest double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        held, out = self.open.get() if self.open.exists() else None, []
        for value, t, seq in frame[_FIELDS].itertuples(index=False):
            if held is not None and self.late == "drop" and t < held[3]:
                continue
            if held is not None:
                out.append((held[0], held[1], t, held[2]))
            held = (value, float(t), int(seq), max(float(t), held[3]) if held is not None else float(t))
        if held is not None:
            self.open.update(held)
            if self.idle_ms is not None:
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(int(held[3] * 3_600_000) + self.idle_ms)
        yield _frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        value, t, seq, _ = self.open.get()
        self.open.clear()
        yield _frame(key, [(value, t, None, seq)])

    def close(self) -> None:
        pass


class EventIntervals(StatefulProcessor):
    """Events wait until the watermark has passed them, then each is closed by the next one in event time (ties by seq)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "value string, t_start double, seq long")
        self.waiting = handle.getListState("waiting", "value string, t_start double, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        self.waiting.appendList([(v, float(t), int(s)) for v, t, s in frame[_FIELDS].itertuples(index=False)])
        for t in frame["t_start"].unique():
            self.handle.registerTimer(int(t * 3_600_000) + 1)
        yield _frame(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() / 3_600_000
        waiting = list(self.waiting.get())
        due = sorted((w for w in waiting if w[1] <= until), key=lambda w: (w[1], w[2]))
        held, out = self.open.get() if self.open.exists() else None, []
        for value, t, seq in due:
            if held is not None:
                out.append((held[0], held[1], t, held[2]))
            held = (value, t, seq)
        if due:
            self.open.update(held)
            rest = [tuple(w) for w in waiting if w[1] > until]
            self.waiting.put(rest) if rest else self.waiting.clear()
        yield _frame(key, out)

    def close(self) -> None:
        pass


def closed_intervals(events: DataFrame, order: str = "arrival", *, late: str = "keep", wait: str = "0 seconds", idle_hours: float | None = None) -> DataFrame:
    """A stream of entity, slot, value, t_start, t_end, seq: the intervals of events (entity, slot, value, t_start in hours, seq, ts), each once it is closed.

    order arrival: closed by the next event to arrive; late events are kept or dropped.  order event: closed by the
    next one in event time, once the watermark (`wait` behind the newest ts) has passed it; events behind the watermark are left out.
    idle_hours (arrival): a state that the watermark has left so far behind is given out with an open end and forgotten.
    """
    if order not in ("arrival", "event") or late not in ("keep", "drop"):
        raise ValueError("order is arrival or event, late is keep or drop")
    use_state_store(events.sparkSession)
    timed = order == "event" or idle_hours is not None
    rows = events.withWatermark("ts", wait) if timed else events
    rows = rows.select(F.col("entity").cast("long").alias("entity"), F.col("slot").cast("string").alias("slot"), F.col("value").cast("string").alias("value"), F.col("t_start").cast("double").alias("t_start"), F.col("seq").cast("long").alias("seq"), *(["ts"] if timed else []))
    processor = EventIntervals() if order == "event" else ArrivalIntervals(late, None if idle_hours is None else int(idle_hours * 3_600_000))
    return rows.groupBy("entity", "slot").transformWithStateInPandas(processor, CLOSED, "append", "EventTime" if timed else "None")


class CacheReplay(StatefulProcessor):
    """A cache of so many keys for each session; the least recently used one that isn't pinned goes.  State not touched for ttl_ms is forgotten."""

    def __init__(self, capacity: int, pinned: frozenset[str], ttl_ms: int | None) -> None:
        self.capacity, self.pinned, self.ttl_ms = capacity, pinned, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "key string", self.ttl_ms)
        self.sums = handle.getValueState("sums", "accesses long, faults long, evictions long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = dict.fromkeys(k[0] for k in self.held.get()) if self.held.exists() else {}
        accesses, faults, evictions = self.sums.get() if self.sums.exists() else (0, 0, 0)
        for k in pd.concat(list(rows)).sort_values("seq", kind="stable")["key"]:
            accesses += 1
            faults += k not in held
            held.pop(k, None)
            held[k] = None
            if len(held) > self.capacity:
                victim = next((h for h in held if h not in self.pinned and h != k), None)
                if victim is None:
                    raise MemoryError("every held key is pinned")
                del held[victim]
                evictions += 1
        self.held.put([(k,) for k in held])
        self.sums.update((accesses, faults, evictions))
        yield pd.DataFrame([(*key, accesses, faults, evictions)], columns=["session", "accesses", "faults", "evictions"])

    def close(self) -> None:
        pass


def cache_faults(accesses: DataFrame, capacity: int, pinned: list[str] | None = None, *, ttl_ms: int | None = None) -> DataFrame:
    """A stream (update mode) of session, accesses, faults, evictions so far, for each session (session long, seq, key string) that a trigger touches.

    With ttl_ms a session that rests so long (by the clock) starts anew.
    """
    use_state_store(accesses.sparkSession)
    rows = accesses.select(F.col("session").cast("long").alias("session"), F.col("seq").cast("long").alias("seq"), F.col("key").cast("string").alias("key"))
    processor = CacheReplay(capacity, frozenset(pinned or ()), ttl_ms)
    return rows.groupBy("session").transformWithStateInPandas(processor, "session long, accesses long, faults long, evictions long", "update", "ProcessingTime" if ttl_ms else "None")
