"""Event streams: windows, sessions, deduplication, queues and state, each usable on a batch or a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.chunks import discourse_chunks
from graphloom.sources.scratch import cut
from graphloom.sources.tables import table
from graphloom.streaming.state import closed_intervals


def counts(events: DataFrame, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """start (seconds), event_type, n, total of each window; late: how long a stream waits for late events."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.unix_seconds(F.col("window.start")).alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """user_id, start, stop (seconds), n: events of a user without a longer gap."""
    g = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.unix_seconds(F.col("session_window.start")).alias("start"), F.unix_seconds(F.col("session_window.end")).alias("stop"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """The first event of each key; on a stream state is dropped behind the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if late else events.dropDuplicates(keys)


def work_queue(items: DataFrame, score: str, seq: str, pinned: str | None = None) -> DataFrame:
    """items with their priority ((1 - score) * 1000; 500 without a score; pinned first) and place in line, by the column queue.

    Items are dealt out by ranges of (queue, priority, seq); each range counts its own and starts behind the
    ranges of its queue before it, so no queue is gathered in one task.
    """
    priority = F.coalesce((1 - F.col(score)) * 1000, F.lit(500.0))
    if pinned:
        priority = F.when(F.col(pinned), -1e9).otherwise(priority)
    rows = items.withColumn("priority", F.round(priority, 4))
    parts = cut(rows.repartitionByRange("queue", "priority", seq).withColumn("_part", F.spark_partition_id()), "queue")
    sizes = parts.groupBy("queue", "_part").agg(F.count("*").alias("_n"))  # a row for each range and queue in it
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("queue").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("queue", "_part").orderBy("priority", seq))
    return parts.withColumn("_own", own).join(F.broadcast(sizes.select("queue", "_part", before.alias("_before"))), ["queue", "_part"]).withColumn("place", (F.col("_own") + F.col("_before")).cast("int")).drop("_own", "_before", "_part")


def working_set(mentions: DataFrame, most: int, decay: float = 0.9) -> DataFrame:
    """session, entity, salience, last_seen, mentions, place: the entities a session keeps, by when they were last seen, then by salience.

    mentions: session, chunk, entity, boost.  Salience fades by `decay` a chunk and grows by the boosts of a chunk,
    rounded to four digits at every step, in the order of chunks.
    """
    g = mentions.groupBy("session", "entity", "chunk").agg(F.sum("boost").alias("boost"), F.count("*").alias("m"))
    steps = F.array_sort(F.collect_list(F.struct("chunk", "boost")))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("long").alias("at"))
    fold = F.aggregate("steps", start, lambda acc, x: F.struct(F.round(acc["s"] * F.pow(F.lit(decay), F.coalesce(x["chunk"] - acc["at"], F.lit(0))) + x["boost"], 4).alias("s"), x["chunk"].alias("at")))
    held = g.groupBy("session", "entity").agg(steps.alias("steps"), F.sum("m").alias("mentions"), F.max("chunk").alias("last_seen")).select("session", "entity", fold["s"].alias("salience"), "last_seen", "mentions")
    w = Window.partitionBy("session").orderBy(F.desc("last_seen"), F.desc("salience"), "entity")
    return held.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def prefetch(edges: DataFrame, faults: DataFrame, depth: int) -> DataFrame:
    """fault, node, step: what a page fault on a node (faults: node) brings in: all that edges (src, dst) lead to within so many steps, each at its first step."""
    out = faults.select(F.col("node").alias("fault"), "node").distinct().withColumn("step", F.lit(0))
    now = out
    for k in range(1, depth + 1):
        now = now.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("_to")), "node").select("fault", F.col("_to").alias("node"), F.lit(k).alias("step")).distinct()
        out = out.unionByName(now)
    return out.groupBy("fault", "node").agg(F.min("step").alias("step"))


def lru_faults(accesses: DataFrame, capacity: int, pinned: list | None = None) -> DataFrame:
    """session, faults, evictions of a cache of `capacity` keys, replayed for every session (session, seq, key) in the order of seq.

    The least recently used key that isn't pinned goes; with nothing but pinned keys the cache is over its capacity, which is an error.
    """
    keep = frozenset(pinned or ())

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sessions follow one another in a task; only the open one's cache is held."""
        now, held, faults, evicted, any_ = None, {}, 0, 0, False
        for frame in frames:
            out = []
            for session, k in zip(frame["session"].astype(object).where(frame["session"].notna(), None), frame["key"], strict=True):
                if any_ and session != now:
                    out.append((now, faults, evicted))
                    held, faults, evicted = {}, 0, 0
                now, any_ = session, True
                faults += k not in held
                held.pop(k, None)
                held[k] = True
                if len(held) > capacity:
                    victim = next((h for h in held if h not in keep and h != k), None)
                    if victim is None:
                        raise MemoryError("every held key is pinned")
                    del held[victim]
                    evicted += 1
            yield pd.DataFrame(out, columns=["session", "faults", "evictions"])
        if any_:
            yield pd.DataFrame([(now, faults, evicted)], columns=["session", "faults", "evictions"])

    kind = accesses.schema["session"].dataType.simpleString()
    ordered = accesses.select("session", "seq", "key").repartition("session").sortWithinPartitions("session", "seq")
    return ordered.mapInPandas(replay, f"session {kind}, faults long, evictions long")


def chunk_pipeline(texts: DataFrame, transduce, compile_rows) -> DataFrame:
    """The three stages of ingestion, on a batch or a stream: texts (doc_id, text) in chunks (the same ones in both), chunks to rows of facts, facts to graph rows.

    transduce and compile_rows go from DataFrame to DataFrame; on a stream the source's trigger options limit how
    much is under way (maxFilesPerTrigger), and `drained` waits for the end.
    """
    return compile_rows(transduce(discourse_chunks(texts)))


def drained(query) -> dict:
    """Wait until a stream has handled what was there, and say how far it came."""
    query.processAllAvailable()
    last = query.lastProgress
    return {"batches": (last["batchId"] + 1) if last else 0, "rows": sum(p["numInputRows"] for p in query.recentProgress), "active": query.isActive}


def latest_state(events: DataFrame, late: str = "keep") -> DataFrame:
    """Stream of user_id, value, t_start, t_end of each state as it is closed by the next event (user_id, event_type, ts) to arrive; late: what `closed_intervals` does with late events."""
    hours = F.unix_micros("ts") / 3.6e9
    e = events.select(F.col("user_id").alias("entity"), F.lit("state").alias("slot"), F.col("event_type").alias("value"), hours.alias("t_start"), F.unix_micros("ts").alias("seq"), "ts")
    return closed_intervals(e, late=late).select(F.col("entity").alias("user_id"), "value", "t_start", "t_end")


def replay_lru(accesses: list, capacity: int, pinned: frozenset = frozenset()) -> list:
    """Keys evicted, in order, by a cache that drops the least recently used key that isn't pinned."""
    held: dict = {}
    out = []
    for key in accesses:
        held.pop(key, None)
        held[key] = True
        if len(held) > capacity:
            victim = next((k for k in held if k not in pinned and k != key), None)
            if victim is None:
                raise MemoryError("every held key is pinned")
            del held[victim]
            out.append(victim)
    return out


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def q_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("queue"), (F.col("value") / (F.col("value") + 20)).alias("score"))
    return work_queue(e, "score", "event_id").select("event_id", "queue", "priority", "place")


def q_working_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight entities that each user's last events keep: event types by hour, with their value as a boost."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("session"), F.floor(F.unix_seconds("ts") / 3600).alias("chunk"), F.concat_ws(":", "event_type", (F.col("event_id") % 5).cast("string")).alias("entity"), F.round("value", 1).alias("boost"))
    return working_set(e, 8)


def q_prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of two steps from every fifth order: customers, then their nations; counted by step."""
    from graphloom.sources.tables import triples

    t = triples(spark, sf_dir).where("property IN ('CUSTOMER', 'NATION', 'REGION')").select(F.col("subject").alias("src"), F.col("object").alias("dst"))
    faults = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.concat(F.lit("O:"), "o_orderkey").alias("node"))
    return prefetch(t, faults, 2).groupBy("step", F.when(F.col("step") > 0, F.col("node")).alias("page")).agg(F.count("*").alias("faults"))


def q_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of a cache of three keys over each user's event types, one of them pinned."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("key"))
    return lru_faults(e, 3, ["click"])


def q_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through the three stages: chunks, their longest word as a fact, facts as edges; counted by document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    facts = lambda c: c.select("doc_id", "chunk", F.array_max(F.transform(F.regexp_extract_all("piece", F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"].alias("word"))
    edges = lambda f: f.select(F.concat_ws("/", "doc_id", "chunk").alias("src"), F.lit("LONGEST").alias("rel"), F.coalesce("word", F.lit("")).alias("dst"), "doc_id")
    return chunk_pipeline(docs, facts, edges).groupBy("doc_id").agg(F.count("*").alias("edges"), F.max("dst").alias("last"))


QUERIES = {
    "ev_tumbling": lambda s, d: counts(_events(s, d), "1 hour"),
    "ev_sliding": lambda s, d: counts(_events(s, d), "1 hour", "30 minutes"),
    "ev_session": lambda s, d: sessions(_events(s, d), "30 minutes"),
    "ev_watermark_dedup": lambda s, d: deduplicated(_events(s, d), ["user_id", "event_type"]).groupBy("event_type").agg(F.count("*").alias("users")),
    "ev_json_props": lambda s, d: _events(s, d).select(F.get_json_object("props", "$.k").cast("long").alias("k"), "value").groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")),
    "priority_queue_order": q_queue,
    "entity_working_set": q_working_set,
    "page_prefetch": q_prefetch,
    "lru_faults": q_lru,
    "ingestion_stages": q_pipeline,
}
ORACLE_SQL = {
    "ev_tumbling": "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "ev_sliding": "SELECT CAST(s AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([floor(epoch(ts) / 1800) * 1800, floor(epoch(ts) / 1800) * 1800 - 1800]) AS s FROM events) GROUP BY ALL",
    "ev_session": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts))) + 1800 AS BIGINT) AS stop, count(*) AS n FROM s GROUP BY user_id, k""",
    "ev_watermark_dedup": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "ev_json_props": "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1",
    "priority_queue_order": "SELECT *, CAST(row_number() OVER (PARTITION BY queue ORDER BY priority, event_id) AS INTEGER) AS place FROM (SELECT event_id, event_type AS queue, round((1 - value / (value + 20)) * 1000, 4) AS priority FROM events)",
    "entity_working_set": """WITH RECURSIVE g AS (SELECT user_id AS session, event_type || ':' || (event_id % 5) AS entity, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS chunk, sum(round(value, 1)) AS boost, count(*) AS m FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY session, entity ORDER BY chunk) AS n FROM g),
f AS (SELECT session, entity, chunk, n, round(boost, 4) AS s FROM k WHERE n = 1 UNION ALL SELECT k.session, k.entity, k.chunk, k.n, round(f.s * pow(0.9, k.chunk - f.chunk) + k.boost, 4) FROM f JOIN k ON k.session = f.session AND k.entity = f.entity AND k.n = f.n + 1),
h AS (SELECT session, entity, max_by(s, n) AS salience, max(chunk) AS last_seen FROM f GROUP BY ALL), c AS (SELECT session, entity, CAST(sum(m) AS BIGINT) AS mentions FROM g GROUP BY ALL), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY session ORDER BY last_seen DESC, salience DESC, entity) AS INTEGER) AS place FROM h JOIN c USING (session, entity)) SELECT session, entity, salience, last_seen, mentions, place FROM p WHERE place <= 8""",
    "page_prefetch": """WITH o AS (SELECT * FROM orders WHERE o_orderkey % 5 = 0) SELECT 0 AS step, NULL AS page, count(*) AS faults FROM o UNION ALL SELECT 1, 'C:' || o_custkey, count(*) FROM o GROUP BY o_custkey UNION ALL SELECT 2, 'N:' || c_nationkey, count(*) FROM o JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey""",
}
