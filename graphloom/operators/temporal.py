"""Temporal operators: state intervals, as-of lookup, Allen relations, difference constraints, clock times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.difference import consistent
from graphloom.sources.scratch import cut, drop
from graphloom.sources.tables import fluents, table


def close_intervals(events: DataFrame) -> DataFrame:
    """events (entity, slot, value, t_start, seq) with t_end: the start of the next one in event time; null while open."""
    w = Window.partitionBy("entity", "slot").orderBy("t_start", "seq")
    return events.withColumn("t_end", F.lead("t_start").over(w))


def active_at(t: Column) -> Column:
    """Whether the half-open interval of a row holds t; without t: whether it is open."""
    return F.when(t.isNull(), F.col("t_end").isNull()).otherwise((F.col("t_start") <= t) & (F.col("t_end").isNull() | (t < F.col("t_end"))))


def as_of(fluents_: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (entity, t) with the value of the latest record active then (null if none)."""
    f = fluents_.select("entity", "value", "t_start", "t_end", "seq")
    hit = asked.join(f, "entity").where(active_at(F.col("t")))
    best = hit.groupBy("entity", "t").agg(F.max_by("value", "seq").alias("value"))
    return asked.join(best, ["entity", "t"], "left")


def allen(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Allen's relation of two intervals."""
    return (
        F.when(a1 < b0, "before").when(b1 < a0, "after").when(a1 == b0, "meets").when(b1 == a0, "met_by")
        .when((a0 == b0) & (a1 == b1), "equals").when(a0 == b0, F.when(a1 < b1, "starts").otherwise("started_by")).when(a1 == b1, F.when(a0 > b0, "finishes").otherwise("finished_by"))
        .when((a0 > b0) & (a1 < b1), "during").when((a0 < b0) & (a1 > b1), "contains").when(a0 < b0, "overlaps").otherwise("overlapped_by")
    )


#: Moments of the day by name, in the order in which they are looked for; a vague one counts only in a text without figures.
MOMENTS = (("dawn", 6.0, False), ("morning", 6.0, True), ("noon|midday", 12.0, False), ("midnight", 0.0, False), ("dusk", 18.0, False), ("evening", 18.0, True), ("night", 22.0, True))


def clock_hours(text: Column) -> Column:
    """Hours of a time in words or figures, or null.

    A moment's name comes first, then a time with am or pm, then one with a colon, then any number.
    """
    low = F.lower(text)
    figures = low.rlike("[0-9]")
    named = [F.when(low.rlike(rf"\b(?:{name})\b") & (~figures if vague else F.lit(True)), hour) for name, hour, vague in MOMENTS]

    def read(pattern: str, half: bool) -> Column:
        group = lambda k: F.regexp_extract(low, pattern, k)
        hour, minute = group(1).try_cast("double"), F.coalesce(group(2).try_cast("double"), F.lit(0.0))
        if half:  # twelve o'clock is hour 0 of its half of the day
            hour = F.pmod(hour, F.lit(12.0)) * (hour <= 12).cast("int") + hour * (hour > 12).cast("int") + 12 * ((group(3) == "p") & (hour <= 12)).cast("int")
        return hour + minute / 60

    return F.coalesce(*named, read(r"\b([0-9]{1,2})(?::([0-9]{2}))?\s*([ap])m\b", True), read(r"\b([0-9]{1,2}):([0-9]{2})\b", False), F.regexp_extract(low, r"\b[0-9]+(?:\.[0-9]+)?\b", 0).try_cast("double"))


def shortest(constraints: DataFrame) -> DataFrame:
    """problem, x, y, c: the tightest bounds x - y <= c that constraints (the same columns) imply within their problem.

    Bounds are doubled until they rest or some x - x is below 0, so rounds follow the logarithm of the number of
    variables.  A problem has a row for each pair of its variables at most: problems are chunks, not corpora.
    """
    own = constraints.select("problem", F.col("x").alias("v")).union(constraints.select("problem", F.col("y").alias("v"))).distinct()
    start = constraints.select("problem", "x", "y", "c").unionByName(own.select("problem", F.col("v").alias("x"), F.col("v").alias("y"), F.lit(0.0).alias("c")))
    now = cut(start.groupBy("problem", "x", "y").agg(F.min("c").alias("c")), "bounds")
    while True:
        lost = now.where("x = y AND c < 0").select("problem").distinct().withColumn("lost", F.lit(True))
        live = now.join(lost, "problem", "left_anti")  # a problem that is known to fail needs no more bounds
        on = live.select("problem", F.col("x").alias("y"), F.col("y").alias("z"), F.col("c").alias("d"))
        through = live.join(on, ["problem", "y"]).select("problem", "x", F.col("z").alias("y"), (F.col("c") + F.col("d")).alias("c"))
        after = cut(now.unionByName(through).groupBy("problem", "x", "y").agg(F.min("c").alias("c")), "bounds")
        tighter = after.join(now.withColumnRenamed("c", "_c"), ["problem", "x", "y"], "left").where("_c IS NULL OR c < _c")
        rests = tighter.isEmpty()  # told bound by bound: bounds only fall, and each is a sum of given ones
        drop(now)
        if rests:
            return after
        now = after


#: Bounds that a relation of two events a and b puts on their points: (point, other point, c) means point - other point <= c; gaps are of one unit.
ALLEN_BOUNDS = {
    "BEFORE": (("a1", "b0", -1.0),), "AFTER": (("b1", "a0", -1.0),), "MEETS": (("a1", "b0", 0.0), ("b0", "a1", 0.0)), "MET_BY": (("b1", "a0", 0.0), ("a0", "b1", 0.0)),
    "DURING": (("b0", "a0", -1.0), ("a1", "b1", -1.0)), "CONTAINS": (("a0", "b0", -1.0), ("b1", "a1", -1.0)), "OVERLAPS": (("a0", "b0", -1.0), ("b0", "a1", -1.0), ("a1", "b1", -1.0)),
    "STARTS": (("a0", "b0", 0.0), ("b0", "a0", 0.0), ("a1", "b1", -1.0)), "FINISHES": (("a1", "b1", 0.0), ("b1", "a1", 0.0), ("b0", "a0", -1.0)),
    "EQUALS": (("a0", "b0", 0.0), ("b0", "a0", 0.0), ("a1", "b1", 0.0), ("b1", "a1", 0.0)), "CAUSES": (("a0", "b0", -1.0),),
}


def allen_constraints(relations: DataFrame) -> DataFrame:
    """problem, x, y, c: the bounds of relations (problem, a, rel, b) between events, each of which lasts a unit at least."""
    rows = [(rel, *bound) for rel, bounds in ALLEN_BOUNDS.items() for bound in bounds]
    table_ = relations.sparkSession.createDataFrame(rows, "rel string, p string, q string, c double")
    point = lambda p: F.concat_ws(".", F.when(F.substring(p, 1, 1) == "a", F.col("a").cast("string")).otherwise(F.col("b").cast("string")), F.substring(p, 2, 1))
    bounds = relations.join(F.broadcast(table_), "rel").select("problem", point("p").alias("x"), point("q").alias("y"), "c")
    events = relations.select("problem", F.col("a").alias("e")).union(relations.select("problem", F.col("b").alias("e"))).distinct()
    lasting = events.select("problem", F.concat_ws(".", F.col("e").cast("string"), F.lit("0")).alias("x"), F.concat_ws(".", F.col("e").cast("string"), F.lit("1")).alias("y"), F.lit(-1.0).alias("c"))
    return bounds.unionByName(lasting)


def close_by_arrival(events: DataFrame, late: str = "keep") -> DataFrame:
    """events (entity, slot, value, t_start, seq) with t_end, closed in the order of arrival (seq): any next one closes, one of the same value too.

    late: an event that starts before one that arrived earlier makes an inverted interval (keep), or is left out (drop).
    """
    w = Window.partitionBy("entity", "slot").orderBy("seq")
    if late == "drop":
        newest = F.max("t_start").over(w.rowsBetween(Window.unboundedPreceding, -1))
        events = events.withColumn("_newest", newest).where("_newest IS NULL OR t_start >= _newest").drop("_newest")
    return events.withColumn("t_end", F.lead("t_start").over(w))


def synced(events: DataFrame) -> DataFrame:
    """entity, slot, value, t_start, seq: the location that events (agent, patient, theme, location, t, seq) give to the patient, else the theme, else the agent."""
    target = F.coalesce("patient", "theme", "agent")
    return events.where(F.col("location").isNotNull() & target.isNotNull()).select(target.alias("entity"), F.lit("location").alias("slot"), F.col("location").alias("value"), F.col("t").alias("t_start"), "seq")


def chain_as_of(links: DataFrame, fluents_: DataFrame, start: DataFrame, props: list[str]) -> DataFrame:
    """root, t, node, value: where properties lead from start (node, t), and the state there at t (null: none)."""
    out = start.select(F.col("node").alias("root"), "t", "node")
    for prop in props:
        step = links.where(F.col("property") == prop).select(F.col("subject").alias("node"), F.col("object").alias("_to"))
        out = out.join(step, "node").select("root", "t", F.col("_to").alias("node")).distinct()
    states = as_of(fluents_, out.select(F.col("node").alias("entity"), "t").distinct())
    return out.join(states.withColumnRenamed("entity", "node"), ["node", "t"], "left").select("root", "t", "node", "value")


def q_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fluents(spark, sf_dir)
    return f.select("entity", "seq", "value", F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"))


def q_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every user in the middle of the observed time."""
    f = fluents(spark, sf_dir)
    middle = f.agg(((F.min("t_start") + F.max("t_start")) / 2).alias("t"))
    return as_of(f, f.select("entity").distinct().join(F.broadcast(middle))).select("entity", "value")


def q_allen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation of each closed interval with the next but one of its user, whose end is moved by a rule so that many relations occur."""
    w = Window.partitionBy("entity").orderBy("t_start", "seq")
    f = fluents(spark, sf_dir).where("t_end IS NOT NULL")
    k = F.col("seq") % 7
    f = f.withColumns({"b0": F.lead("t_start").over(w), "b1": F.lead("t_end").over(w)}).where("b1 IS NOT NULL")
    moved0 = F.when(k == 1, F.col("t_start")).when(k == 2, F.col("t_start") + (F.col("t_end") - F.col("t_start")) / 4).when(k == 3, F.col("t_start") - 1).otherwise(F.col("b0"))
    moved1 = F.when(k == 1, F.col("t_end") + F.when(F.col("seq") % 2 == 0, 1).otherwise(0)).when(k == 2, F.col("t_end") - (F.col("t_end") - F.col("t_start")) / 4).when(k == 3, F.col("t_end")).otherwise(F.col("b1"))
    return f.select("entity", "seq", allen(F.col("t_start"), F.col("t_end"), moved0, moved1).alias("relation"))


def q_inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that end before they start when closed in order of arrival (event_id) instead of event time."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    nxt = F.lead("t").over(Window.partitionBy("user_id").orderBy("event_id"))
    return e.withColumn("n", nxt).groupBy("user_id").agg(F.count("*").alias("events"), F.sum(F.coalesce((F.col("n") < F.col("t")).cast("long"), F.lit(0))).alias("inverted"))


def q_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistency of the order of events in blocks of eight; every 50th event is also said to come after the next one, every 90th to contain it."""
    e = table(spark, sf_dir, "events").where("event_id % 8 < 7").select(F.floor(F.col("event_id") / 8).alias("problem"), F.col("event_id").alias("a"), (F.col("event_id") + 1).alias("b"))
    k = F.col("a") % 3
    plain = e.withColumn("rel", F.when(k == 0, "BEFORE").when(k == 1, "MEETS").otherwise("OVERLAPS"))
    again = e.where("a % 50 = 0").withColumn("rel", F.lit("AFTER")).unionByName(e.where("a % 90 = 0").withColumn("rel", F.lit("CONTAINS")))
    return consistent(allen_constraints(plain.unionByName(again)))


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose every ninth arrives two hours early on the clock."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.lit("last").alias("slot"), F.col("event_type").alias("value"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("t"), F.col("event_id").alias("seq"))
    return e.select("entity", "slot", "value", F.round(F.col("t") - F.when(F.col("seq") % 9 == 0, 2.0).otherwise(0.0), 6).alias("t_start"), "seq")


def q_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals closed by arrival, with late events kept and without them."""
    a = _arrivals(spark, sf_dir)
    kept = close_by_arrival(a).select("entity", "seq", "value", "t_start", "t_end", (F.col("t_end") < F.col("t_start")).alias("inverted"))
    return kept.join(close_by_arrival(a, "drop").select("seq", F.col("t_end").alias("t_end_without")), "seq", "left")


def q_synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of lines' parts by their suppliers, as of the ship date: the state intervals of every part."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_partkey")).alias("patient"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_partkey")).alias("theme"), F.lit(-1).cast("long").alias("agent"), F.when(F.col("l_linenumber") < 6, F.col("l_suppkey")).alias("location"), (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 3600).alias("t"))
    return close_intervals(synced(li)).groupBy("entity").agg(F.count("*").alias("spells"), F.max_by("value", F.struct("t_start", "seq")).alias("place"), F.round(F.sum(F.coalesce(F.col("t_end") - F.col("t_start"), F.lit(0.0))), 3).alias("hours"))


def q_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every order to its customer's user, and that user's last event at a time that follows from the order."""
    links = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("subject"), F.lit("CUSTOMER").alias("property"), F.col("o_custkey").alias("object"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), F.lit("USER").alias("property"), (F.col("c_custkey") % 60).alias("object"))
    f = fluents(spark, sf_dir)
    first = f.agg(F.floor(F.min("t_start")).cast("double").alias("t0"))
    start = table(spark, sf_dir, "orders").join(F.broadcast(first)).select(F.col("o_orderkey").alias("node"), (F.col("t0") + F.col("o_orderkey") % 24).alias("t"))
    return chain_as_of(links.unionByName(users), f, start, ["CUSTOMER", "USER"]).select("root", "node", "value")


def q_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock times of events written in words and figures, read back."""
    e = table(spark, sf_dir, "events").select("event_id", F.hour(F.col("ts").cast("timestamp")).alias("h"), F.minute(F.col("ts").cast("timestamp")).alias("m"))
    twelve = F.format_string("%d:%02d %s", F.when(F.col("h") % 12 == 0, 12).otherwise(F.col("h") % 12), F.col("m"), F.when(F.col("h") < 12, "AM").otherwise("PM"))
    text = F.when(F.col("event_id") % 3 == 0, twelve).when(F.col("event_id") % 3 == 1, F.format_string("at %02d:%02d", "h", "m")).otherwise(F.when(F.col("h") < 8, "at dawn").otherwise("this evening"))
    return e.select("event_id", F.round(clock_hours(text), 6).alias("hours"))


QUERIES = {
    "fluent_intervals": q_intervals,
    "fluent_asof": q_as_of,
    "fluent_history": lambda s, d: fluents(s, d).groupBy("entity", "value").agg(F.count("*").alias("spells"), F.round(F.sum(F.col("t_end") - F.col("t_start")), 4).alias("hours"), F.max("seq").alias("last_seq")),
    "allen_relation": q_allen,
    "interval_inversion": q_inversions,
    "difference_logic": q_difference,
    "parse_timestamp": q_clock,
    "fluent_arrival": q_arrival,
    "state_sync": q_synced,
    "reasoning_chain": q_chain,
}
_F = "f AS (SELECT user_id AS entity, event_type AS value, epoch_us(ts) / 3.6e9 AS t_start, event_id AS seq, lead(epoch_us(ts) / 3.6e9) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t_end FROM events)"
ORACLE_SQL = {
    "fluent_intervals": f"WITH {_F} SELECT entity, seq, value, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end FROM f",
    "fluent_asof": f"WITH {_F}, m AS (SELECT (min(t_start) + max(t_start)) / 2 AS t FROM f), h AS (SELECT entity, max_by(value, seq) AS value FROM f, m WHERE t_start <= t AND (t_end IS NULL OR t < t_end) GROUP BY entity) SELECT entity, value FROM (SELECT DISTINCT entity FROM f) LEFT JOIN h USING (entity)",
    "fluent_history": f"WITH {_F} SELECT entity, value, count(*) AS spells, round(sum(t_end - t_start), 4) AS hours, max(seq) AS last_seq FROM f GROUP BY entity, value",
    "allen_relation": f"""WITH {_F}, n AS (SELECT entity, seq, t_start AS a0, t_end AS a1, lead(t_start) OVER w AS b0, lead(t_end) OVER w AS b1 FROM f WHERE t_end IS NOT NULL WINDOW w AS (PARTITION BY entity ORDER BY t_start, seq)),
g AS (SELECT entity, seq, a0, a1, CASE seq % 7 WHEN 1 THEN a0 WHEN 2 THEN a0 + (a1 - a0) / 4 WHEN 3 THEN a0 - 1 ELSE b0 END AS b0, CASE seq % 7 WHEN 1 THEN a1 + CASE WHEN seq % 2 = 0 THEN 1 ELSE 0 END WHEN 2 THEN a1 - (a1 - a0) / 4 WHEN 3 THEN a1 ELSE b1 END AS b1 FROM n WHERE b1 IS NOT NULL)
SELECT entity, seq, CASE WHEN a1 < b0 THEN 'before' WHEN b1 < a0 THEN 'after' WHEN a1 = b0 THEN 'meets' WHEN b1 = a0 THEN 'met_by' WHEN a0 = b0 AND a1 = b1 THEN 'equals' WHEN a0 = b0 AND a1 < b1 THEN 'starts' WHEN a0 = b0 THEN 'started_by' WHEN a1 = b1 AND a0 > b0 THEN 'finishes' WHEN a1 = b1 THEN 'finished_by' WHEN a0 > b0 AND a1 < b1 THEN 'during' WHEN a0 < b0 AND a1 > b1 THEN 'contains' WHEN a0 < b0 THEN 'overlaps' ELSE 'overlapped_by' END AS relation FROM g""",
    "interval_inversion": "SELECT user_id, count(*) AS events, CAST(sum(CASE WHEN n < ts THEN 1 ELSE 0 END) AS BIGINT) AS inverted FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) GROUP BY user_id",
    "difference_logic": "SELECT event_id // 8 AS problem, NOT bool_or(event_id % 50 = 0 OR event_id % 90 = 0) AS consistent FROM events WHERE event_id % 8 < 7 GROUP BY 1",
    "fluent_arrival": """WITH e AS (SELECT user_id AS entity, event_id AS seq, event_type AS value, round(epoch_us(ts) / 3.6e9 - CASE WHEN event_id % 9 = 0 THEN 2.0 ELSE 0.0 END, 6) AS t_start FROM events), k AS (SELECT *, lead(t_start) OVER (PARTITION BY entity ORDER BY seq) AS t_end, max(t_start) OVER (PARTITION BY entity ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM e),
d AS (SELECT seq, lead(t_start) OVER (PARTITION BY entity ORDER BY seq) AS t_end_without FROM k WHERE newest IS NULL OR t_start >= newest) SELECT k.seq, entity, value, t_start, t_end, t_end < t_start AS inverted, t_end_without FROM k LEFT JOIN d ON d.seq = k.seq""",
    "state_sync": """WITH e AS (SELECT l_partkey AS entity, l_suppkey AS value, epoch(l_shipdate) / 3600 AS t, l_orderkey * 10 + l_linenumber AS seq FROM lineitem WHERE l_linenumber < 6), i AS (SELECT *, lead(t) OVER (PARTITION BY entity ORDER BY t, seq) - t AS h, row_number() OVER (PARTITION BY entity ORDER BY t DESC, seq DESC) AS r FROM e)
SELECT entity, count(*) AS spells, max(value) FILTER (r = 1) AS place, round(coalesce(sum(h), 0), 3) AS hours FROM i GROUP BY entity""",
    "reasoning_chain": f"""WITH {_F}, o AS (SELECT o_orderkey AS root, o_custkey % 60 AS node, (SELECT floor(min(t_start)) FROM f) + o_orderkey % 24 AS t FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)),
h AS (SELECT root, max_by(value, seq) AS value FROM o JOIN f ON entity = node AND t_start <= t AND (t_end IS NULL OR t < t_end) GROUP BY root) SELECT root, node, value FROM o LEFT JOIN h USING (root)""",
    "parse_timestamp": "SELECT event_id, round(CASE WHEN event_id % 3 < 2 THEN hour(ts) + minute(ts) / 60 WHEN hour(ts) < 8 THEN 6.0 ELSE 18.0 END, 6) AS hours FROM events",
}
