"""Difference constraints x - y <= c with a witness: a cycle of constraints whose bounds add up to less than zero.

A constraint is an edge from y to x with weight c; a problem has no solution exactly if it has a cycle of
negative weight.  Variables with one edge out (or one in) are contracted: their edges become edges through them,
of which the lightest between two variables stays.  So chains and rings shrink by a constant share a round.  On what is left,
Bellman and Ford's relaxation runs from a virtual source with a parent for each variable; a cycle of
parents is a negative one.  Rows are edges, never pairs of variables.  The witness is unfolded edge by edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.components import WORTH, heads, trimmed
from graphloom.sources.scratch import cut, drop
from graphloom.sources.tables import table

_EDGE = ["problem", "src", "dst"]


def _contracted(edges: DataFrame, kind: str, round_: int) -> DataFrame:
    """problem, v, t, w: variables that this round contracts, their neighbour and the weight between them."""
    own, other = ("src", "dst") if kind == "out" else ("dst", "src")
    ones = edges.groupBy("problem", F.col(own).alias("v")).agg(F.count("*").alias("n"), F.min(other).alias("t"), F.min("c").alias("w")).where("n = 1")
    return ones.where(heads(round_, F.col("problem"), F.col("v")) & ~heads(round_, F.col("problem"), F.col("t"))).select("problem", "v", "t", "w")


def _through(edges: DataFrame, gone: DataFrame, kind: str) -> DataFrame:
    """The edges without contracted variables; via: the one that an edge now passes (null: none).  Loops are kept."""
    own, other = ("dst", "src") if kind == "out" else ("src", "dst")
    plain = edges.select(*_EDGE, "c").join(gone.select("problem", F.col("v").alias(other)), ["problem", other], "left_anti")
    moved = plain.join(gone.withColumnRenamed("v", own), ["problem", own], "left")
    far = F.coalesce("t", own)
    ends = {own: far, other: F.col(other)}
    longer = moved.select("problem", ends["src"].alias("src"), ends["dst"].alias("dst"), (F.col("c") + F.coalesce("w", F.lit(0.0))).alias("c"), F.when(F.col("t").isNotNull(), F.col(own)).alias("via"))
    return longer.groupBy(*_EDGE).agg(F.min_by(F.struct("c", "via"), F.struct("c", F.col("via").isNotNull(), "via")).alias("e")).select(*_EDGE, "e.c", "e.via")


def _parent_cycles(parents: DataFrame) -> DataFrame:
    """problem, src, dst: the edges on cycles of parents (problem, node, parent): one cycle a problem, that with the smallest node."""
    links = cut(parents.where("parent IS NOT NULL").select("problem", "node", F.col("parent").alias("to"), F.col("parent").alias("low")), "links")
    rows, step = links.count(), 1
    now = links
    while step <= rows and not now.isEmpty():  # nodes from which parents go on for so many steps
        on = now.select("problem", F.col("node").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"))
        now = cut(now.join(on, ["problem", "to"]).select("problem", "node", F.col("_to").alias("to"), F.least("low", "_low").alias("low")), "links")
        step *= 2
    ends = now.select("problem", F.col("to").alias("node"), "low").groupBy("problem", "node").agg(F.min("low").alias("low"))  # after so many steps all are on cycles
    on_cycle = ends.select("problem", "node").distinct()
    cycle = now.join(on_cycle, ["problem", "node"], "left_semi")  # of a node on a cycle, low is the smallest node of it
    best = cycle.groupBy("problem").agg(F.min("low").alias("low"))
    chosen = cycle.join(best, ["problem", "low"], "left_semi")
    return links.join(chosen.select("problem", "node"), ["problem", "node"], "left_semi").select("problem", F.col("to").alias("src"), F.col("node").alias("dst"))


def _relaxed(edges: DataFrame) -> DataFrame:
    """problem, src, dst: a negative cycle of each problem that has one (parents are asked for cycles after 4, 8, 16, ... rounds)."""
    found = edges.select(*_EDGE).where("false")
    nodes = edges.select("problem", F.col("src").alias("node")).union(edges.select("problem", F.col("dst").alias("node"))).distinct()
    none = F.lit(None).cast(edges.schema["src"].dataType)
    now = cut(nodes.select("problem", "node", F.lit(0.0).alias("d"), none.alias("parent"), F.lit(True).alias("moved")), "bounds")
    round_, ask = 0, 4
    while not now.where("moved").isEmpty():
        round_ += 1
        near = edges.join(now.where("moved").select("problem", F.col("node").alias("src"), "d"), ["problem", "src"])
        came = near.groupBy("problem", F.col("dst").alias("node")).agg(F.min(F.struct((F.col("d") + F.col("c")).alias("d"), F.col("src").alias("p"))).alias("b"))
        better = F.col("b.d") < F.col("d")
        joined = now.drop("moved").join(came, ["problem", "node"], "left").withColumn("moved", F.coalesce(better, F.lit(False)))
        after = cut(joined.select("problem", "node", F.when(F.col("moved"), F.col("b.d")).otherwise(F.col("d")).alias("d"), F.when(F.col("moved"), F.col("b.p")).otherwise(F.col("parent")).alias("parent"), "moved"), "bounds")
        drop(now)
        now = after
        if round_ == ask:
            ask *= 2
            cycles = cut(_parent_cycles(now), "cycles")
            if not cycles.isEmpty():
                found = found.unionByName(cycles)
                done = cycles.select("problem").distinct()
                now = cut(now.join(done, "problem", "left_anti"), "bounds")
                edges = cut(edges.join(done, "problem", "left_anti"), "edges")
    return found


def negative_cycles(constraints: DataFrame) -> DataFrame:
    """problem, step, x, y, c: of each problem that has no solution, a simple cycle of constraints x - y <= c that shows it.

    constraints: problem, x, y, c.  Steps count from 0; the y of the first is the smallest variable of the cycle, each x is the next one's y, and
    the c add up to less than 0.  Problems with a solution give no rows; rows with a null part are left out, and of
    repeated constraints the tightest counts.
    """
    whole = constraints.where("problem IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND c IS NOT NULL")
    first = cut(whole.groupBy("problem", F.col("y").alias("src"), F.col("x").alias("dst")).agg(F.min(F.col("c").cast("double")).alias("c")), "edges")
    none = F.lit(None).cast(first.schema["src"].dataType)
    levels: list[tuple[DataFrame, DataFrame]] = []  # edges of a level with via, and the cycles that were found as its loops
    level, round_ = first.withColumn("via", none), 0

    def settled(level: DataFrame) -> DataFrame:
        """The level's trimmed edges, without the problems that a negative loop settles; both are noted."""
        loops = level.where("src = dst AND c < 0").groupBy("problem").agg(F.min("src").alias("src")).select("problem", "src", F.col("src").alias("dst"))
        loops = cut(loops, "loops")
        levels.append((level, loops))
        live = level.where("src <> dst").join(loops.select("problem"), "problem", "left_anti")
        return cut(trimmed(live, ("problem",)), "edges")

    now = settled(level)
    rows = now.count()
    while rows:
        count = rows
        for kind in ("out", "in"):
            round_ += 1
            gone = cut(_contracted(now, kind, round_), "gone")
            if not gone.isEmpty():
                now = settled(cut(_through(now, gone, kind), "edges"))
        rows = now.count()
        if rows > WORTH * count:
            break
    witness = cut(_relaxed(now), "witness") if rows else now.select(*_EDGE).where("false")
    for level, loops in reversed(levels):
        witness = witness.unionByName(loops)
        through = level.select(*_EDGE, "via").join(witness, _EDGE)
        parts = F.when(F.col("via").isNull(), F.array(F.struct("src", "dst"))).otherwise(F.array(F.struct("src", F.col("via").alias("dst")), F.struct(F.col("via").alias("src"), "dst")))
        witness = cut(through.select("problem", F.explode(parts).alias("e")).select("problem", "e.src", "e.dst"), "witness")
    return _ordered(witness.join(first, _EDGE))


def _ordered(cycle: DataFrame) -> DataFrame:
    """Edges of one cycle a problem (problem, src, dst, c) with their steps, by doubling of the way to the end."""
    roots = cycle.groupBy("problem").agg(F.min("src").alias("root"), F.count("*").alias("length"))
    edges = cut(cycle.join(roots, "problem"), "cycle")
    now = edges.select("problem", "src", F.when(F.col("dst") != F.col("root"), F.col("dst")).alias("to"), F.lit(1).cast("long").alias("far"))
    now = cut(now, "ways")
    while not now.where("to IS NOT NULL").isEmpty():
        on = now.select("problem", F.col("src").alias("to"), F.col("to").alias("_to"), F.col("far").alias("_far"))
        now = cut(now.join(on, ["problem", "to"], "left").select("problem", "src", F.col("_to").alias("to"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far")), "ways")
    return edges.join(now.select("problem", "src", "far"), ["problem", "src"]).select("problem", (F.col("length") - F.col("far")).alias("step"), F.col("dst").alias("x"), F.col("src").alias("y"), "c")


def consistent(constraints: DataFrame) -> DataFrame:
    """problem, consistent: whether constraints (problem, x, y, c) have a solution."""
    bad = negative_cycles(constraints).select("problem").distinct().withColumn("_bad", F.lit(True))
    return constraints.where("problem IS NOT NULL").select("problem").distinct().join(bad, "problem", "left").select("problem", F.col("_bad").isNull().alias("consistent"))


def ordered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """problem, x, y, c: each user's events in blocks of 500, each an hour after the one before; every third block is closed by a last event before its first."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 500).alias("problem"), F.col("event_id").alias("k"))
    follow = e.where("k % 500 > 0").select("problem", (F.col("k") - 1).alias("x"), F.col("k").alias("y"), F.lit(-1.0).alias("c"))
    last = e.groupBy("problem").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("problem % 3 = 0 AND first < last")
    slack = F.col("last") - F.col("first") - 1
    closing = last.select("problem", F.col("last").alias("x"), F.col("first").alias("y"), slack.cast("double").alias("c"))
    loose = last.select("problem", F.col("last").alias("x"), (F.col("first") + 1).alias("y"), slack.cast("double").alias("c"))  # this one holds
    return follow.unionByName(closing).unionByName(loose)


QUERIES = {"negative_cycles": lambda s, d: negative_cycles(ordered_events(s, d))}
ORACLE_SQL = {
    "negative_cycles": """WITH e AS (SELECT event_id // 500 AS problem, event_id AS k, min(event_id) OVER w AS a, max(event_id) OVER w AS b FROM events WINDOW w AS (PARTITION BY event_id // 500)), bad AS (SELECT * FROM e WHERE problem % 3 = 0 AND a < b)
SELECT problem, CAST(0 AS BIGINT) AS step, b AS x, a AS y, CAST(b - a - 1 AS DOUBLE) AS c FROM bad WHERE k = a UNION ALL SELECT problem, b - k + 1, k - 1, k, -1.0 FROM bad WHERE k > a""",
}
