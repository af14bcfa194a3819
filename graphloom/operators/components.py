"""Strongly connected components by joins: trimming, contraction of single edges, colours from pivots.

Nodes without edges in or out are trimmed, as no cycle passes them.  A node with one edge out (or one in) is
contracted into its neighbour, and so are nodes that lead to each other; coins keep two neighbours from going in
the same round, so chains and rings shrink by a constant share a round.  What is left is coloured: each node takes
the largest node that reaches it, labels jump along labels, and of each colour those that reach its pivot in turn are a
component.  Contracted nodes then return from the last round to the first: one belongs to its neighbour's
component if another of its neighbours does.  Rounds follow the logarithm of the nodes on chains, rings and
trees, and the distances between nodes of what can't be contracted otherwise; rows are edges, never pairs of nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.sources.scratch import cut, drop
from graphloom.sources.tables import table, triples

#: Contraction goes on while a round leaves less than this share of the edges, and more than so many (fewer are coloured in less time; components are the same).
WORTH, FEW = 0.9, 20_000
#: Tables of a union before it is written as one.
PIECES = 8


def heads(round_: int, *columns: Column) -> Column:
    """A coin of a node, another one each round."""
    return F.xxhash64(F.lit(round_), *columns).bitwiseAND(1) == 1


def trimmed(edges: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """Edges (src, dst and others) whose source is reached and whose target leads on, within what key columns tell apart."""
    on = [*key, "src"]
    ends = edges.select(*key, F.col("dst").alias("src")).distinct()
    starts = edges.select(*key, F.col("src").alias("dst")).distinct()
    return edges.join(ends, on, "left_semi").join(starts, [*key, "dst"], "left_semi")


def _single(edges: DataFrame, kind: str, round_: int) -> DataFrame:
    """v, t: nodes that this round contracts and what into."""
    if kind == "both":
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        found = edges.join(back, ["src", "dst"]).where(heads(round_, F.col("src")) & ~heads(round_, F.col("dst")))
        return found.groupBy(F.col("src").alias("v")).agg(F.min("dst").alias("t"))
    own, other = ("src", "dst") if kind == "out" else ("dst", "src")
    ones = edges.groupBy(F.col(own).alias("v")).agg(F.count("*").alias("n"), F.min(other).alias("t")).where("n = 1")
    return ones.where(heads(round_, F.col("v")) & ~heads(round_, F.col("t"))).select("v", "t")


def _rewired(edges: DataFrame, gone: DataFrame, kind: str) -> DataFrame:
    """The edges after nodes were contracted; those of a node on the side of its single edge are that edge alone."""
    out = edges
    for side, kinds in (("src", ("in", "both")), ("dst", ("out", "both"))):
        if kind in kinds:
            moved = gone.select(F.col("v").alias(side), F.col("t").alias("_t"))
            out = out.join(moved, side, "left").select(*[F.coalesce("_t", side).alias(c) if c == side else c for c in ("src", "dst")])
        else:
            out = out.join(gone.select(F.col("v").alias(side)), side, "left_anti")
    return out.where("src <> dst").select("src", "dst").distinct()


def _spread(edges: DataFrame) -> DataFrame:
    """node, label: the largest node from which edges lead to it, itself included."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    now = cut(nodes.withColumn("label", F.col("node")).withColumn("moved", F.lit(True)), "labels")
    while True:
        came = edges.join(now.where("moved").select(F.col("node").alias("src"), "label"), "src").select(F.col("dst").alias("node"), "label")
        own = now.select("node", "label", F.col("label").alias("old"))
        best = own.unionByName(came, allowMissingColumns=True).groupBy("node").agg(F.max("label").alias("label"), F.max("old").alias("old"))
        jumps = now.select(F.col("node").alias("label"), F.col("label").alias("further"))
        label = F.greatest("label", F.coalesce("further", "label"))
        after = cut(best.join(jumps, "label", "left").select("node", label.alias("label"), (label != F.col("old")).alias("moved")), "labels")
        drop(now)
        now = after
        if now.where("moved").isEmpty():
            return now.select("node", "label")


def _coloured(edges: DataFrame) -> DataFrame:
    """node, comp: of each colour the nodes that its pivot reaches and that reach it."""
    colours = _spread(edges)
    of = lambda side: colours.select(F.col("node").alias(side), F.col("label").alias(f"_{side}"))
    inside = cut(edges.join(of("src"), "src").join(of("dst"), "dst").where("_src = _dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "coloured")
    back = _spread(inside)  # a pivot is the largest node of its colour, so those that reach it are labelled by it
    found = cut(colours.join(back.withColumnRenamed("label", "_back"), "node").where("label = _back").select("node", F.col("label").alias("comp")), "found")
    alone = colours.where("node = label").join(found, "node", "left_anti").select("node", F.col("label").alias("comp"))
    return found.unionByName(alone)


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """node, component, members, cyclic: the strongly connected components of edges (src, dst).

    component is the smallest node of it, members their number; cyclic tells whether some cycle passes the node (an
    edge to itself counts).  Nodes are those that edges name; repeated edges count once, null ends are left out.
    """
    given = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    nodes = given.select(F.col("src").alias("node")).union(given.select(F.col("dst").alias("node"))).distinct()
    loops = given.where("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("_loop"))
    now, count, round_ = cut(trimmed(given.where("src <> dst")), "edges"), None, 0
    steps: list[tuple[str, DataFrame, DataFrame]] = []
    known = [now.select(F.col("src").alias("node"), F.col("src").alias("comp")).where("false")]

    def learn(more: DataFrame) -> None:
        known.append(more)
        if len(known) > PIECES:
            known[:] = [cut(_union(known), "known")]

    rows = now.count()
    while rows:
        count = rows
        for kind in ("out", "in", "both") if rows > few else ():
            round_ += 1
            gone = cut(_single(now, kind, round_), "gone")
            if not gone.isEmpty():
                steps.append((kind, now, gone))
                now = cut(_rewired(now, gone, kind), "edges")
        if count > few:
            now = cut(trimmed(now), "edges")
            rows = now.count()
        if rows > WORTH * count:
            found = cut(_coloured(now), "found")
            learn(found)
            for side in ("src", "dst"):
                now = now.join(found.select(F.col("node").alias(side)), side, "left_anti")
            now = cut(trimmed(now.select("src", "dst")), "edges")
            rows = now.count()
    for kind, before, gone in reversed(steps):
        so_far = _union(known)
        comp = lambda name: so_far.select(F.col("node").alias(name), F.col("comp").alias(f"_{name}"))  # noqa: E731, B023
        into = gone.join(comp("t"), "t", "left").select("v", F.coalesce("_t", "t").alias("comp"))
        if kind != "both":
            own, other = ("dst", "src") if kind == "out" else ("src", "dst")
            around = before.join(into.withColumnRenamed("v", own), own).select(F.col(own).alias("v"), F.col(other).alias("u"), "comp")
            into = around.join(comp("u"), "u", "left").where(F.coalesce("_u", "u") == F.col("comp")).select("v", "comp").distinct()
        pairs = into.select(F.col("v").alias("node"), "comp")
        learn(cut(pairs.unionByName(into.select(F.col("comp").alias("node"), "comp").distinct().join(so_far, "node", "left_anti")), "back"))
    placed = cut(nodes.join(_union(known), "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "placed")
    sizes = placed.groupBy("comp").agg(F.min("node").alias("component"), F.count("*").alias("members"))
    return placed.join(sizes, "comp").join(loops, "node", "left").select("node", "component", "members", ((F.col("members") > 1) | F.coalesce("_loop", F.lit(False))).alias("cyclic"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def condensed(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """src, dst: the edges between components (a graph without cycles); placed is what `components` gives."""
    of = lambda side: placed.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
    return edges.join(of("src"), "src").join(of("dst"), "dst").where("_src <> _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct()


def total_order(edges: DataFrame) -> DataFrame:
    """node, place, component, cyclic: all nodes of edges (src, dst) in one order in which targets come before sources, places from 0.

    Nodes on a cycle can't be ordered so: they stand together (cyclic), and the order holds between components.  Ties
    go by height over the nodes without targets, then component, then node.  Places are dealt by ranges, so nothing is sorted in one task;
    heights take as many rounds as the longest path between components.
    """
    from graphloom.operators.graph import heights

    placed = cut(components(edges), "placed")
    high = heights(condensed(edges, placed).select(F.col("dst").alias("child"), F.col("src").alias("parent")))
    rows = placed.join(high.select(F.col("node").alias("component"), "level"), "component", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    parts = cut(rows.repartitionByRange("level", "component", "node").withColumn("_part", F.spark_partition_id()), "parts")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("level", "component", "node")) - 1
    return parts.withColumn("_own", own).join(F.broadcast(before), "_part").select("node", (F.col("_before") + F.col("_own")).alias("place"), "component", "cyclic")


def q_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers in one order, customers first, with a ring of two above some nations."""
    t = triples(spark, sf_dir).where("property IN ('NATION', 'REGION')").select(F.col("object").alias("src"), F.col("subject").alias("dst"))
    knots = table(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.lit("X:1").alias("src"), F.concat(F.lit("N:"), "n_nationkey").alias("dst"))
    return total_order(t.unionByName(knots).unionByName(spark.createDataFrame([("X:2", "X:1"), ("X:3", "X:2"), ("X:2", "X:3")], "src string, dst string")))


def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, customers and nations, with links back from nations to the first order of every seventh customer and from parts in rings."""
    t = triples(spark, sf_dir).where("property IN ('CUSTOMER', 'NATION')").select(F.col("subject").alias("src"), F.col("object").alias("dst"))
    firsts = table(spark, sf_dir, "orders").where("o_custkey % 7 = 0").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o"))
    c = table(spark, sf_dir, "customer").join(firsts, F.col("c_custkey") == F.col("o_custkey"))
    back = c.where("c_nationkey % 3 = 0").select(F.concat(F.lit("N:"), "c_nationkey").alias("src"), F.concat(F.lit("O:"), "o").alias("dst"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 40).alias("ring"))
    last = p.groupBy("ring").agg(F.max("p_partkey").alias("last"), F.min("p_partkey").alias("first"))
    rings = p.join(last, "ring").select(F.concat(F.lit("P:"), "p_partkey").alias("src"), F.concat(F.lit("P:"), F.when(F.col("p_partkey") == F.col("last"), F.col("first") - F.when(F.col("ring") % 2 == 0, 0).otherwise(40)).otherwise(F.col("p_partkey") + 1)).alias("dst"))
    return components(t.unionByName(back).unionByName(rings))


QUERIES = {"graph_components": q_components, "topo_order": q_order}
ORACLE_SQL = {
    "graph_components": """WITH RECURSIVE o AS (SELECT o_custkey, min(o_orderkey) AS o FROM orders WHERE o_custkey % 7 = 0 GROUP BY 1), back AS (SELECT c_nationkey AS n, o, o_custkey AS c FROM customer JOIN o ON o_custkey = c_custkey WHERE c_nationkey % 3 = 0),
round_trip AS (SELECT 'N:' || n AS node, n FROM back UNION SELECT 'O:' || o, n FROM back UNION SELECT 'C:' || c, n FROM back),
p AS (SELECT p_partkey AS k, p_partkey // 40 AS ring, min(p_partkey) OVER w AS first, max(p_partkey) OVER w AS last FROM part WINDOW w AS (PARTITION BY p_partkey // 40)),
pairs AS (SELECT node, n AS comp FROM round_trip), found AS (SELECT node, min(node) OVER w AS component, count(*) OVER w AS members FROM pairs WINDOW w AS (PARTITION BY comp)),
rings AS (SELECT 'P:' || k AS node, min('P:' || k) OVER w AS component, count(*) OVER w AS members, true AS cyclic FROM p WHERE ring % 2 = 0 WINDOW w AS (PARTITION BY ring)),
n AS (SELECT 'O:' || o_orderkey AS node FROM orders UNION SELECT 'C:' || o_custkey FROM orders UNION SELECT 'C:' || c_custkey FROM customer UNION SELECT 'S:' || s_suppkey FROM supplier UNION SELECT 'N:' || c_nationkey FROM customer UNION SELECT 'N:' || s_nationkey FROM supplier
UNION SELECT 'P:' || k FROM p WHERE ring % 2 = 1 UNION SELECT 'P:' || (first - 40) FROM p WHERE ring % 2 = 1 AND first - 40 NOT IN (SELECT k FROM p))
SELECT node, component, members, members > 1 AS cyclic FROM found UNION ALL SELECT * FROM rings UNION ALL SELECT node, node, 1, false FROM n WHERE node NOT IN (SELECT node FROM found) AND node NOT IN (SELECT node FROM rings)""",
    "topo_order": """WITH RECURSIVE e AS (SELECT 'C:' || c_custkey AS c, 'N:' || c_nationkey AS p FROM customer UNION SELECT 'S:' || s_suppkey, 'N:' || s_nationkey FROM supplier UNION SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation UNION SELECT 'N:' || n_nationkey, 'X:1' FROM nation WHERE n_nationkey < 3 UNION SELECT 'X:1', 'X:2'),
n AS (SELECT c AS node FROM e UNION SELECT p FROM e), h AS (SELECT node, 0 AS level FROM n WHERE node NOT IN (SELECT p FROM e) UNION SELECT e.p, level + 1 FROM h JOIN e ON e.c = h.node),
l AS (SELECT node, max(level) AS level, node AS component, node = 'X:2' AS cyclic FROM h GROUP BY node), w AS (SELECT * FROM l UNION ALL SELECT 'X:3', level, 'X:2', true FROM l WHERE node = 'X:2')
SELECT node, row_number() OVER (ORDER BY level, component, node) - 1 AS place, component, cyclic FROM w""",
}
