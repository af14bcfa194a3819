"""Graph operators: gated edges, personalised PageRank, spreading activation, projection, hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from graphloom.operators.kb import T_SQL
from graphloom.sources.scratch import cut, drop
from graphloom.sources.tables import slot_words, table, triples

DAMPING, REVERSE, DECAY = 0.15, 0.8, 0.7


def gate_factor(truth: Column, confidence: Column, positive: bool = True) -> Column:
    """Weight of a target's status: contradiction 0, true 1, unknown its confidence, false 0 (or its refutation weight)."""
    refuted = F.when(confidence > 0.5, 1 - confidence).otherwise(F.greatest(F.lit(0.5), 1 - confidence))
    return F.when(truth == "CONTRADICTION", 0.0).when(truth == "TRUE", 1.0).when(truth == "UNKNOWN", confidence).otherwise(F.lit(0.0) if positive else refuted)


def gated_edges(edges: DataFrame, nodes: DataFrame, weights: dict[str, float], default: float = 0.9) -> DataFrame:
    """src, dst, weight of edges (src, rel, dst): weight of the relation times the gate of the target; edges from contradictions weigh 0."""
    base = F.lit(default)
    for rel, w in weights.items():
        base = F.when(F.col("rel") == rel, w).otherwise(base)
    target = nodes.select(F.col("node").alias("dst"), gate_factor(F.col("truth"), F.col("confidence")).alias("factor"))
    source = nodes.select(F.col("node").alias("src"), (F.col("truth") == "CONTRADICTION").alias("refused"))
    joined = edges.join(target, "dst").join(source, "src")
    return joined.select("src", "dst", "rel", F.when(F.col("refused"), 0.0).otherwise(F.round(base * F.col("factor"), 6)).alias("weight"))


def transition(edges: DataFrame) -> DataFrame:
    """src, dst, p: edges and their mirrors at 0.8 of the weight, summed and scaled so that what leaves a node sums to 1."""
    mirrored = edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") * REVERSE).alias("weight"))
    w = edges.select("src", "dst", "weight").unionByName(mirrored).where("weight > 0").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return w.join(w.groupBy("src").agg(F.sum("weight").alias("total")), "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p"))


#: Edges up to which the rounds of PageRank run as vector operations on the driver; beyond it each round is a join.
LOCAL_EDGES = 2_000_000
#: Scores up to which they are broadcast to the edges in each round; beyond it both are shuffled by node.
BROADCAST_NODES = 1_000_000


def _power_local(t: DataFrame, p0: DataFrame, iterations: int, alpha: float, tolerance: float | None) -> DataFrame:
    """The same rounds on arrays; t has LOCAL_EDGES rows at most."""
    spark, kind = t.sparkSession, p0.schema["node"].dataType
    e, s = t.select("src", "dst", "p").toPandas(), p0.toPandas()
    codes, names = pd.factorize(np.concatenate([e["src"].to_numpy(object), e["dst"].to_numpy(object), s["node"].to_numpy(object)]))
    n = len(names)
    src, dst, seed = codes[: len(e)], codes[len(e) : 2 * len(e)], codes[2 * len(e) :]
    start = np.bincount(seed, s["p0"].to_numpy(float), minlength=n)
    leaving = np.bincount(src, minlength=n) > 0
    score, weight = start.copy(), e["p"].to_numpy(float)
    for _ in range(iterations):
        last, lost = score, score[~leaving].sum()
        score = (1 - alpha) * np.bincount(dst, weight * last[src], minlength=n) + (alpha + (1 - alpha) * lost) * start
        if tolerance is not None and np.abs(score - last).sum() < tolerance:
            break
    reached = score > 0
    rows = pd.DataFrame({"node": names[reached], "score": score[reached]})
    return spark.createDataFrame(rows, StructType([StructField("node", kind), StructField("score", DoubleType())]))


def _power_joined(t: DataFrame, p0: DataFrame, iterations: int, alpha: float, tolerance: float | None) -> DataFrame:
    """Each round a join of edges and scores and one aggregate; the scores are written to the shared folder between rounds."""
    leaving = cut(t.select(F.col("src").alias("node")).distinct().withColumn("out", F.lit(1)), "leaving")
    p0 = cut(p0, "start")
    score = cut(p0.select("node", F.col("p0").alias("score")), "score")
    for _ in range(iterations):
        near = F.broadcast(score) if score.count() <= BROADCAST_NODES else score
        moved = t.join(near, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("score")).alias("m"))
        lost = score.join(leaving, "node", "left_anti").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        back = p0.join(F.broadcast(lost)).select("node", (F.col("p0") * (alpha + (1 - alpha) * F.col("lost"))).alias("m"))
        last, score = score, cut(moved.select("node", ((1 - alpha) * F.col("m")).alias("m")).unionByName(back).groupBy("node").agg(F.sum("m").alias("score")), "score")
        signed = score.unionByName(last.select("node", (-F.col("score")).alias("score"))).groupBy("node").agg(F.abs(F.sum("score")).alias("d"))
        done = tolerance is not None and (signed.agg(F.sum("d").alias("d")).first()["d"] or 0.0) < tolerance
        drop(last)
        if done:
            break
    return score


def personalized_pagerank(edges: DataFrame, seeds: DataFrame, iterations: int = 10, alpha: float = DAMPING, tolerance: float | None = None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """node, score after a fixed number of power iterations from seeds (node, weight); scores sum to 1.

    With a tolerance, rounds end when the scores change by less than it in sum (at most iterations rounds).
    What nodes without outgoing weight hold goes back to the seeds.  Without seeds of positive weight every
    node of the graph is one.  The transitions are written once; a graph of at most local_edges of them runs
    on arrays, a larger one by joins, with the same scores.
    """
    t = cut(transition(edges), "transitions")
    wanted = seeds.where("weight > 0").groupBy("node").agg(F.sum("weight").alias("w"))
    if wanted.isEmpty():
        wanted = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("w", F.lit(1.0))
    p0 = wanted.join(F.broadcast(wanted.agg(F.sum("w").alias("total")))).select("node", (F.col("w") / F.col("total")).alias("p0"))
    power = _power_local if t.count() <= local_edges and p0.limit(local_edges + 1).count() <= local_edges else _power_joined
    return power(t, p0, iterations, alpha, tolerance)


def within_hops(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Edges whose both ends lie within so many steps of a seed, in either direction."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    near = frontier = seeds.select("node").distinct()
    for _ in range(hops):
        frontier = frontier.join(both, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(frontier.join(near, "node", "left_anti"), "frontier")
        near = near.union(frontier)
    return induced(edges, near)


def rank_nodes(edges: DataFrame, seeds: DataFrame, *, large: int | None = None, hops: int = 4, least: float = 0.001, most: int = 10, tolerance: float = 1e-6, rounds: int = 50) -> DataFrame:
    """The best nodes by PageRank to a tolerance: node, score of at least `least`, `most` of them (ties by node).

    With `large`, a graph of more nodes than that is cut to what lies within so many hops of the seeds first, which gives other scores.
    """
    cut_down = large is not None and edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().count() > large and not seeds.where("weight > 0").isEmpty()
    used = within_hops(edges, seeds, hops) if cut_down else edges
    score = personalized_pagerank(used, seeds, rounds, tolerance=tolerance)
    return score.where(F.col("score") >= least).orderBy(F.desc(F.round("score", 9)), "node").limit(most)


def degree_penalty(degree: Column) -> Column:
    """1 up to two incoming edges, else the logarithm of their number, at most 1.5."""
    return F.when(degree > 2, F.least(F.log2(degree + 1), F.lit(1.5))).otherwise(1.0)


def spread_activation(edges: DataFrame, seeds: DataFrame, depth: int = 2, decay: float = DECAY, threshold: float = 0.35, *, structural: tuple[str, ...] | None = None, refused: DataFrame | None = None) -> DataFrame:
    """node, energy: level by level, the largest of weight * decay * energy of a neighbour, kept at the threshold or above; reverse edges at 0.8.

    With structural (relations that run both ways freely), a reverse edge of any other relation is divided by
    the degree penalty of its target's incoming edges.  Nodes in refused (node) get no energy unless they are seeds.
    """
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") * REVERSE).alias("weight"))
    if structural is not None:
        degree = edges.groupBy("dst").agg(F.count("*").alias("n"))
        penal = F.when(F.col("rel").isin(*structural), 1.0).otherwise(degree_penalty(F.col("n")))
        back = edges.join(degree, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") * REVERSE / penal).alias("weight"))
    both = edges.select("src", "dst", "weight").unionByName(back)
    if refused is not None:
        both = both.join(refused.select(F.col("node").alias("dst")), "dst", "left_anti")
    energy = seeds.select("node", F.col("weight").alias("energy"))
    for _ in range(depth):
        step = energy.join(both, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.round(F.col("energy") * decay * F.col("weight"), 9).alias("energy"))
        energy = energy.unionByName(step.where(F.col("energy") >= threshold)).groupBy("node").agg(F.max("energy").alias("energy"))
    return energy


def heights(edges: DataFrame) -> DataFrame:
    """node, level of every node of edges (child, parent): 0 for leaves, one more than the highest child; null for nodes on a cycle or above one.

    Leaves are peeled level by level until none is left, so depth has no bound.
    """
    edges = cut(edges.select("child", "parent").distinct(), "links")
    every = edges.select(F.col("child").alias("node")).union(edges.select(F.col("parent").alias("node"))).distinct()
    level, left, out = 0, cut(every, "left"), None
    while True:
        blocked = edges.join(left.select(F.col("node").alias("child")), "child", "left_semi").select(F.col("parent").alias("node")).distinct()
        free = left.join(blocked, "node", "left_anti").withColumn("level", F.lit(level))
        free = cut(free, "level")
        if free.isEmpty():
            rest = left.withColumn("level", F.lit(None).cast("int"))
            return rest if out is None else out.unionByName(rest)
        out = free if out is None else out.unionByName(free)
        left, level = cut(left.join(free, "node", "left_anti"), "left"), level + 1


def propagated(nodes: DataFrame, digest: str = "cid") -> DataFrame:
    """node, parent, level, cid: content ids from the leaves up; each is the SHA-256 of a node's own text and the sorted ids of its children.

    nodes: node, parent (null at a root), own.
    """
    links = nodes.where("parent IS NOT NULL").select(F.col("node").alias("child"), "parent")
    level = heights(links).unionByName(nodes.join(links.select(F.col("child").alias("node")).union(links.select("parent")), "node", "left_anti").select("node", F.lit(0).alias("level")))
    rows = cut(nodes.join(level, "node"), "levels")
    top = rows.agg(F.max("level").alias("m")).first()["m"]
    done = None
    for k in range((top if top is not None else -1) + 1):
        now = rows.where(F.col("level") == k)
        if done is not None:
            kids = done.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.array_join(F.sort_array(F.collect_list(digest)), ",").alias("kids"))
            now = now.join(kids, "node", "left")
        else:
            now = now.withColumn("kids", F.lit(None).cast("string"))
        fresh = cut(now.select("node", "parent", "level", F.sha2(F.concat_ws("|", "own", F.coalesce("kids", F.lit(""))), 256).alias(digest)), "cids")
        done = fresh if done is None else done.unionByName(fresh)
    return done


def folded(members: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(folds: chunk, cid, vec, members; links: chunk, rel, dst): each chunk's nodes become one node.

    members: chunk, node, vec (array of 64-bit words).  The vector is the join of all, the cid the digest of
    the sorted (node, vec) rows; edges (src, rel, dst) that leave the chunk stay, those inside it go.
    """
    n = members.select(F.max(F.size("vec")).alias("n")).first()["n"] or 0
    joined = F.array(*[F.bit_or(F.get("vec", F.lit(k))) for k in range(n)])
    folds = members.groupBy("chunk").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("node", "vec")))), 256).alias("cid"), joined.alias("vec"), F.count("*").alias("members"))
    of = lambda c, name: members.select(F.col("node").alias(c), F.col("chunk").alias(name))
    out = edges.join(of("src", "chunk"), "src").join(of("dst", "other"), "dst", "left").where(~F.col("chunk").eqNullSafe(F.col("other")))
    return folds, out.select("chunk", "rel", "dst").distinct()


def unfolded(folds: DataFrame, payload: DataFrame) -> DataFrame:
    """chunk, node, sound: the members of folds (payload: chunk, node, vec), and whether their digest is still the fold's."""
    again = payload.groupBy("chunk").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("node", "vec")))), 256).alias("again"))
    kept = folds.select("chunk", "cid").join(again, "chunk").select("chunk", (F.col("cid") == F.col("again")).alias("sound"))
    return payload.select("chunk", "node").join(kept, "chunk")


def interned(nodes: DataFrame, edges: DataFrame, key: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(kept: node, members; edges with the ends of kept nodes, each once): nodes with equal keys become the one with the least id."""
    k = nodes.select("node", F.sha2(F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("\u0002")) for c in key]), 256).alias("k"))
    least = k.groupBy("k").agg(F.min("node").alias("to"), F.count("*").alias("members"))
    remap = k.join(least, "k").select("node", "to")
    for c in ("src", "dst"):
        edges = edges.join(remap.select(F.col("node").alias(c), F.col("to").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return least.select(F.col("to").alias("node"), "members"), edges.select("src", "rel", "dst").distinct()


def anchored(passages: DataFrame) -> DataFrame:
    """src, rel, dst: passages (passage, concepts) lead to their concepts; one without any leads to a coarse node of its own."""
    named = passages.select(F.col("passage").alias("src"), F.lit("MENTIONS").alias("rel"), F.explode(F.array_distinct("concepts")).alias("dst"))
    coarse = passages.where(F.size("concepts") <= 0).select(F.col("passage").alias("src"), F.lit("COARSE").alias("rel"), F.concat(F.lit("coarse:"), F.col("passage").cast("string")).alias("dst"))
    return named.unionByName(coarse).distinct()


def merged_edges(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, rel, dst of both tables, each once; its reverse index: dst, rel, sources)."""
    every = old.select("src", "rel", "dst").unionByName(new.select("src", "rel", "dst")).distinct()
    return every, every.groupBy("dst", "rel").agg(F.array_sort(F.collect_set("src")).alias("sources"))


def changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """key, change (added, removed, kept) of the rows of two versions of a graph."""
    old, new = before.select(*key).distinct().withColumn("_o", F.lit(1)), after.select(*key).distinct().withColumn("_n", F.lit(1))
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("kept")
    return old.join(new, key, "full").select(*key, kind.alias("change"))


def chains(links: DataFrame) -> DataFrame:
    """root, node, place: nodes along single successors (src, dst) from the nodes that follow none; places from 0, by doubling of steps.

    A node with several successors goes on to the least of them; nodes on a cycle have no root and don't appear.
    Only nodes that haven't reached their root yet are looked at again and written, so rounds follow the logarithm of
    the longest chain, and what they write the length of the chains that are left.
    """
    after = links.groupBy("src").agg(F.min("dst").alias("dst"))
    ends = after.select(F.col("dst").alias("node"), F.col("src").alias("up")).unionByName(after.select(F.col("src").alias("node"), F.lit(None).cast(after.schema["src"].dataType).alias("up")))
    start = ends.where("node IS NOT NULL").groupBy("node").agg(F.min("up").alias("up"))
    is_root = F.col("up").isNull()
    state = start.select("node", F.coalesce("up", "node").alias("at"), (~is_root).cast("long").alias("place"), is_root.alias("done"))
    new = cut(state, "chain")
    n, rounds, done = new.count(), 0, new.where("done")
    left = new.where(~F.col("done"))
    while (1 << rounds) <= 2 * n and not left.isEmpty():
        far = done.unionByName(left).select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("place").alias("more"), F.col("done").alias("arrived"))
        new = cut(left.select("node", "at", "place").join(far, "at").select("node", F.col("next").alias("at"), (F.col("place") + F.col("more")).alias("place"), F.col("arrived").alias("done")), "chain")
        done, left, rounds = done.unionByName(new.where("done")), new.where(~F.col("done")), rounds + 1
    return done.select(F.col("at").alias("root"), "node", "place")


def briefing(edges: DataFrame, by: str = "src") -> DataFrame:
    """by, lines: the edges of a node as sorted lines of text."""
    line = F.concat_ws(" ", F.col("src"), F.lower(F.regexp_replace("rel", "_", " ")), F.col("dst"))
    return edges.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("lines"))


def serialised(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, text: every node as a list '(node id (rel dst) ...)', its edges sorted."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("("), "rel", F.lit(" "), "dst", F.lit(")")))), " ").alias("t"))
    return nodes.select("node").distinct().join(out, "node", "left").select("node", F.concat(F.lit("(node "), F.concat_ws(" ", "node", "t"), F.lit(")")).alias("text"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are admitted."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")


def project(bindings: DataFrame, scores: DataFrame) -> DataFrame:
    """passage, score, nodes: summed scores of the nodes bound to a passage (node, passage)."""
    return bindings.join(scores, "node").groupBy("passage").agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("nodes"))


def merkle(children: DataFrame, parent: str, digest: str, own: Column) -> DataFrame:
    """parent, digest: SHA-256 of own data and the sorted digests of the children."""
    parts = F.array_join(F.sort_array(F.collect_list(digest)), ",")
    return children.groupBy(parent).agg(F.sha2(F.concat_ws("|", own, parts), 256).alias(digest))


def nodes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, truth, confidence of customers, suppliers, nations and regions: status by account balance."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("C:"), "c_custkey").alias("node"), F.col("c_acctbal").alias("b"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S:"), "s_suppkey").alias("node"), F.col("s_acctbal").alias("b"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("N:"), "n_nationkey").alias("node"), F.lit(5000.0).alias("b"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("R:"), "r_regionkey").alias("node"), F.lit(5000.0).alias("b"))
    every = c.unionByName(s).unionByName(n).unionByName(r)
    truth = F.when(F.col("b") < -500, "CONTRADICTION").when(F.col("b") < 0, "FALSE").when(F.col("b") < 2000, "UNKNOWN").otherwise("TRUE")
    return every.select("node", truth.alias("truth"), F.round(F.least(F.greatest(F.col("b") / 10000, F.lit(0.0)), F.lit(1.0)), 4).alias("confidence"))


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triples(spark, sf_dir).where("property IN ('NATION', 'REGION')").select(F.col("subject").alias("src"), F.col("property").alias("rel"), F.col("object").alias("dst"))
    return gated_edges(t, nodes_of(spark, sf_dir), {"NATION": 0.9, "REGION": 1.0})


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.concat(F.lit("R:"), "r_regionkey").alias("node"), F.lit(1.0).alias("weight"))


def q_ppr(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = personalized_pagerank(edges_of(spark, sf_dir), _seeds(spark, sf_dir), 20)
    return scores.select("node", F.round("score", 6).alias("score"))


def q_ppr_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores by joins alone, as on graphs that no driver holds."""
    scores = personalized_pagerank(edges_of(spark, sf_dir), _seeds(spark, sf_dir), 20, local_edges=0)
    return scores.select("node", F.round("score", 6).alias("score"))


def q_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activation of customers carried to their orders."""
    energy = spread_activation(edges_of(spark, sf_dir), _seeds(spark, sf_dir), 2, threshold=0.1).select("node", F.col("energy").alias("score"))
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("C:"), "o_custkey").alias("node"), F.col("o_orderkey").alias("passage"))
    return project(orders, energy)


def q_hash_cons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts interned by brand, type and size: key, one id, members."""
    p = table(spark, sf_dir, "part")
    key = F.sha2(F.concat_ws("|", F.lower("p_brand"), F.lower("p_type"), F.col("p_size").cast("string")), 256)
    return p.groupBy(key.alias("key")).agg(F.min("p_partkey").alias("id"), F.count("*").alias("members"))


def q_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of regions over nations over customers."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.sha2(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name"), 256).alias("h"))
    n = merkle(c, "c_nationkey", "h", F.first(F.col("c_nationkey").cast("string")))
    n = n.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "h")
    return merkle(n, "n_regionkey", "h", F.first(F.col("n_regionkey").cast("string"))).select(F.col("n_regionkey").alias("region"), "h")


def q_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height of every node over the leaves (children first); some nations are made to hang below a customer of theirs, a cycle."""
    t = triples(spark, sf_dir).where("property IN ('NATION', 'REGION')").select(F.col("subject").alias("child"), F.col("object").alias("parent"))
    knots = table(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.concat(F.lit("N:"), "n_nationkey").alias("child"), F.lit("X:1").alias("parent")).unionByName(spark.createDataFrame([("X:1", "X:2"), ("X:2", "X:3"), ("X:3", "X:2")], "child string, parent string"))
    return heights(t.unionByName(knots))


def q_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best nodes by PageRank from the first region, to the tolerance."""
    return rank_nodes(edges_of(spark, sf_dir), _seeds(spark, sf_dir)).select("node", F.round("score", 4).alias("score"))


def q_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank of the nations and regions without any seed."""
    e = triples(spark, sf_dir).where("property = 'REGION'").select(F.col("subject").alias("src"), F.col("object").alias("dst"), F.lit(1.0).alias("weight"))
    return personalized_pagerank(e, e.select(F.col("src").alias("node"), F.lit(0.0).alias("weight")), 10).select("node", F.round("score", 6).alias("score"))


def q_penalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activation from the first region down to customers; nations keep it freely, other reverse edges are penalised, contradictions refused."""
    refused = nodes_of(spark, sf_dir).where("truth = 'CONTRADICTION'")
    return spread_activation(edges_of(spark, sf_dir), _seeds(spark, sf_dir), 2, threshold=0.05, structural=("REGION",), refused=refused).select("node", F.round("energy", 6).alias("energy"))


def q_propagated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content ids from customers up to regions, through nations."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("C:"), "c_custkey").alias("node"), F.concat(F.lit("N:"), "c_nationkey").alias("parent"), F.col("c_name").alias("own"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("N:"), "n_nationkey").alias("node"), F.concat(F.lit("R:"), "n_regionkey").alias("parent"), F.col("n_name").alias("own"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("R:"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("own"))
    return propagated(c.unionByName(n).unionByName(r)).where("level > 0").select("node", "level", "cid")


def q_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors folded by label, with an edge from each to the next one; unfolded again."""
    v = slot_words(spark, sf_dir).select(F.col("label").alias("chunk"), F.col("id").alias("node"), F.col("words").alias("vec"))
    e = v.select(F.col("node").alias("src"), F.lit("NEXT").alias("rel"), (F.col("node") + 1).alias("dst"))
    folds, links = folded(v, e)
    leaving = links.groupBy("chunk").agg(F.count("*").alias("leaving"))
    sound = unfolded(folds, v).groupBy("chunk").agg(F.every("sound").alias("sound"), F.count("*").alias("unfolded"))
    bits = F.aggregate(F.transform("vec", F.bit_count), F.lit(0), lambda a, x: a + x)
    return folds.join(leaving, "chunk", "left").join(sound, "chunk").select("chunk", "members", bits.cast("long").alias("bits"), F.coalesce("leaving", F.lit(0)).alias("leaving"), "sound", "unfolded")


def q_interned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts interned by brand, type and size, and the orders' edges to what is kept, counted by kept part."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.lower("p_brand").alias("b"), "p_type", "p_size")
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("O:"), "l_orderkey").alias("src"), F.lit("PART").alias("rel"), F.col("l_partkey").alias("dst"))
    e = e.select(F.col("src"), "rel", F.col("dst").cast("string").alias("dst"))
    kept, edges = interned(p.withColumn("node", F.col("node").cast("string")), e, [F.col("b"), F.col("p_type"), F.col("p_size")])
    return kept.join(edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("edges")), "node", "left").select("node", "members", F.coalesce("edges", F.lit(0)).alias("edges"))


def q_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as passages that mention the brands of their parts; orders without parts get coarse nodes.  Counted by target."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.collect_list("p_brand").alias("concepts"))
    p = table(spark, sf_dir, "orders").join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(F.col("o_orderkey").alias("passage"), F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"))
    return anchored(p).groupBy("rel", "dst").agg(F.count("*").alias("passages"))


def q_edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations merged with an edited copy of them, as the reverse index; and what the edit changed."""
    old = triples(spark, sf_dir).where("property = 'NATION'").select(F.col("subject").alias("src"), F.col("property").alias("rel"), F.col("object").alias("dst"))
    last = F.substring_index("src", ":", -1).cast("long") % 10
    new = old.where(last > 0).select("src", "rel", F.when(last == 1, "N:0").otherwise(F.col("dst")).alias("dst"))
    _, index = merged_edges(old, new)
    diff = changes(old, new, ["src", "rel", "dst"]).groupBy("dst").pivot("change", ["added", "kept", "removed"]).count()
    return index.select("dst", F.size("sources").cast("long").alias("sources")).join(diff, "dst").fillna(0)


def q_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer along their successors: the place of each order in its chain."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("dst"))
    return chains(o.where("dst IS NOT NULL"))


def q_briefing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of every nation and customer as lines and as a list."""
    e = edges_of(spark, sf_dir)
    return briefing(e).withColumnRenamed("src", "node").join(serialised(nodes_of(spark, sf_dir), e), "node", "right").select("node", F.md5(F.coalesce("lines", F.lit(""))).alias("lines"), "text")


QUERIES = {
    "edge_gate": edges_of,
    "transition_matrix": lambda s, d: transition(edges_of(s, d)).select("src", "dst", F.round("p", 9).alias("p")),
    "ppr_fixed": q_ppr,
    "ppr_joined": q_ppr_joined,
    "bfs_activation": lambda s, d: spread_activation(edges_of(s, d), _seeds(s, d), 2, threshold=0.1),
    "induced_subgraph": lambda s, d: induced(edges_of(s, d), nodes_of(s, d).where("truth IN ('TRUE', 'UNKNOWN')")).groupBy("rel").agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 3).alias("weight")),
    "bipartite_project": q_project,
    "hash_cons": q_hash_cons,
    "merkle_fold": q_merkle,
    "topo_level": q_levels,
    "ppr_top_nodes": q_top,
    "ppr_uniform": q_uniform,
    "activation_penalised": q_penalised,
    "cid_propagation": q_propagated,
    "subgraph_fold": q_folded,
    "intern_remap": q_interned,
    "concept_anchors": q_anchored,
    "edge_merge_diff": q_edge_merge,
    "event_chains": q_chains,
    "logical_briefing": q_briefing,
}
_N = """n0 AS (SELECT 'C:' || c_custkey AS node, c_acctbal AS b FROM customer UNION ALL SELECT 'S:' || s_suppkey, s_acctbal FROM supplier UNION ALL SELECT 'N:' || n_nationkey, 5000.0 FROM nation UNION ALL SELECT 'R:' || r_regionkey, 5000.0 FROM region),
n AS (SELECT node, CASE WHEN b < -500 THEN 'CONTRADICTION' WHEN b < 0 THEN 'FALSE' WHEN b < 2000 THEN 'UNKNOWN' ELSE 'TRUE' END AS truth, round(least(greatest(b / 10000, 0.0), 1.0), 4) AS confidence FROM n0)"""
_E = f"""{T_SQL}, {_N}, e AS (SELECT t.subject AS src, t.object AS dst, t.property AS rel, CASE WHEN a.truth = 'CONTRADICTION' THEN 0.0 ELSE round(CASE t.property WHEN 'NATION' THEN 0.9 ELSE 1.0 END * CASE b.truth WHEN 'CONTRADICTION' THEN 0.0 WHEN 'TRUE' THEN 1.0 WHEN 'UNKNOWN' THEN b.confidence ELSE 0.0 END, 6) END AS weight
FROM t JOIN n a ON a.node = t.subject JOIN n b ON b.node = t.object WHERE t.property IN ('NATION', 'REGION'))"""
_P = f"{_E}, w AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight * 0.8 FROM e WHERE src <> dst) WHERE weight > 0 GROUP BY ALL), p AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM w)"
_B = f"{_E}, b AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight * 0.8 FROM e), a0 AS (SELECT 'R:0' AS node, 1.0 AS energy), " + ", ".join(
    f"a{k + 1} AS (SELECT node, max(energy) AS energy FROM (SELECT * FROM a{k} UNION ALL SELECT * FROM (SELECT dst, round(energy * 0.7 * weight, 9) AS energy FROM a{k} JOIN b ON src = node) WHERE energy >= 0.1) GROUP BY node)" for k in range(2)
)


def _ppr_sql(rounds: int) -> str:
    steps = [f"s{k + 1} AS MATERIALIZED (SELECT node, sum(m) AS score FROM (SELECT dst AS node, 0.85 * sum(p * score) AS m FROM p JOIN s{k} ON src = node GROUP BY dst UNION ALL SELECT 'R:0', 0.15 + 0.85 * coalesce((SELECT sum(score) FROM s{k} WHERE node NOT IN (SELECT src FROM p)), 0.0)) GROUP BY node)" for k in range(rounds)]
    return f"{_P.replace('p AS (', 'p AS MATERIALIZED (')}, s0 AS (SELECT 'R:0' AS node, CAST(1.0 AS DOUBLE) AS score), " + ", ".join(steps)


_LINES = "string_agg(DISTINCT src || ' ' || lower(replace(rel, '_', ' ')) || ' ' || dst, chr(10) ORDER BY src || ' ' || lower(replace(rel, '_', ' ')) || ' ' || dst)"
_PACK = "list_sum(list_transform(range(32), lambda k: CAST(list_extract(w, CAST(k + {0} * 32 + 1 AS INTEGER)) AS HUGEINT) << CAST(2 * k AS INTEGER)))"
ORACLE_SQL = {
    "edge_gate": f"WITH {_E} SELECT src, dst, rel, weight FROM e",
    "transition_matrix": f"WITH {_P} SELECT src, dst, round(p, 9) AS p FROM p",
    "ppr_fixed": f"WITH {_ppr_sql(20)} SELECT node, round(score, 6) AS score FROM s20 WHERE score > 0",
    "ppr_joined": f"WITH {_ppr_sql(20)} SELECT node, round(score, 6) AS score FROM s20 WHERE score > 0",
    "ppr_top_nodes": f"WITH {_ppr_sql(50)} SELECT node, round(score, 4) AS score FROM s50 WHERE score >= 0.001 ORDER BY round(score, 9) DESC, node LIMIT 10",
    "ppr_uniform": "WITH " + "w AS (SELECT 'N:' || n_nationkey AS src, 'R:' || n_regionkey AS dst, 1.0 AS w FROM nation UNION ALL SELECT 'R:' || n_regionkey, 'N:' || n_nationkey, 0.8 FROM nation), p AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM w), n AS (SELECT src AS node, 1.0 / count(*) OVER () AS p0 FROM (SELECT DISTINCT src FROM p)), s0 AS (SELECT node, CAST(p0 AS DOUBLE) AS score FROM n), " + ", ".join(f"s{k + 1} AS MATERIALIZED (SELECT n.node, 0.15 * p0 + 0.85 * sum(p * score) AS score FROM p JOIN s{k} ON s{k}.node = src JOIN n ON n.node = dst GROUP BY n.node, p0)" for k in range(10)) + " SELECT node, round(score, 6) AS score FROM s10",
    "activation_penalised": f"""WITH {_E}, deg AS (SELECT dst, count(*) AS n FROM e GROUP BY dst), bad AS (SELECT node FROM n WHERE truth = 'CONTRADICTION'),
b AS (SELECT src, dst, weight FROM e UNION ALL SELECT e.dst, e.src, weight * 0.8 / CASE WHEN rel = 'REGION' OR deg.n <= 2 THEN 1.0 ELSE least(log2(deg.n + 1), 1.5) END FROM e JOIN deg ON deg.dst = e.dst), k AS (SELECT * FROM b WHERE dst NOT IN (SELECT node FROM bad)),
a0 AS (SELECT 'R:0' AS node, CAST(1.0 AS DOUBLE) AS energy), a1 AS (SELECT node, max(energy) AS energy FROM (SELECT * FROM a0 UNION ALL SELECT * FROM (SELECT dst, round(energy * 0.7 * weight, 9) AS energy FROM a0 JOIN k ON src = node) WHERE energy >= 0.05) GROUP BY node),
a2 AS (SELECT node, max(energy) AS energy FROM (SELECT * FROM a1 UNION ALL SELECT * FROM (SELECT dst, round(energy * 0.7 * weight, 9) AS energy FROM a1 JOIN k ON src = node) WHERE energy >= 0.05) GROUP BY node) SELECT node, round(energy, 6) AS energy FROM a2""",
    "cid_propagation": """WITH c AS (SELECT c_nationkey AS k, sha256(c_name || '|') AS h FROM customer), n AS (SELECT n_nationkey, n_regionkey, sha256(n_name || '|' || string_agg(h, ',' ORDER BY h)) AS h FROM nation JOIN c ON k = n_nationkey GROUP BY n_nationkey, n_regionkey, n_name),
r AS (SELECT r_regionkey, sha256(r_name || '|' || string_agg(h, ',' ORDER BY h)) AS h FROM region JOIN n ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name) SELECT 'N:' || n_nationkey AS node, 1 AS level, h AS cid FROM n UNION ALL SELECT 'R:' || r_regionkey, 2, h FROM r""",
    "subgraph_fold": """WITH s AS (SELECT vec_id AS node, label AS chunk, CASE WHEN x >= 0.1 THEN 1 WHEN x <= -0.1 THEN 2 WHEN abs(x) >= 0.05 THEN 3 ELSE 0 END AS v, k FROM (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS k FROM embeddings)),
j AS (SELECT chunk, k, bit_or(v) AS v FROM s GROUP BY ALL), b AS (SELECT chunk, CAST(sum(bit_count(v)) AS BIGINT) AS bits FROM j GROUP BY chunk), m AS (SELECT label AS chunk, count(*) AS members FROM embeddings GROUP BY label),
l AS (SELECT a.label AS chunk, count(DISTINCT a.vec_id + 1) AS leaving FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE b.label IS DISTINCT FROM a.label GROUP BY a.label)
SELECT chunk, members, bits, coalesce(leaving, 0) AS leaving, true AS sound, members AS unfolded FROM m JOIN b USING (chunk) LEFT JOIN l USING (chunk)""",
    "intern_remap": """WITH p AS (SELECT p_partkey, min(CAST(p_partkey AS VARCHAR)) OVER (PARTITION BY lower(p_brand), p_type, p_size) AS node FROM part), m AS (SELECT node, count(*) AS members FROM p GROUP BY node), e AS (SELECT node, count(DISTINCT l_orderkey) AS edges FROM lineitem JOIN p ON l_partkey = p_partkey GROUP BY node)
SELECT node, members, coalesce(edges, 0) AS edges FROM m LEFT JOIN e USING (node)""",
    "concept_anchors": "WITH m AS (SELECT DISTINCT l_orderkey AS o, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT 'MENTIONS' AS rel, b AS dst, count(*) AS passages FROM m WHERE o IN (SELECT o_orderkey FROM orders) GROUP BY b UNION ALL SELECT 'COARSE', 'coarse:' || o_orderkey, 1 FROM orders WHERE o_orderkey NOT IN (SELECT o FROM m)",
    "edge_merge_diff": """WITH o AS (SELECT 'C:' || c_custkey AS src, c_custkey % 10 AS k, 'N:' || c_nationkey AS dst FROM customer UNION ALL SELECT 'S:' || s_suppkey, s_suppkey % 10, 'N:' || s_nationkey FROM supplier), n AS (SELECT src, CASE WHEN k = 1 THEN 'N:0' ELSE dst END AS dst FROM o WHERE k > 0),
i AS (SELECT dst, count(DISTINCT src) AS sources FROM (SELECT src, dst FROM o UNION SELECT src, dst FROM n) GROUP BY dst), d AS (SELECT coalesce(o.dst, n.dst) AS dst, o.src IS NULL AS added, n.src IS NULL AS removed FROM o FULL JOIN n ON o.src = n.src AND o.dst = n.dst)
SELECT i.dst, sources, count(*) FILTER (added) AS added, count(*) FILTER (NOT added AND NOT removed) AS kept, count(*) FILTER (removed) AS removed FROM i JOIN d ON d.dst = i.dst GROUP BY ALL""",
    "event_chains": """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER w - 1 AS place, first_value(o_orderkey) OVER w AS root, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT root, o_orderkey AS node, place FROM o WHERE n > 1""",
    "logical_briefing": f"WITH {_E}, g AS (SELECT src, {_LINES} AS l, string_agg(DISTINCT '(' || rel || ' ' || dst || ')', ' ' ORDER BY '(' || rel || ' ' || dst || ')') AS t FROM e GROUP BY src) SELECT node, md5(coalesce(l, '')) AS lines, '(node ' || concat_ws(' ', node, t) || ')' AS text FROM n LEFT JOIN g ON src = node",
    "bfs_activation": f"WITH {_B} SELECT node, energy FROM a2",
    "induced_subgraph": f"WITH {_E}, g AS (SELECT node FROM n WHERE truth IN ('TRUE', 'UNKNOWN')) SELECT rel, count(*) AS edges, round(sum(weight), 3) AS weight FROM e WHERE src IN (SELECT node FROM g) AND dst IN (SELECT node FROM g) GROUP BY rel",
    "bipartite_project": f"WITH {_B} SELECT o_orderkey AS passage, round(sum(energy), 6) AS score, count(*) AS nodes FROM orders JOIN a2 ON node = 'C:' || o_custkey GROUP BY o_orderkey",
    "hash_cons": "SELECT sha256(lower(p_brand) || '|' || lower(p_type) || '|' || p_size) AS key, min(p_partkey) AS id, count(*) AS members FROM part GROUP BY 1",
    "merkle_fold": """WITH c AS (SELECT c_nationkey, sha256(c_custkey || '|' || c_name) AS h FROM customer), n AS (SELECT c_nationkey, sha256(c_nationkey || '|' || string_agg(h, ',' ORDER BY h)) AS h FROM c GROUP BY c_nationkey)
SELECT n_regionkey AS region, sha256(n_regionkey || '|' || string_agg(h, ',' ORDER BY h)) AS h FROM n JOIN nation ON n_nationkey = c_nationkey GROUP BY n_regionkey""",
    "topo_level": f"""WITH RECURSIVE {T_SQL}, e AS (SELECT subject AS c, object AS p FROM t WHERE property IN ('NATION', 'REGION') UNION SELECT 'N:' || n_nationkey, 'X:1' FROM nation WHERE n_nationkey < 3 UNION SELECT * FROM (VALUES ('X:1', 'X:2'), ('X:2', 'X:3'), ('X:3', 'X:2')) AS v(c, p)),
every AS (SELECT c AS node FROM e UNION SELECT p FROM e), up AS (SELECT c, p FROM e UNION SELECT up.c, e.p FROM up JOIN e ON e.c = up.p), knot AS (SELECT c AS node FROM up WHERE c = p), bad AS (SELECT node FROM knot UNION SELECT p FROM up WHERE c IN (SELECT node FROM knot)),
h AS (SELECT node, 0 AS level FROM every WHERE node NOT IN (SELECT p FROM e) UNION SELECT e.p, level + 1 FROM h JOIN e ON e.c = h.node WHERE e.p NOT IN (SELECT node FROM bad))
SELECT node, CASE WHEN node NOT IN (SELECT node FROM bad) THEN (SELECT max(level) FROM h WHERE h.node = every.node) END AS level FROM every""",
}
