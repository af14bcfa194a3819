"""Node rows and slot vectors: filters, quantised confidences, partial orders, pairwise lattices, decoding, diagnoses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.quaternary import BAND, _next_pairs, band, entropy, fidelity, pairwise_information
from graphloom.operators.retrieval import best_queries
from graphloom.sources.tables import slots, table


def quantised(confidence: Column) -> Column:
    """A confidence as one of 256 steps."""
    return F.round(F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")


def dequantised(step: Column) -> Column:
    return step / 255.0


def select_nodes(nodes: DataFrame, *, passages: list | None = None, truths: list[str] | None = None, least: float | None = None) -> DataFrame:
    """nodes (passage, truth, confidence) of given passages and truths whose confidence reaches least, compared in steps as it is stored."""
    if passages is not None:
        nodes = nodes.where(F.col("passage").isin(passages))
    if truths is not None:
        nodes = nodes.where(F.col("truth").isin(truths))
    return nodes if least is None else nodes.where(quantised(F.col("confidence")) >= quantised(F.lit(least)))


def knows_less(a: Column, b: Column) -> Column:
    """Order of knowledge of slot values: 0 is below all, 3 above all, 1 and 2 are beside each other."""
    return (a == b) | (a == 0) | (b == 3)


def truth_below(a: Column, b: Column) -> Column:
    """Order of truth of slot values: 2 (false) is below all, 1 (true) above all, 0 and 3 are beside each other."""
    return (a == b) | (a == 2) | (b == 1)


def _padded(a: Column, b: Column, f) -> Column:
    """Element by element, the shorter one padded with 0."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.zip_with(a, b, lambda x, y: f(zero(x), zero(y)))


def vector_join(a: Column, b: Column) -> Column:
    """Join of two slot arrays: bitwise or, the maximum in the ordered bands."""
    both = F.arrays_zip(_padded(a, b, lambda x, y: x.bitwiseOR(y)).alias("o"), _padded(a, b, F.greatest).alias("m"))
    return F.transform(both, lambda p, k: F.when(F.floor(k / BAND).isin(1, 2), p["m"]).otherwise(p["o"]))


def vector_meet(a: Column, b: Column) -> Column:
    """Meet of two slot arrays: bitwise and, the minimum in the ordered bands."""
    both = F.arrays_zip(_padded(a, b, lambda x, y: x.bitwiseAND(y)).alias("o"), _padded(a, b, F.least).alias("m"))
    return F.transform(both, lambda p, k: F.when(F.floor(k / BAND).isin(1, 2), p["m"]).otherwise(p["o"]))


def vector_distance(a: Column, b: Column) -> Column:
    """Slots that differ, plus the difference in length."""
    n = F.least(F.size(a), F.size(b))
    differ = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x != y).cast("int"))
    return F.aggregate(differ, F.lit(0), lambda s, x: s + x) + F.abs(F.size(a) - F.size(b))


def label_softmax(rows: DataFrame, group: list[str], logprob: str = "logprob", temperature: float = 1.0, floor: float = -12.0) -> DataFrame:
    """group, label, p: probabilities of labels from the best log-probability of each (rows: group, label, logprob); nothing is below the floor."""
    best = rows.groupBy(*group, "label").agg(F.greatest(F.max(logprob), F.lit(floor)).alias("x"))
    top = best.groupBy(*group).agg(F.max("x").alias("top"))
    e = best.join(top, group).withColumn("e", F.exp((F.col("x") - F.col("top")) / temperature))
    return e.join(e.groupBy(*group).agg(F.sum("e").alias("s")), group).select(*group, "label", F.round(F.col("e") / F.col("s"), 6).alias("p"))


#: What it costs to read one slot value as another (rows: asked, columns: known), from 0 to 3.
COST = ((0.0, 0.5, 0.5, 0.25), (0.5, 0.0, 1.0, 0.25), (0.5, 1.0, 0.0, 0.25), (0.25, 0.25, 0.25, 0.0))


def decoded(asked: DataFrame, concepts: DataFrame, accept: float = 0.15) -> DataFrame:
    """id, concept, distance: the concept (concept, slot, v) that costs least, averaged over the slots, if it costs at most `accept`; ties by concept.

    asked: id, slot, v; both tables have the same slots.  They are grouped into arrays; tasks cost a batch of rows against a
    block of concepts with one matrix product.
    """
    dense = lambda df, key: df.groupBy(F.col(key).cast("long").alias(key)).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "v"))), lambda s: s["v"].cast("int")).alias("v"))

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        coded = lambda m: np.concatenate([m == x for x in range(4)], axis=1).astype(np.float32)
        costs = np.concatenate([np.array(COST, np.float32)[x][b] for x in range(4)], axis=1)
        return -(coded(a) @ costs.T) / a.shape[1]

    best = best_queries(dense(asked, "id"), dense(concepts, "concept").withColumnRenamed("concept", "query_id"), 1, near, key="id", itself=True)
    distance = F.round(-F.col("score"), 6)
    return best.select("id", F.when(distance <= accept, F.col("query_id")).alias("concept"), distance.alias("distance"))


def projected(s: DataFrame, keep: int, named: dict[int, int]) -> DataFrame:
    """id, slot, v: the first `keep` slots as they are, then named ones (slot -> new slot)."""
    to = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    return s.where(F.col("slot") < keep).select("id", "slot", "v").unionByName(s.where(F.col("slot").isin(*named)).select("id", to[F.col("slot")].alias("slot"), "v"))


#: Weights of the bands in a slot's necessity.
BAND_WEIGHTS = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)


def necessity(s: DataFrame) -> DataFrame:
    """slot, necessity: how often a slot is active, doubled and weighed by its band, 1 at most."""
    weights = F.array(*[F.lit(w) for w in BAND_WEIGHTS])
    g = s.groupBy("slot").agg(F.avg((F.col("v") != 0).cast("double")).alias("f"))
    return g.select("slot", F.round(F.least(F.lit(1.0), F.col("f") * 2 * F.get(weights, band(F.col("slot")))), 6).alias("necessity"))


def dead_slots(pairs: DataFrame, gold: int = 5, recall: float = 0.3) -> DataFrame:
    """slot, support, recall, dead: a slot that is gold often enough and found too seldom."""
    f = fidelity(pairs)
    return f.select("slot", (F.col("tp") + F.col("fn")).alias("support"), "recall", ((F.col("tp") + F.col("fn") >= gold) & (F.col("recall") < recall)).alias("dead"))


def diagnosis(s: DataFrame, low: float = 0.05, high: float = 0.9) -> DataFrame:
    """slot, h, verdict: dead slots (entropy below low), those that another slot of a lower number makes redundant (information of at least `high` of their entropy), and sound ones."""
    h = entropy(s.groupBy("slot", "v").agg(F.count("*").alias("n")), ["slot"])
    shared = pairwise_information(s).groupBy(F.col("j").alias("slot")).agg(F.max("mi").alias("mi"))
    verdict = F.when(F.col("h") < low, "dead").when(F.coalesce("mi", F.lit(0.0)) >= high * F.col("h"), "redundant").otherwise("sound")
    return h.join(shared, "slot", "left").select("slot", "h", verdict.alias("verdict"))


def valid_share(rows: DataFrame, valid: str, similarity: str, group: list[str]) -> DataFrame:
    """group, soundness, consistency: the share of rows that hold and the mean similarity after a round trip."""
    return rows.groupBy(*group).agg(F.round(F.avg(F.col(valid).cast("double")), 6).alias("soundness"), F.round(F.avg(similarity), 6).alias("consistency"))


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.sources.tables import quaternary

    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: quaternary(x.cast("double"))).alias("w"))


def q_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as nodes of their nation's passage: those of six passages, not contradictory, of confidence .2 or more."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("passage"), F.when(F.col("c_acctbal") < 0, "CONTRADICTION").otherwise("TRUE").alias("truth"), (F.col("c_acctbal") / 10000).alias("confidence"))
    kept = select_nodes(c, passages=[0, 1, 2, 5, 7, 11], truths=["TRUE", "UNKNOWN"], least=0.2)
    return kept.select("node", quantised(F.col("confidence")).alias("step"), F.round(dequantised(quantised(F.col("confidence"))), 6).alias("stored"))


def q_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each vector's slots stand to those of the next one in both orders."""
    p = _next_pairs(spark, sf_dir)
    n = lambda c: F.sum(c.cast("long"))
    return p.groupBy("id").agg(n(knows_less(F.col("a"), F.col("b"))).alias("less_known"), n(truth_below(F.col("a"), F.col("b"))).alias("less_true"))


def q_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the next one, cut to 60 slots: join, meet and distance."""
    a = _arrays(spark, sf_dir)
    b = a.select((F.col("id") - 1).alias("id"), F.slice("w", 1, 60).alias("u"))
    text = lambda c: F.md5(F.array_join(c, ""))
    return a.join(b, "id").select("id", text(vector_join(F.col("w"), F.col("u"))).alias("joined"), text(vector_meet(F.col("w"), F.col("u"))).alias("met"), vector_distance(F.col("w"), F.col("u")).alias("distance"))


def q_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of each user by a score that stands for their log-probability."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("label"), (-F.col("value") / 4).alias("logprob"))
    return label_softmax(e, ["user_id"], temperature=2.0)


def q_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector read as one of the concepts, the vectors whose id is divisible by 50."""
    s = slots(spark, sf_dir)
    return decoded(s.select("id", "slot", "v"), s.where("id % 50 = 0").select(F.col("id").alias("concept"), "slot", "v"), accept=0.33)


def q_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots 0 to 7, and slots 20 and 40 as 8 and 9, summed."""
    return projected(slots(spark, sf_dir), 8, {20: 8, 40: 9}).groupBy("slot").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def q_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Necessity, support and verdict of every slot; slot 63 is made a copy of slot 0 and slot 62 empty."""
    s = slots(spark, sf_dir)
    made = s.where("slot < 62").unionByName(s.where("slot = 0").withColumn("slot", F.lit(63))).unionByName(s.where("slot = 62").withColumn("v", F.lit(0)))
    return necessity(made).join(dead_slots(_next_pairs(spark, sf_dir), recall=0.35), "slot").join(diagnosis(made), "slot")


def q_soundness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by label: the share whose next one contradicts them in at most 12 slots, and their mean similarity."""
    from graphloom.operators.quaternary import audit

    a = audit(_next_pairs(spark, sf_dir)).withColumn("valid", F.col("contradictions") <= 12)
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return valid_share(a.join(labels, "id"), "valid", "rate", ["label"])


QUERIES = {
    "node_filter": q_selected, "slot_orders": q_orders, "vector_lattice": q_pairwise, "label_softmax": q_softmax, "concept_decode": q_decoded, "candidate_projection": q_projected, "slot_health": q_health, "symbolic_soundness": q_soundness,
}
_S = "s AS (SELECT id, label, CAST(slot AS INTEGER) AS slot, CASE WHEN x >= 0.1 THEN 1 WHEN x <= -0.1 THEN 2 WHEN abs(x) >= 0.05 THEN 3 ELSE 0 END AS v FROM (SELECT vec_id AS id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS slot FROM embeddings))"
_P = "p AS (SELECT a.id, b.id AS other, a.slot, a.v AS a, b.v AS b FROM s a JOIN s b ON b.id = a.id + 1 AND b.slot = a.slot)"
_COSTS = "[" + ", ".join(str(x) for row in COST for x in row) + "]"
ORACLE_SQL = {
    "node_filter": "SELECT c_custkey AS node, CAST(round(greatest(0, least(1, c_acctbal / 10000)) * 255) AS INTEGER) AS step, round(round(greatest(0, least(1, c_acctbal / 10000)) * 255) / 255.0, 6) AS stored FROM customer WHERE c_nationkey IN (0, 1, 2, 5, 7, 11) AND c_acctbal >= 0 AND round(greatest(0, least(1, c_acctbal / 10000)) * 255) >= 51",
    "slot_orders": f"WITH {_S}, {_P} SELECT id, count(*) FILTER (a = b OR a = 0 OR b = 3) AS less_known, count(*) FILTER (a = b OR a = 2 OR b = 1) AS less_true FROM p GROUP BY id",
    "vector_lattice": f"""WITH {_S}, {_P}, q AS (SELECT id, slot, a, CASE WHEN slot < 60 THEN b ELSE 0 END AS b FROM p)
SELECT id, md5(string_agg(CASE WHEN slot // 8 IN (1, 2) THEN greatest(a, b) ELSE a | b END, '' ORDER BY slot)) AS joined, md5(string_agg(CASE WHEN slot // 8 IN (1, 2) THEN least(a, b) ELSE a & b END, '' ORDER BY slot)) AS met, CAST(count(*) FILTER (slot < 60 AND a <> b) + 4 AS INTEGER) AS distance FROM q GROUP BY id""",
    "label_softmax": "WITH b AS (SELECT user_id, event_type AS label, greatest(max(-value / 4), -12.0) AS x FROM events GROUP BY ALL), e AS (SELECT *, exp((x - max(x) OVER (PARTITION BY user_id)) / 2.0) AS e FROM b) SELECT user_id, label, round(e / sum(e) OVER (PARTITION BY user_id), 6) AS p FROM e",
    "concept_decode": f"WITH {_S}, d AS (SELECT a.id, c.id AS concept, round(sum({_COSTS}[a.v * 4 + c.v + 1]) / 64, 6) AS distance FROM s a JOIN s c ON a.slot = c.slot WHERE c.id % 50 = 0 GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, concept) AS r FROM d) SELECT id, CASE WHEN distance <= 0.33 THEN concept END AS concept, CAST(distance AS DOUBLE) AS distance FROM b WHERE r = 1",
    "candidate_projection": f"WITH {_S}, q AS (SELECT slot, v FROM s WHERE slot < 8 UNION ALL SELECT CASE slot WHEN 20 THEN 8 ELSE 9 END, v FROM s WHERE slot IN (20, 40)) SELECT slot, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM q GROUP BY slot",
    "slot_health": f"""WITH {_S}, {_P}, m AS (SELECT id, slot, v FROM s WHERE slot < 62 UNION ALL SELECT id, 63, v FROM s WHERE slot = 0 UNION ALL SELECT id, 62, 0 FROM s WHERE slot = 62),
n AS (SELECT slot, CAST(round(least(1.0, avg(CASE WHEN v <> 0 THEN 1.0 ELSE 0 END) * 2 * [1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3][slot // 8 + 1]), 6) AS DOUBLE) AS necessity FROM m GROUP BY slot),
f AS (SELECT slot, count(*) FILTER (a <> 0) AS support, count(*) FILTER (a <> 0 AND a = b) AS tp FROM p GROUP BY slot), g AS (SELECT slot, support, CASE WHEN support > 0 THEN round(tp / support, 6) ELSE 1.0 END AS recall FROM f),
c AS (SELECT slot, v, count(*) AS c, sum(count(*)) OVER (PARTITION BY slot) AS t FROM m GROUP BY slot, v), h AS (SELECT slot, round(-sum(c / t * log2(c / t)), 6) + 0.0 AS h FROM c GROUP BY slot),
jc AS (SELECT x.slot AS i, y.slot AS j, x.v AS vi, y.v AS vj, count(*) AS c FROM m x JOIN m y ON x.id = y.id AND x.slot < y.slot GROUP BY ALL), w AS (SELECT *, sum(c) OVER (PARTITION BY i, j) AS n, sum(c) OVER (PARTITION BY i, j, vi) AS a, sum(c) OVER (PARTITION BY i, j, vj) AS b FROM jc),
mi AS (SELECT j AS slot, max(mi) AS mi FROM (SELECT i, j, round(sum(c / n * log2(c * n / (a * b))), 6) AS mi FROM w GROUP BY i, j) GROUP BY j)
SELECT n.slot, necessity, support, recall, support >= 5 AND recall < 0.35 AS dead, h, CASE WHEN h < 0.05 THEN 'dead' WHEN coalesce(mi, 0) >= 0.9 * h THEN 'redundant' ELSE 'sound' END AS verdict FROM n JOIN g USING (slot) JOIN h USING (slot) LEFT JOIN mi USING (slot)""",
    "symbolic_soundness": f"""WITH {_S}, {_P}, g AS (SELECT id, count(*) FILTER (a <> 0) AS active, count(*) FILTER ((a = 1 AND b = 2) OR (a = 2 AND b = 1)) AS c, count(*) FILTER (a <> 0 AND (a & b) = a) AS k FROM p GROUP BY id)
SELECT label, round(avg(CASE WHEN c <= 12 THEN 1.0 ELSE 0.0 END), 6) AS soundness, round(avg(CASE WHEN active > 0 THEN round(k / active, 6) ELSE 1.0 END), 6) AS consistency FROM g JOIN embeddings ON vec_id = id GROUP BY label""",
}
