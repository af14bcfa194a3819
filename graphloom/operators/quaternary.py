"""Four-valued slot algebra, similarity and information measures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.retrieval import nearest
from graphloom.sources.tables import slot_words, slots

#: Slots of a band; bands 1 and 2 are structural (ordered) lattices, the others epistemic ones.
BAND = 8
_PAIRS = 0x5555555555555555


def band(slot: Column) -> Column:
    return F.floor(slot / BAND).cast("int")


def slot_join(v: Column, slot: Column) -> Column:
    """Aggregate join: bitwise or on epistemic slots, maximum on structural ones."""
    return F.when(band(F.first(slot)).isin(1, 2), F.max(v)).otherwise(F.bit_or(v))


def slot_meet(v: Column, slot: Column) -> Column:
    return F.when(band(F.first(slot)).isin(1, 2), F.min(v)).otherwise(F.bit_and(v))


def negate(v: Column) -> Column:
    """Swaps 1 and 2."""
    return F.when(v == 1, 2).when(v == 2, 1).otherwise(v)


def hamming(a: Column, b: Column) -> Column:
    """Slots in which two packed vectors differ."""

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(_PAIRS)))

    return F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, n: s + n)


def entropy(counts: DataFrame, group: list[str], n: str = "n") -> DataFrame:
    """group, h: entropy in bits of the counts within each group (6 digits)."""
    total = counts.groupBy(*group).agg(F.sum(n).alias("t")) if group else counts.agg(F.sum(n).alias("t"))
    joined = counts.join(total, group) if group else counts.join(F.broadcast(total))
    p = F.col(n) / F.col("t")
    return joined.groupBy(*group).agg((F.round(-F.sum(p * F.log2(p)), 6) + 0.0).alias("h"))


def mutual_information(s: DataFrame, other: str) -> DataFrame:
    """slot, mi: mutual information in bits of each slot with a column of the same rows (6 digits)."""
    n = s.groupBy("slot").agg(F.count("*").alias("n"))
    joint = s.groupBy("slot", "v", other).agg(F.count("*").alias("c"))
    a = s.groupBy("slot", "v").agg(F.count("*").alias("a"))
    b = s.groupBy("slot", other).agg(F.count("*").alias("b"))
    j = joint.join(a, ["slot", "v"]).join(b, ["slot", other]).join(n, "slot")
    return j.groupBy("slot").agg(F.round(F.sum(F.col("c") / F.col("n") * F.log2(F.col("c") * F.col("n") / (F.col("a") * F.col("b")))), 6).alias("mi"))


def pairwise_information(s: DataFrame) -> DataFrame:
    """i, j, mi of all slots i < j.  Pairs are counted as rows of one vector: the join is on id."""
    t = s
    x, y = t.select("id", F.col("slot").alias("i"), F.col("v").alias("vi")), t.select("id", F.col("slot").alias("j"), F.col("v").alias("vj"))
    c = x.join(y, "id").where("i < j").groupBy("i", "j", "vi", "vj").agg(F.count("*").alias("c"))
    w = lambda *k: Window.partitionBy(*k)
    c = c.withColumns({"n": F.sum("c").over(w("i", "j")), "a": F.sum("c").over(w("i", "j", "vi")), "b": F.sum("c").over(w("i", "j", "vj"))})
    return c.groupBy("i", "j").agg(F.round(F.sum(F.col("c") / F.col("n") * F.log2(F.col("c") * F.col("n") / (F.col("a") * F.col("b")))), 6).alias("mi"))


def select_slots(s: DataFrame, label: str, k: int) -> list[int]:
    """Greedy choice of k slots: information on the label less the mean information shared with those chosen (numbers of slots only on the driver)."""
    relevance = {r["slot"]: r["mi"] for r in mutual_information(s, label).collect()}
    shared = {(r["i"], r["j"]): r["mi"] for r in pairwise_information(s).collect()} if k > 1 else {}
    chosen: list[int] = []
    while len(chosen) < min(k, len(relevance)):
        cost = lambda c: sum(shared.get((min(c, o), max(c, o)), 0.0) for o in chosen) / max(1, len(chosen))
        chosen.append(max((c for c in relevance if c not in chosen), key=lambda c: (round(relevance[c] - cost(c), 9), -c)))
    return chosen


#: Weights of a slot's fidelity, entropy, necessity, violations and shared information in its choice.
WEIGHTS = (0.35, 0.25, 0.20, 0.05, 0.15)


def weighted_choice(measures: DataFrame, shared: DataFrame, k: int) -> list[tuple[int, float]]:
    """Greedy choice of k slots: (slot, gain), by .35 F1 + .25 entropy + .20 necessity - .05 violations - .15 of half the mean information shared with those chosen.

    measures: slot, f1, h, necessity, violations; shared: i, j, mi.  Slots, of which there are a thousand at most, meet on the driver.
    """
    w = WEIGHTS
    own = {r["slot"]: w[0] * r["f1"] + w[1] * r["h"] + w[2] * r["necessity"] - w[3] * r["violations"] for r in measures.collect()}
    mi = {(r["i"], r["j"]): r["mi"] for r in shared.collect()}
    chosen: list[tuple[int, float]] = []
    while len(chosen) < min(k, len(own)):
        taken = [c for c, _ in chosen]
        gain = {c: round(v - w[4] * (sum(mi.get((min(c, o), max(c, o)), 0.0) for o in taken) / max(1, len(taken))) / 2, 9) for c, v in own.items() if c not in taken}
        best = max(gain, key=lambda c: (gain[c], -c))
        chosen.append((best, gain[best]))
    return chosen


def q_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve best slots by the weighted objective, in the order of their choice."""
    from graphloom.operators.nodes import necessity

    s, p = slots(spark, sf_dir), _next_pairs(spark, sf_dir)
    h = entropy(s.groupBy("slot", "v").agg(F.count("*").alias("n")), ["slot"]).withColumn("h", F.col("h") / 2)
    flips = p.groupBy("slot").agg(F.avg((((F.col("a") == 1) & (F.col("b") == 2)) | ((F.col("a") == 2) & (F.col("b") == 1))).cast("double")).alias("violations"))
    chosen = weighted_choice(fidelity(p).select("slot", "f1").join(h, "slot").join(necessity(s), "slot").join(flips, "slot"), pairwise_information(s), 12)
    return spark.createDataFrame([(k, slot, gain) for k, (slot, gain) in enumerate(chosen)], "step int, slot int, gain double")


def audit(pairs: DataFrame) -> DataFrame:
    """pairs (key columns, slot, a, b) -> contradictions (1 against 2), dropped and preserved active slots, rate, sound; the key is (id, other)."""
    active = F.col("a") != 0
    flip = ((F.col("a") == 1) & (F.col("b") == 2)) | ((F.col("a") == 2) & (F.col("b") == 1))
    kept = active & (F.col("a").bitwiseAND(F.col("b")) == F.col("a"))
    count = lambda c, name: F.sum(c.cast("long")).alias(name)
    g = pairs.groupBy("id", "other").agg(count(active, "active"), count(flip, "contradictions"), count(active & (F.col("b") == 0), "dropped"), count(kept, "preserved"))
    rate = F.when(F.col("active") > 0, F.round(F.col("preserved") / F.col("active"), 6)).otherwise(1.0)
    return g.withColumn("rate", rate).withColumn("sound", (F.col("contradictions") == 0) & (F.col("rate") >= 0.5))


def fidelity(pairs: DataFrame) -> DataFrame:
    """slot, tp, fp, fn, precision, recall, f1 of b against gold a; a wrong polarity is a false positive and a false negative."""
    hit = (F.col("a") != 0) & (F.col("a") == F.col("b"))
    g = pairs.groupBy("slot").agg(*[F.sum(c.cast("long")).alias(n) for n, c in (("tp", hit), ("fp", (F.col("b") != 0) & ~hit), ("fn", (F.col("a") != 0) & ~hit))])
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(1.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return g.select("slot", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def _next_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of each vector beside those of the vector with the next id."""
    s = slots(spark, sf_dir)
    b = s.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), "slot", F.col("v").alias("b"))
    return s.select("id", "slot", F.col("v").alias("a")).join(b, ["id", "slot"])


def _alike(slots_: int):
    """Share of equal slots of packed vectors, rounded to six digits; slots that are masked out count as neither."""

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        differ = np.zeros((len(a), len(b)), np.int64)
        for k in range(a.shape[1]):
            d = a[:, k].view(np.uint64)[:, None] ^ b[:, k].view(np.uint64)[None, :]
            differ += np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(_PAIRS)).astype(np.int64)
        return np.round(1 - differ / slots_, 6)

    return score


def nearest_by_slots(words: DataFrame, queries: DataFrame, k: int, slots_: int = 64) -> DataFrame:
    """query_id, id, score, rank, distance: the k vectors (id, words) that differ in the fewest of so many slots."""
    found = nearest(words.select("id", F.col("words").alias("v")), queries.select("query_id", F.col("words").alias("v")), k, _alike(slots_), key="id")
    return found.withColumn("distance", F.round((1 - F.col("score")) * slots_).cast("int"))


def q_hamming(spark: SparkSession, sf_dir: str, mask: bool = False) -> DataFrame:
    """Ten nearest of every vector whose id is divisible by 50 by differing slots (or by similarity without slots 8 to 23)."""
    w = slot_words(spark, sf_dir).select("id", "words")
    keep = [~(sum(3 << 2 * k for k in range(8, 24))) & (1 << 64) - 1, (1 << 64) - 1]
    if mask:
        signed = [k - (1 << 64) if k >> 63 else k for k in keep]
        w = w.select("id", F.zip_with("words", F.array(*[F.lit(k).cast("long") for k in signed]), lambda a, b: a.bitwiseAND(b)).alias("words"))
    return nearest_by_slots(w, w.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 10, 48 if mask else 64)


def q_total_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of slot entropies, joint entropy and their difference (0 at least)."""
    s = slots(spark, sf_dir)
    marginal = entropy(s.groupBy("slot", "v").agg(F.count("*").alias("n")), ["slot"]).agg(F.round(F.sum("h"), 4).alias("marginal"))
    rows = slot_words(spark, sf_dir).groupBy("words").agg(F.count("*").alias("n"))
    joint = entropy(rows, []).withColumnRenamed("h", "joint")
    both = marginal.join(F.broadcast(joint))
    return both.select("marginal", F.round("joint", 4).alias("joint"), F.round(F.greatest(F.col("marginal") - F.col("joint"), F.lit(0.0)), 3).alias("total_correlation"))


def q_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors, different ones and the share of pairs whose whole vectors are equal."""
    c = slot_words(spark, sf_dir).groupBy("words").agg(F.count("*").alias("n"))
    return c.agg(F.sum("n").alias("vectors"), F.count("*").alias("different"), F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")).alias("pairs")).select(
        "vectors", "different", F.round(F.col("pairs") / (F.col("vectors") * (F.col("vectors") - 1) / 2), 9).alias("rate")
    )


def q_band_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = entropy(slots(spark, sf_dir).groupBy("slot", "v").agg(F.count("*").alias("n")), ["slot"]).withColumn("band", band(F.col("slot")))
    return h.rollup("band").agg(F.round(F.avg("h"), 5).alias("h"), F.count("*").alias("slots"))


def q_mrmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One greedy step: relevance of every slot, and whether it is the first choice."""
    m = mutual_information(slots(spark, sf_dir), "label")
    best = F.max_by("slot", F.struct("mi", -F.col("slot"))).over(Window.partitionBy())
    return m.withColumn("chosen", F.col("slot") == best)


QUERIES = {
    "slot_join_agg": lambda s, d: slots(s, d).groupBy("label", "slot").agg(slot_join(F.col("v"), F.col("slot")).alias("v")),
    "slot_meet_agg": lambda s, d: slots(s, d).groupBy("label", "slot").agg(slot_meet(F.col("v"), F.col("slot")).alias("v")),
    "slot_negate": lambda s, d: slots(s, d).groupBy("slot").agg(F.sum(negate(F.col("v")).cast("long")).alias("total"), F.sum((F.col("v") != 0).cast("long")).alias("active")),
    "hamming_topk": q_hamming,
    "semantic_similarity": lambda s, d: q_hamming(s, d, mask=True),
    "audit_contradictions": lambda s, d: audit(_next_pairs(s, d)),
    "slot_fidelity": lambda s, d: fidelity(_next_pairs(s, d)),
    "slot_entropy": lambda s, d: entropy(slots(s, d).groupBy("slot", "v").agg(F.count("*").alias("n")), ["slot"]),
    "band_entropy": q_band_entropy,
    "total_correlation": q_total_correlation,
    "collision_rate": q_collisions,
    "pairwise_mi": lambda s, d: pairwise_information(slots(s, d)),
    "pairwise_mi_top": lambda s, d: pairwise_information(slots(s, d)).orderBy(F.desc("mi"), "i", "j").limit(20),
    "mrmr_select": q_select,
    "mrmr_step": q_mrmr,
}

_S = "s AS (SELECT id, label, CAST(slot AS INTEGER) AS slot, CASE WHEN x >= 0.1 THEN 1 WHEN x <= -0.1 THEN 2 WHEN abs(x) >= 0.05 THEN 3 ELSE 0 END AS v FROM (SELECT vec_id AS id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS slot FROM embeddings))"
_H = "h AS (SELECT slot, round(-sum(n / t * log2(n / t)), 6) AS h FROM (SELECT slot, n, sum(n) OVER (PARTITION BY slot) AS t FROM (SELECT slot, v, count(*) AS n FROM s GROUP BY ALL)) GROUP BY slot)"
_NEXT = "p AS (SELECT a.id, b.id AS other, a.slot, a.v AS a, b.v AS b FROM s a JOIN s b ON b.id = a.id + 1 AND b.slot = a.slot)"
_HAM = "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM (SELECT q.id AS query_id, a.id, CAST(sum(CAST(a.v <> q.v AS INTEGER)) AS INTEGER) AS distance, round(1 - sum(CAST(a.v <> q.v AS INTEGER)) / {1}, 6) AS score FROM s a JOIN s q ON a.slot = q.slot AND a.id <> q.id WHERE q.id % 50 = 0 AND {0} GROUP BY q.id, a.id)) WHERE rank <= 10"
ORACLE_SQL = {
    "slot_join_agg": f"WITH {_S} SELECT label, slot, CASE WHEN slot // 8 IN (1, 2) THEN max(v) ELSE bit_or(v) END AS v FROM s GROUP BY label, slot",
    "slot_meet_agg": f"WITH {_S} SELECT label, slot, CASE WHEN slot // 8 IN (1, 2) THEN min(v) ELSE bit_and(v) END AS v FROM s GROUP BY label, slot",
    "slot_negate": f"WITH {_S} SELECT slot, CAST(sum(CASE v WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE v END) AS BIGINT) AS total, count(*) FILTER (v <> 0) AS active FROM s GROUP BY slot",
    "hamming_topk": f"WITH {_S} " + _HAM.format("true", 64),
    "semantic_similarity": f"WITH {_S} " + _HAM.format("a.slot NOT BETWEEN 8 AND 23", 48),
    "audit_contradictions": f"""WITH {_S}, {_NEXT}, g AS (SELECT id, other, count(*) FILTER (a <> 0) AS active, count(*) FILTER ((a = 1 AND b = 2) OR (a = 2 AND b = 1)) AS contradictions, count(*) FILTER (a <> 0 AND b = 0) AS dropped, count(*) FILTER (a <> 0 AND (a & b) = a) AS preserved FROM p GROUP BY ALL),
r AS (SELECT *, CASE WHEN active > 0 THEN round(preserved / active, 6) ELSE 1.0 END AS rate FROM g) SELECT *, contradictions = 0 AND rate >= 0.5 AS sound FROM r""",
    "slot_fidelity": f"""WITH {_S}, {_NEXT}, g AS (SELECT slot, count(*) FILTER (a <> 0 AND a = b) AS tp, count(*) FILTER (b <> 0 AND NOT (a <> 0 AND a = b)) AS fp, count(*) FILTER (a <> 0 AND a <> b) AS fn FROM p GROUP BY slot),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS r FROM g)
SELECT slot, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM r""",
    "slot_entropy": f"WITH {_S}, {_H} SELECT * FROM h",
    "band_entropy": f"WITH {_S}, {_H} SELECT band, round(avg(h), 5) AS h, count(*) AS slots FROM (SELECT CAST(slot // 8 AS INTEGER) AS band, h FROM h) GROUP BY ROLLUP (band)",
    "total_correlation": f"""WITH {_S}, {_H}, v AS (SELECT list(v ORDER BY slot) AS w FROM s GROUP BY id), j AS (SELECT round(-sum(n / t * log2(n / t)), 6) AS j FROM (SELECT n, sum(n) OVER () AS t FROM (SELECT w, count(*) AS n FROM v GROUP BY w))),
m AS (SELECT round(sum(h), 4) AS marginal FROM h) SELECT marginal, round(j, 4) AS joint, round(greatest(marginal - j, 0.0), 3) AS total_correlation FROM m, j""",
    "collision_rate": f"WITH {_S}, v AS (SELECT list(v ORDER BY slot) AS w FROM s GROUP BY id), c AS (SELECT w, count(*) AS n FROM v GROUP BY w) SELECT CAST(sum(n) AS BIGINT) AS vectors, count(*) AS different, round(sum(n * (n - 1) / 2) / (sum(n) * (sum(n) - 1) / 2), 9) AS rate FROM c",
    "pairwise_mi": f"""WITH {_S}, c AS (SELECT a.slot AS i, b.slot AS j, a.v AS vi, b.v AS vj, count(*) AS c FROM s a JOIN s b ON a.id = b.id AND a.slot < b.slot GROUP BY ALL),
w AS (SELECT *, sum(c) OVER (PARTITION BY i, j) AS n, sum(c) OVER (PARTITION BY i, j, vi) AS a, sum(c) OVER (PARTITION BY i, j, vj) AS b FROM c) SELECT i, j, round(sum(c / n * log2(c * n / (a * b))), 6) AS mi FROM w GROUP BY i, j""",
    "pairwise_mi_top": f"""WITH {_S}, c AS (SELECT a.slot AS i, b.slot AS j, a.v AS vi, b.v AS vj, count(*) AS c FROM s a JOIN s b ON a.id = b.id AND a.slot < b.slot GROUP BY ALL),
w AS (SELECT *, sum(c) OVER (PARTITION BY i, j) AS n, sum(c) OVER (PARTITION BY i, j, vi) AS a, sum(c) OVER (PARTITION BY i, j, vj) AS b FROM c) SELECT i, j, round(sum(c / n * log2(c * n / (a * b))), 6) AS mi FROM w GROUP BY i, j ORDER BY mi DESC, i, j LIMIT 20""",
    "mrmr_step": f"""WITH {_S}, c AS (SELECT slot, v, label, count(*) AS c FROM s GROUP BY ALL), w AS (SELECT *, sum(c) OVER (PARTITION BY slot) AS n, sum(c) OVER (PARTITION BY slot, v) AS a, sum(c) OVER (PARTITION BY slot, label) AS b FROM c),
m AS (SELECT slot, round(sum(c / n * log2(c * n / (a * b))), 6) AS mi FROM w GROUP BY slot) SELECT slot, mi, slot = (SELECT slot FROM m ORDER BY mi DESC, slot LIMIT 1) AS chosen FROM m""",
}
