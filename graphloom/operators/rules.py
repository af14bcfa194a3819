"""Consistency rules over slot facts and edges: denials, deductions, role types, interval order, cycles.

A denial is a set of facts that must not hold together; its rows are the conflicts themselves, each the
smallest set of facts that breaks the rule.  Facts are rows (node, slot, v) with v among the four values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.components import components
from graphloom.sources.scratch import cut, grow
from graphloom.sources.tables import fluents, slots, table

#: Pairs of slots that exclude each other, by rule.
EXCLUSIVE = {
    "10 spatial": [
        ("SPATIAL_RCC_DISCONNECTED", x) for x in ("SPATIAL_RCC_CONGRUENT_EQ", "SPATIAL_RCC_PARTIAL_OVERLAP", "SPATIAL_RCC_NON_TANG_PART", "SPATIAL_RCC_TANGENTIAL_PART", "SPATIAL_RCC_EXT_CONNECTED")
    ] + [("SPATIAL_RCC_EXT_CONNECTED", "SPATIAL_RCC_CONGRUENT_EQ"), ("SPATIAL_RCC_TANGENTIAL_PART", "SPATIAL_RCC_CONGRUENT_EQ"), ("MEREOLOGY_HOLONYM_WHOLE", "MEREOLOGY_MERONYM_PART")],
    "9 temporal": [("TEMP_ALLEN_BEFORE", x) for x in ("TEMP_ALLEN_DURING", "TEMP_ALLEN_EQUALS", "TEMP_ALLEN_OVERLAPS")] + [("TEMP_ALLEN_MEETS", "TEMP_ALLEN_DURING")],
    "11 mechanism": [("CAUSAL_DIRECT_MECHANISM", "CAUSAL_PREVENTIVE_BLOCK")],
    "12 enabling": [("CAUSAL_ENABLING_CONDITION", "CAUSAL_PREVENTIVE_BLOCK")],
    "13 fork": [("CAUSAL_COMMON_CONFOUNDER", "CAUSAL_COLLIDER_EFFECT")],
    "14 necessity": [("CAUSAL_COUNTERFACTUAL_NEC", "CAUSAL_PREVENTIVE_BLOCK")],
    "15 root": [("GRAPH_ROOT_NODE", "GRAPH_LEAF")],
    "16 branch": [("GRAPH_BRANCH_THEN", "GRAPH_BRANCH_ELSE")],
    "17 function": [("GRAPH_FUNCTION_DEF", "GRAPH_RETURN_VALUE")],
    "18 connective": [("LJB_JE_AND", "LJB_JON_XOR")],
    "19 deontic": [("EPIST_DEONTIC_OBLIGATION", "EPIST_DEONTIC_PROHIBITION")],
    "20 hearsay": [("EPIST_DIRECT_OBSERVATION", "EPIST_HEARSAY_TESTIMONY")],
}
#: Rule 21: two facts that exclude each other unless one of two others holds.
NEGATED = ("21 negation", "NSM_TRUE", "LJB_NA_NEGATION", ("NSM_MAYBE", "MODALITY_FIGURATIVE"))
#: A slot that is true makes others true.
DEDUCTIONS = (
    ("TYPE_ANIMATE", "ROLE_SENTIENT"), ("TYPE_ANIMATE", "ROLE_MOVEABLE"), ("TYPE_ATTRIBUTE_PROPERTY", "WN_ATTRIBUTE_PROP"), ("EPIST_DEDUCTIVE_INFERENCE", "SOLVER_PROOF_VALIDATED"), ("EPIST_AXIOMATIC_PREMISE", "SOLVER_CWA_CLOSED_WORLD"),
)
#: Rules 6 to 8 on the target of a role in a literal event: (rule, relation, slots (value 1) of which it needs one, those that may be unknown (3) as well, slots that forbid it, slots that excuse it).
ROLES = (
    ("6 agent", "VAL_X1_AGENT", ("ROLE_AGENT_CAPABLE", "ROLE_VOLITIONAL_SOURCE", "TYPE_HUMAN", "TYPE_ANIMATE", "TYPE_ORGANIZATION", "GRAPH_VARIABLE_BIND"), ("TYPE_HUMAN", "TYPE_ANIMATE"), (), ("MODALITY_FIGURATIVE",)),
    ("6A artifact", "VAL_X1_AGENT", (), (), ("TYPE_ARTIFACT",), ("ROLE_AGENT_CAPABLE", "ROLE_VOLITIONAL_SOURCE", "MODALITY_FIGURATIVE")),
    ("7 experiencer", "VAL_EXPERIENCER", ("ROLE_SENTIENT", "TYPE_HUMAN", "TYPE_ANIMATE", "GRAPH_VARIABLE_BIND"), ("TYPE_HUMAN", "TYPE_ANIMATE"), (), ()),
    ("8 instrument", "VAL_X5_INSTRUMENT", (), (), ("TYPE_ABSTRACT_CONCEPT",), ("MODALITY_FIGURATIVE",)),
)
#: Names of the slots that rules speak of, in the order in which a vector holds them.
NAMES = sorted(
    {s for pairs in EXCLUSIVE.values() for pair in pairs for s in pair} | {NEGATED[1], NEGATED[2], *NEGATED[3], "MODALITY_LITERAL"} | {s for pair in DEDUCTIONS for s in pair} | {s for _, _, need, _, against, excuse in ROLES for s in (*need, *against, *excuse)}
)


def deduced(facts: DataFrame) -> DataFrame:
    """facts with what the deductions add (each fact once); conclusions may be premises of others, so it goes on until nothing is new."""
    pairs = facts.sparkSession.createDataFrame(list(DEDUCTIONS), "slot string, conclusion string")
    step = lambda new: new.where("v = 1").join(F.broadcast(pairs), "slot").select("node", F.col("conclusion").alias("slot"), F.lit(1).alias("v"))
    return grow(facts.select("node", "slot", F.col("v").cast("int").alias("v")).distinct(), step, ["node", "slot", "v"])


def conflicts(facts: DataFrame) -> DataFrame:
    """rule, node, a, b: every pair of true slots of a node that a rule forbids."""
    spark = facts.sparkSession
    pairs = spark.createDataFrame([(rule, a, b) for rule, found in EXCLUSIVE.items() for a, b in found] + [NEGATED[:3]], "rule string, a string, b string")
    true = facts.where("v = 1").select("node", "slot")
    held = true.join(F.broadcast(pairs), F.col("slot") == F.col("a")).select("rule", "node", "a", "b")
    held = held.join(true.withColumnRenamed("slot", "b"), ["node", "b"])
    excused = true.where(F.col("slot").isin(*NEGATED[3])).select("node", F.lit(NEGATED[0]).alias("rule")).distinct()
    return held.join(excused, ["node", "rule"], "left_anti").select("rule", "node", "a", "b")


def role_conflicts(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """rule, src, dst: role edges (src, rel, dst) of literal events whose target lacks what the role needs or is what it forbids.

    Targets are described once each (one row a node), so an edge meets one row.
    """
    has = lambda slot, values=(1,): F.bool_or((F.col("slot") == slot) & F.col("v").isin(*values))
    parts = []
    for k, (_, _, need, loose, against, excuse) in enumerate(ROLES):
        lacks = ~F.greatest(*[has(s, (1, 3) if s in loose else (1,)) for s in need]) if len(need) > 1 else F.lit(True)
        barred = F.greatest(*[has(s) for s in against], F.lit(False)) if against else F.lit(True)
        free = ~F.greatest(*[has(s) for s in excuse], F.lit(False)) if excuse else F.lit(True)
        parts.append((lacks & barred & free).alias(f"bad{k}"))
    target = facts.groupBy(F.col("node").alias("dst")).agg(*parts)
    event = facts.groupBy(F.col("node").alias("src")).agg((has("MODALITY_LITERAL") & ~has("MODALITY_FIGURATIVE")).alias("literal")).where("literal")
    joined = edges.join(event.select("src"), "src").join(target, "dst")
    rule = F.array(*[F.when((F.col("rel") == rel) & F.col(f"bad{k}"), name) for k, (name, rel, *_) in enumerate(ROLES)])
    return joined.select(F.explode(F.filter(rule, lambda r: r.isNotNull())).alias("rule"), "src", "dst")


#: Relations of precedence, and whether they run from source to target.
PRECEDENCE = {"BEFORE": True, "MEETS": True, "PRECEDES": True, "AFTER": False}


def followed(edges: DataFrame) -> DataFrame:
    """x, y: x is said to come before y, each pair once."""
    return edges.where(F.col("rel").isin(*PRECEDENCE)).select(F.when(F.col("rel") == "AFTER", F.col("dst")).otherwise(F.col("src")).alias("x"), F.when(F.col("rel") == "AFTER", F.col("src")).otherwise(F.col("dst")).alias("y")).distinct()


def precedence(edges: DataFrame) -> DataFrame:
    """x, y: x comes before y, directly or through others (transitive closure, each pair once)."""
    direct = followed(edges)
    base = direct.select(F.col("x").alias("y"), F.col("y").alias("z"))
    return grow(direct, lambda new: new.join(base, "y").select("x", F.col("z").alias("y")), ["x", "y"])


def order_conflicts(edges: DataFrame, intervals: DataFrame) -> DataFrame:
    """rule, x, y: intervals that end before they start (9A), pairs of edges that exclude each other (9B), cycles of precedence (9C), and precedence against the clock (9D).

    intervals: event, t0, t1 (null: open).  A pair of one rule comes once.
    """
    bad = [intervals.where("t0 > t1").select(F.lit("9A interval").alias("rule"), F.col("event").alias("x"), F.col("event").alias("y"))]
    kinds = edges.groupBy("src", "dst").agg(F.collect_set("rel").alias("r"))
    early = F.array_contains("r", "BEFORE") | F.array_contains("r", "PRECEDES")
    late = F.arrays_overlap("r", F.array(*[F.lit(x) for x in ("DURING", "EQUALS", "OVERLAPS", "AFTER")]))
    bad.append(kinds.where(early & late).select(F.lit("9B exclusive").alias("rule"), F.col("src").alias("x"), F.col("dst").alias("y")))
    before = precedence(edges)
    on_cycles = components(followed(edges).select(F.col("x").alias("src"), F.col("y").alias("dst"))).where("cyclic")
    bad.append(on_cycles.select(F.lit("9C cycle").alias("rule"), F.col("node").alias("x"), F.col("node").alias("y")))
    i = lambda n: intervals.select(F.col("event").alias(n), F.col("t0").alias(f"{n}0"), F.col("t1").alias(f"{n}1"))
    timed = before.join(i("x"), "x").join(i("y"), "y").where((F.col("x1") > F.col("y0")) | (F.col("x0") > F.col("y1")))
    bad.append(timed.select(F.lit("9D clock").alias("rule"), "x", "y"))
    out = bad[0]
    for part in bad[1:]:
        out = out.unionByName(part)
    return out.distinct()


def open_recursions(edges: DataFrame, marked: DataFrame, bases: DataFrame) -> DataFrame:
    """node, marked, based: nodes on cycles of edges (src, dst); a sound cycle has a recursion marker and a base case (both: node), else one of its columns is false."""
    on_cycles = cut(components(edges).where("cyclic").select("node", "component"), "cycles")
    flag = lambda df, n: df.select("node", F.lit(True).alias(n)).distinct()
    seen = on_cycles.join(flag(marked, "m"), "node", "left").join(flag(bases, "b"), "node", "left")
    sound = seen.groupBy("component").agg(F.bool_or(F.coalesce("m", F.lit(False))).alias("marked"), F.bool_or(F.coalesce("b", F.lit(False))).alias("based"))
    return on_cycles.join(sound, "component").select("node", "marked", "based")


def named_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, slot (name), v of every vector; slots beyond the names are left out."""
    names = spark.createDataFrame(list(enumerate(NAMES)), "k int, name string")
    s = slots(spark, sf_dir).where("v > 0").join(F.broadcast(names), F.col("slot") == F.col("k"))
    return s.select(F.col("id").alias("node"), F.col("name").alias("slot"), "v")


def made_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an event whose roles the next three vectors fill."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src"))
    kinds = F.array(*[F.struct(F.lit(rel).alias("rel"), F.lit(k).alias("k")) for k, rel in enumerate(("VAL_X1_AGENT", "VAL_EXPERIENCER", "VAL_X5_INSTRUMENT"), 1)])
    return e.withColumn("r", F.explode(kinds)).select("src", F.col("r.rel").alias("rel"), (F.col("src") + F.col("r.k")).alias("dst"))


def made_order(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(edges, intervals): events of each user in blocks of eight, each before the next one; every 50th edge is turned, every 70th doubled, every 30th interval turned."""
    f = fluents(spark, sf_dir).select(F.col("seq").alias("event"), "t_start", "t_end")
    turned = F.col("event") % 30 == 0
    intervals = f.select("event", F.when(turned, F.col("t_end")).otherwise(F.col("t_start")).alias("t0"), F.when(turned, F.col("t_start")).otherwise(F.col("t_end")).alias("t1"))
    e = f.where("event % 8 < 7").select(F.col("event").alias("a"), (F.col("event") + 1).alias("b"))
    plain = e.select(F.col("a").alias("src"), F.when(F.col("a") % 3 == 0, "BEFORE").when(F.col("a") % 3 == 1, "MEETS").otherwise("PRECEDES").alias("rel"), F.col("b").alias("dst"))
    back = e.where("a % 50 = 0").select(F.col("b").alias("src"), F.lit("PRECEDES").alias("rel"), F.col("a").alias("dst"))
    twice = e.where("a % 70 = 0").select(F.col("a").alias("src"), F.lit("DURING").alias("rel"), F.col("b").alias("dst"))
    return plain.unionByName(back).unionByName(twice), intervals


def q_recursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that lead to others in rings of six; some rings lack a marker or a base case."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.floor(F.col("p_partkey") / 6).alias("ring"))
    n = p.groupBy("ring").agg(F.max("k").alias("last"))
    edges = p.join(n, "ring").select(F.col("k").alias("src"), F.when(F.col("k") == F.col("last"), F.col("ring") * 6).otherwise(F.col("k") + 1).alias("dst")).where("src <> dst AND src % 4 <> 3 OR src % 12 < 6")
    return open_recursions(edges, p.where("k % 9 = 0").select(F.col("k").alias("node")), p.where("k % 5 = 0").select(F.col("k").alias("node")))


QUERIES = {
    "rule_conflicts": lambda s, d: conflicts(named_facts(s, d)),
    "rule_deductions": lambda s, d: deduced(named_facts(s, d)),
    "role_conflicts": lambda s, d: role_conflicts(made_roles(s, d), named_facts(s, d)),
    "order_conflicts": lambda s, d: order_conflicts(*made_order(s, d)),
    "open_recursions": q_recursions,
}
_S = "s AS (SELECT vec_id AS node, CAST(k AS INTEGER) AS k, CASE WHEN x >= 0.1 THEN 1 WHEN x <= -0.1 THEN 2 WHEN abs(x) >= 0.05 THEN 3 ELSE 0 END AS v FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS k FROM embeddings))"
_FACTS = f"{_S}, names AS (SELECT unnest([{', '.join(repr(n) for n in NAMES)}]) AS slot, unnest(range({len(NAMES)})) AS k), f AS (SELECT node, slot, v FROM s JOIN names USING (k) WHERE v > 0)"
_PAIRS = ", ".join(f"('{rule}', '{a}', '{b}')" for rule, found in EXCLUSIVE.items() for a, b in found)


def _role_sql() -> str:
    parts = []
    for name, rel, need, loose, against, excuse in ROLES:
        any_of = lambda names, values="(1)": "EXISTS (SELECT 1 FROM f WHERE node = dst AND slot IN (" + ", ".join(repr(n) for n in names) + f") AND v IN {values})"
        tests = [f"NOT {any_of(need)}"] * bool(need) + [f"NOT {any_of(loose, '(3)')}"] * bool(loose) + [any_of(against)] * bool(against) + [f"NOT {any_of(excuse)}"] * bool(excuse)
        parts.append(f"SELECT '{name}' AS rule, src, dst FROM e WHERE rel = '{rel}' AND {' AND '.join(tests)}")
    return " UNION ALL ".join(parts)


_ORD = """i0 AS (SELECT event_id AS event, epoch_us(ts) / 3.6e9 AS a, lead(epoch_us(ts) / 3.6e9) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
i AS (SELECT event, CASE WHEN event % 30 = 0 THEN b ELSE a END AS t0, CASE WHEN event % 30 = 0 THEN a ELSE b END AS t1 FROM i0),
e AS (SELECT event AS src, CASE event % 3 WHEN 0 THEN 'BEFORE' WHEN 1 THEN 'MEETS' ELSE 'PRECEDES' END AS rel, event + 1 AS dst FROM i WHERE event % 8 < 7 UNION ALL SELECT event + 1, 'PRECEDES', event FROM i WHERE event % 8 < 7 AND event % 50 = 0 UNION ALL SELECT event, 'DURING', event + 1 FROM i WHERE event % 8 < 7 AND event % 70 = 0)"""
ORACLE_SQL = {
    "rule_conflicts": f"""WITH {_FACTS}, r AS (SELECT * FROM (VALUES {_PAIRS}) AS t(rule, a, b)), t AS (SELECT node, slot FROM f WHERE v = 1)
SELECT rule, x.node, r.a, r.b FROM r JOIN t x ON x.slot = r.a JOIN t y ON y.slot = r.b AND y.node = x.node
UNION ALL SELECT '21 negation', x.node, x.slot, y.slot FROM t x JOIN t y ON x.node = y.node WHERE x.slot = 'NSM_TRUE' AND y.slot = 'LJB_NA_NEGATION' AND x.node NOT IN (SELECT node FROM t WHERE slot IN ('NSM_MAYBE', 'MODALITY_FIGURATIVE'))""",
    "rule_deductions": f"WITH {_FACTS} SELECT node, slot, v FROM f UNION SELECT node, c, 1 FROM f JOIN (VALUES {', '.join(f'({a!r}, {b!r})' for a, b in DEDUCTIONS)}) AS d(p, c) ON slot = p AND v = 1",
    "role_conflicts": f"""WITH {_FACTS}, l AS (SELECT node FROM f WHERE slot = 'MODALITY_LITERAL' AND v = 1 AND node NOT IN (SELECT node FROM f WHERE slot = 'MODALITY_FIGURATIVE' AND v = 1)),
e AS (SELECT vec_id AS src, rel, vec_id + k AS dst FROM embeddings, (VALUES ('VAL_X1_AGENT', 1), ('VAL_EXPERIENCER', 2), ('VAL_X5_INSTRUMENT', 3)) AS r(rel, k) WHERE vec_id IN (SELECT node FROM l) AND vec_id + k IN (SELECT node FROM f)) {_role_sql()}""",
    "order_conflicts": f"""WITH RECURSIVE {_ORD}, d AS (SELECT DISTINCT src AS x, dst AS y FROM e WHERE rel IN ('BEFORE', 'MEETS', 'PRECEDES')), p AS (SELECT x, y FROM d UNION SELECT p.x, d.y FROM p JOIN d ON p.y = d.x)
SELECT '9A interval' AS rule, event AS x, event AS y FROM i WHERE t0 > t1 UNION SELECT '9B exclusive', a.src, a.dst FROM e a JOIN e b ON a.src = b.src AND a.dst = b.dst WHERE a.rel IN ('BEFORE', 'PRECEDES') AND b.rel = 'DURING'
UNION SELECT '9C cycle', x, y FROM p WHERE x = y UNION SELECT '9D clock', x, y FROM p JOIN i a ON a.event = x JOIN i b ON b.event = y WHERE a.t1 > b.t0 OR a.t0 > b.t1""",
    "open_recursions": """WITH RECURSIVE p AS (SELECT p_partkey AS k, p_partkey // 6 AS ring, max(p_partkey) OVER (PARTITION BY p_partkey // 6) AS last FROM part), e AS (SELECT k AS src, CASE WHEN k = last THEN ring * 6 ELSE k + 1 END AS dst FROM p),
g AS (SELECT src, dst FROM e WHERE (src <> dst AND src % 4 <> 3) OR src % 12 < 6), r AS (SELECT src AS x, dst AS y FROM g UNION SELECT r.x, g.dst FROM r JOIN g ON g.src = r.y), c AS (SELECT a.x, a.y FROM r a JOIN r b ON a.x = b.y AND a.y = b.x)
SELECT x AS node, bool_or(y % 9 = 0) AS marked, bool_or(y % 5 = 0) AS based FROM c GROUP BY x""",
}
