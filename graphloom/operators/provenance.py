"""Where derived facts come from: minimal sets of given facts behind each, and behind each conflict (its unsatisfiable cores).

A fact's provenance is a set of premise sets none of which holds another.  Rules combine the premise sets of
their bodies; each round keeps the minimal ones, until nothing changes.  Rows are (node, fact, premise set), so work
follows the facts that rules touch.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.rules import DEDUCTIONS, EXCLUSIVE, NEGATED, named_facts
from graphloom.sources.scratch import cut, fixpoint

#: Rules of several premises beside the deductions: (premises, conclusion).
INFERENCES = (
    (("TYPE_HUMAN",), "TYPE_ANIMATE"), (("TEMP_ALLEN_MEETS",), "TEMP_ALLEN_BEFORE"), (("EPIST_AXIOMATIC_PREMISE", "EPIST_DEDUCTIVE_INFERENCE"), "NSM_TRUE"), (("SOLVER_PROOF_VALIDATED", "SOLVER_CWA_CLOSED_WORLD"), "EPIST_DIRECT_OBSERVATION"),
    (("CAUSAL_ENABLING_CONDITION", "CAUSAL_COUNTERFACTUAL_NEC"), "CAUSAL_DIRECT_MECHANISM"), (("ROLE_SENTIENT", "ROLE_AGENT_CAPABLE"), "ROLE_VOLITIONAL_SOURCE"), (("ROLE_VOLITIONAL_SOURCE", "GRAPH_FUNCTION_DEF"), "GRAPH_ROOT_NODE"),
    (("SPATIAL_RCC_TANGENTIAL_PART", "MEREOLOGY_HOLONYM_WHOLE"), "SPATIAL_RCC_CONGRUENT_EQ"), (("TYPE_ORGANIZATION", "EPIST_DEONTIC_OBLIGATION"), "ROLE_VOLITIONAL_SOURCE"),
)
RULES = (*(((p,), c) for p, c in DEDUCTIONS), *INFERENCES)
#: Facts that must not hold together, and those that excuse it.
DENIALS = (*((rule, pair, ()) for rule, pairs in EXCLUSIVE.items() for pair in pairs), (NEGATED[0], NEGATED[1:3], NEGATED[3]))


def _minimal(sets: Column) -> Column:
    """The sets that hold no other one of them."""
    return F.filter(sets, lambda s: ~F.exists(sets, lambda t: (t != s) & (F.size(F.array_except(t, s)) == 0)))


def _together(bodies: DataFrame, supports: DataFrame) -> DataFrame:
    """bodies (id, body: array, never empty) with node and premises: all ways to have the whole body, duplicates included.

    A body is gone through from its first part on; at each step the ways so far meet the supports of its next part in the same node.
    """
    longest = bodies.agg(F.max(F.size("body"))).first()[0] or 0
    now = bodies.withColumn("fact", F.get("body", F.lit(0))).join(supports, "fact").drop("fact")
    done = now.where(F.size("body") == 1)
    for k in range(1, longest):
        on = supports.withColumnRenamed("premises", "_more")
        now = now.withColumn("fact", F.get("body", F.lit(k))).join(on, ["node", "fact"]).withColumn("premises", F.array_sort(F.array_union("premises", "_more"))).drop("fact", "_more").distinct()
        done = done.unionByName(now.where(F.size("body") == k + 1))
    return done


def supports(facts: DataFrame, rules: tuple[tuple[tuple[str, ...], str], ...]) -> DataFrame:
    """node, fact, premises: every fact (node, fact) that is given or follows by rules (premises, conclusion) in its node, once for each minimal set of given facts that it follows from; written."""
    table_ = facts.sparkSession.createDataFrame([(c, list(p)) for p, c in rules], "id string, body array<string>")
    start = facts.select("node", "fact").distinct().select("node", "fact", F.array("fact").alias("premises"))

    def step(now: DataFrame) -> DataFrame:
        new = _together(F.broadcast(table_), now).select("node", F.col("id").alias("fact"), "premises")
        sets = now.unionByName(new).groupBy("node", "fact").agg(F.collect_set("premises").alias("sets"))
        return sets.select("node", "fact", F.explode(_minimal(F.col("sets"))).alias("premises"))

    return fixpoint(start, step)


def cores(facts: DataFrame, rules: tuple[tuple[tuple[str, ...], str], ...] = RULES, denials: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = DENIALS) -> DataFrame:
    """rule, node, a, b, premises, irreducible: the minimal sets of given facts (node, fact) from which a denied pair follows.

    A denial (rule, pair, excuses) holds unless one of its excuses is given or follows.  premises are sorted; irreducible: no
    other core of the node is a part of it, so that taking any one of its facts away leaves the rest without a conflict.
    Repeated facts count once; nodes without a conflict give no rows.
    """
    spark = facts.sparkSession
    held = supports(facts.where("node IS NOT NULL AND fact IS NOT NULL"), rules)
    pairs = spark.createDataFrame([(k, list(pair), rule) for k, (rule, pair, _) in enumerate(denials)], "id int, body array<string>, rule string")
    excuses = spark.createDataFrame([(k, e) for k, (_, _, found) in enumerate(denials) for e in found], "id int, fact string")
    free = held.select("node", "fact").distinct().join(F.broadcast(excuses), "fact").select("id", "node").distinct()
    ways = _together(F.broadcast(pairs), held).join(free, ["id", "node"], "left_anti")
    sets = ways.groupBy("id", "rule", "body", "node").agg(F.collect_set("premises").alias("sets"))
    found = cut(sets.select("rule", "node", F.get("body", F.lit(0)).alias("a"), F.get("body", F.lit(1)).alias("b"), F.explode(_minimal(F.col("sets"))).alias("premises")), "cores")
    every = found.groupBy("node").agg(F.collect_set("premises").alias("all"))
    smaller = F.exists("all", lambda t: (t != F.col("premises")) & (F.size(F.array_except(t, "premises")) == 0))
    return found.join(every, "node").select("rule", "node", "a", "b", "premises", (~smaller).alias("irreducible"))


def q_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cores of every vector's true slots."""
    facts = named_facts(spark, sf_dir).where("v = 1").select("node", F.col("slot").alias("fact"))
    return cores(facts).withColumn("premises", F.array_join("premises", ","))


def _closed(facts: set[str]) -> set[str]:
    out = set(facts)
    while more := {c for p, c in RULES if out >= set(p)} - out:
        out |= more
    return out


def _oracle() -> tuple[str, str]:
    """For the SQL of the query: the cores of each denial, by trying all sets of slots that lead to it, and its excuses."""
    rows, excused = [], []
    for k, (rule, (a, b), excuses) in enumerate(DENIALS):
        behind = {a, b}
        while more := {x for p, c in RULES if c in behind for x in p} - behind:
            behind |= more
        enough: list[tuple[str, ...]] = []
        for s in (s for n in range(1, len(behind) + 1) for s in combinations(sorted(behind), n)):
            if {a, b} <= _closed(set(s)) and not any(set(t) <= set(s) for t in enough):
                enough.append(s)
        rows += [f"({k}, '{rule}', '{a}', '{b}', {list(s)})" for s in enough]
        excused += [f"({k}, '{x}')" for x in excuses]
    return f"VALUES {', '.join(rows)}", f"VALUES {', '.join(excused)}"


def _sql() -> str:
    from graphloom.operators.rules import _FACTS

    sets, excuses = _oracle()
    return f"""WITH {_FACTS}, g AS (SELECT node, list(slot) AS have FROM f WHERE v = 1 GROUP BY node), known(id, rule, a, b, need) AS ({sets}), x(id, slot) AS ({excuses}),
c AS (SELECT rule, node, a, b, need FROM g JOIN known ON list_has_all(have, need) WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.id = known.id AND list_contains(have, x.slot)))
SELECT rule, node, a, b, array_to_string(need, ',') AS premises, NOT EXISTS (SELECT 1 FROM c d WHERE d.node = c.node AND d.need <> c.need AND list_has_all(c.need, d.need)) AS irreducible FROM c"""


QUERIES = {"rule_cores": q_cores}
ORACLE_SQL = {"rule_cores": _sql()}
