"""Words to concepts and sentences to graph rows: dictionary ladders, root categories, frames, cue rules, questions to edges and back to sentences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.parsers import formula_nodes, parse_formula, write_formula
from graphloom.operators.discourse import CUES, target_entities
from graphloom.operators.kb import closure
from graphloom.sources.tables import spread, table

#: Suffixes that a word sheds to reach its entry, in this order, and the concepts of shapes that no dictionary has.
SUFFIXES = ("s", "es", "ed", "ing")
SHAPES = ((r"^[0-9]+$", "NUMBER"), (r"^[A-Z]+[-_]?[0-9]+$", "CODE"), (r"^[A-Z]", "NAME"))


def concept_of(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """word, concept, how: by word, part of speech and language; then by word and language; then by word; then by its stem; then by its shape; else UNKNOWN.

    words: word, pos, lang; dictionary: word, pos, lang, concept (the least concept of equal keys).
    """
    w = words.select("word", "pos", "lang").distinct().withColumn("k", F.lower("word"))
    d = dictionary.select(F.lower("word").alias("k"), "pos", "lang", "concept")
    by = lambda keys, out: d.groupBy(*keys).agg(F.min("concept").alias(out))
    shed = F.filter(F.array(*[F.struct(F.lit(k).alias("rank"), F.when(F.endswith("k", F.lit(x)), F.expr(f"left(k, char_length(k) - {len(x)})")).alias("k2")) for k, x in enumerate(SUFFIXES)]), lambda s: s["k2"].isNotNull())
    stems = w.select("k", F.explode(shed).alias("s")).distinct().join(d.select(F.col("k").alias("k2"), "concept"), F.col("s.k2") == F.col("k2"))
    stems = stems.groupBy("k").agg(F.min(F.struct("s.rank", "concept"))["concept"].alias("c3"))
    j = w.join(by(["k", "pos", "lang"], "c0"), ["k", "pos", "lang"], "left").join(by(["k", "lang"], "c1"), ["k", "lang"], "left").join(by(["k"], "c2"), "k", "left").join(stems, "k", "left")
    shape = F.lit(None).cast("string")
    for pattern, name in reversed(SHAPES):
        shape = F.when(F.col("word").rlike(pattern), name).otherwise(shape)
    how = F.when(F.col("c0").isNotNull(), "full").when(F.col("c1").isNotNull(), "language").when(F.col("c2").isNotNull(), "word").when(F.col("c3").isNotNull(), "stem").when(shape.isNotNull(), "shape").otherwise("none")
    return j.select("word", "pos", "lang", F.coalesce("c0", "c1", "c2", "c3", shape, F.lit("UNKNOWN")).alias("concept"), how.alias("how"))


def root_category(nodes: DataFrame, parents: DataFrame, categories: DataFrame) -> DataFrame:
    """node, category, depth: a node's own category, else that of its nearest ancestor that has one (ties: the least name)."""
    up = closure(parents.select(F.col("child").alias("src"), F.col("parent").alias("dst"))).select(F.col("root").alias("node"), F.col("node").alias("at"), "depth")
    every = nodes.select("node", F.col("node").alias("at"), F.lit(0).alias("depth")).unionByName(up.join(nodes, "node", "left_semi"))
    found = every.join(categories.select(F.col("node").alias("at"), "category"), "at")
    best = found.groupBy("node").agg(F.min(F.struct("depth", "category")).alias("b"))
    return nodes.select("node").distinct().join(best, "node", "left").select("node", F.col("b.category").alias("category"), F.col("b.depth").alias("depth"))


#: Slots that the roles of a verb's frame fill, by the verb's class.
FRAMES = {
    "give": {"agent": "VAL_X1_AGENT", "theme": "VAL_X2_THEME", "patient": "VAL_X3_RECIPIENT"},
    "see": {"agent": "VAL_EXPERIENCER", "theme": "VAL_X2_THEME"},
    "cut": {"agent": "VAL_X1_AGENT", "patient": "VAL_X2_PATIENT", "instrument": "VAL_X5_INSTRUMENT"},
}
VERBS = {"give": "give", "gave": "give", "send": "give", "sent": "give", "see": "see", "saw": "see", "hear": "see", "cut": "cut", "cuts": "cut", "chop": "cut"}


def role_slots(events: DataFrame) -> DataFrame:
    """id, role, filler, slot: the fillers (map of role to filler) of events (id, verb, fillers) with the slot of their verb's frame; null for a role or verb that has none."""
    spark = events.sparkSession
    frames = F.broadcast(spark.createDataFrame([(v, role, slot) for v, kind in VERBS.items() for role, slot in FRAMES[kind].items()], "verb string, role string, slot string"))
    rows = events.select("id", F.lower("verb").alias("verb"), F.explode("fillers").alias("role", "filler"))
    return rows.join(frames, ["verb", "role"], "left").select("id", "role", "filler", "slot")


#: What a pair of events or a sentence is taken for without a model, by cue words; the first that fits.
CUE_RULES = (("CAUSES", CUES["causal"]), ("BEFORE", r"(?i)\b(?:before|then|later)\b"), ("AFTER", r"(?i)\bafter\b"), ("DURING", r"(?i)\b(?:while|during|meanwhile)\b"))


def cue_relation(text: Column) -> Column:
    """struct(relation, probability): by the first cue rule that fits; a hedge halves the probability, no cue leaves 0.5 for NONE."""
    relation = F.lit("NONE")
    for name, pattern in reversed(CUE_RULES):
        relation = F.when(text.rlike(pattern), name).otherwise(relation)
    p = F.when(relation == "NONE", 0.5).otherwise(0.9) * F.when(text.rlike(CUES["hedged"]), 0.5).otherwise(1.0)
    return F.struct(relation.alias("relation"), p.alias("probability"))


def relevance(rows: DataFrame, score, batch: int = 256) -> DataFrame:
    """rows (query, text and others) with relevance, by a pluggable function from two lists of texts to numbers, called by batches in the tasks."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [x for k in range(0, len(frame), batch) for x in score(frame["query"].iloc[k : k + batch].tolist(), frame["text"].iloc[k : k + batch].tolist())]
            yield frame.assign(relevance=pd.Series(out, index=frame.index, dtype=float))

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("relevance", DoubleType())]))


def overlap_relevance(queries: list[str], texts: list[str]) -> list[float]:
    """The share of a query's words that a text has: a stand-in for a model."""
    out = []
    for q, t in zip(queries, texts, strict=True):
        asked, held = set((q or "").lower().split()), set((t or "").lower().split())
        out.append(round(len(asked & held) / len(asked), 6) if asked else 0.0)
    return out


def pair_passes(entities: DataFrame, events: DataFrame) -> DataFrame:
    """chunk, entity, event: every pair of an entity and an event of one chunk that a model is asked about; chunks are small by their making."""
    return entities.select("chunk", F.col("id").alias("entity")).join(events.select("chunk", F.col("id").alias("event")), "chunk")


def compiled(entities: DataFrame, events: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, kind, literal; edges: src, rel, dst, confidence) of extracted rows.

    entities: id, name, category; events: id, verb and a column for each role; relations: src, rel, dst, confidence.
    """
    nodes = entities.select(F.concat(F.lit("E:"), "id").alias("node"), F.coalesce("category", F.lit("OBJECT")).alias("kind"), F.col("name").alias("literal")).unionByName(events.select(F.concat(F.lit("V:"), "id").alias("node"), F.lit("EVENT").alias("kind"), F.col("verb").alias("literal")))
    roles = [c for c in events.columns if c not in ("id", "verb", "chunk")]
    filled = events.select("id", F.explode(F.array(*[F.struct(F.lit(r.upper()).alias("rel"), F.col(r).cast("string").alias("to")) for r in roles])).alias("r")).where("r.to IS NOT NULL")
    edges = filled.select(F.concat(F.lit("V:"), "id").alias("src"), F.col("r.rel").alias("rel"), F.concat(F.lit("E:"), F.col("r.to")).alias("dst"), F.lit(1.0).alias("confidence"))
    return nodes.distinct(), edges.unionByName(relations.select("src", "rel", "dst", "confidence")).groupBy("src", "rel", "dst").agg(F.max("confidence").alias("confidence"))


#: Words of a question and the relation they ask for.
ASKS = ((r"(?i)\bwhere\b", "LOCATION"), (r"(?i)\bwho\b", "AGENT"), (r"(?i)\bwhen\b", "TIME"), (r"(?i)\bwhat\b", "THEME"))


def question_pattern(text: Column) -> Column:
    """array of struct(src, rel, dst) with ? for what is asked: each named entity and the relation that the question's word asks for."""
    rel = F.lit("RELATED")
    for pattern, name in reversed(ASKS):
        rel = F.when(text.rlike(pattern), name).otherwise(rel)
    return F.transform(target_entities(text), lambda e: F.struct(e.alias("src"), rel.alias("rel"), F.lit("?").alias("dst")))


def answers(patterns: DataFrame, edges: DataFrame) -> DataFrame:
    """id, answer, n: what edges (src, rel, dst, case aside) say to patterns (id, src, rel, dst with ?); each answer with how many patterns lead to it."""
    e = edges.select(F.lower("src").alias("s"), "rel", F.col("dst").alias("answer"))
    return patterns.where("dst = '?'").select("id", F.lower("src").alias("s"), "rel").join(e, ["s", "rel"]).groupBy("id", "answer").agg(F.count("*").alias("n"))


#: Sentences for relations; any other relation is spelt out.
TEMPLATES = {"LOCATION": "{0} is in {1}", "AGENT": "{1} does {0}", "CAUSES": "{0} causes {1}", "BEFORE": "{0} comes before {1}"}


def sentences_of(edges: DataFrame) -> DataFrame:
    """src, text: the edges of a node in sentences, sorted."""
    out = F.concat_ws(" ", "src", F.lower(F.regexp_replace("rel", "_", " ")), "dst")
    for rel, form in TEMPLATES.items():
        a, b = form.split("{1}") if form.startswith("{0}") else (None, None)
        said = F.concat(F.col("src"), F.lit(a[3:]), F.col("dst"), F.lit(b)) if a is not None else F.concat(F.col("dst"), F.lit(form[3:].replace("{0}", "")), F.col("src"))
        out = F.when(F.col("rel") == rel, said).otherwise(out)
    return edges.groupBy("src").agg(F.array_join(F.array_sort(F.collect_set(F.concat(out, F.lit(".")))), " ").alias("text"))


#: Kinds of distractors that a graph walk leaves out, and the words of a question that switch each rule off.
DISTRACTORS = {
    "media": (r"(?i)\b(?:film|album|song|episode|novel)\b", r"(?i)\b(?:film|movie|song|album|book|novel|directed|written)\b"), "sport": (r"(?i)\b(?:footballer|season|championship|f\.c\.)\b", r"(?i)\b(?:sport|team|player|football|season)\b"),
    "military": (r"(?i)\b(?:battle|regiment|brigade)\b", r"(?i)\b(?:battle|war|army|military)\b"), "disambiguation": (r"(?i)\b(?:may refer to|disambiguation|surname|given name)\b", r"(?i)\b(?:surname|meaning)\b"),
}


def distractor(literal: Column, question: Column) -> Column:
    """The kind of distractor that a node's literal is for a question; null if none, or if the question is about that kind."""
    out = F.lit(None).cast("string")
    for name, (pattern, asked) in reversed(list(DISTRACTORS.items())):
        out = F.when(literal.rlike(pattern) & ~F.coalesce(question, F.lit("")).rlike(asked), name).otherwise(out)
    return out


def q_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the parts' names in several forms, by a dictionary of those names."""
    p = table(spark, sf_dir, "part")
    w = p.select(F.split("p_name", " ")[1].alias("w"), (F.col("p_partkey") % 6).alias("k")).distinct()
    d = w.where("w <> 'gear'").select(F.col("w").alias("word"), F.lit("n").alias("pos"), F.lit("en").alias("lang"), F.upper("w").alias("concept"))
    asked = w.select(F.when(F.col("k") == 3, F.concat("w", F.lit("s"))).when(F.col("k") == 4, F.concat(F.lit("ZZ-"), F.char_length("w"))).when(F.col("k") == 5, F.concat("w", F.lit("qq"))).otherwise(F.col("w")).alias("word"), F.when(F.col("k") == 1, "v").otherwise("n").alias("pos"), F.when(F.col("k") == 2, "de").otherwise("en").alias("lang"))
    return concept_of(asked, d.distinct())


def q_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, nations and regions with the category of their nearest ancestor: some nations have one, all regions but the first."""
    from graphloom.sources.tables import triples

    t = triples(spark, sf_dir).where("property IN ('NATION', 'REGION')").select(F.col("subject").alias("child"), F.col("object").alias("parent"))
    nodes = t.select(F.col("child").alias("node")).union(t.select("parent")).distinct()
    key = F.substring_index("node", ":", -1).cast("long")
    cat = nodes.where((F.startswith("node", F.lit("N:")) & (key % 4 == 0)) | (F.startswith("node", F.lit("R:")) & (key > 0))).select("node", F.concat(F.lit("kind "), "node").alias("category"))
    return root_category(nodes, t, cat)


def q_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events of four verbs: the slots that their customer, priority and status fill."""
    o = table(spark, sf_dir, "orders")
    verb = F.element_at(F.array(*[F.lit(v) for v in ("Sent", "saw", "chop", "dream")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    e = o.select(F.col("o_orderkey").alias("id"), verb.alias("verb"), F.create_map(F.lit("agent"), F.col("o_custkey").cast("string"), F.lit("patient"), F.col("o_orderpriority"), F.lit("instrument"), F.col("o_orderstatus")).alias("fillers"))
    return role_slots(e).groupBy("role", "slot").agg(F.count("*").alias("n"), F.countDistinct("filler").alias("fillers"))


def q_cue_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation and probability of every turn with a cue added, and the share of a fixed question's words in it."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("x "), F.element_at(F.array(*[F.lit(v) for v in ("it fell because of that", "perhaps then it fell", "it fell after", "it fell")]), (F.col("turn") % 4 + 1).cast("int"))).alias("text"))
    r = cue_relation(F.col("text"))
    scored = relevance(c.withColumn("query", F.lit("it fell then")), overlap_relevance)
    return scored.select("conv_id", "turn", r["relation"].alias("relation"), r["probability"].alias("probability"), "relevance")


def q_compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and orders' lines compiled to a graph, counted by relation and kind of its target."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 > 0, "ORGANIZATION").alias("category"))
    li = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_returnflag").alias("verb"), F.col("l_suppkey").alias("agent"), F.when(F.col("l_linenumber") % 2 == 0, (F.col("l_suppkey") + 1) % 10).alias("patient"))
    rel = s.select(F.concat(F.lit("E:"), "id").alias("src"), F.lit("KNOWS").alias("rel"), F.concat(F.lit("E:"), (F.col("id") * 7) % 10).alias("dst"), F.lit(0.5).alias("confidence"))
    nodes, edges = compiled(s, li, rel)
    return edges.join(nodes.select(F.col("node").alias("dst"), "kind"), "dst", "left").groupBy("rel", "kind").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 3).alias("confidence"))


def q_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions for the nation of every customer, answered from edges, and the edges said in words."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    edges = c.select(F.concat(F.lit("CU-"), "c_custkey").alias("src"), F.when(F.col("c_custkey") % 2 == 0, "LOCATION").otherwise("BORN_IN").alias("rel"), F.col("n_name").alias("dst"))
    asked = spread(c.select("c_custkey")).select(F.col("c_custkey").alias("id"), F.format_string("Where is CU-%d now?", "c_custkey").alias("text"))
    # outer, as Spark adds a filter to a plain explode that makes the array once more
    q = asked.select("id", F.explode_outer(question_pattern(F.col("text"))).alias("p")).where("p IS NOT NULL").select("id", "p.*")
    said = sentences_of(edges).select(F.substring("src", 4, 20).cast("long").alias("id"), "text")
    return said.join(answers(q, edges), "id", "left").select("id", "text", "answer")


def q_distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of made literals as distractors of two questions."""
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    literal = F.element_at(F.array(*[F.lit(v) for v in ("a 1990 film", "the battle of X", "Bell may refer to", "a city", "a football season, footballer")]), (F.col("id") % 5 + 1).cast("int"))
    return s.select("id", distractor(literal, F.lit("Who founded the city?")).alias("plain"), distractor(literal, F.lit("Which film or battle?")).alias("asked"))


def q_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of regions' names, read and written by a table function's own parser: whether both agree, and how many parts they have."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, text in zip(frame["id"], frame["text"], strict=True):
                f = parse_formula(text)
                rows.append((k, parse_formula(write_formula(f)) == f, len(list(formula_nodes(f)))))
            yield pd.DataFrame(rows, columns=["id", "same", "parts"])

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("forall x (P"), "c_nationkey", F.lit("(x) & ~Q(x, y) -> R(x) | exists z (S(z) <-> T"), "c_custkey", F.lit("(x)))")).alias("text"))
    return c.mapInPandas(run, "id long, same boolean, parts long")


QUERIES = {
    "concept_ladder": q_concepts, "root_category": q_roots, "frame_roles": q_roles, "cue_relations": q_cue_relations, "extraction_compile": q_compiled, "graph_answers": q_answered, "distractor_pruning": q_distractors, "formula_round_trip": q_formulas,
}
ORACLE_SQL = {
    "concept_ladder": """WITH w AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS w, p_partkey % 6 AS k FROM part), d AS (SELECT DISTINCT w FROM w WHERE w <> 'gear'),
a AS (SELECT DISTINCT CASE k WHEN 3 THEN w || 's' WHEN 4 THEN 'ZZ-' || length(w) WHEN 5 THEN w || 'qq' ELSE w END AS word, CASE k WHEN 1 THEN 'v' ELSE 'n' END AS pos, CASE k WHEN 2 THEN 'de' ELSE 'en' END AS lang, k, w FROM w)
SELECT DISTINCT word, pos, lang, CASE WHEN k = 4 THEN 'CODE' WHEN k = 5 OR w = 'gear' THEN 'UNKNOWN' ELSE upper(w) END AS concept, CASE WHEN k = 4 THEN 'shape' WHEN k = 5 OR w = 'gear' THEN 'none' WHEN k = 1 THEN 'language' WHEN k = 2 THEN 'word' WHEN k = 3 THEN 'stem' ELSE 'full' END AS how FROM a""",
    "root_category": """WITH e AS (SELECT 'C:' || c_custkey AS node, c_nationkey AS n FROM customer UNION SELECT 'S:' || s_suppkey, s_nationkey FROM supplier), r AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation),
a AS (SELECT node, n, r, 1 AS up FROM e JOIN r USING (n) UNION ALL SELECT 'N:' || n, n, r, 0 FROM r)
SELECT node, CASE WHEN n % 4 = 0 THEN 'kind N:' || n WHEN r > 0 THEN 'kind R:' || r END AS category, CASE WHEN n % 4 = 0 THEN up WHEN r > 0 THEN up + 1 END AS depth FROM a UNION ALL SELECT 'R:' || r_regionkey, CASE WHEN r_regionkey > 0 THEN 'kind R:' || r_regionkey END, CASE WHEN r_regionkey > 0 THEN 0 END FROM region""",
    "frame_roles": """WITH e AS (SELECT o_orderkey % 4 AS k, CAST(o_custkey AS VARCHAR) AS a, o_orderpriority AS p, o_orderstatus AS i FROM orders), r AS (SELECT 'agent' AS role, CASE k WHEN 0 THEN 'VAL_X1_AGENT' WHEN 1 THEN 'VAL_EXPERIENCER' WHEN 2 THEN 'VAL_X1_AGENT' END AS slot, a AS f FROM e
UNION ALL SELECT 'patient', CASE k WHEN 0 THEN 'VAL_X3_RECIPIENT' WHEN 2 THEN 'VAL_X2_PATIENT' END, p FROM e UNION ALL SELECT 'instrument', CASE k WHEN 2 THEN 'VAL_X5_INSTRUMENT' END, i FROM e) SELECT role, slot, count(*) AS n, count(DISTINCT f) AS fillers FROM r GROUP BY role, slot""",
    "cue_relations": "SELECT conv_id, turn, ['CAUSES', 'BEFORE', 'AFTER', 'NONE'][turn % 4 + 1] AS relation, CAST([0.9, 0.45, 0.9, 0.5][turn % 4 + 1] AS DOUBLE) AS probability, round(CAST([2, 3, 2, 2][turn % 4 + 1] AS DOUBLE) / 3, 6) AS relevance FROM conversations",
    "extraction_compile": """WITH k AS (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem), e AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber AS src, 'AGENT' AS rel, l_suppkey AS dst, 1.0 AS c FROM k UNION SELECT DISTINCT l_orderkey || '-' || l_linenumber, 'PATIENT', (l_suppkey + 1) % 10, 1.0 FROM k WHERE l_linenumber % 2 = 0 UNION SELECT 'E:' || s_suppkey, 'KNOWS', s_suppkey * 7 % 10, 0.5 FROM supplier)
SELECT rel, CASE WHEN s_suppkey IS NULL THEN NULL WHEN s_suppkey % 3 > 0 THEN 'ORGANIZATION' ELSE 'OBJECT' END AS kind, count(*) AS n, CAST(round(sum(c), 3) AS DOUBLE) AS confidence FROM e LEFT JOIN supplier ON s_suppkey = dst GROUP BY 1, 2""",
    "graph_answers": "SELECT c_custkey AS id, 'CU-' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ' is in ' ELSE ' born in ' END || n_name || '.' AS text, CASE WHEN c_custkey % 2 = 0 THEN n_name END AS answer FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "distractor_pruning": "SELECT c_custkey AS id, ['media', 'military', 'disambiguation', NULL, 'sport'][c_custkey % 5 + 1] AS plain, [NULL, NULL, 'disambiguation', NULL, 'sport'][c_custkey % 5 + 1] AS asked FROM customer",
    "formula_round_trip": "SELECT c_custkey AS id, true AS same, CAST(12 AS BIGINT) AS parts FROM customer",
}
