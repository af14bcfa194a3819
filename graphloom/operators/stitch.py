"""Entity resolution over extracted chunks: names, categories, matches, merges and the references between rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.sources.scratch import cut, fixpoint
from graphloom.sources.tables import table

#: Words that a name sheds from its start, in this order, and words that name nobody.
HONORIFICS = ("dr", "prof", "professor", "mr", "mrs", "ms", "miss", "sir", "lady", "lord", "captain", "president")
ARTICLES = ("the", "a", "an", "his", "her", "their", "its", "my", "our", "your", "this", "that")
PRONOUNS = ("he", "she", "it", "they", "him", "them", "we", "us", "i", "you", "who")
#: Names of categories that mean the same, and groups that may be one entity.
SYNONYMS = {"HUMAN": "PERSON", "UNIVERSITY": "ORGANIZATION", "INSTITUTION": "ORGANIZATION", "TOPIC": "ABSTRACT", "ABSTRACT_CONCEPT": "ABSTRACT"}
ANIMATE = ("PERSON", "ORGANIZATION", "ANIMAL")
INANIMATE = ("SUBSTANCE", "ARTIFACT", "NATURAL_OBJECT", "INSTRUMENT")
THRESHOLD = 0.7


def normal_name(name: Column) -> Column:
    """Lower case without leading titles, then without leading articles."""
    low = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s+", " "))
    bare = F.regexp_replace(low, rf"^(?:(?:{'|'.join(HONORIFICS)})[.,]*(?: |$))+", "")
    return F.trim(F.regexp_replace(bare, rf"^(?:(?:{'|'.join(ARTICLES)})(?: |$))+", ""))


def name_tokens(name: Column) -> Column:
    """The different telling words of a name."""
    words = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z0-9_-]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.char_length(w) > 1) & ~w.isin(*HONORIFICS, *ARTICLES, *PRONOUNS)))


def canonical_category(category: Column) -> Column:
    c = F.upper(F.trim(F.coalesce(category, F.lit("OBJECT"))))
    out = c
    for name, meant in SYNONYMS.items():
        out = F.when(c == name, meant).otherwise(out)
    return out


def compatible(a: Column, b: Column) -> Column:
    """Whether two canonical categories may be one entity's: equal, one of them OBJECT, or both animate or both inanimate."""
    return (a == b) | (a == "OBJECT") | (b == "OBJECT") | (a.isin(*ANIMATE) & b.isin(*ANIMATE)) | (a.isin(*INANIMATE) & b.isin(*INANIMATE))


def match_score(a: str, b: str) -> Column:
    """Score of two entities (structs with name, normal, tokens, category): 1 for equal names, .95 if the words of one contain the other's, .9 for half of the words shared, .8 for a third between two persons."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    same, either = F.size(F.array_intersect(x("tokens"), y("tokens"))), F.size(F.array_union(x("tokens"), y("tokens")))
    jaccard = same / F.greatest(either, F.lit(1))
    persons = (x("category") == "PERSON") & (y("category") == "PERSON")
    ladder = (
        F.when((x("normal") == y("normal")) & (x("normal") != ""), 1.0).when(same == 0, 0.0).when(same == F.least(F.size(x("tokens")), F.size(y("tokens"))), 0.95)
        .when(jaccard >= 0.5, 0.9).when((jaccard >= 0.33) & persons, 0.8).otherwise(0.0)
    )
    return F.when(compatible(x("category"), y("category")), ladder).otherwise(0.0)


def prepared(entities: DataFrame) -> DataFrame:
    """id, e: struct of name, normal, tokens, category."""
    return entities.select("id", F.struct("name", normal_name(F.col("name")).alias("normal"), name_tokens(F.col("name")).alias("tokens"), canonical_category(F.col("category")).alias("category")).alias("e"))


def best_matches(entities: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, match, score: for each entity (id, name, category) the earlier one that matches best (ties: the smallest id).

    Only entities that share a telling word meet.  Entities that agree in normal name, words and category are one
    form first; forms meet, not entities, so a name that very many rows have is compared once.
    """
    p = prepared(entities)
    shape = [F.col("e.normal").alias("normal"), F.array_sort("e.tokens").alias("tokens"), F.col("e.category").alias("category")]
    own = p.select("id", *shape)
    forms = cut(own.groupBy("normal", "tokens", "category").agg(F.min("id").alias("first")), "forms")
    words = forms.select("first", F.struct("normal", "tokens", "category").alias("f"), F.explode("tokens").alias("word"))
    a = words.select("word", F.col("first").alias("a_id"), F.col("f").alias("a"))
    b = words.select("word", F.col("first").alias("b_id"), F.col("f").alias("b"))
    met = a.join(b, "word").where("b_id < a_id").dropDuplicates(["a_id", "b_id"]).withColumn("score", match_score("a", "b")).where(F.col("score") >= threshold)
    found = met.groupBy("a_id").agg(F.max_by("b_id", F.struct("score", -F.col("b_id"))).alias("other"), F.max("score").alias("other_score"))
    near = own.join(forms, ["normal", "tokens", "category"]).join(found, F.col("first") == F.col("a_id"), "left")
    again = (F.col("id") > F.col("first")) & (F.size("tokens") > 0)  # an entity of a form that was met before
    return near.select("id", F.when(again, F.col("first")).otherwise(F.col("other")).alias("match"), F.when(again, F.lit(1.0)).otherwise(F.col("other_score")).alias("score")).where("match IS NOT NULL")


def global_ids(entities: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, global_id: the first entity that matches lead back to (pointers are doubled until they rest)."""
    links = entities.select("id").join(best_matches(entities, threshold).select("id", "match"), "id", "left").select("id", F.coalesce("match", "id").alias("global_id"))
    return fixpoint(links, lambda now: now.join(now.select(F.col("id").alias("global_id"), F.col("global_id").alias("next")), "global_id").select("id", F.col("next").alias("global_id")))


def merged(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """global_id, name, category, aliases, members: one row for each global entity.

    The name with the most telling words wins, then the longest, then the first; a specific category beats OBJECT
    (the first that is specific); the other names are aliases.
    """
    rows = entities.join(mapping, "id").withColumn("c", canonical_category(F.col("category")))
    rank = F.struct(F.size(name_tokens(F.col("name"))), F.char_length("name"), -F.col("id"))
    g = rows.groupBy("global_id").agg(
        F.max_by("name", rank).alias("name"), F.coalesce(F.min_by(F.when(F.col("c") != "OBJECT", F.col("c")), F.when(F.col("c") != "OBJECT", F.col("id"))), F.lit("OBJECT")).alias("category"),
        F.array_sort(F.collect_set("name")).alias("names"), F.count("*").alias("members"),
    )
    return g.select("global_id", "name", "category", F.filter("names", lambda n: n != F.col("name")).alias("aliases"), "members")


def remapped(rows: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """rows whose columns hold entity ids, with global ids instead; ids that no entity has stay."""
    for c in columns:
        m = mapping.select(F.col("id").alias(c), F.col("global_id").alias("_to"))
        rows = rows.join(m, c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return rows


#: Roles of an event, and whether only an entity may fill them.
ROLES = {"agent": False, "patient": False, "location": True}


def broken_references(events: DataFrame, entities: DataFrame, roles: dict[str, bool] = ROLES) -> DataFrame:
    """event, role, ref: what an event (id and a column for each role) names and no entity is; other events may fill the roles that allow it."""
    ids = entities.select(F.col("id").cast("string").alias("ref"))
    every = ids.unionByName(events.select(F.col("id").cast("string").alias("ref")))
    out = None
    for role, strict in roles.items():
        part = events.where(F.col(role).isNotNull()).select(F.col("id").alias("event"), F.lit(role).alias("role"), F.col(role).cast("string").alias("ref")).join(ids if strict else every, "ref", "left_anti")
        out = part if out is None else out.unionByName(part)
    return out.select("event", "role", "ref")


def minted(broken: DataFrame, first: int) -> DataFrame:
    """id, name, category of the entities that broken references ask for, numbered by name from first on; the category follows the role.

    Numbers are dealt by range: each part of the sorted names counts its own, and starts behind the parts before it.
    """
    kind = F.when(F.col("role") == "location", "LOCATION").when(F.col("role") == "agent", "PERSON").otherwise("ABSTRACT")
    asked = broken.groupBy(F.col("ref").alias("name")).agg(F.min(kind).alias("category"))
    parts = cut(asked.repartitionByRange("name").withColumn("part", F.spark_partition_id()), "minted")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # one row a partition
    place = F.row_number().over(Window.partitionBy("part").orderBy("name"))
    return parts.withColumn("k", place).join(F.broadcast(before), "part").select((F.col("k") + F.col("base") + (first - 1)).alias("id"), "name", "category")


def chunk_links(events: DataFrame) -> DataFrame:
    """src, dst, relation: the last event of each chunk (chunk, seq, id, gap) leads to the first one of the next; BEFORE if that says that time has passed, else MEETS."""
    edge = events.groupBy("chunk").agg(F.max_by("id", "seq").alias("last"), F.min_by(F.struct("id", "gap"), "seq").alias("first"))
    follow = edge.withColumn("src", F.lag("last").over(Window.orderBy("chunk"))).where("src IS NOT NULL")  # one row a chunk
    return follow.select("src", F.col("first.id").alias("dst"), F.when(F.col("first.gap"), "BEFORE").otherwise("MEETS").alias("relation"))


def made_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, category: mentions of people and places, five to each, made from customers."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    n = F.floor(F.col("id") / 5).cast("string")
    names = ["Dr. Anna{} Bell{}", "Bell{} Anna{} Mary{}", "the Bell{}", "Hall{}", "Mr. Bell{} Carl{} Otto{}"]
    kinds = ["PERSON", "human", "object", "LOCATION", "PERSON"]
    name, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (text, category) in enumerate(zip(names, kinds, strict=True)):
        parts = [F.lit(x) for x in text.split("{}")]
        name = F.when(F.col("id") % 5 == k, F.concat(parts[0], *[x for p in parts[1:] for x in (n, p)])).otherwise(name)
        kind = F.when(F.col("id") % 5 == k, category).otherwise(kind)
    return c.select("id", name.alias("name"), kind.alias("category"))


def made_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (negative), chunk, seq, agent, patient, location, gap: orders as events; some name nobody, some name an event."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.month("o_orderdate").alias("m"), F.year("o_orderdate").alias("y"))
    missing = F.when(F.col("k") % 7 == 0, 10_000_000 + F.col("k") % 50)
    return o.select(
        (-F.col("k") - 1).alias("id"), (F.col("y") * 12 + F.col("m")).alias("chunk"), F.col("k").alias("seq"), F.coalesce(missing, F.col("c")).alias("agent"),
        F.when(F.col("k") % 3 == 0, -F.col("k")).otherwise(F.col("c")).alias("patient"), F.when(F.col("k") % 5 == 0, -F.col("k") - 1).when(F.col("k") % 5 == 1, F.col("c")).alias("location"), (F.col("k") % 4 == 0).alias("gap"),
    )


def q_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = made_entities(spark, sf_dir)
    return merged(e, global_ids(e)).select("global_id", "name", "category", F.array_join("aliases", "|").alias("aliases"), "members")


def q_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_references(made_events(spark, sf_dir), made_entities(spark, sf_dir))


def q_minted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minted(q_broken(spark, sf_dir).where("ref > 0"), 1)


def q_remapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by global agent and patient."""
    e = made_entities(spark, sf_dir)
    r = remapped(made_events(spark, sf_dir), global_ids(e), ["agent", "patient"])
    return r.groupBy("agent").agg(F.count("*").alias("events"), F.countDistinct("patient").alias("patients"))


QUERIES = {
    "entity_matches": lambda s, d: best_matches(made_entities(s, d)),
    "entity_merge": q_merged,
    "fk_validation": q_broken,
    "entity_mint": q_minted,
    "fk_remap": q_remapped,
    "chunk_links": lambda s, d: chunk_links(made_events(s, d)),
}
_EV = """v AS (SELECT -o_orderkey - 1 AS id, year(o_orderdate) * 12 + month(o_orderdate) AS chunk, o_orderkey AS seq, CASE WHEN o_orderkey % 7 = 0 THEN 10000000 + o_orderkey % 50 ELSE o_custkey END AS agent, CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey ELSE o_custkey END AS patient,
CASE o_orderkey % 5 WHEN 0 THEN -o_orderkey - 1 WHEN 1 THEN o_custkey END AS location, o_orderkey % 4 = 0 AS gap FROM orders)"""
_BR = f"""{_EV}, ids AS (SELECT c_custkey AS ref FROM customer), every AS (SELECT ref FROM ids UNION SELECT id FROM v),
br AS (SELECT id AS event, 'agent' AS role, CAST(agent AS VARCHAR) AS ref FROM v WHERE agent NOT IN (SELECT ref FROM every) UNION ALL SELECT id, 'patient', CAST(patient AS VARCHAR) FROM v WHERE patient NOT IN (SELECT ref FROM every) UNION ALL SELECT id, 'location', CAST(location AS VARCHAR) FROM v WHERE location IS NOT NULL AND location NOT IN (SELECT ref FROM ids))"""
#: Of five mentions the second and fifth match the first, and the third (any category) too; the fourth is a place of its own.
_GL = "gl AS (SELECT c_custkey AS id, c_custkey % 5 AS m, CASE WHEN c_custkey % 5 = 3 THEN c_custkey ELSE c_custkey - c_custkey % 5 END AS global_id, c_custkey // 5 AS n FROM customer)"
ORACLE_SQL = {
    "entity_matches": f"WITH {_GL} SELECT id, CASE m WHEN 4 THEN id - 2 ELSE global_id END AS match, CAST(0.95 AS DOUBLE) AS score FROM gl WHERE m IN (1, 2, 4)",
    "entity_merge": f"""WITH {_GL}, g AS (SELECT global_id, n, min(m) AS m, count(*) AS members FROM gl GROUP BY ALL)
SELECT global_id, CASE WHEN m = 3 THEN 'Hall' || n WHEN members = 4 THEN 'Mr. Bell' || n || ' Carl' || n || ' Otto' || n WHEN members > 1 THEN 'Bell' || n || ' Anna' || n || ' Mary' || n ELSE 'Dr. Anna' || n || ' Bell' || n END AS name, CASE WHEN m = 3 THEN 'LOCATION' ELSE 'PERSON' END AS category,
CASE WHEN m = 3 THEN '' ELSE array_to_string(list_filter([CASE WHEN members = 4 THEN 'Bell' || n || ' Anna' || n || ' Mary' || n END, CASE WHEN members > 1 THEN 'Dr. Anna' || n || ' Bell' || n END, CASE WHEN members > 2 THEN 'the Bell' || n END], lambda x: x IS NOT NULL), '|') END AS aliases, members FROM g""",
    "fk_validation": f"WITH {_BR} SELECT * FROM br",
    "entity_mint": f"WITH {_BR} SELECT row_number() OVER (ORDER BY ref) AS id, ref AS name, min(CASE role WHEN 'location' THEN 'LOCATION' WHEN 'agent' THEN 'PERSON' ELSE 'ABSTRACT' END) AS category FROM br WHERE CAST(ref AS BIGINT) > 0 GROUP BY ref",
    "fk_remap": f"WITH {_EV}, {_GL} SELECT coalesce(a.global_id, v.agent) AS agent, count(*) AS events, count(DISTINCT coalesce(p.global_id, v.patient)) AS patients FROM v LEFT JOIN gl a ON a.id = v.agent LEFT JOIN gl p ON p.id = v.patient GROUP BY 1",
    "chunk_links": f"WITH {_EV}, e AS (SELECT chunk, max_by(id, seq) AS last, min_by(id, seq) AS first, min_by(gap, seq) AS gap FROM v GROUP BY chunk), f AS (SELECT *, lag(last) OVER (ORDER BY chunk) AS src FROM e) SELECT src, first AS dst, CASE WHEN gap THEN 'BEFORE' ELSE 'MEETS' END AS relation FROM f WHERE src IS NOT NULL",
}
