"""Made data and readers of data sets: entities, corpora, haystacks, training pairs, samples of benchmark suites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.sources.tables import table

KINDS = ("human", "location", "organization", "creative_work")
DOMAINS = ("physics", "biology", "law", "history", "software")


def _draw(seed: int, *columns: str | Column) -> Column:
    """A number of 62 bits that follows from the columns and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in columns], F.lit(seed)), 2)


def entities_from(rows: DataFrame) -> DataFrame:
    """id, label, category, aliases of rows (k, code): their kinds take turns, the code names them."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("k") % len(KINDS) + 1).cast("int"))
    return rows.select(F.concat(F.lit("Q"), F.col("k") + 1).alias("id"), F.concat_ws(" ", kind, "code").alias("label"), kind.alias("category"), F.array(F.col("code"), F.concat("code", F.lit("-"), F.col("k") % 10)).alias("aliases"))


def made_entities(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """id, label, category, aliases of n made entities; the same for a seed however the rows are dealt out."""
    e = spark.range(n).select(F.col("id").alias("k"))
    return entities_from(e.select("k", F.conv((_draw(seed, "k") % 1_679_616).cast("string"), 10, 36).alias("code")))


def made_claims(entities: DataFrame, n: int, each: int = 3, seed: int = 2) -> DataFrame:
    """subject, property, object: `each` links of every entity to others, distinct, none to itself."""
    k = F.substring(F.col("id"), F.lit(2), F.lit(20)).cast("long") - 1
    rows = entities.select("id", k.alias("k"), F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("j"))
    to = (F.col("k") + 1 + _draw(seed, "k", "j") % max(1, n - 1)) % n
    prop = F.element_at(F.array(*[F.lit(p) for p in ("P17", "P19", "P50", "P131")]), (F.col("j") % 4 + 1).cast("int"))
    return rows.select(F.col("id").alias("subject"), prop.alias("property"), F.concat(F.lit("Q"), to + 1).alias("object")).where("subject <> object").distinct()


def corpus_from(rows: DataFrame, domains: tuple[str, ...] = DOMAINS) -> DataFrame:
    """id, domain, text: a sentence for each row (id, fact, source), the domains taking turns."""
    d = F.element_at(F.array(*map(F.lit, domains)), (F.col("id") % len(domains) + 1).cast("int"))
    return rows.select("id", d.alias("domain"), F.concat_ws(" ", F.lit("Fact"), F.col("fact").cast("string"), F.lit("of"), d, F.lit("follows from fact"), F.col("source").cast("string")).alias("text"))


def made_corpus(spark: SparkSession, n: int, domains: tuple[str, ...] = DOMAINS, seed: int = 3) -> DataFrame:
    """id, domain, text: n sentences over the domains in equal numbers; the first domains take what doesn't divide."""
    return corpus_from(spark.range(n).select("id", (_draw(seed, "id") % 1000).alias("fact"), (_draw(seed + 1, "id") % 1000).alias("source")), domains)


def haystacks(needles: DataFrame, filler: Column, words: int) -> DataFrame:
    """id, context, position: needles (id, needle, depth from 0 to 1) in `words` words of filler text, repeated as often as it takes."""
    each = F.split(F.trim(F.regexp_replace(filler, r"\s+", " ")), " ")
    times = F.ceil(F.lit(words) / F.size(each)).cast("int")
    hay = F.slice(F.flatten(F.array_repeat(each, times)), F.lit(1), F.lit(words))
    at = F.floor(F.col("depth") * words).cast("int")
    n = needles.withColumn("_hay", hay).withColumn("position", at)
    whole = F.concat(F.slice("_hay", F.lit(1), F.col("position")), F.split("needle", " "), F.slice("_hay", F.col("position") + 1, F.lit(words)))
    return n.select("id", F.array_join(whole, " ").alias("context"), "position")


def tracked(rows: DataFrame, hops: int) -> DataFrame:
    """id, text, answer: for each row (id, value) a chain of assignments, each variable from the one before; the answer is the first one's value."""
    names = F.transform(F.sequence(F.lit(0), F.lit(hops)), lambda k: F.concat(F.lit("X"), F.col("id").cast("string"), F.lit("_"), k.cast("string")))
    lines = F.transform(F.sequence(F.lit(1), F.lit(hops)), lambda k: F.concat(F.lit("VAR "), F.get(names, k), F.lit(" = "), F.get(names, k - 1)))
    value = F.col("value").cast("string")
    return rows.select("id", F.concat(F.lit("VAR "), F.get(names, F.lit(0)), F.lit(" = "), value, F.lit("\n"), F.array_join(lines, "\n")).alias("text"), value.alias("answer"))


def tracked_variables(spark: SparkSession, n: int, hops: int, seed: int = 4) -> DataFrame:
    """`tracked` for n made values of five digits."""
    return tracked(spark.range(n).select("id", (_draw(seed, "id") % 90000 + 10000).alias("value")), hops)


def quota(rows: DataFrame, group: str, most: int, seed: int = 5) -> DataFrame:
    """At most `most` rows of every group, drawn by a hash of the row: what is drawn doesn't depend on partitions.

    Each task first keeps `most` rows of a group at most (Spark's group limit below the window), so a group of any
    size reaches its task as that many rows a partition.
    """
    drawn = rows.withColumn("_h", F.xxhash64(*[F.col(c).cast("string") for c in rows.columns], F.lit(seed)))
    w = Window.partitionBy(group).orderBy("_h")
    return drawn.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_h", "_r")


#: Names that suites give to the parts of a sample, in the order in which they are looked for.
FIELDS = {
    "id": ("id", "task_id", "sample_id", "qid"), "prompt": ("question", "prompt", "query", "input"), "context": ("context", "paragraphs", "passage", "story", "premises"), "gold": ("answer", "gold_answer", "answerKey", "label", "target"),
}


def samples(rows: DataFrame, suite: str, fields: dict[str, tuple[str, ...]] = FIELDS) -> DataFrame:
    """suite, id, prompt, context, gold of a suite's rows, whatever it calls them; nested parts come as JSON, missing ones as empty text."""
    kinds = {f.name: f.dataType.typeName() for f in rows.schema.fields}

    def part(names: tuple[str, ...]) -> Column:
        found = [F.to_json(c) if kinds[c] in ("array", "struct", "map") else F.col(c).cast("string") for c in names if c in kinds]
        return F.coalesce(*found, F.lit(""))

    return rows.select(F.lit(suite).alias("suite"), *[part(names).alias(name) for name, names in fields.items()])


def read_samples(spark: SparkSession, path: str, suite: str, fields: dict[str, tuple[str, ...]] = FIELDS) -> DataFrame:
    """Samples of a suite in JSON lines or Parquet."""
    return samples(spark.read.parquet(path) if path.endswith(".parquet") else spark.read.json(path), suite, fields)


def training_pairs(facts: DataFrame, spoil: int = 4, seed: int = 6, broken: Column | None = None) -> DataFrame:
    """domain, input, output, repair: facts (domain, subject, relation, object) as s-expressions; every so many, or those that `broken` tells, have lost their closing bracket, to be repaired."""
    good = F.concat(F.lit("(fact ("), "relation", F.lit(" "), "subject", F.lit(" "), "object", F.lit("))"))
    broken = _draw(seed, "subject", "relation", "object") % spoil == 0 if broken is None else broken
    text = F.concat_ws(" ", "subject", "relation", "object")
    return facts.select("domain", F.when(broken, F.concat(F.lit("repair: "), F.substring(good, F.lit(1), F.char_length(good) - 1))).otherwise(F.concat(F.lit("parse: "), text)).alias("input"), good.alias("output"), broken.alias("repair"))


def q_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities."""
    e = entities_from(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("code")))
    return e.withColumn("aliases", F.array_join("aliases", "|"))


def q_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sentences of customers and amounts."""
    return corpus_from(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("fact"), F.floor("o_totalprice").alias("source")))


def q_haystacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A needle for each customer at a depth of its key, in 300 words of seven letters' names."""
    needles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("The code of "), "c_name", F.lit(" is "), F.col("c_custkey") * 7).alias("needle"), ((F.col("c_custkey") % 11) / 10).alias("depth"))
    h = haystacks(needles, F.lit("alpha beta  gamma delta\nepsilon zeta eta"), 300)
    return h.select("id", "position", F.md5("context").alias("context"))


def q_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of four assignments for each supplier, that begins with its nation's number."""
    return tracked(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") + 10_000).alias("value")), 4)


def q_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items under other names, and with a nested context, as samples of two suites."""
    b = table(spark, sf_dir, "benchmark")
    one = b.select(F.col("item_id").alias("task_id"), F.col("text").alias("prompt"))
    two = b.select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.array(F.lit("p1"), F.lit("p2")).alias("paragraphs"), F.lit(True).alias("answer"))
    return samples(one, "first").unionByName(samples(two, "second"))


def q_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of customers as training pairs, every fourth to be repaired."""
    t = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    facts = t.select(F.concat(F.lit("r"), "n_regionkey").alias("domain"), F.concat(F.lit("C"), "c_custkey").alias("subject"), F.lit("nation").alias("relation"), F.col("n_name").alias("object"), "c_custkey")
    return training_pairs(facts, broken=F.col("c_custkey") % 4 == 0)


QUERIES = {"made_entities": q_entities, "made_corpus": q_corpus, "haystack_needles": q_haystacks, "variable_tracking": q_variables, "suite_samples": q_samples, "training_pairs": q_training}
ORACLE_SQL = {
    "made_entities": "SELECT 'Q' || (p_partkey + 1) AS id, c || ' ' || p_name AS label, c AS category, p_name || '|' || p_name || '-' || (p_partkey % 10) AS aliases FROM (SELECT *, ['human', 'location', 'organization', 'creative_work'][p_partkey % 4 + 1] AS c FROM part)",
    "made_corpus": "SELECT o_orderkey AS id, d AS domain, 'Fact ' || o_custkey || ' of ' || d || ' follows from fact ' || CAST(floor(o_totalprice) AS BIGINT) AS text FROM (SELECT *, ['physics', 'biology', 'law', 'history', 'software'][o_orderkey % 5 + 1] AS d FROM orders)",
    "haystack_needles": """WITH w AS (SELECT list_transform(range(300), lambda k: ['alpha', 'beta', 'gamma', 'delta', 'epsilon', 'zeta', 'eta'][k % 7 + 1]) AS w), n AS (SELECT c_custkey AS id, 'The code of ' || c_name || ' is ' || (c_custkey * 7) AS needle, CAST(floor((c_custkey % 11) / 10 * 300) AS INTEGER) AS position FROM customer)
SELECT id, position, md5(trim(regexp_replace(array_to_string(w[1:position], ' ') || ' ' || needle || ' ' || array_to_string(w[position + 1:], ' '), ' +', ' ', 'g'))) AS context FROM n, w""",
    "variable_tracking": "SELECT s_suppkey AS id, 'VAR X' || s_suppkey || '_0 = ' || (s_nationkey + 10000) || array_to_string(list_transform([1, 2, 3, 4], lambda k: chr(10) || 'VAR X' || s_suppkey || '_' || k || ' = X' || s_suppkey || '_' || (k - 1)), '') AS text, CAST(s_nationkey + 10000 AS VARCHAR) AS answer FROM supplier",
    "suite_samples": """SELECT 'first' AS suite, CAST(item_id AS VARCHAR) AS id, text AS prompt, '' AS context, '' AS gold FROM benchmark UNION ALL SELECT 'second', CAST(item_id AS VARCHAR), text, '["p1","p2"]', 'true' FROM benchmark""",
    "training_pairs": "WITH f AS (SELECT 'r' || n_regionkey AS domain, 'C' || c_custkey AS s, n_name AS o, c_custkey % 4 = 0 AS repair FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT domain, CASE WHEN repair THEN 'repair: (fact (nation ' || s || ' ' || o || ')' ELSE 'parse: ' || s || ' nation ' || o END AS input, '(fact (nation ' || s || ' ' || o || '))' AS output, repair FROM f",
}
