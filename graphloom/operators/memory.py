"""What a memory offers to its users: seeds of a walk, statistics, details, wider contexts, manifests, audits, unions of graphs; and settings with their origin."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.parsers import _code_edges
from graphloom.operators import retrieval
from graphloom.operators.kb import literal_index
from graphloom.sources.tables import quaternary, slots, table, triples


def allowed(edges: DataFrame, relations: list[str] | None) -> DataFrame:
    """Edges of the relations on a list; None or a list with * lets all pass."""
    return edges if relations is None or "*" in relations else edges.where(F.col("rel").isin(*relations))


def seeds(dense: DataFrame, literal: DataFrame, alias: DataFrame, most: int, theta: float = 0.2, alpha: float = 0.6) -> DataFrame:
    """query_id, node, energy, sources: the nodes that a walk starts from.

    Three sets of candidates meet, and the largest energy of a node counts: dense ones (query_id, node, cosine,
    similarity) have alpha * cosine (0 below theta) + (1 - alpha) * similarity, those whose literal or alias the query
    names (query_id, node) have 1.
    """
    d = dense.select("query_id", "node", F.round(alpha * F.when(F.col("cosine") >= theta, F.col("cosine")).otherwise(0.0) + (1 - alpha) * F.greatest(F.lit(0.0), F.col("similarity")), 6).alias("energy"), F.lit("dense").alias("source"))
    named = [df.select("query_id", "node", F.lit(1.0).alias("energy"), F.lit(name).alias("source")).distinct() for df, name in ((literal, "literal"), (alias, "alias"))]
    g = d.unionByName(named[0]).unionByName(named[1]).groupBy("query_id", "node").agg(F.max("energy").alias("energy"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))
    w = Window.partitionBy("query_id").orderBy(F.desc("energy"), "node")
    return g.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def named_in(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, node: nodes (node, literal) all of whose indexed words stand in the query (query_id, text)."""
    words = literal_index(nodes)
    size = words.groupBy("node").agg(F.count("*").alias("n"))
    asked = queries.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)))).alias("word"))
    return retrieval.small(asked).join(words, "word").groupBy("query_id", "node").agg(F.count("*").alias("k")).join(size, "node").where("k = n").select("query_id", "node")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, n, edges_out, edges_in: nodes (node, kind) and what leads from and to them."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"))
    j = nodes.join(out, "node", "left").join(into, "node", "left")
    return j.groupBy("kind").agg(F.count("*").alias("n"), F.coalesce(F.sum("o"), F.lit(0)).alias("edges_out"), F.coalesce(F.sum("i"), F.lit(0)).alias("edges_in"))


def details(asked: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """node, rel, direction, n, others: what is known of the asked nodes (node); others lists the least `most` by name."""
    out = edges.select(F.col("src").alias("node"), "rel", F.lit("out").alias("direction"), F.col("dst").alias("other"))
    into = edges.select(F.col("dst").alias("node"), "rel", F.lit("in").alias("direction"), F.col("src").alias("other"))
    rows = out.unionByName(into).join(asked.select("node").distinct(), "node", "left_semi")
    w = Window.partitionBy("node", "rel", "direction").orderBy("other")
    listed = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).groupBy("node", "rel", "direction").agg(F.array_join(F.array_sort(F.collect_list("other")), ",").alias("others"))
    return rows.groupBy("node", "rel", "direction").agg(F.count("*").alias("n")).join(listed, ["node", "rel", "direction"])


def widened(hits: DataFrame, passages: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """doc_id, hit, text: hits (doc_id, place) with the passages (doc_id, place, text) round them, in order."""
    near = hits.select("doc_id", F.col("place").alias("hit"), F.explode(F.sequence(F.col("place") - before, F.col("place") + after)).alias("place")).distinct()
    parts = F.array_sort(F.collect_list(F.struct("place", "text")))
    return near.join(passages, ["doc_id", "place"]).groupBy("doc_id", "hit").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))


def manifest(entities: DataFrame, most: int) -> DataFrame:
    """session, lines: the entities (session, name, category, salience) of a session as lines, the most salient first."""
    w = Window.partitionBy("session").orderBy(F.desc("salience"), "name")
    top = entities.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    line = F.concat(F.lit("- "), "name", F.lit(" ["), "category", F.lit("] "), F.format_string("%.2f", "salience"))
    rows = F.array_sort(F.collect_list(F.struct("_r", line.alias("line"))))
    return top.groupBy("session").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("lines"))


def ambiguous_pronouns(mentions: DataFrame) -> DataFrame:
    """doc, seq, referent, ambiguous: pronouns (mentions: doc, seq, name, kind, pronoun) lead to the last named mention of their kind; ambiguous if the one before it is another."""
    w = Window.partitionBy("doc", "kind").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    named = F.when(~F.col("pronoun"), F.col("name"))
    last = F.last(named, ignorenulls=True).over(w)
    held = mentions.withColumn("referent", last).withColumn("_change", F.when(~F.col("pronoun") & (F.col("name") != F.coalesce(last, F.lit(""))), last))
    prior = F.last(F.col("_change"), ignorenulls=True).over(Window.partitionBy("doc", "kind").orderBy("seq"))
    return held.withColumn("_prior", prior).where("pronoun").select("doc", "seq", "referent", F.col("_prior").isNotNull().alias("ambiguous"))


def audited(rows: DataFrame, key: str, checks: dict[str, Column], share: float, seed: int = 3) -> DataFrame:
    """check, sampled, failed: checks (true where a row is sound) over a sample of rows that a hash of the key draws."""
    drawn = rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10_000)) < int(share * 10_000))
    wide = drawn.agg(F.count("*").alias("sampled"), *[F.sum((~F.coalesce(c, F.lit(False))).cast("long")).alias(n) for n, c in checks.items()])
    return wide.select("sampled", F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(0)).alias("failed")) for n in checks])).alias("x")).select("x.check", "sampled", "x.failed")


def united(graphs: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of several graphs (nodes: node, kind, literal; edges: src, rel, dst).

    Leaves and variables with equal literals are one node, the least id of them; events stay apart.  Edges follow, each once.
    """
    nodes, edges = graphs[0]
    for n, e in graphs[1:]:
        nodes, edges = nodes.unionByName(n), edges.unionByName(e)
    shared = F.col("kind") != "EVENT"
    key = F.when(shared, F.concat_ws("|", "kind", F.lower("literal"))).otherwise(F.concat(F.lit("="), "node"))
    keyed = nodes.distinct().withColumn("k", key)
    least = keyed.groupBy("k").agg(F.min("node").alias("to"), F.min("kind").alias("kind"), F.min("literal").alias("literal"))
    remap = keyed.join(least.select("k", "to"), "k").select("node", "to")
    for c in ("src", "dst"):
        edges = edges.join(remap.select(F.col("node").alias(c), F.col("to").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return least.select(F.col("to").alias("node"), "kind", "literal"), edges.select("src", "rel", "dst").distinct()


def canonical_cid(s: DataFrame, anchor: Column) -> DataFrame:
    """id, cid, canonical: digests of a vector's slots (id, slot, v and what anchor names) and an anchor, each part with its length; the canonical one takes the register band (2) as empty."""
    text = lambda v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", v))), lambda x: x["v"].cast("string")), "")
    whole, plain = text(F.col("v").alias("v")), text(F.when(F.floor(F.col("slot") / 8) == 2, 0).otherwise(F.col("v")).alias("v"))
    part = lambda c: F.concat(F.char_length(c).cast("string"), F.lit(":"), c)
    g = s.groupBy("id").agg(whole.alias("w"), plain.alias("p"), F.first(anchor).alias("a"))
    return g.select("id", F.sha2(F.concat(part(F.col("w")), part(F.col("a"))), 256).alias("cid"), F.sha2(F.concat(part(F.col("p")), part(F.col("a"))), 256).alias("canonical"))


def code_graph(sources: DataFrame) -> DataFrame:
    """src, rel, dst of Python sources (name, code); sources that don't parse give nothing."""
    import ast

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, code in zip(frame["name"], frame["code"], strict=True):
                try:
                    rows += list(_code_edges(ast.parse(code or ""), name))
                except SyntaxError:
                    continue
            yield pd.DataFrame(rows, columns=["src", "rel", "dst"])

    return sources.select("name", "code").mapInPandas(run, "src string, rel string, dst string").distinct()


class Settings:
    """Parameters with their origin: defaults, then a profile, then the environment (PREFIX_NAME), then overrides."""

    def __init__(self, defaults: dict, profile: dict | None = None, prefix: str = "GRAPHLOOM", overrides: dict | None = None) -> None:
        self.values, self.origin = {}, {}
        env = {k: type(v)(os.environ[name]) for k, v in defaults.items() if (name := f"{prefix}_{k.upper()}") in os.environ}
        for origin, source in (("default", defaults), ("profile", profile or {}), ("environment", env), ("override", overrides or {})):
            for k, v in source.items():
                if k not in defaults:
                    raise KeyError(f"{k} is no parameter")
                self.values[k], self.origin[k] = v, origin

    def __getitem__(self, name: str):
        return self.values[name]

    def report(self) -> list[tuple[str, object, str]]:
        return [(k, self.values[k], self.origin[k]) for k in sorted(self.values)]


class Timings:
    """Milliseconds by stage, added up over its runs."""

    def __init__(self) -> None:
        self.total: dict[str, float] = {}

    @contextmanager
    def stage(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.total[name] = self.total.get(name, 0.0) + 1000 * (time.perf_counter() - began)


def q_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of queries that are every 50th vector: dense candidates, parts named in a made question, and their brands as aliases."""
    v = table(spark, sf_dir, "embeddings")
    dense = retrieval.nearest_by_cosine(v, v.where("vec_id % 50 = 0"), 10).select("query_id", F.concat(F.lit("V:"), "vec_id").alias("node"), F.col("score").alias("cosine"), F.abs("score").alias("similarity"))
    p = table(spark, sf_dir, "part").where("p_partkey < 40")
    q = v.where("vec_id % 50 = 0").join(p, F.col("p_partkey") == F.floor(F.col("vec_id") / 50)).select(F.col("vec_id").alias("query_id"), F.concat(F.lit("where is the "), "p_name", F.lit(" kept?")).alias("text"), "p_brand")
    literal = named_in(q, p.select(F.concat(F.lit("P:"), "p_partkey").alias("node"), F.col("p_name").alias("literal")))
    alias = q.join(p.select("p_brand", F.concat(F.lit("P:"), "p_partkey").alias("node")), "p_brand").select("query_id", "node")
    return seeds(dense, literal, alias, 8)


def q_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triples(spark, sf_dir).select(F.col("subject").alias("src"), F.col("property").alias("rel"), F.col("object").alias("dst"))
    nodes = t.select(F.col("src").alias("node")).union(t.select("dst")).distinct()
    return statistics(nodes.select("node", F.substring_index("node", ":", 1).alias("kind")), allowed(t, ["NATION", "REGION", "CUSTOMER"]))


def q_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of the nations, three names at most."""
    t = triples(spark, sf_dir).select(F.col("subject").alias("src"), F.col("property").alias("rel"), F.col("object").alias("dst"))
    return details(table(spark, sf_dir, "nation").select(F.concat(F.lit("N:"), "n_nationkey").alias("node")), t, 3)


def q_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of users with the turns round them."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("place"), F.coalesce("text", F.lit("")).alias("text"), "role")
    return widened(c.where("role = 'user'"), c.select("doc_id", "place", "text")).select("doc_id", "hit", F.md5("text").alias("text"))


def q_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation by balance as a manifest of five."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("session"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"), F.round(F.floor(F.col("c_acctbal")) / 4, 2).alias("salience"))
    return manifest(c, 5)


def q_pronouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer as mentions: by status of one of three kinds, every third a pronoun, named by priority."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("kind"), (F.col("o_orderkey") % 3 == 0).alias("pronoun"))
    return ambiguous_pronouns(o)


def q_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers checked in full (a share of 1): names, segments, balances."""
    c = table(spark, sf_dir, "customer")
    return audited(c, "c_custkey", {"name": F.col("c_name").rlike("^Customer#[0-9]{9}$"), "segment": F.col("c_mktsegment") != "BUILDING", "balance": F.col("c_acctbal") >= 0}, 1.0)


def q_united(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two graphs of parts and of lines that share names, counted by kind and relation."""
    p = table(spark, sf_dir, "part")
    one = (p.select(F.concat(F.lit("a"), "p_partkey").alias("node"), F.lit("LEAF").alias("kind"), F.col("p_name").alias("literal")), p.select(F.concat(F.lit("a"), "p_partkey").alias("src"), F.lit("BRAND").alias("rel"), F.col("p_brand").alias("dst")))
    li = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").join(p, F.col("l_partkey") == F.col("p_partkey"))
    events = li.select(F.concat(F.lit("e"), "l_orderkey").alias("node"), F.lit("EVENT").alias("kind"), F.col("l_returnflag").alias("literal"))
    leaves = li.select(F.concat(F.lit("b"), "l_orderkey").alias("node"), F.lit("LEAF").alias("kind"), F.upper("p_name").alias("literal"))
    two = (events.unionByName(leaves), li.select(F.concat(F.lit("e"), "l_orderkey").alias("src"), F.lit("THEME").alias("rel"), F.concat(F.lit("b"), "l_orderkey").alias("dst")))
    nodes, edges = united([one, two])
    return nodes.groupBy(F.col("kind").alias("what")).agg(F.count("*").alias("n"), F.countDistinct(F.lower("literal")).alias("names")).unionByName(edges.groupBy(F.col("rel").alias("what")).agg(F.count("*").alias("n"), F.countDistinct("dst").alias("names")))


def q_cids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_cid(slots(spark, sf_dir), F.concat(F.lit("label "), F.col("label").cast("string")))


def q_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules made of parts, every fifth of which doesn't parse: their edges, counted by relation."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), "p_partkey").alias("name"), "p_partkey")
    code = F.concat(F.lit("import os\nfrom a import b\nclass C(Base):\n    def run(self):\n        return os.getcwd(), helper("), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(")"), F.lit("\n"))
    return code_graph(p.select("name", code.alias("code"))).groupBy("rel", F.regexp_replace("dst", "^m[0-9]+", "m").alias("dst")).agg(F.count("*").alias("n"))


def distance_counts(rows: DataFrame, queries: DataFrame, prefixes: tuple[int, ...]) -> DataFrame:
    """slots, d, n: how many pairs of a row (id, v: slot values) and another query (query_id, v) differ in d of their first slots.

    Tasks count batches of rows against blocks of queries by matrix products; only counts leave them.
    """
    out = None
    for ids, matrix in retrieval.query_blocks(queries, 4096):

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, matrix: np.ndarray = matrix) -> Iterator[pa.RecordBatch]:
            total = {p: np.zeros(p + 1, np.int64) for p in prefixes}
            for keys, v in retrieval.pieces(batches):
                other = keys[:, None] != ids[None, :]
                same, start = np.zeros(other.shape, np.float32), 0
                for p in sorted(prefixes):
                    same += retrieval.same_values(v[:, start:p], matrix[:, start:p])
                    start = p
                    total[p] += np.bincount((p - same[other]).astype(np.int64), minlength=p + 1)
            for p, n in total.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(p + 1, p, np.int32)), pa.array(np.arange(p + 1, dtype=np.int32)), pa.array(n)], ["slots", "d", "n"])

        part = rows.select("id", "v").mapInArrow(run, "slots int, d int, n long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.sparkSession.createDataFrame([], "slots int, d int, n long")
    return out.groupBy("slots", "d").agg(F.sum("n").alias("n")).where("n > 0")


def q_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors lie within each of six distances of a query (every 50th vector), over its first 16, 32 and 64 slots."""
    values = F.transform("embedding", lambda x: quaternary(x.cast("double")))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), values.alias("v"))
    rows = distance_counts(v, v.where("id % 50 = 0").withColumnRenamed("id", "query_id"), (16, 32, 64))
    near = rows.select("slots", F.explode(F.array(*[F.lit(x / 20) for x in (9, 10, 11, 12, 13, 14)])).alias("share"), "d", "n").where(F.col("d") <= F.col("share") * F.col("slots"))
    return near.groupBy("slots", "share").agg(F.sum("n").alias("pairs"))


QUERIES = {
    "seed_search": q_seeds, "memory_statistics": q_statistics, "entity_details": q_details, "context_widening": q_widened, "manifest_render": q_manifest, "pronoun_ambiguity": q_pronouns,
    "kb_audit": q_audit, "graph_union": q_united, "canonical_cids": q_cids, "code_graph": q_code, "dimension_sweep": q_sweep,
}
_S = "s AS (SELECT id, label, CAST(slot AS INTEGER) AS slot, CASE WHEN x >= 0.1 THEN 1 WHEN x <= -0.1 THEN 2 WHEN abs(x) >= 0.05 THEN 3 ELSE 0 END AS v FROM (SELECT vec_id AS id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS slot FROM embeddings))"
_T3 = "t AS (SELECT 'C:' || c_custkey AS src, 'NATION' AS rel, 'N:' || c_nationkey AS dst FROM customer UNION SELECT 'S:' || s_suppkey, 'NATION', 'N:' || s_nationkey FROM supplier UNION SELECT 'N:' || n_nationkey, 'REGION', 'R:' || n_regionkey FROM nation UNION SELECT 'O:' || o_orderkey, 'CUSTOMER', 'C:' || o_custkey FROM orders)"
ORACLE_SQL = {
    "seed_search": f"""WITH {retrieval._cos('c')}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM c), p AS (SELECT * FROM part WHERE p_partkey < 40), q AS (SELECT vec_id AS query_id, p_name, p_brand FROM embeddings JOIN p ON p_partkey = vec_id // 50 WHERE vec_id % 50 = 0),
a AS (SELECT query_id, 'V:' || vec_id AS node, round(0.6 * CASE WHEN score >= 0.2 THEN score ELSE 0.0 END + 0.4 * abs(score), 6) AS energy, 'dense' AS s FROM n WHERE r <= 10 UNION ALL SELECT query_id, 'P:' || p_partkey, 1.0, 'literal' FROM q JOIN p USING (p_name) UNION ALL SELECT query_id, 'P:' || p_partkey, 1.0, 'alias' FROM q JOIN p USING (p_brand)),
g AS (SELECT query_id, node, max(energy) AS energy, string_agg(DISTINCT s, '+' ORDER BY s) AS sources FROM a GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY energy DESC, node) AS r FROM g) SELECT query_id, node, energy, sources FROM r WHERE r <= 8""",
    "memory_statistics": f"WITH {_T3}, every AS (SELECT src AS node FROM t UNION SELECT dst FROM t UNION SELECT 'O:' || l_orderkey FROM lineitem UNION SELECT 'P:' || l_partkey FROM lineitem UNION SELECT 'S:' || l_suppkey FROM lineitem) SELECT split_part(node, ':', 1) AS kind, count(*) AS n, CAST(sum((SELECT count(*) FROM t WHERE src = node)) AS BIGINT) AS edges_out, CAST(sum((SELECT count(*) FROM t WHERE dst = node)) AS BIGINT) AS edges_in FROM every GROUP BY 1",
    "entity_details": f"WITH {_T3}, b AS (SELECT src AS node, rel, 'out' AS direction, dst AS other FROM t UNION ALL SELECT dst, rel, 'in', src FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY node, rel, direction ORDER BY other) AS r FROM b WHERE starts_with(node, 'N:')) SELECT node, rel, direction, count(*) AS n, string_agg(other, ',' ORDER BY other) FILTER (r <= 3) AS others FROM r GROUP BY ALL",
    "context_widening": "WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations) SELECT u.conv_id AS doc_id, u.turn AS hit, md5(string_agg(x.t, ' ' ORDER BY x.turn)) AS text FROM c u JOIN c x ON x.conv_id = u.conv_id AND x.turn BETWEEN u.turn - 1 AND u.turn + 1 WHERE u.role = 'user' GROUP BY ALL",
    "manifest_render": "WITH c AS (SELECT c_nationkey AS session, c_name, c_mktsegment, round(floor(c_acctbal) / 4, 2) AS s, row_number() OVER (PARTITION BY c_nationkey ORDER BY round(floor(c_acctbal) / 4, 2) DESC, c_name) AS r FROM customer) SELECT session, string_agg('- ' || c_name || ' [' || c_mktsegment || '] ' || printf('%.2f', s), chr(10) ORDER BY r) AS lines FROM c WHERE r <= 5 GROUP BY session",
    "pronoun_ambiguity": """WITH o AS (SELECT o_custkey AS doc, o_orderkey AS seq, o_orderpriority AS name, o_orderstatus AS kind, o_orderkey % 3 = 0 AS pronoun FROM orders) SELECT p.doc, p.seq, max_by(n.name, n.seq) AS referent, count(DISTINCT n.name) > 1 AS ambiguous FROM o p LEFT JOIN o n ON n.doc = p.doc AND n.kind = p.kind AND NOT n.pronoun AND n.seq < p.seq WHERE p.pronoun GROUP BY p.doc, p.seq""",
    "kb_audit": """SELECT 'name' AS "check", count(*) AS sampled, count(*) FILTER (NOT regexp_matches(c_name, '^Customer#[0-9]{9}$')) AS failed FROM customer UNION ALL SELECT 'segment', count(*), count(*) FILTER (c_mktsegment = 'BUILDING') FROM customer UNION ALL SELECT 'balance', count(*), count(*) FILTER (c_acctbal < 0) FROM customer""",
    "graph_union": """WITH li AS (SELECT l_orderkey, l_returnflag, lower(p_name) AS p FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1), nm AS (SELECT lower(p_name) AS p, min('a' || p_partkey) AS id FROM part GROUP BY 1)
SELECT 'LEAF' AS what, count(*) AS n, count(*) AS names FROM nm UNION ALL SELECT 'EVENT', count(DISTINCT l_orderkey), count(DISTINCT lower(l_returnflag)) FROM li UNION ALL SELECT 'BRAND', count(DISTINCT (p_name, p_brand)), count(DISTINCT p_brand) FROM part UNION ALL SELECT 'THEME', count(DISTINCT (l_orderkey, p)), count(DISTINCT p) FROM li""",
    "canonical_cids": f"WITH {_S}, g AS (SELECT id, 'label ' || label AS a, string_agg(v, '' ORDER BY slot) AS w, string_agg(CASE WHEN slot // 8 = 2 THEN 0 ELSE v END, '' ORDER BY slot) AS p FROM s GROUP BY id, label) SELECT id, sha256(length(w) || ':' || w || length(a) || ':' || a) AS cid, sha256(length(p) || ':' || p || length(a) || ':' || a) AS canonical FROM g",
    "code_graph": """WITH n AS (SELECT count(*) AS n FROM part WHERE p_partkey % 5 > 0) SELECT rel, dst, n FROM n, (VALUES ('IMPORTS', 'os'), ('IMPORTS', 'a.b'), ('DEFINES', 'm.C'), ('INHERITS', 'Base'), ('DEFINES', 'm.C.run'), ('CALLS', 'os.getcwd'), ('CALLS', 'helper')) AS v(rel, dst)""",
    "dimension_sweep": f"WITH {_S}, d AS (SELECT q.id AS q, a.id, n, sum(CASE WHEN a.slot < n AND a.v <> q.v THEN 1 ELSE 0 END) AS d FROM s a JOIN s q ON a.slot = q.slot AND a.id <> q.id, (SELECT unnest([16, 32, 64]) AS n) WHERE q.id % 50 = 0 GROUP BY ALL) SELECT n AS slots, CAST(x / 20 AS DOUBLE) AS share, count(*) AS pairs FROM d, (SELECT unnest([9, 10, 11, 12, 13, 14]) AS x) WHERE d <= x / 20 * n GROUP BY ALL",
}
