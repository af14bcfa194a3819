"""Knowledge-base operators over triples: lookup, matching, paths, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.components import components
from graphloom.sources.scratch import fixpoint
from graphloom.sources.tables import table, triples


def match(t: DataFrame, subject: str | None = None, prop: str | None = None, obj: str | None = None) -> DataFrame:
    """Triples that fit the given parts."""
    for name, value in (("subject", subject), ("property", prop), ("object", obj)):
        if value is not None:
            t = t.where(F.col(name) == value)
    return t


def hop(frontier: DataFrame, t: DataFrame, prop: str, column: str = "node") -> DataFrame:
    """frontier with its column moved along a property; distinct."""
    step = t.where(F.col("property") == prop).select(F.col("subject").alias(column), F.col("object").alias("_to"))
    return frontier.join(step, column).drop(column).withColumnRenamed("_to", column).distinct()


def path(t: DataFrame, start: DataFrame, props: list[str]) -> DataFrame:
    """start (node) -> root, node: what the properties lead to, one after another."""
    out = start.select(F.col("node").alias("root"), "node")
    for prop in props:
        out = hop(out, t, prop)
    return out.select("root", "node")


def in_degree(t: DataFrame) -> DataFrame:
    """node, degree, penalty: min(log2(degree + 1), 1.5) above two incoming edges, else 1."""
    d = t.groupBy(F.col("object").alias("node")).agg(F.count("*").alias("degree"))
    return d.withColumn("penalty", F.when(F.col("degree") > 2, F.round(F.least(F.log2(F.col("degree") + 1), F.lit(1.5)), 6)).otherwise(1.0))


def lookup(names: DataFrame, asked: Column, limit: int) -> DataFrame:
    """id, name, source of entities whose name (first) or alias (then) is asked for; one row an entity, ties by id.

    names: id, name, alias.
    """
    direct = names.where(F.lower("name") == F.lower(asked)).select("id", "name", F.lit(0).alias("priority"))
    alias = names.where(F.lower("alias") == F.lower(asked)).select("id", "name", F.lit(1).alias("priority"))
    one = direct.unionByName(alias).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("priority"))).where("n = 1").drop("n")
    return one.orderBy("priority", "id").limit(limit)


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) whose target isn't a node."""
    return edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti")


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rule, n: rows that break an integrity rule (denials: a rule holds where n is 0).

    Domain and range of properties, single-valued properties, part-of without cycles, orders before shipping.
    """
    t = triples(spark, sf_dir)
    kind = lambda c: F.substring_index(c, ":", 1)
    allowed = {"NATION": (("C", "S"), ("N",)), "REGION": (("N",), ("R",)), "CUSTOMER": (("O",), ("C",)), "PART": (("O",), ("P",)), "SUPPLIER": (("O",), ("S",))}
    out = []
    for prop, (domain, range_) in allowed.items():
        of = t.where(F.col("property") == prop)
        out.append(of.where(~kind("subject").isin(*domain)).agg(F.lit(f"domain {prop}").alias("rule"), F.count("*").alias("n")))
        out.append(of.where(~kind("object").isin(*range_)).agg(F.lit(f"range {prop}").alias("rule"), F.count("*").alias("n")))
    for prop in ("NATION", "REGION", "CUSTOMER"):
        many = t.where(F.col("property") == prop).groupBy("subject").agg(F.count("*").alias("k")).where("k > 1")
        out.append(many.agg(F.lit(f"single {prop}").alias("rule"), F.count("*").alias("n")))
    late = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate < o_orderdate")
    out.append(late.agg(F.lit("shipped before ordered").alias("rule"), F.count("*").alias("n")))
    loops = t.alias("a").join(t.alias("b"), (F.col("a.object") == F.col("b.subject")) & (F.col("b.object") == F.col("a.subject")))
    out.append(loops.agg(F.lit("mutual").alias("rule"), F.count("*").alias("n")))
    total = out[0]
    for part in out[1:]:
        total = total.unionByName(part)
    return total


def q_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every nation, by direction."""
    t = triples(spark, sf_dir)
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("N:"), "n_nationkey").alias("node"))
    outgoing = t.join(n, F.col("subject") == F.col("node")).select("node", "property", F.col("object").alias("other"), F.lit("out").alias("direction"))
    incoming = t.join(n, F.col("object") == F.col("node")).select("node", "property", F.col("subject").alias("other"), F.lit("in").alias("direction"))
    return outgoing.unionByName(incoming)


def q_path2(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = table(spark, sf_dir, "customer").select(F.concat(F.lit("C:"), "c_custkey").alias("node"))
    return path(triples(spark, sf_dir), start, ["NATION", "REGION"])


def q_path3(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = table(spark, sf_dir, "orders").select(F.concat(F.lit("O:"), "o_orderkey").alias("node"))
    return path(triples(spark, sf_dir), start, ["CUSTOMER", "NATION", "REGION"])


def q_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by name, then by region as their alias."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("alias"))
    first = names.agg(F.min("alias").alias("a")).first()["a"]
    return lookup(names, F.lit(first.lower()), 50)


def q_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples whose object is nobody's subject, by property."""
    t = triples(spark, sf_dir)
    e = t.select(F.col("subject").alias("src"), F.col("object").alias("dst"), "property")
    return dangling(e, t.select(F.col("subject").alias("node")).distinct()).groupBy("property").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("targets"))


def closure(edges: DataFrame) -> DataFrame:
    """root, node, depth: everything that edges (src, dst) lead to, each pair once with its shortest distance.

    Distances are doubled until they rest: rounds follow the logarithm of the longest path, which has no bound.
    """
    start = edges.select(F.col("src").alias("root"), F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(1))

    def double(now: DataFrame) -> DataFrame:
        on = now.select(F.col("root").alias("node"), F.col("node").alias("to"), F.col("depth").alias("more"))
        longer = now.join(on, "node").select("root", F.col("to").alias("node"), (F.col("depth") + F.col("more")).alias("depth"))
        return now.unionByName(longer).groupBy("root", "node").agg(F.min("depth").alias("depth"))

    return fixpoint(start, double)


def _up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers up to regions; regions in a ring of five, and a chain of the parts' sizes below."""
    t = triples(spark, sf_dir).where("property IN ('NATION', 'REGION')").select(F.col("subject").alias("src"), F.col("object").alias("dst"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("R:"), "r_regionkey").alias("src"), F.concat(F.lit("R:"), (F.col("r_regionkey") + 1) % 5).alias("dst"))
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").alias("k")).distinct()
    chain = sizes.select(F.concat(F.lit("Z:"), "k").alias("src"), F.concat(F.lit("Z:"), F.col("k") + 1).alias("dst"))
    return t.unionByName(r).unionByName(chain)


def q_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitive closure, counted by what is reached."""
    return closure(_up(spark, sf_dir)).groupBy("node").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))


def q_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every node the cycle-bound component that it belongs to, and whether a cycle passes it."""
    return components(_up(spark, sf_dir))


def resolved(values: DataFrame, names: DataFrame) -> DataFrame:
    """value, id: free values as ids: an id itself, else the least id with that alias, else with that label, else the value as it stands.

    names: id, name, alias.  Case and outer spaces don't matter.
    """
    v = values.select("value").distinct().withColumn("k", F.lower(F.trim("value")))
    of = lambda c, out: names.where(F.col(c).isNotNull()).groupBy(F.lower(F.trim(c)).alias("k")).agg(F.min("id").alias(out))
    found = v.join(names.select(F.lower("id").alias("k"), F.col("id").alias("own")).distinct(), "k", "left").join(of("alias", "by_alias"), "k", "left").join(of("name", "by_name"), "k", "left")
    return found.select("value", F.coalesce("own", "by_alias", "by_name", "value").alias("id"))


def normal_property(name: Column) -> Column:
    """Property names in upper case with underscores."""
    return F.regexp_replace(F.upper(F.trim(name)), r"[\s-]+", "_")


def typed_path(t: DataFrame, names: DataFrame, start: DataFrame, props: list[str]) -> DataFrame:
    """root, node: as `path`, with property names in any spelling and objects that are names instead of ids resolved."""
    out = start.select(F.col("node").alias("root"), "node")
    for prop in props:
        step = t.where(normal_property(F.col("property")) == normal_property(F.lit(prop))).select(F.col("subject").alias("node"), F.col("object").alias("value"))
        moved = out.join(step, "node").select("root", "value").distinct()
        out = moved.join(resolved(moved, names), "value").select("root", F.col("id").alias("node")).distinct()
    return out


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("N:"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("land "), "n_nationkey").alias("alias"))
    return n.unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("R:"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("alias")))


def q_typed_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to regions where the store holds names, aliases and ids of nations, in several spellings of the property."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 4
    obj = F.when(k == 0, F.concat(F.lit("N:"), "n_nationkey")).when(k == 1, F.concat(F.lit(" Land "), "n_nationkey")).when(k == 2, F.lower("n_name")).otherwise(F.concat(F.lit("nowhere "), "c_custkey"))
    t = c.select(F.concat(F.lit("C:"), "c_custkey").alias("subject"), F.when(k == 1, "home nation").otherwise("HOME_NATION").alias("property"), obj.alias("object"))
    r = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("N:"), "n_nationkey").alias("subject"), F.lit("in-region").alias("property"), F.col("r_name").alias("object"))
    start = table(spark, sf_dir, "customer").select(F.concat(F.lit("C:"), "c_custkey").alias("node"))
    return typed_path(t.unionByName(r), _names(spark, sf_dir), start, ["Home Nation", "IN_REGION"])


def literal_index(nodes: DataFrame) -> DataFrame:
    """node, word: words of literals (node, literal) that are worth a lookup: three letters or more, no stopword, no number."""
    from graphloom.operators.retrieval import STOPWORDS

    words = nodes.select("node", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("literal"), F.lit("[a-z0-9_]+"), F.lit(0)))).alias("word"))
    return words.where((F.char_length("word") >= 3) & ~F.col("word").isin(STOPWORDS) & ~F.col("word").rlike("^[0-9]+$"))


def literal_lookup(index: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, node, how: nodes whose words are the one asked for (exact), else its plural or singular (number), else begin with it, four letters at least (prefix).

    Words meet by equality: a word is also known by its stem and by its beginnings of the lengths that are asked for.
    """
    a = asked.select(F.lower("asked").alias("asked")).distinct()
    stem = lambda w: F.regexp_replace(w, "(?:es|s)$", "")
    exact = index.join(a, index["word"] == a["asked"]).select("asked", "node", F.lit(0).alias("rank"))
    number = index.withColumn("k", stem(F.col("word"))).join(a.withColumn("k", stem(F.col("asked"))), "k").where("word <> asked").select("asked", "node", F.lit(1).alias("rank"))
    lengths = a.where(F.char_length("asked") >= 4).select(F.char_length("asked").alias("n")).distinct()
    heads = index.join(F.broadcast(lengths), F.char_length("word") > F.col("n")).select("node", F.substring(F.col("word"), F.lit(1), F.col("n")).alias("asked"))
    prefix = heads.join(a, "asked").select("asked", "node", F.lit(2).alias("rank"))
    every = exact.unionByName(number).unionByName(prefix)
    best = every.groupBy("asked").agg(F.min("rank").alias("rank"))
    how = F.element_at(F.array(F.lit("exact"), F.lit("number"), F.lit("prefix")), F.col("rank") + 1)
    return every.join(best, ["asked", "rank"]).select("asked", "node", how.alias("how")).distinct()


def fetched(asked: DataFrame, local: DataFrame, fallback: DataFrame) -> DataFrame:
    """Every asked id (node) with its local row, else that of the fallback store; source tells which, or none."""
    cols = [c for c in local.columns if c != "node"]
    of = lambda df, p: df.select("node", F.struct(*cols).alias(p))
    j = asked.select("node").distinct().join(of(local, "l"), "node", "left").join(of(fallback, "f"), "node", "left")
    best = F.coalesce("l", "f")
    return j.select("node", *[best[c].alias(c) for c in cols], F.when(F.col("l").isNotNull(), "local").when(F.col("f").isNotNull(), "global").otherwise("none").alias("source"))


def bridged(asked: DataFrame, local: DataFrame, fallback: DataFrame) -> DataFrame:
    """The local store with the rows that asked ids have in the fallback store alone."""
    missing = fallback.join(asked.select("node").distinct(), "node", "left_semi").join(local, "node", "left_anti")
    return local.unionByName(missing.select(*local.columns))


def q_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by words of their names, asked for whole, in the plural and by their beginnings."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.concat_ws(" ", "p_name", F.lit("the 12")).alias("literal"))
    asked = spark.createDataFrame([("red",), ("bolts",), ("widg",), ("the",), ("gear",), ("12",)], "asked string")
    return literal_lookup(literal_index(p), asked).groupBy("asked", "how").agg(F.count("*").alias("n"), F.min("node").alias("first"))


def q_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers asked for by key: customers are the local store, suppliers the global one; and the store after a bridge."""
    local = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("node"), F.col("c_name").alias("name"))
    other = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("name"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    return fetched(asked, local, other).join(bridged(asked, local, other).select("node", F.col("name").alias("bridged")), "node", "left")


def stored_dangling(edges: DataFrame, nodes: DataFrame, exempt: tuple[str, ...]) -> DataFrame:
    """src, rel, dst, why: edges whose target is missing, unless the relation is exempt, and those from nodes whose stored id isn't the one their content gives.

    nodes: node, cid, content.
    """
    missing = edges.where(~F.col("rel").isin(*exempt)).join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "rel", "dst", F.lit("missing").alias("why"))
    stale = nodes.where(F.col("cid") != F.sha2("content", 256)).select(F.col("node").alias("src"))
    return missing.unionByName(edges.join(stale, "src", "left_semi").select("src", "rel", "dst", F.lit("stale").alias("why")))


def q_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from orders to customers where some customers are gone and some were edited after their id was taken."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 11 > 0")
    nodes = c.select(F.concat(F.lit("C:"), "c_custkey").alias("node"), F.sha2(F.concat("c_name", F.when(F.col("c_custkey") % 13 == 0, "old").otherwise("")), 256).alias("cid"), F.col("c_name").alias("content"))
    e = table(spark, sf_dir, "orders").select(F.concat(F.lit("O:"), "o_orderkey").alias("src"), F.when(F.col("o_orderkey") % 4 == 0, "BRIDGE").otherwise("CUSTOMER").alias("rel"), F.concat(F.lit("C:"), "o_custkey").alias("dst"))
    back = c.select(F.concat(F.lit("C:"), "c_custkey").alias("src"), F.lit("SELF").alias("rel"), F.concat(F.lit("C:"), "c_custkey").alias("dst"))
    return stored_dangling(e.unionByName(back), nodes, ("BRIDGE",)).groupBy("rel", "why", "dst").agg(F.count("*").alias("n"))


QUERIES = {
    "triples_build": triples,
    "triple_match": lambda s, d: match(triples(s, d), prop="NATION", obj="N:7"),
    "kb_counts": lambda s, d: triples(s, d).groupBy("property").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"), F.countDistinct("object").alias("objects")),
    "neighbors": q_neighbors,
    "path_2hop": q_path2,
    "path_3hop": q_path3,
    "name_lookup": q_lookup,
    "reverse_degree": lambda s, d: in_degree(triples(s, d)),
    "dangling_edges": q_dangling,
    "hypernym_closure": q_reachable,
    "cycle_check": q_cycle,
    "integrity_rules": violations,
    "path_resolved": q_typed_path,
    "literal_lookup": q_literals,
    "batch_fetch": q_fetched,
    "dangling_stored": q_stored,
}
T_SQL = """t AS (SELECT DISTINCT * FROM (SELECT 'C:' || c_custkey AS subject, 'NATION' AS property, 'N:' || c_nationkey AS object FROM customer UNION ALL SELECT 'S:' || s_suppkey, 'NATION', 'N:' || s_nationkey FROM supplier
UNION ALL SELECT 'N:' || n_nationkey, 'REGION', 'R:' || n_regionkey FROM nation UNION ALL SELECT 'O:' || o_orderkey, 'CUSTOMER', 'C:' || o_custkey FROM orders
UNION ALL SELECT 'O:' || l_orderkey, 'PART', 'P:' || l_partkey FROM lineitem UNION ALL SELECT 'O:' || l_orderkey, 'SUPPLIER', 'S:' || l_suppkey FROM lineitem))"""
_UP = f"""WITH RECURSIVE {T_SQL}, e AS (SELECT subject AS src, object AS dst FROM t WHERE property IN ('NATION', 'REGION') UNION SELECT 'R:' || r_regionkey, 'R:' || ((r_regionkey + 1) % 5) FROM region UNION SELECT 'Z:' || p_size, 'Z:' || (p_size + 1) FROM part),
up AS (SELECT src AS root, dst AS node, 1 AS depth FROM e UNION SELECT up.root, e.dst, up.depth + 1 FROM up JOIN e ON e.src = up.node WHERE up.depth < 80), least_depth AS (SELECT root, node, min(depth) AS depth FROM up GROUP BY ALL)"""


def _rules() -> str:
    allowed = {"NATION": ("'C', 'S'", "'N'"), "REGION": ("'N'", "'R'"), "CUSTOMER": ("'O'", "'C'"), "PART": ("'O'", "'P'"), "SUPPLIER": ("'O'", "'S'")}
    parts = [f"SELECT 'domain {p}' AS rule, count(*) AS n FROM t WHERE property = '{p}' AND split_part(subject, ':', 1) NOT IN ({a})" for p, (a, _) in allowed.items()]
    parts += [f"SELECT 'range {p}', count(*) FROM t WHERE property = '{p}' AND split_part(object, ':', 1) NOT IN ({b})" for p, (_, b) in allowed.items()]
    parts += [f"SELECT 'single {p}', count(*) FROM (SELECT subject FROM t WHERE property = '{p}' GROUP BY subject HAVING count(*) > 1)" for p in ("NATION", "REGION", "CUSTOMER")]
    parts += ["SELECT 'shipped before ordered', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate", "SELECT 'mutual', count(*) FROM t a JOIN t b ON a.object = b.subject AND b.object = a.subject"]
    return f"WITH {T_SQL} " + " UNION ALL ".join(parts)


ORACLE_SQL = {
    "triples_build": f"WITH {T_SQL} SELECT * FROM t",
    "triple_match": f"WITH {T_SQL} SELECT * FROM t WHERE property = 'NATION' AND object = 'N:7'",
    "kb_counts": f"WITH {T_SQL} SELECT property, count(*) AS n, count(DISTINCT subject) AS subjects, count(DISTINCT object) AS objects FROM t GROUP BY property",
    "neighbors": f"WITH {T_SQL}, n AS (SELECT 'N:' || n_nationkey AS node FROM nation) SELECT node, property, object AS other, 'out' AS direction FROM t JOIN n ON subject = node UNION ALL SELECT node, property, subject, 'in' FROM t JOIN n ON object = node",
    "path_2hop": "SELECT 'C:' || c_custkey AS root, 'R:' || n_regionkey AS node FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "path_3hop": "SELECT 'O:' || o_orderkey AS root, 'R:' || n_regionkey AS node FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "name_lookup": "WITH n AS (SELECT n_nationkey AS id, n_name AS name, r_name AS alias FROM nation JOIN region ON n_regionkey = r_regionkey), a AS (SELECT min(alias) AS a FROM n) SELECT id, name, CASE WHEN lower(name) = lower(a) THEN 0 ELSE 1 END AS priority FROM n, a WHERE lower(name) = lower(a) OR lower(alias) = lower(a)",
    "reverse_degree": f"WITH {T_SQL}, d AS (SELECT object AS node, count(*) AS degree FROM t GROUP BY object) SELECT *, CASE WHEN degree > 2 THEN round(least(log2(degree + 1), 1.5), 6) ELSE 1.0 END AS penalty FROM d",
    "dangling_edges": f"WITH {T_SQL} SELECT property, count(*) AS n, count(DISTINCT object) AS targets FROM t WHERE object NOT IN (SELECT subject FROM t) GROUP BY property",
    "hypernym_closure": _UP + " SELECT node, count(*) AS n, max(depth) AS depth FROM least_depth GROUP BY node",
    "cycle_check": _UP + ", m AS (SELECT a.root, a.node FROM least_depth a JOIN least_depth b ON a.root = b.node AND a.node = b.root), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT n.node, coalesce(min(m.node), n.node) AS component, greatest(count(m.node), 1) AS members, count(m.node) > 0 AS cyclic FROM n LEFT JOIN m ON m.root = n.node GROUP BY n.node",
    "integrity_rules": _rules(),
    "path_resolved": "SELECT 'C:' || c_custkey AS root, 'R:' || n_regionkey AS node FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 4 < 3",
    "literal_lookup": """WITH w AS (SELECT DISTINCT p_partkey AS node, unnest(string_split(lower(p_name), ' ')) AS word FROM part), a AS (SELECT unnest(['red', 'bolts', 'widg', 'gear']) AS asked),
e AS (SELECT asked, node, 0 AS r FROM w JOIN a ON word = asked UNION SELECT asked, node, 1 FROM w JOIN a ON regexp_replace(word, '(es|s)$', '') = regexp_replace(asked, '(es|s)$', '') AND word <> asked UNION SELECT asked, node, 2 FROM w JOIN a ON length(asked) >= 4 AND length(word) > length(asked) AND starts_with(word, asked)),
b AS (SELECT asked, min(r) AS r FROM e GROUP BY asked) SELECT asked, ['exact', 'number', 'prefix'][r + 1] AS how, count(DISTINCT node) AS n, min(node) AS first FROM e JOIN b USING (asked, r) GROUP BY asked, r""",
    "batch_fetch": """WITH a AS (SELECT c_custkey AS node, c_custkey % 3 > 0 AS own, c_name, s_name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey) SELECT node, CASE WHEN own THEN c_name ELSE s_name END AS name, CASE WHEN own THEN 'local' WHEN s_name IS NOT NULL THEN 'global' ELSE 'none' END AS source, CASE WHEN own THEN c_name ELSE s_name END AS bridged FROM a""",
    "dangling_stored": """SELECT 'CUSTOMER' AS rel, 'missing' AS why, 'C:' || o_custkey AS dst, count(*) AS n FROM orders WHERE o_orderkey % 4 > 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 > 0) GROUP BY o_custkey
UNION ALL SELECT 'SELF', 'stale', 'C:' || c_custkey, 1 FROM customer WHERE c_custkey % 11 > 0 AND c_custkey % 13 = 0""",
}
