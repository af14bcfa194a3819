"""Sources and sinks: entity dumps, the triple store, versioned nodes and resumable runs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.sources.scratch import cut, drop
from graphloom.sources.tables import table

_VALUE = "map<string, struct<language: string, value: string>>"
_CLAIM = "map<string, array<struct<mainsnak: struct<datavalue: struct<value: struct<id: string>>>>>>"
DUMP_SCHEMA = f"id string, labels {_VALUE}, descriptions {_VALUE}, aliases map<string, array<struct<language: string, value: string>>>, claims {_CLAIM}"
#: Properties kept, with their names.
PROPERTIES = {
    "P31": "INSTANCE_OF", "P279": "SUBCLASS_OF", "P17": "COUNTRY", "P36": "CAPITAL", "P50": "AUTHOR", "P19": "PLACE_OF_BIRTH", "P27": "CITIZENSHIP",
    "P800": "NOTABLE_WORK", "P106": "OCCUPATION", "P131": "LOCATED_IN", "P159": "HEADQUARTERS", "P112": "FOUNDED_BY", "P166": "AWARD_RECEIVED",
}
#: Classes (of P31) that decide a category, tested in this order.
CATEGORIES = (
    ("human", ("Q5",)),
    ("location", ("Q2221906", "Q515", "Q6256", "Q3624078", "Q82794", "Q486972", "Q532")),
    ("organization", ("Q43229", "Q4830453", "Q3918", "Q7837", "Q7278", "Q327333")),
    ("creative_work", ("Q386724", "Q7725634", "Q11424", "Q571", "Q2188189", "Q482994", "Q2431196")),
)
#: A record of no category is kept if it has one of these.
KEEPING = ("P17", "P36", "P50", "P19", "P800")


def read_dump(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Records of a JSON-lines or JSON-array dump (plain, gz or bz2): brackets, trailing commas and broken lines are passed over."""
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), r",\s*$", "").alias("line")).where("line NOT IN ('', '[', ']')")
    rows = lines.select(F.from_json("line", DUMP_SCHEMA, {"mode": "PERMISSIVE"}).alias("r")).select("r.*").where("id IS NOT NULL")
    return rows.limit(most) if most is not None else rows


def category(classes: Column) -> Column:
    out = F.lit("other")
    for name, members in reversed(CATEGORIES):
        out = F.when(F.arrays_overlap(classes, F.array(*map(F.lit, members))), name).otherwise(out)
    return out


def entities(dump: DataFrame, language: str = "en") -> DataFrame:
    """id, label, description, aliases, category of the records; a record without a label in the language is called by its id."""
    text = lambda c: F.col(c)[language]["value"]
    classes = F.transform(F.coalesce(F.col("claims")["P31"], F.array()), lambda c: c["mainsnak"]["datavalue"]["value"]["id"])
    aliases = F.array_distinct(F.transform(F.coalesce(F.col("aliases")[language], F.array()), lambda a: a["value"]))
    return dump.select("id", F.coalesce(text("labels"), F.col("id")).alias("label"), text("descriptions").alias("description"), aliases.alias("aliases"), category(classes).alias("category"))


def salient(dump: DataFrame) -> DataFrame:
    """The records worth keeping: those of a category, and others with a telling property."""
    classes = F.transform(F.coalesce(F.col("claims")["P31"], F.array()), lambda c: c["mainsnak"]["datavalue"]["value"]["id"])
    telling = F.arrays_overlap(F.coalesce(F.map_keys("claims"), F.array().cast("array<string>")), F.array(*map(F.lit, KEEPING)))
    return dump.where((category(classes) != "other") | telling)


def claims(dump: DataFrame) -> DataFrame:
    """subject, property, name, object of the kept claims whose value is another record; distinct."""
    rows = dump.select(F.col("id").alias("subject"), F.explode("claims").alias("property", "c")).select("subject", "property", F.explode("c").alias("c"))
    names = F.create_map(*[F.lit(x) for pair in PROPERTIES.items() for x in pair])
    out = rows.select("subject", "property", names[F.col("property")].alias("name"), F.col("c.mainsnak.datavalue.value.id").alias("object"))
    return out.where("name IS NOT NULL AND object IS NOT NULL").distinct()


def write_store(dump: DataFrame, path: str, buckets: int = 16) -> None:
    """The dump as three tables: nodes, aliases and triples (partitioned by property, so that a path reads only its properties).

    The dump is parsed once, into the scratch folder.
    """
    dump = cut(salient(dump), "dump")
    nodes = entities(dump)
    nodes.drop("aliases").write.mode("overwrite").parquet(f"{path}/nodes")
    nodes.select("id", F.explode("aliases").alias("alias")).write.mode("overwrite").parquet(f"{path}/aliases")
    claims(dump).repartition(buckets, "subject").write.mode("overwrite").partitionBy("property").parquet(f"{path}/triples")
    drop(dump)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Latest row of each key by order; nulls of a newer row keep what an older one had.

    Rows of one order go by their content, the new table's before the old one's, so the result doesn't depend on how rows lie.
    """
    every = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in every.columns if c not in (key, order, "_new")]
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("_new"), *[F.desc_nulls_last(c) for c in rest])
    frame = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = every.select(key, order, *[F.first(c, ignorenulls=True).over(frame).alias(c) for c in rest], F.row_number().over(w).alias("_n"))
    return filled.where("_n = 1").drop("_n")


def remaining(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items of a resumed run that aren't done yet."""
    return items.join(done.select(key), key, "left_anti")


def commit_run(done: DataFrame, path: str, run: str) -> None:
    """Record finished items: a part is written beside the others and counts only once Spark has marked it as complete."""
    done.write.mode("overwrite").parquet(f"{path}/{run}")


class Passages:
    """Passages (passage_id, doc_id, start, stop, text, granularity, parent, seq) with their states, as tables that are only added to."""

    def __init__(self, passages: DataFrame, states: DataFrame | None = None) -> None:
        if not {"passage_id", "doc_id", "start", "stop", "text"} <= set(passages.columns):
            raise ValueError("passages need passage_id, doc_id, start, stop and text")
        self.rows, self.states = passages.where("start <= stop"), states

    def by(self, **values) -> DataFrame:
        """Passages whose columns have the given values: by id, document, granularity or parent."""
        out = self.rows
        for column, value in values.items():
            out = out.where(F.col(column) == value)
        return out

    def at(self, asked: DataFrame) -> DataFrame:
        """doc_id, offset, passage_id: the passages that hold a place (asked: doc_id, offset) of their document, the start included, the end not."""
        held = self.rows.select("doc_id", "passage_id", "start", "stop")
        return asked.join(held, "doc_id").where("start <= offset AND offset < stop").select("doc_id", "offset", "passage_id")

    def in_state(self, status: str) -> DataFrame:
        """Passages whose latest state (passage_id, status, seq) is this one."""
        latest = self.states.groupBy("passage_id").agg(F.max_by("status", "seq").alias("status")).where(F.col("status") == status)
        return self.rows.join(latest.select("passage_id"), "passage_id", "left_semi")

    def children(self, parents: DataFrame) -> DataFrame:
        """Passages whose parent is one of parents (passage_id)."""
        return self.rows.join(parents.select(F.col("passage_id").alias("parent")), "parent", "left_semi")


class ContentStore:
    """Payloads by the digest of their text; what is read is checked against its key."""

    @staticmethod
    def put(payloads: DataFrame, column: str = "payload") -> DataFrame:
        """cid, payload: each different payload once."""
        return payloads.select(F.sha2(F.col(column), 256).alias("cid"), F.col(column).alias("payload")).dropDuplicates(["cid"])

    @staticmethod
    def get(store: DataFrame, asked: DataFrame) -> DataFrame:
        """cid, payload, sound of the asked cids that the store has."""
        return store.join(asked.select("cid").distinct(), "cid", "left_semi").withColumn("sound", F.sha2("payload", 256) == F.col("cid"))


def report(rows: DataFrame, columns: list[str], style: str = "markdown") -> str:
    """A small table (a thousand rows at most) as Markdown or LaTeX text."""
    found = rows.select(*columns).limit(1001).collect()
    if len(found) > 1000:
        raise ValueError("a report has a thousand rows at most")
    body = [[("" if v is None else str(v)) for v in r] for r in found]
    if style == "latex":
        escape = lambda v: re.sub(r"([&%$#_{}])", r"\\\1", v)
        lines = [" & ".join(map(escape, r)) + r" \\" for r in [columns, *body]]
        return "\n".join([r"\begin{tabular}{" + "l" * len(columns) + "}", lines[0], r"\hline", *lines[1:], r"\end{tabular}"])
    return "\n".join("| " + " | ".join(r) + " |" for r in [columns, ["---"] * len(columns), *body])


def q_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in passages of 500 characters: which one holds the middle of a document, its parent's other ones, and how many are done."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("n", F.char_length("t")).where("n > 0")
    p = d.select("doc_id", "t", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 500).cast("int"))).alias("k"))
    p = p.select((F.col("doc_id") * 1_000_000 + F.col("k")).alias("passage_id"), "doc_id", (F.col("k") * 500).alias("start"), F.least(F.col("k") * 500 + 500, F.col("n")).alias("stop"), F.substring(F.col("t"), F.col("k") * 500 + 1, F.lit(500)).alias("text"), (F.col("doc_id") * 1_000_000 + F.floor(F.col("k") / 4)).alias("parent"))
    states = p.select("passage_id", F.explode(F.array(F.struct(F.lit("new").alias("status"), F.lit(0).alias("seq")), F.struct(F.when(F.col("passage_id") % 3 > 0, "done").otherwise("failed").alias("status"), F.lit(1).alias("seq")))).alias("s")).select("passage_id", "s.*")
    store = Passages(p, states)
    held = store.at(d.select("doc_id", F.floor(F.col("n") / 2).alias("offset")))
    done = store.in_state("done").groupBy("doc_id").agg(F.count("*").alias("done"), F.sum(F.char_length("text")).alias("chars"))
    family = store.children(p.where("passage_id % 1000000 = 0").select("passage_id")).groupBy("doc_id").agg(F.count("*").alias("first_family"))
    return held.select("doc_id", "passage_id").join(done, "doc_id", "left").join(family, "doc_id", "left").fillna(0)


def q_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' descriptions stored by content, and read with one payload in nine spoilt."""
    p = table(spark, sf_dir, "part").select(F.concat_ws("|", "p_name", "p_brand").alias("payload"))
    store = ContentStore.put(p)
    spoilt = store.withColumn("payload", F.when(F.col("payload").endswith("9"), F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return ContentStore.get(spoilt, store).select("cid", "sound")


def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with edits of every fourth: a new balance, no new segment."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lit(1).alias("version"), "c_acctbal", "c_mktsegment")
    new = c.where("c_custkey % 4 = 0").select("c_custkey", F.lit(2).alias("version"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"))
    return upsert(c, new, "c_custkey", "version")


def q_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that a run of every third customer has left, by status."""
    o = table(spark, sf_dir, "orders")
    done = o.where("o_custkey % 3 = 0").select("o_orderkey")
    return remaining(o, done, "o_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("left"))


QUERIES = {"passage_store": q_passages, "content_store": q_content, "node_upsert": q_upsert, "resume_run": q_resume}
ORACLE_SQL = {
    "passage_store": """WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents WHERE length(coalesce(text, '')) > 0), p AS (SELECT doc_id, n, unnest(range((n - 1) // 500 + 1)) AS k FROM d)
SELECT doc_id, doc_id * 1000000 + (n // 2) // 500 AS passage_id, count(*) FILTER ((doc_id * 1000000 + k) % 3 > 0) AS done, CAST(coalesce(sum(least(500, n - k * 500)) FILTER ((doc_id * 1000000 + k) % 3 > 0), 0) AS BIGINT) AS chars, count(*) FILTER (k < 4) AS first_family FROM p GROUP BY doc_id, n""",
    "content_store": "SELECT DISTINCT sha256(p_name || '|' || p_brand) AS cid, NOT ends_with(p_brand, '9') AS sound FROM part",
    "node_upsert": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END AS version, c_acctbal + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS c_acctbal, c_mktsegment FROM customer",
    "resume_run": "SELECT o_orderstatus, count(*) AS left FROM orders WHERE o_custkey % 3 > 0 GROUP BY o_orderstatus",
}
