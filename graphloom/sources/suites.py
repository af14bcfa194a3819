"""Samples of known benchmark suites and statements of known data sets, each from the shape in which it is published."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.text import token_estimate
from graphloom.sources.scratch import cut
from graphloom.sources.tables import table

#: How a question with options is to be answered.
CHOICE_RULES = "State the reason in a sentence or two, then end with a line of its own: 'Answer: X', where X is the letter."


def _sample(rows: DataFrame, suite: str, id_: str, prompt: Column, context: Column, gold: Column, **more: Column) -> DataFrame:
    """suite, id, prompt, context, gold, tokens, more (map of other parts); missing texts are empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    extras = F.create_map(*[x for k, c in more.items() for x in (F.lit(k), text(c))]) if more else F.create_map().cast("map<string,string>")
    out = rows.select(F.lit(suite).alias("suite"), F.col(id_).cast("string").alias("id"), text(prompt).alias("prompt"), text(context).alias("context"), text(gold).alias("gold"), extras.alias("more"))
    return out.withColumn("tokens", F.greatest(token_estimate(F.col("prompt")), F.lit(1)).cast("long"))


def humaneval(rows: DataFrame) -> DataFrame:
    """Samples of rows (task_id, prompt, canonical_solution, entry_point, test): the prompt is code, gold its solution."""
    return _sample(rows, "humaneval", "task_id", F.col("prompt"), F.lit(""), F.col("canonical_solution"), entry_point=F.col("entry_point"), test_code=F.col("test"))


def arc(rows: DataFrame) -> DataFrame:
    """Samples of rows (id, question, choices: struct of the arrays text and label, answerKey): options by letter below the question; gold is the letter, gold_text its option (the first, if no label is like it)."""
    labels, texts = F.col("choices.label"), F.col("choices.text")
    listed = F.array_join(F.zip_with(labels, texts, lambda a, b: F.concat(F.lit("("), a, F.lit(") "), b)), "\n")
    place = F.greatest(F.array_position(labels, F.col("answerKey")) - 1, F.lit(0)).cast("int")
    return _sample(rows, "arc_science", "id", F.concat("question", F.lit("\n\nChoices:\n"), listed, F.lit(f"\n\n{CHOICE_RULES}")), F.lit(""), F.col("answerKey"), gold_text=F.get(texts, place))


def musique(rows: DataFrame) -> DataFrame:
    """Samples of rows (id, question, paragraphs: array of structs paragraph_text and is_supporting, answer): the context holds supporting paragraphs first, then the others, numbered as documents."""
    support = lambda p: F.coalesce(p["is_supporting"], F.lit(False))
    ordered = F.concat(F.filter("paragraphs", support), F.filter("paragraphs", lambda p: ~support(p)))
    context = F.array_join(F.transform(ordered, lambda p, k: F.concat(F.lit("Document ["), (k + 1).cast("string"), F.lit("]: "), p["paragraph_text"])), "\n\n")
    return _sample(rows, "musique", "id", F.col("question"), context, F.col("answer"), supporting=F.size(F.filter("paragraphs", support)))


def strided(rows: DataFrame, order: str, most: int) -> DataFrame:
    """`most` rows evenly spaced in the order of a column without ties, from the first on; all rows if there are no more.

    Row k of n is taken if some i below `most` has floor(i * n / most) = k.  Places are dealt by ranges of the column.
    """
    parts = cut(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "parts")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    w = Window.orderBy("_part")
    before = sizes.select("_part", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    placed = parts.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1).join(F.broadcast(before), "_part")
    k, n = F.col("_k") + F.col("_before"), F.col("_all")
    first = F.call_function("div", k * most + n - 1, n)  # the least i whose row is k or later
    return placed.where((n <= most) | (first * n < (k + 1) * most)).select(*rows.columns)


def _parts(text: Column, mark: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), mark), lambda s: F.trim(s)), lambda s: F.char_length(s) > 3)


def _statements(rows: DataFrame, dataset: str, key: str, found: Column) -> DataFrame:
    """dataset, text, formula: each different statement once (found: array of structs text and formula), with what came with it at its first place by key."""
    every = rows.select(F.col(key).alias("_key"), F.posexplode(found).alias("_at", "_s")).select("_key", "_at", F.trim("_s.text").alias("text"), F.trim(F.coalesce("_s.formula", F.lit(""))).alias("formula"))
    firsts = every.where(F.char_length("text") > 3).groupBy("text").agg(F.min_by("formula", F.struct("_key", "_at")).alias("formula"))
    return firsts.select(F.lit(dataset).alias("dataset"), "text", "formula")


def _plain(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(t.alias("text"), F.lit("").alias("formula")))


def folio(rows: DataFrame, key: str = "example_id") -> DataFrame:
    """Premises and conclusions with their formulas, of rows (key, premises, premises-FOL: arrays; conclusion, conclusion-FOL); a missing formula is empty."""
    pairs = F.zip_with("premises", F.coalesce("premises-FOL", F.array().cast("array<string>")), lambda t, f: F.struct(t.alias("text"), f.alias("formula")))
    last = F.array(F.struct(F.col("conclusion").alias("text"), F.col("conclusion-FOL").alias("formula")))
    return _statements(rows, "folio", key, F.concat(F.filter(pairs, lambda p: p["text"].isNotNull()), last))


def proofwriter(rows: DataFrame, key: str = "id") -> DataFrame:
    """Facts and rules of theories, and questions, of rows (key, theory, question)."""
    return _statements(rows, "proofwriter", key, _plain(F.concat(_parts(F.col("theory"), r"\."), F.array(F.coalesce("question", F.lit(""))))))


def babi(rows: DataFrame, key: str = "id") -> DataFrame:
    """Lines of stories without their numbers, and questions, of rows (key, passage, question)."""
    lines = F.transform(F.split(F.coalesce("passage", F.lit("")), "\n"), lambda s: F.regexp_replace(F.trim(s), r"^[0-9]\S*(?:\s+|$)", ""))
    return _statements(rows, "babi", key, _plain(F.concat(lines, F.array(F.coalesce("question", F.lit(""))))))


def clutrr(rows: DataFrame, key: str = "id") -> DataFrame:
    """Sentences of stories of kinship without the brackets around names, of rows (key, sentence1)."""
    return _statements(rows, "clutrr", key, _plain(_parts(F.translate("sentence1", "[]", ""), r"\.")))


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of three suites made of parts and their suppliers in each suite's shape."""
    p = table(spark, sf_dir, "part")
    code = p.select(F.concat(F.lit("Task/"), "p_partkey").alias("task_id"), F.format_string("def part_%d(x):\n", "p_partkey").alias("prompt"), F.format_string("    return x + %d\n", "p_size").alias("canonical_solution"), F.format_string("part_%d", "p_partkey").alias("entry_point"), F.lit(None).cast("string").alias("test"))
    choices = F.struct(F.array("p_name", "p_brand", "p_type").alias("text"), F.array(*map(F.lit, "ABC")).alias("label"))
    options = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("Which is the brand of "), "p_name", F.lit("?")).alias("question"), choices.alias("choices"), F.when(F.col("p_partkey") % 5 > 0, "B").otherwise("E").alias("answerKey"))
    say = lambda c, s: F.struct(F.col(c).alias("paragraph_text"), s.alias("is_supporting"))
    hops = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("question"), F.array(say("p_name", F.lit(False)), say("p_brand", F.col("p_partkey") % 2 == 0), say("p_type", F.lit(True))).alias("paragraphs"), F.col("p_brand").alias("answer"))
    every = reduce(DataFrame.unionByName, [humaneval(code), arc(options), musique(hops)])
    return every.select("suite", "id", F.md5("prompt").alias("prompt"), F.md5("context").alias("context"), "gold", "tokens", F.concat_ws("|", *[F.coalesce(F.col("more")[k], F.lit("-")) for k in ("entry_point", "test_code", "gold_text", "supporting")]).alias("more"))


def q_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of four data sets made of nations, customers and orders in each one's shape."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    logic = n.select(F.col("n_nationkey").alias("example_id"), F.array(F.concat("n_name", F.lit(" lies in "), "r_name"), F.concat("r_name", F.lit(" is large "))).alias("premises"), F.array(F.concat(F.lit("In("), "n_name", F.lit(")"))).alias("premises-FOL"), F.lit("It is so").alias("conclusion"), F.col("n_name").alias("conclusion-FOL"))
    c = table(spark, sf_dir, "customer")
    theory = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("All are "), "c_mktsegment", F.lit(". "), "c_name", F.lit(" buys. no.")).alias("theory"), F.lit("Who buys?").alias("question"))
    o = table(spark, sf_dir, "orders")
    story = o.select(F.col("o_orderkey").alias("id"), F.format_string("1 Order %d came.\n22\n2 Status is %s", "o_orderkey", "o_orderstatus").alias("passage"), F.when(F.col("o_orderkey") % 2 == 0, "Where is it?").alias("question"))
    kin = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("["), "c_name", F.lit("] has a son. [Al] is he. ok")).alias("sentence1"))
    return reduce(DataFrame.unionByName, [folio(logic), proofwriter(theory), babi(story), clutrr(kin)])


QUERIES = {"suite_published": published, "dataset_statements": q_statements, "strided_sample": lambda s, d: strided(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 82)}
_RULES = CHOICE_RULES.replace("'", "''")
_TOKENS = "CAST(greatest(1, floor(len(list_filter(string_split(trim(regexp_replace({0}, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) * 1.33)) AS BIGINT)"
ORACLE_SQL = {
    "suite_published": f"""WITH s AS (SELECT 'humaneval' AS suite, 'Task/' || p_partkey AS id, 'def part_' || p_partkey || '(x):' || chr(10) AS p, '' AS c, '    return x + ' || p_size || chr(10) AS gold, 'part_' || p_partkey || '||-|-' AS more FROM part
UNION ALL SELECT 'arc_science', CAST(p_partkey AS VARCHAR), 'Which is the brand of ' || p_name || '?' || chr(10) || chr(10) || 'Choices:' || chr(10) || '(A) ' || p_name || chr(10) || '(B) ' || p_brand || chr(10) || '(C) ' || p_type || chr(10) || chr(10) || '{_RULES}', '', CASE WHEN p_partkey % 5 > 0 THEN 'B' ELSE 'E' END, '-|-|' || CASE WHEN p_partkey % 5 > 0 THEN p_brand ELSE p_name END || '|-' FROM part
UNION ALL SELECT 'musique', CAST(p_partkey AS VARCHAR), p_type, CASE WHEN p_partkey % 2 = 0 THEN 'Document [1]: ' || p_brand || chr(10) || chr(10) || 'Document [2]: ' || p_type || chr(10) || chr(10) || 'Document [3]: ' || p_name ELSE 'Document [1]: ' || p_type || chr(10) || chr(10) || 'Document [2]: ' || p_name || chr(10) || chr(10) || 'Document [3]: ' || p_brand END, p_brand, '-|-|-|' || CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END FROM part)
SELECT suite, id, md5(p) AS prompt, md5(c) AS context, gold, {_TOKENS.format("p")} AS tokens, more FROM s""",
    "dataset_statements": """SELECT 'folio' AS dataset, n_name || ' lies in ' || r_name AS text, 'In(' || n_name || ')' AS formula FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT DISTINCT 'folio', r_name || ' is large', '' FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'folio', 'It is so', n_name FROM nation WHERE n_nationkey = (SELECT min(n_nationkey) FROM nation)
UNION ALL SELECT DISTINCT 'proofwriter', 'All are ' || c_mktsegment, '' FROM customer UNION ALL SELECT DISTINCT 'proofwriter', c_name || ' buys', '' FROM customer UNION ALL SELECT 'proofwriter', 'Who buys?', ''
UNION ALL SELECT 'babi', 'Order ' || o_orderkey || ' came.', '' FROM orders UNION ALL SELECT DISTINCT 'babi', 'Status is ' || o_orderstatus, '' FROM orders UNION ALL SELECT 'babi', 'Where is it?', ''
UNION ALL SELECT DISTINCT 'clutrr', c_name || ' has a son', '' FROM customer UNION ALL SELECT 'clutrr', 'Al is he', ''""",
    "strided_sample": "WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey, o_custkey FROM r WHERE k IN (SELECT CAST(floor(i * n / 82.0) AS BIGINT) FROM (SELECT unnest(range(82)) AS i))",
}
