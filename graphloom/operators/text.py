"""Text operators: tokens, answers, sentences, chunks and budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.tables import table

TOKEN = "[a-z0-9_]{2,}"
WORDS_TO_TOKENS = 1.33


def tokens(text: Column) -> Column:
    """Lower-case tokens of two characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: w != ""))


def token_estimate(text: Column) -> Column:
    """About 1.33 tokens a word, rounded down."""
    return F.floor(word_count(text) * WORDS_TO_TOKENS).cast("long")


def normalize_answer(text: Column) -> Column:
    """Lower case, without ASCII punctuation, without articles, single spaces - in that order."""
    plain = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    words = F.split(F.trim(F.regexp_replace(plain, r"\s+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin("a", "an", "the")), " ")


def token_f1(pairs: DataFrame, prediction: str, gold: str, key: list[str]) -> DataFrame:
    """key, f1: multiset overlap of the normalised words, rounded to 4 digits; 0 without overlap."""
    words = lambda c: F.filter(F.split(normalize_answer(F.col(c)), " "), lambda w: w != "")
    both = pairs.select(*key, words(prediction).alias("p"), words(gold).alias("g"))
    sizes = both.select(*key, F.size("p").alias("np"), F.size("g").alias("ng"))
    count = lambda c, n: both.select(*key, F.explode(c).alias("w")).groupBy(*key, "w").agg(F.count("*").alias(n))
    common = count("p", "a").join(count("g", "b"), [*key, "w"]).groupBy(*key).agg(F.sum(F.least("a", "b")).alias("same"))
    joined = sizes.join(common, key, "left").withColumn("same", F.coalesce("same", F.lit(0)))
    f1 = F.when(F.col("same") > 0, 2.0 * F.col("same") / (F.col("np") + F.col("ng"))).otherwise(0.0)
    return joined.select(*key, F.round(f1, 4).alias("f1"))


def compression(before: Column, after: Column) -> tuple[Column, Column]:
    """Share of tokens saved, signed and (as a report shows it) not below 0; in percent."""
    signed = F.when(before > 0, F.round((before - after) * 100.0 / before, 2)).otherwise(0.0)
    return signed, F.greatest(signed, F.lit(0.0))


def split_sentences(text: str) -> list[tuple[int, int]]:
    """Bounds of sentences: terminal punctuation before white space and a capital; some abbreviations skip one boundary."""
    import re

    abbreviations = {"mr", "mrs", "ms", "dr", "prof", "st", "vs", "etc", "e.g", "i.e"}
    out, start = [], 0
    for m in re.finditer(r"[.!?]+[\"')\]]*\s+(?=[\w\"'(\[])", text):
        before = re.search(r"([\w.]+)$", text[start : m.start()])
        if before and before[1].lower() in abbreviations:
            continue
        out.append((start, m.end()))
        start = m.end()
    if text[start:].strip():
        out.append((start, len(text)))
    return out


def greedy_chunks(sizes: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """Ranges of items whose sizes fill up to high; a chunk closes once it has low and the next would pass high; an oversize item stands alone."""
    out, start, total = [], 0, 0
    for k, n in enumerate(sizes):
        if k > start and total + n > high:
            out.append((start, k))
            start, total = k, 0
        total += n
        if total >= high:
            out.append((start, k + 1))
            start, total = k + 1, 0
    if start < len(sizes):
        out.append((start, len(sizes)))
    if len(out) > 1 and sum(sizes[slice(*out[-1])]) < low and sum(sizes[slice(*out[-2])]) + sum(sizes[slice(*out[-1])]) <= high:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out


def micro_chunks(docs: DataFrame, low: int = 150, high: int = 350) -> DataFrame:
    """doc_id, chunk, start, stop, words: sentences of each whole text filled greedily; twice the size above 10,000 words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                text = text or ""
                spans = split_sentences(text)
                sizes = [len(text[a:b].split()) for a, b in spans]
                bounds = (400, 800) if sum(sizes) > 10_000 else (low, high)
                for k, (a, b) in enumerate(greedy_chunks(sizes, *bounds)):
                    rows.append((doc_id, k, spans[a][0], spans[b - 1][1], sum(sizes[a:b])))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "start", "stop", "words"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk long, start long, stop long, words long")


def macro_blocks(chunks: DataFrame, target: int = 1000) -> DataFrame:
    """doc_id, block, first_chunk, last_chunk, words: chunks of a document blocked greedily to about `target` tokens."""
    high = F.lit(int(max(max(80, 0.6 * target) + 50, 1.4 * target) / WORDS_TO_TOKENS))
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "words")))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("block"), F.array().cast("array<struct<block: long, chunk: long, words: long>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = (acc["total"] > 0) & (acc["total"] + x["words"] > high)
        block = acc["block"] + F.when(fresh, 1).otherwise(0)
        row = F.array(F.struct(block.alias("block"), x["chunk"].alias("chunk"), x["words"].alias("words")))
        return F.struct((F.when(fresh, 0).otherwise(acc["total"]) + x["words"]).alias("total"), block.alias("block"), F.concat(acc["out"], row).alias("out"))

    folded = chunks.groupBy("doc_id").agg(ordered.alias("c")).select("doc_id", F.explode(F.aggregate("c", start, step)["out"]).alias("x"))
    return folded.groupBy("doc_id", F.col("x.block").alias("block")).agg(F.min("x.chunk").alias("first_chunk"), F.max("x.chunk").alias("last_chunk"), F.sum("x.words").alias("words"))


def sentence_stats(docs: DataFrame) -> DataFrame:
    """doc_id, sentences, words, longest: sentences end at . ! ? before white space or the end (no look-around)."""
    parts = F.filter(F.split(F.regexp_replace("text", r"[.!?]+\s+", "\u0001"), "\u0001"), lambda s: F.trim(s) != "")
    lengths = F.transform(F.col("s"), lambda s: word_count(s))
    return docs.select("doc_id", parts.alias("s"), "text").select(
        "doc_id", F.size("s").cast("long").alias("sentences"), word_count(F.col("text")).cast("long").alias("words"), F.coalesce(F.array_max(lengths), F.lit(0)).cast("long").alias("longest")
    )


def truncate_to_budget(docs: DataFrame, budget: int) -> DataFrame:
    """doc_id, kept_lines, kept_tokens: whole lines of a text from its start as long as their token estimates fit; it stops at the first that doesn't."""
    lines = F.transform(F.split("text", "\n"), lambda s: token_estimate(s))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"), F.lit(True).alias("open"))
    step = lambda acc, x: F.struct(
        (acc["n"] + F.when(acc["open"] & (acc["total"] + x <= budget), 1).otherwise(0)).alias("n"),
        (acc["total"] + F.when(acc["open"] & (acc["total"] + x <= budget), x).otherwise(0)).alias("total"),
        (acc["open"] & (acc["total"] + x <= budget)).alias("open"),
    )
    return docs.withColumn("f", F.aggregate(lines, start, step)).select("doc_id", F.col("f.n").alias("kept_lines"), F.col("f.total").alias("kept_tokens"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def q_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", normalize_answer(F.col("text")).alias("answer"))


def q_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and collection frequency of every token."""
    t = _docs(spark, sf_dir).select("doc_id", F.explode(tokens(F.col("text"))).alias("term"))
    tf = t.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


def q_task_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History and last user turn of every conversation; long ones are marked for compression."""
    c = table(spark, sf_dir, "conversations").withColumn("tokens", token_estimate(F.coalesce("text", F.lit(""))))
    g = c.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("query_turn"), F.count("*").alias("messages"), F.sum("tokens").alias("tokens"))
    compress = (F.col("tokens") > 800) | ((F.col("messages") > 4) & (F.col("tokens") > 200))
    return g.select("conv_id", "query_turn", "messages", "tokens", compress.alias("compress"))


def q_turn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different turns by the digest of role and text, with their first conversation."""
    c = table(spark, sf_dir, "conversations")
    who = F.when(F.col("role") == "user", "Human: ").when(F.col("role") == "assistant", "Assistant: ").otherwise(F.concat(F.coalesce("role", F.lit("")), F.lit(": ")))
    digest = F.sha2(F.concat(who, F.coalesce("text", F.lit(""))), 256)
    return c.groupBy(digest.alias("digest")).agg(F.count("*").alias("turns"), F.min("conv_id").alias("first_conv"))


_W = "len(list_filter(string_split(trim(regexp_replace({0}, '\\s+', ' ', 'g')), ' '), lambda x: x <> ''))"
_NORM = "array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x NOT IN ('a', 'an', 'the')), ' ')"

QUERIES = {
    "normalize_answer": q_normalize,
    "term_stats": q_term_stats,
    "sentence_stats": lambda s, d: sentence_stats(_docs(s, d)),
    "truncate_budget": lambda s, d: truncate_to_budget(_docs(s, d), 200),
    "micro_chunks": lambda s, d: micro_chunks(_docs(s, d)),
    "macro_blocks": lambda s, d: macro_blocks(micro_chunks(_docs(s, d))),
    "task_split": q_task_split,
    "chat_turn_dedup": q_turn_dedup,
    "session_tokens": lambda s, d: table(s, d, "conversations").groupBy("conv_id", "role").agg(F.sum(token_estimate(F.coalesce("text", F.lit("")))).alias("tokens"), F.count("*").alias("turns")),
}
ORACLE_SQL = {
    "normalize_answer": f"SELECT item_id, {_NORM.format('text')} AS answer FROM benchmark",
    "term_stats": "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS term FROM documents), f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_tf FROM f GROUP BY term",
    "sentence_stats": f"""WITH s AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(text, '[.!?]+\\s+', chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM documents)
SELECT doc_id, CAST(len(s) AS BIGINT) AS sentences, CAST({_W.format('text')} AS BIGINT) AS words, CAST(coalesce(list_max(list_transform(s, lambda y: {_W.format('y')})), 0) AS BIGINT) AS longest FROM s""",
    "truncate_budget": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents),
e AS (SELECT doc_id, k, CAST(floor({_W.format('line')} * 1.33) AS BIGINT) AS t FROM l), r AS (SELECT doc_id, t, sum(t) OVER (PARTITION BY doc_id ORDER BY k) AS total FROM e)
SELECT doc_id, count(*) FILTER (total <= 200) AS kept_lines, CAST(coalesce(sum(t) FILTER (total <= 200), 0) AS BIGINT) AS kept_tokens FROM r GROUP BY doc_id""",
    "task_split": f"""WITH c AS (SELECT *, CAST(floor({_W.format("coalesce(text, '')")} * 1.33) AS BIGINT) AS tokens FROM conversations),
g AS (SELECT conv_id, max(turn) FILTER (role = 'user') AS query_turn, count(*) AS messages, CAST(sum(tokens) AS BIGINT) AS tokens FROM c GROUP BY conv_id)
SELECT *, tokens > 800 OR (messages > 4 AND tokens > 200) AS compress FROM g""",
    "chat_turn_dedup": "SELECT sha256(CASE role WHEN 'user' THEN 'Human: ' WHEN 'assistant' THEN 'Assistant: ' ELSE coalesce(role, '') || ': ' END || coalesce(text, '')) AS digest, count(*) AS turns, min(conv_id) AS first_conv FROM conversations GROUP BY 1",
    "session_tokens": f"""SELECT conv_id, role, CAST(sum(CAST(floor({_W.format("coalesce(text, '')")} * 1.33) AS BIGINT)) AS BIGINT) AS tokens, count(*) AS turns FROM conversations GROUP BY ALL""",
}
