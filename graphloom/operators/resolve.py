"""Entity resolution: string similarities and blocked matching."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.retrieval import small
from graphloom.sources.tables import table


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; equal empty strings are 1."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest > 0, F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / longest)).otherwise(1.0)


def bigrams(text: Column) -> Column:
    n = F.char_length(text)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.substring(text, k, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def dice_score(a: Column, b: Column) -> Column:
    """Overlap of the multisets of bigrams (6 digits); strings without bigrams are compared whole."""
    held = F.struct(bigrams(a).alias("x"), bigrams(b).alias("y"))  # as an element, so that it is made once a row
    times = lambda g, grams: F.size(F.filter(grams, lambda h: h == g)).cast("long")
    overlap = lambda p: F.aggregate(F.array_intersect(p["x"], p["y"]), F.lit(0).cast("long"), lambda s, g: s + F.least(times(g, p["x"]), times(g, p["y"])))
    total = F.greatest(F.char_length(a) - 1, F.lit(0)) + F.greatest(F.char_length(b) - 1, F.lit(0))
    score = F.when(total > 0, 2.0 * F.transform(F.array(held), overlap)[0] / total).otherwise((a == b).cast("double"))
    return F.round(score, 6)


def dice(pairs: DataFrame, a: str, b: str, key: list[str]) -> DataFrame:
    """key, dice: dice_score of columns a and b."""
    return pairs.select(*key, dice_score(F.col(a), F.col(b)).alias("dice"))


def name_score(a: Column, b: Column) -> Column:
    """Ladder on the words of two names: equal 1, subset .95, half or more shared .9, a third .8, else 0."""
    same, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    j = same / F.greatest(either, F.lit(1))
    return F.when((same == either) & (same > 0), 1.0).when((same > 0) & (same == F.least(F.size(a), F.size(b))), 0.95).when(j >= 0.5, 0.9).when(j >= 0.33, 0.8).otherwise(0.0)


def transposition_distance(a: str, b: str) -> int:
    """Edit distance that also counts a swap of neighbours as one (optimal string alignment)."""
    before, now = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        rows = [i]
        for j, y in enumerate(b, 1):
            best = min(now[j] + 1, rows[j - 1] + 1, now[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            rows.append(best)
        before, now = now, rows
    return now[-1]


#: Cells of distances that a step of transposition_distances holds, about.
CELLS = 1 << 18


def transposition_distances(a: list[str], b: list[str]) -> np.ndarray:
    """transposition_distance of a and b, string by string; a row of the distances of many pairs is made at once.

    Cells are held less their place in the row, so letters of b that come in are a running minimum (taken in doubled steps).
    """
    sizes = np.array([list(map(len, a)), list(map(len, b))]).reshape(2, -1)
    order, out, at = np.argsort(-sizes.max(0), kind="stable"), np.empty(len(a), np.int32), 0
    while at < len(a):
        width = max(1, sizes[:, order[at]].max().item())  # the longest strings come first
        some = order[at : at + max(1, CELLS // width)]
        at += len(some)
        (la, lb), kind = sizes[:, some], np.int8 if width < 100 else np.int32
        x, y = (np.array([of[k] for k in some], f"U{width}").view(np.uint32).reshape(len(some), width).T for of in (a, b))
        x, y = (c.astype(np.uint8 if max(x.max(), y.max()) < 256 else np.uint32, order="C") for c in (x, y))
        now = np.zeros((width + 1, len(some)), kind)
        before = met = None
        steps = [1 << k for k in range(width.bit_length())]
        for i in range(la.max() + 1):
            if i:
                same, row = (x[i - 1] == y).view(np.int8), now + kind(1)
                np.minimum(row[1:], now[:-1] - same, out=row[1:])
                if i > 1:
                    np.minimum(row[2:], before[:-2] - (same[:-1] & met[1:]), out=row[2:])
                for step in steps:
                    np.minimum(row[step:], row[:-step], out=row[step:])
                before, now, met = now, row, same
            done = np.flatnonzero(la == i)
            out[some[done]] = now[lb[done], done] + lb[done]
    return out


@F.pandas_udf(T.IntegerType())
def damerau(a: pd.Series, b: pd.Series) -> pd.Series:
    known = a.notna() & b.notna()
    out = pd.Series(pd.NA, index=a.index, dtype="Int32")
    out[known] = transposition_distances(a[known].tolist(), b[known].tolist())
    return out


#: Ids of a kind that a row holds while pairs are made.
RUN = 1024

#: Kinds up to which every two of them are scored once for all blocks (so at most their square is broadcast).
KINDS = 700


def kind_pairs(rows: DataFrame, block: list[str], kind: list[str], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """a_id, b_id and score's columns for every pair (a_id < b_id) of rows (id, block, kind) of a block.

    What a pair is worth follows from its kinds alone: score adds columns to rows by their a_ and b_ columns of the kind
    (both orders), each row by itself, and keeps the others.  Few kinds are scored once for every two that meet; many
    where they meet, once for every two runs of RUN ids of a kind, so no pair is shuffled.  Ids are paired last.
    """
    side = lambda df, t: df.withColumnsRenamed({c: f"{t}_{c}" for c in [*kind, "ids", "first", "last"]})
    place = F.row_number().over(Window.partitionBy(*block, *kind).orderBy("id")) - 1
    runs = rows.withColumn("_run", F.floor(place / RUN)).groupBy(*block, *kind, "_run").agg(F.collect_list("id").alias("ids"), F.min("id").alias("first"), F.max("id").alias("last")).drop("_run")
    # by sorting: a task holds two rows of a block at a time, and small tables are not sent whole to one place
    met = side(runs, "a").join(side(runs, "b").hint("merge"), block).where("a_first < b_last").drop(*block)
    keys = [f"{t}_{c}" for t in "ab" for c in kind]
    if rows.select(*kind).distinct().limit(KINDS + 1).count() > KINDS:
        scored = score(met)
        found = [c for c in scored.columns if c not in met.columns]
    else:
        kinds = rows.select(*block, *kind).distinct()
        worth = score(side(kinds, "a").join(side(kinds, "b"), block).select(*keys).distinct())
        found = worth.columns[len(keys):]
        table = F.broadcast(worth.withColumnsRenamed({c: f"_{c}" for c in keys}))
        scored = met.join(table, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    every = scored.select(F.explode("a_ids").alias("a_id"), "b_ids", "b_last", *found).where("a_id < b_last")
    return every.select("a_id", F.explode("b_ids").alias("b_id"), *found).where("a_id < b_id")


def word_blocks(names: DataFrame) -> DataFrame:
    """Pairs (a_id < b_id) of names (id, name) that share their first and their last word."""
    w = names.withColumn("w", F.split(F.lower("name"), " ")).withColumn("block", F.concat_ws("|", F.get("w", F.lit(0)), F.element_at("w", -1)))
    a = w.select("block", F.col("id").alias("a_id"), F.col("name").alias("a_name"))
    b = w.select("block", F.col("id").alias("b_id"), F.col("name").alias("b_name"))
    return a.join(b, "block").where("a_id < b_id").drop("block")


def block_similarity(names: DataFrame) -> DataFrame:
    """a_id, pairs, best: for every id of names (id, name) the pairs of word_blocks that it starts, and the highest similarity of one.

    No pair is made: pairs are counted by places in the block, and each name of a block is compared with its other
    names, if these have a later id.
    """
    w = names.withColumn("w", F.split(F.lower("name"), " ")).select("id", "name", F.concat_ws("|", F.get("w", F.lit(0)), F.element_at("w", -1)).alias("block"))
    later = w.withColumn("pairs", F.rank().over(Window.partitionBy("block").orderBy(F.desc("id"))) - 1).where("pairs > 0")
    kinds = w.groupBy("block", "name").agg(F.max("id").alias("last"))
    alike = kinds.select("block", F.col("name").alias("a_name")).join(kinds.withColumnRenamed("name", "b_name"), "block")
    alike = alike.select("block", "a_name", "last", levenshtein_similarity(F.col("a_name"), F.col("b_name")).alias("s"))
    # of names as alike, the one with the last id decides
    alike = alike.groupBy("block", "a_name", "s").agg(F.max("last").alias("last")).withColumnRenamed("block", "of")
    met = later.join(alike, (F.col("block") == F.col("of")) & F.col("name").eqNullSafe(F.col("a_name")) & (F.col("id") < F.col("last")))
    best = met.groupBy("id").agg(F.max("s").alias("s"))
    return later.groupBy("id").agg(F.sum("pairs").alias("pairs")).join(best, "id").select(F.col("id").alias("a_id"), "pairs", F.round("s", 6).alias("best"))


def deletions(word: Column, most: int = 2) -> Column:
    """The word and all words that deleting up to `most` letters makes of it.

    Two words within that many edits (swaps of neighbours included) share one, so they can meet by equality.
    """
    one = lambda w: F.when(F.char_length(w) > 1, F.transform(F.sequence(F.lit(1), F.char_length(w)), lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, F.char_length(w))))).otherwise(F.array().cast("array<string>"))
    out = ring = F.array(word)
    for _ in range(most):
        ring = F.array_distinct(F.flatten(F.transform(ring, one)))
        out = F.array_union(out, ring)
    return out


def corrections(words: DataFrame, lexicon: DataFrame, most: int = 2) -> DataFrame:
    """word, correction, distance: the entry (entry, priority) with the least 10 * distance - priority, below 20; ties by entry.

    Words and entries meet by what deletions make of both, so no word is compared with the whole lexicon; the
    transposition distance runs on those pairs alone.
    """
    w = words.select("word").distinct().select("word", F.explode(deletions(F.col("word"), most)).alias("k"))
    e = lexicon.select("entry", "priority", F.explode(deletions(F.col("entry"), most)).alias("k"))
    pairs = w.join(e, "k").select("word", "entry", "priority").distinct().withColumn("distance", damerau("word", "entry")).where(F.col("distance") <= most)
    scored = pairs.withColumn("score", 10 * F.col("distance") - F.col("priority")).where("score < 20")
    best = scored.groupBy("word").agg(F.min(F.struct("score", "entry", "distance")).alias("b"))
    return best.select("word", F.col("b.entry").alias("correction"), F.col("b.distance").alias("distance"))


def alias_scan(texts: DataFrame, aliases: DataFrame, longest: int | None = None) -> DataFrame:
    """doc_id, start (word), words, id: where aliases (id, alias) of up to `longest` words (all, if not given) stand in texts; of overlapping ones the longest, then the first.

    Runs of words meet aliases by equality; the dictionary's first words filter them before.  The overlap of a
    match with a longer one, or an earlier one of its length, is settled inside its text.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[^\s.,;:!?()\"']+"), F.lit(0))
    a = aliases.select("id", words(F.col("alias")).alias("w"))
    longest = longest or a.agg(F.max(F.size("w"))).first()[0] or 1
    a = a.where(F.size("w").between(1, longest))
    a = a.groupBy(F.array_join("w", " ").alias("run"), F.size("w").alias("n")).agg(F.min("id").alias("id"), F.first(F.get("w", F.lit(0))).alias("head"))
    t = texts.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("w")).select("doc_id", "w", F.posexplode("w").alias("start", "head"))
    t = t.join(small(a.select("head").distinct()), "head", "left_semi")
    runs = t.select("doc_id", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - F.col("start")))).alias("n"), "w").select("doc_id", "start", "n", F.array_join(F.slice("w", F.col("start") + 1, F.col("n")), " ").alias("run"))
    hits = runs.join(a.drop("head"), ["run", "n"]).select("doc_id", "start", "n", "id")

    def settle(found: Column) -> Column:
        kind = "array<struct<neg: int, start: int, n: int, id: long>>"

        def step(acc: Column, x: Column) -> Column:
            free = ~F.exists(acc, lambda y: (x["start"] < y["start"] + y["n"]) & (y["start"] < x["start"] + x["n"]))
            return F.when(free, F.concat(acc, F.array(x))).otherwise(acc)

        return F.aggregate(found, F.array().cast(kind), step)

    row = F.struct((-F.col("n")).cast("int").alias("neg"), F.col("start").cast("int").alias("start"), F.col("n").cast("int").alias("n"), F.col("id").cast("long").alias("id"))
    g = hits.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("f")).select("doc_id", F.explode(settle(F.col("f"))).alias("x"))
    return g.select("doc_id", F.col("x.start").alias("start"), F.col("x.n").alias("words"), F.col("x.id").alias("id"))


def _pairs(spark: SparkSession, sf_dir: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Parts of the same brand, size and type in pairs, scored by their names (a_name, b_name) as aliases."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_size", "p_type", F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return kind_pairs(p, ["p_brand", "p_size", "p_type"], ["name"], score)


def q_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    return _pairs(spark, sf_dir, lambda n: n.withColumns({"similarity": F.round(levenshtein_similarity(F.col("a_name"), F.col("b_name")), 6), "name_score": name_score(words("a_name"), words("b_name"))}))


def q_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different names of parts with a suffix, in pairs that share first and last word: how alike the pairs of a block are."""
    p = table(spark, sf_dir, "part").where("p_partkey % 5 < 2").select((F.col("p_partkey")).alias("id"), F.concat_ws(" ", F.split("p_name", " ")[0], F.col("p_brand"), F.concat(F.lit("x"), (F.col("p_partkey") % 40).cast("string"))).alias("name"))
    return block_similarity(p)


def _misspelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the parts' names with a swap, a loss, a change or a doubling, by key."""
    w = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.explode(F.split("p_name", " ")).alias("w"))
    at = lambda i, n: F.substring(F.col("w"), F.lit(i), F.lit(n))
    made = F.when(F.col("k") % 5 == 0, F.concat(at(1, 1), at(3, 1), at(2, 1), at(4, 99))).when(F.col("k") % 5 == 1, F.concat(at(1, 1), at(3, 99))).when(F.col("k") % 5 == 2, F.concat(F.lit("#"), at(2, 99))).when(F.col("k") % 5 == 3, F.concat(at(1, 2), F.lit("qqq"), at(3, 99))).otherwise(F.col("w"))
    return w.select(made.alias("word"), F.col("w").alias("meant"))


def q_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt words corrected by the words that occur, with those of four letters preferred."""
    m = _misspelt(spark, sf_dir)
    lexicon = m.select(F.col("meant").alias("entry")).distinct().withColumn("priority", (F.char_length("entry") == 4).cast("int"))
    return corrections(m.select("word"), lexicon)


def q_alias_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts in texts made of the names of three neighbours."""
    p = table(spark, sf_dir, "part")
    name = lambda k: p.select((F.col("p_partkey") - k).alias("doc_id"), F.col("p_name").alias(f"n{k}"))
    texts = name(0).join(name(1), "doc_id").join(name(2), "doc_id").select("doc_id", F.format_string("Take %s, no %s (%s).", "n0", "n1", "n2").alias("text"))
    names = p.groupBy(F.col("p_name").alias("alias")).agg(F.min("p_partkey").alias("id"))
    singles = names.select(F.substring_index("alias", " ", 1).alias("alias")).distinct().select((F.lit(1_000_000) + F.length("alias")).cast("long").alias("id"), "alias")
    return alias_scan(texts, names.select("id", "alias").unionByName(singles.select("id", "alias")))


QUERIES = {
    "alias_levenshtein": q_similar,
    "alias_dice": lambda s, d: _pairs(s, d, lambda n: n.withColumn("dice", dice_score(F.col("a_name"), F.col("b_name")))),
    "word_blocks": q_blocks,
    "typo_correction": q_corrected,
    "alias_scan": q_alias_scan,
    "typo_distance": lambda s, d: _pairs(s, d, lambda n: n.withColumn("distance", damerau("a_name", "b_name"))),
}
_PR = "p AS (SELECT a.p_partkey AS a_id, b.p_partkey AS b_id, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey)"
_W2 = "w AS (SELECT *, list_distinct(string_split(lower(x), ' ')) AS wa, list_distinct(string_split(lower(y), ' ')) AS wb FROM p), c AS (SELECT *, len(list_intersect(wa, wb)) AS same, len(list_distinct(list_concat(wa, wb))) AS n FROM w)"
ORACLE_SQL = {
    "alias_levenshtein": f"WITH {_PR}, {_W2} SELECT a_id, b_id, round(greatest(0.0, 1 - levenshtein(x, y) / greatest(length(x), length(y))), 6) AS similarity, CAST(CASE WHEN same = n AND same > 0 THEN 1.0 WHEN same > 0 AND same = least(len(wa), len(wb)) THEN 0.95 WHEN same / n >= 0.5 THEN 0.9 WHEN same / n >= 0.33 THEN 0.8 ELSE 0.0 END AS DOUBLE) AS name_score FROM c",
    "alias_dice": f"""WITH {_PR}, a AS (SELECT a_id, b_id, g, count(*) AS n FROM (SELECT a_id, b_id, unnest(list_transform(range(1, length(x)), lambda k: substring(x, CAST(k AS INTEGER), 2))) AS g FROM p) GROUP BY ALL),
b AS (SELECT a_id, b_id, g, count(*) AS m FROM (SELECT a_id, b_id, unnest(list_transform(range(1, length(y)), lambda k: substring(y, CAST(k AS INTEGER), 2))) AS g FROM p) GROUP BY ALL), c AS (SELECT a_id, b_id, sum(least(n, m)) AS s FROM a JOIN b USING (a_id, b_id, g) GROUP BY ALL)
SELECT a_id, b_id, round(2.0 * coalesce(s, 0) / (length(x) + length(y) - 2), 6) AS dice FROM p LEFT JOIN c USING (a_id, b_id)""",
    "word_blocks": """WITH p AS (SELECT p_partkey AS id, string_split(p_name, ' ')[1] || ' ' || p_brand || ' x' || (p_partkey % 40) AS name, string_split(p_name, ' ')[1] || '|' || (p_partkey % 40) AS block FROM part WHERE p_partkey % 5 < 2),
s AS (SELECT a.id AS a_id, greatest(0.0, 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))) AS s FROM p a JOIN p b ON a.block = b.block AND a.id < b.id) SELECT a_id, count(*) AS pairs, round(max(s), 6) AS best FROM s GROUP BY a_id""",
    "typo_correction": """WITH w AS (SELECT p_partkey AS k, unnest(string_split(p_name, ' ')) AS w FROM part), m AS (SELECT DISTINCT CASE k % 5 WHEN 0 THEN substring(w, 1, 1) || substring(w, 3, 1) || substring(w, 2, 1) || substring(w, 4, 99) WHEN 1 THEN substring(w, 1, 1) || substring(w, 3, 99) WHEN 2 THEN '#' || substring(w, 2, 99) WHEN 3 THEN substring(w, 1, 2) || 'qqq' || substring(w, 3, 99) ELSE w END AS word FROM w),
l AS (SELECT DISTINCT w AS entry, CASE WHEN length(w) = 4 THEN 1 ELSE 0 END AS priority FROM w), d AS (SELECT word, entry, CAST(damerau_levenshtein(word, entry) AS INTEGER) AS distance, 10 * damerau_levenshtein(word, entry) - priority AS score FROM m, l WHERE damerau_levenshtein(word, entry) <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score, entry) AS r FROM d WHERE score < 20) SELECT word, entry AS correction, distance FROM r WHERE r = 1""",
    "alias_scan": """WITH n AS (SELECT p_partkey AS k, p_name, min(p_partkey) OVER (PARTITION BY p_name) AS id FROM part), t AS (SELECT a.k AS doc_id, [a.id, b.id, c.id] AS ids FROM n a JOIN n b ON b.k = a.k + 1 JOIN n c ON c.k = a.k + 2)
SELECT doc_id, CAST([1, 4, 6][i] AS INTEGER) AS start, 2 AS words, ids[i] AS id FROM t, (SELECT unnest([1, 2, 3]) AS i)""",
}
