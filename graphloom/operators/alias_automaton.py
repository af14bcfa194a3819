"""Aliases in texts: exact runs by a dictionary automaton, inflected and misspelt words by a walk over a trie.

The dictionary is cut into shards of bounded size, each an automaton (a trie with failure links) that goes out to where
the texts lie; texts are read in one pass a shard and never shuffled.  Words that no exact match took are compared once for
each different form: a Levenshtein automaton (a row of distances) walks the trie of folded aliases below
the word's first letters, so only aliases that begin alike are seen.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.retrieval import small
from graphloom.sources.scratch import cut
from graphloom.sources.tables import table

#: Characters of aliases in one shard (some 30 bytes of memory each).
SHARD_CHARS = 4_000_000
#: Letters that a word and an alias must begin with alike; least similarity; letters that a word may have beyond an alias; most difference in length.
PREFIX, THRESHOLD, SUFFIX, LENGTHS = 3, 0.70, 6, 4
_WORD = re.compile(r"[\wÀ-ɏḀ-ỿ]+")


def lowered(text: str) -> str:
    """Lower case of the same length (letters whose lower case is longer stay)."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def folded(text: str) -> str:
    """Lower case without marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def _inner(text: str, at: int) -> bool:
    """Whether a letter, digit or underscore stands at a place of a text."""
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


class Trie:
    """Folded aliases by letter; each node's children and the aliases that end there."""

    def __init__(self, aliases: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[str]] = [[]]
        for alias in aliases:
            node = 0
            for c in folded(alias):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                node = self.children[node][c]
            self.ends[node].append(alias)

    def near(self, word: str, prefix: int, threshold: float) -> list[tuple[str, str]]:
        """(alias, how) of the aliases that a folded word begins with (prefix) or is like (fuzzy): by edits, or by shared pairs of letters."""
        node, row, path = 0, list(range(len(word) + 1)), ""
        for c in word[:prefix]:
            if c not in self.children[node]:
                return []
            node, row, path = self.children[node][c], self._next(row, word, c), path + c
        out, open_ = [], [(node, row, path)]
        while open_:
            node, row, path = open_.pop()
            if self.ends[node]:
                how = "prefix" if word.startswith(path) and len(word) - len(path) <= SUFFIX else "fuzzy" if abs(len(word) - len(path)) <= LENGTHS and self._alike(word, path, row[-1], threshold) else None
                out += [(alias, how) for alias in self.ends[node] if how]
            if len(path) < len(word) + LENGTHS:
                open_ += [(child, self._next(row, word, c), path + c) for c, child in self.children[node].items()]
        return out

    @staticmethod
    def _next(row: list[int], word: str, c: str) -> list[int]:
        out = [row[0] + 1]
        for k, x in enumerate(word):
            out.append(min(out[k] + 1, row[k + 1] + 1, row[k] + (x != c)))
        return out

    @staticmethod
    def _alike(a: str, b: str, distance: int, threshold: float) -> bool:
        if 1 - distance / max(len(a), len(b)) >= threshold:
            return True
        pairs = lambda s: Counter(s[k : k + 2] for k in range(len(s) - 1))
        total = len(a) + len(b) - 2
        return len(a) > 1 and len(b) > 1 and 2 * sum((pairs(a) & pairs(b)).values()) / total >= threshold


def leftmost_longest(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of overlapping spans the one that starts first, of those the longest."""
    out, free = [], 0
    for start, stop in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= free:
            out.append((start, stop))
            free = stop
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_FOUND = pa.schema([("start", pa.int32()), ("stop", pa.int32()), ("surface", pa.string()), ("alias", pa.string()), ("word", pa.string())])


def _exact(shard):
    """Adds what one shard (broadcast) finds to the texts' spans: for each start the longest alias between word boundaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for alias in shard.value:
            automaton.add_word(alias, len(alias))
        automaton.make_automaton()
        for batch in batches:
            spans = []
            for text, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                low = lowered(text)
                longest = {k["start"]: k["stop"] for k in known}
                for last, n in automaton.iter(low) if shard.value else ():
                    start = last + 1 - n
                    if last + 1 > longest.get(start, 0) and not _inner(low, last + 1) and not _inner(low, start - 1):
                        longest[start] = last + 1
                spans.append([{"start": a, "stop": b} for a, b in longest.items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, _SPANS)], ["rest", "text", "spans"])

    return run


def _settled(ignored: frozenset[str], heads, prefix: int, fuzzy: bool):
    """rest and the kept spans of each text (alias set), and its words that no alias is equal to but some may be like (word set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], {name: [] for name in _FOUND.names}
            for k, (text, spans) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                low, rows = lowered(text), []
                for a, b in leftmost_longest([(s["start"], s["stop"]) for s in spans]):
                    rows.append((a, b, text[a:b], low[a:b], None))
                taken = {r[3] for r in rows} | ignored
                for m in _WORD.finditer(text) if fuzzy else ():
                    word = folded(m[0])
                    if m[0].lower() not in taken and len(word) >= prefix and (heads.value is None or word[:prefix] in heads.value):
                        rows.append((*m.span(), m[0], None, word))
                at += [k] * len(rows)
                for name, values in zip(_FOUND.names, zip(*rows, strict=True) if rows else [[]] * len(_FOUND), strict=True):
                    out[name] += values
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(out[f.name], f.type) for f in _FOUND]], ["rest", *_FOUND.names])

    return run


def _near(shard, prefix: int, threshold: float):
    """word, alias, how: the aliases of one shard that words are like."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shard.value)
        for batch in batches:
            found = [(w, *hit) for w in batch.column(0).to_pylist() for hit in trie.near(w, prefix, threshold)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*found, strict=True) if found else [[]] * 3)], ["word", "alias", "how"])

    return run


#: Beginnings of aliases that go to the tasks to sort out words at most; beyond, words are sorted out by the walk alone.
HEADS = 1_000_000


def alias_matches(texts: DataFrame, aliases: DataFrame, *, fuzzy: bool = True, threshold: float = THRESHOLD, prefix: int = PREFIX, ignored: tuple[str, ...] = (), shard_chars: int = SHARD_CHARS) -> DataFrame:
    """doc_id, start, stop (code points), surface, alias, id, how: where aliases (id, alias) stand in texts (doc_id, text).

    exact: in any case, between word boundaries; of overlapping ones the first, then the longest.  prefix: a word
    that begins with a folded alias and has up to 6 letters more.  fuzzy: a word that begins with the same `prefix` letters, differs by up
    to 4 in length and is alike enough by edits or by pairs of letters.  Words equal to an exact match of their text and ignored ones are
    left out of these two.  A match has a row for each id of its alias.  Null texts are empty; aliases of one
    letter, null or ignored ones match nothing; repeated texts are texts of their own; other columns are ignored.
    """
    spark = texts.sparkSession
    skipped = frozenset(w.lower() for w in ignored)
    named = aliases.select("id", F.trim(F.col("alias").cast("string")).alias("given")).where("given IS NOT NULL")
    kind = dict(named.dtypes)["id"]

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [lowered(a) for a in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(low, pa.string()), pa.array([folded(a)[:prefix] for a in low], pa.string())], ["id", "alias", "head"])

    named = cut(named.mapInArrow(lower, f"id {kind}, alias string, head string").where(F.char_length("alias") >= 2).where(~F.col("alias").isin(list(skipped)) if skipped else F.lit(True)).distinct(), "aliases")
    every = named.select("alias").distinct()
    shards = 1 + (every.agg(F.sum(F.char_length("alias"))).first()[0] or 0) // shard_chars
    heads = named.select("head").where(F.char_length("head") == prefix).distinct()
    heads = {r["head"] for r in heads.collect()} if fuzzy and heads.limit(HEADS + 1).count() <= HEADS else None
    part = lambda k: spark.sparkContext.broadcast([r["alias"] for r in every.where(F.pmod(F.xxhash64("alias"), F.lit(shards)) == k).collect()])
    parts = [part(k) for k in range(shards)]
    rows = texts.select(F.struct("doc_id").alias("rest"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.array().cast("array<struct<start: int, stop: int>>").alias("spans"))
    rest = rows.schema["rest"].dataType.simpleString()
    for shard in parts:
        rows = rows.mapInArrow(_exact(shard), f"rest {rest}, text string, spans array<struct<start: int, stop: int>>")
        if shards > 1:  # one automaton in memory at a time
            rows = cut(rows, "spans")
    found = rows.mapInArrow(_settled(skipped, spark.sparkContext.broadcast(heads), prefix, fuzzy), f"rest {rest}, start int, stop int, surface string, alias string, word string")
    found = cut(found, "found")
    hits = found.where("alias IS NOT NULL").select("rest", "start", "stop", "surface", "alias", F.lit("exact").alias("how"))
    if fuzzy:
        words = cut(found.where("word IS NOT NULL").select("word").distinct(), "words")
        near = None
        for shard in parts:
            one = words.mapInArrow(_near(shard, prefix, threshold), "word string, alias string, how string")
            near = one if near is None else near.unionByName(one)
        near = cut(near, "near")
        open_ = found.where("word IS NOT NULL").drop("alias").join(small(near), "word")
        hits = hits.unionByName(open_.select("rest", "start", "stop", "surface", "alias", "how"))
    return hits.join(small(named.select("id", "alias").distinct()), "alias").select("rest.doc_id", "start", "stop", "surface", "alias", "id", "how")


def _listed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(texts, aliases): lists of three parts' names, and the names with their first words beside them."""
    p = table(spark, sf_dir, "part")
    name = lambda k: p.select((F.col("p_partkey") - k).alias("doc_id"), F.col("p_name").alias(f"n{k}"))
    texts = name(0).join(name(1), "doc_id").join(name(2), "doc_id").select("doc_id", F.format_string("Take %s, no %s (%s).", "n0", F.initcap("n1"), "n2").alias("text"))
    names = p.groupBy(F.col("p_name").alias("alias")).agg(F.min("p_partkey").alias("id"))
    heads = names.groupBy(F.substring_index("alias", " ", 1).alias("alias")).agg((F.min("id") + 1_000_000).alias("id"))
    return texts, names.select("id", "alias").unionByName(heads.select("id", "alias"))


def q_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in lists of names, exactly and longest first."""
    return alias_matches(*_listed(spark, sf_dir), fuzzy=False).select("doc_id", "start", "stop", "id")


def q_inflected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours and things of the parts in texts where they have endings or a letter too few."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    aliases = p.select(F.explode("w").alias("alias")).groupBy("alias").agg(F.lit(1).alias("one")).select(F.col("alias").alias("id"), "alias")
    word = lambda k: F.get("w", F.lit(k))
    texts = p.select(F.col("p_partkey").alias("doc_id"), F.concat(word(0), F.when(F.col("p_partkey") % 3 == 0, "nak").otherwise("s"), F.lit(" and "), F.expr("concat(substring(w[1], 1, 3), substring(w[1], 5, 99))")).alias("text"))
    return alias_matches(texts, aliases).select("doc_id", "start", "surface", "alias", "how")


QUERIES = {"alias_spans": q_spans, "alias_inflected": q_inflected}
_ENDINGS = """w AS (SELECT p_partkey AS doc_id, string_split(p_name, ' ') AS w FROM part), a AS (SELECT DISTINCT unnest(w) AS alias FROM w), t AS (SELECT doc_id, w[1] || CASE WHEN doc_id % 3 = 0 THEN 'nak' ELSE 's' END AS t1, substring(w[2], 1, 3) || substring(w[2], 5, 99) AS t2 FROM w),
k AS (SELECT doc_id, 0 AS start, t1 AS surface FROM t UNION ALL SELECT doc_id, length(t1) + 5, t2 FROM t), e AS (SELECT doc_id, CAST(start AS INTEGER) AS start, surface, surface IN (SELECT alias FROM a) AS own FROM k),
g AS (SELECT DISTINCT surface, alias, starts_with(surface, alias) AND length(surface) - length(alias) <= 6 AS head, 1 - levenshtein(surface, alias) / greatest(length(surface), length(alias)) AS lev,
list_transform(range(1, length(surface)), lambda i: surface[i:i + 1]) AS x, list_transform(range(1, length(alias)), lambda i: alias[i:i + 1]) AS y, abs(length(surface) - length(alias)) <= 4 AS near FROM e, a WHERE NOT own AND substring(surface, 1, 3) = substring(alias, 1, 3) AND length(surface) >= 3),
h AS (SELECT *, 2 * coalesce(list_sum(list_transform(list_distinct(x), lambda b: least(len(list_filter(x, lambda c: c = b)), len(list_filter(y, lambda c: c = b))))), 0) / (len(x) + len(y)) AS dice FROM g)"""
ORACLE_SQL = {
    "alias_spans": """WITH n AS (SELECT p_partkey AS k, p_name, min(p_partkey) OVER (PARTITION BY p_name) AS id FROM part), t AS (SELECT a.k AS doc_id, [a.id, b.id, c.id] AS ids, [length(a.p_name), length(b.p_name), length(c.p_name)] AS n FROM n a JOIN n b ON b.k = a.k + 1 JOIN n c ON c.k = a.k + 2),
s AS (SELECT doc_id, unnest([5, 5 + n[1] + 5, 5 + n[1] + 5 + n[2] + 2]) AS start, unnest(n) AS n, unnest(ids) AS id FROM t) SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(start + n AS INTEGER) AS stop, id FROM s""",
    "alias_inflected": f"WITH {_ENDINGS} SELECT doc_id, start, surface, surface AS alias, 'exact' AS how FROM e WHERE own UNION ALL SELECT doc_id, start, e.surface, alias, CASE WHEN head THEN 'prefix' ELSE 'fuzzy' END AS how FROM e JOIN h ON h.surface = e.surface AND NOT own WHERE head OR near AND (lev >= 0.7 OR dice >= 0.7)",
}
