"""Substring dedup: spans of a document that also occur in an earlier one are removed.

Matching statistics come from suffix automata of reference shards.  A shard holds the passages of all
documents around one anchor, so documents are streamed past the shards that can match them instead of
past all of them (a broadcast of every shard would read the corpus once for each).

An anchor is the smallest hash of `GRAM` words in a window; equal windows have equal anchors.  Anchors
met in one text only need no further look; a filter of fixed size holds the others.  For the others the passages (the windows with that anchor,
13 to 19 words) meet in their shard in the order of doc_id, and each is matched against the automaton of
those before.  Copies of whole texts are settled by their digests and never reach a shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._common import bounded_batches, discard, join_skewed, key_filter, materialise, may_contain, slices, table, texts
from graphloom.llm._words import EXACT, NOT_SPACE, Words, mix, words_of
from graphloom.llm.automaton import SuffixAutomaton

WINDOW = 13
#: Words of an anchor.
GRAM = 7
#: Texts that one shard holds the passages of; an anchor met in more of them has several shards, by a second hash.
SHARD_TEXTS = 1000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _anchors(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window: its first word, the place of its anchor and the anchor's hash."""
    n, g = len(words.hash) - window + 1, len(words.hash) - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(g, np.uint64)
    for k in range(gram):
        h = h * _FACTOR + words.hash[k : k + g]
    h = mix(h)
    best, place = h[:n].copy(), np.arange(n)
    for k in range(1, window - gram + 1):
        less = h[k : k + n] < best
        best[less] = h[k : k + n][less]
        place[less] = np.flatnonzero(less) + k
    start = np.flatnonzero(words.doc[:n] == words.doc[window - 1 :])
    return start, place[start], best[start]


def _met(first: Broadcast):
    """key: the different anchors of each first copy of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use = may_contain(first.value, batch.column("slot").to_numpy(zero_copy_only=False))
            column = batch.column("text").filter(pa.array(use))
            for low, high in slices(column):
                buf, off = texts(column.slice(low, high - low))
                words = words_of(buf, off, NOT_SPACE, EXACT)
                start, place, key = _anchors(words)
                one = np.ones(len(start), bool)
                one[1:] = place[1:] != place[:-1]
                doc, key = words.doc[start][one], key[one]
                order = np.lexsort((key, doc))
                new = np.ones(len(order), bool)
                new[1:] = (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                yield pa.RecordBatch.from_arrays([pa.array(key[order][new].view(np.int64))], ["key"])

    return run


def _passages(first: Broadcast, shared: Broadcast, hot: Broadcast, shards: int, combine: bool):
    """doc_id, node, start, key, wh, size, words (packed hashes): passages of first copies around anchors that other texts have too.

    key is the shard: the anchor's own, or for an anchor in `hot` one of `shards`, which each window of a
    passage chooses by its hash (equal windows choose alike).
    combine: each different passage once, with the smallest doc_id of those that this task has seen since its
    memory was last emptied; else every passage, without its words.
    """
    names = ["doc_id", "node", "start", "key", "wh", "size"] + ["words"] * combine
    kinds = [pa.int64()] * 6 + [pa.binary()] * combine

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            use = pa.array(may_contain(first.value, batch.column("slot").to_numpy(zero_copy_only=False)))
            ids, nodes = (batch.column(c).filter(use).to_pylist() for c in ("doc_id", "node"))
            column = batch.column("text").filter(use)
            for low, high in slices(column):
                buf, off = texts(column.slice(low, high - low))
                words = words_of(buf, off, NOT_SPACE, EXACT)
                start, place, key = _anchors(words)
                edge = np.ones(len(place) + 1, bool)
                edge[1:-1] = (place[1:] != place[:-1]) | (words.doc[start][1:] != words.doc[start][:-1])
                edge = np.flatnonzero(edge) if len(place) else np.zeros(1, int)
                begin, end = edge[:-1], edge[1:]
                known = may_contain(shared.value, key[begin])
                begin, end = begin[known], end[known]
                alone = may_contain(hot.value, key[begin])
                out = []
                for x, y, single in zip(begin.tolist(), end.tolist(), alone.tolist(), strict=True):
                    d = int(words.doc[start[x]])
                    for p, q in [(w, w + 1) for w in range(x, y)] if single else [(x, y)]:
                        packed = words.hash[start[p] : start[q - 1] + WINDOW].tobytes()
                        wh = int.from_bytes(hashlib.blake2b(packed, digest_size=8).digest(), "little", signed=True)
                        shard = int(mix(key[x : x + 1] + np.uint64((wh % shards) + 1))[0].view(np.int64)) if single else int(key[x].view(np.int64))
                        row = (ids[low + d], nodes[low + d], int(start[p] - words.first[d]), shard, wh, q - p)
                        if not combine:
                            out.append(row)
                        elif (shard, wh) not in held or row[0] < held[shard, wh][0]:
                            held[shard, wh] = (*row, packed)
                if out:
                    yield batch_of(out)
                if len(held) > 100_000:
                    yield batch_of(list(held.values()))
                    held.clear()
        if combine:
            yield batch_of(list(held.values()))

    return run


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, wh, first document and the windows (bits) that occur in documents before it, for every different passage.

    Rows come by shard and doc_id; passages of one document enter the automaton after all of them are judged.
    """
    names = ["key", "wh", "first_id", "bits"]
    shard, doc, waiting, automaton, seen = None, None, [], None, set()
    for batch in batches:
        out = []
        for key, wh, first_id, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "wh", "doc_id", "words")), strict=True):
            if key != shard:
                shard, doc, waiting, automaton, seen = key, first_id, [], None, set()
            elif first_id != doc:
                automaton = automaton or SuffixAutomaton()
                for w in waiting:
                    automaton.add(w)
                doc, waiting = first_id, []
            if wh in seen:
                continue
            seen.add(wh)
            words = np.frombuffer(raw, np.uint64).tolist()
            bits = 0
            if automaton is not None:
                for k, (_, matched) in enumerate(automaton.walk(words)):
                    if matched >= WINDOW:
                        bits |= 1 << (k + 1 - WINDOW)
            waiting.append(words)
            out.append((key, wh, first_id, bits))
        c = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in c], names)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and the text without the words of repeated windows."""
    for batch in batches:
        keep = [c for c in batch.schema.names if c not in ("text", "node", "copy", "windows")]
        out = []
        for text, copy, windows in zip(batch.column("text"), batch.column("copy").to_pylist(), batch.column("windows").to_pylist(), strict=True):
            words = (text.as_py() or "").encode().split()
            gone = np.zeros(len(words), bool)
            if copy and len(words) >= WINDOW:
                gone[:] = True
            for w in windows or ():
                for k in range(w["bits"].bit_length()):
                    if w["bits"] >> k & 1:
                        gone[w["start"] + k : w["start"] + k + WINDOW] = True
            n = int(gone.sum())
            out.append((len(words), n, b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode() if n else b" ".join(words).decode()))
        c = list(zip(*out, strict=True)) or [()] * 3
        arrays = [pa.array(v, t) for v, t in zip(c, (pa.int64(), pa.int64(), pa.string()), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *arrays], [*keep, "n_words", "n_removed", "kept_text"])


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text (the words left, joined by one space).

    A window is 13 consecutive words; it is removed if it also starts in a document with a smaller doc_id.
    Windows are judged on the input.  Null texts have no words.  Rows with a null id are neither compared
    nor changed; rows that share an id don't count as earlier than each other; repeated rows all come back.
    Texts are told apart by 128 bits and words by 64.  Texts are shuffled once, by doc_id.

    shard_texts sets the size of shards alone: an anchor met in more texts than that is spread over
    several shards, so many that the most frequent anchor has about shard_texts texts in each.  Equal
    passages are aggregated before they reach a shard.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("node", F.xxhash64("text", F.octet_length("text")))
    known = rows.where(F.col("doc_id").isNotNull()).withColumn("slot", F.xxhash64("doc_id", "node"))
    ids = materialise(known.select("doc_id", "node", F.xxhash64(F.lit("second seed"), "text").alias("twin")).distinct(), "ids")
    firsts = materialise(ids.groupBy("node", "twin").agg(F.min("doc_id").alias("first_id")), "firsts")
    first = key_filter(firsts.select(F.xxhash64("first_id", "node").alias("key")))
    counted = materialise(known.mapInArrow(_met(first), "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    shared, hot = key_filter(counted.select("key")), key_filter(counted.where(F.col("n") > shard_texts).select("key"))
    most = counted.agg(F.max("n").alias("n")).first()["n"] or 1
    shards = -(-most // shard_texts)
    narrow = "doc_id long, node long, start long, key long, wh long, size long"
    different = known.mapInArrow(_passages(first, shared, hot, shards, True), narrow + ", words binary").select("key", "wh", "doc_id", "words")
    judged = different.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_judged, "key long, wh long, first_id long, bits long")
    whole = (F.pow(F.lit(2.0), F.col("size")) - 1).cast("long")  # a bit for each window
    windows = known.mapInArrow(_passages(first, shared, hot, shards, False), narrow).withColumn("whole", whole).join(judged, ["key", "wh"])
    windows = windows.select("doc_id", "node", "start", F.when(F.col("doc_id") > F.col("first_id"), F.col("whole")).otherwise(F.col("bits")).alias("bits")).where("bits <> 0")
    windows = windows.groupBy("doc_id", "node").agg(F.collect_list(F.struct("start", "bits")).alias("windows"))
    copies = join_skewed(ids, firsts, ["node", "twin"]).select("doc_id", "node", (F.col("doc_id") > F.col("first_id")).alias("copy"))
    verdict = materialise(copies.join(windows, ["doc_id", "node"], "left").where("copy OR windows IS NOT NULL"), "verdict")
    discard(ids, firsts, counted)
    judged_rows = known.join(verdict, ["doc_id", "node"], "left").select("doc_id", "text", "node", "copy", "windows")
    loose = rows.where(F.col("doc_id").isNull()).select("doc_id", "text", "node", F.lit(False).alias("copy"), F.lit(None).cast("array<struct<start: long, bits: long>>").alias("windows"))
    return judged_rows.unionByName(loose).mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_text string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document without the 13-word windows of earlier ones."""
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 12), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
least_id AS (SELECT g, min(doc_id) AS first_id FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM win JOIN least_id USING (g) WHERE doc_id > first_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS word FROM d),
kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.q) AS t FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.q = gone.q WHERE gone.q IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
