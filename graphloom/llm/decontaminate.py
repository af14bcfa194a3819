"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

Words of the documents are hashed in bulk; only runs of words that all occur in some item are streamed
through the automaton, which starts anew at any other word anyway.  A match of at least the window's
length marks its last words as hit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._common import bounded_batches, discard, materialise, slices, table, texts
from graphloom.llm._words import ALNUM, LOWER, words_of
from graphloom.llm.automaton import SuffixAutomaton

WINDOW = 10
#: Words of test items in one automaton (about 100 MB of states); more items make more automata, used one after another.
SHARD_WORDS = 200_000
#: Automata that one pass over the documents uses; after it what was found is written and they are let go.
TOGETHER = 4
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_WORD_TEXT = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_STATE = "_hits array<int>, _items array<string>"


@dataclass
class Shard:
    """One automaton: windows[state]: items that hold the window ending there; short[state]: (length, item); up[state]: next state with short items."""

    automaton: SuffixAutomaton
    vocabulary: dict[bytes, int]
    hashes: np.ndarray
    windows: dict[int, list[int]]
    short: dict[int, list[tuple[int, int]]]
    up: list[int]
    names: list[str | None]
    least: int

    @classmethod
    def build(cls, items: list[tuple[str | None, bytes]], window: int) -> Shard:
        vocabulary: dict[bytes, int] = {}
        tokens = [[vocabulary.setdefault(w, len(vocabulary)) for w in _WORD.findall(text.lower())] for _, text in items]
        automaton = SuffixAutomaton(t for t in tokens if t)
        windows: dict[int, set[int]] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        for item, sequence in enumerate(tokens):
            state = matched = 0
            for state, matched in automaton.walk(sequence):
                if matched >= window:
                    windows.setdefault(automaton.suffix(state, window), set()).add(item)
            if 0 < len(sequence) < window:
                short.setdefault(automaton.suffix(state, matched), []).append((matched, item))
        up = [0] * len(automaton.next)
        for state in sorted(range(1, len(up)), key=automaton.length.__getitem__):
            link = automaton.link[state]
            up[state] = link if link in short else up[link]
        raw = b"\n".join(vocabulary)
        ends = np.cumsum([len(w) + 1 for w in vocabulary]) if vocabulary else np.zeros(0, np.int64)
        hashes = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM).hash if len(ends) else np.zeros(0, np.uint64)
        lengths = [len(t) for t in tokens if t]
        return cls(automaton, vocabulary, np.sort(hashes), {k: sorted(v) for k, v in windows.items()}, short, up, [n for n, _ in items], min([window, *lengths]))

    def match(self, words: list[int | None], window: int) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit ranges (first, end) of a run of words, and the items whose windows occur in it."""
        hits: list[tuple[int, int]] = []
        items: set[int] = set()
        automaton, state, matched = self.automaton, 0, 0
        for k, word in enumerate(words):
            if word is None:
                state = matched = 0
                continue
            state, matched = automaton.step(state, matched, word)
            if matched >= window:
                hits.append((k + 1 - window, k + 1))
                items.update(self.windows[automaton.suffix(state, window)])
            at = state if state in self.short else self.up[state]
            while at:
                for length, item in self.short[at]:
                    if length <= matched:
                        hits.append((k + 1 - length, k + 1))
                        items.add(item)
                at = self.up[at]
        return hits, items


def _ranges(hits: list[tuple[int, int]]) -> list[int]:
    """Merged ranges as a flat list: first, end, first, end, ..."""
    out: list[int] = []
    for low, high in sorted(hits):
        if out and low <= out[-1]:
            out[-1] = max(out[-1], high)
        else:
            out += [low, high]
    return out


def _matched(shard: Broadcast, window: int, carried: bool):
    """Add this shard's hits and items to those of the shards before."""

    def rows(batch: pa.RecordBatch) -> tuple[list, list]:
        s: Shard = shard.value
        hits_out = batch.column("_hits").to_pylist() if carried else [[] for _ in range(batch.num_rows)]
        items_out = batch.column("_items").to_pylist() if carried else [[] for _ in range(batch.num_rows)]
        column = batch.column("_text")
        for low, high in slices(column):
            buf, off = texts(column.slice(low, high - low))
            words = words_of(buf, off, ALNUM, LOWER)
            if not len(words.hash) or not len(s.hashes):
                continue
            at = np.searchsorted(s.hashes, words.hash)
            known = s.hashes[np.minimum(at, len(s.hashes) - 1)] == words.hash
            edge = np.flatnonzero(np.diff(np.concatenate([[0], known.astype(np.int8), [0]])) | np.concatenate([[0], np.diff(words.doc), [0]]))
            for a, b in zip(edge[:-1], edge[1:], strict=True) if len(edge) else ():
                if b - a < s.least or not known[a]:
                    continue
                run = [s.vocabulary.get(buf[words.starts[k] : words.ends[k]].tobytes().lower()) for k in range(a, b)]
                hits, items = s.match(run, window)
                if hits:
                    doc = int(words.doc[a])
                    shift, row = int(a - words.first[doc]), low + doc
                    before = list(zip(hits_out[row][::2], hits_out[row][1::2], strict=True))
                    hits_out[row] = _ranges(before + [(x + shift, y + shift) for x, y in hits])
                    items_out[row] = items_out[row] + [s.names[k] for k in sorted(items)]
        return hits_out, items_out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, items = rows(batch)
            keep = [c for c in batch.schema.names if c not in ("_hits", "_items")]
            arrays = [batch.column(c) for c in keep] + [pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "_hits", "_items"])

    return run


def _chained(steps: list):
    """The steps one after another in one Python worker, so that a task needs one whatever the number of automata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        yield from batches

    return run


def _cleaned(min_words: int, max_coverage: float):
    """From hits to counts, digest and clean text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            column = batch.column("_text")
            n_words = np.zeros(batch.num_rows, np.int64)
            for low, high in slices(column):
                buf, off = texts(column.slice(low, high - low))
                n_words[low:high] = np.diff(words_of(buf, off, ALNUM, LOWER).first)
            for k, (hits, items) in enumerate(zip(batch.column("_hits").to_pylist(), batch.column("_items").to_pylist(), strict=True)):
                spans = list(zip(hits[::2], hits[1::2], strict=True))
                n_hit = sum(b - a for a, b in spans)
                found = sorted({x for x in items if x is not None})
                digest = hashlib.sha256(",".join(found).encode()).hexdigest()
                text, drop = column[k].as_py(), False
                if spans:
                    drop = n_hit > max_coverage * n_words[k]
                    raw = text.encode()
                    bounds = [m.span() for m in _WORD.finditer(raw.lower())]
                    for a, b in reversed(spans):
                        if b - a >= min_words:
                            raw = raw[: bounds[a][0]] + raw[bounds[b - 1][1] :]
                    text = raw.decode()
                out.append((int(n_words[k]), n_hit, len(set(items)), digest, n_hit > 0, text, drop, hits))
            keep = [c for c in batch.schema.names if c not in ("_text", "_hits", "_items")]
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.bool_(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                [*keep, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "clean_text", "over_coverage", "hit_ranges"],
            )

    return run


def _shards(bench: DataFrame, id_col: str, text_col: str, window: int, shard_words: int) -> Iterator[Shard]:
    """Automata of the test items, shard_words words each; their number follows the counted words of the table."""
    items = bench.select(F.col(id_col).cast("string").alias("name"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = items.select(F.sum(F.length("text"))).first()[0] or 0  # characters: an upper bound of the words
    n = 1 + total // (2 * shard_words)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k).orderBy("name", "text").toLocalIterator()
        yield Shard.build([(r["name"], r["text"].encode()) for r in part], window)


def find_contamination(
    docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bench_id: str = "item_id", bench_text: str = "text",
    keep: tuple[str, ...] = (), window: int = WINDOW, min_words: int = 1, max_coverage: float = 0.8, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row per row of docs: doc_id, rest (a struct of the columns named in keep, if any), n_words, n_hit, n_items, items_sha256, contaminated, clean_text, over_coverage, hit_ranges.

    A window is `window` consecutive words of an item (a shorter item is one window; an item without words
    none).  clean_text lacks the hit spans of at least min_words words; over_coverage marks documents of
    which more than max_coverage of the words is hit.  Null texts have no words (clean_text stays null),
    null items none; an item with a null id marks hits and counts once but isn't listed; items that share
    an id count once.  hit_ranges is flat: first word, end, first word, end, ...

    Each automaton is broadcast and holds shard_words words at most (a single longer item excepted); a larger
    benchmark passes through several automata in turn, without a shuffle of the documents.  TOGETHER of them
    share a pass; then the documents are written with what was found and the automata are let go, so memory
    doesn't grow with the benchmark.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rest = [F.struct(*[docs[c] for c in keep]).alias("rest")] if keep else []
    df = docs.select(docs[id_col].alias("doc_id"), *rest, docs[text_col].cast("string").alias("_text"))
    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "_text")
    held: list[Broadcast] = []
    steps: list = []
    written: DataFrame | None = None
    for k, shard in enumerate(_shards(bench, bench_id, bench_text, window, shard_words)):
        if len(held) == TOGETHER:
            before, written = written, materialise(df.mapInArrow(_chained(steps), f"{base}, _text string, {_STATE}"), "matched")
            df = written
            for automaton in held:
                automaton.destroy()
            held, steps = [], []
            if before is not None:
                discard(before)
        held.append(spark.sparkContext.broadcast(shard))
        steps.append(_matched(held[-1], window, k > 0))
    out = f"{base}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, clean_text string, over_coverage boolean, hit_ranges array<int>"
    return df.mapInArrow(_chained([*steps, _cleaned(min_words, max_coverage)]), out)


def decontaminate(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with hit spans removed, in its own columns; documents over the coverage limit go, all others stay.  Extra columns may have any names."""
    keep = tuple(c for c in docs.columns if c != text_col)
    found = find_contamination(docs, bench, id_col=id_col, text_col=text_col, keep=keep, **options).where(~F.col("over_coverage"))
    return found.select(*[F.col("clean_text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns])


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: words of every document inside windows of 10 words of any benchmark item."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP2_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
lens AS (SELECT DISTINCT least(len(w), 10) AS n FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, list_slice(w, p, p + n - 1) AS g FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
grams AS (SELECT doc_id, n, p, list_slice(w, p, p + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
found AS (SELECT doc_id, grams.n, p, item_id FROM grams JOIN win ON grams.g = win.g AND grams.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
