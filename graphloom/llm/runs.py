"""Periodic runs of words: every maximal stretch that repeats with some period, found by Lyndon words.

A run's Lyndon root is the longest Lyndon word at some place of the run, under the order of the words or
under its reverse.  So for both orders a stack is scanned from right to left (a place's longest Lyndon word
ends where the next smaller suffix begins), and each such word is extended to both sides as far as its period
holds.  Comparing and extending ask for longest common extensions: binary searches over rolling hashes; what is
reported is compared word by word, and if that ever fails, the extensions of that text are done by words alone.

Runs asked for hold three periods and 24 words at least, so each eight words of one occur again in its text a
period away.  Stretches of which that isn't so (almost all prose) hold no run and are left out before the stack.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._common import bounded_batches, table
from graphloom.llm._words import mix

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of the windows that must occur again; every run holds two periods and GRAM - 1 words.
GRAM = 8
_PRIME = (1 << 61) - 1

Run = tuple[int, int, int]  # start, length, period


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches outside of which there is no run: each GRAM words of one occur again nearby, a third of its length away at most."""
    n = len(ids) - GRAM + 1
    if len(ids) < LEAST_WORDS:
        return []
    x, h = mix(ids.astype(np.uint64) + np.uint64(1)), np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[k : k + n]
    order = np.argsort(h, kind="stable")
    near = np.full(n, len(ids), np.int64)  # distance to the nearest equal window
    same = h[order[1:]] == h[order[:-1]]
    a, b = order[:-1][same], order[1:][same]
    near[a] = b - a
    near[b] = np.minimum(near[b], b - a)
    found, open_ = [], [(0, n)]
    while open_:
        lo, hi = open_.pop()
        inside = np.zeros(hi - lo + 2, bool)
        inside[1:-1] = near[lo:hi] <= (hi - lo + GRAM - 1) // LEAST_PERIODS
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + lo
        for u, v in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if v - u + GRAM - 1 >= LEAST_WORDS:
                (found if (u, v) == (lo, hi) else open_).append((u, v))
    return sorted((u, v + GRAM - 1) for u, v in found)


def _by_words(s: list[int]) -> tuple[Callable[[int, int], int], Callable[[int, int], int]]:
    """Longest common extensions to the right of two places and to the left of them, word by word."""

    def right(i: int, j: int) -> int:
        k = 0
        while j + k < len(s) and s[i + k] == s[j + k]:
            k += 1
        return k

    def left(i: int, j: int) -> int:
        k = 0
        while k < i and s[i - 1 - k] == s[j - 1 - k]:
            k += 1
        return k

    return right, left


def _by_hashes(s: list[int], base: int) -> tuple[Callable[[int, int], int], Callable[[int, int], int]]:
    """The same by rolling hashes: steps that double, then a binary search.  In both, i < j.

    A match that was found for a distance is kept: a later one that reaches its start goes on to its end.
    """
    n, total, factor = len(s), [0], [1]
    for x in s:
        total.append((total[-1] * base + x + 1) % _PRIME)
        factor.append(factor[-1] * base % _PRIME)
    known: dict[int, tuple[int, int]] = {}

    def equal(i: int, j: int, k: int) -> bool:
        return (total[i + k] - total[i] * factor[k] - total[j + k] + total[j] * factor[k]) % _PRIME == 0

    def longest(most: int, same: Callable[[int], bool]) -> int:
        low, step = 0, 4
        while step <= most and same(step):
            low, step = step, 2 * step
        high = min(step, most + 1)  # same(high) is false
        while high - low > 1:
            middle = (low + high) // 2
            if same(middle):
                low = middle
            else:
                high = middle
        return low

    def right(i: int, j: int) -> int:
        if j >= n or s[i] != s[j]:
            return 0
        at, end = known.get(j - i, (-1, 0))
        if at > i and at - i <= 32 and s[i:at] == s[j : j + at - i]:
            k = end - i
        else:
            k = longest(n - j, lambda m: equal(i, j, m))
        known[j - i] = i, i + k
        return k

    def left(i: int, j: int) -> int:
        if i == 0 or s[i - 1] != s[j - 1]:
            return 0
        return longest(i, lambda m: equal(i - m, j - m, m))

    return right, left


def _lyndon_ends(s: list[int], right: Callable[[int, int], int], reverse: bool) -> list[int]:
    """Where each place's longest Lyndon word ends under the order of the numbers or its reverse (a prefix is the smaller one)."""
    n = len(s)
    ends = [0] * n
    for i in range(n - 1, -1, -1):
        j = i + 1
        while j < n:
            a, b = s[i], s[j]
            if a == b:
                k = right(i, j)
                if j + k == n:
                    break
                a, b = s[i + k], s[j + k]
            if (a < b) == reverse:
                break
            j = ends[j]
        ends[i] = j
    return ends


def _lyndon_runs(s: list[int], right: Callable[[int, int], int], left: Callable[[int, int], int]) -> set[Run]:
    found: set[Run] = set()
    n = len(s)
    for reverse in (False, True):
        last: dict[int, int] = {}  # period: end of the last run with it
        for i, j in enumerate(_lyndon_ends(s, right, reverse)):
            p = j - i
            if LEAST_PERIODS * p > n or last.get(p, 0) >= j:
                continue
            start = i - left(i, j)
            end = j + right(i, j)
            last[p] = end
            if end - start >= max(LEAST_WORDS, LEAST_PERIODS * p):
                found.add((start, end - start, p))
    return found


def word_runs(ids: np.ndarray, seed: int = 1) -> list[Run]:
    """All maximal runs (start, length, smallest period) of a text's words, given as numbers, by start and period."""
    out: list[Run] = []
    for lo, hi in stretches(ids):
        part = ids[lo:hi]
        s = part.tolist()
        base = 1 + int(mix(np.array([seed & 0x7FFFFFFFFFFFFFFF, hi], np.uint64)).sum()) % (_PRIME - 2)
        found = _lyndon_runs(s, *_by_hashes(s, base))
        holds = lambda a, n, p: np.array_equal(part[a : a + n - p], part[a + p : a + n]) and (a == 0 or s[a - 1] != s[a + p - 1]) and (a + n == len(s) or s[a + n] != s[a + n - p])
        if not all(holds(*r) for r in found):
            found = _lyndon_runs(s, *_by_words(s))
        out += [(lo + a, n, p) for a, n, p in found]
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers, different words different ones."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]


_FOUND = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        runs, kept = [], []
        for text in batch.column("_text").cast(pa.large_binary()):
            data = text.as_py() or b""
            words = data.split()
            seed = int.from_bytes(hashlib.blake2b(data, digest_size=7).digest(), "little") if len(words) >= LEAST_WORDS else 0
            found = word_runs(numbered(words), seed) if len(words) >= LEAST_WORDS else []
            runs.append([{"start": a, "length": n, "period": p} for a, n, p in found])
            kept.append(b" ".join(collapsed(words, found)))
        yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())], ["rest", "runs", "collapsed"])


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (array of start, length, period by start and period; word numbers from 0), collapsed.

    Words are what ASCII white space parts.  A run is a stretch with a smallest period q (words q apart are
    equal) of at least max(24, 3 q) words that no neighbouring word extends.  collapsed is the text's words,
    joined by single spaces, without those that a run holds after its first q words.  Null and empty texts have no
    words, no runs and an empty collapsed text; every row, repeated or with a null id, is searched on its own; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.struct(docs[id_col].alias("id")).alias("rest"), docs[text_col].cast("string").alias("_text"))
    found = rows.mapInArrow(_searched, f"rest struct<id: {kind}>, {_FOUND}")
    return found.select(F.col("rest.id").alias("doc_id"), "runs", "collapsed")


def collapse_runs(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs, in its own columns, with every run cut to its first period; texts without a run stay as they are, null texts null."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("rest"), docs[text_col].cast("string").alias("_text"))
    found = rows.mapInArrow(_searched, f"rest {rows.schema['rest'].dataType.simpleString()}, {_FOUND}")
    own = F.col("rest").getField(text_col)
    text = F.when(own.isNotNull() & (F.size("runs") > 0), F.col("collapsed")).otherwise(own)
    return found.select(*[text.alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns])


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period (exactly; ties: smallest start, then period); null if there is none."""

    def better(best: Column, r: Column) -> Column:
        a, b = r["length"] * best["period"], best["length"] * r["period"]
        return F.when(best.isNull() | (a > b), r).otherwise(best)  # runs come by start and period

    return F.aggregate(runs, F.get(runs, F.lit(0)), better)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: of documents whose h = crc32(doc_id) ends in 0, the words from a on repeat a period, as the query states it; others stay."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def edited(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        source = lambda i, a, p: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        spread = lambda b: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, source(i, b["a"], b["p"]).cast("int")))
        return F.when(n > 0, F.array_join(_let(F.struct(a.alias("a"), p.alias("p")), spread), " "))

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(h % 10 == 0, F.coalesce(_let(words, edited), F.col("text"))).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: periodic runs of every document, after a tenth of them were made periodic from some word on."""
    found = find_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = found.withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
