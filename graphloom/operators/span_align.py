"""Where extracted words stand in their passage: a ladder from exact to approximate, in Arrow batches.

The last rung compares windows of one to five words with the wanted text by the share of characters that
matching blocks hold.  Two bounds sort windows out before: the characters that both have at all (counted for all windows at
once), and the longest common subsequence (bit-parallel: one addition of whole numbers a character).  Windows are
compared from the best bound on and no more once the best ratio beats the next bound, so the result is that of comparing all.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.tables import table

#: Characters that are trimmed, letters of endings, least ratio, words of a window, its length against the wanted one's.
TRIM = "\"'`.,;:()[]{}<>«»„“\t\n\r"
ENDINGS = "a-zA-ZáéíóöőúüűÁÉÍÓÖŐÚÜŰ-"
RATIO, WORDS, SHORTEST, LONGEST = 0.70, 5, 0.8, 1.3

Found = tuple[int, int, float]  # start, stop, confidence


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; bit k of a whole number stands for a's letter k."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    open_ = full
    for c in b:
        hit = open_ & places.get(c, 0)
        open_ = (open_ + hit | open_ - hit) & full
    return len(a) - open_.bit_count()


def _windows(text: str, wanted: int) -> np.ndarray:
    """start and stop of runs of one to five words whose length is near the wanted one, in the order of their words."""
    spans = np.array([m.span() for m in re.finditer(r"\S+", text)], np.int64).reshape(-1, 2)
    n = len(spans)
    first = np.repeat(np.arange(n), WORDS)
    last = first + np.tile(np.arange(WORDS), n)
    inside = last < n
    out = np.stack([spans[first[inside], 0], spans[last[inside], 1]], axis=1)
    length = out[:, 1] - out[:, 0]
    return out[(length >= max(1, int(wanted * SHORTEST))) & (length <= int(wanted * LONGEST) + 2)]


def closest(text: str, target: str, least: float = RATIO) -> Found | None:
    """The window of a text most like the target (in lower case), the first of equals, with its ratio; null below `least`."""
    low = target.lower()
    spans = _windows(text, len(target))
    if not len(spans):
        return None
    shared = np.zeros(len(spans), np.int64)
    # windows are lowered one by one below; here a letter and its lower form count alike
    codes = np.array([ord(c.lower()) if len(c.lower()) == 1 else -1 for c in text], np.int64)
    odd = np.concatenate([[0], np.cumsum(codes < 0)])
    for c in set(low):
        here = np.concatenate([[0], np.cumsum(codes == ord(c))])
        shared += np.minimum(low.count(c), here[spans[:, 1]] - here[spans[:, 0]])
    shared += 3 * (odd[spans[:, 1]] - odd[spans[:, 0]])  # letters whose lower case is longer
    length = spans[:, 1] - spans[:, 0]
    bound = 2 * shared / (len(low) + length)
    best: tuple[float, int] | None = None
    for k in np.lexsort((np.arange(len(spans)), -bound)):
        if bound[k] < (best[0] if best else least):
            break
        window = text[spans[k, 0] : spans[k, 1]].lower()
        if 2 * common_length(low, window) / (len(low) + len(window)) < (best[0] if best else least):
            continue
        ratio = difflib.SequenceMatcher(None, low, window).ratio()
        if best is None or (-ratio, k) < (-best[0], best[1]):
            best = ratio, int(k)
    if best is None or best[0] < least:
        return None
    return int(spans[best[1], 0]), int(spans[best[1], 1]), round(best[0], 3)


def located(text: str, span: str, hint: int = 0, least: float = RATIO) -> Found | None:
    """Where a span stands in a text, first from the hint on, then anywhere; each rung is tried on the whole text before the next."""
    if not text or not span:
        return None
    hint = max(0, min(hint, len(text)))
    trimmed = span.strip(TRIM)
    target = trimmed or span

    def find(where: str, what: str) -> int:
        at = where.find(what, hint)
        return at if at >= 0 else where.find(what)

    def search(pattern: str) -> tuple[int, int] | None:
        compiled = re.compile(pattern, re.IGNORECASE)
        m = compiled.search(text[hint:])
        if m:
            return hint + m.start(), hint + m.end()
        m = compiled.search(text)
        return m.span() if m else None

    if trimmed and trimmed != span and (at := find(text, trimmed)) >= 0:
        return at, at + len(trimmed), 0.98
    if (at := find(text, span)) >= 0:
        return at, at + len(span), 1.0
    if (at := find(text.lower(), target.lower())) >= 0:
        return at, at + len(target), 0.95
    words = target.split()
    if len(words) > 1 and (found := search(r"\s+".join(map(re.escape, words)))):
        return *found, 0.92
    if found := search(rf"\b{re.escape(target)}[{ENDINGS}]*\b"):
        return *found, 0.88
    return closest(text, target, least)


_KIND = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("byte_start", pa.int64()), ("byte_stop", pa.int64()), ("matched", pa.string()), ("confidence", pa.float64())])


def aligned(rows: DataFrame, *, passage: str = "passage", span: str = "span", hint: str | None = None, least: float = RATIO) -> DataFrame:
    """rows with `alignment`: struct(start, stop, byte_start, byte_stop, matched, confidence), null where nothing is found.

    Confidence by rung: 0.98 without the outer punctuation, 1.0 as it stands, 0.95 in any case, 0.92 with any white
    space between its words, 0.88 as the beginning of a word, else the ratio (3 digits) of the most similar window, `least` or more.
    Positions are code points, stop exclusive.  A hint is where the search starts.  Null or empty passages and spans find nothing.
    """
    columns = [c for c in rows.columns if c != "alignment"]
    packed = rows.select(F.struct(*[rows[c] for c in columns]).alias("rest"), rows[passage].cast("string").alias("p"), rows[span].cast("string").alias("s"), (F.coalesce(rows[hint].cast("int"), F.lit(0)) if hint else F.lit(0)).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, what, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found = located(text or "", what or "", h, least)
                if found is None:
                    out.append(None)
                    continue
                start, stop, confidence = found
                before = len(text[:start].encode())
                out.append({"start": start, "stop": stop, "byte_start": before, "byte_stop": before + len(text[start:stop].encode()), "matched": text[start:stop], "confidence": confidence})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _KIND)], ["rest", "alignment"])

    done = packed.mapInArrow(run, f"rest {packed.schema['rest'].dataType.simpleString()}, alignment struct<start: bigint, stop: bigint, byte_start: bigint, byte_stop: bigint, matched: string, confidence: double>")
    return done.select(*[F.col("rest").getField(c).alias(c) for c in columns], "alignment")


def q_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stretch from the middle of every document: as it stands, in brackets, in capitals, with other white space, without the end of its last word, or with letters lost."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("passage"))
    s = F.coalesce(F.try_element_at(F.regexp_extract_all("passage", F.lit(r"\S+\s+\S+\s+\S+"), F.lit(0)), F.lit(3)), F.lit("nothing"))
    k = F.col("doc_id") % 6
    shorter = F.regexp_replace(s, r"^\S+\s+\S+\s+|\S{1,2}$", "")
    span = F.when(k == 0, s).when(k == 1, F.concat(F.lit("("), s, F.lit(").«"))).when(k == 2, F.upper(s)).when(k == 3, F.regexp_replace(s, r"\s+", " \t ")).when(k == 4, shorter).otherwise(F.regexp_replace(s, r"(\S{2})\S(\S)", "$1$2"))
    found = aligned(d.withColumn("span", span))
    return found.select("doc_id", *[F.col("alignment")[c].alias(c) for c in ("start", "stop", "byte_start", "byte_stop", "matched", "confidence")])


QUERIES = {"span_ladder": q_ladder}
ORACLE_SQL: dict[str, str] = {}
