"""Chunks of discourse: sentences filled up to a size, never across chapters, scene breaks or oversize sentences; on a batch or a stream."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.discourse import HEADING, SCENE_BREAK
from graphloom.operators.text import split_sentences
from graphloom.sources.tables import table

#: Words of a chunk, and those of a chunk in texts of more than LONG words.
LOW_HIGH, LONG_LOW_HIGH, LONG = (150, 350), (400, 800), 10_000
_HEADING, _BREAK = re.compile(HEADING), re.compile(SCENE_BREAK)
#: A heading of a numbered document may carry text on its line.
_NUMBERED = re.compile(r"(?i)\s*(?:#{1,3}\s+)?((?:document|passage)\s*\[?\d+\]?)[:.\-–—]?\s*(.*?)\s*$")

Unit = tuple[int, int, int, str | None, str | None]  # start, stop, words, chapter, title; words is -1 for a scene break


def slug(title: str) -> str:
    """The id that a heading gives its chapter."""
    return re.sub(r"[\s-]+", "_", re.sub(r"[^\w\s-]", "", title.lower())).strip("_")


def units(text: str) -> list[Unit]:
    """Sentences of a text with their chapter, and its scene breaks, in order.

    A paragraph ends at an empty line, a heading, a scene break or before an indented line; sentences don't cross its end.
    """
    out: list[Unit] = []
    chapter = title = None
    start = None  # of the open paragraph

    def close(stop: int) -> None:
        nonlocal start
        if start is not None:
            for a, b in split_sentences(text[start:stop]):
                piece = text[start + a : start + b]
                lead = len(piece) - len(piece.lstrip())
                if piece.strip():
                    out.append((start + a + lead, start + a + len(piece.rstrip()), len(piece.split()), chapter, title))
        start = None

    for m in re.finditer(r"[^\n]*\n|[^\n]+$", text):
        line, at = m[0].rstrip("\n"), m.start()
        if not line.strip():
            close(at)
        elif found := _NUMBERED.match(line):
            close(at)
            title, chapter = found[1], slug(found[1])
            if found[2]:
                start = at + found.start(2)
        elif found := _HEADING.match(line):
            close(at)
            title, chapter = found[1], slug(found[1])
        elif _BREAK.match(line):
            close(at)
            out.append((at, at + len(line), -1, chapter, title))
        else:
            if line.startswith(("    ", "\t")):
                close(at)
            start = at if start is None else start
    close(len(text))
    return out


def filled(found: list[Unit], high: int) -> list[list[Unit]]:
    """Units in chunks of at most `high` words: a new chunk at a scene break, another chapter, or where the next sentence doesn't fit; one of `high` words or more stands alone."""
    out: list[list[Unit]] = []
    open_: list[Unit] = []
    for unit in found:
        breaks, oversize = unit[2] < 0, unit[2] >= high
        if open_ and (breaks or oversize or unit[3] != open_[0][3] or sum(u[2] for u in open_) + unit[2] > high):
            out.append(open_)
            open_ = []
        if oversize:
            out.append([unit])
        elif not breaks:
            open_.append(unit)
    return [*out, open_] if open_ else out


CHUNK = "doc_id long, chunk long, start long, stop long, words long, sentences long, chapter string, title string, piece string"


def discourse_chunks(docs: DataFrame, high: int | None = None) -> DataFrame:
    """doc_id, chunk, start, stop (code points), words, sentences, chapter, title, piece of each text (doc_id, text), on a batch or a stream.

    high: words of a chunk at most; 350 if not given, 800 in texts of more than 10,000 words.  Headings and scene
    breaks belong to no chunk.  Null texts are empty and have none; every row is cut on its own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                text = text or ""
                found = units(text)
                most = high or (LONG_LOW_HIGH if sum(max(u[2], 0) for u in found) > LONG else LOW_HIGH)[1]
                for k, c in enumerate(filled(found, most)):
                    rows.append((doc_id, k, c[0][0], c[-1][1], sum(u[2] for u in c), len(c), c[0][3], c[0][4], text[c[0][0] : c[-1][1]]))
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, CHUNK)


def q_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents given two chapters and a scene break, their bodies as words without full stops: one sentence each."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_append(F.slice(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0)), 1, 400), F.lit("end")).alias("w"))
    body = F.array_join("w", " ")
    text = F.concat(F.lit("Chapter 1: One\n"), body, F.lit("\n* * *\nPart of it\n\n## Epilogue\n"), body, F.lit(". Then more. "), F.upper(body))
    return discourse_chunks(d.select("doc_id", text.alias("text"))).select("doc_id", "chunk", "words", "sentences", "chapter", F.md5("piece").alias("digest"))


QUERIES = {"discourse_chunks": q_chunks}
ORACLE_SQL = {
    "discourse_chunks": """WITH d AS (SELECT doc_id, list_append(list_slice(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), 1, 400), 'end') AS w FROM documents), b AS (SELECT doc_id, len(w) AS n, array_to_string(w, ' ') AS t, n >= 350 AS big FROM d),
u AS (SELECT doc_id, 'chapter_1_one' AS chapter, 0 AS part, t AS piece, n AS words, 1 AS sentences FROM b UNION ALL SELECT doc_id, 'chapter_1_one', 1, 'Part of it', 3, 1 FROM b
UNION ALL SELECT doc_id, 'epilogue', 2, CASE WHEN NOT big AND 2 * n + 2 <= 350 THEN t || '. Then more. ' || upper(t) WHEN NOT big AND n + 2 <= 350 THEN t || '. Then more.' ELSE t || '.' END, CASE WHEN NOT big AND 2 * n + 2 <= 350 THEN 2 * n + 2 WHEN NOT big AND n + 2 <= 350 THEN n + 2 ELSE n END, CASE WHEN NOT big AND 2 * n + 2 <= 350 THEN 3 WHEN NOT big AND n + 2 <= 350 THEN 2 ELSE 1 END FROM b
UNION ALL SELECT doc_id, 'epilogue', 3, CASE WHEN NOT big AND n + 2 <= 350 THEN upper(t) ELSE 'Then more.' END, CASE WHEN NOT big AND n + 2 <= 350 THEN n ELSE 2 END, 1 FROM b WHERE big OR 2 * n + 2 > 350
UNION ALL SELECT doc_id, 'epilogue', 4, upper(t), n, 1 FROM b WHERE big OR n + 2 > 350)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS chunk, CAST(words AS BIGINT) AS words, CAST(sentences AS BIGINT) AS sentences, chapter, md5(piece) AS digest FROM u""",
}
