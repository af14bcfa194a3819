"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents of equal length are interchangeable, so the packing is planned on the histogram of lengths
alone: at most `capacity` numbers reach the driver whatever the corpus holds.  Lengths above a third of
the capacity are matched greedily, two to a sequence at most; the smaller ones go, longest first, into
the tightest gap that holds them.  The plan says for runs of equal sequences which ranks of each length
they take; every piece then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import base64
import bisect
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm._common import bounded_batches, materialise, table

CAPACITY = 2048
SEPARATOR = 0
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
_UNUSUAL = re.compile("[^\u0000-ɏ]")


@dataclass(frozen=True)
class Run:
    """Pieces of one length, ranks first..first+count-1: per_bin in each sequence from sequence on, the first at offset."""

    length: int
    first: int
    count: int
    sequence: int
    per_bin: int
    offset: int


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Pack counts[length] pieces of each length; returns the runs.

    Steps follow the number of different lengths, not of pieces: each takes all pieces of a length or all
    sequences of a run.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    runs: list[Run] = []
    taken = dict.fromkeys(left, 0)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    sequences = 0

    def place(length: int, count: int, sequence: int, per_bin: int, offset: int) -> None:
        runs.append(Run(length, taken[length], count, sequence, per_bin, offset))
        taken[length] += count
        left[length] -= count

    large = sorted(k for k in left if 3 * k > capacity)
    for a in reversed(large):
        while left[a]:
            k = bisect.bisect_right(large, min(a, capacity - a)) - 1
            while k >= 0 and left[large[k]] < (2 if large[k] == a else 1):
                k -= 1
            if k < 0:
                bins, used = left[a], a
                place(a, bins, sequences, 1, 0)
            elif large[k] == a:
                bins, used = left[a] // 2, 2 * a
                place(a, 2 * bins, sequences, 2, 0)
            else:
                b = large[k]
                bins, used = min(left[a], left[b]), a + b
                place(a, bins, sequences, 1, 0)
                place(b, bins, sequences, 1, a)
            gaps[capacity - used].append((sequences, bins))
            sequences += bins
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        gap = s
        while left[s]:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap > capacity:
                sequence, bins, room = sequences, -(-left[s] // (capacity // s)), capacity
                sequences += bins
            else:
                (sequence, bins), room = gaps[gap].pop(), gap
            each = room // s
            full = min(bins, left[s] // each)
            if full:
                place(s, full * each, sequence, each, capacity - room)
                gaps[room - each * s].append((sequence, full))
                sequence, bins = sequence + full, bins - full
            if bins and left[s]:
                rest = left[s]
                place(s, rest, sequence, rest, capacity - room)
                gaps[room - rest * s].append((sequence, 1))
                sequence, bins = sequence + 1, bins - 1
            if bins:
                gaps[room].append((sequence, bins))
    return runs


@lru_cache(2)
def _encoder(path: str):
    """Text -> ids as the tokenizers library gives them for that file.

    A byte-level BPE file that has its ranks beside it is run by tiktoken, with the same ids at several
    times the speed; texts with characters past Latin go to the tokenizers library itself.
    """
    from pathlib import Path

    from tokenizers import Tokenizer

    slow = lru_cache(1)(lambda: Tokenizer.from_file(path))  # only where a text needs it
    ranks = Path(path).with_suffix(".tiktoken")
    if not ranks.exists():
        return lambda text: np.array(slow().encode(text, add_special_tokens=False).ids, "<u4")
    import public_tokenizers
    import tiktoken

    special = {t["content"]: t["id"] for t in json.loads(Path(path).read_text()).get("added_tokens", [])}
    pairs = (line.split() for line in ranks.read_bytes().splitlines() if line)
    fast = tiktoken.Encoding(
        ranks.stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens=special
    )

    def encode(text: str) -> np.ndarray:
        if _UNUSUAL.search(text):
            return np.array(slow().encode(text, add_special_tokens=False).ids, "<u4")
        return fast.encode_to_numpy(text, allowed_special="all")

    return encode


def _tokenised(tokenizer: str, capacity: int, separator: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = _encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            ids_out: list[np.ndarray] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), separator).astype("<u4")
                n = len(ids)
                bounds = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for piece, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    rows.append((doc_id, piece, low, high - low, zlib.crc32(ids[low:high].tobytes()), part, seen[high - low]))
                    seen[high - low] += 1
                    if keep_ids:
                        ids_out.append(ids[low:high].astype("<i4"))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            if keep_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _placed(runs: list[Run], keep: list[str]):
    runs = sorted(runs, key=lambda r: (r.length, r.first))
    length, first, sequence, per_bin, offset = (np.array([getattr(r, k) for r in runs], np.int64) for k in ("length", "first", "sequence", "per_bin", "offset"))
    keys = (length << 48) + first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "rank"))
            k = np.searchsorted(keys, (n << 48) + rank, "right") - 1
            within = rank - first[k] if len(k) else rank
            seq = sequence[k] + within // per_bin[k] if len(k) else rank
            at = offset[k] + within % per_bin[k] * n if len(k) else rank
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(seq, pa.int64()), pa.array(at, pa.int64())], [*keep, "sequence_id", "offset"])

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, separator: int = SEPARATOR, keep_ids: bool = False
) -> DataFrame:
    """Pack all rows of docs; one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null or empty text is the separator alone.  Each row is a document of its own, repeated ids
    included; a null id stays null.  A text longer than the capacity is cut into pieces of the capacity,
    the first of which may be shorter.  An empty table gives no rows; other columns are ignored.

    The tokenised pieces are written once to the shared scratch folder (lengths and checksums; ids only
    with keep_ids), which also fixes each piece's rank among those of its length in its task.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = _PIECES + (", ids array<int>" if keep_ids else "")
    pieces = materialise(rows.mapInArrow(_tokenised(str(tokenizer), capacity, separator, keep_ids), schema), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if keep_ids else [])
    ranked = pieces.join(base, ["part", "length"]).select(*keep, (F.col("rank") + F.col("base")).alias("rank"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "") + ", sequence_id long, offset long"
    return ranked.mapInArrow(_placed(plan_runs(total, capacity), keep), out)


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences of a packing with ids: sequence_id, ids (capacity ids at most), doc_ids, lengths."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths")
    )


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: pack all documents into sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
