"""Words of UTF-8 texts as NumPy arrays: bounds, documents and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes hashed at once; bounds the temporary arrays (8 bytes for each byte of text) for texts of any length.
SEGMENT = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    h = h.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    size = 1
    while size < n:
        step = min(size, n - size)
        out[size : size + step] = out[:step] * np.uint64(pow(base, size, 1 << 64))
        size += step
    return out


_POW = _powers(_MULTIPLIER, SEGMENT + 1)
_INV = _powers(pow(_MULTIPLIER, -1, 1 << 64), SEGMENT + 1)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans: the bytes that belong to words."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Everything but ASCII white space (what bytes.split() leaves).
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: ASCII digits and letters and all that is not ASCII.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
EXACT = np.arange(256, dtype=np.uint8)


@dataclass
class Words:
    """starts, ends: byte bounds of each word; doc: its row; hash: of its bytes; first: index of each row's first word (rows + 1)."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def _hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Polynomial hash of each word over its folded bytes; words are handled in runs of SEGMENT bytes."""
    out = np.empty(len(starts), np.uint64)
    values, at = _BYTES[fold], 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + SEGMENT, "right")))
        s, e = starts[at:to] - low, ends[at:to] - low
        span = int(e[-1])
        if span <= SEGMENT:
            sums = np.zeros(span + 1, np.uint64)
            np.cumsum(values[buf[low : low + span]] * _POW[:span], out=sums[1:])
            out[at:to] = (sums[e] - sums[s]) * _INV[s]
        else:  # one word longer than a segment
            total, factor = 0, 1
            for k in range(0, span, SEGMENT):
                part = buf[low + k : low + min(span, k + SEGMENT)]
                total = (total + factor * int((values[part] * _POW[: len(part)]).sum(dtype=np.uint64))) & _MASK
                factor = factor * pow(_MULTIPLIER, SEGMENT, 1 << 64) & _MASK
            out[at] = total
        at = to
    return mix(out ^ ((ends - starts).astype(np.uint64) << np.uint64(56)))


def words_of(buf: np.ndarray, off: np.ndarray, kind: np.ndarray, fold: np.ndarray = EXACT) -> Words:
    """All words of the rows whose texts lie between successive offsets of buf."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = kind[buf]
    begin = inside[1:-1] & ~inside[:-2]
    final = inside[1:-1] & ~inside[2:]
    edges = off[:-1][off[:-1] < off[1:]]  # neighbouring texts touch each other in the buffer
    begin[edges] = inside[1:-1][edges]
    last = off[1:][off[:-1] < off[1:]] - 1
    final[last] = inside[1:-1][last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(final) + 1
    first = np.searchsorted(starts, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(starts, ends, doc, _hashes(buf, starts, ends, fold), first)


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every run of n words inside one row."""
    count = len(words.hash) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(count, np.uint64)
    for k in range(n):
        h = h * np.uint64(_MULTIPLIER) + words.hash[k : k + count]
    at = np.flatnonzero(words.doc[:count] == words.doc[n - 1 :])
    return at, mix(h[at])
