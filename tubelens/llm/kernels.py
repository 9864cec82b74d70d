"""Numpy kernels over a flat byte buffer: many texts at once, no per-word Python objects.

Texts are laid end to end as UTF-8 bytes. A word is a maximal run of bytes other than space and
0x09-0x0D, so multi-byte characters never split. Hashes are 64-bit; rolling ones are polynomial
over randomised symbols and finished by a mixer.
"""
from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_R = U(0x9E3779B97F4A7C15 | 1)
_RINV = U(pow(int(_R), -1, 1 << 64))
CHUNK_BYTES = 1 << 18  # the arrays of a chunk stay in the processor's cache


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U(30))
        h = h * U(0xBF58476D1CE4E5B9)
        h = h ^ (h >> U(27))
        h = h * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD1342543DE82EF95))
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
#: Letter runs: everything but ASCII letters and bytes of longer characters divides.
NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)[:n]


_POW = [powers(_R, 1 << 16), powers(_RINV, 1 << 16)]


def _pows(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        _POW[0], _POW[1] = powers(_R, n), powers(_RINV, n)
    return _POW[0][:n], _POW[1][:n]


def prefix(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums of symbol[i] * r^i, with a leading zero."""
    out = np.zeros(len(symbols) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(symbols * _pows(len(symbols))[0], out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of symbols[start:end], the same wherever the span lies."""
    with np.errstate(over="ignore"):
        inv = _pows(len(pre))[1]
        return mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(np.uint64))


def rolling(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive symbols; empty when there are fewer."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    pre = prefix(symbols)
    with np.errstate(over="ignore"):
        return mix((pre[k:] - pre[:n]) * _pows(len(pre))[1][:n] + U(k))


class Words:
    """Word hashes of a run of texts. ``doc[i]`` is the text of word i; ``lo[d]:hi[d]`` its words."""

    __slots__ = ("buf", "at", "start", "end", "hash", "doc", "lo", "hi")

    def __init__(self, buf: np.ndarray, at: np.ndarray, lower: bool = False, gap: np.ndarray = _GAP):
        if lower:
            buf = _LOWER[buf]
        n, docs = len(buf), len(at) - 1
        word = ~gap[buf] if n else np.zeros(0, dtype=bool)
        edge = np.zeros(n + 1, dtype=bool)
        edge[at] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[1:n]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:n]
        self.buf, self.at = buf, at
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        pre = prefix(_BYTE[buf])
        self.hash = span_hash(pre, self.start, self.end)
        self.lo, self.hi = np.searchsorted(self.start, at[:-1]), np.searchsorted(self.start, at[1:])
        self.doc = np.repeat(np.arange(docs), self.hi - self.lo)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``(hash, first word)`` of every k consecutive words of one text."""
        h = rolling(self.hash, k)
        at = np.flatnonzero(self.doc[:len(h)] == self.doc[k - 1:]) if len(h) else np.zeros(0, dtype=np.int64)
        return h[at], at


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of an Arrow string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + n + 1] if n else np.zeros(1, np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def pieces(at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or one longer row."""
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def chunks(batches, column: str = "text", limit: int = CHUNK_BYTES):
    """For each Arrow batch, its row ranges as ``(batch slice, bytes, offsets)``."""
    for b in batches:
        buf, at = column_bytes(b.column(column))
        for i, j in pieces(at, limit):
            yield b.slice(i, j - i), buf[at[i]:at[j]], at[i:j + 1] - at[i]


def ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Concatenated aranges lo[i] .. lo[i]+n[i]-1."""
    total = int(n.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    first = np.cumsum(n) - n
    return np.arange(total, dtype=np.int64) + np.repeat(lo - first, n)


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mask of positions inside any span [start, end)."""
    d = np.zeros(n + 1, dtype=np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, end, -1)
    return np.cumsum(d[:-1]) > 0


PLACE_BITS = 24


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """For every w consecutive hashes the position of the smallest; of equal ones (in the bits compared) the last.

    Hash and position share a number, so one running minimum gives both.
    """
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    bits = max(PLACE_BITS, len(h).bit_length())
    low = U((1 << bits) - 1)
    best = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    span = 1
    while span * 2 <= w:  # doubling: the minimum over span*2 from two of span
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if w > span:
        best = np.minimum(best[:n], best[w - span:w - span + n])
    return (low - (best[:n] & low)).astype(np.int64)
