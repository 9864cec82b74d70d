"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier are removed.

Surroundings of shared anchors meet by anchor (see ``repeats``). Their distinct ones, as far as another one of the anchor agrees
to the left and to the right, are cut into pieces that end with white
space, and the piece string's suffix array is built by grouping (``suffix``). Pieces are numbered in byte order, so
this is the byte order of the suffixes that start a piece. A 100-byte string is the bytes up to its first white space and a
prefix of such a suffix: strings are equal when the first parts are equal and no neighbour between their
suffixes has a shorter common prefix. The first place of each class stays.

Defined cases: null and empty texts have no bytes; fewer than 100 bytes are kept whole; a null id keeps all and takes
nothing from others; rows that share an id: see ``repeats``, equal ones get equal results; an empty table gives an empty
result; other columns are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tubelens.llm import repeats as R
from tubelens.llm.common import documents
from tubelens.llm.kernels import _BYTE, _GAP, column_bytes, covered, prefix, ranges, span_hash
from tubelens.llm.suffix import suffix_array

WINDOW, ANCHOR = 100, 28


def ordered_pieces(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(piece start, rank of the suffix there, bytes in common with the suffix ranked before)``."""
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[1:] = _GAP[buf]
    edge[at] = True
    start = np.flatnonzero(edge[:-1])
    stop = np.append(start[1:], len(buf))
    raw = buf.tobytes()
    names = [raw[a:b] for a, b in zip(start.tolist(), stop.tolist())]
    number = {x: i + 1 for i, x in enumerate(sorted(set(names)))}
    ids = np.array([number[x] for x in names], dtype=np.int64)
    row = np.searchsorted(at, start, side="right") - 1
    # a zero after every surrounding ends its suffixes
    place = np.arange(len(ids)) + row
    text = np.zeros(len(ids) + len(at) - 1, dtype=np.int64)
    text[place] = ids
    order = suffix_array(text)
    back = np.full(len(text), -1, dtype=np.int64)
    back[place] = np.arange(len(ids))
    order = back[order]
    order = order[order >= 0]
    rank = np.empty(len(ids), dtype=np.int64)
    rank[order] = np.arange(len(ids))
    left = at[row + 1] - start  # bytes up to the end of the surrounding
    common = np.zeros(len(ids), dtype=np.int64)
    ahead = np.lib.stride_tricks.sliding_window_view(np.concatenate([buf, np.zeros(WINDOW, dtype=np.uint8)]), WINDOW)
    step = 10_000
    for i in range(1, len(order), step):
        a, b = order[i - 1:min(i - 1 + step, len(order) - 1)], order[i:i + step]
        x = ahead[start[a]] != ahead[start[b]]
        n = np.where(x.any(1), x.argmax(1), WINDOW)
        common[i:i + len(b)] = np.minimum(n, np.minimum(left[a], left[b]))
    return start, rank, common


def classes(buf: np.ndarray, at: np.ndarray, row: np.ndarray, off: np.ndarray, window: int) -> np.ndarray:
    """For every window (surrounding, offset) the lowest index of an equal one."""
    start, rank, common = ordered_pieces(buf, at)
    s = at[row] + off
    nxt = np.searchsorted(start, s, side="right")  # the piece after the window's first white space
    to = np.append(start, len(buf))[nxt]
    head = np.minimum(to - s, window)
    pre = prefix(_BYTE[buf])
    key = span_hash(pre, s, s + head)
    need = window - head
    r = np.where(need > 0, np.append(rank, 0)[nxt], 0)
    order = np.lexsort((r, key, need))
    k, rr, nd = key[order], r[order], need[order]
    new = np.ones(len(order), dtype=bool)
    same = (k[1:] == k[:-1]) & (nd[1:] == nd[:-1])
    bounds = np.flatnonzero(np.concatenate([[True], nd[1:] != nd[:-1], [True]])) if len(nd) else np.zeros(0, np.int64)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if nd[a] == 0:
            new[a + 1:b] = ~same[a:b - 1]
        else:
            breaks = np.cumsum(common < nd[a])  # a break at i parts ranks i-1 and i
            new[a + 1:b] = ~same[a:b - 1] | (breaks[rr[a + 1:b]] != breaks[rr[a:b - 1]])
    cls = np.cumsum(new) - 1
    low = np.full(int(new.sum()), len(row), dtype=np.int64)
    np.minimum.at(low, cls, order)
    out = np.empty(len(row), dtype=np.int64)
    out[order] = low[cls]
    return out


def reach(buf: np.ndarray, at: np.ndarray, anchor: np.ndarray, cls: np.ndarray, k: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes left and right of its anchor each surrounding shares with some other one of its class."""
    def one(first, step, room):
        cols = first[:, None] + step * np.arange(most)
        rows = np.where(np.arange(most) < room[:, None], buf[np.clip(cols, 0, len(buf) - 1)], 0)
        pad = np.zeros((len(rows), -most % 8), dtype=np.uint8)
        words = np.ascontiguousarray(np.concatenate([rows, pad], 1)).view(">u8")
        order = np.lexsort([*words.T[::-1], cls])
        x = rows[order]
        diff = x[1:] != x[:-1]
        n = np.where(diff.any(1), diff.argmax(1), most)
        n[cls[order][1:] != cls[order][:-1]] = 0
        got = np.zeros(len(rows), dtype=np.int64)
        got[order[1:]] = n
        got[order[:-1]] = np.maximum(got[order[:-1]], n)
        return np.minimum(got, room)

    here = at[:-1] + anchor
    return one(here - 1, -1, anchor), one(here + k, 1, np.diff(at) - anchor - k)


def resolve(kind: R.Kind, t: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that start earlier too. ``t`` holds whole anchors, sorted by (anchor, id, start)."""
    buf, at = column_bytes(t.column("around"))
    n = t.column("n").to_numpy().astype(np.int64)
    h = t.column("h").to_numpy().view(np.uint64)
    with np.errstate(over="ignore"):
        own = span_hash(prefix(_BYTE[buf]), at[:-1], at[1:]) + h
    _, first, inv = np.unique(own, return_index=True, return_inverse=True)
    lead = first[inv]
    copy = lead != np.arange(len(n))  # an equal surrounding stands earlier: all its windows go
    cls = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
    several = np.bincount(cls, weights=~copy)[cls] > 1
    use = np.flatnonzero(~copy & several)
    out = [(np.flatnonzero(copy), np.zeros(int(copy.sum()), np.int64), n[copy])]
    if len(use):
        size = np.diff(at)[use]
        sub, bytes_ = np.concatenate([[0], np.cumsum(size)]), buf[ranges(at[use], size)]
        anchor = t.column("anchor").to_numpy().astype(np.int64)[use]
        # only what some other surrounding shares around the anchor can hold a repeated window
        left, right = reach(bytes_, sub, anchor, cls[use], kind.k, kind.window - kind.k)
        lo, size = anchor - left, left + kind.k + right
        ok = size >= kind.window
        use, begin, lo, size = use[ok], (sub[:-1] + lo)[ok], lo[ok], size[ok]
        if len(use):
            m = size - kind.window + 1
            row, off = np.repeat(np.arange(len(use)), m), ranges(np.zeros(len(use), np.int64), m)
            low = classes(bytes_[ranges(begin, size)], np.concatenate([[0], np.cumsum(size)]), row, off, kind.window)
            r, o, m = R.runs_of(low != np.arange(len(low)), row, off)
            out.append((use[r], o + lo[r], m))
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3))


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row."""
    kind = R.Kind(False, window, min(ANCHOR, window))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    part, texts, runs = R.repeated(rows.where("doc_id is not null"), kind, resolve, same_doc=True)

    def finish(b, buf, at, doc, start, n):
        gone = covered(len(buf), at[doc] + start, at[doc] + start + n - 1 + window)
        cut, spans, sha = [], [], []
        for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
            g = gone[i:j]
            cut.append(int(g.sum()))
            spans.append(int((g[1:] & ~g[:-1]).sum() + (len(g) > 0 and g[0])))
            sha.append(hashlib.sha256(buf[i:j][~g].tobytes()).hexdigest())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(cut, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)],
                                          ["doc_id", "th", "cut", "spans", "cut_sha256"])

    cut = R.removal(texts, runs, finish, "doc_id long, th long, cut long, spans long, cut_sha256 string")
    first = part.withColumnRenamed("doc_id", "first_id")
    base = rows.select("doc_id", "th", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("all_sha256"))
    out = base.join(first, "th", "left").join(cut, ["doc_id", "th"], "left")
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_bytes") >= window)
    return out.select("doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("cut", F.lit(0))).alias("n_removed"),
                      F.when(copy, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
                      F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha256", "all_sha256")).alias("kept_sha256"))


def op9_suffix_dedup(spark, sf_dir):
    return dedup(documents(spark, sf_dir))
