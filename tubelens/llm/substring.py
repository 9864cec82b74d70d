"""Substring dedup by seed and extend: winnowed word anchors are joined across documents and compared to both sides.

A word goes when a window of 50 words covers it that also starts in a document with a smaller id. For every window around a shared
anchor, the words to the left and to the right of the anchor are hashed: places that agree in so many words share a class, and a
window is repeated when a place of a smaller id has both its left and its right class. Overlapping repeats merge into maximal ones.

Defined cases: null text has no words; a document with fewer than 50 words keeps all; a null id keeps all and takes nothing
from others; rows that share an id: see ``repeats``, equal ones get equal results; an empty table gives an empty
result; other columns are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tubelens.llm import repeats as R
from tubelens.llm.common import documents
from tubelens.llm.kernels import Words, chunks, column_bytes, covered, mix, prefix, ranges, span_hash

WINDOW, ANCHOR = 50, 8
OUT = "doc_id long, th long, n_words long, n_removed long, kept_sha256 string"


def extended(kind: R.Kind, t: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that a smaller id has too. ``t`` holds whole anchors, sorted by (anchor, id, start)."""
    buf, at = column_bytes(t.column("around"))
    w = Words(buf, at)
    n, anchor = t.column("n").to_numpy().astype(np.int64), t.column("anchor").to_numpy().astype(np.int64)
    h, doc_id = t.column("h").to_numpy().view(np.uint64), t.column("doc_id").to_numpy()
    row, off = np.repeat(np.arange(len(n)), n), ranges(np.zeros(len(n), np.int64), n)
    pre = prefix(w.hash)
    begin, seed = w.lo[row] + off, w.lo[row] + anchor[row]
    left = span_hash(pre, begin, seed)  # what stands between the window's start and the seed
    right = span_hash(pre, seed, begin + kind.window)
    with np.errstate(over="ignore"):
        cls = mix(left + mix(right ^ h[row]) * np.uint64(3))
    order = np.lexsort((doc_id[row], cls))
    c, d = cls[order], doc_id[row][order]
    head = np.concatenate([[True], c[1:] != c[:-1]])
    lowest = d[np.maximum.accumulate(np.where(head, np.arange(len(c)), 0))]
    flag = np.zeros(len(c), dtype=bool)
    flag[order] = d > lowest
    return R.runs_of(flag, row, off)


def _sha(w: Words, d: int, gone: np.ndarray | None) -> str:
    """Digest of a text's kept words joined by one space."""
    lo, hi = w.lo[d], w.hi[d]
    at = np.arange(lo, hi) if gone is None else np.flatnonzero(~gone[lo:hi]) + lo
    if not len(at):
        return hashlib.sha256(b"").hexdigest()
    size = w.end[at] - w.start[at]
    out = np.full(int(size.sum()) + len(at) - 1, 32, dtype=np.uint8)
    to = np.cumsum(size + 1) - size - 1
    out[ranges(to, size)] = w.buf[ranges(w.start[at], size)]
    return hashlib.sha256(out.tobytes()).hexdigest()


def whole(docs: DataFrame) -> DataFrame:
    """``doc_id, th, n_words, all_sha256`` of every row."""
    def run(batches):
        for b, buf, at in chunks(batches):
            w = Words(buf, at)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), pa.array((w.hi - w.lo).astype(np.int64)),
                 pa.array([_sha(w, d, None) for d in range(b.num_rows)], pa.string())], ["doc_id", "th", "n_words", "all_sha256"])

    return docs.mapInArrow(run, "doc_id long, th long, n_words long, all_sha256 string")


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row."""
    kind = R.Kind(True, window, min(ANCHOR, window))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    part, texts, runs = R.repeated(rows.where("doc_id is not null"), kind, extended, same_doc=False)

    def finish(b, buf, at, doc, start, n):
        w = Words(buf, at)
        gone = covered(len(w.hash), w.lo[doc] + start, w.lo[doc] + start + n - 1 + window)
        cut = np.add.reduceat(np.append(gone, False), np.minimum(w.lo, len(gone))) * (w.hi > w.lo) if len(w.lo) else np.zeros(0)
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("th"), pa.array(cut.astype(np.int64)),
             pa.array([_sha(w, d, gone) for d in range(b.num_rows)], pa.string())], ["doc_id", "th", "cut", "cut_sha256"])

    cut = R.removal(texts, runs, finish, "doc_id long, th long, cut long, cut_sha256 string")
    first = part.withColumnRenamed("doc_id", "first_id")
    out = whole(rows).join(first, "th", "left").join(cut, ["doc_id", "th"], "left")
    # a later copy of a text has all its windows in the first one
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= window)
    return out.select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).alias("n_removed"),
                      F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha256", "all_sha256")).alias("kept_sha256"))


def op5_substring_dedup(spark, sf_dir):
    return dedup(documents(spark, sf_dir))


SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM words),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s FROM places),
firsts AS (SELECT s, min(doc_id) AS d FROM windows GROUP BY s),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE doc_id > d),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hits),
each AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM words),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
