"""Language identification: Viterbi over per-word scores, candidates narrowed by script.

Each letter of a word adds the log share of its three-byte surrounding in a language; counts come from every
training row, gathered by Spark into a table of fixed size (2^17 hash classes per language). A word can only get a language that
was seen with its script. Viterbi with a switching penalty labels the words of a text; all texts of a block
advance together. A text's language is the one with most labelled bytes, its score their share.

Defined cases: null texts and texts without a letter are ``und`` with score 0; rows with null or held-out lang teach nothing;
ties go to the language first in order; without training rows every text is ``und``; repeated rows get
equal results; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tubelens.llm.common import documents, held_out, train_row
from tubelens.llm.kernels import NOT_LETTER, Words, chunks, _LOWER

BITS = 17
SWITCH = 6.0
SMOOTH = 0.5
ROWS = 4096
SCRIPTS = ["latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "thai", "kana", "han", "hangul", "other"]
_LETTER = regex.compile(r"\p{L}")


def script_of(buf: np.ndarray) -> np.ndarray:
    """Script number by lead byte of each character; -1 for bytes that carry none (continuations)."""
    table = np.full(256, -1, dtype=np.int8)
    table[65:91] = table[97:123] = 0
    for lo, hi, name in ((0xC3, 0xCA, "latin"), (0xCE, 0xD0, "greek"), (0xD0, 0xD4, "cyrillic"), (0xD6, 0xD8, "hebrew"),
                         (0xD8, 0xDC, "arabic"), (0xE4, 0xEA, "han"), (0xEA, 0xEE, "hangul"), (0xF0, 0xF5, "other")):
        table[lo:hi] = SCRIPTS.index(name)
    out = table[buf]
    at = np.flatnonzero((buf >= 0xE0) & (buf <= 0xE3))  # three-byte characters below the Han block: by the second byte
    if len(at):
        second = buf[np.minimum(at + 1, len(buf) - 1)]
        lead = buf[at]
        kind = np.full(len(at), SCRIPTS.index("other"), dtype=np.int8)
        kind[(lead == 0xE0) & (second >= 0xA4) & (second < 0xB8)] = SCRIPTS.index("indic")
        kind[(lead == 0xE0) & (second == 0xB8) | (lead == 0xE0) & (second == 0xB9)] = SCRIPTS.index("thai")
        kind[(lead == 0xE1) & (second >= 0xB8) & (second < 0xBC)] = SCRIPTS.index("latin")
        kind[(lead == 0xE3) & (second >= 0x81) & (second <= 0x83)] = SCRIPTS.index("kana")
        out[at] = kind
    return out


def surroundings(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(positions of letter bytes, hash class of the bytes before, at and after)``."""
    clean = np.where(NOT_LETTER[buf], 32, _LOWER[buf]).astype(np.uint32)
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[at] = True
    before = np.concatenate([[32], clean[:-1]]).astype(np.uint32)
    after = np.concatenate([clean[1:], [32]]).astype(np.uint32)
    before[edge[:-1]], after[edge[1:]] = 32, 32
    pos = np.flatnonzero(clean != 32)
    key = (before[pos] << np.uint32(16)) | (clean[pos] << np.uint32(8)) | after[pos]
    return pos, ((key * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def train(docs: DataFrame) -> dict | None:
    """Log shares per hash class and language, and which scripts a language uses."""
    rows = docs.where(F.col("lang").isNotNull() & train_row("doc_id")).select("text", F.col("lang").cast("string").alias("lang"))
    top = 1 << BITS

    def run(batches):
        seen: dict[str, np.ndarray] = {}
        for b, buf, at in chunks(batches):
            pos, key = surroundings(buf, at)
            row = np.searchsorted(at, pos, side="right") - 1
            script = script_of(buf)
            lead = np.flatnonzero(script >= 0)
            lead_row = np.searchsorted(at, lead, side="right") - 1
            langs = np.array(b.column("lang").to_pylist(), dtype=object)
            for lang in set(langs):
                of = langs == lang
                n = seen.setdefault(lang, np.zeros(top + len(SCRIPTS), dtype=np.int64))
                n[:top] += np.bincount(key[of[row]], minlength=top)
                n[top:] += np.bincount(script[lead[of[lead_row]]], minlength=len(SCRIPTS))
        for lang, n in seen.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(n[k])], ["lang", "k", "n"])

    got = rows.mapInArrow(run, "lang string, k int, n long").groupBy("lang", "k").agg(F.sum("n").alias("n"))
    got = got.toArrow()  # at most 2^17 + 11 rows per language
    if not got.num_rows:
        return None
    names = np.array(got.column("lang").to_pylist(), dtype=object)
    langs = sorted(set(names))
    n = np.zeros((len(langs), top + len(SCRIPTS)))
    n[np.searchsorted(np.array(langs, dtype=object), names), got.column("k").to_numpy()] = got.column("n").to_numpy()
    share = n[:, :top] + SMOOTH
    used = n[:, top:] / np.maximum(n[:, top:].sum(1, keepdims=True), 1)
    return {"langs": langs, "log": np.log(share / share.sum(1, keepdims=True)).astype(np.float32).T.copy(), "script": used > 0.001}


def word_scores(model: dict, buf: np.ndarray, at: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words (letter runs), their scores per language and their bytes."""
    w = Words(buf, at, gap=NOT_LETTER)
    langs = len(model["langs"])
    if not len(w.hash):
        return w, np.zeros((0, langs), np.float32), np.zeros(0, np.int64)
    pos, key = surroundings(buf, at)
    cum = np.zeros((len(pos) + 1, langs), dtype=np.float64)
    np.cumsum(model["log"][key], axis=0, out=cum[1:])
    a, b = np.searchsorted(pos, w.start), np.searchsorted(pos, w.end)
    s = (cum[b] - cum[a]).astype(np.float32)
    script = script_of(buf)
    first = script[w.start]  # a word's script is that of its first letter
    ok = model["script"].T[np.maximum(first, 0)]
    ok |= (first < 0)[:, None] | ~ok.any(1)[:, None]
    s[~ok] -= 1e4
    return w, s, w.end - w.start


def viterbi(scores: np.ndarray, lo: np.ndarray, hi: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; texts advance together, longest first."""
    n = hi - lo
    order = np.argsort(-n, kind="stable")
    lo, n = lo[order], n[order]
    total, langs = scores.shape
    kind = np.min_scalar_type(max(langs - 1, 0))
    came = np.zeros((total, langs), dtype=kind)
    out = np.zeros(total, dtype=kind)
    if not total:
        return out
    active = int(np.searchsorted(-n, 0, side="left"))
    cur = scores[lo[:active]].copy()
    own = np.arange(langs, dtype=kind)
    steps = int(n[0])
    ends = np.searchsorted(-n, -np.arange(steps), side="left")  # texts longer than t words
    final = np.zeros(len(n), dtype=kind)
    came[lo[:active]] = own
    best_end = np.zeros((len(n), langs), dtype=np.float32)
    best_end[:active] = cur
    for t in range(1, steps):
        k = int(ends[t])
        cur = cur[:k]
        top = cur.argmax(1)
        jump = cur[np.arange(k), top] - penalty
        stay = cur >= jump[:, None]
        at = lo[:k] + t
        came[at] = np.where(stay, own, top[:, None].astype(kind))
        cur = np.where(stay, cur, jump[:, None]) + scores[at]
        best_end[:k] = cur
    final[:active] = best_end[:active].argmax(1)
    state = final.copy()
    for t in range(steps - 1, -1, -1):
        k = int(ends[t])
        at = lo[:k] + t
        out[at] = state[:k]
        state[:k] = came[at, state[:k]]
    return out


def _blocks(batches):
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row."""
    box = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = box.value
        for b, buf, at in chunks(_blocks(batches), limit=4 << 20):
            rows = b.num_rows
            if m is None:
                pred, share = np.array(["und"] * rows, dtype=object), np.zeros(rows)
            else:
                w, s, size = word_scores(m, buf, at)
                label = viterbi(s, w.lo, w.hi, SWITCH)
                langs = len(m["langs"])
                won = np.bincount(w.doc * langs + label, weights=size, minlength=rows * langs).reshape(rows, langs)
                pred = np.array(m["langs"], dtype=object)[won.argmax(1)]
                share = won.max(1) / np.maximum(won.sum(1), 1)
                plain = np.add.reduceat(np.append(~NOT_LETTER[buf] & (buf < 128), False), np.minimum(at[:-1], len(buf))) if len(buf) else np.zeros(rows)
                for d in np.flatnonzero((plain == 0) | (at[1:] == at[:-1])):  # no ASCII letter: look at the characters
                    if not _LETTER.search(bytes(buf[at[d]:at[d + 1]]).decode("utf-8", "replace")):
                        pred[d], share[d] = "und", 0.0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(share.astype(np.float64))],
                                             ["doc_id", "lang_pred", "score"])

    src = docs.select("doc_id", "text")
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, lang_pred string, score double")


def spans(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, start, end, lang``: maximal runs of equally labelled words, as byte positions."""
    box = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = box.value
        for b, buf, at in chunks(_blocks(batches), limit=4 << 20):
            w, s, _ = word_scores(m, buf, at)
            label = viterbi(s, w.lo, w.hi, SWITCH)
            if not len(label):
                continue
            new = np.concatenate([[True], (label[1:] != label[:-1]) | (w.doc[1:] != w.doc[:-1])])
            i = np.flatnonzero(new)
            j = np.append(i[1:], len(label)) - 1
            d = w.doc[i]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(d)), pa.array(w.start[i] - at[d]), pa.array(w.end[j] - at[d]),
                 pa.array(np.array(m["langs"], dtype=object)[label[i]], pa.string())], ["doc_id", "start", "end", "lang"])

    src = docs.select("doc_id", "text")
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, start long, end long, lang string")


def op7_langid(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = predict(docs, train(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
