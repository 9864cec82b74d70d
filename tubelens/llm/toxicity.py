"""Toxicity by class-conditional Kneser-Ney models of spelling.

Two letter models, one of toxic and one of ordinary labelled texts, predict each letter of a word from up to
CONTEXT letters before it. What a class has rarely seen backs off to shared counts: in how many different longer
contexts, of either class, a letter follows a context of BACKOFF letters. So unseen forms of a known expression are
still recognised. Counts are Spark rows, one for each true context of characters and
letter (64-bit hashes), and so are the log-likelihood ratios. Up to MODEL_ROWS of these rows, by count, are broadcast (48 MB);
beyond, texts get the values of their words by joins. Both ways give the same scores. A text is judged by
length-normalised ratios: per letter of the whole text, of its most toxic word and of its most toxic stretch; a
logistic curve fitted on training rows that gave no counts turns these into a score.

Training rows: labelled rows whose crc32(id as text) mod 4 is not 2. Of these, ids with remainder 1 in the least of
CLASSES hash classes fit the curve (at most FIT_ROWS ids, a documented bound, or one class); all others give the counts.

Defined cases: null and empty texts have no words and get the score of a text with zero ratios; rows with a null label teach
nothing; several labels of one id count as toxic if one is; without both classes the score is the toxic share;
repeated rows are scored alike; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tubelens.llm.common import documents, held_out, stored, table
from tubelens.llm.kernels import NOT_LETTER, Words, _BYTE, chunks, mix, prefix, ranges, span_hash

CONTEXT, BACKOFF = 5, 3
DISCOUNT = 0.75
UNSEEN = 0.5 / 32
STRETCH = 12
FIT_ROWS = 20_000
CLASSES = 1 << 16
THRESHOLD = 0.3
BROADCAST_ROWS = 4_000_000
MODEL_ROWS = 4_000_000
LETTERS = 1_000_000
FEATURES = ["mean", "word", "peak", "logn"]
U = np.uint64


def letters(w: Words, one: np.ndarray) -> dict[str, np.ndarray]:
    """Of every character of the words ``one``: its word's place in ``one`` and 64-bit hashes of its context, context and letter, backoff
    context, backoff context and letter."""
    size = w.end[one] - w.start[one]
    at = ranges(w.start[one], size)
    new = (w.buf[at] & 0xC0) != 0x80  # a character's first byte
    at, word = at[new], np.repeat(np.arange(len(one)), size)[new]
    count = np.bincount(word, minlength=len(one))
    begin, i = (np.cumsum(count) - count)[word], np.arange(len(at))
    end = np.append(at[1:], 0)
    last = i == begin + count[word] - 1
    end[last] = w.end[one][word[last]]
    pre = prefix(_BYTE[w.buf])
    letter = span_hash(pre, at, end)

    def context(k: int) -> np.ndarray:
        # a context that reaches the word's start differs from the same letters inside a word
        return mix(span_hash(pre, at[np.maximum(begin, i - k)], at) ^ (i - begin < k).astype(U))

    def cell(ctx: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(ctx * U(3) + letter)

    ctx, low = context(CONTEXT), context(BACKOFF)
    return {"word": word, "ctx": ctx, "cell": cell(ctx), "low": low, "low_cell": cell(low)}


def _small(df: DataFrame) -> DataFrame:
    """Broadcast up to a checked number of rows; beyond it the plain join stays."""
    n = df.limit(BROADCAST_ROWS + 1).count()
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, toxic, part, class`` of training rows; part is the remainder of the id's hash by 4, class one of CLASSES by another hash."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(~held_out("doc_id"))
    rows = docs.select("doc_id", "text").where("doc_id is not null")
    return rows.join(_small(marks), "doc_id").select(
        "doc_id", "text", "toxic", (F.crc32(F.col("doc_id").cast("string")) % 4).cast("int").alias("part"),
        F.pmod(F.xxhash64("doc_id"), F.lit(CLASSES)).cast("int").alias("class"))


def dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows that are counted, rows that fit the curve)``: the curve has the ids of remainder 1 in the least hash classes, about
    FIT_ROWS of them and one row each; all other rows are counted."""
    ids = rows.where("part = 1").select("doc_id", "class").distinct()
    many = sorted((r["class"], r["count"]) for r in ids.groupBy("class").count().collect())  # at most CLASSES rows
    total = np.cumsum([n for _, n in many])
    last = many[max(int(np.searchsorted(total, FIT_ROWS, side="right")) - 1, 0)][0] if many else -1
    curve = (F.col("part") == 1) & (F.col("class") <= last)
    fits = rows.where(curve).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return rows.where(~curve), fits


def count_cells(rows: DataFrame) -> DataFrame:
    """``cell, ctx, low, low_cell, n0, n1``: how often a letter follows a context in ordinary and toxic rows, with its backoff context."""
    keys = ["cell", "ctx", "low", "low_cell"]

    def run(batches):
        seen, held = [], 0

        def flush():
            col = {k: np.concatenate([s[k] for s in seen]) for k in [*keys, "n0", "n1"]}
            _, first, at = np.unique(col["cell"], return_index=True, return_inverse=True)
            n = [np.bincount(at, weights=col[k], minlength=len(first)).astype(np.int64) for k in ("n0", "n1")]
            return pa.RecordBatch.from_arrays([pa.array(col[k][first].view(np.int64)) for k in keys] + [pa.array(x) for x in n], [*keys, "n0", "n1"])

        for b, buf, at in chunks(batches):
            w = Words(buf, at, lower=True, gap=NOT_LETTER)
            toxic = np.asarray(b.column("toxic").to_numpy(zero_copy_only=False) > 0, dtype=np.int64)
            _, one, same = np.unique(w.hash, return_index=True, return_inverse=True)
            n1 = np.bincount(same, weights=toxic[w.doc], minlength=len(one))
            n0 = np.bincount(same, minlength=len(one)) - n1
            got = letters(w, one)
            word = got.pop("word")
            seen.append(got | {"n0": n0[word], "n1": n1[word]})
            held += len(word)
            if held > LETTERS:
                yield flush()
                seen, held = [], 0
        if held:
            yield flush()

    per_task = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(
        run, ", ".join(f"{k} long" for k in [*keys, "n0", "n1"]))
    return per_task.groupBy(*keys).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def log_ratios(cells: DataFrame) -> DataFrame:
    """``key, ratio``: log P(letter | context, toxic) - log P(letter | context, ordinary) of every cell and, for its other letters, of every context.

    A letter that follows a context in neither class has the same backoff share in both, so its ratio is the context's; that
    of an unseen context is 0.
    """
    follows = cells.groupBy("low", "low_cell").agg(F.count(F.lit(1)).alias("f"))  # distinct longer contexts, both classes
    of_low = follows.groupBy("low").agg(F.sum("f").alias("all"))
    kinds = lambda c: F.sum(F.when(F.col(c) > 0, 1).otherwise(0))
    ctxs = cells.groupBy("ctx").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), kinds("n0").alias("k0"), kinds("n1").alias("k1"))
    shared = follows.join(of_low, "low").select("low_cell", ((F.col("f") + UNSEEN) / (F.col("all") + 0.5)).alias("shared"))
    rest = lambda c: DISCOUNT * F.col(f"k{c}") / F.col(f"t{c}")
    part = lambda c: F.when(F.col(f"t{c}") > 0, rest(c)).otherwise(1.0)
    p = lambda c: F.when(F.col(f"t{c}") > 0, F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) / F.col(f"t{c}") + rest(c) * F.col("shared")).otherwise(
        F.col("shared"))
    known = cells.join(shared, "low_cell").join(ctxs, "ctx").select(F.col("cell").alias("key"), F.log(p(1) / p(0)).cast("float").alias("ratio"))
    return known.unionByName(ctxs.select(F.col("ctx").alias("key"), F.log(part(1) / part(0)).cast("float").alias("ratio")))


def packed(ratios: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """The ratios as arrays ordered by key, up to a checked number of rows; None beyond it."""
    if ratios.count() > MODEL_ROWS:
        return None
    got = ratios.toArrow()
    key, ratio = got.column("key").to_numpy().view(U), got.column("ratio").to_numpy()
    order = np.argsort(key)
    return key[order], ratio[order]


def looked_up(keys: np.ndarray, values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(value, found)`` of each x."""
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    found = keys[at] == x
    return np.where(found, values[at], 0.0), found


def word_values(w: Words, ratios: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sum of its letters' ratios, of every word."""
    _, one, same = np.unique(w.hash, return_index=True, return_inverse=True)
    got = letters(w, one)
    value, found = looked_up(*ratios, got["cell"])
    value[~found] = looked_up(*ratios, got["ctx"][~found])[0]
    return np.bincount(got["word"], weights=value, minlength=len(one))[same]


def valued(docs: DataFrame, ratios: DataFrame) -> DataFrame:
    """``docs`` with ``_known``, the (word, value) of each of a text's words: the form without a broadcast, by joins."""
    def words(batches):
        for b, buf, at in chunks(batches):
            w = Words(buf, at, lower=True, gap=NOT_LETTER)
            yield pa.RecordBatch.from_arrays([b.column("_th").take(pa.array(w.doc)), pa.array(w.hash.view(np.int64))], ["_th", "word"])

    def spelled(batches):
        for b, buf, at in chunks(batches):
            w = Words(buf, at, lower=True, gap=NOT_LETTER)
            hashes, one = np.unique(w.hash, return_index=True)
            got = letters(w, one)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (hashes[got["word"]], got["cell"], got["ctx"])] +
                                             [pa.array((np.arange(len(got["word"])) - np.searchsorted(got["word"], got["word"])).astype(np.int64))],
                                             ["word", "cell", "ctx", "place"])

    rows = docs.withColumn("_th", F.xxhash64(F.coalesce("text", F.lit(""))))
    spell = rows.select("text").mapInArrow(spelled, "word long, cell long, ctx long, place long").distinct()
    r = lambda key, name: ratios.select(F.col("key").alias(key), F.col("ratio").alias(name))
    value = spell.join(r("cell", "a"), "cell", "left").join(r("ctx", "b"), "ctx", "left").groupBy("word").agg(
        F.sum(F.coalesce("a", "b", F.lit(0.0))).alias("value"))
    pairs = rows.select("_th", "text").mapInArrow(words, "_th long, word long").distinct()
    per = pairs.join(value, "word").groupBy("_th").agg(F.collect_list(F.struct("word", "value")).alias("_known"))  # of one text
    return rows.join(per, "_th", "left").drop("_th")


def known_values(b: pa.RecordBatch, w: Words) -> np.ndarray:
    """``word_values`` from the column that ``valued`` adds."""
    flat = b.column("_known").flatten()
    if not len(flat):
        return np.zeros(len(w.hash))
    key, first = np.unique(flat.field("word").to_numpy().view(U), return_index=True)
    return looked_up(key, flat.field("value").to_numpy()[first], w.hash)[0]


def features(value: np.ndarray, w: Words) -> np.ndarray:
    """Per text: mean ratio of a letter, highest of a word, highest mean of STRETCH words, log of the length."""
    docs = len(w.at) - 1
    n = (w.hi - w.lo).astype(np.float64)
    cum = np.concatenate([[0.0], np.cumsum(value)])
    starts = np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80)])
    size = np.bincount(w.doc, weights=starts[w.end] - starts[w.start], minlength=docs)
    whole = cum[w.hi] - cum[w.lo]
    best = np.zeros(docs)
    np.maximum.at(best, w.doc, value)
    peak = whole / STRETCH
    if len(value) >= STRETCH:
        s = (cum[STRETCH:] - cum[:-STRETCH]) / STRETCH
        at = np.flatnonzero(w.doc[:len(s)] == w.doc[STRETCH - 1:])
        long = np.full(docs, -np.inf)
        np.maximum.at(long, w.doc[at], s[at])
        peak = np.where(np.isfinite(long), long, peak)
    return np.stack([whole / np.maximum(size, 1), best, peak, np.log1p(n)], 1)


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: (centre, scale, weights with intercept)."""
    mid, dev = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mid) / dev, np.ones(len(x))])
    b = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (p - y) + 1e-3 * b
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return mid, dev, b


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The model: ``ratio`` (arrays up to MODEL_ROWS rows), ``table`` (the same as a DataFrame) and the curve.

    Counts come from all training rows that don't fit the curve."""
    rows = labelled(docs, labels)
    counted, fits = dealt(rows)
    cells = stored(count_cells(counted), "cells")
    n0, n1 = cells.agg(F.sum("n0"), F.sum("n1")).first()
    if not n0 or not n1:
        share = rows.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.0
        return {"ratio": None, "table": None, "share": float(share)}
    ratios = stored(log_ratios(cells), "ratios")
    model = {"ratio": packed(ratios), "table": ratios}

    def run(b, w, value):
        f = features(value, w)
        y = np.asarray(b.column("toxic").to_numpy(zero_copy_only=False) > 0, dtype=np.float64)
        return pa.RecordBatch.from_arrays([pa.array(f[:, k]) for k in range(len(FEATURES))] + [pa.array(y)], [*FEATURES, "y"])

    kinds = ", ".join(f"{c} double" for c in [*FEATURES, "y"])
    got = judged(fits.select("text", F.col("toxic").cast("int").alias("toxic")), model, run, kinds).toArrow()
    y = got.column("y").to_numpy()
    if not len(y) or y.min() == y.max():
        curve = (np.zeros(4), np.ones(4), np.array([0.0, 1.0, 0.0, 0.0, -4.0]))
    else:
        curve = fit(np.stack([got.column(c).to_numpy() for c in FEATURES], 1), y)
    return model | {"curve": curve}


def judged(docs: DataFrame, model: dict, result, schema) -> DataFrame:
    """``result(batch, words, value of each word)`` over ``docs``: values from the broadcast ratios, or by joins beyond MODEL_ROWS."""
    joined = model["table"] is not None and model["ratio"] is None
    box = docs.sparkSession.sparkContext.broadcast(model["ratio"])

    def run(batches):
        for b, buf, at in chunks(batches):
            w = Words(buf, at, lower=True, gap=NOT_LETTER)
            if joined:
                value = known_values(b, w)
                b = b.select([c for c in b.schema.names if c != "_known"])
            else:
                value = np.zeros(len(w.hash)) if box.value is None else word_values(w, box.value)
            yield result(b, w, value)

    return (valued(docs, model["table"]) if joined else docs).mapInArrow(run, schema)


def probability(model: dict, w: Words, value: np.ndarray) -> np.ndarray:
    """Score of each text from the values of its words."""
    if "curve" not in model:
        return np.full(len(w.at) - 1, model["share"])
    mid, dev, b = model["curve"]
    return 1 / (1 + np.exp(-np.clip((features(value, w) - mid) / dev @ b[:-1] + b[-1], -30, 30)))


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` for every row."""
    small = {k: v for k, v in model.items() if k in ("curve", "share")}

    def run(b, w, value):
        p = probability(small, w, value)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                                          ["doc_id", "score", "predicted"])

    src = docs.select("doc_id", "text")
    return judged(src, model, run, f"doc_id {dict(src.dtypes)['doc_id']}, score double, predicted int")


def op10_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def keep_ordinary(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the texts that score at least the threshold."""
    model = train(docs, labels)
    small = {k: v for k, v in model.items() if k in ("curve", "share")}
    safe = docs.toDF(*["text" if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)])  # no name of a caller's can clash
    return judged(safe, model, lambda b, w, value: b.filter(pa.array(probability(small, w, value) < threshold)), safe.schema).toDF(*docs.columns)
