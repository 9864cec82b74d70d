"""Language-model scores: an interpolated modified Kneser-Ney model of word pairs, counted in Spark, kept as sorted hash
arrays in the shared folder and memory-mapped by the workers that score.

Training. A task turns its texts into (word before, word) pairs, sums them in blocks of ``FLUSH`` tokens and sends one blob
per shard and block. A pair's shard follows from the word before; a word before that is very common is dealt by the whole
pair, so no shard depends on one word. The task of a shard adds up the blobs, writes the shard's sorted keys with their counts
to the shared folder (to a name of its own, then renamed: a repeated task writes the same bytes again), and passes on what each
of its words adds to the statistics of words: counts, distinct words before, and for contexts the sum and the number
of pairs seen once, twice, and more. Spark sums these per word; a second set of files holds them, by ranges of the hash.

Scoring. A task maps the files (it does not read them into memory), sorts the pairs of a few megabytes of text and looks
them up in order. ``p(w|u) = (c(uw) - D) / c(u.) + g(u) p1(w)``, ``p1(w) = (n(.w) - d) / n(..) + g0 / (V + 1)`` with n(.w) the
number of distinct words before w; g hands on what the discounts take away, so everything sums to one over the words seen and
one unknown word. Discounts are the usual ones from counts of counts; where a corpus is too small for them, 0.5, 1 and 1.5.

The model has order 2. The shared folder must be a path that workers can map (a mounted file system); other stores are refused.
Words and pairs are known by 64-bit hashes.

Defined cases: null text is empty (one token, the end); a null id is never held out; rows that repeat an id are
scored and learned from one by one; without any training row every probability is 1 / (V + 1) = 1, so scores are 0; a text longer
than ``PIECE`` is worked on in parts, cut between words; other columns are ignored.
"""
from __future__ import annotations

import math
import os
import uuid
from dataclasses import dataclass
from typing import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tubelens.llm import kernels as K
from tubelens.llm.common import documents, stored
from tubelens.session import stage_path

U = np.uint64
PIECE = K.CHUNK_BYTES    # bytes of text taken apart at once
LOOKUP = 1 << 19         # tokens looked up at once
FLUSH = 1 << 21          # tokens summed in a task before they are sent
SHARD_TOKENS = 1 << 21   # about as many tokens for each shard
SAMPLE = 64              # one of so many texts is looked at to find very common words; this decides placement, not results
HOT_SHARE = 512          # a word with more than 1/512 of all tokens is very common: there are at most 512
START, END = K.mix(np.array([0x53544152, 0x454E4421], dtype=np.uint64))
_PAIR = U(0xA24BAED4963EE407)


def held_out(doc_id: Column | str) -> Column:
    """True where crc32 of the id as text leaves remainder 1 by 5."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 5 == 1, F.lit(False))


# ---------------------------------------------------------------- tokens
def _cuts(buf: np.ndarray, lo: int, hi: int, limit: int) -> list[int]:
    """Places between words that divide buf[lo:hi] into parts of about ``limit`` bytes (a longer word stays whole)."""
    out, at = [], lo
    while hi - at > limit:
        gaps, step = np.zeros(0, dtype=np.int64), at + limit
        while not len(gaps) and step < hi:  # the first gap at or after the limit
            gaps = np.flatnonzero(K._GAP[buf[step:min(step + limit, hi)]]) + step
            step += limit
        if not len(gaps):
            break
        at = int(gaps[0])
        out.append(at)
    return out


def tokens(batch, limit: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(row, word before, word)`` of every token of an Arrow batch, some megabytes at a time; the end is a token."""
    buf, at = K.column_bytes(batch.column("text"))
    for i, j in K.pieces(at, limit):
        cuts = _cuts(buf, at[i], at[j], limit) if j == i + 1 else []
        edges = [at[i], *cuts, at[j]] if cuts else None
        for p in range(len(edges) - 1 if edges else 1):
            span = np.array(edges[p:p + 2]) if edges else at[i:j + 1]
            last = not edges or p == len(edges) - 2
            w = K.Words(buf[span[0]:span[-1]], span - span[0], lower=True)
            n = w.hi - w.lo
            # one place more for the end of each text that ends here
            first = np.cumsum(n + last) - (n + last)
            word = np.full(int((n + last).sum()), END, dtype=np.uint64)
            word[K.ranges(first, n)] = w.hash
            before = np.empty(len(word), dtype=np.uint64)
            before[1:] = word[:-1]
            before[first[first < len(word)]] = START
            carry = carry if p else START
            if p and len(before):
                before[0] = carry
            if len(w.hash):
                carry = w.hash[-1]
            yield np.repeat(np.arange(i, j), n + last), before, word


class Pairs:
    """Key of a pair: its shard in the highest bits, then a hash of both words."""

    def __init__(self, bits: int, hot: np.ndarray):
        self.bits, self.hot = bits, np.sort(hot)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.hot & U(0xFFFF)).astype(np.int64)] = True

    def keys(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = K.mix(before * _PAIR + word)
        home = before.copy()
        if len(self.hot):
            at = np.flatnonzero(self.maybe[(before & U(0xFFFF)).astype(np.int64)])
            at = at[np.isin(before[at], self.hot)]
            home[at] = h[at]
        shift = U(64 - self.bits)
        return (home >> shift << shift) | (h >> U(self.bits))

    def edges(self, keys: np.ndarray) -> np.ndarray:
        """Where each shard begins in sorted keys, and the end."""
        firsts = np.arange(1 << self.bits, dtype=np.uint64) << U(64 - self.bits)
        return np.append(np.searchsorted(keys, firsts), len(keys))


def _sums(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(order, starts of runs)`` of equal keys."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    return order, np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, dtype=np.int64)


# ---------------------------------------------------------------- files
def local_folder(path: str) -> str:
    """The folder as workers open it."""
    at = urlparse(path)
    if at.scheme not in ("", "file"):
        raise ValueError(f"the model is memory-mapped: spark.checkpoint.dir must be a mounted path, not {at.scheme}://")
    return at.path


def write_arrays(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Arrays end to end in one file, which appears whole or not at all."""
    os.makedirs(folder, exist_ok=True)
    tmp = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
    with open(tmp, "wb") as f:
        for a in arrays:
            f.write(memoryview(np.ascontiguousarray(a)).cast("B") if len(a) else b"")
    os.replace(tmp, os.path.join(folder, name))


def map_arrays(folder: str, name: str, kinds: list[str]) -> list[np.ndarray]:
    """The arrays of a file, mapped; a shard that nothing fell into has no file."""
    path = os.path.join(folder, name)
    size = sum(np.dtype(k).itemsize for k in kinds)
    n = os.path.getsize(path) // size if os.path.exists(path) else 0
    if not n:
        return [np.zeros(0, dtype=k) for k in kinds]
    raw, out, at = np.memmap(path, dtype=np.uint8, mode="r"), [], 0
    for k in kinds:
        step = n * np.dtype(k).itemsize
        out.append(raw[at:at + step].view(k))
        at += step
    return out


PAIR_FILE = ["u8", "u4"]                      # key, count
WORD_FILE = ["u8", "i8", "i8", "f8", "f8"]    # hash, count, sum as a context, p1, share handed on


# ---------------------------------------------------------------- counting
def _common_words(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Estimated tokens, and words that are very common in the sample."""
    def count(batches):
        n, total = {}, 0
        for b in batches:
            for _, _, word in tokens(b):
                total += len(word)
                h, c = np.unique(word, return_counts=True)
                keep = c > len(word) // (2 * HOT_SHARE)
                for x, y in zip(h[keep].view(np.int64).tolist(), c[keep].tolist()):
                    n[x] = n.get(x, 0) + y
        yield pa.RecordBatch.from_pydict({"h": pa.array([None, *n], pa.int64()), "n": pa.array([total, *n.values()], pa.int64())})

    some = docs.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(SAMPLE)) == 0).select("text")
    found = some.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    total = (found.where("h is null").first() or [None, 0])[1]
    hot = found.where("h is not null").where(F.col("n") > max(total // HOT_SHARE, 1000)).select("h").orderBy(F.desc("n")).limit(HOT_SHARE)
    return total * SAMPLE, np.array([r["h"] for r in hot.collect()], dtype=np.int64).view(np.uint64)


def _blobs(pairs: Pairs, flush: int):
    def run(batches):
        held: list[tuple] = []

        def send():
            before, word = (np.concatenate(x) for x in zip(*held))
            held.clear()
            keys = pairs.keys(before, word)
            order, starts = _sums(keys)
            count = np.diff(np.append(starts, len(keys))).astype(np.uint32)
            pick = order[starts]
            before, word, keys = before[pick], word[pick], keys[pick]
            edge = pairs.edges(keys)
            shard, blob = [], []
            for s in np.flatnonzero(np.diff(edge)):
                part = slice(edge[s], edge[s + 1])
                o, heads = _sums(before[part])
                b, runs = before[part][o[heads]], np.diff(np.append(heads, len(o))).astype(np.uint32)
                shard.append(int(s))
                blob.append(b"".join([np.array([len(b), len(o)], dtype="u8").tobytes(), b.tobytes(), word[part][o].tobytes(),
                                      runs.tobytes(), count[part][o].tobytes()]))
            return pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int32()), "blob": pa.array(blob, pa.binary())})

        for b in batches:
            for _, before, word in tokens(b):
                held.append((before, word))
                if sum(len(x[0]) for x in held) >= flush:
                    yield send()
        if held:
            yield send()

    return run


def _unblob(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, n = np.frombuffer(raw, dtype="u8", count=2).tolist()
    at = 16
    b, at = np.frombuffer(raw, "u8", a, at), at + 8 * a
    w, at = np.frombuffer(raw, "u8", n, at), at + 8 * n
    r, at = np.frombuffer(raw, "u4", a, at), at + 4 * a
    return np.repeat(b, r), w, np.frombuffer(raw, "u4", n, at)


STATS = ["c", "n_before", "total", "n1", "n2", "n3"]
SEEN = ["q1", "q2", "q3", "q4"]


def _shard_writer(pairs: Pairs, folder: str):
    """One shard: its file, and what its pairs say of their words. A null word carries the counts of counts."""
    def run(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        before, word, count = (np.concatenate(x) for x in zip(*(_unblob(x.as_py()) for x in table.column("blob"))))
        keys = pairs.keys(before, word)
        order, starts = _sums(keys)
        count = np.add.reduceat(count[order].astype(np.int64), starts)
        pick = order[starts]
        keys, before, word = keys[pick], before[pick], word[pick]
        write_arrays(folder, f"pairs-{s}", [keys, count.astype(np.uint32)])
        words, at = np.unique(np.concatenate([before, word]), return_inverse=True)
        u, w, k = at[:len(before)], at[len(before):], len(words)
        add = lambda i, v: np.bincount(i, weights=v, minlength=k).astype(np.int64)
        cols = [add(w, count), np.bincount(w, minlength=k), add(u, count), add(u, count == 1), add(u, count == 2), add(u, count > 2)]
        none = np.zeros(k + 1, dtype=np.int64)
        out = {"h": pa.array(np.append(words, U(0)).view(np.int64), mask=np.arange(k + 1) == k)}
        out |= {n: pa.array(np.append(c, 0).astype(np.int64)) for n, c in zip(STATS, cols)}
        for i, n in enumerate(SEEN, 1):
            col = none.copy()
            col[k] = int((count == i).sum())
            out[n] = pa.array(col)
        return pa.table(out)

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken from counts of one, two, and more."""
    plain = (0.5, 1.0, 1.5)
    if not (n1 and n2 and n3 and n4):
        return plain
    y = n1 / (n1 + 2.0 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(x if 0 < x < k else p for x, k, p in zip(d, (1, 2, 3), plain))


def _taken(d: tuple, count: np.ndarray) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(count, 3)]


@dataclass
class Model:
    folder: str
    pairs: Pairs
    n_tokens: int        # N
    n_words: int         # V
    discount: tuple
    unknown: float       # p1 of a word never seen


def _word_writer(folder: str, d2: tuple, d1: tuple, n_pairs: int, unknown: float):
    def run(table: pa.Table) -> pa.Table:
        g = {c: table.column(c).to_numpy() for c in ["shard", "h", *STATS]}
        h = g["h"].view(np.uint64)
        o = np.argsort(h)
        g = {c: v[o] for c, v in g.items()}
        p1 = (g["n_before"] - _taken(d1, g["n_before"])) / max(n_pairs, 1) + unknown
        total = g["total"]
        on = np.where(total > 0, (d2[0] * g["n1"] + d2[1] * g["n2"] + d2[2] * g["n3"]) / np.maximum(total, 1), 1.0)
        write_arrays(folder, f"words-{int(g['shard'][0])}", [h[o], g["c"], total, p1, on])
        return pa.table({"n": pa.array([len(o)], pa.int64())})

    return run


def train(docs: DataFrame, flush: int = FLUSH, shard_tokens: int = SHARD_TOKENS) -> Model:
    """Learn from all rows of ``docs`` (``doc_id, text``). The model's files lie beside the checkpoints."""
    spark = docs.sparkSession
    n, hot = _common_words(docs)
    bits = max(3, math.ceil(math.log2(max(n, 1) / shard_tokens + 1)))
    folder, pairs, shards = local_folder(stage_path(spark, "lm")), Pairs(bits, hot), 1 << bits
    blobs = docs.select("text").mapInArrow(_blobs(pairs, flush), "shard int, blob binary")
    schema = ", ".join(f"{c} long" for c in ["h", *STATS, *SEEN])
    words = stored(blobs.repartition(shards, "shard").groupBy("shard").applyInArrow(_shard_writer(pairs, folder), schema)
                   .groupBy("h").agg(*[F.sum(c).alias(c) for c in [*STATS, *SEEN]]), "lm-words")
    known = words.where("h is not null and n_before > 0")
    t = known.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
                  F.coalesce(F.sum("n_before"), F.lit(0)).alias("types"), F.count_if(F.col("n_before") > 2).alias("more"),
                  *[F.count_if(F.col("n_before") == i).alias(f"m{i}") for i in range(1, 5)]).first()
    q = words.where("h is null").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in SEEN]).first()
    d2, d1 = discounts(*q), discounts(*[t[f"m{i}"] for i in range(1, 5)])
    over = (d1[0] * t["m1"] + d1[1] * t["m2"] + d1[2] * t["more"]) / t["types"] if t["types"] else 1.0
    unknown = over / (t["v"] + 1)
    by = words.where("h is not null").select(F.shiftrightunsigned("h", 64 - bits).cast("int").alias("shard"), "h", *STATS)
    by.repartition(shards, "shard").groupBy("shard").applyInArrow(_word_writer(folder, d2, d1, t["types"], unknown), "n long").agg(F.sum("n")).first()
    return Model(folder, pairs, t["n"], t["v"], d2, unknown)


# ---------------------------------------------------------------- scoring
class Mapped:
    """Lookups in the files of one kind, mapped when first needed."""

    def __init__(self, folder: str, name: str, kinds: list[str], bits: int):
        self.folder, self.name, self.kinds, self.shift, self.open = folder, name, kinds, U(64 - bits), {}

    def find(self, q: np.ndarray) -> list[np.ndarray]:
        """Values of sorted keys (0 where absent), and a mask of those present."""
        out = [np.zeros(len(q), dtype=k) for k in self.kinds[1:]]
        hit = np.zeros(len(q), dtype=bool)
        home = (q >> self.shift).astype(np.int64)
        starts = np.flatnonzero(np.append(True, home[1:] != home[:-1])) if len(q) else []
        for lo, hi in zip(starts, np.append(starts[1:], len(q)).astype(np.int64) if len(q) else []):
            s = int(home[lo])
            if s not in self.open:
                self.open[s] = map_arrays(self.folder, f"{self.name}-{s}", self.kinds)
            keys, *values = self.open[s]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, q[lo:hi]), len(keys) - 1)
                ok = keys[at] == q[lo:hi]
                hit[lo:hi] = ok
                for o, v in zip(out, values):
                    o[lo:hi][ok] = v[at[ok]]
        return [*out, hit]


def _logs(m: Model, before: np.ndarray, word: np.ndarray, pair_file: Mapped, word_file: Mapped):
    """Of every token: known, log10 of the base, log10 of the model."""
    names, at = np.unique(np.concatenate([word, before]), return_inverse=True)
    count, total, p1, on, hit = word_file.find(names)
    seen = count > 0
    p1 = np.where(seen, p1, m.unknown)
    on = np.where(total > 0, on, 1.0)
    base = np.log10((count + 0.5) / (m.n_tokens + 0.5 * (m.n_words + 1)))
    w, u = at[:len(word)], at[len(word):]
    keys = m.pairs.keys(before, word)
    order = np.argsort(keys)
    found, _ = pair_file.find(keys[order])
    c = np.zeros(len(keys), dtype=np.int64)
    c[order] = found
    p = np.where(c > 0, (c - _taken(m.discount, c)) / np.maximum(total[u], 1), 0.0) + on[u] * p1[w]
    return seen[w], base[w], np.log10(p)


def _gathered(parts, least: int):
    """Parts put together until they hold ``least`` tokens."""
    held, n = [], 0
    for x in parts:
        held.append(x)
        n += len(x[0])
        if n >= least:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(c) for c in zip(*held))


def score(docs: DataFrame, m: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of every row; scores are log10 probabilities of whole texts."""
    def run(batches):
        pair_file = Mapped(m.folder, "pairs", PAIR_FILE, m.pairs.bits)
        word_file = Mapped(m.folder, "words", WORD_FILE, m.pairs.bits)
        for b in batches:
            k = b.num_rows
            n, known, base, model = (np.zeros(k) for _ in range(4))
            for row, before, word in _gathered(tokens(b), LOOKUP):
                seen, lb, lm = _logs(m, before, word, pair_file, word_file)
                for total, v in ((n, None), (known, seen), (base, lb), (model, lm)):
                    s = np.bincount(row - row[0], weights=v)
                    total[row[0]:row[0] + len(s)] += s
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_tokens": pa.array(n.astype(np.int64)),
                                              "n_known": pa.array(known.astype(np.int64)), "base_score": pa.array(base), "score": pa.array(model)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out("doc_id")))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known",
                                     F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
