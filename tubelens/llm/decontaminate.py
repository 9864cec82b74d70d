"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact weighted-shingle check.

A text's windows of an item's length are fingerprinted (256 bits over 5-word shingles) and looked up among the items of that
length. Fingerprints within RADIUS bits must agree in one of four 64-bit blocks up to RADIUS // 4 bits, so the block test
loses none of them. RADIUS lies five standard deviations above the mean distance at similarity 0.8. What is left is verified exactly: the
weighted Jaccard similarity of the shingles, weight being the number of occurrences, must reach 0.8.

Only windows that hold at least one shingle of an item of that length are fingerprinted: others have
similarity 0. Items go in blocks of ITEM_BLOCK (bounded broadcast), one pass over the texts for each.
Words are runs of letters, digits and bytes of longer characters; A-Z count as lower case.

A text with fewer words than the item is one window itself. Its similarity to every item that shares a shingle is summed from the
shingles' items, without fingerprints: so few shingles may leave more bits apart than RADIUS.

Defined cases: null and empty texts match nothing, nor do items without words; an item of fewer than five words must occur
whole; repeated rows match alike; repeated items each match; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tubelens.llm.common import documents, table
from tubelens.llm.kernels import NOT_LETTER, Words, chunks, mix, ranges

K = 5
BITS = 256
RADIUS = 67
PERCENT = 80
ITEM_BLOCK = 20_000
WINDOWS = 4096
GAP = NOT_LETTER.copy()
GAP[48:58] = False
U = np.uint64


def bits(h: np.ndarray) -> np.ndarray:
    """+1 / -1 for each of 256 bits of each shingle hash."""
    with np.errstate(over="ignore"):
        four = np.stack([mix(h + U(j + 1) * U(0x9E3779B97F4A7C15)) for j in range(BITS // 64)], 1)
    return np.unpackbits(four.view(np.uint8).reshape(len(h), BITS // 8), axis=1).astype(np.int8) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64).reshape(len(sums), BITS // 64)


def owners(count: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(shingle, item, occurrences)`` of all items, ordered by shingle."""
    v, c = (np.concatenate(x) for x in zip(*count))
    order = np.argsort(v, kind="stable")
    return v[order], np.repeat(np.arange(len(count)), [len(x) for x, _ in count])[order], c[order]


class Items:
    """Items by length: fingerprints, shingle counts, and which lengths own a shingle."""

    def __init__(self, ids: list, texts: list[str]):
        raw = [(t or "").encode() for t in texts]
        at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        w = Words(np.frombuffer(b"".join(raw), dtype=np.uint8), at, lower=True, gap=GAP)
        n = w.hi - w.lo
        self.by_length: dict[int, dict] = {}
        for length in sorted(set(n.tolist()) - {0}):
            own = np.flatnonzero(n == length)
            k = min(K, length)
            h, pos = w.grams(k)
            doc = w.doc[pos]
            rows = [h[doc == d] for d in own]
            self.by_length[length] = {
                "k": k, "ids": [ids[d] for d in own], "known": np.unique(np.concatenate(rows)),
                "print": fingerprints(np.stack([bits(r).sum(0, dtype=np.int32) for r in rows])),
                "count": [np.unique(r, return_counts=True) for r in rows]}
            self.by_length[length]["owners"] = owners(self.by_length[length]["count"])

    def unions(self) -> dict[int, np.ndarray]:
        """All items' shingles by shingle size."""
        if not hasattr(self, "_unions"):
            ks = {it["k"] for it in self.by_length.values()}
            self._unions = {k: np.unique(np.concatenate([it["known"] for it in self.by_length.values() if it["k"] == k])) for k in ks}
        return self._unions


def unpacked(by_length: dict) -> Items:
    out = Items.__new__(Items)
    out.by_length = by_length
    return out


def near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, distance)`` of fingerprints within RADIUS; one block within RADIUS // 4 first."""
    blocks = BITS // 64
    hit = np.zeros((len(a), len(b)), dtype=bool)
    for c in range(blocks):
        hit |= np.bitwise_count(a[:, c][:, None] ^ b[:, c][None, :]) <= RADIUS // blocks
    i, j = np.nonzero(hit)
    d = np.bitwise_count(a[i] ^ b[j]).sum(1)
    ok = d <= RADIUS
    return i[ok], j[ok], d[ok]


def similarity(x: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of a window's shingles with an item's."""
    v, c = np.unique(x, return_counts=True)
    _, i, j = np.intersect1d(v, known[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(c[i], known[1][j]).sum())
    return both / (len(x) + int(known[1].sum()) - both)


def similarities(x: np.ndarray, it: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(item, similarity)`` of a text's shingles with every item of n shingles that shares one."""
    v, c = np.unique(x, return_counts=True)
    known, item, count = it["owners"]
    lo, hi = np.searchsorted(known, v), np.searchsorted(known, v, side="right")
    at = ranges(lo, hi - lo)
    both = np.bincount(item[at], weights=np.minimum(np.repeat(c, hi - lo), count[at]), minlength=len(it["ids"]))
    j = np.flatnonzero(both)
    return j, both[j] / (len(x) + n - both[j])


def matches(items: Items, w: Words) -> list[tuple]:
    """``(text, item id, first word, similarity)``: the best window of each text and item."""
    best: dict[tuple[int, object, int], tuple[float, int]] = {}
    grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    unions = items.unions()
    total, size = len(w.hash), w.hi - w.lo
    for length, it in items.by_length.items():
        k = it["k"]
        if k not in grams:
            h, pos = w.grams(k)
            full = np.zeros(total, dtype=U)
            full[pos] = h
            at = np.minimum(np.searchsorted(unions[k], h), len(unions[k]) - 1)
            grams[k] = (full, pos[unions[k][at] == h])  # places of any item's shingles
        full, pos = grams[k]
        if not len(pos):
            continue
        at = np.minimum(np.searchsorted(it["known"], full[pos]), len(it["known"]) - 1)
        p = pos[it["known"][at] == full[pos]]
        if not len(p):
            continue
        lo = np.maximum(p + k - length, w.lo[w.doc[p]])
        hi = np.minimum(p, w.hi[w.doc[p]] - length)
        ok = hi >= lo
        starts = np.unique(ranges(lo[ok], hi[ok] - lo[ok] + 1))
        n = length - k + 1
        d = w.doc[p]
        short = (size[d] < length) & (100 * (size[d] - k + 1) >= PERCENT * n)  # of fewer shingles none can reach it
        for d in np.unique(d[short]).tolist():
            for j, sim in zip(*similarities(full[w.lo[d]:w.hi[d] - k + 1], it, n)):
                key = (d, it["ids"][j], length)
                if 100 * sim >= PERCENT - 1e-9 and (key not in best or sim > best[key][0]):
                    best[key] = (float(sim), int(w.lo[d]))
        for i in range(0, len(starts), WINDOWS):
            s = starts[i:i + WINDOWS]
            need = np.zeros(total + 1, dtype=bool)
            need[ranges(s, np.full(len(s), n))] = True
            where = np.flatnonzero(need)
            index = np.cumsum(need) - need
            cum = np.zeros((len(where) + 1, BITS), dtype=np.int32)
            np.cumsum(bits(full[where]), axis=0, dtype=np.int32, out=cum[1:])
            sums = cum[index[s] + n] - cum[index[s]]
            a, b, _ = near(fingerprints(sums), it["print"])
            for x, j in zip(s[a].tolist(), b.tolist()):
                sim = similarity(full[x:x + n], it["count"][j])
                if 100 * sim >= PERCENT - 1e-9:
                    d = int(w.doc[x])
                    key = (d, it["ids"][j], length)
                    if key not in best or (sim, -x) > (best[key][0], -best[key][1]):
                        best[key] = (sim, x)
    return [(d, item, x - int(w.lo[d]), sim) for (d, item, _), (sim, x) in sorted(best.items(), key=lambda e: (e[0][0], str(e[0][1])))]


def item_blocks(benchmark: DataFrame, block: int = ITEM_BLOCK):
    """The items, at most about ``block`` at a time."""
    n = benchmark.count()
    parts = max(1, -(-n // block))
    for b in range(parts):
        rows = benchmark.select("item_id", "text").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == b).collect()
        yield Items([r["item_id"] for r in rows], [r["text"] for r in rows])


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, start, similarity``: one row per text and item it holds; start counts words."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = f"doc_id {dict(src.dtypes)['doc_id']}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, start long, similarity double"
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = None
    for items in item_blocks(benchmark):
        box = docs.sparkSession.sparkContext.broadcast(items.by_length)

        def run(batches, box=box):
            it = unpacked(box.value)
            for b, buf, at in chunks(batches):
                m = matches(it, Words(buf, at, lower=True, gap=GAP))
                d, i, s, f = (list(x) for x in zip(*m)) if m else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d, pa.int64())), pa.array(i, item_type), pa.array(s, pa.int64()), pa.array(f, pa.float64())],
                                                 ["doc_id", "item_id", "start", "similarity"])

        got = src.mapInArrow(run, kinds)
        out = got if out is None else out.unionByName(got)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all columns, without texts that hold an item."""
    for items in item_blocks(benchmark):
        box = docs.sparkSession.sparkContext.broadcast(items.by_length)

        def run(batches, box=box):
            it = unpacked(box.value)
            for b, buf, at in chunks(batches):
                keep = np.ones(b.num_rows, dtype=bool)
                keep[[m[0] for m in matches(it, Words(buf, at, lower=True, gap=GAP))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontaminate(spark, sf_dir):
    return leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
