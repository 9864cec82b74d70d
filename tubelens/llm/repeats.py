"""Search for long strings that occur in several documents: winnowed anchors, then the surroundings of shared ones.

A unit is a word or a byte. Every window of ``window`` units picks one anchor, the least hash among its k-unit strings, so equal
windows pick equal anchors at equal offsets. Only anchors that occur more than once are followed up; the units
around them decide which windows are repeated:

* the surroundings of one anchor meet in one task (a rule per unit kind decides), when it has up to HOT places;
* the windows of a more common anchor are parted into nodes by where the anchor stands in them: near their start, so that they share more of the
  text on its right, or near their end. A node is keyed by all text that its windows must have in common, and of a surrounding it holds a
  clip, the text of those windows. Equal clips are found by aggregation (map-side first) and only the first goes on; a node
  with up to HOT distinct clips meets in one task under the same rule, a larger one is halved again.

A surrounding gives two rows a step at most, in as many steps as halving a window takes; a difference between two
copies lies in one clip outside its key a step. At the last step a clip is a single window, so nothing is left to meet.
HOT decides how far windows are parted, not which of them are found. An id names one document: of rows that share an id with
different texts the one with the least text hash takes part, and exact copies of a text take part once, as the smallest id.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tubelens.llm.common import stored
from tubelens.llm.kernels import Words, _BYTE, chunks, mix, pieces, prefix, ranges, rolling, span_hash, winnow

HOT = 1000
UNPACK_BYTES = 1 << 22  # texts packed or unpacked at a time, or one longer text
MEET_BYTES = 1 << 18  # surroundings compared at a time, or those of one longer anchor: the rule's arrays are some hundred times as large
U = np.uint64


@dataclass(frozen=True)
class Kind:
    """What a unit is, the window in units and the anchor string in units."""

    words: bool
    window: int
    k: int

    @property
    def w(self) -> int:
        return self.window - self.k + 1


def units(kind: Kind, buf: np.ndarray, at: np.ndarray):
    """``(symbols, document of each, first, end, words or None)``."""
    if kind.words:
        w = Words(buf, at)
        return w.hash, w.doc, w.lo, w.hi, w
    n = np.diff(at)
    return _BYTE[buf], np.repeat(np.arange(len(n)), n), at[:-1], at[1:], None


def anchored(kind: Kind, sym: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(window start, anchor place, anchor hash)`` of every window inside one document, in order."""
    h = rolling(sym, kind.k)
    n = len(sym) - kind.window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U),)
    pos = winnow(h, kind.w)[:n]
    start = np.flatnonzero(doc[:n] == doc[kind.window - 1:])
    pos = pos[start]
    return start, pos, h[pos]


def counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (document, hash), each once: ``(order that groups them, first of each group, size)``."""
    order = np.lexsort((h, doc))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1])
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(order)))


def anchors(docs: DataFrame, kind: Kind) -> DataFrame:
    """``h, doc_id, c``: each anchor hash of a document once, with the number of its places."""
    def run(batches):
        for b, buf, at in chunks(batches):
            sym, doc, _, _, _ = units(kind, buf, at)
            _, pos, h = anchored(kind, sym, doc)
            new = np.ones(len(pos), dtype=bool)
            new[1:] = pos[1:] != pos[:-1]
            d, h = doc[pos[new]], h[new]
            order, first, c = counted(d, h)
            i = order[first]
            yield pa.RecordBatch.from_arrays([pa.array(h[i].view(np.int64)), b.column("doc_id").take(pa.array(d[i])), pa.array(c.astype(np.int32))],
                                             ["h", "doc_id", "c"])

    return docs.mapInArrow(run, "h long, doc_id long, c int")


def packed(docs: DataFrame) -> DataFrame:
    """``doc_id, th, z``: text hash and the compressed text."""
    def run(batches):
        c = zstandard.ZstdCompressor(level=3)
        for b, buf, at in chunks(batches, limit=UNPACK_BYTES):
            z = [c.compress(buf[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(z, pa.binary())], ["doc_id", "th", "z"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, z binary")


def unpack(batches):
    """Batches with ``text`` bytes in place of ``z``, UNPACK_BYTES at a time."""
    d = zstandard.ZstdDecompressor()
    for b in batches:
        names = [n for n in b.schema.names if n != "z"]
        zs = b.column("z").to_pylist()
        at = np.concatenate([[0], np.cumsum([zstandard.frame_content_size(z) for z in zs], dtype=np.int64)])
        for i, j in pieces(at, UNPACK_BYTES):
            text = pa.array([d.decompress(z) for z in zs[i:j]], pa.large_binary())
            part = b.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [text], names + ["text"])


def participants(docs: DataFrame) -> DataFrame:
    """``doc_id, th``: one id per text and one text per id."""
    ids = docs.groupBy("doc_id").agg(F.min("th").alias("th"))
    return ids.groupBy("th").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "th")


def repeated(docs: DataFrame, kind: Kind, resolve: Callable, same_doc: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(participants, texts, runs)``.

    ``docs`` (doc_id, th, text). ``texts``: (doc_id, th, z) of participants with a repeated anchor. ``runs``: (doc_id,
    runs), each (start, n): n consecutive window starts whose string occurs first elsewhere: in a smaller id, or also earlier
    in the same document when ``same_doc``.
    """
    part = stored(participants(docs), "participants")
    rows = anchors(docs.select("doc_id", "text"), kind)
    shared = F.sum("c") if same_doc else F.count(F.lit(1))
    often = rows.groupBy("h").agg(shared.alias("n")).where("n > 1").select("h")
    rows = stored(rows.join(often, "h").join(part.select("doc_id"), "doc_id", "left_semi"), "anchors")
    counts = rows.groupBy("h").agg(shared.alias("n"), F.sum("c").alias("places")).where("n > 1").select("h", (F.col("places") > HOT).alias("hot"))
    mine = rows.select("h", "doc_id").join(counts, "h").groupBy("doc_id").agg(
        F.collect_list("h").alias("hs"), F.collect_list(F.when(F.col("hot"), F.col("h"))).alias("hot"))  # of one document
    mine = mine.join(part.withColumnRenamed("th", "_th"), "doc_id")  # all by id, so that texts are shuffled once
    texts = stored(mine.join(packed(docs), "doc_id").where("th = _th").drop("_th"), "texts")
    common = texts.where(F.size("hot") > 0)
    copies, follow = _parted(common, kind, same_doc)
    plain = texts.where(F.size("hot") == 0).withColumn("clips", F.array().cast("array<long>"))
    met = _met(plain.unionByName(common.join(follow, "doc_id", "left")), kind, resolve, same_doc)
    return part, texts.select("doc_id", "th", "z"), met.unionByName(copies)


def places(kind: Kind, b: pa.RecordBatch, sym: np.ndarray, doc: np.ndarray, name: str, but: str | None = None):
    """``(first window, number of windows, anchor place, anchor hash)`` of the places whose anchor is in list ``name``, not in ``but``."""
    start, pos, h = anchored(kind, sym, doc)
    ok = _member(b, name, doc[pos], h)
    if but:
        ok &= ~_member(b, but, doc[pos], h)
    start, pos, h = start[ok], pos[ok], h[ok]
    new = np.ones(len(pos), dtype=bool)
    new[1:] = pos[1:] != pos[:-1]
    i = np.flatnonzero(new)
    return start[i], np.diff(np.append(i, len(pos))), pos[i], h[i]  # the windows of one place are consecutive


def steps(kind: Kind) -> int:
    """Halvings after which a node holds single windows."""
    return (kind.w - 1).bit_length()


def node_of(kind: Kind, off: np.ndarray, step: int) -> np.ndarray:
    """Number of the node, of 2**step ones, for windows whose anchor stands ``off`` units after their start."""
    return (off << step) // kind.w


def parted(kind: Kind, lo: np.ndarray, n: np.ndarray, pos: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Clips (first window, number of windows, anchor place) of the nodes of a step that the windows fall into."""
    if not step or not len(lo):
        return lo, n, pos
    start, row = ranges(lo, n), np.repeat(np.arange(len(lo)), n)
    part = node_of(kind, pos[row] - start, step)
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
    i = np.flatnonzero(new)
    return start[i], np.diff(np.append(i, len(row))), pos[row[i]]


def keys(kind: Kind, sym: np.ndarray, lo: np.ndarray, n: np.ndarray, pos: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """``(clip hash, node hash)``. A node's hash covers the text that all its windows have, whatever their place around the anchor."""
    if not len(lo):
        return np.zeros(0, U), np.zeros(0, U)
    pre = prefix(sym)
    part = node_of(kind, pos - lo, step)
    least = -(-part * kind.w >> step)  # offsets of the anchor in the node's windows: the least and the one after the last
    after = -(-(part + 1) * kind.w >> step)
    with np.errstate(over="ignore"):
        tag = mix(part.astype(U) + U(step + 1) * U(0xD1342543DE82EF95))
        clip = mix(span_hash(pre, lo, lo + n - 1 + kind.window) + (pos - lo).astype(U) * U(0x9E3779B97F4A7C15) + n.astype(U) + tag)
        return clip, mix(span_hash(pre, pos - least, pos + kind.window - after + 1) + tag)


def once(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The first place of each key in its document, in order."""
    order, i, _ = counted(doc, key)
    return np.sort(order[i])


def _member(b: pa.RecordBatch, name: str, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each anchor hash is in its document's list."""
    col = b.column(name)
    off = col.offsets.to_numpy()
    vals = col.values.to_numpy(zero_copy_only=False).view(U)[off[0]:off[-1]]
    own = np.repeat(np.arange(len(off) - 1), np.diff(off)).astype(U)
    with np.errstate(over="ignore"):
        tag = lambda d, x: mix(x + d * U(0x9E3779B97F4A7C15))
        return np.isin(tag(doc.astype(U), h), tag(own, vals))


def _met(texts: DataFrame, kind: Kind, resolve: Callable, same_doc: bool) -> DataFrame:
    """Surroundings and clips to their anchor's or node's task; ``resolve`` returns runs of repeated windows."""
    def sets(b, sym, doc):
        lo, n, pos, h = places(kind, b, sym, doc, "hs", "hot")
        yield lo, n, pos, h
        lo, n, pos, _ = places(kind, b, sym, doc, "hot")
        for step in range(steps(kind)) if len(lo) else ():
            l, m, p = parted(kind, lo, n, pos, step)
            clip, node = keys(kind, sym, l, m, p, step)
            ok = np.flatnonzero(_member(b, "clips", doc[l], clip))
            if same_doc:  # the later places in a document went whole
                ok = ok[once(doc[l[ok]], clip[ok])]
            yield l[ok], m[ok], p[ok], node[ok]

    def cut(batches):
        for b, buf, at in chunks(unpack(batches)):
            sym, doc, first, _, w = units(kind, buf, at)
            lo, n, pos, h = (np.concatenate(x) for x in zip(*sets(b, sym, doc)))
            if not len(lo):
                continue
            hi = lo + n - 1 + kind.window
            if w is None:
                a, z = lo, hi
            else:
                a, z = w.start[lo], w.end[hi - 1]
            size = np.concatenate([[0], np.cumsum(z - a)])
            for i, j in pieces(size, UNPACK_BYTES):  # Arrow counts the bytes of a binary column in 31 bits
                off = (size[i:j + 1] - size[i]).astype(np.int32)
                data = buf[ranges(a[i:j], (z - a)[i:j])]
                around = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data.tobytes())])
                d = doc[lo[i:j]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[i:j].view(np.int64)), b.column("doc_id").take(pa.array(d)), pa.array((lo[i:j] - first[d]).astype(np.int64)),
                     pa.array((pos - lo)[i:j].astype(np.int32)), pa.array(n[i:j].astype(np.int32)), around], ["h", "doc_id", "start", "anchor", "n", "around"])

    rows = texts.select("doc_id", "z", "hs", "hot", F.coalesce("clips", F.array().cast("array<long>")).alias("clips")).mapInArrow(cut, "h long, doc_id long, start long, anchor int, n int, around binary")
    rows = rows.repartition("h").sortWithinPartitions("h", "doc_id", "start")

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks().to_batches()[0]
            h = t.column("h").to_numpy()
            last = int(np.searchsorted(h, h[-1]))  # Spark sorts longs as signed, like numpy here
            held = t.slice(last)
            if last:
                yield from _pieces(t.slice(0, last))
        if held is not None:
            yield from _pieces(held)

    def _pieces(t):
        h = t.column("h").to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.cumsum(np.array(t.column("around").value_lengths())) if hasattr(t.column("around"), "value_lengths") else None
        if size is None:
            off = np.frombuffer(t.column("around").buffers()[1], dtype=np.int32)[t.column("around").offset:][:len(h) + 1]
            size = (off[1:] - off[0]).astype(np.int64)
        bounds, begin = [0], 0
        for e in heads[1:].tolist():  # whole anchors
            if size[e - 1] - begin > MEET_BYTES:
                bounds.append(e)
                begin = size[e - 1]
        bounds.append(len(h))
        for i, j in zip(bounds[:-1], bounds[1:]):
            s = t.slice(i, j - i)
            row, off, n = resolve(kind, s)
            start = s.column("start").to_numpy()[row] + off
            yield pa.RecordBatch.from_arrays([s.column("doc_id").take(pa.array(row)), pa.array(start.astype(np.int64)), pa.array(n.astype(np.int64))],
                                             ["doc_id", "start", "n"])

    return rows.mapInArrow(run, "doc_id long, start long, n long").select("doc_id", F.array(F.struct("start", "n")).alias("runs"))


def _parted(hot: DataFrame, kind: Kind, same_doc: bool) -> tuple[DataFrame, DataFrame]:
    """``(runs, clips)`` of very common anchors: windows that go with their whole clip, and (doc_id, clips) of the clips that meet others.

    A step's clips are rows, each one of a document once with its places. What a clip's first document has too goes from all
    others, found by aggregation; only the first document's places go on: the first place when ``same_doc``, as its later ones
    go too, else all of them. So what many documents share whole is one row each.
    """
    def clips(step):
        def run(batches):
            for b, buf, at in chunks(unpack(batches)):
                sym, doc, first, _, _ = units(kind, buf, at)
                lo, n, pos, _ = places(kind, b, sym, doc, "hot")
                if step:
                    lo, n, pos = parted(kind, lo, n, pos, step - 1)
                    clip, _ = keys(kind, sym, lo, n, pos, step - 1)
                    ok = np.flatnonzero(_member(b, "firsts", doc[lo], clip))
                    if same_doc:
                        ok = ok[once(doc[lo[ok]], clip[ok])]
                    lo, n, pos = parted(kind, lo[ok], n[ok], pos[ok], step)
                if not len(lo):
                    continue
                clip, node = keys(kind, sym, lo, n, pos, step)
                d = doc[lo]
                order, i, _ = counted(d, clip)  # stable: places stay in order
                own = order[i]
                off = np.append(i, len(order)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(clip[own].view(np.int64)), pa.array(node[own].view(np.int64)), b.column("doc_id").take(pa.array(d[own])),
                     pa.ListArray.from_arrays(off, pa.array((lo - first[d])[order].astype(np.int64))), pa.array(n[own].astype(np.int64))],
                    ["key", "node", "doc_id", "starts", "n"])
        return run

    run = lambda starts: F.transform(starts, lambda s: F.struct(s.alias("start"), F.col("n").alias("n"))).alias("runs")
    copies, small, src = None, None, hot.select("doc_id", "z", "hot")
    for step in range(steps(kind) + 1):
        rows = stored(src.mapInArrow(clips(step), "key long, node long, doc_id long, starts array<long>, n long"), f"clips{step}")
        first = rows.groupBy("node", "key").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("d"))
        met = rows.join(first.where("c > 1").select("key", "d"), "key").where("doc_id > d").select("doc_id", run("starts"))
        if same_doc:
            met = met.unionByName(rows.where(F.size("starts") > 1).select("doc_id", run(F.slice("starts", 2, F.size("starts") - 1))))
        copies = met if copies is None else copies.unionByName(met)
        if step == steps(kind):  # clips are single windows
            break
        several = first.groupBy("node").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("node", (F.col("m") > HOT).alias("large"))
        follow = stored(first.join(several, "node").select(F.col("d").alias("doc_id"), "key", "large"), f"follow{step}")
        some = follow.where("not large").select("doc_id", "key")
        small = some if small is None else small.unionByName(some)
        large = follow.where("large")
        if large.isEmpty():
            break
        firsts = large.groupBy("doc_id").agg(F.collect_list("key").alias("firsts"))  # of one document
        src = hot.select("doc_id", "z", "hot").join(firsts, "doc_id")
    return copies, small.groupBy("doc_id").agg(F.collect_list("key").alias("clips"))  # of one document


def runs_of(flag: np.ndarray, row: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, offset, n)`` of the maximal flagged stretches of consecutive offsets of a row."""
    at = np.flatnonzero(flag)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    i = np.flatnonzero(new)
    n = np.diff(np.append(i, len(at)))
    return row[at[i]], off[at[i]], n


def removal(texts: DataFrame, runs: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """Per document with repeated windows, what ``finish(units kind args)`` derives from its covered units."""
    per = runs.groupBy("doc_id").agg(F.flatten(F.collect_list("runs")).alias("runs"))  # of one document
    joined = texts.join(per, "doc_id")

    def run(batches):
        for b, buf, at in chunks(unpack(batches)):
            col = b.column("runs")
            off = col.offsets.to_numpy()
            flat = col.values.slice(int(off[0]), int(off[-1] - off[0]))
            start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
            doc = np.repeat(np.arange(b.num_rows), np.diff(off))
            yield finish(b, buf, at, doc, start, n)

    return joined.mapInArrow(run, schema)
