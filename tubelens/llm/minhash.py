"""Near-dedup by fast similarity sketches, banding and exact verification.

Sketch: in round i every set element is hashed to one of T bins with a value that grows with i; the least value
of a bin stays. After T such rounds, round T + j puts every element into bin j, so each coordinate fills; mostly
a few rounds suffice. The share of equal coordinates concentrates around the Jaccard similarity.
ROWS coordinates make a band: two sets of similarity 0.8 share none of the BANDS bands with probability 1e-7.

Texts with equal sets form one class, and only classes go on. Links are needed up to connectivity:

1. every class is compared with the class it shares most bands with among the first ones of its bands;
2. after components are known, bands that still hold several components are searched for links across them, in blocks
   of bounded size (members outside the band's main component x all members). Two sets whose parity bits (the parity of the number
   of elements per hash class) differ in more than (n1 + n2) / 9 places differ in more elements still, so they can't reach 0.8. Members
   without a partner under this exact bound leave; the texts of the others come to their blocks, which compare full sets, a pair in the first
   band it shares, skip what the block has already connected and return a spanning forest: fewer links than members, never pairs.

Links inside a component change nothing, so nothing is lost and a group of copies never emits its pairs.

Defined cases: null and empty texts have no shingle and link to nothing; with fewer words than a shingle has, the whole
sequence is the only one; a null id is never linked and its component is null; rows that share an id
count as one document when their sets are equal, and link to nothing else by it otherwise; an empty table
gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tubelens.llm.common import documents, id_bit, id_filter, in_filter, stored
from tubelens.llm.kernels import Words, chunks, mix, pieces, ranges
from tubelens.operators.graph import star_components

BANDS, ROWS = 40, 5
T = BANDS * ROWS
BLOCK = 512
ELEMENTS = 1 << 20  # of one side of a block
U = np.uint64
_SIG = "n long, d1 long, d2 long, keys array<long>, parity binary"


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(elements, first, count)``: the distinct shingle hashes of each text, ascending."""
    docs = len(w.at) - 1
    h, at = w.grams(k)
    n = w.hi - w.lo
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):  # the whole sequence as one shingle
        with np.errstate(over="ignore"):
            one = [mix(np.bitwise_xor.reduce(mix(w.hash[w.lo[d]:w.hi[d]] * U(31) + np.arange(1, n[d] + 1).astype(U))) + U(n[d])) for d in short]
        h = np.concatenate([h, np.array(one, dtype=U)])
        doc = np.concatenate([w.doc[at], short])
    else:
        doc = w.doc[at]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    count = np.bincount(doc, minlength=docs)
    return h, np.cumsum(count) - count, count


def sketches(h: np.ndarray, first: np.ndarray, count: np.ndarray, t: int = T) -> np.ndarray:
    """``[texts, t]`` sketch; rows of texts without elements stay at the maximum."""
    docs = len(count)
    full = np.iinfo(np.uint64).max
    out = np.full((docs, t), full, dtype=U)
    flat = out.reshape(-1)
    active = np.flatnonzero(count)
    low = U((1 << 54) - 1)
    for i in range(2 * t):
        if not len(active):
            break
        el = ranges(first[active], count[active])
        row = np.repeat(active, count[active])
        with np.errstate(over="ignore"):
            v = mix(h[el] + U(i + 1) * U(0x9E3779B97F4A7C15))
        b = (v >> U(32)) % U(t) if i < t else np.full(len(v), i - t, dtype=U)
        np.minimum.at(flat, row * t + b.astype(np.int64), (v & low) | (U(i) << U(54)))
        active = active[(out[active] == full).any(1)]
    return out


def band_keys(sk: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = sk.reshape(len(sk), BANDS, ROWS)
        k = np.zeros(x.shape[:2], dtype=U)
        for j in range(ROWS):
            k = mix(k * U(0xD1342543DE82EF95) + x[:, :, j] + U(j))
        return mix(k + np.arange(BANDS, dtype=U) * U(0x9E3779B97F4A7C15))


def parities(h: np.ndarray, first: np.ndarray, count: np.ndarray) -> list[bytes]:
    """Parity bits of each set: 2 to 4 bits an element, a power of two in all."""
    size = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * count, 1))).astype(np.int64))
    base = np.cumsum(size) - size
    row = np.repeat(np.arange(len(count)), count)
    n = np.bincount(base[row] + (h & (size[row] - 1).astype(U)).astype(np.int64), minlength=int(size.sum()))
    raw = np.packbits((n & 1).astype(np.uint8)).tobytes()
    return [raw[a // 8:(a + m) // 8] for a, m in zip(base.tolist(), size.tolist())]


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n, d1, d2, keys, parity`` of every row: set size, digest of the set, band keys, parity bits."""
    def run(batches):
        for b, buf, at in chunks(batches):
            h, first, count = shingle_sets(Words(buf, at, lower=True), k)
            keys = band_keys(sketches(h, first, count)).view(np.int64)
            has = np.flatnonzero(count)
            d = np.zeros((2, len(count)), dtype=np.int64)
            if len(has):
                d[0, has] = np.add.reduceat(mix(h), first[has]).view(np.int64)
                d[1, has] = np.bitwise_xor.reduceat(mix(h ^ U(0xA0761D6478BD642F)), first[has]).view(np.int64)
            off = np.arange(len(count) + 1, dtype=np.int32) * BANDS
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(d[0]), pa.array(d[1]),
                 pa.ListArray.from_arrays(off, pa.array(keys.reshape(-1))),
                 pa.array(parities(h, first, count), pa.binary())], ["doc_id", "n", "d1", "d2", "keys", "parity"])

    src = docs.select("doc_id", "text")
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, {_SIG}")


def _packed(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, z``: the compressed texts of at least the wanted nodes."""
    box = docs.sparkSession.sparkContext.broadcast(id_filter(nodes, "node"))

    def run(batches):
        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            b = b.filter(pa.array(in_filter(box.value, b.column("bit").to_numpy())))
            z = [c.compress((t or "").encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(z, pa.binary())], ["node", "z"])

    return docs.select("doc_id", "text", id_bit("doc_id").alias("bit")).mapInArrow(run, "node long, z binary")


def packed_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, z`` of the documents in ``nodes`` (node, each once)."""
    rows = _packed(docs.where("doc_id is not null and text is not null"), nodes)
    return stored(rows.join(nodes, "node").dropDuplicates(["node"]), "texts")


def unpacked_sets(d: zstandard.ZstdDecompressor, zs: list[bytes], k: int):
    """``(from, to, elements, first, count)`` for stretches of texts; sizes are read first, so one stretch is unpacked at a time."""
    at = np.concatenate([[0], np.cumsum([zstandard.frame_content_size(z) for z in zs])]).astype(np.int64)
    for i, j in pieces(at):
        buf = np.frombuffer(b"".join([d.decompress(z) for z in zs[i:j]]), dtype=np.uint8)
        yield i, j, *shingle_sets(Words(buf, at[i:j + 1] - at[i], lower=True), k)


def verified(texts: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of ``u, v`` whose full sets reach the similarity.

    The texts of v go to u's task; a u with many partners is split over tasks, BLOCK partners each.
    """
    sent = pairs.select("u", "v", F.pmod(F.xxhash64("v"), F.lit(1 << 20)).alias("_s"))
    blocks = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_m"))
    sent = sent.join(blocks, "u").withColumn("_s", F.pmod("_s", "_m"))
    right = sent.join(texts, F.col("v") == F.col("node")).select("u", "_s", "v", "z")
    left = blocks.join(texts, F.col("u") == F.col("node")).select(
        "u", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_s"), F.lit(None).cast("long").alias("v"), "z")
    rows = left.unionByName(right.withColumn("_s", F.col("_s").cast("int")))
    rows = rows.repartition("u", "_s").sortWithinPartitions("u", "_s", F.col("v").asc_nulls_first())

    def run(batches):
        d = zstandard.ZstdDecompressor()
        own = key = None
        for b in batches:
            us, ss, vs, zs = (b.column(c).to_pylist() for c in ("u", "_s", "v", "z"))
            hu, hv = [], []
            for i, j, h, first, count in unpacked_sets(d, zs, k):
                for r in range(i, j):
                    x = h[first[r - i]:first[r - i] + count[r - i]]
                    if vs[r] is None:
                        own, key = x.copy(), (us[r], ss[r])
                    elif key == (us[r], ss[r]):
                        both = len(np.intersect1d(own, x, assume_unique=True))
                        if both and 100 * both >= percent * (len(own) + len(x) - both):
                            hu.append(us[r])
                            hv.append(vs[r])
            yield pa.RecordBatch.from_arrays([pa.array(hu, pa.int64()), pa.array(hv, pa.int64())], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def _fold(x: np.ndarray, bits: int) -> np.ndarray:
    while x.shape[1] > bits:
        x = x[:, :x.shape[1] // 2] ^ x[:, x.shape[1] // 2:]
    return x


def possible(g: dict, split: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(left, right, d)`` of a block's pairs across components that size and parity bits don't rule out.

    Members before ``split`` are the left ones. Of two members that are both outside the main component the smaller node is left.
    """
    node, comp, n, free, par = (g[c] for c in ("node", "comp", "n", "free", "parity"))
    size = np.array([len(p) for p in par])
    out = [np.zeros((3, 0), np.int64)]
    for m in np.unique(size[:split]):
        left = np.flatnonzero(size[:split] == m)
        for o in (m // 2, m, m * 2):
            right = np.flatnonzero(size[split:] == o) + split
            if not len(right):
                continue
            bits = min(m, o) // 8  # as 64-bit numbers
            x = _fold(np.frombuffer(b"".join([par[i] for i in left]), dtype=U).reshape(len(left), -1), bits)
            y = _fold(np.frombuffer(b"".join([par[i] for i in right]), dtype=U).reshape(len(right), -1), bits)
            for i in range(0, len(left), 64):
                p = left[i:i + 64]
                a, b = n[p][:, None], n[right][None, :]
                ok = (comp[p][:, None] != comp[right][None, :]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
                ok &= ~free[right][None, :] | (node[p][:, None] < node[right][None, :])
                p, q = np.nonzero(ok)
                d = np.bitwise_count(x[i + p] ^ y[q]).sum(1, dtype=np.int64)
                # similarity >= j means at most (n1 + n2) (1 - j) / (1 + j) elements differ
                few = d * (100 + percent) <= (n[left[i + p]] + n[right[q]]) * (100 - percent)
                out.append(np.stack([left[i + p[few]], right[q[few]], d[few]]))
    return tuple(np.concatenate(out, axis=1))


def forest(g: dict, split: int, k: int, percent: int, d: zstandard.ZstdDecompressor) -> list[tuple[int, int]]:
    """True links of a block that join its components, fewer than it has members."""
    node, comp = g["node"], g["comp"]
    left, right, _ = possible(g, split, percent)
    keys = np.stack([np.asarray(x) for x in g["keys"]])
    band = int(np.argmax(keys[0] == g["key"]))
    here = np.ones(len(left), dtype=bool)
    for i in range(0, len(left), 1 << 16):  # a pair belongs to the first band it shares
        a, b = left[i:i + (1 << 16)], right[i:i + (1 << 16)]
        here[i:i + (1 << 16)] = ~(keys[a, :band] == keys[b, :band]).any(1)
    left, right = left[here], right[here]
    if not len(left):
        return []
    used, back = np.unique(np.concatenate([left, right]), return_inverse=True)
    left, right = back[:len(left)], back[len(left):]
    sets, size = [], np.zeros(len(used), np.int64)
    for i, j, h, _, count in unpacked_sets(d, [g["z"][x] for x in used], k):
        sets.append(h)
        size[i:j] = count
    words, el = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(size) - size
    _, own = np.unique(comp[used], return_inverse=True)
    root = list(range(len(used)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links, mark = [], np.zeros(len(words), dtype=bool)
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    at = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
    for i, j in zip(at.tolist(), np.append(at[1:], len(left)).tolist()):
        x = int(left[i])
        mine = el[first[x]:first[x] + size[x]]
        mark[mine] = True
        others = [y for y in right[i:j].tolist() if find(own[y]) != find(own[x])]
        for o in range(0, len(others), 64):
            ys = np.array(others[o:o + 64])
            both = np.add.reduceat(mark[el[ranges(first[ys], size[ys])]].astype(np.int64), np.cumsum(size[ys]) - size[ys])
            for y in ys[100 * both >= percent * (size[x] + size[ys] - both)].tolist():
                a, b = find(own[x]), find(own[y])
                if a != b:
                    root[a] = b
                    links.append((int(node[used[x]]), int(node[used[y]])))
        mark[mine] = False
    return links


def by_block(batches, columns: list[str], work):
    """``work(members, split)`` for each block of rows sorted by key, a, b, side; its results, batch by batch."""
    def groups(t, last):
        k = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("key", "a", "b")], 1)
        starts = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1])
        ends = np.append(starts[1:], len(k))
        held = None
        if not last:  # the last block may go on in the next batch
            held = t.slice(int(starts[-1]))
            starts, ends = starts[:-1], ends[:-1]
        found = []
        for i, j in zip(starts.tolist(), ends.tolist()):
            part = t.slice(i, j - i)
            g = {c: part.column(c).to_pylist() if c in ("parity", "keys", "z") else part.column(c).to_numpy() for c in columns}
            g.update(key=k[i, 0], a=k[i, 1], b=k[i, 2], side=part.column("side").to_numpy())
            found.append(work(g, int((g["side"] == 0).sum())))
        return found, held

    held = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        found, held = groups(t, last=False)
        yield found
    if held is not None and held.num_rows:
        yield groups(held, last=True)[0]


def crossing(rows: DataFrame, sig: DataFrame, percent: int) -> DataFrame:
    """The members of blocks that have a possible partner there: ``key, a, b, side, free, node, comp``.

    ``rows`` (key, node, n, comp), ``sig`` (node, n, parity). A block is a part of the members outside the band's main component (side 0)
    and a part of all members (side 1), at most about BLOCK members and ELEMENTS elements each.
    """
    per = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    per = per.groupBy("key").agg(F.sum("c").alias("all"), F.sum("n").alias("n"), F.max(F.struct("c", "n", F.col("comp").alias("m"))).alias("top"), F.count(F.lit(1)).alias("comps"))
    blocks = lambda c, n: F.greatest(F.ceil(c / BLOCK), F.ceil(n / ELEMENTS)).cast("int")
    per = per.where("comps > 1").select("key", F.col("top.m").alias("main"), blocks(F.col("all") - F.col("top.c"), F.col("n") - F.col("top.n")).alias("na"),
                                        blocks(F.col("all"), F.col("n")).alias("nb"))
    open_rows = stored(rows.drop("n").join(per, "key"), "open")
    need = sig.join(open_rows.select("node").distinct(), "node", "left_semi")
    full = open_rows.join(need, "node").withColumn("free", F.col("comp") != F.col("main"))
    spread = F.xxhash64("node")
    a = full.where("free").withColumn("a", F.pmod(spread, "na").cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    b = full.withColumn("b", F.pmod(spread, "nb").cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("na") - 1)))
    cols = ["key", "a", "b", "side", "free", "node", "comp", "n", "parity"]
    both = a.withColumn("side", F.lit(0)).select(cols).unionByName(b.withColumn("side", F.lit(1)).select(cols))
    both = both.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "side")

    def members(g, split):
        left, right, _ = possible(g, split, percent)
        i = np.unique(np.concatenate([left, right]))
        one = lambda c: np.full(len(i), g[c])
        return [one("key"), one("a"), one("b"), g["side"][i], g["free"][i], g["node"][i], g["comp"][i]]

    def run(batches):
        names, kinds = cols[:7], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
        for found in by_block(batches, ["free", "node", "comp", "n", "parity"], members):
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*found), kinds)], names)

    return both.mapInArrow(run, "key long, a int, b int, side int, free boolean, node long, comp long")


def cross_links(members: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Links ``u, v`` that join the components of each block of ``crossing``."""
    nodes = members.select("node").distinct()
    held = classes.select("node", "n", "parity", "keys").join(nodes, "node", "left_semi")
    held = stored(held.join(packed_texts(docs, nodes), "node"), "members")
    rows = members.join(held, "node").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "side")

    def run(batches):
        d = zstandard.ZstdDecompressor()
        for found in by_block(batches, ["free", "node", "comp", "n", "parity", "keys", "z"], lambda g, split: forest(g, split, k, percent, d)):
            links = [x for block in found for x in block]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig = stored(signatures(docs, k), "signatures")
    linkable = sig.where("n > 0 and doc_id is not null")
    classes = stored(linkable.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("node"), F.any_value("keys").alias("keys"),
                                                           F.any_value("parity").alias("parity")), "classes")
    exploded = classes.select("node", "n", F.explode("keys").alias("key"))
    shared = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("hub")).where("c > 1").select("key", "hub")
    rows = stored(exploded.join(shared, "key").select("key", "node", "n", "hub"), "bands")
    votes = rows.where("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    star = votes.groupBy("node").agg(F.max(F.struct("c", (-F.col("hub")).alias("h"))).alias("m"))
    star = stored(star.select((-F.col("m.h")).alias("u"), F.col("node").alias("v")), "star")
    ends = star.select("u").unionByName(star.select(F.col("v").alias("u"))).distinct().withColumnRenamed("u", "node")
    links = stored(verified(packed_texts(docs, ends), star, k, percent), "links")
    comp = star_components(links, [])
    labelled = rows.select("key", "node", "n").join(comp, "node", "left").select("key", "node", "n", F.coalesce("comp", "node").alias("comp"))
    more = stored(crossing(labelled, classes.select("node", "n", "parity"), percent), "crossing")
    if not more.isEmpty():
        links = stored(links.unionByName(cross_links(more, docs, classes, k, percent)), "links")
        comp = star_components(links, [])
    final = classes.select("n", "d1", "d2", "node").join(comp, "node", "left").select(
        "n", "d1", "d2", F.coalesce("comp", "node").alias("component_id"))
    out = sig.select("doc_id", "n", "d1", "d2").join(final, ["n", "d1", "d2"], "left")
    one = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), one.alias("component_id"),
                      F.coalesce(F.col("doc_id") == one, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component; all columns stay."""
    gone = near_groups(docs, k, percent).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op2_minhash(spark, sf_dir):
    return near_groups(documents(spark, sf_dir), k=2)
