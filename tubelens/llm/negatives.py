"""Hard-negative mining: exact top lists of inner products, with coordinate pruning over length buckets.

Rows become integer vectors. Equal vectors of one label are one entry with the smallest ids that any list could need, so a
vector that a third of all rows share costs one comparison, not one for each row. Entries are sorted by length and cut into buckets of
at most ``BUCKET`` entries; a bucket holds its vectors, and for every coordinate the sorted list of the values with
the entries they belong to. Queries, one for each distinct vector and label among the anchors, are taken in blocks.

A block meets buckets from the longest to the shortest, several lanes at once, so a task holds one block and one bucket. With a
bucket of length at most L and a query of length Q, a score of at least s needs a cosine of at least c = s / (Q L). Then on a
coordinate where the query's direction has the value q, an entry's direction must lie in q c -/+ sqrt((1 - q^2)(1 - c^2)); times the
bucket's shortest and longest length, that is a range of its sorted list. The ranges of the query's ``FOCUS`` largest coordinates are
found by binary search and intersected; what is left is verified by the exact integer product. s rises as lists fill. Buckets
whose length can't reach s are not sent to the block at all.

First the positives of each query (buckets of its label), then, for each distinct score of a positive, the best entries of other
labels whose score lies in the window. Last, lists are given to the anchors: an anchor's own row is taken out of its positives.
Queries are known by 64-bit hashes.

Defined cases: rows with a null id, label, vector or component, or a component that is not finite or 65,536 and more in size (its scores
could leave 64 bits), take no part; vectors of different lengths are compared as if the shorter ended in zeros; of rows that
repeat an id one takes part, that with the smallest label and vector; ties go to the smaller id; an anchor
without positives, or a positive without negatives in its window, gives no row; an empty table gives none; other columns are ignored.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tubelens.llm import kernels as K
from tubelens.llm.common import stored, table

SCALE, LIMIT = 256.0, 65536.0
BUCKET = 2048      # entries of a bucket
BLOCK = 256        # queries of a block
LANE = 16          # buckets of a lane, about
FOCUS = 4          # coordinates looked at
SAFE = 2.0 ** 53   # sums below are exact in double


# ---------------------------------------------------------------- rows
def entries(rows: DataFrame) -> DataFrame:
    """``vec_id, label, q``: rows that take part, with their integer vectors as little-endian 32-bit numbers."""
    def run(batches):
        for b in batches:
            col = b.column("embedding")
            col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
            ends = np.asarray(col.offsets)
            flat = col.values.cast(pa.float64())
            good = np.isfinite(np.asarray(flat.fill_null(np.nan)))
            x = np.asarray(flat.fill_null(0.0))
            good &= np.abs(np.where(good, x, 0)) < LIMIT
            bad = np.concatenate([[0], np.cumsum(~good)])
            ok = (bad[ends[1:]] == bad[ends[:-1]])
            ints = np.floor(np.where(good, x, 0.0) * SCALE).astype("<i4")
            raw = [ints[lo:hi].tobytes() if k else None for lo, hi, k in zip(ends[:-1], ends[1:], ok)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(raw, pa.binary())], names=["vec_id", "label", "q"])

    some = rows.where("vec_id is not null and label is not null and embedding is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    whole = some.mapInArrow(run, "vec_id long, label long, q binary").where("q is not null")
    one = whole.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r"))
    return one.select("vec_id", "r.label", "r.q")


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """``label, q, ids``: distinct vectors with their ``ids`` smallest ids (no list can use more of them)."""
    w = Window.partitionBy("label", "q").orderBy("vec_id")
    few = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= ids)
    return few.groupBy("label", "q").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(raw: list[bytes], dim: int | None = None) -> np.ndarray:
    d = max((len(r) // 4 for r in raw), default=0) if dim is None else dim
    out = np.zeros((len(raw), d), dtype=np.int64)
    for i, r in enumerate(raw):
        v = np.frombuffer(r, dtype="<i4")[:d]
        out[i, :len(v)] = v
    return out


_SCHEMA = "label long, longest double, shortest double, n int, dim int, vectors binary, labels binary, ids binary, per binary, values binary, places binary"


def buckets(distinct: DataFrame, by_label: bool, size: int = BUCKET) -> DataFrame:
    """Entries in order of length, cut into buckets with their coordinate lists. ``by_label``: one label for a bucket."""
    def cut(batches):
        held: list[tuple] = []

        def close():
            x = _matrix([h[1] for h in held])
            lens = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
            order = np.argsort(x, axis=0, kind="stable") if x.size else np.zeros(x.shape, dtype=np.int64)
            values = np.take_along_axis(x, order, axis=0) if x.size else x
            row = [held[0][0] if by_label else None, float(lens.max()), float(lens.min()), len(held), x.shape[1],
                   x.astype("<i4").tobytes(), np.array([h[0] for h in held], dtype="<i8").tobytes(),
                   np.array([i for h in held for i in h[2]], dtype="<i8").tobytes(), np.array([len(h[2]) for h in held], dtype="<i4").tobytes(),
                   values.T.astype("<i4").tobytes(), order.T.astype("<u2").tobytes()]
            held.clear()
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in _SCHEMA.split(", ")])

        for b in batches:
            for label, q, ids in zip(*[b.column(c).to_pylist() for c in ("label", "q", "ids")]):
                if held and (len(held) >= size or by_label and held[0][0] != label):
                    yield close()
                held.append((label, q, ids))
        if held:
            yield close()

    order = [*([F.col("label")] if by_label else []), F.col("length").desc(), F.col("q"), F.col("label")]
    return _with_length(distinct).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, _SCHEMA)


# ---------------------------------------------------------------- search in a task
class Bucket:
    """One bucket as arrays; ``values[f]`` is the sorted list of coordinate f, ``places[f]`` whose values they are."""

    def __init__(self, r: dict):
        n, d = r["n"], r["dim"]
        self.n, self.dim, self.longest, self.shortest = n, d, r["longest"], r["shortest"]
        self.x = np.frombuffer(r["vectors"], "<i4").reshape(n, d)
        self.exact = self.x.astype(np.float64)
        self.labels = np.frombuffer(r["labels"], "<i8")
        self.per = np.frombuffer(r["per"], "<i4").astype(np.int64)
        self.ids, self.first = np.frombuffer(r["ids"], "<i8"), np.concatenate([[0], np.cumsum(self.per)])
        self.values = np.frombuffer(r["values"], "<i4").reshape(d, n)
        self.places = np.frombuffer(r["places"], "<u2").reshape(d, n)

    def feasible(self, q: np.ndarray, length: float, least: int, focus: int = FOCUS) -> np.ndarray:
        """Entries that may score ``least``: those in the value range of each focus coordinate."""
        if least <= 0 or not length or not self.longest:
            return np.arange(self.n) if least <= 0 else np.zeros(0, dtype=np.int64)
        c = least / (length * self.longest) * (1 - 1e-9)
        if c > 1:
            return np.zeros(0, dtype=np.int64)
        d = min(self.dim, len(q))
        at = np.argsort(-np.abs(q[:d]), kind="stable")[:focus]
        found = None
        for f in at.tolist():
            u = q[f] / length
            wide = math.sqrt(max(1 - u * u, 0.0) * max(1 - c * c, 0.0))
            lo, hi = u * c - wide, u * c + wide
            if u >= c:   # the axis itself is within reach of the query's direction
                hi = 1.0
            if -u >= c:
                lo = -1.0
            low = lo * (self.longest if lo < 0 else self.shortest)
            high = hi * (self.longest if hi > 0 else self.shortest)
            a = np.searchsorted(self.values[f], math.floor(low - 1e-6 * abs(low)) - 1)
            z = np.searchsorted(self.values[f], math.ceil(high + 1e-6 * abs(high)) + 1, side="right")
            if z - a == self.n:
                continue
            mask = np.zeros(self.n, dtype=bool)
            mask[self.places[f][a:z]] = True
            found = mask if found is None else found & mask
            if not found.any():
                break
        return np.arange(self.n) if found is None else np.flatnonzero(found)

    def scores(self, q: np.ndarray, length: float, at: np.ndarray) -> np.ndarray:
        """Exact integer products with the entries ``at``."""
        d = min(self.dim, len(q))
        if length * self.longest < SAFE:
            rows = self.exact if len(at) == self.n else self.exact[at]
            return (rows[:, :d] @ q[:d].astype(np.float64)).astype(np.int64)
        return self.x[at, :d].astype(np.int64) @ q[:d]

    def listed(self, at: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids, one for each id of the entries."""
        n = self.per[at]
        return np.repeat(score, n), self.ids[K.ranges(self.first[at], n)]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(score) > 8 * k:  # all that tie with the k-th stay for the sort
        keep = score >= np.partition(score, len(score) - k)[len(score) - k]
        score, ids = score[keep], ids[keep]
    o = np.lexsort((ids, -score))[:k]
    return score[o], ids[o]


class Positives:
    """The best ``k`` entries of the query's own label."""

    def __init__(self, row: dict, k: int):
        self.q, self.k = np.frombuffer(row["q"], "<i4").astype(np.int64), k
        self.length = math.sqrt(float((self.q.astype(np.float64) ** 2).sum()))
        self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def look(self, b: Bucket) -> None:
        if len(self.score) == self.k:
            at = b.feasible(self.q, self.length, int(self.score[-1]))
        else:
            at = np.arange(b.n)
        if len(at):
            s, i = b.listed(at, b.scores(self.q, self.length, at))
            self.score, self.ids = _best(np.concatenate([self.score, s]), np.concatenate([self.ids, i]), self.k)

    def rows(self):
        return [(int(s), 0, int(s), int(i)) for s, i in zip(self.score, self.ids)]


class Negatives:
    """For each score p of a positive the best ``k`` entries of other labels with lo p <= 100 score <= hi p."""

    def __init__(self, row: dict, k: int, window: tuple[int, int]):
        self.q, self.k, self.label = np.frombuffer(row["q"], "<i4").astype(np.int64), k, row["label"]
        self.length = math.sqrt(float((self.q.astype(np.float64) ** 2).sum()))
        # -(-a // b) rounds up; an empty window (negative p) is dropped
        spans = [(p, -(-window[0] * p // 100), window[1] * p // 100) for p in row["scores"]]
        self.spans = [s for s in spans if s[1] <= s[2]]
        self.least = {p: lo for p, lo, _ in self.spans}
        self.lists = {p: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for p, _, _ in self.spans}

    def look(self, b: Bucket) -> None:
        if not self.spans:
            return
        at = b.feasible(self.q, self.length, min(self.least.values()))
        at = at[b.labels[at] != self.label]
        if not len(at):
            return
        score = b.scores(self.q, self.length, at)
        for p, _, hi in self.spans:
            ok = (score >= self.least[p]) & (score <= hi)
            if ok.any():
                s, i = b.listed(at[ok], score[ok])
                s0, i0 = self.lists[p]
                s, i = self.lists[p] = _best(np.concatenate([s0, s]), np.concatenate([i0, i]), self.k)
                if len(s) == self.k:
                    self.least[p] = max(self.least[p], int(s[-1]))

    def rows(self):
        return [(p, 1, int(s), int(i)) for p, (score, ids) in self.lists.items() for s, i in zip(score, ids)]


# ---------------------------------------------------------------- blocks against buckets
def _blocks(queries: DataFrame, by_label: bool, size: int = BLOCK) -> DataFrame:
    """Queries packed ``size`` to a row: ``block, label, reach`` and their columns as lists. ``reach``: the greatest
    (length / least score that counts), so a bucket of length L matters only if L * reach >= 1."""
    group = ["label"] if by_label else []
    n = queries.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    if by_label:
        q = queries.join(n, "label").withColumn("_b", F.pmod(F.xxhash64("q"), F.ceil(F.col("_n") / size)))
    else:
        total = n.first()["_n"]
        q = queries.withColumn("_b", F.pmod(F.xxhash64("q", "label"), F.lit(max(1, math.ceil(total / size)))))
    return q.groupBy(*group, "_b").agg(
        F.collect_list(F.struct("key", "q", *(["scores", F.col("label").alias("own")] if not by_label else []))).alias("queries"),
        *([] if by_label else [F.max("reach").alias("reach")])).withColumn("block", F.xxhash64(*group, "_b"))


def _search(blocks: DataFrame, table_: DataFrame, by_label: bool, make) -> DataFrame:
    """Every block against the buckets it needs. A task gets the block, then buckets from the longest to the shortest."""
    per = table_.groupBy("label").count() if by_label else table_.agg(F.count(F.lit(1)).alias("count"))
    if by_label:  # lanes within the label
        lanes = per.select("label", F.ceil(F.col("count") / LANE).cast("int").alias("lanes"))
        t, b = table_.join(lanes, "label"), blocks.join(lanes, "label")
    else:
        n = max(1, math.ceil(per.first()["count"] / LANE))
        t, b = table_.withColumn("lanes", F.lit(n)), blocks.withColumn("lanes", F.lit(n))
    lane = F.pmod(F.xxhash64("longest", "vectors", "labels"), F.col("lanes")).cast("int")
    b = b.withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).drop("lanes")
    t = t.withColumn("lane", lane).drop("lanes")
    keys = (["label"] if by_label else []) + ["lane"]
    need = b.select(*keys, "block", *([] if by_label else ["reach"]))
    pairs = (t if by_label else t.drop("label")).join(need, keys)
    if not by_label:
        pairs = pairs.where(F.col("longest") * F.col("reach") >= 1.0 - 1e-9)
    heads = b.select(*keys, "block", "queries")
    body = [c.split()[0] for c in _SCHEMA.split(", ")][1:]
    both = heads.select("block", "lane", "queries", F.lit(float("inf")).alias("longest"), *[F.lit(None).cast(k).alias(c) for c, k in
                        (x.split() for x in _SCHEMA.split(", ")[2:])]).unionByName(pairs.select("block", "lane", F.lit(None).cast(b.schema["queries"].dataType).alias("queries"), *body))

    def run(batches):
        now, state, done = None, [], []

        def flush():
            for key, s in state:
                done.extend((key, *r) for r in s.rows())

        def sent():
            cols = list(zip(*done)) or [[]] * 5
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()])],
                                              names=["key", "p", "kind", "score", "id"])

        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                if r["queries"] is not None:
                    flush()
                    now, state = (r["block"], r["lane"]), [(q["key"], make(q)) for q in r["queries"]]
                elif now == (r["block"], r["lane"]):
                    bucket = Bucket(r)
                    for _, s in state:
                        s.look(bucket)
            if done:
                yield sent()
        flush()
        if done:
            yield sent()

    spark = blocks.sparkSession  # much work for few bytes: the number of tasks is set here, not by size
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    spread = both.repartition(tasks, "block", "lane").sortWithinPartitions("block", "lane", F.col("longest").desc())
    return spread.mapInArrow(run, "key long, p long, kind int, score long, id long")


def _with_length(q: DataFrame) -> DataFrame:
    """Add ``length``, the length of the integer vector."""
    cols = q.columns

    def run(batches):
        for b in batches:
            n = [math.sqrt(float((np.frombuffer(r.as_py(), "<i4").astype(np.float64) ** 2).sum())) for r in b.column("q")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in cols], pa.array(n, pa.float64())], names=[*cols, "length"])

    return q.mapInArrow(run, T.StructType([*q.schema.fields, T.StructField("length", T.DoubleType())]))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``rows`` (``vec_id, label, embedding``)."""
    all_rows = stored(entries(rows), "entries")
    distinct = stored(distinct_vectors(all_rows, max(positives + 1, negatives)), "vectors")
    anchors = all_rows.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), "label", "q")
    queries = stored(anchors.select("label", "q").distinct().withColumn("key", F.xxhash64("label", "q")), "queries")

    near = _search(_blocks(queries, True), stored(buckets(distinct, True), "label-buckets"), True, lambda q: Positives(q, positives + 1))
    w = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    best = stored(near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= positives + 1).select("key", "score", "id"), "positives")
    # an anchor's row is one of the best of its query, or not among them; either way it is left out
    own = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    pairs = stored(anchors.withColumn("key", F.xxhash64("label", "q")).select("anchor_id", "key").join(best, "key")
                   .withColumnRenamed("id", "positive_id").where("positive_id <> anchor_id")
                   .withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= positives).drop("_r"), "pairs")

    asked = pairs.groupBy("key").agg(F.sort_array(F.collect_set("score")).alias("scores"))  # at most positives + 1 scores
    least = F.array_min(F.filter("scores", lambda p: p >= 0)) * (window[0] / 100.0)
    q2 = _with_length(queries.join(asked, "key")).withColumn("reach", F.when(least > 0, F.col("length") / least).otherwise(F.lit(float("inf")))).drop("length")
    far = _search(_blocks(stored(q2, "asked"), False), stored(buckets(distinct, False), "buckets"), False,
                  lambda q: Negatives(q | {"label": q["own"]}, negatives, window))
    top = Window.partitionBy("key", "p").orderBy(F.desc("score"), "id")
    lists = far.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= negatives).select(
        "key", F.col("p").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.withColumnRenamed("score", "positive_score").join(lists, ["key", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def prepared(rows: DataFrame) -> DataFrame:
    """The labels of the contract: every seventh id has the next one of ten."""
    return rows.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long")).alias("label"), "embedding")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(prepared(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


SQL = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same,
         list_inner_product(a.q, b.q)::bigint as score
  from r a, r b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), p as (
  select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, p.positive_id,
       (row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.id))::int as rank,
       n.id as negative_id, p.positive_score, n.score as negative_score
from p join s n on n.anchor_id = p.anchor_id and not n.same
  and 30 * p.positive_score <= 100 * n.score and 100 * n.score <= 90 * p.positive_score
qualify rank <= 10
"""
