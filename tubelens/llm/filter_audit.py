"""Filter interaction audit: what each of several filters removes, in every order they can be applied in.

A posting list holds the rows that fail one filter. Rows are dealt to ranges of ids; a task goes through its range in the order
(part, id) and writes, for every part and at most ``SPAN`` rows of it, one row with the sorted list of each filter and of each
label. Entries are places in that stretch of rows, so rows that repeat an id, or have none, stay apart. The lists are a table:
other audits can read it again.

All lists of one stretch lie in one row, so merging them needs no shuffle. Per stretch the union of every subset of filters is
taken by merging lists from the longest to the shortest: each entry of the shorter is found in the longer by a galloping
search, all at once, and what is not there is put in. Sizes of unions, also within each label's list, are added up per part; what
a filter removes after others is the difference of two unions. Only these sums, 2^filters for each part, meet the orders.

Defined cases: null text counts as empty; a null part as the empty string; a null id is a row of its own that never makes
another row a copy, nor is one; rows that repeat an id are counted one by one; a row counts as good or toxic when any
label row of its id says so, null labels say nothing; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tubelens.llm.common import documents, stored, table

SPAN = 1 << 16
LONG = 1 << 20          # bytes of a text whose words are taken at once
LABELS = ("good", "toxic")
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
_CAPITALS, _SIGNS = bytes(range(65, 91)), b"#$%&*|"
_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that start no character
_GAPS = b"\t\n\v\f\r "


def _words(raw: bytes) -> tuple[int, int]:
    """Words and distinct words; long texts in parts that end at a gap."""
    if len(raw) <= LONG:
        w = raw.split()
        return len(w), len(set(w))
    n, seen, at = 0, set(), 0
    while at < len(raw):
        end = at + LONG
        while end < len(raw) and raw[end] not in _GAPS:
            end += 1
        w = raw[at:end].split()
        n, at = n + len(w), end
        seen.update(w)
    return n, len(seen)


def text_failures(raw: bytes) -> str:
    """Letters of the filters A to D that a text fails."""
    n, distinct = _words(raw)
    points = len(raw) if raw.isascii() else len(raw.translate(None, _FOLLOWING))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return "".join(f for f, bad in (("A", n < MIN_WORDS), ("B", 100 * distinct < MIN_DISTINCT * n),
                                    ("C", 100 * capitals > MAX_CAPITALS * points), ("D", len(raw.translate(None, _SIGNS)) != len(raw))) if bad)


def judged(docs: DataFrame, part: str = "source") -> DataFrame:
    """``id, part, fails, digest``: text filters and the SHA-256 of every row, without its text."""
    def run(batches):
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            fails, digest = [], []
            for t in texts:
                raw = t.as_py() or b""
                fails.append(text_failures(raw))
                digest.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("part"), pa.array(fails, pa.string()), pa.array(digest, pa.binary())],
                                             names=["id", "part", "fails", "digest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    return rows.mapInArrow(run, f"id {kind}, part string, fails string, digest binary")


def with_copies(rows: DataFrame) -> DataFrame:
    """Filter E: a row fails when a smaller id has its text. Only digests that occur twice are joined back."""
    first = rows.groupBy("digest").agg(F.min("id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    late = F.coalesce(F.col("id") > F.col("_first"), F.lit(False))
    return rows.join(first, "digest", "left").select("id", "part", F.concat("fails", F.when(late, "E").otherwise("")).alias("fails"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    any_of = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)) == 1
    lab = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(any_of("quality").alias("good"), any_of("toxic").alias("toxic"))
    return rows.join(lab, "id", "left").select("id", "part", "fails", *[F.coalesce(c, F.lit(False)).alias(c) for c in LABELS])


def postings(rows: DataFrame, filters: str, span: int = SPAN) -> DataFrame:
    """The posting table: ``part, n_rows`` and per filter and label the sorted places of its rows in this stretch of ids."""
    names = [*filters, *LABELS]

    def run(batches):
        part, n, lists, out = None, 0, {c: [] for c in names}, []

        def close():
            if n:
                out.append((part, n, {c: np.concatenate(v) if v else np.zeros(0, np.int32) for c, v in lists.items()}))
            for v in lists.values():
                v.clear()

        def table():
            cols = [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64())]
            for c in names:
                ends = np.cumsum([0, *[len(r[2][c]) for r in out]]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[2][c] for r in out]).astype(np.int32))))
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=["part", "n_rows", *names])

        for b in batches:
            parts = np.array(b.column("part").to_pylist(), dtype=object)
            fails = b.column("fails").to_pylist()
            marks = {f: np.array([f in x for x in fails], dtype=bool) for f in filters}
            marks |= {c: b.column(c).to_numpy(zero_copy_only=False) for c in LABELS}
            at = 0
            while at < len(parts):
                if parts[at] != part or n == span:
                    close()
                    part, n = parts[at], 0
                other = np.flatnonzero(parts[at:at + span - n] != part)
                end = at + (int(other[0]) if len(other) else min(span - n, len(parts) - at))
                for c in names:
                    lists[c].append((np.flatnonzero(marks[c][at:end]) + n).astype(np.int32))
                n, at = n + end - at, end
            if out:
                yield table()
        close()
        if out:
            yield table()

    kinds = T.StructType([T.StructField("part", T.StringType()), T.StructField("n_rows", T.LongType()),
                          *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in names]])
    return rows.repartitionByRange("id").sortWithinPartitions("part", "id").mapInArrow(run, kinds)


def merged(longer: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Union of two sorted lists without repeats: entries of the shorter are searched for in the longer, each from where the one
    before it was found, and the missing ones put in."""
    if len(longer) < len(shorter):
        longer, shorter = shorter, longer
    if not len(shorter):
        return longer
    at = np.searchsorted(longer, shorter)
    there = at < len(longer)
    there[there] = longer[at[there]] == shorter[there]
    return np.insert(longer, at[~there], shorter[~there])


def common(longer: np.ndarray, shorter: np.ndarray) -> int:
    """How many entries two sorted lists share."""
    if len(longer) < len(shorter):
        longer, shorter = shorter, longer
    at = np.searchsorted(longer, shorter)
    there = at < len(longer)
    return int((longer[at[there]] == shorter[there]).sum())


def union_sizes(lists: dict[str, np.ndarray], filters: str, labels=LABELS) -> dict[str, list[int]]:
    """For every subset of filters (bit i: filter i): the size of the union, alone and within each label's list."""
    k = len(filters)
    order = sorted(range(k), key=lambda i: len(lists[filters[i]]))  # the longest list is merged first
    unions = {0: np.zeros(0, dtype=np.int32)}
    for subset in range(1, 1 << k):
        low = next(i for i in order if subset >> i & 1)
        unions[subset] = merged(unions[subset & ~(1 << low)], lists[filters[low]]) if subset & (subset - 1) else lists[filters[low]]
    out = {"n": [len(unions[s]) for s in range(1 << k)]}
    return out | {c: [common(unions[s], lists[c]) for s in range(1 << k)] for c in labels}


def part_unions(posts: DataFrame, filters: str) -> DataFrame:
    """``part, rows, failing, good, toxic``: rows of the part, and for every subset of filters the sizes of the union, as arrays
    indexed by the subset. A task sends one row for each part."""
    m, kinds = 1 << len(filters), ("failing", *LABELS)
    names = [f"{c}_{s}" for c in kinds for s in range(m)]

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for i in range(b.num_rows):
                u = union_sizes({c: b.column(c)[i].values.to_numpy() for c in [*filters, *LABELS]}, filters)
                row = np.array([b.column("n_rows")[i].as_py(), *u["n"], *[x for c in LABELS for x in u[c]]], dtype=np.int64)
                part = b.column("part")[i].as_py()
                sums[part] = sums[part] + row if part in sums else row
        grid = np.stack(list(sums.values())) if sums else np.zeros((0, 1 + len(names)), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *[pa.array(c) for c in grid.T.copy()]], names=["part", "rows", *names])

    added = posts.mapInArrow(run, "part string, " + ", ".join(f"{c} long" for c in ["rows", *names])).groupBy("part").agg(
        *[F.sum(c).alias(c) for c in ["rows", *names]])
    return added.select("part", "rows", *[F.array(*[f"{c}_{s}" for s in range(m)]).alias(c) for c in kinds])


def _steps(spark: SparkSession, filters: str) -> DataFrame:
    """Every order and step as bit sets: what was applied before, the filter, all others. Its size depends on the filters alone."""
    rows, full = [], (1 << len(filters)) - 1
    for order in itertools.permutations(filters):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << filters.index(f)
            rows.append(("".join(order), step, before, before | bit, bit, full & ~bit))
            before |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, before int, after int, own int, others int")


def audit(unions: DataFrame, filters: str) -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = unions.sparkSession
    at = lambda c, s: F.get(c, s)
    full = F.lit((1 << len(filters)) - 1)
    every = unions.join(F.broadcast(_steps(spark, filters)))
    removed = at("failing", F.col("after")) - at("failing", F.col("before"))
    out = every.select(
        "part", "filter_order", "step", "own", (F.col("rows") - at("failing", F.col("after"))).alias("kept"), removed.alias("removed"),
        (at("failing", F.col("own")) - removed).alias("redundant"), (at("failing", full) - at("failing", F.col("others"))).alias("unique_fails"),
        *[(at(c, F.col("after")) - at(c, F.col("before"))).alias(f"{c}_lost") for c in LABELS])
    share = out.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return out.join(share, ["part", "own"]).drop("own")


FILTERS = "ABCDE"


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(judged(documents(spark, sf_dir)), "judged")
    posts = stored(postings(stored(with_labels(with_copies(rows), table(spark, sf_dir, "labels")), "failing"), FILTERS), "postings")
    return audit(part_unions(posts, FILTERS), FILTERS)


SQL = r"""
with recursive d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents
), w as (
  select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
         min(doc_id) over (partition by t) as first_id,
         exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1) as good,
         exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 1) as toxic
  from d
), m as (
  select part, good, toxic,
         (case when len(words) < 50 then 1 else 0 end)
         + (case when 100 * len(list_distinct(words)) < 65 * len(words) then 2 else 0 end)
         + (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) then 4 else 0 end)
         + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end)
         + (case when doc_id > first_id then 16 else 0 end) as mask
  from w
), c as (
  select part, mask, count(*) as n, count(*) filter (good) as g, count(*) filter (toxic) as x from m group by all
), f(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), p(filter_order, used) as (
  select '', 0 union all select filter_order || letter, used | bit from p, f where used & bit = 0
), s as (
  select filter_order, step, list_sum(list_transform(string_split(filter_order[1:step - 1], ''), lambda z: case z when 'A' then 1 when 'B' then 2 when 'C' then 4 when 'D' then 8 when 'E' then 16 else 0 end)) as before, bit
  from p, range(1, 6) r(step), f where used = 31 and letter = filter_order[step]
), o as (
  select part, filter_order, step::int as step, bit,
         coalesce(sum(n) filter (mask & (before::int | bit) = 0), 0)::bigint as kept,
         coalesce(sum(n) filter (mask & before::int = 0 and mask & bit > 0), 0)::bigint as removed,
         coalesce(sum(n) filter (mask & before::int > 0 and mask & bit > 0), 0)::bigint as redundant,
         coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
         coalesce(sum(g) filter (mask & before::int = 0 and mask & bit > 0), 0)::bigint as good_lost,
         coalesce(sum(x) filter (mask & before::int = 0 and mask & bit > 0), 0)::bigint as toxic_lost
  from s, c group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, bit))::bigint as shapley
from o
"""
