"""Sharding by minimax contiguous partition of atomic groups (rows of equal text).

Groups are ordered by size, largest first, then by content hash, and cut into contiguous shards. The
smallest feasible capacity is found by binary search; a greedy walk checks a capacity. In this order
groups of one size stand together, so the walk only needs the table (size, number of groups). It has at most
sqrt(2 * total bytes) rows, since its sizes are distinct and sum to no more than the total; that is what the driver sees.
A group as large as a fair share of what is left gets a shard alone, and the rest is cut anew, so
one huge group of copies does not leave the other shards uneven.

Defined cases: null text has no bytes (size 16) and equals empty text; null ids and repeated rows are
numbered like others; shards may stay empty when there are fewer groups than shards; an empty table
gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tubelens.llm.common import documents, stored
from tubelens.llm.exact import content_hash
from tubelens.operators.prefix import range_blocks, running

OVERHEAD = 16
SLOT_BUCKETS = 512


def greedy(cum: np.ndarray, size: np.ndarray, start: int, stop_total: int, capacity: int, shards: int):
    """Byte positions where each further shard starts, or None when ``shards`` are not enough.

    ``cum[i]`` is the total before run i; positions are always at group borders.
    """
    cuts, at = [], start
    for _ in range(shards):
        run = int(np.searchsorted(cum, at + capacity, side="right")) - 1
        if run >= len(size):
            return cuts
        to = int(cum[run]) + (at + capacity - int(cum[run])) // int(size[run]) * int(size[run])
        if to >= stop_total:
            return cuts
        cuts.append(to)
        at = to
    return None


def plan(size: np.ndarray, count: np.ndarray, shards: int) -> list[tuple[int, int]]:
    """Cuts as ``(group size, rank within that size)`` for runs sorted by descending size."""
    size, count = size.astype(object), count.astype(object)  # exact integers
    cum = np.concatenate([[0], np.cumsum(size * count)]) if len(size) else np.array([0], dtype=object)
    cum = cum.astype(np.int64)
    total, at, left, cuts = int(cum[-1]), 0, shards, []
    while left > 1 and at < total:
        run = int(np.searchsorted(cum, at, side="right")) - 1
        if int(size[run]) * left < total - at:
            break
        at += int(size[run])  # a group of a fair share or more: alone
        left -= 1
        if at < total:
            cuts.append(at)
    if at < total and left > 1:
        run = int(np.searchsorted(cum, at, side="right")) - 1
        low = max(int(size[run]), -(-(total - at) // left))
        high = low + int(size[run])
        while low < high:
            mid = (low + high) // 2
            if greedy(cum, size, at, total, mid, left) is None:
                low = mid + 1
            else:
                high = mid
        cuts += greedy(cum, size, at, total, low, left)
    out = []
    for c in cuts:
        run = int(np.searchsorted(cum, c, side="right")) - 1
        out.append((int(size[run]), (c - int(cum[run])) // int(size[run])))
    return out


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), content_hash(text_col).alias("_h"),
                       (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    groups = stored(rows.groupBy("_h").agg(F.sum("size").alias("_g")), "groups")
    runs = groups.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("_g").desc()).collect()
    cuts = plan(np.array([r["_g"] for r in runs], dtype=np.int64), np.array([r["n"] for r in runs], dtype=np.int64), shards)
    split = sorted({s for s, r in cuts if r})
    inside = groups.where(F.col("_g").isin(split)) if split else groups.where("false")
    # ranks are needed only for the sizes that a cut goes through
    ranked = running(range_blocks(inside, ["_g"], [F.col("_h")]), ["_g"], [F.col("_h")],
                     {"_r": ("sum", F.lit(1).cast("long"))}).select("_h", "_g", (F.col("_r") - 1).alias("_r"))
    whole = groups.where(~F.col("_g").isin(split)) if split else groups
    placed = whole.select("_h", "_g", F.lit(0).cast("long").alias("_r")).unionByName(ranked)
    shard = F.lit(0)
    for s, r in cuts:
        shard = shard + ((F.col("_g") < s) | ((F.col("_g") == s) & (F.col("_r") >= r))).cast("int")
    out = rows.join(placed.select("_h", shard.alias("shard")), "_h")
    return slots(out).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                             F.lit(None).cast("int").alias("grown_shard"))


def slots(rows: DataFrame) -> DataFrame:
    """Gapless numbers per shard: row numbers in hashed buckets, plus the totals of earlier buckets."""
    rows = stored(rows.withColumn("_b", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOT_BUCKETS)).cast("int")), "placed")
    totals = rows.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))  # shards x buckets rows at most
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    here = Window.partitionBy("shard", "_b").orderBy("doc_id", "_h")
    rows = rows.withColumn("_i", F.row_number().over(here) - 1)
    return rows.join(totals, ["shard", "_b"]).withColumn("slot", (F.col("_i") + F.col("_o")).cast("long"))


def op4_sharding(spark, sf_dir):
    return assign(documents(spark, sf_dir))
