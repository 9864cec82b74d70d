"""Exact dedup: group by a 128-bit content hash, keep one id, compare bytes inside groups.

DataFrame functions only. One aggregation by hash takes the count, the id that stays and the smallest
and largest text. Texts of a group are byte-equal exactly when these two are equal, so every byte is
compared and map-side partial aggregation leaves one row per group and task, however large the group.
Only groups that hold a collision are split again by their text.

Defined cases: null text counts as empty; a null id never stays while a group has another (a group
with null ids only keeps them all); rows that repeat an id and text all carry ``kept`` when the id
stays; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tubelens.llm.common import documents, stored

HASH, MIXED = "_h", "_mixed"


def content_hash(text: Column | str) -> Column:
    """128 bits as 16 bytes."""
    return F.unhex(F.md5(F.encode(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "UTF-8")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max",
                 hash_fn=content_hash) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row. ``keep``: 'max' or 'min' id."""
    pick = {"max": F.max, "min": F.min}[keep]
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"),
                       hash_fn(text_col).alias(HASH))
    groups = base.groupBy(HASH).agg(
        F.count(F.lit(1)).alias("group_size"), pick("doc_id").alias("keep_id"),
        F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    # one narrow row per distinct text, written once: the collision test and the join both read it
    groups = stored(groups.select(HASH, "group_size", "keep_id", (F.col("_lo") != F.col("_hi")).alias(MIXED)), "exact")
    sha = F.sha2(F.encode("_t", "UTF-8"), 256).alias("text_sha256")
    out = base.select("doc_id", HASH, sha).join(groups.where(~F.col(MIXED)), HASH).select("doc_id", "keep_id", "group_size", "text_sha256")
    if not groups.where(MIXED).isEmpty():  # hash collisions: their rows are grouped by the text itself
        mixed = base.join(groups.where(MIXED).select(HASH), HASH, "left_semi").select("doc_id", "_t", sha)
        again = mixed.groupBy("_t").agg(F.count(F.lit(1)).alias("group_size"), pick("doc_id").alias("keep_id"))
        out = out.unionByName(mixed.join(again, "_t").select("doc_id", "keep_id", "group_size", "text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """``docs`` without exact copies, all columns kept. Ids must be unique to leave one row per text."""
    gone = exact_groups(docs, id_col, text_col, keep).where("not kept").select(F.col("doc_id").alias(id_col))
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def op1_exact_dedup(spark, sf_dir):
    return exact_groups(documents(spark, sf_dir))


SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents
window w as (partition by coalesce(text, ''))
"""
