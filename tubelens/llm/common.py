"""Spark helpers shared by the text operators."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tubelens.session import materialize, stored

__all__ = ["documents", "table", "materialize", "stored", "train_row", "held_out", "id_bit", "id_filter", "in_filter", "FILTER_BITS", "HOLD"]

HOLD = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


FILTER_BITS = 1 << 24


def id_bit(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of FILTER_BITS hash classes (2 MB, whatever the input) that hold an id.

    It keeps rows that can't join from being shuffled. Ids outside the set may pass, so a join must follow; when most bits are
    set it saves nothing and loses nothing.
    """
    bit = id_bit(column)
    parts = ids.select(F.floor(bit / 32768).cast("int").alias("k"), (bit % 32768).alias("b")).groupBy("k").agg(
        F.bitmap_construct_agg("b").alias("m")).collect()
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in parts:
        out[r["k"] * 4096:(r["k"] + 1) * 4096] = np.frombuffer(bytes(r["m"]), dtype=np.uint8)
    return out


def in_filter(bitmap: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def held_out(doc_id: Column | str) -> Column:
    """True where crc32 of the id as text leaves remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4 == HOLD,
                      F.lit(False))


def train_row(doc_id: Column | str) -> Column:
    return ~held_out(doc_id)
