"""Incremental ingest with commit marks: only keys and files that were not taken up before, and no half of one.

Rows of a batch go to a folder of their own (``<target>/_batch=<id>``). A batch counts once its mark is written, as one
row in ``<target>_commits``, after everything else; readers ask ``committed`` for rows of marked batches. A run that ends early
leaves a folder without a mark: nobody sees it, and the next run takes the same keys up again.
"""
from __future__ import annotations

import hashlib
import uuid
from typing import Optional

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tubelens import schemas as K
from tubelens.operators.prefix import union_all
from tubelens.sources.contracts import with_violations
from tubelens.sources.tables import _parquet

BATCH = "_batch"
MARKS = f"{BATCH} string, n_rows long"


def _marks(spark: SparkSession, target: str) -> Optional[DataFrame]:
    return _parquet(spark, target + "_commits")


def _mark(spark: SparkSession, target: str, batch: str, n_rows: int) -> None:
    """The last write of a batch: one row in one file, so it is there or not."""
    spark.createDataFrame([(batch, n_rows)], MARKS).coalesce(1).write.mode("append").parquet(target + "_commits")


def _write(df: DataFrame, path: str, batch: str, partition_by=()) -> None:
    """The batch's folder, replaced as a whole when the batch is tried again."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{path}/{BATCH}={batch}")


def _read(spark: SparkSession, path: str, schema: T.StructType) -> Optional[DataFrame]:
    """All batches, marked or not, with their id."""
    if _parquet(spark, path) is None:
        return None
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.StringType())])).parquet(path)


def committed(spark: SparkSession, target: str, schema: T.StructType = K.DETECTIONS, part: str = "") -> DataFrame:
    """Rows of finished batches. ``part``: ``"_rejected"`` for what a stream put aside."""
    marks, rows = _marks(spark, target), _read(spark, target + part, schema)
    if marks is None or rows is None:
        return K.empty(spark, schema)
    return rows.join(marks.select(BATCH).distinct(), BATCH, "left_semi").select(*schema.names)


def unseen(new: DataFrame, done: DataFrame, keys=("tag", "volume_id")) -> DataFrame:
    """Rows whose key is not in the processed table. NULL is a key like any other."""
    seen = done.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return new.join(seen, same, "left_anti")


def ingest_new(new: DataFrame, target: str, keys=("tag", "volume_id"), steps: int = 1) -> DataFrame:
    """Take up the keys of ``new`` that no finished batch has; returns all finished rows.

    Keys are dealt to ``steps`` batches that are finished one after the other, so a run that ends early loses one step
    at most. A batch writes its rows (partitioned by the first key), then its keys, then its mark. A key is whole: rows that come later for
    a finished key are left out. One writer at a time.
    """
    spark, schema = new.sparkSession, new.schema
    kinds = T.StructType([schema[k] for k in keys])
    done = committed(spark, target, kinds, "_keys")
    todo = unseen(new, done, keys).withColumn("_step", F.pmod(F.xxhash64(*keys), F.lit(steps)))
    for step in range(steps):
        batch, rows = uuid.uuid4().hex, todo.where(F.col("_step") == step).drop("_step")
        _write(rows, target, batch, [keys[0]])
        written = spark.read.schema(schema).parquet(f"{target}/{BATCH}={batch}")
        counted = written.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
        _write(counted, target + "_keys", batch)
        total = spark.read.schema("n_rows long").parquet(f"{target}_keys/{BATCH}={batch}").agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
        _mark(spark, target, batch, total)
    return committed(spark, target, schema)


def unfinished(spark: SparkSession, target: str, schema: T.StructType = K.DETECTIONS, parts=("", "_keys", "_rejected")) -> list[str]:
    """Batches that were begun and never finished (their folders may be deleted)."""
    found = [d.select(BATCH) for p in parts if (d := _read(spark, target + p, T.StructType([]))) is not None]
    if not found:
        return []
    marks, all_ = _marks(spark, target), union_all(found).distinct()
    return sorted(r[0] for r in (all_ if marks is None else all_.join(marks.select(BATCH), BATCH, "left_anti")).collect())


def stream_detections(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Take up all new detection files, then stop. Rows that break the contract go to ``<target>_rejected``.

    Each micro-batch is checked once and gives good and rejected rows under one id, made of the checkpoint and Spark's
    number of the batch; a batch that is tried again replaces its own folders, and one that was marked already is left alone. So a lost driver or
    executor neither repeats nor skips a file, nor parts the two sinks.
    """
    name = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def take(rows: DataFrame, number: int) -> None:
        batch = f"{name}-{number}"
        marks = _marks(rows.sparkSession, target)
        if marks is not None and not marks.where(F.col(BATCH) == batch).isEmpty():
            return
        checked = with_violations(rows, K.DETECTIONS).persist()
        try:
            good = F.size("violations") == 0
            _write(checked.where(good).drop("violations"), target, batch)
            _write(checked.where(~good), target + "_rejected", batch)
            _mark(rows.sparkSession, target, batch, checked.count())
        finally:
            checked.unpersist()

    raw = spark.readStream.schema(K.DETECTIONS).parquet(source)
    raw.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
