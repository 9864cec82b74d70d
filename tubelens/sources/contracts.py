"""Contract checks, fingerprints and guards."""
from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tubelens import schemas as K
from tubelens.operators.prefix import attach


def _rules(schema: T.StructType) -> dict[str, Column]:
    """Violation name -> condition that holds on a bad row."""
    names = {f.name for f in schema}
    out = {f"{f.name}_null": F.col(f.name).isNull() for f in schema if f.name != "component_id"}
    if {"x1", "x2", "y1", "y2"} <= names:
        out["x_order"] = ~(F.col("x1") < F.col("x2"))
        out["y_order"] = ~(F.col("y1") < F.col("y2"))
    if "score" in names:
        out["score_range"] = ~F.col("score").between(0.0, 1.0)
    if "probability" in names:
        out["probability_range"] = ~((F.col("probability") >= 0.0) & (F.col("probability") < 1.0))
    if {"r0", "r1", "c0", "c1"} <= names:
        out["box_order"] = (F.col("r1") < F.col("r0")) | (F.col("c1") < F.col("c0"))
    return out


def with_violations(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The contract's columns and an array of the rules each row breaks."""
    marks = [F.when(cond, F.lit(name)) for name, cond in _rules(schema).items()]
    return K.select_contract(df, schema).withColumn("violations", F.array_compact(F.array(*marks)))


def violation_counts(df: DataFrame, schema: T.StructType) -> DataFrame:
    """One row: rows and how many break each rule, in one aggregate."""
    return K.select_contract(df, schema).agg(F.count(F.lit(1)).alias("n_rows"), *[
        F.count_if(c).alias(n) for n, c in _rules(schema).items()])


def _check_types(df: DataFrame, schema: T.StructType) -> None:
    integers = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    for f in schema:
        if f.name not in df.columns:
            raise ValueError(f"missing columns: ['{f.name}']")
        have = df.schema[f.name].dataType
        ok = isinstance(have, type(f.dataType)) or \
            (isinstance(f.dataType, T.LongType) and isinstance(have, integers)) or \
            (isinstance(f.dataType, T.DoubleType) and isinstance(have, (T.FloatType, T.DoubleType)))
        if not ok:
            raise TypeError(f"{f.name}: expected {f.dataType.simpleString()}, found {have.simpleString()}")


def validate(df: DataFrame, schema: T.StructType, mode: str = "fail"):
    """Check types at once and rows by ``mode``.

    ``fail``: count violations first, raise if any. ``lazy``: raise inside the query that reads the
    rows, in generated code and without a job of its own. ``split``: (good, bad) where bad rows carry
    ``violations``. ``trusted``: no row check, so column pruning and pushdown are untouched.
    """
    _check_types(df, schema)
    if mode == "trusted":
        return K.select_contract(df, schema)
    if mode == "split":
        v = with_violations(df, schema)
        return v.where(F.size("violations") == 0).drop("violations"), v.where(F.size("violations") > 0)
    if mode == "lazy":
        names = [F.when(cond, F.lit(name)) for name, cond in _rules(schema).items()]
        bad = F.lit(False)
        for cond in _rules(schema).values():
            bad = bad | F.coalesce(cond, F.lit(False))
        stop = F.raise_error(F.concat(F.lit("contract violation: "), F.concat_ws(",", *names))).cast("boolean")
        return K.select_contract(df, schema).where(F.when(bad, stop).otherwise(F.lit(True)))
    if mode != "fail":
        raise ValueError(f"unknown mode {mode!r}")
    counts = violation_counts(df, schema).first().asDict()
    broken = {k: v for k, v in counts.items() if k != "n_rows" and v}
    if broken:
        raise ValueError(f"contract violations: {broken}")
    return K.select_contract(df, schema)


def unknown_volumes(pred: DataFrame, gt: DataFrame, key: str = "public_id") -> DataFrame:
    """Volumes with predictions but no ground truth."""
    return pred.select(key).distinct().join(gt.select(key).distinct(), key, "left_anti")


def assert_known_volumes(pred: DataFrame, gt: DataFrame, key: str = "public_id") -> DataFrame:
    first = unknown_volumes(pred, gt, key).first()
    if first is not None:
        raise ValueError(f"prediction on a volume without ground truth: {first[0]}")
    return pred


def fingerprint(config: dict) -> str:
    """SHA-256 of the configuration as canonical JSON."""
    text = json.dumps(config, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def stale_fingerprints(df: DataFrame, expected: str, col: str = "preprocess_hash") -> DataFrame:
    """Fingerprints present in the data that differ from the expected one, with their row counts."""
    return df.where(~F.col(col).eqNullSafe(expected)).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def assert_fingerprint(df: DataFrame, expected: str, col: str = "preprocess_hash") -> DataFrame:
    bad = stale_fingerprints(df, expected, col).first()
    if bad is not None:
        raise ValueError(f"data was written with another configuration: {bad[col]}")
    return df


def guard_split(split: str, allow_test: bool = False) -> str:
    """Refuse the hold-out split unless it is asked for explicitly."""
    if split not in ("train", "val", "test"):
        raise ValueError(f"unknown split {split!r}")
    if split == "test" and not allow_test:
        raise PermissionError("the test split needs allow_test=True")
    return split


def key_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys present on one side only: ``keys..., side`` ('left' or 'right')."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.subtract(right).withColumn("side", F.lit("left")).unionByName(
        right.subtract(left).withColumn("side", F.lit("right")))


def assert_same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    first = key_differences(a, b, keys).first()
    if first is not None:
        raise ValueError(f"keys differ: {first.asDict()}")


def check_alignment(record: DataFrame, pred: DataFrame, key: str = "candidate_id", prob: str = "score_max",
                    tol: float = 1e-9) -> DataFrame:
    """One row: joined pairs, rows on one side only, and probability mismatches above ``tol``."""
    r = record.select(key, F.col(prob).alias("_r"), F.lit(1).alias("_in_r"))
    p = pred.select(key, F.col("probability").alias("_p"), F.lit(1).alias("_in_p"))
    j = r.join(p, key, "full_outer")
    both = F.col("_in_r").isNotNull() & F.col("_in_p").isNotNull()
    return j.agg(F.count_if(both).alias("n_pairs"), F.count_if(~both).alias("n_unpaired"),
                 F.count_if(both & (F.abs(F.col("_r") - F.col("_p")) > tol)).alias("n_mismatch"))


def box_residuals(boxes: DataFrame, gt: DataFrame, fields, key: str = "public_id") -> DataFrame:
    """Absolute difference of each field between a recomputed box and the given one, and the largest."""
    j = boxes.select(key, *[F.col(f).alias("_a" + f) for f in fields]).join(gt.select(key, *fields), key)
    diffs = {f"d_{f}": F.abs(F.col("_a" + f) - F.col(f)) for f in fields}
    return j.select(key, *[c.alias(n) for n, c in diffs.items()]).withColumn("max_diff", F.greatest(*diffs))
