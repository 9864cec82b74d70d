"""Readers and writers. Paths are read by Spark, with fixed schemas and no inference."""
from __future__ import annotations

from typing import Optional

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tubelens import schemas as K
from tubelens.functions import boxes as B
from tubelens.sources.contracts import validate


def _parquet(spark: SparkSession, *paths: str) -> Optional[DataFrame]:
    """The first of ``paths`` that is there, or None."""
    for p in paths:
        try:
            return spark.read.parquet(p)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return None


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Columns are found by their names in the header, in any order; others are left out."""
    header = spark.read.csv(path, header=True).columns
    missing = [f.name for f in schema if f.name not in header]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    kinds = {f.name: f.dataType for f in schema}
    by_header = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header])
    return spark.read.schema(by_header).csv(path, header=True).select(*schema.names)


def _read(spark: SparkSession, path: str, schema: T.StructType, mode: str) -> DataFrame:
    """``<path>.parquet`` or ``path`` as Parquet; the CSV mirror when there is no Parquet."""
    base = path.removesuffix(".parquet").removesuffix(".csv")
    df = None if path.endswith(".csv") else _parquet(spark, base + ".parquet", path)
    return validate(_csv(spark, base + ".csv", schema) if df is None else df, schema, mode)


def _write(df: DataFrame, path: str, csv_mirror: bool, partition_by=()) -> None:
    base = path.removesuffix(".parquet").removesuffix(".csv")
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(base + ".parquet")
    if csv_mirror:
        df.write.mode("overwrite").csv(base + ".csv", header=True)


def read_detections(spark: SparkSession, path: str, mode: str = "lazy") -> DataFrame:
    return _read(spark, path, K.DETECTIONS, mode)


def write_detections(df: DataFrame, path: str, csv_mirror: bool = False, mode: str = "lazy") -> None:
    """Checked while it is written, so the rows are read once."""
    _write(validate(df, K.DETECTIONS, mode), path, csv_mirror)


def read_slice_boxes(spark: SparkSession, path: str, mode: str = "lazy") -> DataFrame:
    return _read(spark, path, K.SLICE_BOXES, mode)


def write_slice_boxes(df: DataFrame, path: str, csv_mirror: bool = False, mode: str = "lazy") -> None:
    _write(validate(df, K.SLICE_BOXES, mode), path, csv_mirror)


def read_gt(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth as shipped (other column names) -> contract names; no other columns allowed."""
    kinds = {n: K.GT_BOXES[v].dataType for n, v in K.GT_SHIPPED_NAMES.items()}
    header = spark.read.csv(path, header=True)
    if set(header.columns) != set(kinds):
        raise ValueError(f"expected columns {sorted(kinds)}, found {sorted(header.columns)}")
    schema = T.StructType([T.StructField(c, kinds[c]) for c in header.columns])
    df = spark.read.schema(schema).csv(path, header=True).withColumnsRenamed(K.GT_SHIPPED_NAMES)
    return K.select_contract(df, K.GT_BOXES)


def read_case_labels(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, K.CASE_LABELS).select("case_id", "label")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per volume."""
    return spark.read.schema(K.META).json(path)


def read_epoch_log(spark: SparkSession, path: str) -> DataFrame:
    """Training log, one JSON object per line."""
    return spark.read.schema(K.EPOCH_LOG).json(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# ---------------------------------------------------------------- candidates, predictions
def write_candidates(df: DataFrame, path: str, csv_mirror: bool = False) -> None:
    """Partitioned by split and detector, so later reads prune to the pool they need."""
    _write(K.select_contract(df, K.CANDIDATES), path, csv_mirror, ["split", "detector_of_origin"])


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    base = path.removesuffix(".parquet").removesuffix(".csv")
    df = _parquet(spark, base + ".parquet")
    df = _csv(spark, base + ".csv", K.CANDIDATES) if df is None else df
    return K.select_contract(df, K.CANDIDATES)


def to_predictions(record: DataFrame, prob_col: str = "score_max", mode: str = "lazy") -> DataFrame:
    """Prediction columns from a candidate record; ``candidate_id`` keeps the rows aligned.
    The probability must lie in [0, 1)."""
    d = record.withColumn("probability", F.col(prob_col).cast("double"))
    schema = T.StructType([K.CANDIDATES["candidate_id"], *K.PREDICTIONS.fields])
    return validate(d, schema, mode)


def write_predictions(pred: DataFrame, path: str, mode: str = "lazy") -> None:
    validate(pred, K.PREDICTIONS, mode).write.mode("overwrite").csv(path, header=True)


def fan_out_predictions(record: DataFrame, split: str, path: str, prob_col: str = "score_max") -> None:
    """Train: one folder. Other splits: one folder per detector, in one job."""
    pool = record.where(F.col("split") == split)
    pred = to_predictions(pool.select("*"), prob_col)
    if split == "train":
        pred.drop("candidate_id").write.mode("overwrite").csv(path, header=True)
        return
    detector = F.substring_index("candidate_id", ":", 1)
    (pred.withColumn("detector_of_origin", detector).drop("candidate_id")
     .write.mode("overwrite").partitionBy("detector_of_origin").csv(path, header=True))


# ---------------------------------------------------------------- case discovery
def list_files(spark: SparkSession, root: str, pattern: str = "*.nrrd") -> DataFrame:
    """Recursive listing; file contents are never read because only path and length are selected."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern).load(root).select("path", "length"))


def pair_cases(files: DataFrame) -> DataFrame:
    """DATA and MASK files matched by case id: ``case_id, data, mask, n_data, n_mask, problem``.

    ``problem`` is NULL, 'duplicate' or 'unmatched'.
    """
    kind = F.upper(F.regexp_extract("path", r"(?i)(DATA|MASK)[^/]*$", 1))
    f = files.select("path", B.case_id_from_path(F.col("path")).alias("case_id"), kind.alias("kind"))
    side = lambda k, n: f.where(F.col("kind") == k).groupBy("case_id").agg(
        F.min("path").alias(n), F.count(F.lit(1)).alias("n_" + n))
    j = side("DATA", "data").join(side("MASK", "mask"), "case_id", "full_outer")
    problem = F.when((F.col("n_data") > 1) | (F.col("n_mask") > 1), "duplicate").when(
        F.col("data").isNull() | F.col("mask").isNull(), "unmatched")
    return j.select("case_id", "data", "mask", F.coalesce("n_data", F.lit(0)).alias("n_data"),
                    F.coalesce("n_mask", F.lit(0)).alias("n_mask"), problem.alias("problem"))


def discover_cases(spark: SparkSession, root: str) -> DataFrame:
    """``case_id, data, mask``; raises when a case is duplicated or has only one of its files."""
    cases = pair_cases(list_files(spark, root))
    bad = cases.where(F.col("problem").isNotNull()).first()
    if bad is not None:
        raise ValueError(f"case {bad['case_id']}: {bad['problem']} file")
    return cases.select("case_id", "data", "mask")
