"""Table contracts. Column order is part of the contract."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"l": T.LongType(), "d": T.DoubleType(), "s": T.StringType(), "b": T.BooleanType()}
    fields = (item.split(":") for item in spec.split())
    return T.StructType([T.StructField(n, kinds[k], True) for n, k in fields])


# --- fixed values -----------------------------------------------------------
DETECTIONS = _struct("det_id:l volume_id:l slice_z:l x1:d y1:d x2:d y2:d score:d")
SLICE_BOXES = _struct("volume_id:l slice_z:l r0:l c0:l r1:l c1:l component_id:l")
GT_BOXES = _struct("public_id:l coordX:d coordY:d coordZ:d x_length:d y_length:d z_length:d")
PREDICTIONS = _struct("public_id:l coordX:d coordY:d coordZ:d x_length:d y_length:d z_length:d "
                      "probability:d")
MANIFEST = _struct("volume_id:l split:s fold:l label:s manifest_hash:s")
CASE_LABELS = _struct("case_id:l label:s data_path:s mask_path:s")
CANDIDATES = _struct(
    "public_id:l candidate_id:s detector_of_origin:s split:s fold:l "
    "coordX:d coordY:d coordZ:d x_length:d y_length:d z_length:d "
    "score_max:d score_mean:d score_std:d score_min:d slice_count:l z_span:l fill_ratio:d "
    "centroid_jitter:d area_cv:d rank:l rank_norm:d label:s iou_gt:d "
    "cen_d0:d cen_d1:d cen_d2:d ext_d0:d ext_d1:d ext_d2:d preprocess_hash:s")
EPOCH_LOG = T.StructType([
    T.StructField("epoch", T.LongType()),
    T.StructField("val_ap_2d", T.DoubleType()),
    T.StructField("val_froc_recall", T.MapType(T.StringType(), T.DoubleType())),
])
META = T.StructType([
    T.StructField("volume_id", T.LongType()),
    T.StructField("native_shape", T.ArrayType(T.LongType())),
    T.StructField("iso_shape", T.ArrayType(T.LongType())),
    T.StructField("spacing_storage_mm", T.ArrayType(T.DoubleType())),
    T.StructField("iso_spacing_mm", T.DoubleType()),
    T.StructField("zoom_factors", T.ArrayType(T.DoubleType())),
    T.StructField("inverse_affine", T.StructType([
        T.StructField("formula", T.StringType()),
        T.StructField("f", T.ArrayType(T.DoubleType())),
    ])),
])
# names under which the ground truth is shipped -> contract names
GT_SHIPPED_NAMES = {
    "id": "public_id", "c_x": "coordX", "c_y": "coordY", "c_z": "coordZ",
    "len_x": "x_length", "len_y": "y_length", "len_z": "z_length",
}
# --- end of fixed values ----------------------------------------------------


def select_contract(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to the contract's columns and types; name the missing ones if any."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema])


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
