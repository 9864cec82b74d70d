"""Box geometry as column expressions (no UDF).

A 2-D box is half-open ``x1, y1, x2, y2``. A 3-D official box is centre + extent
``coordX.. , x_length..``. A storage box is inclusive ``min_d0.. , max_d2``.
Prefixes let one row hold two boxes.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tubelens import config as C

XYXY = ("x1", "y1", "x2", "y2")
CENTRE = ("coordX", "coordY", "coordZ")
EXTENT = ("x_length", "y_length", "z_length")
STORAGE = ("min_d0", "min_d1", "min_d2", "max_d0", "max_d1", "max_d2")


def _c(prefix: str, name: str) -> Column:
    return F.col(prefix + name)


def half_even(c: Column) -> Column:
    return F.rint(c).cast("long")


# ---------------------------------------------------------------- overlap
def intersection_2d(a: str = "a_", b: str = "b_") -> Column:
    w = F.least(_c(a, "x2"), _c(b, "x2")) - F.greatest(_c(a, "x1"), _c(b, "x1"))
    h = F.least(_c(a, "y2"), _c(b, "y2")) - F.greatest(_c(a, "y1"), _c(b, "y1"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def area_2d(p: str = "") -> Column:
    return (_c(p, "x2") - _c(p, "x1")) * (_c(p, "y2") - _c(p, "y1"))


def iou_2d(a: str = "a_", b: str = "b_") -> Column:
    inter = intersection_2d(a, b)
    union = area_2d(a) + area_2d(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def corners_3d(p: str = "") -> list[tuple[Column, Column]]:
    """``(lo, hi)`` per official axis."""
    return [(_c(p, c) - _c(p, e) / 2.0, _c(p, c) + _c(p, e) / 2.0) for c, e in zip(CENTRE, EXTENT)]


def iou_3d(a: str = "a_", b: str = "b_") -> Column:
    """0 when any axis does not overlap, which also covers zero-extent boxes."""
    over = [F.least(ah, bh) - F.greatest(al, bl)
            for (al, ah), (bl, bh) in zip(corners_3d(a), corners_3d(b))]
    inter = over[0] * over[1] * over[2]
    va = _c(a, "x_length") * _c(a, "y_length") * _c(a, "z_length")
    vb = _c(b, "x_length") * _c(b, "y_length") * _c(b, "z_length")
    return F.when(F.least(*over) <= 0, F.lit(0.0)).otherwise(inter / (va + vb - inter))


def box_gap(a: str = "a_", b: str = "b_") -> Column:
    """Empty cells between two inclusive boxes ``r0,c0,r1,c1`` (0 when they touch)."""
    def sep(lo, hi):
        return F.greatest(F.lit(0), _c(a, lo) - _c(b, hi) - 1, _c(b, lo) - _c(a, hi) - 1)
    return F.hypot(sep("r0", "r1").cast("double"), sep("c0", "c1").cast("double"))


def iou_label(iou: Column) -> Column:
    return (F.when(iou > C.LABEL_POS_IOU, F.lit("pos"))
            .when(iou < C.LABEL_NEG_IOU, F.lit("neg")).otherwise(F.lit("ignore")))


# ---------------------------------------------------------------- frames
def to_half_open(df: DataFrame) -> DataFrame:
    """Inclusive ``r0,c0,r1,c1`` rows -> half-open boxes (x = column, y = row)."""
    drop = ("r0", "c0", "r1", "c1")
    return df.select(
        *[c for c in df.columns if c not in drop],
        F.col("c0").cast("double").alias("x1"), F.col("r0").cast("double").alias("y1"),
        (F.col("c1") + 1).cast("double").alias("x2"), (F.col("r1") + 1).cast("double").alias("y2"))


def storage_to_official(p: str = "") -> dict[str, Column]:
    """Axis order is reversed; the length is max - min, not a voxel count."""
    out: dict[str, Column] = {}
    for name, axis in zip(CENTRE, (2, 1, 0)):
        out[name] = ((_c(p, f"min_d{axis}") + _c(p, f"max_d{axis}")) / 2.0).cast("double")
    for name, axis in zip(EXTENT, (2, 1, 0)):
        out[name] = (_c(p, f"max_d{axis}") - _c(p, f"min_d{axis}")).cast("double")
    return out


def official_to_storage(p: str = "") -> dict[str, Column]:
    lohi = corners_3d(p)
    out = {f"min_d{axis}": half_even(lohi[2 - axis][0]) for axis in range(3)}
    out.update({f"max_d{axis}": half_even(lohi[2 - axis][1]) for axis in range(3)})
    return out


def iso_to_native(zoom: Column, p: str = "") -> dict[str, Column]:
    """Storage box in resampled voxels -> native voxels, half-even rounding."""
    return {n: half_even((_c(p, n) + 0.5) / zoom[int(n[-1])] - 0.5) for n in STORAGE}


def hull_to_iso(least=F.min, most=F.max) -> dict[str, Column]:
    """Boxes of one tube -> one inclusive storage box, as aggregates or from columns that hold their least and greatest values."""
    return {
        "min_d0": half_even(least("y1")), "min_d1": half_even(least("x1")),
        "min_d2": least("slice_z").cast("long"),
        "max_d0": half_even(most("y2")) - 1, "max_d1": half_even(most("x2")) - 1,
        "max_d2": most("slice_z").cast("long"),
    }


def zoom_factors(iso: float = C.ISO_SPACING_MM) -> Column:
    return F.array(*[F.lit(s / iso) for s in C.SPACING_MM])


def iso_shape(native_shape: Column, zoom: Column) -> Column:
    return F.array(*[half_even(native_shape[i] * zoom[i]) for i in range(3)])


# ---------------------------------------------------------------- measures
def measures_2d(p: str = "") -> dict[str, Column]:
    w, h = _c(p, "x2") - _c(p, "x1"), _c(p, "y2") - _c(p, "y1")
    return {
        "cx": (_c(p, "x1") + _c(p, "x2")) / 2.0, "cy": (_c(p, "y1") + _c(p, "y2")) / 2.0,
        "w": w, "h": h, "area": w * h, "diag": F.sqrt(w * w + h * h), "aspect": h / w,
    }


def diag_3d(p: str = "") -> Column:
    x, y, z = (_c(p, e) for e in EXTENT)
    return F.sqrt(x * x + y * y + z * z)


def anisotropy(p: str = "") -> Column:
    """Depth extent over the mean of the other two; NULL when that mean is 0."""
    denom = (_c(p, "ext_d1") + _c(p, "ext_d2")) / 2.0
    return F.when(denom > 0, _c(p, "ext_d0") / denom)


def clamp_prob(score: Column) -> Column:
    return F.least(score, F.lit(C.PROB_CLAMP))


def size_bucket(value: Column, edges=C.SIZE_EDGES) -> Column:
    """Label ``[lo,hi)`` of the bin holding ``value``; the last edge may be None."""
    out = None
    for lo, hi in zip(edges[:-1], edges[1:]):
        inside = value >= lo if hi is None else (value >= lo) & (value < hi)
        out = F.when(inside, bucket_name(lo, hi)) if out is None else out.when(inside, bucket_name(lo, hi))
    return out


def bucket_name(lo, hi) -> str:
    return f"[{int(lo)},{'inf' if hi is None else int(hi)})"


def round_up(x: Column, m: int) -> Column:
    return (F.ceil(x / F.lit(float(m))) * m).cast("long")


def snap_to_grid(value: Column, grid) -> Column:
    """Nearest grid entry, the smaller one on ties."""
    g = F.array(*[F.lit(float(v)) for v in grid])
    return F.array_min(F.transform(g, lambda e: F.struct(F.abs(value - e).alias("d"), e.alias("g"))))["g"]


def canonical_split(name: Column) -> Column:
    known = F.create_map(*[F.lit(v) for kv in C.SPLIT_NAMES.items() for v in kv])
    return F.coalesce(known[name], F.raise_error(F.concat(F.lit("unknown split: "), name)).cast("string"))


def candidate_id(detector: Column, volume: Column, index: Column) -> Column:
    return F.concat_ws(":", detector, volume.cast("string"), index.cast("string"))


def case_id_from_path(path: Column) -> Column:
    return F.regexp_extract(path, r"_(\d+)\.nrrd$", 1).cast("long")


def run_name_fold(name: Column) -> Column:
    """``fold3`` -> 3; anything else -> -1."""
    digits = F.regexp_extract(name, r"^fold(\d+)$", 1)
    return F.when(digits != "", digits.cast("long")).otherwise(F.lit(-1).cast("long"))


# ---------------------------------------------------------------- box transforms
def _clip_and_drop(df: DataFrame, new: dict[str, Column], width, height, clip: bool) -> DataFrame:
    if clip:
        for n, hi in (("x1", width), ("x2", width), ("y1", height), ("y2", height)):
            new[n] = F.least(F.greatest(new[n], F.lit(0.0)), F.lit(float(hi)))
    out = df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])
    return out.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def hflip_boxes(df: DataFrame, width: float) -> DataFrame:
    return df.withColumns({"x1": width - F.col("x2"), "x2": width - F.col("x1")})


def shift_boxes(df: DataFrame, dy: float, dx: float, height: float, width: float, clip: bool = True) -> DataFrame:
    new = {"x1": F.col("x1") + dx, "x2": F.col("x2") + dx, "y1": F.col("y1") + dy, "y2": F.col("y2") + dy}
    return _clip_and_drop(df, new, width, height, clip)


def scale_boxes(df: DataFrame, s: float, height: float, width: float, clip: bool = True) -> DataFrame:
    mid = {"x": width / 2.0, "y": height / 2.0}
    new = {n: mid[n[0]] + (F.col(n) - mid[n[0]]) * s for n in XYXY}
    return _clip_and_drop(df, new, width, height, clip)


def rotate_boxes(df: DataFrame, degrees: float, height: float, width: float, clip: bool = True) -> DataFrame:
    """Axis-aligned hull of the four rotated corners about the frame centre."""
    cx, cy, t = width / 2.0, height / 2.0, math.radians(degrees)
    corner = [(F.col(x) - cx, F.col(y) - cy) for x in ("x1", "x2") for y in ("y1", "y2")]
    xs = [math.cos(t) * u - math.sin(t) * v + cx for u, v in corner]
    ys = [math.sin(t) * u + math.cos(t) * v + cy for u, v in corner]
    new = {"x1": F.least(*xs), "x2": F.greatest(*xs), "y1": F.least(*ys), "y2": F.greatest(*ys)}
    return _clip_and_drop(df, new, width, height, clip)


def filter_by_score(df: DataFrame, threshold: float) -> DataFrame:
    return df.where(F.col("score") >= threshold)


def drop_degenerate(df: DataFrame) -> DataFrame:
    return df.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
