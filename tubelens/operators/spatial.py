"""Grid-cell equi-joins for boxes that overlap.

Both sides are expanded to the cells they touch, joined on (keys, cell), and a pair is
reported only in the cell that holds the low corner of its intersection. Each pair thus
appears once, without a distinct, and two boxes far apart never meet even when one key
holds most of the rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tubelens.functions import boxes as B

CELL_2D = 128.0   # slice-frame pixels
CELL_3D = 256.0   # native voxels

AXES_2D = [("x1", "x2"), ("y1", "y2")]
AXES_3D = [("lo_x", "hi_x"), ("lo_y", "hi_y"), ("lo_z", "hi_z")]


def with_corners(df: DataFrame) -> DataFrame:
    """Add ``lo_*``/``hi_*`` corners of an official box."""
    return df.withColumns({f"{side}_{ax}": lohi[i] for ax, lohi in zip("xyz", B.corners_3d())
                           for i, side in enumerate(("lo", "hi"))})


def _cell_name(i: int) -> str:
    return f"_cell{i}"


def cell_of(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size))


def explode_cells(df: DataFrame, axes, size: float) -> DataFrame:
    for i, (lo, hi) in enumerate(axes):
        df = df.withColumn(_cell_name(i), F.explode(F.sequence(cell_of(F.col(lo), size),
                                                               cell_of(F.greatest(lo, hi), size))))
    return df


def prefixed(df: DataFrame, prefix: str, keep) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def same_cell(axes, size: float, a: str = "a_", b: str = "b_") -> Column:
    """The pair's reference cell is the cell of this row."""
    cond = F.lit(True)
    for i, (lo, _) in enumerate(axes):
        cond = cond & (cell_of(F.greatest(F.col(a + lo), F.col(b + lo)), size) == F.col(_cell_name(i)))
    return cond


def boxes_meet(axes, strict: bool = False, a: str = "a_", b: str = "b_") -> Column:
    cond = F.lit(True)
    for lo, hi in axes:
        for p, q in ((a, b), (b, a)):
            cond = cond & ((F.col(p + lo) < F.col(q + hi)) if strict else (F.col(p + lo) <= F.col(q + hi)))
    return cond


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str], axes, size: float) -> DataFrame:
    """All pairs with equal ``keys`` whose (closed) boxes meet; columns ``keys, a_*, b_*``."""
    cells = [_cell_name(i) for i in range(len(axes))]
    a = prefixed(explode_cells(left, axes, size), "a_", keys + cells)
    b = prefixed(explode_cells(right, axes, size), "b_", keys + cells)
    return a.join(b, keys + cells).where(boxes_meet(axes) & same_cell(axes, size)).drop(*cells)


def _with_iou(pairs: DataFrame, axes) -> DataFrame:
    """IoU of pairs that overlap on every axis; sizes ``a__size`` / ``b__size`` were computed once per box."""
    inter = None
    for lo, hi in axes:
        side = F.least("a_" + hi, "b_" + hi) - F.greatest("a_" + lo, "b_" + lo)
        inter = side if inter is None else inter * side
    p = pairs.where(boxes_meet(axes, strict=True)).withColumn("_inter", inter)
    return p.withColumn("iou", F.col("_inter") / (F.col("a__size") + F.col("b__size") - F.col("_inter"))).drop(
        "_inter", "a__size", "b__size")


def slice_pairs(left: DataFrame, right: DataFrame, keys=("volume_id", "slice_z")) -> DataFrame:
    """Pairs of 2-D boxes with positive overlap on one slice, with ``iou``."""
    sized = [d.withColumn("_size", B.area_2d()) for d in (left, right)]
    return _with_iou(overlap_pairs(*sized, list(keys), AXES_2D, CELL_2D), AXES_2D)


def volume_pairs(left: DataFrame, right: DataFrame, keys=("public_id",)) -> DataFrame:
    """Pairs of official boxes with positive overlap in one volume, with ``iou``. Two axes are
    gridded; the slice axis is a residual."""
    size = F.col("x_length") * F.col("y_length") * F.col("z_length")
    sized = [with_corners(d.withColumn("_size", size)).drop(*B.CENTRE, *B.EXTENT) for d in (left, right)]
    return _with_iou(overlap_pairs(*sized, list(keys), AXES_3D[1:], CELL_3D), AXES_3D)
