"""Greedy suppression: keep the best row, drop the rows it conflicts with, repeat.

Small groups run as an array rule, many per Python call. Larger groups are distributed:

1. tiles: rows go once to the few tiles, several boxes wide, that they touch, and a task runs the array rule there. A row inside one
   tile meets all its rivals there, so it is final unless a better rival is open; a row on a border is open, but can be removed.
   Tiles with more than TILE_LIMIT rows decide nothing. What is final leaves; the rest is a share of the rows, or lies in crowded places;
2. leader rounds: a row that is the best of every grid cell it touches is final, since a better rival would share a
   cell with it. It removes what it conflicts with. A stack of any height collapses in one such round, at one
   comparison per row and cell. They go on while they remove a tenth of the rows;
3. the conflicts of what is left are listed once by the grid join and settled in rounds on that narrow list: every
   row without a better live rival is final, and its rivals go. The number of rounds is the depth of the
   longest chain of conflicts; it doesn't depend on the number of rows.

Cells are about as large as the boxes of the table, so neighbours are few.
"""
from __future__ import annotations

import math
from typing import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tubelens.operators import spatial as S
from tubelens.operators.grouped import per_group, split_by_size
from tubelens.operators.prefix import union_all
from tubelens.session import materialize, stored

GROUP_LIMIT = 20_000   # the grouped form compares a kept row with all rows left in its group
TILE_LIMIT = 20_000    # rows of a tile that are settled in one call
TILE = 16              # cells a side of a tile


class _Ops:
    """min / max / ratio for either columns or arrays, so a conflict rule is written once."""

    def __init__(self, mn, mx, ratio):
        self.mn, self.mx, self.ratio = mn, mx, ratio


def _array_ratio(a, b):
    """a / b where b > 0, else 0."""
    a, b = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(b, dtype=float))
    return np.divide(a, b, out=np.zeros(a.shape), where=b > 0)


_COLUMN = _Ops(lambda a, b: F.least(a, b if isinstance(b, Column) else F.lit(b)),
               lambda a, b: F.greatest(a, b if isinstance(b, Column) else F.lit(b)),
               lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0)))
_NUMPY = _Ops(np.minimum, np.maximum, _array_ratio)


def _inter(a, b, axes, ops):
    out = 1.0
    for lo, hi in axes:
        out = out * ops.mx(ops.mn(a(hi), b(hi)) - ops.mx(a(lo), b(lo)), 0.0)
    return out


def _size(a, axes):
    out = 1.0
    for lo, hi in axes:
        out = out * (a(hi) - a(lo))
    return out


# conflict rules: (kept row, other row, ops) -> condition
def contained_at(t: float):
    def rule(a, b, ops):
        return ops.ratio(_inter(a, b, S.AXES_2D, ops), _size(b, S.AXES_2D)) >= t
    return rule


def iou_2d_above(t: float):
    def rule(a, b, ops):
        i = _inter(a, b, S.AXES_2D, ops)
        return ops.ratio(i, _size(a, S.AXES_2D) + _size(b, S.AXES_2D) - i) > t
    return rule


def iou_3d_at(t: float):
    def rule(a, b, ops):
        i = _inter(a, b, S.AXES_3D, ops)
        return i / (_size(a, S.AXES_3D) + _size(b, S.AXES_3D) - i + 1e-12) >= t
    return rule


def centre_within(cols, r: float):
    def rule(a, b, ops):
        d2 = 0.0
        for c in cols:
            d2 = d2 + (a(c) - b(c)) * (a(c) - b(c))
        return d2 ** 0.5 <= r
    return rule


def _suppress_grouped(df: DataFrame, keys, prio, row_id, needed, rule) -> DataFrame:
    """Keys and ids kept, for groups of bounded size."""
    def keep(g):
        live = np.ones(len(g[row_id]), dtype=bool)
        col = {c: g[c].astype(float) for c in needed}
        for i in range(len(live)):
            if live[i]:
                rest = np.flatnonzero(live[i + 1:]) + i + 1
                hit = rule(lambda c: col[c][i], lambda c: col[c][rest], _NUMPY)
                live[rest[np.broadcast_to(hit, rest.shape)]] = False
        return live, None

    ranked = df.withColumn("_worse", -prio)
    return per_group(ranked, keys, ["_worse", row_id], [row_id, *needed], keep, [*keys, row_id])


def _cell_side(df: DataFrame, axes) -> tuple[float, list[float]]:
    """Cells that nine boxes in ten fit, and the least corner of the table."""
    side = F.greatest(*[F.col(hi) - F.col(lo) for lo, hi in axes]) if len(axes) > 1 else F.col(axes[0][1]) - F.col(axes[0][0])
    got = df.agg(F.percentile_approx(side, 0.9).alias("side"), *[F.min(lo).alias(f"o{i}") for i, (lo, _) in enumerate(axes)]).first()
    ok = lambda x: x is not None and math.isfinite(x)
    return (float(got["side"]) if ok(got["side"]) and got["side"] > 0 else 1.0,
            [float(got[f"o{i}"]) if ok(got[f"o{i}"]) else 0.0 for i in range(len(axes))])


def _settle_tiles(live: DataFrame, keys, needed, rule, axes, side: float, origin: list[float]) -> DataFrame:
    """``keys, _id, _state`` of rows that a tile decides: 1 kept, with all it removes, 2 removed. A row may come from several tiles."""
    tiles, inner = [f"_tile{i}" for i in range(len(axes))], F.lit(True)
    placed = live
    for t, (lo, hi), o in zip(tiles, axes, origin):
        first, last = (S.cell_of(c - F.lit(o), side) for c in (F.col(lo), F.greatest(lo, hi)))
        inner = inner & (first == last)
        placed = placed.withColumn(t, F.sequence(first, last))
    placed = placed.select(*keys, "_id", "_p", *needed, inner.alias("_inner"), *tiles)
    for t in tiles:
        placed = placed.withColumn(t, F.explode(t))

    def settle(g):
        n = len(g["_inner"])
        state, blocked, inside = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool), g["_inner"]
        col = {c: g[c].astype(float) for c in needed}
        for i in range(n):  # best first, so all that can remove or block a row came before it
            if state[i]:
                continue
            rest = np.flatnonzero(state[i + 1:] == 0) + i + 1
            hit = rest[np.broadcast_to(rule(lambda c: col[c][i], lambda c: col[c][rest], _NUMPY), rest.shape)]
            if inside[i] and not blocked[i]:
                state[i] = 1
                state[hit] = 2
            else:
                blocked[hit] = True
        return state > 0, state

    small, _ = split_by_size(placed, [*keys, *tiles], TILE_LIMIT)
    return per_group(small, [*keys, *tiles], ["_p", "_id"], ["_inner", *needed], settle, [*keys, "_id"], "_state")


def _suppress_rounds(df: DataFrame, keys, prio, row_id, needed, rule, axes) -> DataFrame:
    """Keys and ids that are removed, by distributed rounds."""
    one = [*keys, "_id"]
    cells = [f"_cell{i}" for i in range(len(axes))]
    cols = list(dict.fromkeys(needed + [c for ax in axes for c in ax]))
    rows = stored(df.select(*keys, F.col(row_id).alias("_id"), (-prio).alias("_p"), *cols), "rows")
    cell, origin = _cell_side(rows, axes)
    done = stored(_settle_tiles(rows, keys, needed, rule, axes, cell * TILE, origin), "settled")
    at = lambda p: (lambda c: F.col(p + c))
    gone = [done.where("_state = 2").select(*one).distinct()]
    live = materialize(rows.join(done.select(*one), one, "left_anti").select(*keys, "_id", F.struct(F.col("_p").alias("p"), F.col("_id").alias("i")).alias("_rank"), *cols))
    n = live.count()
    while n:
        placed = S.explode_cells(live, axes, cell)
        best = placed.groupBy(*keys, *cells).agg(F.min("_rank").alias("_top"))
        led = placed.join(best, keys + cells)
        leads = led.groupBy(*one).agg(F.min((F.col("_rank") == F.col("_top")).cast("int")).alias("_all")).where("_all = 1").select(*one)
        leads = materialize(led.join(leads, one, "left_semi").drop("_top"))
        hit = materialize(S.prefixed(led.drop("_top"), "b_", keys + cells).join(S.prefixed(leads, "a_", keys + cells), keys + cells)
                          .where((F.col("a__rank") < F.col("b__rank")) & S.boxes_meet(axes) & rule(at("a_"), at("b_"), _COLUMN))
                          .select(*keys, F.col("b__id").alias("_id")).distinct())
        m = hit.count()
        gone.append(hit)
        live = materialize(live.join(hit.unionByName(leads.select(*one).distinct()), one, "left_anti"))
        if m < n / 10:
            break
        n = live.count()
    pairs = (S.overlap_pairs(live, live, keys, axes, cell)
             .where((F.col("a__rank") < F.col("b__rank")) & rule(at("a_"), at("b_"), _COLUMN))
             .select(*keys, F.col("a__id").alias("u"), F.col("b__id").alias("v")))
    pairs = materialize(pairs)
    while not pairs.isEmpty():
        u, v = pairs.select(*keys, F.col("u").alias("_id")), pairs.select(*keys, F.col("v").alias("_id"))
        final = u.distinct().join(v.distinct(), one, "left_anti").withColumnRenamed("_id", "u")
        lost = materialize(pairs.join(final, [*keys, "u"], "left_semi").select(*keys, F.col("v").alias("_id")).distinct())
        gone.append(lost)
        pairs = materialize(pairs.join(final, [*keys, "u"], "left_anti")
                            .join(lost.withColumnRenamed("_id", "u"), [*keys, "u"], "left_anti")
                            .join(lost.withColumnRenamed("_id", "v"), [*keys, "v"], "left_anti"))
        if len(gone) >= 20:
            gone = [materialize(union_all(gone))]
    return union_all(gone).withColumnRenamed("_id", row_id)


def suppress(df: DataFrame, keys: list[str], prio: Column, row_id: str, needed: list[str],
             rule: Callable, axes, limit: int = GROUP_LIMIT, all_conflict: bool = False) -> DataFrame:
    """Rows of ``df`` that survive greedy suppression within ``keys``.

    ``prio`` is higher-is-better; ties go to the smaller ``row_id`` (unique within a group). With ``all_conflict``
    any two rows of a group conflict, also boxes that don't meet: the best one stays.
    """
    if all_conflict:
        best = df.groupBy(*keys).agg(F.min(F.struct((-prio).alias("p"), F.col(row_id).alias("i"))).alias("_m"))
        return df.join(best.select(*keys, F.col("_m.i").alias(row_id)), [*keys, row_id], "left_semi")
    small, large = split_by_size(df, keys, limit)
    ids = _suppress_grouped(small, keys, prio, row_id, needed, rule)
    out = small.join(ids, [*keys, row_id], "left_semi").select(*df.columns)
    if large is not None:
        gone = _suppress_rounds(large, keys, prio, row_id, needed, rule, axes)
        out = out.unionByName(large.join(gone, [*keys, row_id], "left_anti").select(*df.columns))
    return out


_2D = ["x1", "y1", "x2", "y2"]
_3D = [c for ax in S.AXES_3D for c in ax]


def containment_suppress(det: DataFrame, t: float, keys=("volume_id", "slice_z"),
                         limit: int = GROUP_LIMIT) -> DataFrame:
    """Per slice, drop a box at least ``t`` inside a better kept box. ``t >= 1`` keeps all."""
    if t >= 1.0:
        return det
    return suppress(det, list(keys), F.col("score"), "det_id", _2D, contained_at(t),
                    S.AXES_2D, limit, all_conflict=t <= 0)


def nms_2d(det: DataFrame, t: float, keys=("volume_id", "slice_z"), limit: int = GROUP_LIMIT) -> DataFrame:
    """Per slice, drop a box whose IoU with a better kept box is above ``t``."""
    return suppress(det, list(keys), F.col("score"), "det_id", _2D, iou_2d_above(t),
                    S.AXES_2D, limit, all_conflict=t < 0)


def nms_3d(cands: DataFrame, t, row_id: str = "cand_seq", keys=("public_id",), score: str = "score_max",
           limit: int = GROUP_LIMIT) -> DataFrame:
    """Per volume, drop a box whose 3-D IoU with a better kept box is at least ``t``; None keeps all. The union has 1e-12 added, which
    decides where the IoU is ``t`` itself."""
    if t is None:
        return cands
    with_box = S.with_corners(stored(cands, "boxes"))
    out = suppress(with_box, list(keys), F.col(score), row_id, _3D, iou_3d_at(t), S.AXES_3D, limit, all_conflict=t <= 0)
    return out.select(*cands.columns)


def dedup_by_distance(cands: DataFrame, radius: float, key: str, row_id: str = "cand_seq",
                      cols=("cen_d0", "cen_d1", "cen_d2"), keys=("public_id",),
                      limit: int = GROUP_LIMIT) -> DataFrame:
    """Keep the row with the highest ``key`` of each neighbourhood of ``radius``; <= 0 keeps all."""
    if radius <= 0:
        return cands
    # a little more than half the radius, so that no pair at the radius is lost to rounding; the rule decides
    half = lambda c: F.lit(radius / 2.0 * (1 + 1e-9)) + F.abs(F.col(c)) * 1e-12
    spread = stored(cands, "points").withColumns({f"_{s}{i}": F.col(c) + (half(c) if s == "hi" else -half(c))
                                for i, c in enumerate(cols) for s in ("lo", "hi")})
    axes = [(f"_lo{i}", f"_hi{i}") for i in range(len(cols))]
    out = suppress(spread, list(keys), F.col(key).cast("double"), row_id, list(cols),
                   centre_within(cols, radius), axes, limit)
    return out.select(*cands.columns)
