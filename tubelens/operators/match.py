"""Matching detections and predictions against ground truth, and the recalls built on it."""
from __future__ import annotations

from typing import Optional

from pyspark.sql import Column, DataFrame, Window, functions as F

from tubelens import config as C
from tubelens.functions import boxes as B
from tubelens.operators import prefix as P
from tubelens.operators import spatial as S
from tubelens.session import materialize

SLICE = ["volume_id", "slice_z"]
GT_KEY = SLICE + ["component_id"]


def slice_hits(det: DataFrame, gt: DataFrame) -> DataFrame:
    """Overlapping (detection, slice ground truth) pairs with ``iou``; gt is inclusive."""
    d = det.select(*SLICE, "det_id", *B.XYXY, "score")
    g = B.to_half_open(gt).select(*GT_KEY, *B.XYXY)
    return (S.slice_pairs(d, g)
            .select(*SLICE, F.col("b_component_id").alias("component_id"),
                    F.col("a_det_id").alias("det_id"), F.col("a_score").alias("score"), "iou"))


def match_gt(det: DataFrame, gt: DataFrame, score_thresh: float = C.DIAG_SCORE) -> DataFrame:
    """Per ground-truth box: its diagonal and the best IoU of a detection on its slice (0 if none)."""
    best = slice_hits(B.filter_by_score(det, score_thresh), gt).groupBy(*GT_KEY).agg(F.max("iou").alias("best_iou"))
    g = B.to_half_open(gt).select(*GT_KEY, B.measures_2d()["diag"].alias("diag"))
    return g.join(best, GT_KEY, "left").select(*GT_KEY, "diag", F.coalesce("best_iou", F.lit(0.0)).alias("best_iou"))


def fired_slices(det: DataFrame, gt: DataFrame, score_thresh: float = C.DIAG_SCORE) -> DataFrame:
    """Every ground-truth slice with a flag: does it carry any detection."""
    seen = B.filter_by_score(det, score_thresh).select(*SLICE).distinct().withColumn("_f", F.lit(1))
    return gt.select(*SLICE).distinct().join(seen, SLICE, "left").select(
        *SLICE, F.coalesce("_f", F.lit(0)).cast("long").alias("fired"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def fire_rate(det: DataFrame, gt: DataFrame, score_thresh: float = C.DIAG_SCORE) -> DataFrame:
    n = F.count(F.lit(1))
    fired = F.coalesce(F.sum("fired"), F.lit(0)).cast("long")
    return fired_slices(det, gt, score_thresh).agg(
        fired.alias("fired"), n.alias("lesion_slices"), _ratio(fired, n).alias("rate"))


def gt_recall(matches: DataFrame, iou: float = C.HIT_IOU) -> DataFrame:
    hits, n = F.count_if(F.col("best_iou") > iou), F.count(F.lit(1))
    return matches.agg(hits.alias("hits"), n.alias("total"), _ratio(hits, n).alias("recall"))


def recall_breakdown(matches: DataFrame, fired: DataFrame, ious=C.IOU_SWEEP, edges=C.SIZE_EDGES) -> DataFrame:
    """Long table ``section, label, n, hits, recall``: IoU sweep, size buckets, fire rate.

    One aggregate over the match table; every bucket is present, empty ones with NULL recall.
    """
    buckets = [B.bucket_name(lo, hi) for lo, hi in zip(edges[:-1], edges[1:])]
    hit = F.col("best_iou") > ious[-1]
    agg = matches.withColumn("_b", B.size_bucket(F.col("diag"), edges)).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("best_iou") > t).alias(f"i{k}") for k, t in enumerate(ious)],
        *[F.count_if(F.col("_b") == b).alias(f"n{k}") for k, b in enumerate(buckets)],
        *[F.count_if((F.col("_b") == b) & hit).alias(f"h{k}") for k, b in enumerate(buckets)])
    rows = [F.struct(F.lit("iou").alias("section"), F.lit(str(t)).alias("label"), F.col("n").alias("n"),
                     F.col(f"i{k}").alias("hits")) for k, t in enumerate(ious)]
    rows += [F.struct(F.lit("size").alias("section"), F.lit(b).alias("label"), F.col(f"n{k}").alias("n"),
                      F.col(f"h{k}").alias("hits")) for k, b in enumerate(buckets)]
    body = agg.select(F.inline(F.array(*rows)))
    rate = fired.agg(F.lit("fire").alias("section"), F.lit("slices").alias("label"),
                     F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("fired"), F.lit(0)).cast("long").alias("hits"))
    return body.unionByName(rate).withColumn("recall", _ratio(F.col("hits"), F.col("n")))


def hit_slice_counts(matches: DataFrame, volumes: DataFrame, iou: float = C.HIT_IOU) -> DataFrame:
    """Distinct hit slices of each volume; volumes without any are kept with 0."""
    per_slice = matches.groupBy(*SLICE).agg(F.max((F.col("best_iou") > iou).cast("long")).alias("_h"))
    n = per_slice.groupBy("volume_id").agg(F.sum("_h").alias("_n"))
    return volumes.select("volume_id").join(n, "volume_id", "left").select(
        "volume_id", F.coalesce("_n", F.lit(0)).cast("long").alias("hit_slices"))


def per_volume_recall(hit_counts: DataFrame) -> DataFrame:
    hit, n = F.count_if(F.col("hit_slices") > 0), F.count(F.lit(1))
    return hit_counts.agg(hit.alias("vols_with_hit"), n.alias("n_vols"), _ratio(hit, n).alias("recall"))


def missed_volumes(matches: DataFrame, fired: DataFrame, iou: float = C.HIT_IOU) -> DataFrame:
    """Volumes whose best IoU stays at or below ``iou``: box count, size, best IoU, fired share."""
    m = matches.groupBy("volume_id").agg(
        F.count(F.lit(1)).alias("n_gt_boxes"), F.max("diag").alias("max_gt_diag"),
        F.max("best_iou").alias("best_iou")).where(F.col("best_iou") <= iou)
    f = fired.groupBy("volume_id").agg(F.avg("fired").alias("fired_frac"))
    return m.join(f, "volume_id")


def recall_at_least(matches: DataFrame, iou: float = C.HIT_IOU) -> DataFrame:
    """Share of boxes and of volumes matched at IoU >= ``iou`` (not strict); NULL without boxes."""
    per = matches.groupBy("volume_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("best_iou") >= iou).alias("_h"))
    n, h, v = F.sum("_n"), F.sum("_h"), F.count(F.lit(1))
    return per.agg(_ratio(h, n).alias("per_slice_recall"),
                   _ratio(F.count_if(F.col("_h") > 0), v).alias("per_volume_recall"))


def detector_coverage(det: DataFrame, gt: DataFrame, iou: float = 0.1) -> DataFrame:
    """Per volume: ground-truth slices, how many have a raw box at IoU >= ``iou``, best IoU."""
    best = slice_hits(det, gt).groupBy(*SLICE).agg(F.max("iou").alias("iou"))
    per = gt.select(*SLICE).distinct().join(best, SLICE, "left")
    return per.groupBy("volume_id").agg(
        F.count_if(F.col("iou") >= iou).alias("n_cov_slices"),
        F.coalesce(F.max("iou"), F.lit(0.0)).alias("best_2d_iou"), F.count(F.lit(1)).alias("n_gt_slices"))


def footprint_fire(det: DataFrame, gt_iso: DataFrame) -> DataFrame:
    """Detections that overlap the lesion's footprint within its slices, per volume."""
    g = gt_iso.select("volume_id", "min_d2", "max_d2", F.col("min_d1").cast("double").alias("x1"),
                      F.col("min_d0").cast("double").alias("y1"), (F.col("max_d1") + 1).cast("double").alias("x2"),
                      (F.col("max_d0") + 1).cast("double").alias("y2"))
    hit = (S.overlap_pairs(det.select("volume_id", "slice_z", *B.XYXY, "score"), g, ["volume_id"], S.AXES_2D, S.CELL_2D)
           .where(F.col("a_slice_z").between(F.col("b_min_d2"), F.col("b_max_d2"))
                  & S.boxes_meet(S.AXES_2D, strict=True)))
    per_slice = hit.groupBy("volume_id", "a_slice_z").agg(F.count(F.lit(1)).alias("_n"), F.max("a_score").alias("_s"))
    per = per_slice.groupBy("volume_id").agg(F.sum("_n").alias("n_fire"), F.count(F.lit(1)).alias("n_slices_fired"),
                                             F.max("_s").alias("max_score"))
    span = (F.col("max_d2") - F.col("min_d2") + 1).cast("long").alias("gt_n_slices")
    return gt_iso.select("volume_id", span).join(per, "volume_id", "left").select(
        "volume_id", F.coalesce("n_fire", F.lit(0)).cast("long").alias("n_fire"),
        F.coalesce("n_slices_fired", F.lit(0)).cast("long").alias("n_slices_fired"), "gt_n_slices",
        F.coalesce("max_score", F.lit(0.0)).alias("max_score"))


def annotate_slices(det: DataFrame, gt: DataFrame, k: int = 5) -> DataFrame:
    """Per detection: IoU to its slice's enclosing ground-truth box, whether it is the slice's
    best one, and whether it is among the slice's ``k`` highest scores.

    A slice has one enclosing box, so the IoU is a column of the join by slice. The best row and the k-th score are
    aggregates of the slice and come back by slice too: detections are shuffled once, and a slice with very many of them is
    never sorted in one task."""
    box = gt.groupBy(*SLICE).agg(F.min("r0").alias("r0"), F.min("c0").alias("c0"), F.max("r1").alias("r1"),
                                 F.max("c1").alias("c1"))
    gt_box = B.to_half_open(box).select(*SLICE, *[F.col(c).alias("b_" + c) for c in B.XYXY])
    d = det.select(*SLICE, "det_id", *[F.col(c).alias("a_" + c) for c in B.XYXY], "score")
    place = F.struct(F.col("score").isNull().alias("none"), (-F.col("score")).alias("s"), "det_id")
    out = d.join(gt_box, SLICE, "left").select(
        *SLICE, "det_id", "score", F.col("b_x1").isNotNull().alias("_has"), F.coalesce(B.iou_2d(), F.lit(0.0)).alias("iou"))
    best = out.where("_has").groupBy(*SLICE).agg(F.min(F.struct((-F.col("iou")).alias("o"), "det_id")).alias("_b"))
    last = cap_per_slice(d, k).groupBy(*SLICE).agg(F.max(place).alias("_last"))
    return out.join(best, SLICE, "left").join(last, SLICE, "left").select(
        *SLICE, "det_id", "iou", F.coalesce(F.col("_b.det_id") == F.col("det_id"), F.lit(False)).alias("is_best"),
        F.coalesce(place <= F.col("_last"), F.lit(False)).alias("in_top"))


def cap_per_slice(det: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest-scored detections of each slice (planned as a limit before the shuffle)."""
    w = Window.partitionBy(*SLICE).orderBy(F.col("score").desc(), F.col("det_id"))
    return det.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


# ---------------------------------------------------------------- one-to-one matching
def greedy_match(det: DataFrame, gt: DataFrame, iou: float = C.HIT_IOU) -> DataFrame:
    """``det_id, score, is_tp`` when, in score order, each detection takes its best free box.

    Taking turns by one common priority is the same as deferred acceptance: each detection asks
    for its best box, a box holds its best asker and refuses the worse ones, who ask for their
    next. All slices advance together and no slice is gathered.
    """
    ask = slice_hits(det, gt).where(F.col("iou") >= iou).withColumn(
        "_rank", F.struct((-F.col("score")).alias("s"), F.col("det_id").alias("i")))
    ask = materialize(ask)
    n = ask.count()
    while True:
        wish = ask.groupBy("det_id", "_rank").agg(
            F.min(F.struct((-F.col("iou")).alias("o"), "component_id", *SLICE)).alias("w"))
        held = materialize(wish.groupBy(*[F.col("w")[c].alias(c) for c in GT_KEY]).agg(F.min("_rank").alias("_held")))
        ask = materialize(ask.join(held, GT_KEY, "left").where(
            F.col("_held").isNull() | (F.col("_rank") <= F.col("_held"))).drop("_held"))
        left = ask.count()
        if left == n:
            break
        n = left
    won = held.select(F.col("_held.i").alias("det_id"), F.lit(1).cast("long").alias("_t"))
    return det.select("det_id", "score").join(won, "det_id", "left").select(
        "det_id", "score", F.coalesce("_t", F.lit(0)).cast("long").alias("is_tp"))


def ranked_counts(matched: DataFrame) -> DataFrame:
    """Cumulative TP / FP in score order, with range blocks left in place for further runs."""
    order = [F.col("score").desc(), F.col("det_id").asc()]
    blocks = P.range_blocks(matched, [], order)
    return P.running(blocks, [], order, {"tp_cum": ("sum", F.col("is_tp")),
                                         "fp_cum": ("sum", 1 - F.col("is_tp"))})


def average_precision(matched: DataFrame, gt: DataFrame) -> DataFrame:
    """All-point AP: the precision envelope summed at each true positive. Without ground truth
    it is 1 when there are no detections, else 0."""
    run = ranked_counts(matched).withColumn("prec", F.col("tp_cum") / (F.col("tp_cum") + F.col("fp_cum")))
    back = [F.col("score").asc(), F.col("det_id").desc()]
    env = P.running(run, [], back, {"env": ("max", F.col("prec"))}, reverse=True)
    got = env.agg(F.coalesce(F.sum(F.when(F.col("is_tp") == 1, F.col("env"))), F.lit(0.0)).alias("s"),
                  F.count(F.lit(1)).alias("n_det"))
    n_gt = gt.agg(F.count(F.lit(1)).alias("n_gt"))
    ap = F.when(F.col("n_gt") == 0, (F.col("n_det") == 0).cast("double")).otherwise(F.col("s") / F.col("n_gt"))
    return P.attach(got, n_gt).select("n_gt", "n_det", ap.alias("ap"))


def recall_at_budgets(matched: DataFrame, gt: DataFrame, n_slices: DataFrame, budgets=C.FP_BUDGETS) -> DataFrame:
    """Recall where cumulative FP still fits ``budget * slices``; ``budget, recall`` rows.

    ``n_slices`` is a one-row table with column ``n_slices``.
    """
    one = P.attach(gt.agg(F.count(F.lit(1)).alias("n_gt")), n_slices)
    got = P.attach(ranked_counts(matched), one).agg(
        F.max("n_gt").alias("n_gt"), F.count(F.lit(1)).alias("n_det"),
        *[F.max(F.when(F.col("fp_cum") <= b * F.col("n_slices"), F.col("tp_cum"))).alias(f"t{i}")
          for i, b in enumerate(budgets)])
    rows = F.array(*[F.struct(F.lit(float(b)).alias("budget"), F.col(f"t{i}").alias("tp"))
                     for i, b in enumerate(budgets)])
    return got.select("n_gt", "n_det", F.inline(rows)).select(
        "budget", F.when(F.coalesce("n_gt", F.lit(0)) == 0, (F.col("n_det") == 0).cast("double"))
        .otherwise(F.coalesce("tp", F.lit(0)) / F.col("n_gt")).alias("recall"))


# ---------------------------------------------------------------- 3-D
def match_predictions(pred: DataFrame, gt: DataFrame, by=()) -> DataFrame:
    """Per prediction that touches ground truth: best box and IoU (first box on ties).

    ``pred`` needs ``pred_id``; ``gt`` needs ``label_id``. Predictions that touch nothing give
    no row (their best IoU is 0). Columns of ``by`` that ``gt`` lacks group the predictions only.
    """
    join = ["public_id", *[c for c in by if c in gt.columns]]
    box = [*B.CENTRE, *B.EXTENT]
    p = S.volume_pairs(pred.select("public_id", *by, "pred_id", *box, "probability"),
                       gt.select(*join, "label_id", *box), join)
    keys = [F.col(c) if c in join else F.col("a_" + c).alias(c) for c in [*by, "public_id"]]
    best = p.groupBy(*keys, F.col("a_pred_id").alias("pred_id")).agg(
        F.max("a_probability").alias("probability"),
        F.max(F.struct("iou", (-F.col("b_label_id")).alias("l"))).alias("_m"))
    return best.select(*by, "public_id", "pred_id", "probability", (-F.col("_m.l")).cast("long").alias("hit_label"),
                       F.col("_m.iou").alias("max_iou"))


def best_iou_per_row(rows: DataFrame, row_id, gt: DataFrame, keys=("public_id",)) -> DataFrame:
    """Add ``iou_gt``: the best 3-D IoU of each row to a ground-truth box of its volume (0 if none).

    ``row_id`` names one column or a list of columns that identify a row within ``keys``.
    """
    ids = [row_id] if isinstance(row_id, str) else list(row_id)
    box = [*B.CENTRE, *B.EXTENT]
    p = S.volume_pairs(rows.select(*keys, *ids, *box), gt.select(*keys, *box), keys)
    best = p.groupBy(*keys, *[F.col("a_" + i).alias(i) for i in ids]).agg(F.max("iou").alias("iou_gt"))
    return rows.join(best, [*keys, *ids], "left").withColumn("iou_gt", F.coalesce("iou_gt", F.lit(0.0)))
