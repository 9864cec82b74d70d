"""Candidate generation: detections -> tubes -> features -> floor -> 3-D NMS -> ids -> ranks."""
from __future__ import annotations

from typing import Optional

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tubelens import config as C
from tubelens import schemas as K
from tubelens.config import LinkConfig
from tubelens.functions import boxes as B
from tubelens.operators import graph as GR
from tubelens.operators import greedy as G
from tubelens.operators import link as L
from tubelens.operators import match as M
from tubelens.operators import ranking as R
from tubelens.operators import spatial as S
from tubelens.sources.contracts import fingerprint, guard_split

PREPROCESS = {"iso_spacing_mm": C.ISO_SPACING_MM, "spacing_storage_mm": list(C.SPACING_MM)}


def detectors(spark: SparkSession, folds: int = C.FOLDS, seeds=C.FULL_SEEDS) -> DataFrame:
    """Detector dimension: one per fold (scores its own fold) and one per full seed."""
    rows = [(f"fold{f}", "train", f) for f in range(folds)] + \
           [(f"full_seed{s}", split, -1) for s in seeds for split in ("val", "test")]
    return spark.createDataFrame(rows, "detector_of_origin string, split string, fold long")


def route(manifest: DataFrame, detectors: DataFrame, split: str, allow_test: bool = False) -> DataFrame:
    """Which detector scores which volume: fold-f volumes by detector f, other splits by every seed."""
    guard_split(split, allow_test)
    m = manifest.where(F.col("split") == split).select("volume_id", "split", "fold")
    return m.join(detectors, ["split", "fold"]).select("volume_id", "detector_of_origin", "split", "fold")


def train_volumes(manifest: DataFrame, regime: str, k: Optional[int] = None) -> DataFrame:
    """Volumes a detector may learn from: all of train, or train without fold ``k``."""
    t = manifest.where(F.col("split") == "train")
    if regime == "fold":
        t = t.where(F.col("fold") != k)
    elif regime != "full":
        raise ValueError(f"unknown regime {regime!r}")
    return t.select("volume_id")


def stack(*pools: DataFrame) -> DataFrame:
    out = pools[0]
    for p in pools[1:]:
        out = out.unionByName(p)
    return out


def emission_order() -> list[Column]:
    """Volumes ascending, then tubes in the order their seeds were taken."""
    return [F.col("public_id").asc(), F.col("seed_order").asc()]


def tube_pool(det: DataFrame, meta: DataFrame, cfg: LinkConfig, by=("volume_id",), limit: int = L.LINK_LIMIT) -> DataFrame:
    """Linked tubes with features and official boxes above the score floor (before NMS)."""
    if cfg.op_score > 0:
        det = B.filter_by_score(det, cfg.op_score)
    f = L.tube_features(L.link_tubes(det, cfg, by, limit), meta, by)
    if cfg.score_floor > 0:
        f = f.where(F.col("score_max") >= cfg.score_floor)
    return f.withColumnRenamed("volume_id", "public_id")


def generate_candidates(det: DataFrame, gt: DataFrame, meta: DataFrame, routing: DataFrame,
                        cfg: Optional[LinkConfig] = None, limit: int = L.LINK_LIMIT) -> DataFrame:
    """The full candidate record.

    ``det`` carries ``detector_of_origin``; ``routing`` (from ``route``) keeps the rows each
    detector is responsible for. Ids run across a detector's volumes; ranks are per detector
    and volume. ``cand_seq`` (the number inside the id) is kept for tie-breaks.
    """
    cfg = cfg or LinkConfig(op_score=C.OP_SCORE)
    by = ["detector_of_origin", "volume_id"]
    d = det.join(routing.select(*by), by, "left_semi")
    pool = tube_pool(d, meta, cfg, by, limit)
    keys = ["detector_of_origin", "public_id"]
    # the first numbering fixes the emission order and materializes the pool
    pool = R.number_candidates(pool, emission_order())
    if cfg.nms_iou is not None:
        kept = G.nms_3d(pool, cfg.nms_iou, "tube_id", keys)
        pool = R.number_candidates(kept.drop("cand_seq"), emission_order())
    pool = R.rank_candidates(pool, keys)
    pool = M.best_iou_per_row(pool, ["detector_of_origin", "tube_id"], gt)
    info = routing.select("detector_of_origin", F.col("volume_id").alias("public_id"), "split", "fold")
    out = pool.join(info, keys).withColumns({
        "candidate_id": B.candidate_id(F.col("detector_of_origin"), F.col("public_id"), F.col("cand_seq")),
        "label": B.iou_label(F.col("iou_gt")), "preprocess_hash": F.lit(fingerprint(PREPROCESS))})
    return out.select(*[F.col(f.name).cast(f.dataType) for f in K.CANDIDATES], "cand_seq", "tube_id")


def candidate_frame(pool: DataFrame, gt: DataFrame, gt_iso: DataFrame) -> DataFrame:
    """Diagnostics per tube: IoU in official and in resampled space, what the mapping loses, hit flag.

    ``pool`` is ``tube_pool`` output; ``gt_iso`` has ``volume_id`` and a storage box per volume.
    """
    off = M.best_iou_per_row(pool, "tube_id", gt).withColumnRenamed("iou_gt", "official_iou")
    box = [*B.CENTRE, *B.EXTENT]
    iso = pool.select("public_id", "tube_id", *[c.alias(n) for n, c in B.storage_to_official().items()])
    g = gt_iso.select(F.col("volume_id").alias("public_id"), *[c.alias(n) for n, c in B.storage_to_official().items()])
    iso = M.best_iou_per_row(iso, "tube_id", g).select("public_id", "tube_id", F.col("iou_gt").alias("iso_iou"))
    out = off.join(iso, ["public_id", "tube_id"])
    return out.select(
        "public_id", "tube_id", "score_max", "score_mean", "score_std", "score_min", "slice_count", "z_span", "fill_ratio",
        "centroid_jitter", "area_cv", *B.CENTRE, *[F.col(e).alias(f"ext_{e[0]}") for e in B.EXTENT],
        B.diag_3d().alias("box_diag"), "official_iou", "iso_iou", (F.col("iso_iou") - F.col("official_iou")).alias("recon_loss"),
        (F.col("official_iou") > C.HIT_IOU).alias("is_tp"),
        *[f"cen_d{i}" for i in range(3)], *[f"ext_d{i}" for i in range(3)])


def gt_consistency(gt_slices: DataFrame, gt: DataFrame, meta: DataFrame) -> DataFrame:
    """Per volume: IoU between its official box and the hull of its slice boxes mapped back."""
    hull = B.to_half_open(gt_slices).groupBy("volume_id").agg(*[c.alias(n) for n, c in B.hull_to_iso().items()])
    rec = L.official_boxes(hull, meta).select(F.col("volume_id").alias("public_id"), F.col("volume_id").alias("row"), *B.CENTRE, *B.EXTENT)
    return M.best_iou_per_row(rec, "row", gt).select("public_id", F.col("iou_gt").alias("recon_iou"))


def build_manifest(cases: DataFrame, labels: DataFrame, k: int = C.FOLDS, seed: int = C.FOLD_SEED) -> DataFrame:
    """``cases`` (volume_id, split) with labels and folds; fold is -1 outside train. The split name is
    canonical, and a case without a label raises."""
    c = cases.select("volume_id", B.canonical_split(F.col("split")).alias("split"))
    j = c.join(labels.select(F.col("case_id").alias("volume_id"), "label"), "volume_id", "left")
    j = j.withColumn("label", F.coalesce("label", F.raise_error(F.concat(F.lit("no label: "), F.col("volume_id"))).cast("string")))
    train = R.stratified_folds(j.where(F.col("split") == "train"), k, seed)
    rest = j.where(F.col("split") != "train").withColumn("fold", F.lit(-1).cast("long"))
    return train.unionByName(rest)


def enumerate_slices(meta: DataFrame, gt_slices: DataFrame) -> DataFrame:
    """Every ``volume_id, slice_z`` of each volume with ``is_lesion``."""
    last = F.col("iso_shape")[2] - 1
    z = meta.select("volume_id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("slice_z"))
    g = gt_slices.select("volume_id", "slice_z").distinct().withColumn("_g", F.lit(True))
    return z.join(g, ["volume_id", "slice_z"], "left").select("volume_id", "slice_z", F.coalesce("_g", F.lit(False)).alias("is_lesion"))


def neighbour_rows(rows: DataFrame, meta: DataFrame, cols, half: int = 1) -> DataFrame:
    """Each slice row beside the ``cols`` of slices z-half .. z+half, clamped to the volume's range."""
    n = meta.select("volume_id", (F.col("iso_shape")[2] - 1).alias("_last"))
    off = rows.select("volume_id", "slice_z").join(n, "volume_id").withColumn(
        "offset", F.explode(F.sequence(F.lit(-half), F.lit(half))))
    off = off.withColumn("source_z", F.greatest(F.lit(0), F.least(F.col("_last"), F.col("slice_z") + F.col("offset"))).cast("long"))
    src = rows.select("volume_id", F.col("slice_z").alias("source_z"), *cols)
    return off.join(src, ["volume_id", "source_z"], "left").select("volume_id", "slice_z", "offset", "source_z", *cols)


# ---------------------------------------------------------------- anchors
def adaptive_assign(gt: DataFrame, anchors: DataFrame, topk: int = C.ASSIGN_TOPK) -> DataFrame:
    """``image, anchor_id, gt_id, iou``: the anchors assigned to each box.

    Per box and level the ``topk`` nearest anchors compete; those with IoU >= mean + std of the
    competitors and their centre inside the box are assigned, an anchor to its best box (first
    on ties). IoUs are compared with mean + std as whole multiples of 1e-9: exactly, so that equal competitors, whose std is 0, all reach it.
    """
    mid = {"cx": (F.col("x1") + F.col("x2")) / 2.0, "cy": (F.col("y1") + F.col("y2")) / 2.0}
    levels = anchors.select("image", "level").distinct()
    asked = gt.withColumns(mid).join(levels, "image")
    near = GR.nearest_rows(asked, anchors.withColumns(mid), ["image", "level"], ["gt_id"], ["anchor_id"], topk)
    a = S.prefixed(anchors.select("image", "anchor_id", *B.XYXY), "a_", ["image", "anchor_id"])
    g = S.prefixed(gt.select("image", "gt_id", *B.XYXY), "b_", ["image", "gt_id"])
    ax, ay = (F.col("a_x1") + F.col("a_x2")) / 2.0, (F.col("a_y1") + F.col("a_y2")) / 2.0
    inside = ax.between(F.col("b_x1"), F.col("b_x2")) & ay.between(F.col("b_y1"), F.col("b_y2"))
    per_gt = Window.partitionBy("image", "gt_id")  # topk rows per level
    cand = near.join(a, ["image", "anchor_id"]).join(g, ["image", "gt_id"]).select(
        "image", "gt_id", "anchor_id", B.iou_2d().alias("iou"), inside.alias("_in"))
    cand = cand.withColumn("_x", F.round(F.col("iou") * 1e9).cast("decimal(19,0)"))
    n, s, q = F.count(F.lit(1)).over(per_gt).cast("decimal(9,0)"), F.sum("_x").over(per_gt), F.sum(F.col("_x") * F.col("_x")).over(per_gt)
    # x >= mean + std: n * x - sum >= 0 and (n * x - sum)^2 >= n * (sum of squares) - sum^2
    cand = cand.withColumns({"_d": (n * F.col("_x") - s).cast("decimal(19,0)"), "_v": n * q.cast("decimal(28,0)") - s.cast("decimal(19,0)") * s.cast("decimal(19,0)")})
    pos = cand.where((F.col("_d") >= 0) & (F.col("_d") * F.col("_d") >= F.col("_v")) & F.col("_in"))
    best = pos.groupBy("image", "anchor_id").agg(F.max(F.struct("iou", (-F.col("gt_id")).alias("g"))).alias("m"))
    return best.select("image", "anchor_id", (-F.col("m.g")).cast("long").alias("gt_id"), F.col("m.iou").alias("iou"))


def anchor_coverage(gt: DataFrame, anchors: DataFrame, iou: float = 0.4) -> DataFrame:
    """Per box: anchors of its image with IoU >= ``iou`` (0 kept), its diagonal and size bucket."""
    a = anchors.select("image", "anchor_id", *B.XYXY)
    hit = S.slice_pairs(a, gt.select("image", "gt_id", *B.XYXY), ["image"]).where(F.col("iou") >= iou)
    n = hit.groupBy("image", F.col("b_gt_id").alias("gt_id")).agg(F.count(F.lit(1)).alias("_n"))
    d = B.measures_2d()["diag"]
    return gt.join(n, ["image", "gt_id"], "left").select(
        "image", "gt_id", d.alias("diag"), B.size_bucket(d).alias("bucket"), F.coalesce("_n", F.lit(0)).alias("n_anchors"))


def coverage_summary(cov: DataFrame, max_zero: float = 0.05) -> DataFrame:
    """Per size bucket: boxes, share without anchors, most frequent count (smallest on ties), median,
    and whether the share without anchors is acceptable."""
    per = cov.groupBy("bucket", "n_anchors").agg(F.count(F.lit(1)).alias("k"))
    med = cov.groupBy("bucket").agg(F.percentile("n_anchors", F.lit(0.5)).alias("median"))  # integers
    s = per.groupBy("bucket").agg(
        F.sum("k").alias("n"), (F.sum(F.when(F.col("n_anchors") == 0, F.col("k")).otherwise(0)) / F.sum("k")).alias("frac_zero"),
        (-F.max(F.struct("k", (-F.col("n_anchors")).alias("m")))["m"]).alias("mode"))
    return s.join(med, "bucket").withColumn("ok", F.col("frac_zero") <= max_zero)
