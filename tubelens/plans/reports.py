"""Diagnostics built from the operators: attribution, baselines, what-ifs, full reports."""
from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, functions as F

from tubelens import config as C
from tubelens.config import LinkConfig
from tubelens.functions import boxes as B
from tubelens.operators import graph as GR
from tubelens.operators import greedy as G
from tubelens.operators import link as L
from tubelens.operators import match as M
from tubelens.operators.prefix import attach, union_all
from tubelens.plans import candidates as CA
from tubelens.plans import froc as FR
from tubelens.plans import stats as ST
from tubelens.plans import sweeps as SW
from tubelens.session import materialize


def fp_structure(df: DataFrame, radius: float = C.CLUSTER_RADIUS) -> DataFrame:
    """Are false positives more elongated and more clustered than true ones? One row.

    ``df``: ``public_id, cand_seq, label, cen_*, ext_*``; pos and neg rows are compared.
    Neighbour distances are pooled over volumes, cluster counts are per volume.
    """
    d = materialize(df.where(F.col("label").isin("pos", "neg")).withColumn("anisotropy", B.anisotropy()))
    nn = GR.nearest_neighbour(d, ["label"])
    rows = materialize(d.select("label", "cand_seq", "anisotropy").join(nn, ["label", "cand_seq"], "left"))
    clusters = GR.cluster_redundancy(d, radius, ["label", "public_id"])
    qs = (25, 50, 75)
    pct = ST.percentile_summary(rows, ["anisotropy", "nn_dist"], ["label"], qs).drop("mean", "n")
    cl = clusters.groupBy("label").agg(F.percentile("n_clusters", F.array(*[F.lit(q / 100) for q in qs])).alias("p"))  # integers
    cl = cl.select(F.lit("clusters_per_vol").alias("metric"), "label", *[F.col("p")[i].alias(f"p{q}") for i, q in enumerate(qs)])
    cells = [(m, lab) for m in ("anisotropy", "nn_dist", "clusters_per_vol") for lab in ("neg", "pos")]
    short = {"neg": "fp", "pos": "tp"}
    wide = pct.unionByName(cl).agg(*[
        F.max(F.when((F.col("metric") == m) & (F.col("label") == lab), F.col(f"p{q}"))).alias(f"{short[lab]}_{m}_{n}")
        for m, lab in cells for q, n in ((50, "median"), (25, "q1"), (75, "q3"))])
    size = d.agg(*[F.count_if(F.col("label") == lab).alias(f"{short[lab]}_n") for lab in short])
    eff = [ST.cliffs_delta(rows.withColumn("_fp", F.col("label") == "neg"), m, "_fp").withColumnRenamed("delta", f"{m}_delta")
           for m in ("anisotropy", "nn_dist")]
    one = attach(attach(attach(wide, size), eff[0]), eff[1])
    longer = F.coalesce(F.col("fp_anisotropy_median") > F.col("tp_anisotropy_median"), F.lit(False))
    tighter = F.coalesce(F.col("fp_nn_dist_median") < F.col("tp_nn_dist_median"), F.lit(False))
    multi = F.coalesce(F.col("fp_clusters_per_vol_median") > 1, F.lit(False))
    return one.withColumns({
        "more_elongated": longer, "tighter_nn": tighter, "multi_cluster_per_vol": multi, "more_clustered": tighter & multi,
        "structure_present": longer & tighter & multi,
        "claim_scope": F.when(longer & tighter & multi, "relational").otherwise("set-level contextual calibration")})


def best_tube_iou(det, meta, gt, cfg: LinkConfig, limit: int = L.LINK_LIMIT) -> DataFrame:
    """Best official IoU of a volume's tubes; volumes without tubes are absent."""
    pool = M.best_iou_per_row(CA.tube_pool(det, meta, cfg, limit=limit), "tube_id", gt)
    return pool.groupBy("public_id").agg(F.max("iou_gt").alias("iou"))


def attribute_misses(det, meta, gt, gt_slices, cfg: LinkConfig, overlap_iou: float = 0.1, limit: int = L.LINK_LIMIT) -> DataFrame:
    """Per volume of ``meta``: is it hit, and if not, is the linker or the detector the cause?

    The configured linking is compared with a permissive one (no caps, no containment, two boxes
    are enough) and with the raw coverage of the lesion's slices.
    """
    cfg = cfg.but(score_floor=0.0)
    loose = cfg.but(min_tube_len=2, max_tube_zspan=None, max_centroid_drift=None, containment=1.0, label="permissive")
    pool = SW.sweep_pool(det, meta, gt, [cfg.but(label="frozen"), loose], limit)
    best = pool.groupBy("public_id").agg(
        *[F.max(F.when(F.col("config_id") == i, F.col("iou_gt"))).alias(n) for i, n in enumerate(("frozen_iou", "perm_iou"))])
    cov = M.detector_coverage(det, gt_slices, overlap_iou).withColumnRenamed("volume_id", "public_id")
    base = meta.select(F.col("volume_id").alias("public_id"))
    j = base.join(best, "public_id", "left").join(cov, "public_id", "left").na.fill(
        0, ["frozen_iou", "perm_iou", "best_2d_iou", "n_cov_slices", "n_gt_slices"])
    klass = (F.when(F.col("frozen_iou") > C.HIT_IOU, "HIT").when(F.col("perm_iou") > C.HIT_IOU, "LINKER-SUPPRESSED")
             .when(F.col("n_cov_slices") >= cfg.min_tube_len, "LINKER-LOST").when(F.col("perm_iou") >= C.GREY_IOU, "LINKER-LOST")
             .otherwise("DETECTOR-WALL"))
    return j.withColumn("klass", klass)


def miss_counts(attribution: DataFrame) -> DataFrame:
    """Volumes per class; all four classes are present."""
    n = attribution.groupBy().pivot("klass", ["HIT", "LINKER-SUPPRESSED", "LINKER-LOST", "DETECTOR-WALL"]).agg(F.count(F.lit(1)))
    names = n.columns
    return n.select(F.inline(F.array(*[F.struct(F.lit(c).alias("klass"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias("n"))
                                       for c in names])))


def volume_best(frame: DataFrame, volumes: DataFrame) -> DataFrame:
    """Per volume: candidates, hits, best official and resampled IoU."""
    per = frame.groupBy("public_id").agg(
        F.count(F.lit(1)).alias("n_cand"), F.count_if("is_tp").alias("n_tp"),
        F.max("official_iou").alias("best_official_iou"), F.max("iso_iou").alias("best_iso_iou"))
    return volumes.select(F.col("volume_id").alias("public_id")).join(per, "public_id", "left").na.fill(0)


def missed_verdict(frame: DataFrame, det: DataFrame, gt_iso: DataFrame, op_score: float = 0.0) -> DataFrame:
    """Why each volume without a hit was missed."""
    best = volume_best(frame, gt_iso).where(F.col("n_tp") == 0)
    fire = M.footprint_fire(B.filter_by_score(det, op_score), gt_iso).withColumnRenamed("volume_id", "public_id")
    hit = C.HIT_IOU
    verdict = (F.when((F.col("n_fire") == 0) & (F.col("max_score") < op_score + 1e-9), "DETECTOR-SILENT")
               .when((F.col("best_iso_iou") > hit) & (F.col("best_official_iou") <= hit), "RECONSTRUCTION-LOST")
               .when(F.col("best_iso_iou") <= hit, "LINKER/DETECTOR-LIMITED").otherwise("LINKER-SUPPRESSED"))
    return best.join(fire, "public_id").withColumn("verdict", verdict)


def baseline_ladder(gt: DataFrame, pred: DataFrame, detectors: DataFrame, n_boot: int = 0, seed: int = 0,
                    ci: float = 0.95) -> DataFrame:
    """CPM and ceiling of each detector's predictions (``pred`` carries ``detector_of_origin``), with a
    bootstrap interval ``lo, hi`` when ``n_boot`` is given."""
    by = ["detector_of_origin"]
    hist = materialize(FR.volume_histograms(gt, pred, by))
    bins = hist.groupBy(*by, "bin").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    out = FR.froc_summary(FR.curve_from_bins(bins, FR.group_sizes(gt, detectors), by), by=by).select(*by, "cpm", "ceiling")
    if not n_boot:
        return out
    a = (1.0 - ci) / 2.0
    boot = FR.bootstrap_values(gt, hist, n_boot, seed, by, detectors).groupBy(*by).agg(
        F.percentile("cpm", F.array(F.lit(a), F.lit(1.0 - a))).alias("_q"))  # n_boot values
    return out.join(boot, by).select(*out.columns, F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"))


def dedup_whatif(pool: DataFrame, gt: DataFrame, volumes: DataFrame, nms_ious=(0.1, 0.3, 0.5),
                 keys=("slice_count", "fill_ratio", "score_max"), radii=(5.0, 10.0)) -> DataFrame:
    """Pool size, recall, CPM and ceiling without reduction, with score NMS and with keyed dedup.

    ``pool`` is scored once (``iou_gt``) and every variant only selects rows of it.
    """
    pool = materialize(pool)
    variants = [("none", pool)]
    variants += [(f"nms_iou={t}", G.nms_3d(pool, t, "tube_id")) for t in nms_ious]
    variants += [(f"{k}_r={r}", G.dedup_by_distance(pool, r, k, "tube_id")) for k in keys for r in radii]
    every = materialize(union_all([d.withColumn("method", F.lit(n)) for n, d in variants]))
    names = pool.sparkSession.createDataFrame([(n,) for n, _ in variants], "method string")
    vols = SW.config_volumes(names, volumes.select(F.col("volume_id").alias("public_id")))
    rec = ST.linked_recall(every, vols, ["method"]).select("method", "recall", "pool_mean", "pool_max")
    return rec.join(SW.sweep_curves(every, gt, names, ["method"]), "method")


TUBE_METRICS = ["score_max", "slice_count", "z_span", "fill_ratio", "box_diag", "anisotropy"]


def tube_report(frame: DataFrame, radius: float = C.CLUSTER_RADIUS) -> DataFrame:
    """Percentiles of tube measures for all, hit and other tubes, plus clustering redundancy."""
    f = materialize(frame.withColumn("anisotropy", B.anisotropy()))
    tag = F.explode(F.array(F.lit("all"), F.when(F.col("is_tp"), "tp").otherwise("fp"))).alias("pool")
    out = ST.percentile_summary(f.select("*", tag), TUBE_METRICS, ["pool"])
    red = GR.cluster_redundancy(f, radius, ["public_id"], row_id="tube_id").withColumn("pool", F.lit("all"))
    return out.unionByName(ST.percentile_summary(red, ["n_clusters", "redundancy"], ["pool"]))


def detection_report(det, gt_slices, volumes, score: float = C.DIAG_SCORE) -> DataFrame:
    """Recall break-down, volume recall, the middle hit-slice count and missed volumes as
    ``section, label, n, hits, recall``. The match table is built once.

    The middle count is the upper of the two for an even number of volumes.
    """
    m = materialize(M.match_gt(det, gt_slices, score))
    f = materialize(M.fired_slices(det, gt_slices, score))
    brk = M.recall_breakdown(m, f)
    counts = materialize(M.hit_slice_counts(m, volumes))
    vol = M.per_volume_recall(counts).select(
        F.lit("volume").alias("section"), F.lit("hit").alias("label"), F.col("n_vols").alias("n"),
        F.col("vols_with_hit").alias("hits"), "recall")
    hist = counts.groupBy("hit_slices").agg(F.count(F.lit(1)).alias("k"))
    # a histogram over at most slices-per-volume values
    from pyspark.sql import Window
    run = hist.withColumn("_c", F.sum("k").over(Window.orderBy("hit_slices")))
    total = hist.agg(F.sum("k").alias("_n"))
    mid = attach(run, total).where(F.col("_c") > F.floor(F.col("_n") / 2)).agg(
        F.max("_n").alias("n"), F.min("hit_slices").alias("hits"))
    mid = mid.select(F.lit("volume").alias("section"), F.lit("middle_hit_slices").alias("label"), "n", "hits",
                     F.lit(None).cast("double").alias("recall"))
    of = m.agg(F.count_distinct("volume_id").alias("n"))
    missed = attach(M.missed_volumes(m, f).agg(F.count(F.lit(1)).alias("hits")), of).select(
        F.lit("volume").alias("section"), F.lit("missed").alias("label"), "n", "hits",
        F.lit(None).cast("double").alias("recall"))
    return union_all([brk, vol, mid, missed])


def diagnostics_report(frame: DataFrame, det: DataFrame, gt_iso: DataFrame, recon: DataFrame, op_score: float = 0.0,
                       radius: float = C.CLUSTER_RADIUS) -> DataFrame:
    """All diagnostics of a candidate pool as ``section, label, metric, value``.

    ``recon``: ``public_id, recon_iou`` from ``gt_consistency``.
    """
    frame = materialize(frame)
    vols = gt_iso.select("volume_id")
    best = materialize(volume_best(frame, vols))

    def long(df: DataFrame, section: str, label, cols) -> DataFrame:
        lab = label if not isinstance(label, str) else F.lit(label)
        return df.select(F.lit(section).alias("section"), lab.cast("string").alias("label"), F.inline(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])))

    n = F.count(F.lit(1))
    pool = best.agg(n.alias("n_vol"), F.sum("n_cand").alias("n_cand"), F.sum("n_tp").alias("n_tp"),
                    F.avg((F.col("n_tp") > 0).cast("double")).alias("recall"), F.count_if(F.col("n_tp") == 0).alias("missed"))
    stats = ["p10", "p50", "p90", "p100", "mean", "n"]
    split = frame.withColumn("pool", F.when(F.col("is_tp"), "tp").otherwise("fp"))
    split_cols = ["score_max", "box_diag", "z_span", "slice_count", "fill_ratio", "centroid_jitter", "area_cv", "score_std", "score_mean"]
    pct = ST.percentile_summary(split, split_cols, ["pool"]).withColumn("label", F.concat_ws(":", "pool", "metric")).drop("metric")
    iou = ST.percentile_summary(frame, ["official_iou"]).withColumnRenamed("metric", "label")
    ioub = ST.percentile_summary(best, ["best_official_iou", "best_iso_iou"]).withColumnRenamed("metric", "label")
    loss = ST.percentile_summary(frame.where("is_tp"), ["recon_loss"]).withColumnRenamed("metric", "label")
    rec = ST.percentile_summary(recon, ["recon_iou"]).withColumnRenamed("metric", "label")
    low = recon.agg(F.count_if(F.col("recon_iou") < C.RECON_FLOOR).alias("n_below_floor"))
    floor = ST.score_floor_sweep(frame.withColumn("iou_gt", F.col("official_iou")), best)
    red = GR.cluster_redundancy(frame, radius, ["public_id"], row_id="tube_id",
                                cols=B.CENTRE).agg(F.avg("n_clusters").alias("clusters_per_vol"), F.avg("redundancy").alias("redundancy"))
    miss = missed_verdict(frame, det, gt_iso, op_score)
    return union_all([
        long(pool, "pool", "all", ["n_vol", "n_cand", "n_tp", "recall", "missed"]),
        long(pct, "split", F.col("label"), stats),
        long(ST.separability(frame), "separability", "score_max", ["frac_fp_below_tp_median", "best_balacc", "best_thresh", "tp_min"]),
        long(floor, "floor", F.col("floor"), ["recall", "kept_total", "pool_mean", "pool_max", "n_tp_kept"]),
        *[long(d, "iou", F.col("label"), stats) for d in (iou, ioub, loss, rec)],
        long(low, "iou", "recon_iou", ["n_below_floor"]),
        long(red, "clusters", "all", ["clusters_per_vol", "redundancy"]),
        long(miss.groupBy("verdict").agg(n.alias("n_volumes")), "missed", F.col("verdict"), ["n_volumes"])])
