"""Summaries: percentiles, separability, effect size, design statistics, gates, balance."""
from __future__ import annotations

from typing import Optional

from pyspark.sql import Column, DataFrame, functions as F

from tubelens import config as C
from tubelens.functions import boxes as B
from tubelens.operators import prefix as P
from tubelens.operators.ranking import seeded_order
from tubelens.session import materialize


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def _finite(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols})


def percentile_summary(df: DataFrame, cols, by=(), qs=C.SUMMARY_PERCENTILES) -> DataFrame:
    """Long table ``metric, by..., p<q>..., mean, n`` per column; NULL and NaN are skipped."""
    keys = list(by)
    long = _finite(df, cols).select(*keys, F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in cols]))).where(F.col("v").isNotNull())
    per_value = materialize(long.groupBy("metric", *keys, "v").agg(F.count(F.lit(1)).alias("_k")))
    runs = P.exact_percentiles_weighted(per_value, ["metric", *keys], "v", "_k", qs)
    mean = per_value.groupBy("metric", *keys).agg((F.sum(F.col("v") * F.col("_k")) / F.sum("_k")).alias("mean"))
    return runs.join(mean, ["metric", *keys]).select("metric", *keys, *[f"p{q}" for q in qs], "mean", "n")


def separability(df: DataFrame, col: str = "score_max", flag: str = "is_tp") -> DataFrame:
    """Share of negatives below the positives' median, the best single-threshold balanced accuracy
    (lowest threshold on ties) and the smallest positive. NULLs when a class is empty."""
    tp, fp = F.col(flag).cast("long"), (~F.col(flag)).cast("long")
    runs = materialize(P.value_runs(df, [], col, {"tp": tp, "fp": fp}))
    tot = runs.agg(F.sum("tp").alias("n_tp"), F.sum("fp").alias("n_fp"))
    j = P.attach(runs, tot)
    tpr = (F.col("n_tp") - F.col("cum_tp") + F.col("tp")) / F.col("n_tp")
    tnr = (F.col("cum_fp") - F.col("fp")) / F.col("n_fp")
    both = (F.col("n_tp") > 0) & (F.col("n_fp") > 0)
    v = F.col(col).cast("double")
    lo = F.min(F.when(F.col("cum_tp") > F.floor((F.col("n_tp") - 1) / 2.0), v))
    hi = F.min(F.when(F.col("cum_tp") > F.ceil((F.col("n_tp") - 1) / 2.0), v))
    one = j.agg(F.max(F.when(both, F.struct((0.5 * (tpr + tnr)).alias("ba"), (-v).alias("t")))).alias("_b"),
                ((lo + hi) / 2.0).alias("_med"), F.min(F.when(both & (F.col("tp") > 0), v)).alias("tp_min"))
    below = P.attach(runs, one).agg(
        F.sum(F.when(v < F.col("_med"), F.col("fp")).otherwise(0)).alias("_lt"), F.sum("fp").alias("_fp"),
        F.max("_b").alias("_b"), F.max("tp_min").alias("tp_min"))
    return below.select(F.when(F.col("_b").isNotNull(), F.col("_lt") / F.col("_fp")).alias("frac_fp_below_tp_median"),
                        F.col("_b.ba").alias("best_balacc"), (-F.col("_b.t")).alias("best_thresh"), "tp_min")


def cliffs_delta(df: DataFrame, col: str, flag: str) -> DataFrame:
    """``P(a > b) - P(a < b)`` for a = rows with ``flag``, b = the others; one row ``delta``."""
    a, b = F.col(flag).cast("long"), (~F.col(flag)).cast("long")
    runs = P.value_runs(_finite(df, [col]), [], col, {"a": a, "b": b})
    na, nb = F.sum("a").cast("double"), F.sum("b").cast("double")
    above = F.sum(F.col("a").cast("double") * (F.col("cum_b") - F.col("b")))
    through = F.sum(F.col("a").cast("double") * F.col("cum_b"))
    # a below b: all b minus those at or below
    below = na * nb - through
    return runs.agg(F.when((na > 0) & (nb > 0), (above - below) / (na * nb)).alias("delta"))


# ---------------------------------------------------------------- pool metrics
def linked_recall(cands: DataFrame, volumes: DataFrame, by=(), hit_iou: float = C.HIT_IOU) -> DataFrame:
    """Recall and pool size over the listed volumes (those without candidates count as 0).

    ``cands`` has ``by..., public_id, iou_gt``; ``volumes`` lists ``by..., public_id``.
    """
    keys = [*by, "public_id"]
    per = cands.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max((F.col("iou_gt") > hit_iou).cast("long")).alias("_h"))
    full = volumes.select(*keys).join(per, keys, "left").select(
        *by, F.coalesce("_n", F.lit(0)).alias("_n"), F.coalesce("_h", F.lit(0)).alias("_h"))
    n = F.count(F.lit(1))
    return full.groupBy(*by).agg(
        _ratio(F.sum("_h"), n).alias("recall"), F.sum("_h").cast("long").alias("n_hit"), n.alias("n_vol"),
        F.avg("_n").alias("pool_mean"), F.percentile("_n", F.lit(0.5)).alias("pool_median"),  # integers
        F.max("_n").alias("pool_max"), F.sum("_n").cast("long").alias("pool_total"))


def score_floor_sweep(cands: DataFrame, volumes: DataFrame, floors=C.SCORE_FLOORS, hit_iou: float = C.HIT_IOU) -> DataFrame:
    """Per score floor: recall, pool and kept hits over the listed volumes.

    One pass: per volume, counts for every floor as aggregate columns, no copy of the pool per floor.
    """
    tp = F.col("iou_gt") > hit_iou
    per = cands.groupBy("public_id").agg(
        *[F.count_if(F.col("score_max") >= f).alias(f"k{i}") for i, f in enumerate(floors)],
        *[F.count_if((F.col("score_max") >= f) & tp).alias(f"t{i}") for i, f in enumerate(floors)])
    full = volumes.select("public_id").join(per, "public_id", "left")
    rows = F.array(*[F.struct(F.lit(float(f)).alias("floor"), F.coalesce(f"k{i}", F.lit(0)).alias("k"),
                              F.coalesce(f"t{i}", F.lit(0)).alias("t")) for i, f in enumerate(floors)])
    n = F.count(F.lit(1))
    return full.select(F.inline(rows)).groupBy("floor").agg(
        (F.count_if(F.col("t") > 0) / n).alias("recall"), F.sum("k").cast("long").alias("kept_total"),
        (F.sum("k") / n).alias("pool_mean"), F.max("k").alias("pool_max"), F.sum("t").cast("long").alias("n_tp_kept"))


# ---------------------------------------------------------------- design statistics
def _pcts(col: str, qs=C.DESIGN_PERCENTILES) -> Column:
    return F.percentile(col, F.array(*[F.lit(q / 100.0) for q in qs]))


def train_stats(meta: DataFrame, gt_slices: DataFrame, manifest: DataFrame, qs=C.DESIGN_PERCENTILES) -> DataFrame:
    """One row over the train split: frame sizes, box size percentiles, boxes per slice.

    Box sides are pixel counts, so the percentile states hold a few distinct values per side.
    """
    train = manifest.where(F.col("split") == "train").select("volume_id")
    d = meta.join(train, "volume_id", "left_semi").select(F.col("iso_shape")[0].alias("d0"), F.col("iso_shape")[1].alias("d1"))
    frames = d.agg(F.count(F.lit(1)).alias("n_train_volumes"), *[f(c).alias(f"frame_{c}_{n}") for c in ("d0", "d1")
                   for n, f in (("min", F.min), ("max", F.max), ("median", lambda x: F.percentile(x, F.lit(0.5))))])
    b = gt_slices.join(train, "volume_id", "left_semi").select(
        "volume_id", "slice_z", (F.col("r1") - F.col("r0") + 1).cast("double").alias("h"),
        (F.col("c1") - F.col("c0") + 1).cast("double").alias("w"))
    b = b.withColumns({"diag": F.sqrt(F.col("h") * F.col("h") + F.col("w") * F.col("w")), "aspect": F.col("h") / F.col("w")})
    sizes = b.agg(F.count(F.lit(1)).alias("n_boxes"), _pcts("h", qs).alias("box_h_pct"), _pcts("w", qs).alias("box_w_pct"),
                  _pcts("diag", qs).alias("diag_pct"), _pcts("aspect", qs).alias("aspect_pct"))
    per = b.groupBy("volume_id", "slice_z").agg(F.count(F.lit(1)).alias("_n"))
    comp = per.agg(F.coalesce(F.max("_n"), F.lit(0)).alias("components_per_slice_max"),
                   F.coalesce(F.avg((F.col("_n") > 1).cast("double")), F.lit(0.0)).alias("components_per_slice_frac_gt1"))
    return P.attach(P.attach(frames, sizes), comp)


def pooled_intensity(slice_stats: DataFrame, n_sample: Optional[int] = None,
                     seed: int = C.DESIGN_RULE["intensity_seed"]) -> DataFrame:
    """Mean and std pooled from per-slice ``volume_id, slice_z, n, mean, sumsq``, over all
    slices, or over a seeded sample of ``n_sample``."""
    d = slice_stats
    if n_sample is not None:
        d = d.orderBy(seeded_order(F.lit(seed), F.concat_ws(":", "volume_id", "slice_z")), "volume_id", "slice_z").limit(n_sample)
    n, s, q = F.sum("n"), F.sum(F.col("n") * F.col("mean")), F.sum("sumsq")
    return d.agg(F.count(F.lit(1)).alias("n_slices"), (s / n).alias("intensity_mean"),
                 F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))).alias("intensity_std"))


def derive_constants(stats: DataFrame, rule: Optional[dict] = None, qs=C.DESIGN_PERCENTILES) -> DataFrame:
    """Design constants from a ``train_stats`` row: padded frame, power-of-two ladder that covers
    the large boxes, aspect ratios snapped to the grid."""
    r = rule or C.DESIGN_RULE
    at = {q: i for i, q in enumerate(qs)}
    n = int(r["anchor_n_levels"])
    lo, hi = F.col("diag_pct")[at[r["anchor_diag_lo_pct"]]], F.col("diag_pct")[at[r["anchor_diag_hi_pct"]]]
    base = F.least(F.pow(F.lit(2.0), F.rint(F.log2(lo))), F.lit(float(r["anchor_min_base"])))
    need = hi / F.lit(2.0 ** (2.0 / 3.0))
    octaves = F.greatest(F.lit(0.0), F.ceil(F.log2(need / (base * (2.0 ** (n - 1))))).cast("double"))
    first = base * F.pow(F.lit(2.0), octaves)
    snapped = [B.snap_to_grid(F.col("aspect_pct")[at[p]], r["aspect_grid"]) for p in r["aspect_pcts"]]
    return stats.select(
        B.round_up(F.col("frame_d0_max"), r["min_size_round"]).alias("min_size"),
        B.round_up(F.col("frame_d1_max"), r["max_size_round"]).alias("max_size"),
        F.array(*[F.rint(first * (2.0 ** i)).cast("long") for i in range(n)]).alias("anchor_base_sizes"),
        F.array_sort(F.array_distinct(F.array(*snapped, F.lit(1.0)))).alias("anchor_aspect_ratios"))


def derive_link_caps(gt_slices: DataFrame, zspan_safety: float = 1.8, drift_safety: float = 1.5) -> DataFrame:
    """Tube caps from the 99th percentiles of lesion depth and in-plane side (both integers)."""
    z = gt_slices.groupBy("volume_id").agg((F.max("slice_z") - F.min("slice_z") + 1).alias("_z")).agg(
        F.percentile("_z", F.lit(0.99)).alias("zspan_p99"))
    side = F.greatest(F.col("c1") - F.col("c0") + 1, F.col("r1") - F.col("r0") + 1)
    e = gt_slices.agg(F.percentile(side, F.lit(0.99)).alias("inplane_extent_p99"))
    return P.attach(z, e).select("zspan_p99", "inplane_extent_p99",
                                 B.half_even(zspan_safety * F.col("zspan_p99")).alias("max_tube_zspan"),
                                 B.half_even(drift_safety * F.col("inplane_extent_p99")).alias("max_centroid_drift"))


def slice_total(meta: DataFrame) -> DataFrame:
    n = F.col("iso_shape")[2]
    return meta.agg(F.sum(n).cast("long").alias("n_slices"), F.avg(n).alias("mean_slices"))


# ---------------------------------------------------------------- audits, gates, balance
def component_audit(sizes: DataFrame, floor: int = C.LESION_MIN_VOXELS) -> DataFrame:
    """Histogram of components per volume: ``n_components, raw_volumes, kept_volumes``, where kept
    counts components of at least ``floor`` voxels; and whether one component is dominant
    (at least 90 % of volumes keep exactly one)."""
    per = sizes.groupBy("volume_id").agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("n_voxels") >= floor).alias("kept"))
    long = per.select(F.inline(F.array(F.struct(F.col("raw").alias("n_components"), F.lit(1).alias("r"), F.lit(0).alias("k")),
                                       F.struct(F.col("kept").alias("n_components"), F.lit(0).alias("r"), F.lit(1).alias("k")))))
    hist = long.groupBy("n_components").agg(F.sum("r").cast("long").alias("raw_volumes"), F.sum("k").cast("long").alias("kept_volumes"))
    share = per.agg(F.avg((F.col("kept") == 1).cast("double")).alias("single_share"))
    return P.attach(hist, share).withColumn("single_dominant", F.col("single_share") >= 0.9)


def gate_summary(df: DataFrame, col: str, soft: float = C.RECON_SOFT, floor: float = C.RECON_FLOOR,
                 share: float = C.RECON_SOFT_SHARE) -> DataFrame:
    """Distribution of a per-volume IoU and the gate: PASS when none is below ``floor`` and at least ``share`` of them
    reach ``soft``. An empty input has no verdict."""
    pct = P.exact_percentiles(df, [], col, (10, 50))
    cnt = df.agg(F.min(col).alias("min"), F.max(col).alias("max"), F.count_if(F.col(col) < soft).alias("n_below_warn"),
                 F.count_if(F.col(col) < floor).alias("n_below_floor"), F.avg((F.col(col) >= soft).cast("double")).alias("soft_share"))
    return P.attach(pct, cnt).select(
        "n", "min", "p10", F.col("p50").alias("median"), "max", "n_below_warn", "n_below_floor", "soft_share",
        F.when((F.col("n_below_floor") == 0) & (F.col("soft_share") >= share), "PASS").otherwise("FAIL").alias("verdict"))


def balance(manifest: DataFrame) -> DataFrame:
    """Counts by (split, label), by fold and by split in one pass."""
    g = manifest.groupingSets([["split"], ["split", "label"], ["fold"]], "split", "label", "fold")
    return g.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level")).select("level", "split", "label", "fold", "n")


def slice_balance(samples: DataFrame, manifest: DataFrame) -> DataFrame:
    """Lesion and background slices of each split."""
    j = samples.join(manifest.select("volume_id", "split"), "volume_id")
    return j.groupBy("split").agg(F.count(F.lit(1)).alias("n_slices"), F.count_if("is_lesion").alias("n_lesion"),
                                  F.count_if(~F.col("is_lesion")).alias("n_background"))


def label_balance(pool: DataFrame) -> DataFrame:
    """Candidates and volumes of each (detector, label)."""
    per = pool.groupBy("detector_of_origin", "label", "public_id").agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy("detector_of_origin", "label").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("n_volumes"))


def over_seeds(df: DataFrame, by, cols) -> DataFrame:
    """Mean and population std of each column over the other dimension; NULL and NaN are skipped."""
    d = _finite(df, cols)
    return d.groupBy(*by).agg(*[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def membership_hash(df: DataFrame, cols) -> DataFrame:
    """Row count and an order-free fingerprint of the rows (sums of 64-bit pieces of their SHA-256).

    Sums combine per partition, so the table is never gathered or sorted.
    """
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("n"), part(0).cast("string").alias("h0"), part(1).cast("string").alias("h1"))


def reconcile_constants(derived: DataFrame, pinned: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Join ``name, value`` tables on name: difference, whether it is within ``tol``."""
    d = F.abs(F.col("value") - F.col("pinned_value"))
    return derived.join(pinned.select("name", F.col("value").alias("pinned_value")), "name", "full_outer").select(
        "name", "value", "pinned_value", d.alias("diff"), F.coalesce(d <= tol, F.lit(False)).alias("ok"))
