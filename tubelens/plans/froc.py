"""FROC curve, its summary, and the volume bootstrap, from per-bin counts.

A prediction counts at every threshold up to its own probability, so one histogram over the
200 threshold bins and a suffix sum replace 200 scans. Counts are additive over volumes, so a
bootstrap replicate is a weighted sum of per-volume histograms; no data is copied.
"""
from __future__ import annotations

from typing import Optional

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tubelens import config as C
from tubelens.operators import match as M
from tubelens.operators import prefix as P
from tubelens.session import materialize


def threshold_bin(prob: Column) -> Column:
    """Index of the highest threshold ``i * 0.005`` that ``prob`` reaches, exact at the edges."""
    step = F.lit(C.THRESHOLD_STEP)
    guess = F.floor(prob * C.N_THRESHOLDS).cast("int")
    fixed = (F.when((guess + 1) * step <= prob, guess + 1).when(guess * step > prob, guess - 1).otherwise(guess))
    return F.least(fixed, F.lit(C.N_THRESHOLDS - 1))


def volume_histograms(gt: DataFrame, pred: DataFrame, by=(), hit_iou: float = C.HIT_IOU) -> DataFrame:
    """``by..., public_id, bin, tp, fp``: a ground-truth box counts once, at its best hit; a
    prediction whose best IoU is not a hit is a false positive; repeat hits are neither."""
    keys = [*by, "public_id"]
    hits = M.match_predictions(pred, gt, by).where(F.col("max_iou") > hit_iou)
    # at most 200 rows per box from here on
    per_box = hits.groupBy(*keys, "hit_label", threshold_bin(F.col("probability")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    best = F.max("bin").over(Window.partitionBy(*keys, "hit_label"))
    hit_bins = per_box.withColumn("tp", (F.col("bin") == best).cast("long")).select(
        *keys, "bin", "tp", (-F.col("n")).alias("fp"))
    preds = pred.groupBy(*keys, threshold_bin(F.col("probability")).alias("bin")).agg(F.count(F.lit(1)).alias("fp")).select(
        *keys, "bin", F.lit(0).cast("long").alias("tp"), "fp")
    return (hit_bins.unionByName(preds).groupBy(*keys, "bin").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
            .where((F.col("tp") != 0) | (F.col("fp") != 0)))


def curve_from_bins(bins: DataFrame, sizes: DataFrame, by=()) -> DataFrame:
    """``by..., p_thresh, fp, recall`` from binned counts (``by, bin, tp, fp``) and group sizes
    (``by, n_vol, n_gt``). Every group has all 200 thresholds."""
    keys = list(by)
    grid = sizes.select(*keys, "n_vol", "n_gt", F.explode(F.sequence(F.lit(0), F.lit(C.N_THRESHOLDS - 1))).alias("bin"))
    full = grid.join(bins, keys + ["bin"], "left")
    w = Window.partitionBy(*keys).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)  # 200 rows
    tp, fp = (F.sum(F.coalesce(c, F.lit(0))).over(w) for c in ("tp", "fp"))
    e = C.FROC_EPS
    return full.select(*keys, "bin", tp.alias("_tp"), fp.alias("_fp"), "n_vol", "n_gt").select(
        *keys, (F.col("bin") * F.lit(C.THRESHOLD_STEP)).alias("p_thresh"),
        ((F.col("_fp") + e) / (F.col("n_vol") + e)).alias("fp"),
        ((F.col("_tp") + e) / (F.col("n_gt") + e)).alias("recall"))


def group_sizes(gt: DataFrame, groups: Optional[DataFrame] = None) -> DataFrame:
    """Volumes with ground truth (also those without predictions) and boxes, per group."""
    per = gt.groupBy("public_id").agg(F.count(F.lit(1)).alias("_n"))
    one = per.agg(F.count(F.lit(1)).alias("n_vol"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_gt"))
    return one if groups is None else P.attach(groups, one)


def froc_curve(gt: DataFrame, pred: DataFrame, by=(), groups: Optional[DataFrame] = None) -> DataFrame:
    """200-point FROC. With ``by``, ``groups`` lists the group keys (also those without
    predictions) and the whole of ``gt`` applies to each."""
    keys = list(by)
    hist = volume_histograms(gt, pred, by).groupBy(*keys, "bin").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    return curve_from_bins(hist, group_sizes(gt, groups), by)


def _key_points(curve: DataFrame, key_fp, by) -> DataFrame:
    """One row per group: ``keys`` (array of key_fp, recall), ``ceiling``, ``fp_at_ceiling``, ``cpm``."""
    point = F.struct("fp", "p_thresh", "recall")
    aggs = [F.max("recall").alias("ceiling"), F.max("fp").alias("fp_at_ceiling")]
    for i, k in enumerate(key_fp):
        aggs += [F.max(F.when(F.col("fp") <= k, point)).alias(f"_a{i}"), F.min(F.when(F.col("fp") >= k, point)).alias(f"_b{i}")]

    def at(i, k):
        a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
        line = a["recall"] + (b["recall"] - a["recall"]) * ((k - a["fp"]) / (b["fp"] - a["fp"] + 1e-8))
        return F.when(a.isNull(), F.lit(0.0)).when(b.isNull(), F.col("ceiling")).otherwise(line)

    rows = F.array(*[F.struct(F.lit(float(k)).alias("key_fp"), at(i, k).alias("recall")) for i, k in enumerate(key_fp)])
    total = F.aggregate("keys", F.lit(0.0), lambda acc, x: acc + x["recall"])
    return curve.groupBy(*by).agg(*aggs).select(*by, "ceiling", "fp_at_ceiling", rows.alias("keys")).withColumn(
        "cpm", total / len(key_fp))


def recall_at_fp(curve: DataFrame, key_fp=C.KEY_FP, by=()) -> DataFrame:
    """Recall interpolated at each key FP: ``by..., key_fp, recall``.

    The curve is read in (fp, p_thresh) order: 0 below its range, its maximum above.
    """
    return _key_points(curve, key_fp, by).select(*by, F.inline("keys"))


def froc_summary(curve: DataFrame, key_fp=C.KEY_FP, by=()) -> DataFrame:
    """``by..., cpm, ceiling, fp_at_ceiling, key_recall`` (map key FP -> recall)."""
    return _key_points(curve, key_fp, by).select(
        *by, "cpm", "ceiling", "fp_at_ceiling", F.map_from_entries("keys").alias("key_recall"))


# ---------------------------------------------------------------- bootstrap
def _drawn(volumes: DataFrame, n_boot: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``public_id, i`` of every volume and one row ``b, i`` per draw.

    Draw j of replicate b is 60 bits of a hash of (seed, b, j), so it does not depend on partitioning.
    """
    spark = volumes.sparkSession
    idx = materialize(P.dense_index(volumes.select("public_id").distinct(), [F.col("public_id")], "i"))
    n = idx.count()
    code = F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("j").cast("string"))
    d = spark.range(n_boot * n).select((F.col("id") / n).cast("long").alias("b"), (F.col("id") % n).alias("j"))
    i = F.conv(F.substring(F.md5(code), 1, 15), 16, 10).cast("long") % n
    return idx, d.select("b", i.alias("i"))


def draws(volumes: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """``b, public_id, weight``: volumes drawn with replacement, as many as there are."""
    idx, d = _drawn(volumes, n_boot, seed)
    return d.groupBy("b", "i").agg(F.count(F.lit(1)).alias("weight")).join(idx, "i").drop("i")


def _replicate_sums(drawn: DataFrame, n_boot: int, by: list[str], kinds: dict[str, str]) -> DataFrame:
    """``by..., b, bin, tp, fp`` summed over the draws of a task, from one row per volume: ``bs`` (the replicates that drew it), its boxes and
    the columns of its histogram as lists. Bin -1 has the draws and their ground-truth boxes. A task holds one count per
    (group, bin, replicate), however many volumes it sees."""
    def run(batches):
        tp, fp = {}, {}
        sizes = np.zeros((2, n_boot), dtype=np.int64)
        for pdf in batches:
            lists = [pdf[c] for c in (*by, "bin", "tp", "fp")]
            for bs, boxes, *h in zip(pdf["bs"], pdf["_n"], *lists):
                w = np.bincount(bs, minlength=n_boot)
                sizes[0] += w
                sizes[1] += w * boxes
                if h[-1] is None:
                    continue
                for *group, at, t, f in zip(*h):
                    key = (*group, int(at))
                    for sums, value in ((tp, t), (fp, f)):
                        if key not in sums:
                            sums[key] = np.zeros(n_boot, dtype=np.int64)
                        if value:
                            sums[key] += value * w
        b = np.arange(n_boot, dtype=np.int64)
        yield pd.DataFrame({**{k: pd.Series([None] * n_boot, dtype=object) for k in by}, "b": b, "bin": -1, "tp": sizes[0], "fp": sizes[1]})
        for key in tp:
            yield pd.DataFrame({**dict(zip(by, key)), "b": b, "bin": key[-1], "tp": tp[key], "fp": fp[key]})

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in by], "b long, bin int, tp long, fp long"])
    return drawn.mapInPandas(run, schema)


def bootstrap_values(gt: DataFrame, hist: DataFrame, n_boot: int = 1000, seed: int = 0, by=(),
                     groups: Optional[DataFrame] = None) -> DataFrame:
    """CPM of each replicate, ``by..., b, cpm``, from ``volume_histograms``. All groups (a short list)
    see the same draws, so their differences are paired.

    A volume meets the list of the replicates that drew it once, and its histogram is added to theirs as vectors; rows of
    (replicate, volume, bin) are never made.
    """
    by = list(by)
    keys = [*by, "b"]
    per_gt = gt.groupBy("public_id").agg(F.count(F.lit(1)).alias("_n"))
    idx, d = _drawn(gt, n_boot, seed)
    lists = d.groupBy("i").agg(F.collect_list(F.col("b").cast("int")).alias("bs"))  # n_boot on average
    h = hist.join(idx, "public_id").groupBy("i").agg(F.collect_list(F.struct(*by, "bin", "tp", "fp")).alias("_h"))
    drawn = lists.join(idx.join(per_gt, "public_id").drop("public_id"), "i").join(h, "i", "left").select(
        "bs", "_n", *[F.col(f"_h.{c}").alias(c) for c in (*by, "bin", "tp", "fp")])
    tasks = 2 * gt.sparkSession.sparkContext.defaultParallelism  # each sends one row per (group, bin, replicate)
    kinds = {f.name: f.dataType.simpleString() for f in hist.schema}
    sums = materialize(_replicate_sums(drawn.coalesce(tasks), n_boot, by, kinds).groupBy(*keys, "bin").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp")))
    sizes = sums.where("bin = -1").select("b", F.col("tp").alias("n_vol"), F.col("fp").alias("n_gt"))
    if groups is not None:
        sizes = groups.crossJoin(sizes)  # short list x replicates
    bins = sums.where("bin >= 0")
    return _key_points(curve_from_bins(bins, sizes, keys), C.KEY_FP, keys).select(*keys, "cpm")


def bootstrap_cpm(gt: DataFrame, pred: DataFrame, n_boot: int = 1000, seed: int = 0, ci: float = 0.95) -> DataFrame:
    """One row ``point, lo, hi``: CPM and its percentile interval over volume resamples."""
    a = (1.0 - ci) / 2.0
    hist = materialize(volume_histograms(gt, pred))
    q = F.percentile("cpm", F.array(F.lit(a), F.lit(1.0 - a)))  # n_boot values
    ci_row = bootstrap_values(gt, hist, n_boot, seed).agg(q.alias("q"))
    bins = hist.groupBy("bin").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    point = _key_points(curve_from_bins(bins, group_sizes(gt)), C.KEY_FP, ()).select(F.col("cpm").alias("point"))
    return P.attach(point, ci_row).select("point", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
