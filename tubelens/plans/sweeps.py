"""Parameter sweeps: configurations are rows, all of them run in one job."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tubelens import config as C
from tubelens.config import LinkConfig
from tubelens.functions import boxes as B
from tubelens.operators import greedy as G
from tubelens.operators import link as L
from tubelens.operators import match as M
from tubelens.operators import prefix as P
from tubelens.operators import ranking as R
from tubelens.operators import spatial as S
from tubelens.operators.prefix import union_all
from tubelens.plans import froc as FR
from tubelens.plans import stats as ST
from tubelens.session import materialize, stored

def one_at_a_time(base: LinkConfig, grid: dict) -> list[LinkConfig]:
    """The base and each single-knob variation of it."""
    out = [base.but(label="base")]
    for knob, values in grid.items():
        out += [base.but(**{knob: v, "label": f"{knob}={v}"}) for v in values if getattr(base, knob) != v]
    return out


def full_grid(base: LinkConfig, first: tuple, second: tuple) -> list[LinkConfig]:
    (a, avals), (b, bvals) = first, second
    return [base.but(**{a: x, b: y, "label": f"{a}={x},{b}={y}"}) for x in avals for y in bvals]


def config_table(spark: SparkSession, configs: list[LinkConfig]) -> DataFrame:
    return spark.createDataFrame([(i, c.label) for i, c in enumerate(configs)], "config_id long, config string")


def sweep_pool(det: DataFrame, meta: DataFrame, gt: DataFrame, configs: list[LinkConfig], limit: int = L.LINK_LIMIT) -> DataFrame:
    """Candidates of every configuration: ``config_id, config, public_id, tube_id, score_max, box, iou_gt``.

    Each distinct linking runs once however many floors or NMS settings use it; boxes fan out
    to (linking, volume) groups in one shuffle.
    """
    spark = det.sparkSession
    links: dict[tuple, int] = {}
    for c in configs:
        links.setdefault(c.link_key(), len(links))
    chosen = [next(c for c in configs if c.link_key() == k) for k in links]
    parts = []
    for t in sorted({c.containment for c in chosen}):
        # a box is only ever suppressed by a better one, so filtering by score commutes with it
        uses = [F.when(F.col("score") >= c.op_score, F.lit(i).cast("long"))
                for i, c in enumerate(chosen) if c.containment == t]
        parts.append(G.containment_suppress(det, t).withColumn("config_id", F.explode(F.array_compact(F.array(*uses)))))
    by = ["config_id", "volume_id"]
    feats = L.tube_features(L.link_tubes(union_all(parts), [c.but(containment=1.0) for c in chosen], by, limit), meta, by)
    feats = feats.withColumnsRenamed({"volume_id": "public_id", "config_id": "link_id"})
    scored = materialize(M.best_iou_per_row(feats, ["link_id", "tube_id"], gt))
    use = spark.createDataFrame([(links[c.link_key()], i, c.label, float(c.score_floor)) for i, c in enumerate(configs)],
                                "link_id long, config_id long, config string, floor double")
    pool = scored.join(F.broadcast(use), "link_id").where(F.col("score_max") >= F.col("floor")).drop("floor", "link_id")
    thr = {i: c.nms_iou for i, c in enumerate(configs)}
    done = [pool.where(F.col("config_id").isin([i for i, t in thr.items() if t is None]))]
    for t in sorted({t for t in thr.values() if t is not None}):
        ids = [i for i, v in thr.items() if v == t]
        done.append(G.nms_3d(pool.where(F.col("config_id").isin(ids)), t, "tube_id", ("config_id", "public_id")))
    return union_all(done)


def config_volumes(configs: DataFrame, volumes: DataFrame) -> DataFrame:
    """Every (config, volume): the denominators. The configuration list is a short literal."""
    return volumes.select("public_id").crossJoin(F.broadcast(configs))


def sweep(det: DataFrame, meta: DataFrame, gt: DataFrame, configs: list[LinkConfig], limit: int = L.LINK_LIMIT) -> DataFrame:
    """Recall and pool size of every configuration over the volumes of ``meta``."""
    pool = sweep_pool(det, meta, gt, configs, limit)
    table = config_table(det.sparkSession, configs)
    vols = config_volumes(table, meta.select(F.col("volume_id").alias("public_id")))
    return ST.linked_recall(pool, vols, ["config_id", "config"])


def sweep_curves(pool: DataFrame, gt: DataFrame, groups: DataFrame, by=("config_id",)) -> DataFrame:
    """CPM and ceiling of every group of a pool."""
    p = pool.withColumn("pred_id", F.col("tube_id")).withColumn("probability", B.clamp_prob(F.col("score_max")))
    curve = FR.froc_curve(gt, p, by, groups)
    return FR.froc_summary(curve, by=by).select(*by, "cpm", "ceiling")


def sweep_metrics(det: DataFrame, meta: DataFrame, gt: DataFrame, configs: list[LinkConfig], limit: int = L.LINK_LIMIT) -> DataFrame:
    """``sweep`` plus CPM and ceiling, from one linked pool."""
    pool = materialize(sweep_pool(det, meta, gt, configs, limit))
    table = config_table(det.sparkSession, configs)
    vols = config_volumes(table, meta.select(F.col("volume_id").alias("public_id")))
    rec = ST.linked_recall(pool, vols, ["config_id", "config"])
    return rec.join(sweep_curves(pool, gt, table.select("config_id")), "config_id")


def target_flags(pool: DataFrame, volumes: DataFrame, base: str, labels: list[str], hit_iou: float = C.HIT_IOU) -> DataFrame:
    """The volumes the base configuration misses, with one hit flag per configuration."""
    hit = pool.where(F.col("iou_gt") > hit_iou).select("public_id", "config").distinct()
    missed = volumes.select("public_id").join(hit.where(F.col("config") == base), "public_id", "left_anti")
    flags = hit.groupBy("public_id").pivot("config", labels).agg(F.count(F.lit(1)))
    return missed.join(flags, "public_id", "left").select(
        "public_id", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in labels])


def threshold_configs(base: LinkConfig, thresholds) -> list[LinkConfig]:
    return [base.but(op_score=float(t), label=f"t={t}") for t in thresholds]


def threshold_probe(det, meta, gt, base: LinkConfig, thresholds, limit: int = L.LINK_LIMIT) -> DataFrame:
    """Metrics per score threshold: ``thresh, recall, pool_mean, pool_max, cpm, ceiling``."""
    m = sweep_metrics(det, meta, gt, threshold_configs(base, thresholds), limit)
    grid = det.sparkSession.createDataFrame([(i, float(t)) for i, t in enumerate(thresholds)], "config_id long, thresh double")
    return m.join(F.broadcast(grid), "config_id").select("thresh", "recall", "n_hit", "n_vol", "pool_mean", "pool_max", "cpm", "ceiling")


def calibrate(det, meta, gt, base: LinkConfig, thresholds, seeds, limit: int = L.LINK_LIMIT):
    """Threshold sweep for every seed's detections: ``(per-seed rows, mean and std over seeds)``.

    ``det`` carries ``seed``. Nothing is copied per threshold: a box is linked for all thresholds in one place, a tube that several
    thresholds in a row share is one row with their range, and meets ground truth once. Ranges become thresholds where counts are made.
    """
    spark, seeds, thresholds = det.sparkSession, list(seeds), list(thresholds)
    det = G.containment_suppress(det.where(F.col("seed").isin(seeds)), base.containment, ("seed", "volume_id", "slice_z"))  # commutes with the score filter
    steps = sorted({float(t) for t in thresholds}, reverse=True)
    pairs = [(i, s, float(t), steps.index(float(t))) for i, (s, t) in enumerate((s, t) for s in seeds for t in thresholds)]
    table = spark.createDataFrame(pairs, "config_id long, seed long, thresh double, step int")
    # read several times. Not as Parquet: files of so few distinct values are so small that joins would broadcast them at any number of rows
    meta, gt = materialize(meta.select("volume_id", "zoom_factors")), materialize(gt.select("public_id", "label_id", *B.CENTRE, *B.EXTENT))
    tubes = L.official_boxes(L.threshold_tubes(det, base, steps, ["seed", "volume_id"], limit), meta).withColumnRenamed("volume_id", "public_id")
    pool = stored(tubes.where(F.col("score_max") >= base.score_floor).select(
        "seed", "public_id", "tube_id", "first", "last", "score_max", *B.CENTRE, *B.EXTENT), "pool")
    if base.nms_iou is not None:
        one = pool.withColumn("first", F.explode(F.sequence("first", "last"))).withColumn("last", F.col("first"))
        pool = stored(G.nms_3d(one, base.nms_iou, "tube_id", ("seed", "first", "public_id")), "pool")
    counts = _range_counts(pool, gt, ["seed"])
    got = table.join(counts, ["seed", "step"], "left")
    n_vol = F.col("n_vol")
    rec = P.attach(got.groupBy("config_id").agg(F.coalesce(F.sum("n_hit"), F.lit(0)).alias("n_hit"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")),
                   meta.agg(F.count(F.lit(1)).alias("n_vol"))).where(n_vol > 0).select(
        "config_id", (F.col("n_hit") / n_vol).alias("recall"), (F.col("n") / n_vol).alias("pool_mean"))
    bins = got.where("bin is not null").select("config_id", "bin", "tp", "fp")
    curve = FR.curve_from_bins(bins, FR.group_sizes(gt, table.select("config_id")), ["config_id"])
    rows = rec.join(FR.froc_summary(curve, by=["config_id"]).select("config_id", "cpm", "ceiling"), "config_id").join(table, "config_id")
    rows = rows.select("seed", "thresh", "recall", "cpm", "ceiling", "pool_mean")
    return rows, ST.over_seeds(rows, ["thresh"], ["recall", "cpm", "ceiling", "pool_mean"])


def _range_counts(pool: DataFrame, gt: DataFrame, by: list[str], hit_iou: float = C.HIT_IOU) -> DataFrame:
    """``by..., step, bin, n, n_hit, tp, fp`` of tubes that stand for the steps ``first`` to ``last``: tubes, volumes hit (at bin 0), and the
    counts of ``froc.volume_histograms`` summed over volumes. 200 rows per group and step at most."""
    box = [*B.CENTRE, *B.EXTENT]
    row = ["public_id", *by, "tube_id", "first", "last"]
    steps = F.explode(F.sequence("first", "last")).alias("step")
    pool = pool.withColumn("bin", FR.threshold_bin(B.clamp_prob(F.col("score_max"))))
    near = S.volume_pairs(pool.select(*row, "bin", *box), gt.select("public_id", "label_id", *box), ["public_id"]).where(F.col("iou") > hit_iou)
    best = near.groupBy("public_id", *[F.col("a_" + c).alias(c) for c in row[1:]]).agg(
        F.max("a_bin").alias("bin"), F.max(F.struct("iou", (-F.col("b_label_id")).alias("l")))["l"].alias("_l"))
    hits = stored(best.select("public_id", *by, "first", "last", "bin", (-F.col("_l")).alias("hit_label")), "hits")
    # one move by box; its steps are spread out behind it
    per_box = hits.repartition(*by, "public_id", "hit_label").select(*by, "public_id", "hit_label", "bin", steps).groupBy(
        *by, "public_id", "hit_label", "step").agg(F.max("bin").alias("bin"))
    zero = F.lit(0).cast("long")
    kinds = ("n", "n_hit", "tp", "fp")
    count = lambda df, **at: df.groupBy(*by, "step", "bin").agg(F.count(F.lit(1)).alias("_n")).select(
        *by, "step", "bin", *[(F.col("_n") * at[k] if k in at else zero).alias(k) for k in kinds])
    vols = hits.select(*by, "public_id", steps).distinct().withColumn("bin", F.lit(0))
    return stored(P.union_all([count(pool.select(*by, steps, "bin"), n=1, fp=1), count(hits.select(*by, steps, "bin"), fp=-1), count(per_box, tp=1),
                               count(vols, n_hit=1)]).groupBy(*by, "step", "bin").agg(*[F.sum(k).alias(k) for k in kinds]), "counts")


def evaluate_epochs(det, meta, gt, base: LinkConfig, epochs, limit: int = L.LINK_LIMIT) -> DataFrame:
    """Linked CPM, ceiling, recall and pool for every checkpoint; ``det`` carries ``epoch``."""
    spark = det.sparkSession
    det = G.containment_suppress(det, base.containment, ("epoch", "volume_id", "slice_z"))
    table = spark.createDataFrame([(i, int(e)) for i, e in enumerate(epochs)], "config_id long, epoch long")
    fan = det.join(F.broadcast(table), "epoch").where(F.col("score") >= base.op_score).select("config_id", "volume_id", *L.MEMBER)
    by = ["config_id", "volume_id"]
    f = L.tube_features(L.link_tubes(fan, [base.but(containment=1.0)] * len(list(epochs)), by, limit), meta, by).withColumnRenamed("volume_id", "public_id")
    f = f.where(F.col("score_max") >= base.score_floor)
    pool = G.nms_3d(materialize(M.best_iou_per_row(f, ["config_id", "tube_id"], gt)), base.nms_iou, "tube_id", ("config_id", "public_id"))
    pool = materialize(pool)
    vols = config_volumes(table.select("config_id"), meta.select(F.col("volume_id").alias("public_id")))
    rec = ST.linked_recall(pool, vols, ["config_id"])
    return rec.join(sweep_curves(pool, gt, table.select("config_id")), "config_id").join(table, "config_id").select(
        "epoch", "cpm", "ceiling", "recall", "pool_mean")
