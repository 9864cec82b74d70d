from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tubelens import config as C
from tubelens import schemas as K
from tubelens.config import LinkConfig
from tubelens.functions import boxes as B
from tubelens.operators import graph as GR
from tubelens.operators import greedy as G
from tubelens.operators import link as L
from tubelens.operators import match as M
from tubelens.operators import prefix as P
from tubelens.operators import ranking as R
from tubelens.operators import spatial as S
from tubelens.plans import candidates as CA
from tubelens.plans import froc as FR
from tubelens.plans import reports as RP
from tubelens.plans import stats as ST
from tubelens.plans import sweeps as SW
from tubelens.plans.fixtures import Fixtures
from tubelens.session import materialize, stage_path
from tubelens.sources import contracts as CT
from tubelens.sources import tables as TB
from tubelens.streaming import ingest as IN

# The derived volumes have 12 slices, so tubes of 3 boxes count.
LINK = LinkConfig(min_tube_len=3, op_score=0.02, score_floor=0.0)
QUERIES: dict = {}


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles to 6 places and widen integers, so engines can be compared."""
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(fn):
    key = fn.__name__

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(fn(Fixtures(spark, sf_dir)))

    run.__name__ = key
    QUERIES[key] = run
    return fn


BOX3 = [*B.CENTRE, *B.EXTENT]


def _zoom(df: DataFrame) -> DataFrame:
    return df.withColumn("zoom_factors", B.zoom_factors())


def _cols(df: DataFrame, exprs: dict, *keep) -> DataFrame:
    return df.select(*keep, *[c.alias(n) for n, c in exprs.items()])


# ================================================================ A. sources, sinks, contracts
@query
def s1(fx):
    p = stage_path(fx.spark, "det")
    TB.write_detections(fx.det(), p)
    return TB.read_detections(fx.spark, p)


@query
def s2(fx):
    p = stage_path(fx.spark, "det")
    TB.write_detections(fx.det(), p, csv_mirror=True)
    return TB.read_detections(fx.spark, p + ".csv")


@query
def s3(fx):
    return CT.violation_counts(fx.dirty(), K.DETECTIONS)


@query
def s5(fx):
    p = stage_path(fx.spark, "gt")
    back = {v: k for k, v in K.GT_SHIPPED_NAMES.items()}
    fx.gt_boxes().drop("label_id").withColumnsRenamed(back).write.csv(p, header=True)
    return TB.read_gt(fx.spark, p)


@query
def s6(fx):
    p = stage_path(fx.spark, "labels")
    fx.manifest().selectExpr("volume_id case_id", "label", "concat('d', volume_id) data_path", "concat('m', volume_id) mask_path") \
        .write.csv(p, header=True)
    return TB.read_case_labels(fx.spark, p)


@query
def s7(fx):
    p = stage_path(fx.spark, "slices")
    TB.write_slice_boxes(fx.gt_slices(), p)
    return TB.read_slice_boxes(fx.spark, p)


@query
def s8(fx):
    p = stage_path(fx.spark, "record")
    TB.write_candidates(fx.record(), p)
    return TB.read_candidates(fx.spark, p)


@query
def s9(fx):
    return TB.to_predictions(fx.record())


@query
def s10(fx):
    p = stage_path(fx.spark, "pred")
    TB.fan_out_predictions(fx.record(), "val", p)
    schema = T.StructType([*K.PREDICTIONS.fields, T.StructField("detector_of_origin", T.StringType())])
    return fx.spark.read.schema(schema).csv(p, header=True)


@query
def s11(fx):
    return TB.pair_cases(fx.paths())


@query
def s12(fx):
    p = stage_path(fx.spark, "metrics")
    m = fx.det().groupBy("volume_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"))
    TB.write_metrics(m, p)
    return fx.spark.read.schema("volume_id long, n long, top double").json(p)


@query
def s13(fx):
    p = stage_path(fx.spark, "log")
    fx.epoch_log().select(
        (F.col("run") * 100 + F.col("epoch")).alias("epoch"), F.col("cpm").alias("val_ap_2d"),
        F.create_map(F.lit("1"), F.col("ceiling")).alias("val_froc_recall")).write.json(p)
    return TB.read_epoch_log(fx.spark, p).select("epoch", "val_ap_2d", F.col("val_froc_recall")["1"].alias("recall_at_1"))


@query
def s14(fx):
    return CT.stale_fingerprints(fx.record(), "new")


@query
def s15(fx):
    p = stage_path(fx.spark, "pool")
    d = fx.det().withColumn("tag", F.concat(F.lit("t"), F.col("det_id") % 2))
    IN.ingest_new(d.where("volume_id % 3 = 0"), p)      # what an earlier run had finished
    return IN.ingest_new(d, p).groupBy("tag", "volume_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"))


@query
def s15_stream(fx):
    src, dst, ck = (stage_path(fx.spark, n) for n in ("in", "out", "ck"))
    fx.dirty().write.parquet(src)
    IN.stream_detections(fx.spark, src, dst, ck)
    return IN.committed(fx.spark, dst)


@query
def s16(fx):
    split = CT.guard_split("val")
    return fx.manifest().where(F.col("split") == split)


# ================================================================ B. projections, box functions
@query
def p1(fx):
    return B.filter_by_score(fx.det(), 0.5).select("det_id", "score")


@query
def p2(fx):
    return B.drop_degenerate(fx.dirty()).select("det_id", *B.XYXY)


@query
def p3(fx):
    return B.to_half_open(fx.gt_slices())


def _slice_storage(fx):
    return fx.gt_slices().selectExpr("volume_id", "slice_z", "component_id", "r0 min_d0", "c0 min_d1", "slice_z min_d2",
                                     "r1 max_d0", "c1 max_d1", "slice_z+3 max_d2")


@query
def p4(fx):
    return _cols(_slice_storage(fx), B.storage_to_official(), "volume_id", "slice_z", "component_id")


@query
def p5(fx):
    return _cols(fx.pred(), B.official_to_storage(), "pred_id")


@query
def p6(fx):
    d = _zoom(_slice_storage(fx))
    return _cols(d, B.iso_to_native(F.col("zoom_factors")), "volume_id", "slice_z", "component_id")


@query
def p7(fx):
    shape = F.array(800 + F.col("volume_id") % 90, 600 + F.col("volume_id") % 70, 300 + F.col("volume_id") % 50)
    d = _zoom(fx.volumes()).withColumn("iso", B.iso_shape(shape, F.col("zoom_factors")))
    return d.select("volume_id", *[F.col("zoom_factors")[i].alias(f"f{i}") for i in range(3)],
                    *[F.col("iso")[i].alias(f"n{i}") for i in range(3)])


@query
def p8(fx):
    d, g = fx.det(), B.to_half_open(fx.gt_slices())
    p = S.overlap_pairs(d, g, ["volume_id", "slice_z"], S.AXES_2D, S.CELL_2D).withColumn("iou", B.iou_2d()).where("iou > 0")
    return p.select(F.col("a_det_id").alias("det_id"), F.col("b_component_id").alias("component_id"), "iou")


@query
def p9(fx):
    p = S.overlap_pairs(S.with_corners(fx.pred()), S.with_corners(fx.gt_boxes()), ["public_id"], S.AXES_3D, S.CELL_3D)
    p = p.withColumn("iou", B.iou_3d()).where("iou > 0")
    return p.select(F.col("a_pred_id").alias("pred_id"), F.col("b_label_id").alias("label_id"), "iou")


@query
def p10(fx):
    r = fx.record()
    return r.select("cand_seq", "iou_gt", B.iou_label(F.col("iou_gt")).alias("label"))


@query
def p11(fx):
    g = fx.gt_slices()
    a, b = (S.prefixed(g.where(F.col("component_id") == k), p, ["volume_id", "slice_z"]) for k, p in ((0, "a_"), (1, "b_")))
    return a.join(b, ["volume_id", "slice_z"]).select("volume_id", "slice_z", B.box_gap().alias("gap"))


@query
def p12(fx):
    return _cols(fx.det(), B.measures_2d(), "det_id").join(
        fx.pred().select(F.col("pred_id").alias("det_id"), B.diag_3d().alias("diag_3d")), "det_id")


@query
def p13(fx):
    return fx.record().select("cand_seq", B.anisotropy().alias("anisotropy"))


@query
def p14(fx):
    return fx.base().select(F.col("e").alias("det_id"), B.clamp_prob(F.col("value") / 100.0).alias("p"))


W0, H0 = 160.0, 110.0


@query
def p15(fx):
    return B.hflip_boxes(fx.det(), W0).select("det_id", *B.XYXY)


@query
def p16(fx):
    return B.shift_boxes(fx.det(), 9.0, -31.0, H0, W0).select("det_id", *B.XYXY)


@query
def p17(fx):
    return B.scale_boxes(fx.det(), 1.25, H0, W0).select("det_id", *B.XYXY)


@query
def p18(fx):
    return B.rotate_boxes(fx.det(), 7.0, H0, W0).select("det_id", *B.XYXY)


@query
def p19(fx):
    d = fx.frames().select("volume_id", *[F.col("iso_shape")[i].alias(f"n{i}") for i in range(3)])
    ext = [F.round(F.col(f"n{i}") * s, 1) for i, s in enumerate(C.SPACING_MM)]
    return d.select("*", *[e.alias(f"ext{i}") for i, e in enumerate(ext)],
                    ((F.col("n0") >= F.col("n1")) & (F.col("n1") >= F.col("n2"))).alias("ordered"))


@query
def p20(fx):
    names = [B.bucket_name(lo, hi) for lo, hi in zip(C.SIZE_EDGES[:-1], C.SIZE_EDGES[1:])]
    d = B.to_half_open(fx.gt_slices()).select(B.size_bucket(B.measures_2d()["diag"]).alias("bucket"))
    one = d.agg(*[F.count_if(F.col("bucket") == n).alias(n) for n in names])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("bucket"), F.col(f"`{n}`").alias("n")) for n in names])))


@query
def p21(fx):
    return fx.cases().select("volume_id", B.canonical_split(F.col("split")).alias("split"))


@query
def p22(fx):
    d = fx.volumes().withColumn("path", F.concat(F.lit("/a/DATA_"), "volume_id", F.lit(".nrrd")))
    d = d.withColumn("run", F.when(F.col("volume_id") % 2 == 0, F.concat(F.lit("fold"), F.col("volume_id") % 5)).otherwise("full_seed1"))
    return d.select("volume_id", B.case_id_from_path(F.col("path")).alias("case_id"), B.run_name_fold(F.col("run")).alias("fold"),
                    B.candidate_id(F.col("run"), F.col("volume_id"), F.lit(7)).alias("candidate_id"))


@query
def p23(fx):
    v = F.col("value")
    return fx.base().select(F.col("e").alias("event_id"), B.round_up(v, 32).alias("up"),
                            B.snap_to_grid(v / 100.0, C.DESIGN_RULE["aspect_grid"]).alias("snap"))


# ================================================================ C. joins
@query
def j1(fx):
    return M.match_gt(fx.det(), fx.gt_slices())


@query
def j2(fx):
    return M.fire_rate(fx.det(), fx.gt_slices(), 0.5)


@query
def j3(fx):
    return M.match_predictions(fx.pred(), fx.gt_boxes()).select("pred_id", "hit_label", "max_iou")


@query
def j4(fx):
    return L.link_edges(fx.det(), 0.3, 1).select(F.col("a_det_id").alias("a"), F.col("b_det_id").alias("b"), "iou")


def _gt_iso(fx):
    return GR.mask_boxes_3d(fx.voxels())


@query
def j5(fx):
    return M.footprint_fire(fx.det(), _gt_iso(fx))


@query
def j6(fx):
    return TB.pair_cases(fx.paths()).where("problem = 'unmatched'").select("case_id", "data", "mask")


@query
def j7(fx):
    return CT.unknown_volumes(fx.pred(), fx.gt_gaps())


@query
def j8(fx):
    d = CA.detectors(fx.spark)
    return CA.stack(*[CA.route(fx.manifest(), d, s, allow_test=True) for s in ("train", "val", "test")])


@query
def j8_train(fx):
    return CA.train_volumes(fx.manifest(), "fold", 2)


@query
def j9(fx):
    box = _cols(_gt_iso(fx), B.storage_to_official(), F.col("volume_id").alias("public_id"))
    return CT.box_residuals(box, fx.gt_boxes(), BOX3)


@query
def j10(fx):
    return GR.nearest_neighbour(fx.record(), ["label"]).select("cand_seq", "nn_dist")


@query
def j11(fx):
    return CA.adaptive_assign(fx.anchor_gt(), fx.anchors(), 3)


@query
def j12(fx):
    return CA.coverage_summary(CA.anchor_coverage(fx.anchor_gt(), fx.anchors(), 0.2))


@query
def j13(fx):
    return CA.neighbour_rows(fx.slice_stats(), fx.meta(), ["n", "top"]).na.fill(0, ["n"])


@query
def j14(fx):
    p = TB.to_predictions(fx.record()).withColumn(
        "probability", F.when(F.col("public_id") % 5 == 0, F.col("probability") / 2).otherwise(F.col("probability")))
    renamed = F.when(F.col("public_id") % 11 == 0, F.concat("candidate_id", F.lit("x"))).otherwise(F.col("candidate_id"))
    return CT.check_alignment(fx.record(), p.withColumn("candidate_id", renamed))


@query
def j15(fx):
    return CA.enumerate_slices(fx.meta(), fx.gt_slices())


# ================================================================ D. aggregations
def _tube(fx):
    return L.tube_features(fx.members(), _native(fx))


def _native(fx):
    return fx.meta()


@query
def a1(fx):
    return fx.members().groupBy("volume_id", "tube_id").agg(*L.score_stats())


@query
def a2(fx):
    return L.step_lengths(fx.members()).groupBy("volume_id", "tube_id").agg(*L.geometry_stats())


@query
def a3(fx):
    return _tube(fx).select("volume_id", "tube_id", *B.STORAGE, *[f"{n}_d{i}" for n in ("cen", "ext") for i in range(3)])


@query
def a4(fx):
    return _tube(fx).select("volume_id", "tube_id", *BOX3)


@query
def a5(fx):
    return _gt_iso(fx)


@query
def a6(fx):
    return GR.mask_boxes_2d(fx.voxels())


@query
def a7(fx):
    return CA.gt_consistency(fx.gt_slices(), fx.gt_boxes(), fx.meta())


def _scored(fx):
    return M.best_iou_per_row(fx.pred().withColumn("score_max", F.col("probability")), "pred_id", fx.gt_boxes())


def _all_volumes(fx):
    return fx.gt_boxes().select("public_id").distinct()


@query
def a8(fx):
    return ST.linked_recall(_scored(fx), _all_volumes(fx))


@query
def a9(fx):
    return M.recall_breakdown(M.match_gt(fx.det(), fx.gt_slices()), M.fired_slices(fx.det(), fx.gt_slices(), C.DIAG_SCORE))


@query
def a10(fx):
    return M.hit_slice_counts(M.match_gt(fx.det(), fx.gt_slices()), fx.volumes())


@query
def a11(fx):
    return M.missed_volumes(M.match_gt(fx.det(), fx.gt_slices()), M.fired_slices(fx.det(), fx.gt_slices()))


@query
def a12(fx):
    return M.recall_at_least(M.match_gt(fx.det(), fx.gt_slices()))


@query
def a13(fx):
    d = _scored(fx).withColumn("is_tp", F.col("iou_gt") > C.HIT_IOU).withColumn("box_diag", B.diag_3d())
    return ST.percentile_summary(d, ["score_max", "box_diag"], ["is_tp"])


@query
def a14(fx):
    return ST.separability(_scored(fx).withColumn("is_tp", F.col("iou_gt") > C.HIT_IOU))


@query
def a15(fx):
    d = fx.record().where("label <> 'ignore'").withColumn("is_fp", F.col("label") == "neg").withColumn("anisotropy", B.anisotropy())
    return ST.cliffs_delta(d, "anisotropy", "is_fp")


@query
def a16(fx):
    return RP.fp_structure(fx.record())


@query
def a17(fx):
    s = ST.train_stats(fx.frames(), fx.gt_slices(), fx.manifest())
    pcts = ["box_h_pct", "box_w_pct", "diag_pct", "aspect_pct"]
    return s.select(*[c for c in s.columns if c not in pcts],
                    *[F.col(c)[i].alias(f"{c}_{q}") for c in pcts for i, q in enumerate(C.DESIGN_PERCENTILES)])


@query
def a18(fx):
    return ST.pooled_intensity(fx.slice_stats(), None)


@query
def a18_sample(fx):
    return ST.pooled_intensity(fx.slice_stats(), 1000, 3)


@query
def a19(fx):
    d = ST.derive_constants(ST.train_stats(fx.frames(), fx.gt_slices(), fx.manifest()))
    return d.select("min_size", "max_size", F.array_join(F.col("anchor_base_sizes").cast("array<string>"), ",").alias("bases"),
                    F.array_join(F.transform("anchor_aspect_ratios", lambda x: F.format_number(x, 2)), ",").alias("aspects"))


@query
def a20(fx):
    return ST.derive_link_caps(fx.gt_slices())


@query
def a21(fx):
    return ST.component_audit(GR.component_sizes(fx.voxels()), 3000)


@query
def a22(fx):
    return ST.gate_summary(CA.gt_consistency(fx.gt_slices(), fx.gt_boxes(), fx.meta()), "recon_iou")


@query
def a23(fx):
    return ST.balance(fx.manifest()).withColumn("fold", F.col("fold").cast("string"))


@query
def a23_slices(fx):
    return ST.slice_balance(CA.enumerate_slices(fx.meta(), fx.gt_slices()), fx.manifest())


@query
def a23_labels(fx):
    return ST.label_balance(fx.record())


@query
def a24(fx):
    return ST.over_seeds(fx.epoch_log(), ["epoch"], ["cpm", "ceiling"])


@query
def a25(fx):
    return ST.membership_hash(fx.manifest(), ["volume_id", "split", "fold", "label"])


@query
def a26(fx):
    return GR.cluster_redundancy(fx.record(), C.CLUSTER_RADIUS, ["public_id"])


@query
def a27(fx):
    return ST.slice_total(fx.frames())


# ================================================================ E. windows
@query
def w1(fx):
    r = fx.record().drop("rank", "rank_norm")
    return R.rank_candidates(r).select("candidate_id", "rank", "rank_norm")


@query
def w2(fx):
    r = fx.record().drop("cand_seq")
    order = [F.col("public_id"), F.col("score_max").desc(), F.col("tube_id")]
    return R.number_candidates(r, order).select("tube_id", "detector_of_origin", "cand_seq")


@query
def w3(fx):
    return M.average_precision(M.greedy_match(fx.det(), fx.gt_slices()), fx.gt_slices())


@query
def w4(fx):
    n = ST.slice_total(fx.meta()).select("n_slices")
    return M.recall_at_budgets(M.greedy_match(fx.det(), fx.gt_slices()), fx.gt_slices(), n)


@query
def w5(fx):
    return L.step_lengths(fx.members()).select("det_id", "tube_id", "step")


@query
def w6(fx):
    d = fx.epoch_log().selectExpr("run", "epoch/100.0D thresh", "ceiling recall")
    return R.monotonicity_violations(d, ["run"])


@query
def w7(fx):
    return R.stratified_folds(fx.manifest().drop("fold")).select("volume_id", "label", "fold")


@query
def w8(fx):
    return M.annotate_slices(fx.det(), fx.gt_slices(), 2)


@query
def w9(fx):
    return M.cap_per_slice(fx.det(), 3).select("volume_id", "slice_z", "det_id", "score")


@query
def w10(fx):
    return FR.recall_at_fp(FR.froc_curve(fx.gt_boxes(), fx.pred()))


# ================================================================ F. selection rules
@query
def k1(fx):
    return R.select_epoch(fx.epoch_log(), 3, 0.02, ["run"])


@query
def k1_legacy(fx):
    return R.select_epoch(fx.epoch_log().drop("ceiling"), 3, 0.0, ["run"])


@query
def k2(fx):
    return R.selection_stability(fx.epoch_log(), 3, 3, ["run"])


def _op_table(fx):
    """A metric row per score threshold, straight from the detections."""
    cuts = [0.05, 0.1, 0.2, 0.4, 0.6, 0.8]
    one = fx.det().agg(*[F.count_if(F.col("score") >= t).alias(f"c{i}") for i, t in enumerate(cuts)], F.count(F.lit(1)).alias("n"))
    rows = F.array(*[F.struct(F.lit(t).alias("thresh"), F.lit(f"t={t}").alias("config"), F.lit(f"m{i}").alias("method"),
                              (F.col(f"c{i}") / F.col("n")).alias("recall"), (F.col(f"c{i}") % 97 / 97).alias("cpm"),
                              F.col(f"c{i}").cast("double").alias("pool_mean"), F.col(f"c{i}").alias("pool_max"))
                     for i, t in enumerate(cuts)])
    return one.select(F.inline(rows))


@query
def k3(fx):
    return R.choose_operating_point(_op_table(fx), 0.5).select("thresh", "recall", "cpm", "pool_mean")


@query
def k4(fx):
    t = _op_table(fx)
    top = t.agg(F.max("pool_max")).scalar()
    return R.cheapest_config(t.withColumn("pool_max", F.col("pool_max") / top), 0.3, 0.7)


@query
def k5(fx):
    t = _op_table(fx)
    top = t.agg(F.max("pool_mean")).scalar()
    return R.best_dedup(t.withColumn("pool_mean", F.col("pool_mean") / top), 0.7, 0.3)


@query
def k6(fx):
    return R.recall_knee(_op_table(fx), 0.5).select("thresh", "recall")


@query
def k7(fx):
    return R.sample_epoch(CA.enumerate_slices(fx.meta(), fx.gt_slices()), 1, 5, 2)


# ================================================================ G. set operations
@query
def u1(fx):
    d = fx.det().select("det_id", "score")
    return CA.stack(*[d.withColumn("detector", F.lit(f"full_seed{s}")) for s in C.FULL_SEEDS])


@query
def u2(fx):
    return CT.key_differences(fx.pred(), fx.gt_boxes(), ["public_id"])


@query
def u3(fx):
    g = fx.gt_slices().selectExpr("volume_id + case when volume_id % 13 = 0 then 3000000 else 0 end volume_id", "slice_z")
    return CT.key_differences(g, fx.voxels().selectExpr("volume_id", "d2 slice_z"), ["volume_id", "slice_z"])


@query
def u4(fx):
    s = _scored(fx)
    pool = P.union_all([s.where(F.col("score_max") >= t).withColumn("config", F.lit(f"c{i}")) for i, t in enumerate((0.6, 0.4, 0.1))])
    return SW.target_flags(pool, _all_volumes(fx), "c0", ["c0", "c1", "c2"])


# ================================================================ H. greedy and graph operators
def _linked(fx):
    return L.link_tubes(B.filter_by_score(fx.det(), LINK.op_score), LINK)


@query
def g1(fx):
    return _linked(fx)


@query
def g1_large(fx):
    """Every volume taken as too large for one task: by windows."""
    return L.link_tubes(B.filter_by_score(fx.det(), LINK.op_score), LINK, limit=0)


@query
def g2(fx):
    return G.containment_suppress(fx.det(), 0.8).select("det_id")


def _boxes3(fx):
    return fx.pred().withColumnsRenamed({"pred_id": "cand_seq", "probability": "score_max"})


@query
def g3(fx):
    return G.nms_3d(_boxes3(fx), 0.3).select("cand_seq")


@query
def g4(fx):
    return G.dedup_by_distance(fx.record(), 8.0, "slice_count").select("cand_seq")


@query
def g5(fx):
    return GR.single_linkage(fx.record(), 6.0, ["public_id"])


@query
def g5_large(fx):
    """Every volume by the form without groups."""
    return GR.single_linkage(fx.record(), 6.0, ["public_id"], limit=0)


@query
def g6(fx):
    return M.greedy_match(fx.det(), fx.gt_slices()).select("det_id", "is_tp")


@query
def g7(fx):
    return G.nms_2d(fx.det(), 0.3).select("det_id")


# the distributed forms on the whole tables
@query
def g2_large(fx):
    return G.containment_suppress(fx.det(), 0.8, limit=0).select("det_id")


@query
def g3_large(fx):
    return G.nms_3d(_boxes3(fx), 0.3, limit=0).select("cand_seq")


@query
def g4_large(fx):
    return G.dedup_by_distance(fx.record(), 8.0, "slice_count", limit=0).select("cand_seq")


@query
def g7_large(fx):
    return G.nms_2d(fx.det(), 0.3, limit=0).select("det_id")


@query
def w1_large(fx):
    return R.rank_candidates(fx.record().drop("rank", "rank_norm"), limit=0).select("candidate_id", "rank", "rank_norm")


@query
def g8(fx):
    return GR.slice_labels(fx.voxels())


@query
def g9(fx):
    return GR.component_sizes(fx.voxels()).select("volume_id", "n_voxels")


@query
def g10(fx):
    return GR.regrid_mask(fx.voxels(), fx.meta()).groupBy("volume_id", "d2").agg(
        F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("d0", "d1") for n, f in (("min", F.min), ("max", F.max), ("sum", F.sum))])


# ================================================================ I. composites
@query
def e1(fx):
    return FR.froc_curve(fx.gt_boxes(), CT.assert_known_volumes(fx.pred(), fx.gt_boxes()))


@query
def e2(fx):
    return FR.froc_summary(FR.froc_curve(fx.gt_boxes(), fx.pred())).select(
        "cpm", "ceiling", "fp_at_ceiling", *[F.col("key_recall")[F.lit(k)].alias(f"r{i}") for i, k in enumerate(C.KEY_FP)])


@query
def e3(fx):
    return FR.bootstrap_cpm(fx.gt_boxes(), fx.pred(), 1000, 0)


def _meta(fx):
    return materialize(fx.meta())


GRID = SW.one_at_a_time(LINK, {"link_iou": (0.2, 0.4), "min_tube_len": (2,), "containment": (0.8,), "nms_iou": (0.3,),
                               "score_floor": (0.3,), "max_tube_zspan": (4,)})


@query
def e4(fx):
    return SW.sweep(fx.det(), fx.meta(), fx.gt_boxes(), GRID)


def _detectors_det(fx, split):
    """Each detector's own detections: seeds see the same boxes with their own scores."""
    r = CA.route(fx.manifest(), CA.detectors(fx.spark), split)
    d = fx.det().join(r.select("volume_id", "detector_of_origin"), "volume_id")
    seed = F.coalesce(F.regexp_extract("detector_of_origin", r"seed(\d)", 1).try_cast("long"), F.lit(0))
    return d.withColumn("score", F.col("score") * (1.0 - 0.125 * seed)), r


@query
def e5(fx):
    d, r = _detectors_det(fx, "val")
    return CA.generate_candidates(d, fx.gt_boxes(), fx.meta(), r, LINK).drop("cand_seq", "tube_id")


@query
def e5_train(fx):
    d, r = _detectors_det(fx, "train")
    return CA.generate_candidates(d, fx.gt_boxes(), fx.meta(), r, LINK.but(nms_iou=0.3)).drop("cand_seq", "tube_id")


def _frame(fx):
    pool = materialize(CA.tube_pool(fx.det(), fx.meta(), LINK))
    return CA.candidate_frame(pool, fx.gt_boxes(), _gt_iso(fx))


@query
def e6(fx):
    return _frame(fx)


@query
def e7(fx):
    return ST.score_floor_sweep(_scored(fx), _all_volumes(fx))


@query
def e8(fx):
    return RP.attribute_misses(fx.det(), fx.meta(), fx.gt_boxes(), fx.gt_slices(), LINK)


@query
def e8_counts(fx):
    return RP.miss_counts(RP.attribute_misses(fx.det(), fx.meta(), fx.gt_boxes(), fx.gt_slices(), LINK))


@query
def e9(fx):
    return M.detector_coverage(fx.det(), fx.gt_slices(), 0.1)


@query
def e10(fx):
    return RP.missed_verdict(_frame(fx), fx.det(), _gt_iso(fx), LINK.op_score)


def _epochs(fx):
    e = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))
    d = fx.det().withColumn("epoch", e)
    return d.withColumn("score", F.when((F.col("det_id") + F.col("epoch")) % 5 == 0, F.col("score") * 0.25).otherwise(F.col("score")))


@query
def e11(fx):
    m = materialize(SW.evaluate_epochs(_epochs(fx), fx.meta(), fx.gt_boxes(), LINK, range(5)))
    pick = R.select_epoch(m, 1, C.SELECT_CPM_TOL).select("epoch", F.lit(True).alias("selected"))
    return m.join(pick, "epoch", "left").na.fill(False, ["selected"])


THRESH = C.SCORE_THRESHOLDS


def _seeds(fx):
    d = fx.det().withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    return d.withColumn("score", F.col("score") * (1.0 - 0.125 * F.col("seed")))


@query
def e12(fx):
    rows, agg = SW.calibrate(_seeds(fx), fx.meta(), fx.gt_boxes(), LINK, THRESH, (0, 1, 2))
    agg = materialize(agg)
    t = agg.selectExpr("thresh", "recall_mean recall", "cpm_mean cpm", "pool_mean_mean pool_mean")
    pick = R.choose_operating_point(t).select("thresh", F.lit(True).alias("chosen"))
    drops = R.monotonicity_violations(t).select(F.col("thresh_lo").alias("thresh"), F.lit(True).alias("recall_dropped"))
    return agg.join(pick, "thresh", "left").join(drops, "thresh", "left").na.fill(False, ["chosen", "recall_dropped"])


def _ladder(fx, n_boot=0):
    names = fx.spark.createDataFrame([(f"full_seed{s}",) for s in C.FULL_SEEDS], "detector_of_origin string")
    p = fx.pred().withColumn("detector_of_origin", F.concat(F.lit("full_seed"), (F.col("pred_id") % 3).cast("string")))
    return RP.baseline_ladder(fx.gt_boxes(), p, names, n_boot)


@query
def e13(fx):
    return _ladder(fx, 1000)


@query
def e13_seeds(fx):
    d = _ladder(fx).withColumn("k", F.lit("all"))
    return ST.over_seeds(d, ["k"], ["cpm", "ceiling"])


@query
def e14(fx):
    pool = M.best_iou_per_row(CA.tube_pool(fx.det(), fx.meta(), LINK), "tube_id", fx.gt_boxes())
    return RP.dedup_whatif(pool, fx.gt_boxes(), fx.meta(), (0.3,), ("slice_count", "score_max"), (6.0,))


@query
def e15(fx):
    return RP.tube_report(_frame(fx))


@query
def e16(fx):
    return RP.detection_report(fx.det(), fx.gt_slices(), fx.volumes())


@query
def e17(fx):
    rec = CA.gt_consistency(fx.gt_slices(), fx.gt_boxes(), fx.meta())
    return RP.diagnostics_report(_frame(fx), fx.det(), _gt_iso(fx), rec, LINK.op_score)


@query
def e18(fx):
    m = materialize(SW.threshold_probe(fx.det(), fx.meta(), fx.gt_boxes(), LINK, THRESH))
    knee = R.recall_knee(m).select("thresh", F.lit(True).alias("is_knee"))
    return m.join(knee, "thresh", "left").na.fill(False, ["is_knee"])


@query
def e19(fx):
    caps = ST.derive_link_caps(fx.gt_slices())
    pinned = fx.gt_slices().agg((F.max("slice_z") * 2).alias("z"), F.max(F.col("c1") - F.col("c0")).alias("w"))
    long = lambda d, z, w: d.select(F.inline(F.array(
        F.struct(F.lit("max_tube_zspan").alias("name"), F.col(z).cast("double").alias("value")),
        F.struct(F.lit("max_centroid_drift").alias("name"), F.col(w).cast("double").alias("value")))))
    return ST.reconcile_constants(long(caps, "max_tube_zspan", "max_centroid_drift"), long(pinned, "z", "w"), 5.0)
