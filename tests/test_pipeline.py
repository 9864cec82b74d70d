"""Metrics, selection rules, contracts, sources and the whole pipeline."""
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import naive as N
from conftest import SF
from tubelens import schemas as K
from tubelens.config import KEY_FP, LinkConfig
from tubelens.functions import boxes as B
from tubelens.operators import ranking as R
from tubelens.plans import candidates as CA
from tubelens.plans import froc as FR
from tubelens.plans import stats as ST
from tubelens.plans import sweeps as SW
from tubelens.plans.fixtures import Fixtures
from tubelens.session import stage_path
from tubelens.sources import contracts as CT
from tubelens.sources import tables as TB
from tubelens.streaming import ingest as IN

GT = "public_id long, label_id long, coordX double, coordY double, coordZ double, x_length double, y_length double, z_length double"
PRED = GT.replace("label_id", "pred_id") + ", probability double"


def gt_frame(spark):
    return spark.createDataFrame([(v, 1, 50.0 + 100 * v, 50.0, 50.0, 10.0, 10.0, 10.0) for v in range(3)], GT)


def pred_frame(spark, shifts, prob=0.9):
    rows = [(v, i, 50.0 + 100 * v + s, 50.0, 50.0, 10.0, 10.0, 10.0, prob) for i, (v, s) in enumerate(shifts)]
    return spark.createDataFrame(rows, PRED)


def summary(gt, pred):
    return FR.froc_summary(FR.froc_curve(gt, pred)).first()


def test_froc_golden(spark):
    gt = gt_frame(spark)
    near, far = -3.0, 7.5                                                      # IoU 7/13 and 1/7
    assert summary(gt, pred_frame(spark, [(2, near), (0, 0.5), (1, near)]))["cpm"] == pytest.approx(1.0)
    one = summary(gt, pred_frame(spark, [(0, far), (1, near), (2, -far), (2, far)]))
    assert one["ceiling"] == pytest.approx(1 / 3) and one["fp_at_ceiling"] == pytest.approx(3 / 3)
    assert set(one["key_recall"]) == set(KEY_FP)
    lost = summary(gt, pred_frame(spark, [(1, far), (2, far)]))
    assert lost["ceiling"] == pytest.approx(0.0, abs=1e-6)
    often = summary(gt, pred_frame(spark, [(2, near), (2, 0.25), (2, 1.5), (1, 2.0)]))  # further hits of a lesion are neither TP nor FP
    assert often["ceiling"] == pytest.approx(2 / 3) and often["fp_at_ceiling"] == pytest.approx(0.0, abs=1e-6)


def test_threshold_bins_are_exact(spark):
    rows = [(i, i * 0.005) for i in range(200)] + [(i, i * 0.005 + 0.004) for i in range(200)] + [(199, 0.999999)]
    df = spark.createDataFrame(rows, "want int, p double").withColumn("got", FR.threshold_bin(F.col("p")))
    assert df.where("want <> got").count() == 0


def test_bootstrap_is_seeded_and_partition_free(spark):
    fx = Fixtures(spark, SF)
    a = FR.bootstrap_cpm(fx.gt_boxes(), fx.pred(), 20, 3).first()
    b = FR.bootstrap_cpm(fx.gt_boxes().repartition(5), fx.pred().repartition(9), 20, 3).first()
    assert a == b and a["lo"] <= a["point"] <= a["hi"]


def test_fixture_reference_values(spark):
    fx = Fixtures(spark, SF)
    assert (fx.det().count(), fx.gt_slices().count(), fx.gt_boxes().count()) == (1000, 190, 24)


def test_select_epoch(spark):
    rows = [(2, 0.97, 0.99), (5, 0.60, 0.91), (7, 0.631, 0.62), (9, float("nan"), 0.95), (12, 0.64, 0.55), (14, 0.625, 0.62)]
    df = spark.createDataFrame(rows, "epoch long, cpm double, ceiling double")
    assert R.select_epoch(df, 3, 0.03).first()["epoch"] == 7       # 5 is too far below, 14 ties with 7 and is later
    assert R.select_epoch(df, 3, 0.05).first()["epoch"] == 5
    assert R.select_epoch(df.drop("ceiling"), 3).first()["epoch"] == 12
    nan = df.withColumn("cpm", F.lit(float("nan")))
    assert R.select_epoch(nan, 3, 0.03).first()["epoch"] == 14
    assert R.selection_stability(df, 3, 2).first()["spread"] == pytest.approx(0.64 - 0.631)
    two = df.withColumn("run", F.lit(1)).unionByName(df.where("epoch < 3").withColumn("run", F.lit(2)))
    for late in (R.select_epoch(df, 15), R.select_epoch(df.limit(0), 3), R.select_epoch(two, 3, by=["run"])):
        with pytest.raises(Exception, match="no epoch from"):
            late.collect()


def test_monotonicity_and_operating_point(spark):
    df = spark.createDataFrame([(0.5, 0.4, 0.3, 10.0), (0.3, 0.8, 0.4, 20.0), (0.1, 0.7, 0.4, 15.0)],
                               "thresh double, recall double, cpm double, pool_mean double")
    v = R.monotonicity_violations(df).collect()
    assert [(r["thresh_hi"], r["thresh_lo"]) for r in v] == [(0.3, 0.1)]
    assert R.choose_operating_point(df, 0.8).first()["thresh"] == 0.1
    assert R.recall_knee(df, 0.98).first()["thresh"] == 0.3


def test_folds_are_balanced(spark):
    df = spark.range(103).select(F.col("id").alias("volume_id"), F.when(F.col("id") % 3 == 0, "B").otherwise("M").alias("label"))
    f = R.stratified_folds(df, 5, 0)
    n = f.groupBy("label", "fold").count().groupBy("label").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r["d"] <= 1 for r in n)
    assert sorted(f.collect()) == sorted(R.stratified_folds(df.repartition(17), 5, 0).collect())


def test_epoch_sample(spark):
    fx = Fixtures(spark, SF)
    s = CA.enumerate_slices(fx.meta(), fx.gt_slices())
    a = R.sample_epoch(s, 0, 1, 0)
    assert a.where("not is_lesion").count() == 0
    assert a.count() == s.where("is_lesion").count()


def test_contracts(spark):
    fx = Fixtures(spark, SF)
    assert CT.validate(fx.det(), K.DETECTIONS).columns == [f.name for f in K.DETECTIONS]
    with pytest.raises(ValueError, match="x_order"):
        CT.validate(fx.dirty(), K.DETECTIONS)
    with pytest.raises(Exception, match="contract violation"):
        CT.validate(fx.dirty(), K.DETECTIONS, "lazy").collect()
    with pytest.raises(ValueError, match="missing"):
        CT.validate(fx.det().drop("score"), K.DETECTIONS)
    with pytest.raises(TypeError):
        CT.validate(fx.det().withColumn("score", F.lit("a")), K.DETECTIONS)
    good, bad = CT.validate(fx.dirty(), K.DETECTIONS, "split")
    assert (good.count(), bad.count()) == (600, 400)
    with pytest.raises(ValueError, match="without ground truth"):
        CT.assert_known_volumes(fx.pred(), fx.gt_boxes().where("public_id > 5"))
    with pytest.raises(ValueError, match="another configuration"):
        CT.assert_fingerprint(fx.record(), "new")
    with pytest.raises(PermissionError):
        CT.guard_split("test")
    assert CT.guard_split("test", allow_test=True) == "test"
    assert CT.fingerprint({"a": 1, "b": 2}) == CT.fingerprint({"b": 2, "a": 1})
    with pytest.raises(ValueError):
        CT.assert_same_keys(fx.pred(), fx.gt_boxes(), ["public_id"])
    with pytest.raises(Exception, match="unknown split"):
        fx.volumes().select(B.canonical_split(F.lit("Tset"))).collect()
    with pytest.raises(ValueError):
        TB.to_predictions(fx.record().withColumn("score_max", F.lit(1.0)), mode="fail")


def test_tables_round_trip(spark):
    fx = Fixtures(spark, SF)
    p = stage_path(spark, "t")
    TB.write_detections(fx.det(), p, csv_mirror=True)
    assert sorted(TB.read_detections(spark, p).collect()) == sorted(TB.read_detections(spark, p + ".csv").collect())
    q = stage_path(spark, "c")
    TB.write_candidates(fx.record(), q)
    assert TB.read_candidates(spark, q).columns == [f.name for f in K.CANDIDATES]
    plan = TB.read_candidates(spark, q).where("split = 'val'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    e = K.empty(spark, K.DETECTIONS)
    assert e.count() == 0 and e.schema == K.DETECTIONS


def test_discovery(spark, tmp_path):
    for kind in ("DATA", "MASK"):
        for i in (1, 2):
            (tmp_path / kind / "x").mkdir(parents=True, exist_ok=True)
            (tmp_path / kind / "x" / f"{kind}_{i:03d}.nrrd").write_bytes(b"n")
    assert sorted(r["case_id"] for r in TB.discover_cases(spark, str(tmp_path)).collect()) == [1, 2]
    (tmp_path / "MASK" / "MASK_007.nrrd").write_bytes(b"n")
    with pytest.raises(ValueError, match="7: unmatched"):
        TB.discover_cases(spark, str(tmp_path))
    (tmp_path / "DATA" / "DATA_007.nrrd").write_bytes(b"n")
    (tmp_path / "DATA" / "y").mkdir()
    (tmp_path / "DATA" / "y" / "DATA_007.nrrd").write_bytes(b"n")
    with pytest.raises(ValueError, match="7: duplicate"):
        TB.discover_cases(spark, str(tmp_path))


def test_read_meta(spark, tmp_path):
    doc = {"volume_id": 3, "native_shape": [4, 5, 6], "iso_shape": [1, 2, 7], "spacing_storage_mm": [0.073, 0.2, 0.475674],
           "iso_spacing_mm": 0.4, "zoom_factors": [0.1825, 0.5, 1.189185], "inverse_affine": {"formula": "x", "f": [1.0, 2.0, 3.0]}}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    r = TB.read_meta(spark, str(tmp_path)).first()
    assert r["zoom_factors"] == [0.1825, 0.5, 1.189185] and r["inverse_affine"]["f"][2] == 3.0


def test_stream_takes_each_file_once(spark):
    fx = Fixtures(spark, SF)
    src, dst, ck = (stage_path(spark, n) for n in ("in", "out", "ck"))
    fx.det().where("det_id < 400").write.parquet(src)
    IN.stream_detections(spark, src, dst, ck)
    IN.stream_detections(spark, src, dst, ck)
    assert spark.read.parquet(dst).count() == 400
    fx.dirty().where("det_id >= 400").write.mode("append").parquet(src)
    IN.stream_detections(spark, src, dst, ck)
    assert spark.read.parquet(dst).count() == 400 + 360
    assert spark.read.parquet(dst + "_rejected").count() == 240
    assert IN.committed(spark, dst).count() == 760 and IN.unfinished(spark, dst) == []


def _keyed(spark):
    return Fixtures(spark, SF).det().withColumn("tag", F.when(F.col("det_id") % 3 > 0, F.concat(F.lit("t"), F.col("det_id") % 2)))


def _stop_at(monkeypatch, name, call):
    """``IN.<name>`` raises at its n-th call, as when a run ends there."""
    inner, calls = getattr(IN, name), []

    def stops(*a, **k):
        calls.append(1)
        if len(calls) == call:
            raise RuntimeError("the run ends here")
        return inner(*a, **k)

    monkeypatch.setattr(IN, name, stops)


def test_ingest_takes_each_key_once(spark):
    """Also NULL keys, which are keys like others."""
    d, p = _keyed(spark), stage_path(spark, "pool")
    first = d.where("volume_id % 3 = 0 and det_id < 300")
    assert IN.ingest_new(first, p).count() == first.count()
    got = IN.ingest_new(d, p, steps=3)
    late = d.join(first.select("tag", "volume_id").distinct().withColumnsRenamed({"tag": "t", "volume_id": "v"}),
                  F.col("tag").eqNullSafe(F.col("t")) & (F.col("volume_id") == F.col("v")), "left_anti")
    assert got.count() == first.count() + late.count() and got.select("det_id").distinct().count() == got.count()
    assert IN.ingest_new(d, p).count() == got.count() and IN.ingest_new(d.limit(0), p).count() == got.count()


@pytest.mark.parametrize("name,call", [("_write", 2), ("_mark", 1), ("_mark", 2)])
def test_ingest_after_a_run_that_ended(spark, monkeypatch, name, call):
    """Rows written but not marked are not seen, and their keys are taken up again."""
    d, p = _keyed(spark), stage_path(spark, "pool")
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        _stop_at(m, name, call)
        IN.ingest_new(d, p, steps=2)
    seen = IN.committed(spark, p, d.schema).count()
    assert (seen == 0) == (call == 1 or name == "_write") and seen < d.count()
    assert len(IN.unfinished(spark, p)) == 1
    got = IN.ingest_new(d, p)
    assert sorted(got.collect(), key=str) == sorted(d.collect(), key=str)


def test_stream_that_ends_between_its_sinks(spark, monkeypatch):
    fx = Fixtures(spark, SF)
    src, dst, ck = (stage_path(spark, n) for n in ("in", "out", "ck"))
    fx.dirty().write.parquet(src)
    with monkeypatch.context() as m, pytest.raises(Exception):
        _stop_at(m, "_write", 2)
        IN.stream_detections(spark, src, dst, ck)
    assert IN.committed(spark, dst).count() == 0 and len(IN.unfinished(spark, dst)) == 1
    IN.stream_detections(spark, src, dst, ck)
    IN.stream_detections(spark, src, dst, ck)
    bad = fx.dirty().where("not (x1 < x2 and y1 < y2 and score between 0 and 1) or score is null").count()
    assert IN.committed(spark, dst).count() == fx.dirty().count() - bad
    assert spark.read.parquet(dst + "_rejected").count() == bad and IN.unfinished(spark, dst) == []


LINK = LinkConfig(min_tube_len=3, op_score=0.02, score_floor=0.0)


def test_candidates_end_to_end(spark):
    """The record agrees with brute-force tubes in members, ids and ranks, however rows are spread."""
    fx = Fixtures(spark, SF)
    r = CA.route(fx.manifest(), CA.detectors(spark), "val")
    det = fx.det().join(r.select("volume_id", "detector_of_origin"), "volume_id")
    a = CA.generate_candidates(det, fx.gt_boxes(), fx.meta(), r, LINK)
    b = CA.generate_candidates(det.repartition(11), fx.gt_boxes(), fx.meta(), r, LINK)
    rows = sorted(x.asDict()["candidate_id"] + str(sorted(x.asDict().items(), key=str)) for x in a.collect())
    assert rows == sorted(x.asDict()["candidate_id"] + str(sorted(x.asDict().items(), key=str)) for x in b.collect())
    got = [x for x in a.collect() if x["detector_of_origin"] == "full_seed1"]
    dets = [x.asDict() for x in fx.det().where("score >= 0.02").collect()]
    seq = 0
    for v in sorted({x["volume_id"] for x in r.collect()}):
        mine = {d["det_id"]: d for d in dets if d["volume_id"] == v}
        for seed, members in N.tubes(list(mine.values()), LINK).items():
            row = next(x for x in got if x["tube_id"] == seed)
            assert row["candidate_id"] == f"full_seed1:{v}:{seq}"
            assert row["slice_count"] == len(members)
            assert row["score_max"] == max(mine[m]["score"] for m in members)
            seq += 1
        mine = sorted((x for x in got if x["public_id"] == v), key=lambda x: (-x["score_max"], x["cand_seq"]))
        assert [x["rank"] for x in mine] == list(range(1, len(mine) + 1))
    assert seq == len(got)


def test_sweep_matches_single_runs(spark):
    fx = Fixtures(spark, SF)
    configs = [LINK.but(label="a"), LINK.but(label="b", score_floor=0.4), LINK.but(label="c", nms_iou=0.2, op_score=0.3)]
    got = {r["config"]: r for r in SW.sweep(fx.det(), fx.meta(), fx.gt_boxes(), configs).collect()}
    from tubelens.operators import greedy as G
    from tubelens.operators import match as M
    for c in configs:
        pool = G.nms_3d(CA.tube_pool(fx.det(), fx.meta(), c), c.nms_iou, "tube_id")
        pool = M.best_iou_per_row(pool, "tube_id", fx.gt_boxes())
        one = ST.linked_recall(pool, fx.volumes().withColumnRenamed("volume_id", "public_id")).first()
        assert all(got[c.label][k] == one[k] for k in ("recall", "n_vol", "pool_mean", "pool_median", "pool_total"))


def test_manifest(spark):
    fx = Fixtures(spark, SF)
    lab = fx.manifest().selectExpr("volume_id case_id", "label")
    m = CA.build_manifest(fx.cases(), lab)
    assert m.where("split <> 'train' and fold <> -1").count() == 0
    assert m.count() == fx.volumes().count()
    with pytest.raises(Exception, match="no label"):
        CA.build_manifest(fx.cases(), lab.where("case_id > 3")).collect()
    h = ST.membership_hash(m, ["volume_id", "fold"]).first()
    assert h == ST.membership_hash(m.repartition(9), ["volume_id", "fold"]).first()


def test_rules_travel_without_installation(spark, tmp_path):
    """A driver started elsewhere can use the package: array rules are shipped with the job."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", {os.path.join(root, '__spark_entry__.py')!r})
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", m.entry(s).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 200" in out.stdout, out.stderr[-2000:]
