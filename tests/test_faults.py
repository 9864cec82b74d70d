"""Cases that once went wrong: each of them gave a wrong or size-dependent answer."""
import random

import pytest
from pyspark.sql import functions as F

from tubelens import config as C
from tubelens.operators import graph as GR
from tubelens.operators import greedy as G
from tubelens.operators import prefix as P
from tubelens.operators import ranking as R
from tubelens.plans import froc as FR
from tubelens.plans import stats as ST
from tubelens.sources import tables

DET = "volume_id long, slice_z int, det_id long, x1 double, y1 double, x2 double, y2 double, score double"


def boxes(spark, rows):
    return spark.createDataFrame([(1, 0, i, *map(float, r)) for i, r in enumerate(rows)], DET)


def ids(df, col="det_id"):
    return sorted(r[col] for r in df.select(col).collect())


def rounds_of(fn, monkeypatch):
    n = [0]
    real = G.materialize
    monkeypatch.setattr(G, "materialize", lambda d: (n.__setitem__(0, n[0] + 1), real(d))[1])
    out = fn()
    return out, n[0]


@pytest.mark.parametrize("shape", ["disjoint", "stacked"])
def test_large_suppression_needs_few_rounds(spark, shape, monkeypatch):
    n = 5000
    at = (lambda i: (i % 71 * 12, i // 71 * 12)) if shape == "disjoint" else (lambda i: (i % 3 * 0.1, 0))
    det = boxes(spark, [(*at(i), at(i)[0] + 10, at(i)[1] + 10, (i * 7919 % n) / n) for i in range(n)])
    kept, steps = rounds_of(lambda: ids(G.nms_2d(det, 0.5, limit=0)), monkeypatch)
    assert len(kept) == (n if shape == "disjoint" else 1) and steps <= 40
    assert kept == ids(G.nms_2d(det, 0.5))


@pytest.mark.parametrize("t", [-0.5, 0.0, 0.3, 0.5, 1.0])
def test_forms_agree_on_random_boxes(spark, t):
    rnd = random.Random(int(t * 10))
    rows = []
    for _ in range(250):
        x, y = rnd.randint(0, 90), rnd.randint(0, 90)
        rows.append((x, y, x + rnd.randint(0, 30), y + rnd.randint(0, 30), rnd.randint(0, 9) / 10))
    det = boxes(spark, rows)
    for fn in (G.nms_2d, G.containment_suppress):
        assert ids(fn(det, t, limit=0)) == ids(fn(det, t)), fn.__name__


def test_volumes_agree_at_zero(spark):
    rows = [(v, s, float(10 * s), 0.0, 0.0, 4.0, 4.0, 4.0, s / 10) for v in range(3) for s in range(3)]
    c = spark.createDataFrame(rows, "public_id long, cand_seq long, coordX double, coordY double, coordZ double, x_length double, y_length double, z_length double, score_max double")
    key = lambda d: sorted((r.public_id, r.cand_seq) for r in d.collect())
    assert key(G.nms_3d(c, 0.0)) == key(G.nms_3d(c, 0.0, limit=0)) == [(v, 2) for v in range(3)]


def test_pair_exactly_at_the_radius(spark):
    rows = [(1, 0, 2.8, 0.0, 0.0, 0.9), (1, 1, 12.8, 0.0, 0.0, 0.8), (1, 2, 22.9, 0.0, 0.0, 0.7)]
    c = spark.createDataFrame(rows, "public_id long, cand_seq long, cen_d0 double, cen_d1 double, cen_d2 double, k double")
    for limit in (0, 1000):
        assert ids(G.dedup_by_distance(c, 10.0, "k", limit=limit), "cand_seq") == [0, 2]


def test_csv_columns_go_by_name(spark, tmp_path):
    det = tables.K.empty(spark, tables.K.DETECTIONS) if hasattr(tables.K, "empty") else None
    names = tables.K.DETECTIONS.names
    row = {f.name: (float(i) if f.dataType.simpleString() in ("double", "float") else i) for i, f in enumerate(tables.K.DETECTIONS)}
    row |= {"x1": 10.0, "y1": 20.0, "x2": 30.0, "y2": 50.0, "score": 0.5}
    order = list(reversed(names))
    (tmp_path / "d.csv").write_text(",".join(order) + "\n" + ",".join(str(row[c]) for c in order) + "\n")
    got = tables.read_detections(spark, str(tmp_path / "d.csv")).first().asDict()
    assert {k: got[k] for k in ("x1", "y1", "x2", "y2", "score")} == {"x1": 10.0, "y1": 20.0, "x2": 30.0, "y2": 50.0, "score": 0.5}
    (tmp_path / "e.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="lacks"):
        tables.read_detections(spark, str(tmp_path / "e.csv"))
    (tmp_path / "l.csv").write_text("label,mask_path,data_path,case_id\nM,m,d,7\n")
    assert tuple(tables.read_case_labels(spark, str(tmp_path / "l.csv")).first()) == (7, "M")
    assert det is None or det.count() == 0


def test_null_keys_stay(spark):
    m = spark.createDataFrame([(i, None if i % 5 == 0 else "M") for i in range(20)], "volume_id long, label string")
    f = R.stratified_folds(m).collect()
    assert len(f) == 20 and sorted(r.fold for r in f if r.label is None) == [0, 1, 2, 3]
    p = P.exact_percentiles(m, ["label"], "volume_id", (50,)).collect()
    assert {r.label: (r.p50, r.n) for r in p} == {None: (7.5, 4), "M": (10.0, 16)}
    c = spark.createDataFrame([(None, 1, i, i / 4) for i in range(4)], "detector_of_origin string, public_id long, cand_seq long, score_max double")
    for limit in (0, 1000):
        assert sorted(r["rank"] for r in R.rank_candidates(c, limit=limit).collect()) == [1, 2, 3, 4]


def test_gate_needs_the_soft_share(spark):
    v = lambda xs: ST.gate_summary(spark.createDataFrame([(x,) for x in xs], "r double"), "r").first().verdict
    assert v([0.9] * 9 + [0.6]) == "PASS" and v([0.9] * 8 + [0.6, 0.6]) == "FAIL" and v([0.9] * 99 + [0.4]) == "FAIL"


def test_far_voxels_stay_apart(spark):
    vox = spark.createDataFrame([(1, 0, 0, 1 << 21), (1, 0, 1, 0), (1, 50, 50, 50)], "volume_id long, d0 long, d1 long, d2 long")
    assert sorted(r.n_voxels for r in GR.component_sizes(vox).collect()) == [1, 1, 1]


def test_draws_cover_all_volumes_evenly(spark):
    d = FR.draws(spark.range(50).selectExpr("id public_id"), 200, 1).groupBy("public_id").agg(F.sum("weight").alias("w")).collect()
    assert len(d) == 50 and sum(r.w for r in d) == 10_000 and min(r.w for r in d) > 130


def test_pooled_intensity_reads_every_slice(spark):
    n = C.DESIGN_RULE["intensity_sample_slices"] + 100
    s = spark.range(n).selectExpr("id volume_id", "0 slice_z", "1L n", "double(id) mean", "double(id*id) sumsq")
    assert ST.pooled_intensity(s).first().n_slices == n


def test_nearest_search_ends_with_odd_coordinates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", i, float(i * i), 0.0, 0.0) for i in range(6)] + [("a", 9, nan, 0.0, 0.0), ("a", 10, None, 0.0, 0.0), ("a", 11, inf, 1.0, 1.0)]
    rows += [("b", 20 + i, 1.0 + i * 1e-300, 0.0, 0.0) for i in range(50)] + [("c", 90, 5.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "label string, cand_seq long, cen_d0 double, cen_d1 double, cen_d2 double")
    got = {r.cand_seq: r.nn_dist for r in GR.nearest_neighbour(df, ["label"]).collect()}
    assert [got[i] for i in range(6)] == [1.0, 1.0, 3.0, 5.0, 7.0, 9.0] and set(got) == {*range(6), *range(20, 70)}


def test_dense_cells_link_like_points(spark):
    rnd = random.Random(6)
    rows = [(1, i, *(rnd.random() * (0.4 if i % 2 else 9.0) + (0 if i % 2 else 1) for _ in range(3))) for i in range(400)]
    df = spark.createDataFrame(rows, "public_id long, cand_seq long, cen_d0 double, cen_d1 double, cen_d2 double")
    key = lambda d: sorted((r.cand_seq, r.cluster) for r in d.collect())
    for radius in (0.3, 1.0):
        assert key(GR.single_linkage(df, radius, ["public_id"], limit=0)) == key(GR.single_linkage(df, radius, ["public_id"]))


def test_link_iou_zero_is_refused_at_every_size(spark):
    from tubelens.config import LinkConfig
    from tubelens.operators import link as L

    for limit in (0, 1000):
        with pytest.raises(ValueError, match="link_iou"):
            L.link_tubes(boxes(spark, [(0, 0, 1, 1, 0.5)]), LinkConfig(link_iou=0.0), limit=limit)


def test_calibration_and_epochs_use_containment_and_nms(spark):
    from checks.queries import LINK
    from conftest import SF
    from tubelens.plans import sweeps as SW
    from tubelens.plans.fixtures import Fixtures

    fx = Fixtures(spark, SF)
    det, meta, gt = fx.det(), fx.meta(), fx.gt_boxes()
    cfg = LINK.but(containment=0.3, nms_iou=0.1)
    pool = lambda rows: [round(r.pool_mean, 9) for r in rows.collect()]
    want = pool(SW.sweep(det, meta, gt, [cfg]))
    rows, _ = SW.calibrate(det.withColumn("seed", F.lit(0).cast("long")), meta, gt, cfg, [cfg.op_score], [0])
    assert pool(rows) == want
    assert pool(SW.evaluate_epochs(det.withColumn("epoch", F.lit(4).cast("long")), meta, gt, cfg, [4])) == want
    assert want != pool(SW.sweep(det, meta, gt, [LINK]))
