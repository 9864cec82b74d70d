"""Cases behind the finding of the fourth review."""
import pytest
from pyspark.sql import functions as F

from checks.queries import LINK, _seeds
from conftest import SF
from test_operators import CONFIGS, frame, random_det
from tubelens import config as C
from tubelens.operators import link as L
from tubelens.operators import spatial as S
from tubelens.plans import sweeps as SW
from tubelens.plans.fixtures import Fixtures

STEPS = [0.5, 0.3, 0.1, 0.02]


def test_calibration_moves_a_box_once(spark, monkeypatch):
    """boxes went to the linker and tubes to ground truth once per threshold, so shuffled bytes grew with their number."""
    fx = Fixtures(spark, SF)
    det = _seeds(fx).cache()
    linked, met = [], []
    split, pairs = L.split_by_size, S.volume_pairs
    monkeypatch.setattr(L, "split_by_size", lambda df, *a: (linked.append(df.count()), split(df, *a))[1])
    monkeypatch.setattr(S, "volume_pairs", lambda df, *a: (met.append(df.count()), pairs(df, *a))[1])
    rows, _ = SW.calibrate(det, fx.meta(), fx.gt_boxes(), LINK, C.SCORE_THRESHOLDS, (0, 1, 2))
    tubes = sum(r.pool_mean for r in rows.collect()) * fx.meta().count()
    assert sum(linked) <= det.count() and sum(met) < tubes


@pytest.mark.parametrize("limit", [10_000, 10])
@pytest.mark.parametrize("cfg", CONFIGS[:2])
def test_tubes_of_thresholds(spark, cfg, limit):
    """the ranges of thresholds spread out to what each threshold links alone, also for groups linked by threshold."""
    rows = random_det(4) + [dict(r, volume_id=r["volume_id"] + 100, score=None) for r in random_det(4)[:3]]
    rows.append(dict(rows[0], det_id=9_999, volume_id=200, score=0.9))  # alone in its volume
    det = frame(spark, rows).cache()
    box = [f"{s}_d{i}" for s in ("min", "max") for i in range(3)]
    cols = ["volume_id", "tube_id", "score_max", *box]
    got = L.threshold_tubes(det, cfg, STEPS, limit=limit).withColumn("step", F.explode(F.sequence("first", "last"))).select("step", *cols)
    want = []
    for i, t in enumerate(STEPS):
        feats = L.tube_features(L.link_tubes(det.where(F.col("score") >= t), cfg.but(containment=1.0)))
        want += [(i, *r) for r in feats.select(*cols).collect()]
    assert len(want) > 10 and sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("cfg", [LINK, LINK.but(containment=0.3, nms_iou=0.1, score_floor=0.15)])
def test_calibration_is_the_sweep_of_every_seed(spark, cfg):
    """F1: recall, curve and pool by seed and threshold as from pools of their own; thresholds in any order, one that nothing reaches."""
    fx = Fixtures(spark, SF)
    thresholds = (0.05, 0.9999995, 0.2, 0.02)
    rows, _ = SW.calibrate(_seeds(fx), fx.meta(), fx.gt_boxes(), cfg, thresholds, (2, 0))
    key = lambda r: (r.seed, r.thresh)
    got = [(*key(r), *(round(r[c], 9) for c in ("recall", "cpm", "ceiling", "pool_mean"))) for r in sorted(rows.collect(), key=key)]
    want = []
    for s in (0, 2):
        m = SW.threshold_probe(_seeds(fx).where(F.col("seed") == s), fx.meta(), fx.gt_boxes(), cfg, thresholds)
        want += [(s, r.thresh, *(round(r[c], 9) for c in ("recall", "cpm", "ceiling", "pool_mean"))) for r in sorted(m.collect(), key=lambda r: r.thresh)]
    assert len(got) == 8 and got == want
