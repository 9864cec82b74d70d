"""Operators against brute force on random data, in every form they can run in."""
import random

import pytest
from pyspark.sql import functions as F

import naive as N
from tubelens import schemas as K
from tubelens.config import LinkConfig
from tubelens.operators import graph as GR
from tubelens.operators import greedy as G
from tubelens.operators import link as L
from tubelens.operators import match as M
from tubelens.operators import prefix as P
from tubelens.operators import ranking as R
from tubelens.plans import stats as ST


def random_det(seed, volumes=2, slices=9, most=6, span=40):
    rng = random.Random(seed)
    rows, n = [], 0
    for v in range(volumes):
        for z in range(slices):
            for _ in range(rng.randint(0, most)):
                x, y = rng.randint(0, span), rng.randint(0, span)
                rows.append(dict(det_id=n, volume_id=v, slice_z=z, x1=float(x), y1=float(y),
                                 x2=float(x + rng.randint(6, 24)), y2=float(y + rng.randint(6, 24)),
                                 score=rng.randint(1, 12) / 16.0))
                n += 1
    return rows


def frame(spark, rows, schema=K.DETECTIONS):
    return spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema)


def as_tubes(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["tube_id"], set()).add(r["det_id"])
    return out


CONFIGS = [LinkConfig(link_iou=0.2, min_tube_len=1, max_tube_zspan=None, max_centroid_drift=None),
           LinkConfig(link_iou=0.1, min_tube_len=2, max_tube_zspan=4, max_centroid_drift=9.0),
           LinkConfig(link_iou=0.3, max_z_gap=0, min_tube_len=2, max_tube_zspan=5, max_centroid_drift=6.0)]


@pytest.mark.parametrize("seed,cfg", list(enumerate(CONFIGS)))
def test_link_tubes(spark, seed, cfg):
    rows = random_det(seed)
    want = {}
    for v in {r["volume_id"] for r in rows}:
        want.update(N.tubes([r for r in rows if r["volume_id"] == v], cfg))
    det = frame(spark, rows)
    assert as_tubes(L.link_tubes(det, cfg)) == want
    assert as_tubes(L.link_tubes(det.repartition(13), cfg, limit=len(rows) // 2 - 5)) == want   # by components
    random.Random(seed).shuffle(rows)
    assert as_tubes(L.link_tubes(frame(spark, rows).repartition(1), cfg)) == want


def test_link_rounds(spark):
    """The form without groups, with caps that stop extensions."""
    cfg = CONFIGS[1]
    rows = random_det(5, volumes=1, slices=5, most=4)
    assert as_tubes(L._link_rounds(frame(spark, rows), cfg, ["volume_id"])) == N.tubes(rows, cfg)


@pytest.mark.parametrize("cfg", CONFIGS[1:])
def test_link_windows(spark, cfg):
    """Many windows of one component: tubes run across their edges, and a box beyond a cap just outside a window ends a tube."""
    rows, n = [], 0
    rng = random.Random(11)
    for z in range(30):
        for _ in range(14):
            x, y = rng.randint(0, 150), rng.randint(0, 60)
            rows.append(dict(det_id=n, volume_id=n % 2, slice_z=z, x1=float(x), y1=float(y), x2=float(x + rng.randint(8, 14)),
                             y2=float(y + rng.randint(8, 14)), score=rng.randint(1, 40) / 64.0))
            n += 1
    want = {}
    for v in (0, 1):
        want.update(N.tubes([r for r in rows if r["volume_id"] == v], cfg))
    report = []
    got = L._link_windows(frame(spark, rows).repartition(5), cfg, ["volume_id"], limit=150, report=report)
    assert as_tubes(got) == want and len(report) > 1
    assert L._link_windows(frame(spark, rows), cfg, ["volume_id"], limit=3) is None   # too crowded: rounds take over
    assert L._link_windows(frame(spark, []), cfg, ["volume_id"]).count() == 0


def test_link_best_match_that_breaks_a_cap_stops(spark):
    box = lambda i, z, x, s: dict(det_id=i, volume_id=0, slice_z=z, x1=x, y1=0.0, x2=x + 10.0, y2=10.0, score=s)
    rows = [box(0, 0, 0.0, 0.9), box(1, 1, 2.0, 0.5), box(2, 1, 4.0, 0.4)]
    cfg = LinkConfig(link_iou=0.1, min_tube_len=1, max_centroid_drift=1.0)
    assert as_tubes(L.link_tubes(frame(spark, rows), cfg))[0] == {0}


def test_link_configs_in_one_job(spark):
    rows = random_det(9)
    det = frame(spark, rows)
    both = det.withColumn("config_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    got = L.link_tubes(both, CONFIGS[:2], ["config_id", "volume_id"])
    for i in (0, 1):
        assert as_tubes(got.where(F.col("config_id") == i)) == as_tubes(L.link_tubes(det, CONFIGS[i]))


@pytest.mark.parametrize("limit", [10_000, 0])
def test_suppression(spark, limit):
    rows = random_det(3, volumes=2, slices=2, most=30)
    det = frame(spark, rows)
    slices = {(r["volume_id"], r["slice_z"]) for r in rows}
    of = lambda s: [r for r in rows if (r["volume_id"], r["slice_z"]) == s]

    def inside(k, r):
        w, h = min(k["x2"], r["x2"]) - max(k["x1"], r["x1"]), min(k["y2"], r["y2"]) - max(k["y1"], r["y1"])
        return max(w, 0) * max(h, 0) / ((r["x2"] - r["x1"]) * (r["y2"] - r["y1"])) >= 0.5

    ids = lambda df: {r["det_id"] for r in df.select("det_id").collect()}
    nms = set().union(*[N.keep_best(of(s), lambda r: r["score"], "det_id", lambda a, b: N.iou2(a, b) > 0.3) for s in slices])
    assert ids(G.nms_2d(det, 0.3, limit=limit)) == nms
    con = set().union(*[N.keep_best(of(s), lambda r: r["score"], "det_id", inside) for s in slices])
    assert ids(G.containment_suppress(det, 0.5, limit=limit)) == con
    assert ids(G.containment_suppress(det, 1.0)) == {r["det_id"] for r in rows}


def points(seed, n, span, step=1.0):
    rng = random.Random(seed)
    return [dict(cand_seq=i, public_id=i % 2, **{f"cen_d{d}": rng.randint(0, span) * step for d in range(3)},
                 slice_count=rng.randint(1, 5)) for i in range(n)]


COLS = ("cen_d0", "cen_d1", "cen_d2")
POINT = "cand_seq long, public_id long, cen_d0 double, cen_d1 double, cen_d2 double, slice_count long"


def point_frame(spark, rows):
    return spark.createDataFrame([(r["cand_seq"], r["public_id"], *[r[c] for c in COLS], r["slice_count"]) for r in rows], POINT)


@pytest.mark.parametrize("limit", [10_000, 0])
def test_distance_dedup(spark, limit):
    rows = points(4, 60, 12)
    want = set()
    for v in (0, 1):
        want |= N.keep_best([r for r in rows if r["public_id"] == v], lambda r: r["slice_count"], "cand_seq",
                            lambda a, b: N.dist(a, b, COLS) <= 4.0)
    got = G.dedup_by_distance(point_frame(spark, rows), 4.0, "slice_count", limit=limit)
    assert {r["cand_seq"] for r in got.collect()} == want


@pytest.mark.parametrize("limit,radius", [(10_000, 3.0), (0, 3.0), (0, 5.0)])
def test_single_linkage(spark, limit, radius):
    rows = points(6, 70, 16)
    got = {r["cand_seq"]: r["cluster"] for r in GR.single_linkage(point_frame(spark, rows), radius, ["public_id"], limit=limit).collect()}
    by_id = {r["cand_seq"]: r for r in rows}
    for v in (0, 1):
        ids = [r["cand_seq"] for r in rows if r["public_id"] == v]
        want = N.components(ids, lambda a, b: N.dist(by_id[a], by_id[b], COLS) <= radius)
        assert {i: got[i] for i in ids} == want


def test_single_linkage_meets_few_pairs(spark):
    """One dense blob beside a thin one: clusters are right; pairs of cells follow the space a blob fills, not its points."""
    rng = random.Random(4)
    blob = lambda n: [(rng.uniform(0, 3), rng.uniform(0, 3), rng.uniform(0, 3)) for _ in range(n)]
    thin = [(rng.uniform(6, 40), rng.uniform(0, 30), rng.uniform(0, 30)) for _ in range(300)]
    pts = blob(3000) + thin + [(0.5, 0.5, 0.5)] * 20 + [(4.0, 1.0, 1.0), (-50.0, 0.0, 0.0), (-51.0, 0.0, 0.0), (-52.0000001, 0.0, 0.0)]
    cols = ("cen_d0", "cen_d1", "cen_d2")
    as_frame = lambda p: spark.createDataFrame([(0, i, *map(float, x)) for i, x in enumerate(p)], "public_id long, cand_seq long, " + ", ".join(f"{c} double" for c in cols))
    few, many = [], []
    got = {r["cand_seq"]: r["cluster"] for r in GR._linkage_grid(as_frame(pts), ["public_id"], "cand_seq", cols, 1.0, few).collect()}
    assert got == {r["cand_seq"]: r["cluster"] for r in GR.single_linkage(as_frame(pts), 1.0, ["public_id"]).collect()}
    GR._linkage_grid(as_frame(pts + blob(9000)), ["public_id"], "cand_seq", cols, 1.0, many)
    assert sum(few) < 6 * len(pts) and sum(many) < 2.5 * (len(pts) + 9000)



def test_components_rounds(spark):
    rng = random.Random(8)
    pairs = {(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(30)} | {(i, i + 1) for i in range(50, 70)}
    df = spark.createDataFrame([(0, a, b) for a, b in pairs], "g long, u long, v long")
    nodes = sorted({n for p in pairs for n in p})
    want = N.components(nodes, lambda a, b: (a, b) in pairs or (b, a) in pairs)
    for limit in (1000, 0):
        got = GR.connected_components(df, ["g"], limit)
        assert sorted((r["node"], r["comp"]) for r in got.collect()) == sorted(want.items())


def test_nearest_neighbour(spark):
    rows = points(7, 50, 60, 0.5) + [dict(cand_seq=900, public_id=0, cen_d0=500.0, cen_d1=0.0, cen_d2=0.0, slice_count=1)]
    rows += [dict(rows[3], cand_seq=901, public_id=rows[3]["public_id"])]
    got = {r["cand_seq"]: r["nn_dist"] for r in GR.nearest_neighbour(point_frame(spark, rows), ["public_id"], per_cell=2).collect()}
    for r in rows:
        near = min(N.dist(r, o, COLS) for o in rows if o is not r and o["public_id"] == r["public_id"])
        assert got[r["cand_seq"]] == pytest.approx(near)


def test_voxel_components_and_slice_labels(spark):
    rng = random.Random(11)
    cells = sorted({(rng.randint(0, 14), rng.randint(0, 14), rng.randint(0, 2)) for _ in range(90)})
    vox = spark.createDataFrame([(1, *c) for c in cells], "volume_id long, d0 long, d1 long, d2 long")
    touch = lambda a, b: max(abs(x - y) for x, y in zip(a, b)) <= 1
    lab = N.components(cells, touch)
    sizes = sorted(list(lab.values()).count(c) for c in set(lab.values()))
    assert sorted(r["n_voxels"] for r in GR.component_sizes(vox).collect()) == sizes
    want = set()
    for z in range(3):
        mine = [c for c in cells if c[2] == z]
        comp = N.components(mine, touch)
        box = {}
        for c, k in comp.items():
            b = box.setdefault(k, [c[0], c[1], c[0], c[1]])
            box[k] = [min(b[0], c[0]), min(b[1], c[1]), max(b[2], c[0]), max(b[3], c[1])]
        gap = lambda a, b: (max(0, box[a][0] - box[b][2] - 1, box[b][0] - box[a][2] - 1) ** 2
                            + max(0, box[a][1] - box[b][3] - 1, box[b][1] - box[a][3] - 1) ** 2) ** 0.5
        merged = N.components(sorted(box), lambda a, b: gap(a, b) <= 1.0)
        for root in set(merged.values()):
            bs = [box[k] for k in box if merged[k] == root]
            want.add((z, min(b[0] for b in bs), min(b[1] for b in bs), max(b[2] for b in bs), max(b[3] for b in bs),
                      sum(merged[k] == root for k in comp.values())))
    got = GR.slice_labels(vox, merge_gap=1.0).collect()
    assert {(r["slice_z"], r["r0"], r["c0"], r["r1"], r["c1"], r["area"]) for r in got} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_match_and_ap(spark, seed):
    """Several overlapping lesions per slice, so that detections compete and fall back."""
    dets = random_det(seed, volumes=1, slices=4, most=14, span=18)
    rng = random.Random(seed + 100)
    gts = [dict(volume_id=0, slice_z=z, r0=r, c0=c, r1=r + 13, c1=c + 13, component_id=k)
           for z in range(5) for k in range(4) for r, c in [(rng.randint(0, 18), rng.randint(0, 18))]]
    g, d = frame(spark, gts, K.SLICE_BOXES), frame(spark, dets)
    want = N.match_greedily(dets, gts, 0.2)
    m = M.greedy_match(d, g, 0.2)
    assert {r["det_id"]: r["is_tp"] for r in m.collect()} == want
    assert M.average_precision(m, g).first()["ap"] == pytest.approx(N.average_precision(dets, want, len(gts)))
    got = {r["budget"]: r["recall"] for r in M.recall_at_budgets(m, g, spark.createDataFrame([(5,)], "n_slices long")).collect()}
    fps = tps = 0
    best = {b: 0 for b in got}
    for r in sorted(dets, key=lambda r: (-r["score"], r["det_id"])):
        tps, fps = tps + want[r["det_id"]], fps + 1 - want[r["det_id"]]
        best = {b: tps if fps <= b * 5 else v for b, v in best.items()}
    assert got == pytest.approx({b: v / len(gts) for b, v in best.items()})


def test_ap_without_ground_truth(spark):
    g = spark.createDataFrame([], K.SLICE_BOXES)
    d = frame(spark, random_det(1))
    assert M.average_precision(M.greedy_match(d, g), g).first()["ap"] == 0.0
    none = spark.createDataFrame([], K.DETECTIONS)
    assert M.average_precision(M.greedy_match(none, g), g).first()["ap"] == 1.0


def test_running_and_percentiles(spark):
    import numpy as np
    rng = random.Random(2)
    rows = [(g, float(rng.randint(0, 30)), i) for i in range(300) for g in (0, 1)]
    df = spark.createDataFrame(rows, "g long, v double, i long").repartition(7)
    idx = {r["i"]: r["idx"] for r in P.dense_index(df.where("g = 0"), [F.col("v").desc(), F.col("i")]).collect()}
    want = sorted((r for r in rows if r[0] == 0), key=lambda r: (-r[1], r[2]))
    assert idx == {r[2]: k for k, r in enumerate(want)}
    got = {r["g"]: r for r in P.exact_percentiles(df, ["g"], "v", (0, 13, 50, 99, 100)).collect()}
    for g in (0, 1):
        vals = [v for k, v, _ in rows if k == g]
        for q in (0, 13, 50, 99, 100):
            assert got[g][f"p{q}"] == pytest.approx(np.percentile(vals, q))


def test_rank_of_large_groups(spark):
    rows = [("d", v, s % 7 / 10.0, s) for v in (1, 2) for s in range(40)]
    df = spark.createDataFrame(rows, "detector_of_origin string, public_id long, score_max double, cand_seq long")
    small = R.rank_candidates(df).select("public_id", "cand_seq", "rank", "rank_norm")
    large = R.rank_candidates(df, limit=5).select("public_id", "cand_seq", "rank", "rank_norm")
    assert sorted(small.collect()) == sorted(large.collect())


def test_separability_and_delta(spark):
    rows = [(0.71, True), (0.64, True), (0.93, True)] + [(i / 50.0, False) for i in range(9)]
    one = ST.separability(spark.createDataFrame(rows, "score_max double, is_tp boolean")).first()
    assert (one["best_balacc"], one["best_thresh"], one["frac_fp_below_tp_median"]) == (1.0, 0.64, 1.0)
    d = spark.createDataFrame([(3.0, True), (1.0, True), (2.0, False), (None, False)], "v double, a boolean")
    assert ST.cliffs_delta(d, "v", "a").first()["delta"] == 0.0
    assert ST.cliffs_delta(d.where("a"), "v", "a").first()["delta"] is None


def test_nearest_rows(spark):
    rng = random.Random(13)
    t = [(0, i, float(rng.randint(0, 30)), float(rng.randint(0, 30))) for i in range(40)] + [(1, 90, 5.0, 5.0)]
    q = [(g, i, float(rng.randint(0, 30)), float(rng.randint(0, 30))) for i in range(6) for g in (0, 1)] + [(0, 7, 400.0, 0.0)]
    td = spark.createDataFrame(t, "g long, t long, cx double, cy double")
    qd = spark.createDataFrame(q, "g long, q long, cx double, cy double")
    got = sorted((r["g"], r["q"], r["t"]) for r in GR.nearest_rows(qd, td, ["g"], ["q"], ["t"], 3, per_cell=2).collect())
    want = []
    for g, i, x, y in q:
        near = sorted((((x - tx) ** 2 + (y - ty) ** 2) ** 0.5, j) for h, j, tx, ty in t if h == g)
        want += [(g, i, j) for _, j in near[:3]]
    assert got == sorted(want)


def test_lone_points_meet_dense_places_by_cells(spark):
    """Few points far from a dense blob: distances are right, and the pairs met do not grow with the blob."""
    rng = random.Random(23)
    lone = [(rng.uniform(50, 900), rng.uniform(50, 900)) for _ in range(60)]
    met = []
    for n in (500, 4000):
        pts = [(rng.uniform(0, 2), rng.uniform(0, 2)) for _ in range(n)] + lone
        df = spark.createDataFrame([(0, i, *p) for i, p in enumerate(pts)], "g long, i long, x double, y double")
        report = []
        got = {r["i"]: r["nn_dist"] for r in GR.nearest_neighbour(df, ["g"], "i", ("x", "y"), report=report).collect()}
        near = lambda a, i: min(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for j, b in enumerate(pts) if j != i)
        assert len(got) == len(pts) and all(got[i] == pytest.approx(near(pts[i], i)) for i in [*range(0, n, n // 50), *range(n, len(pts))])
        q = spark.createDataFrame([(0, i, *p) for i, p in enumerate(lone)], "g long, q long, x double, y double")
        rows = GR.nearest_rows(q, df.withColumnRenamed("i", "t"), ["g"], ["q"], ["t"], 3, ("x", "y")).collect()
        want = {(i, j) for i, a in enumerate(lone) for _, j in sorted(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2, j) for j, b in enumerate(pts))[:3]}
        assert {(r["q"], r["t"]) for r in rows} == want
        met.append(sum(report) / len(report) / len(pts))
    assert met[1] < met[0] and max(met) < 40


def test_one_hot_slice(spark):
    """One slice holds nearly all boxes, all stacked: suppression and matching stay exact and linear."""
    rng = random.Random(17)
    rows = [dict(det_id=i, volume_id=0, slice_z=0, x1=float(rng.randint(0, 6)), y1=float(rng.randint(0, 6)),
                 x2=float(rng.randint(30, 40)), y2=float(rng.randint(30, 40)), score=rng.randint(0, 99) / 100.0) for i in range(300)]
    det = frame(spark, rows)
    want = N.keep_best(rows, lambda r: r["score"], "det_id", lambda a, b: N.iou2(a, b) > 0.6)
    assert {r["det_id"] for r in G.nms_2d(det, 0.6, limit=50).collect()} == want
