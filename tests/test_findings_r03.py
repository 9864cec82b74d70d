"""Cases behind the findings of the third review."""
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.oracles import SQL
from checks.queries import QUERIES
from conftest import SF
from tubelens.config import LinkConfig
from tubelens.operators import graph as GR
from tubelens.operators import greedy as G
from tubelens.operators import link as L
from tubelens.plans import froc as FR
from tubelens.plans.fixtures import Fixtures

WIDE = SF.replace("sf0.001", "sf0.1")


def some_events(path, user, shift):
    """The events of one user under the ids of a later copy of the table."""
    con = duckdb.connect()
    con.execute(f"""copy (select event_id+{shift}*100000 event_id, ts, user_id+{shift}*1500 user_id, event_type, value, props
        from '{WIDE}/events.parquet' where user_id={user} order by event_id) to '{path}/events.parquet' (format parquet)""")
    con.execute(f"copy (select * from '{WIDE}/region.parquet') to '{path}/region.parquet' (format parquet)")
    for t in ("events", "region"):
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key, user, shift", [("e4", 740, 1), ("j11", 969, 3)])
def test_ties_agree_with_sql(spark, tmp_path, key, user, shift):
    """e4: two tubes whose 3-D IoU is the NMS threshold. j11: competitors that all have one IoU."""
    con = some_events(tmp_path, user, shift)
    got, want = QUERIES[key](spark, str(tmp_path)).toPandas(), con.execute(SQL[key]).df()
    cols = sorted(want.columns)
    order = lambda d: sorted(map(tuple, d[cols].round(6).values.tolist()), key=str)
    assert len(got) and order(got) == order(want)


def random_mask(spark, seed=3):
    rng = np.random.default_rng(seed)
    at = {tuple(map(int, x)) for x in np.stack([rng.integers(1, 5, 900), rng.integers(-3, 9, 900), rng.integers(40, 52, 900), rng.integers(0, 9, 900)], 1)}
    return spark.createDataFrame(sorted(at), "volume_id long, d0 long, d1 long, d2 long"), at


@pytest.mark.parametrize("kind", ["volume", "slice"])
def test_runs_as_arrays_and_by_joins(spark, kind):
    vox, at = random_mask(spark)
    keys, line, along = (["volume_id"], ["d0", "d1"], "d2") if kind == "volume" else (["volume_id", "d2"], ["d0"], "d1")
    runs = GR._runs(vox, keys, line, along)
    parts = []
    for limit in (GR.RUN_LIMIT, 0):
        rows = GR._run_components(runs, keys, line, limit).collect()
        groups = {}
        for r in rows:
            groups.setdefault((*[r[k] for k in keys], r["comp"]), set()).add((*[r[c] for c in line], r["lo"], r["hi"]))
        parts.append(sorted(sorted((k[:-1], *sorted(v)) for k, v in groups.items())))
    assert parts[0] == parts[1]
    left, n = set(at), 0  # flood fill
    while left:
        todo, n = [left.pop()], n + 1
        while todo:
            v, a, b, c = todo.pop()
            for q in [(v, a + i, b + j, c + k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in ((-1, 0, 1) if kind == "volume" else (0,))]:
                if q in left:
                    left.remove(q)
                    todo.append(q)
    assert len(parts[0]) == n


def test_mask_components_send_nothing_through_the_driver(spark):
    """Spark's estimate of the runs is a few MB at any size of the mask, so a join without a hint broadcast them."""
    plan = GR.component_sizes(Fixtures(spark, SF).voxels())._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_voxels_are_dealt_out(spark):
    vox = Fixtures(spark, SF).voxels()
    assert vox.withColumn("p", F.spark_partition_id()).agg(F.count_distinct("p")).first()[0] > 1


def test_bootstrap_makes_no_row_per_replicate_volume_and_bin(spark):
    """Replicates are those of ``draws``; no join of weights with histograms is left in the plan of the values."""
    gt = spark.createDataFrame([(v, 1) for v in range(7)], "public_id long, label_id long")
    hist = spark.createDataFrame([(k, v, b, (v + b) % 2, v % 3) for k in "xy" for v in range(6) for b in (3, 50, 199) if (v + b) % 4],
                                 "k string, public_id long, bin int, tp long, fp long")
    groups = spark.createDataFrame([("x",), ("y",), ("z",)], "k string")
    got = FR.bootstrap_values(gt, hist, 20, 5, ["k"], groups)
    w = FR.draws(gt, 20, 5)
    bins = w.join(hist, "public_id").groupBy("k", "b", "bin").agg(F.sum(F.col("weight") * F.col("tp")).alias("tp"), F.sum(F.col("weight") * F.col("fp")).alias("fp"))
    sizes = groups.crossJoin(w.groupBy("b").agg(F.sum("weight").alias("n_vol"), F.sum("weight").alias("n_gt")))
    want = FR.froc_summary(FR.curve_from_bins(bins, sizes, ["k", "b"]), by=("k", "b")).select("k", "b", "cpm")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert hasattr(FR, "_replicate_sums")


def test_linker_takes_many_volumes_in_one_call(spark, monkeypatch):
    """One call for a bin, with knobs that differ by volume; each volume as if it were alone."""
    rng = np.random.default_rng(1)
    n, vols = 400, 9
    code, z = np.sort(rng.integers(0, vols, n)), rng.integers(0, 6, n)
    box = rng.integers(0, 12, (2, n)).astype(float)
    box = np.stack([*box, *(box + rng.integers(3, 9, (2, n)))])
    at = np.lexsort((*box[::-1], z, code))
    code, z, box, score = code[at], z[at], box[:, at], rng.integers(0, 30, n) / 30.0
    configs = [LinkConfig(), LinkConfig(link_iou=0.2, max_z_gap=2), LinkConfig(max_tube_zspan=3, max_centroid_drift=2.0)]
    which = code % 3
    seeds = np.lexsort((np.arange(n), -score, code))
    monkeypatch.setattr(L, "BLOCK_CELLS", 50)
    whole = L._grown(code, z, box, seeds, L._knobs(configs, which))
    for v in range(vols):
        one = np.flatnonzero(code == v)
        k = L._knobs([configs[v % 3]], np.zeros(len(one), dtype=int))
        alone = L._grown(np.zeros(len(one), dtype=int), z[one], box[:, one], np.lexsort((np.arange(len(one)), -score[one])), k)
        assert (whole[one] == one[alone]).all()


@pytest.mark.parametrize("form", ["tiles", "some crowded"])
def test_tiles_settle_like_groups(spark, form, monkeypatch):
    """whatever tiles decide, at any width and limit, large groups keep the rows of the grouped form."""
    rng = np.random.default_rng(12)
    if form == "some crowded":
        monkeypatch.setattr(G, "TILE", 2)
        monkeypatch.setattr(G, "TILE_LIMIT", 40)
    n = 300
    at = np.where(rng.random((n, 1)) < 0.5, rng.integers(-40, 40, (n, 3)), rng.integers(0, 12, (n, 3))).astype(float)
    size = rng.integers(4, 16, (n, 3)).astype(float)
    rows = [(i % 2, i, *at[i].tolist(), *size[i].tolist(), int(rng.integers(0, 6)) / 10) for i in range(n)]
    df = spark.createDataFrame(rows, "public_id long, cand_seq long, coordX double, coordY double, coordZ double, x_length double, y_length double, "
                                     "z_length double, score_max double").cache()
    key = lambda d: sorted(r.cand_seq for r in d.select("cand_seq").collect())
    assert key(G.nms_3d(df, 0.05, limit=0)) == key(G.nms_3d(df, 0.05))
    cols = ("coordX", "coordY", "coordZ")
    assert key(G.dedup_by_distance(df, 8.0, "score_max", cols=cols, limit=0)) == key(G.dedup_by_distance(df, 8.0, "score_max", cols=cols))


def test_tiles_leave_little_to_the_rounds(spark, tmp_path, monkeypatch):
    """the rounds copy a row for every cell, several times over; most rows are settled before."""
    some_events(tmp_path, 740, 1)
    df = Fixtures(spark, str(tmp_path)).record().select("public_id", "cand_seq", "slice_count", "cen_d0", "cen_d1", "cen_d2")
    left, real = [], G.materialize
    monkeypatch.setattr(G, "materialize", lambda d: (lambda m: (left.append(m.count()), m)[1])(real(d)))
    G.dedup_by_distance(df, 8.0, "slice_count", limit=0)
    assert left[0] <= df.count() / 4


@pytest.mark.parametrize("crowded", [20_000, 20])
def test_linkage_by_tiles(spark, crowded, monkeypatch):
    """chains that cross tiles, tiles too crowded for a task and points without a place."""
    monkeypatch.setattr(GR, "TILE", 4)
    cells, real = [], GR._linkage_grid
    monkeypatch.setattr(GR, "_linkage_grid", lambda *a: (cells.append(1), real(*a))[1])
    rng = np.random.default_rng(13)
    pts = [*rng.uniform(-30, 30, (200, 3)), *rng.uniform(0, 4, (100, 3)), *np.stack([np.arange(-20, 20) * 1.9, np.full(40, 9.0), np.full(40, -9.0)], 1)]
    rows = [(i % 2 if i < 300 else 0, i, *map(float, p)) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "public_id long, cand_seq long, cen_d0 double, cen_d1 double, cen_d2 double").cache()
    key = lambda d: sorted((r.public_id, r.cand_seq, r.cluster) for r in d.collect())
    want = GR.single_linkage(df, 2.0, ["public_id"])
    cols = ["cen_d0", "cen_d1", "cen_d2"]
    assert key(GR._linkage_tiles(df, ["public_id"], "cand_seq", cols, 2.0, crowded)) == key(want)
    assert bool(cells) == (crowded < 20_000)
    if crowded < 20_000:
        return
    cells.clear()
    odd = df.unionByName(df.limit(1).selectExpr("public_id", "cand_seq + 1000 cand_seq", "cast(null as double) cen_d0", "cen_d1", "cen_d2"))
    got = key(GR.single_linkage(odd, 2.0, ["public_id"], limit=0))
    assert len(got) == len(rows) + 1 and set(key(want)) < set(got) and not cells


def test_suffix_dedup_meets_a_quarter_megabyte_at_a_time(spark, monkeypatch):
    """op9: a task's arrays are some hundred times as large as the surroundings it compares at once."""
    from tubelens.llm import bytedup

    rng, real = np.random.default_rng(9), bytedup.resolve

    def resolve(kind, t):
        assert t.column("around").nbytes < 1 << 19, t.column("around").nbytes
        return real(kind, t)

    monkeypatch.setattr(bytedup, "resolve", resolve)
    said = [" ".join(f"w{x}" for x in rng.integers(0, 10 ** 6, 250)) for _ in range(300)]
    rows = [(i + 300 * k, f"{t} end {k}") for i, t in enumerate(said) for k in range(2)]
    got = bytedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id").n_removed
    assert all(got[i] == 0 and got[i + 300] >= len(t) for i, t in enumerate(said))
