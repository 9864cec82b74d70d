"""Connected components, single linkage, nearest neighbours and mask components."""
from __future__ import annotations

import itertools
import math
from typing import Optional

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tubelens import config as C
from tubelens.functions import boxes as B
from tubelens.operators import spatial as S
from tubelens.operators.grouped import per_bin, per_group, split_by_size
from tubelens.operators.prefix import union_all
from tubelens.session import materialize, stored

POINT_LIMIT = 20_000
EDGE_LIMIT = 500_000
RUN_LIMIT = 200_000
MAX_ROUNDS = 200
TILE = 32              # radii a side of a tile of points
PAIRS_AT_ONCE = 512    # points whose distances are one matrix


# ---------------------------------------------------------------- components
def connected_components(edges: DataFrame, by: list[str], limit: int = EDGE_LIMIT) -> DataFrame:
    """``by..., node, comp`` for the nodes of ``edges`` (``by..., u, v``); comp = smallest node.

    Groups with up to ``limit`` edges are labelled as arrays, larger ones by distributed rounds.
    """
    edges = materialize(edges.select(*by, "u", "v"))
    small, large = split_by_size(edges, by, limit)
    lab = per_group(small, by, ["u", "v"], ["u", "v"], _label_edges, [*by, "u", "v"], "comp")
    out = lab.select(*by, F.col("u").alias("node"), "comp").unionByName(lab.select(*by, F.col("v").alias("node"), "comp"))
    out = out.distinct()
    return out if large is None else out.unionByName(star_components(large, by))


def _label_edges(g):
    """Smallest node of the component of each edge: minimum over edges, then jump to the label's label."""
    names, at = np.unique(np.concatenate([g["u"], g["v"]]), return_inverse=True)
    u, v = at[:len(g["u"])], at[len(g["u"]):]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if np.array_equal(new, label):
            return np.ones(len(u), dtype=bool), names[label[u]]
        label = new


def star_components(edges: DataFrame, by: list[str]) -> DataFrame:
    """Alternates two star contractions. Each is a grouped minimum (with partial aggregation) and a
    join back, so a node with very many neighbours is never gathered."""
    def downhill(df):
        return df.where(F.col("u") != F.col("v")).select(
            *by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    cur = materialize(downhill(edges))
    state = None
    for _ in range(MAX_ROUNDS):
        both = cur.unionByName(cur.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*by, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = downhill(both.where(F.col("v") > F.col("u")).join(low, by + ["u"])
                         .select(*by, F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy(*by, "u").agg(F.min("v").alias("m"))
        small = large.join(low, by + ["u"])
        star = downhill(small.select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
                        .unionByName(low.select(*by, "u", F.col("m").alias("v"))))
        cur = materialize(star)
        new_state = tuple(cur.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*by, "u", "v"))).first())
        if new_state == state:
            break
        state = new_state
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(*by, F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    loops = edges.where("u = v").select(*by, F.col("u").alias("node"), F.col("v").alias("comp"))
    nodes = cur.select(*by, F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)
    return nodes.unionByName(loops.distinct().join(nodes, [*by, "node"], "left_anti"))


def label_nodes(nodes: DataFrame, edges: DataFrame, by: list[str], row_id: str, out: str) -> DataFrame:
    """Add the component of each row; rows without an edge are their own component."""
    comp = connected_components(edges, by).select(*by, F.col("node").alias(row_id), F.col("comp").alias(out))
    return nodes.join(comp, by + [row_id], "left").withColumn(out, F.coalesce(F.col(out), F.col(row_id)))


# ---------------------------------------------------------------- points
def _distance(cols, a: str = "a_", b: str = "b_") -> Column:
    d2 = F.lit(0.0)
    for c in cols:
        d2 = d2 + (F.col(a + c) - F.col(b + c)) * (F.col(a + c) - F.col(b + c))
    return F.sqrt(d2)


def _flood(cols, row_id, radius):
    """Rule that labels each point of a group, sorted by id, with the least id it is chained to."""
    def matrix(xyz, ids):
        d2 = sum((x[:, None] - x) ** 2 for x in xyz.T)
        u, v = np.nonzero(np.sqrt(d2) <= radius)
        label = np.arange(len(ids))
        while True:
            new = label.copy()
            np.minimum.at(new, u, label[v])
            new = np.minimum(new, new[new])
            if np.array_equal(new, label):
                return ids[label]
            label = new

    def flood(g):
        xyz = np.stack([g[c].astype(float) for c in cols], axis=1)
        ids = g[row_id]
        if len(ids) <= PAIRS_AT_ONCE:
            return np.ones(len(ids), dtype=bool), matrix(xyz, ids)
        label = np.full(len(ids), -1, dtype=np.int64)
        done = np.zeros(len(ids), dtype=bool)
        for start in range(len(ids)):
            todo = [] if done[start] else [start]
            while todo:
                at = todo.pop()
                done[at], label[at] = True, ids[start]
                free = np.flatnonzero(~done)
                near = free[np.sqrt(((xyz[free] - xyz[at]) ** 2).sum(axis=1)) <= radius]
                done[near], label[near] = True, ids[start]
                todo.extend(near.tolist())
        return np.ones(len(ids), dtype=bool), label

    return flood


def _linkage_grouped(df: DataFrame, by, row_id, cols, radius) -> DataFrame:
    return per_group(df, by, [row_id], [row_id, *cols], _flood(cols, row_id, radius), [*by, row_id], "cluster")


def _linkage_tiles(df: DataFrame, by, row_id, cols, radius, limit: int = POINT_LIMIT) -> DataFrame:
    """Points go to their tile, many radii wide, and to those within a radius of them, so each link lies whole in some tile. A tile is labelled as
    arrays; what tiles say of the points that they share unites their labels. Points of tiles with more than ``limit`` rows are labelled
    by cells, and that counts as one more tile."""
    side, wide = radius * TILE, radius * (1 + 1e-9)
    tiles = [f"_tile{i}" for i in range(len(cols))]
    rows = stored(df.select(*by, F.col(row_id).alias("_id"), *[F.col(c).cast("double").alias(c) for c in cols]), "points")
    least = rows.agg(*[F.min(c).alias(c) for c in cols]).first()
    placed, border, home = rows, F.lit(False), F.lit(True)
    for t, c in zip(tiles, cols):
        origin = least[c] - 2 * radius if least[c] is not None and math.isfinite(least[c]) else 0.0
        first, own, last = (S.cell_of(F.col(c) + F.lit(d) - F.lit(origin), side) for d in (-wide, 0.0, wide))
        border, home = border | F.coalesce(first != last, F.lit(False)), home & F.coalesce(F.col(t) == own, F.lit(True))
        placed = placed.withColumn(t, F.coalesce(F.sequence(first, last), F.array(F.lit(0).cast("long"))))  # without a coordinate: linked to nothing
    placed = placed.withColumn("_border", border)
    for t in tiles:
        placed = placed.withColumn(t, F.explode(t))
    placed = placed.withColumn("_home", home)
    small, large = split_by_size(placed, [*by, *tiles], limit)
    said = [*by, "_id", "_border", "_home"]
    lab = per_group(small, [*by, *tiles], ["_id"], ["_id", *cols], _flood(cols, "_id", radius), said, "_label")
    if large is not None:
        crowd = materialize(large.groupBy(*by, "_id", *cols).agg(F.max("_border").alias("_border"), F.max("_home").alias("_home")))
        cells = _linkage_grid(crowd, by, "_id", cols, radius).withColumnRenamed("cluster", "_label")
        lab = lab.unionByName(crowd.join(cells, by + ["_id"]).select(*said, "_label"))
    lab = stored(lab, "labels")
    comp = connected_components(lab.where("_border").select(*by, F.col("_id").alias("u"), F.col("_label").alias("v")), by)
    out = lab.where("_home").join(comp.withColumnRenamed("node", "_label"), by + ["_label"], "left")
    return out.select(*by, F.col("_id").alias(row_id), F.coalesce("comp", "_label").alias("cluster"))


def _box_bounds(cols, a: str, b: str) -> tuple[Column, Column]:
    """Least and greatest distance of points of two boxes ``<side>_lo_*``, ``<side>_hi_*``."""
    near2 = far2 = F.lit(0.0)
    for c in cols:
        al, ah, bl, bh = (F.col(f"{s}_{e}_{c}") for s in (a, b) for e in ("lo", "hi"))
        gap, wide = F.greatest(al - bh, bl - ah, F.lit(0.0)), F.greatest(ah - bl, bh - al)
        near2, far2 = near2 + gap * gap, far2 + wide * wide
    return F.sqrt(near2), F.sqrt(far2)


def _tight(cols) -> list[Column]:
    return [f(c).alias(f"{n}_{c}") for c in cols for f, n in ((F.min, "lo"), (F.max, "hi"))]


def _linkage_grid(df: DataFrame, by, row_id, cols, radius, report: Optional[list] = None) -> DataFrame:
    """Cells small enough that all points of one cell are linked. Cells whose boxes are surely linked are united; a pair that is neither surely linked
    nor surely apart is halved: the boxes of its smaller cells meet instead, those out of reach are dropped, and one certain
    pair unites the two. Pairs that are connected by now are dropped before every halving, and cells that share a face come
    first, so in dense places one halving of these settles all, and points are compared only where they lie about ``radius`` apart. A cell of equal points
    is one point, so halving ends. ``report`` gets the pairs met in every step.
    """
    d = len(cols)
    side = radius / math.sqrt(d)
    cc = [f"_c{i}" for i in range(d)]
    at = lambda size: {k: S.cell_of(F.col(c), size) for c, k in zip(cols, cc)}
    pts = materialize(df.select(*by, F.col(row_id).alias("_id"), *[F.col(c).cast("double").alias(c) for c in cols]).withColumns(at(side)))
    cells = materialize(pts.groupBy(*by, *cc).agg(F.min("_id").alias("_rep"), *_tight(cols)))
    # the points of a cell once each, under the name of their cell
    named = materialize(pts.join(cells.select(*by, *cc, "_rep"), by + cc))
    star = named.select(*by, F.col("_id").alias("u"), F.col("_rep").alias("v"))
    places = named.select(*by, "_rep", *cols).distinct()
    reach = int(math.ceil(math.sqrt(d)))
    forward = [o for o in itertools.product(range(-reach, reach + 1), repeat=d) if o > (0,) * d]
    offsets = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"o{i}") for i, v in enumerate(o)]) for o in forward]))
    a = S.prefixed(cells, "a_", by).withColumn("_o", offsets)
    a = a.withColumns({k: F.col("a_" + k) + F.col(f"_o.o{i}") for i, k in enumerate(cc)}).drop("_o")
    b = S.prefixed(cells, "b_", by + cc).withColumns({"b_" + k: F.col(k) for k in cc})
    near, far = _box_bounds(cols, "a", "b")
    ends = [*by, "a__rep", "b__rep", *[f"{s}_{k}" for s in "ab" for k in cc]]
    met = materialize(a.join(b, by + cc).where(near <= radius).select(*ends, (far <= radius).alias("_sure")))
    edges = []

    def unite(pairs):
        edges.append(pairs.where("_sure").select(*by, F.col("a__rep").alias("u"), F.col("b__rep").alias("v")).distinct())

    def apart(pairs):
        """Pairs whose cells are not connected yet."""
        known = materialize(label_nodes(cells.select(*by, F.col("_rep").alias("_id")), union_all(edges), by, "_id", "_comp").select(*by, "_id", "_comp"))
        for s in "ab":
            pairs = pairs.join(known.select(*by, F.col("_id").alias(f"{s}__rep"), F.col("_comp").alias(f"_{s}comp")), by + [f"{s}__rep"])
        return materialize(pairs.where(F.col("_acomp") != F.col("_bcomp")).drop("_acomp", "_bcomp"))

    def halved(pairs, side):
        wanted = pairs.select(*by, F.col("a__rep").alias("_rep")).unionByName(pairs.select(*by, F.col("b__rep").alias("_rep"))).distinct()
        halves = places.join(wanted, by + ["_rep"], "left_semi").withColumns(at(side)).withColumnsRenamed({k: "_up" + k for k in cc}).withColumns(at(side / 2.0))
        kids = materialize(halves.groupBy(*by, "_rep", *["_up" + k for k in cc], *cc).agg(*_tight(cols)))
        for s in "ab":
            mine = kids.select(*by, F.col("_rep").alias(f"{s}__rep"), *[F.col("_up" + k).alias(f"{s}_{k}") for k in cc], *[F.col(k).alias(f"_{s}{k}") for k in cc],
                               *[F.col(f"{e}_{c}").alias(f"{s}_{e}_{c}") for c in cols for e in ("lo", "hi")])
            pairs = pairs.join(mine, by + [f"{s}__rep", *[f"{s}_{k}" for k in cc]])
        return materialize(pairs.where(near <= radius).withColumns({f"{s}_{k}": F.col(f"_{s}{k}") for s in "ab" for k in cc}).select(
            *ends, (far <= radius).alias("_sure")))

    unite(met)
    counts = [met.count()]
    face = sum((F.abs(F.col("a_" + k) - F.col("b_" + k)) for k in cc), F.lit(0)) == 1
    # neighbours that share a face first: in a dense place they connect the others
    for some in (face, ~face):
        open_, size = apart(met.where(~F.col("_sure") & some).select(*ends)), side
        while not open_.isEmpty():
            step, size = halved(open_, size), size / 2.0
            counts.append(step.count())
            unite(step)
            open_ = apart(step.where(~F.col("_sure")).select(*ends))
    if report is not None:
        report.extend(counts)
    return label_nodes(pts.select(*by, "_id"), union_all([star, *edges]), by, "_id", "cluster").select(
        *by, F.col("_id").alias(row_id), "cluster")


def single_linkage(df: DataFrame, radius: float, by: list[str], row_id: str = "cand_seq",
                   cols=("cen_d0", "cen_d1", "cen_d2"), limit: int = POINT_LIMIT) -> DataFrame:
    """``by..., row_id, cluster``: rows chained by steps of at most ``radius`` share a cluster."""
    small, large = split_by_size(df, by, limit)
    out = _linkage_grouped(small, by, row_id, cols, radius)
    if large is not None:
        apart = _linkage_tiles if radius > 0 else _linkage_grid
        out = out.unionByName(apart(large, by, row_id, cols, radius))
    return out


def cluster_redundancy(df: DataFrame, radius: float, by: list[str], **kw) -> DataFrame:
    """Clusters, points and points per cluster of each group."""
    lab = single_linkage(df, radius, by, **kw)
    per = lab.groupBy(*by, "cluster").agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("_n").alias("n_points")).withColumn(
        "redundancy", F.col("n_points") / F.greatest(F.col("n_clusters"), F.lit(1)))


def _finite_only(df: DataFrame, cols) -> DataFrame:
    """Rows whose coordinates are all numbers."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.where(ok)


LEAST_SIDE = 2.0 ** -40  # of the widest extent; closer places share a cell


def _first_side(spots: DataFrame, keys, cols, widest: float, n: int, per_cell: int) -> float:
    """A side at which no cell holds more than ``per_cell`` distinct places (or a very small one)."""
    cc = [f"_c{i}" for i in range(len(cols))]
    side = widest / max(n ** (1.0 / len(cols)), 1.0)
    while side > widest * LEAST_SIDE:
        crowd = spots.withColumns({k: S.cell_of(F.col(c), side) for c, k in zip(cols, cc)}).groupBy(*keys, *cc).count()
        if (crowd.agg(F.max("count")).first()[0] or 0) <= per_cell:
            break
        side /= 2.0
    return side


def _around(queries: DataFrame, targets: DataFrame, keys, cols, side: float) -> DataFrame:
    """Queries (``a_*``) with the targets (``b_*``) in their own and the neighbouring cells, and the distance."""
    cc = [f"_c{i}" for i in range(len(cols))]
    celled = lambda d: d.withColumns({k: S.cell_of(F.col(c), side) for c, k in zip(cols, cc)})
    offsets = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"o{i}") for i, v in enumerate(o)]) for o in itertools.product((-1, 0, 1), repeat=len(cols))]))
    q = S.prefixed(celled(queries).withColumn("_o", offsets), "a_", keys)
    q = q.withColumns({k: F.col("a_" + k) + F.col(f"a__o.o{i}") for i, k in enumerate(cc)})
    return q.join(S.prefixed(celled(targets), "b_", keys + cc), keys + cc).withColumn("dist", _distance(cols))


def _descend(queries: DataFrame, targets: DataFrame, keys, q_id, cols, k: int, side: float, widest: float, report: Optional[list] = None) -> DataFrame:
    """Queries with every target that can be among their ``k`` nearest: ``keys, a_*, b_*, dist``.

    Cells of side ``side`` are gathered into cells of twice the side until one or two span each axis. From there queries walk down
    all at once: a cell is kept if it begins no further away than the k-th target must end, by the boxes and counts of
    the cells met. So a query far from everything meets a few coarse cells of a dense place, and points only where they count.
    """
    cc = [f"_c{i}" for i in range(len(cols))]
    base = targets.withColumns({n: S.cell_of(F.col(c), side) for c, n in zip(cols, cc)})
    levels = [materialize(base.groupBy(*keys, *cc).agg(F.count(F.lit(1)).alias("_n"), *_tight(cols)))]
    size = side
    while size < 2.0 * widest:
        up = levels[-1].withColumns({n: F.floor(F.col(n) / 2.0) for n in cc}).groupBy(*keys, *cc).agg(
            F.sum("_n").alias("_n"), *[f(f"{n}_{c}").alias(f"{n}_{c}") for c in cols for f, n in ((F.min, "lo"), (F.max, "hi"))])
        levels.append(materialize(up))
        size *= 2.0
    q = S.prefixed(queries.select(*keys, *q_id, *cols), "a_", keys)
    names = [*keys, *dict.fromkeys("a_" + c for c in [*q_id, *cols])]
    by_far = Window.partitionBy(*names).orderBy("_far", *cc).rowsBetween(Window.unboundedPreceding, 0)
    of_query = Window.partitionBy(*names)
    met = None
    for level in reversed(levels):
        if met is None:
            pairs = q.join(level, keys)
        else:
            kids = level.withColumns({f"_up{n}": F.floor(F.col(n) / 2.0) for n in cc})
            pairs = met.withColumnsRenamed({n: f"_up{n}" for n in cc}).join(kids, keys + [f"_up{n}" for n in cc]).drop(*[f"_up{n}" for n in cc])
        near2 = far2 = F.lit(0.0)
        for c in cols:
            x, lo, hi = F.col("a_" + c), F.col("lo_" + c), F.col("hi_" + c)
            gap, wide = F.greatest(lo - x, x - hi, F.lit(0.0)), F.greatest(hi - x, x - lo)
            near2, far2 = near2 + gap * gap, far2 + wide * wide
        pairs = pairs.withColumns({"_near": F.sqrt(near2), "_far": F.sqrt(far2)}).withColumn("_sum", F.sum("_n").over(by_far))
        enough = F.coalesce(F.min(F.when(F.col("_sum") >= k, F.col("_far"))).over(of_query), F.lit(float("inf")))
        met = materialize(pairs.withColumn("_enough", enough).where(F.col("_near") <= F.col("_enough")).select(*names, *cc))
        if report is not None:
            report.append(met.count())
    return met.join(S.prefixed(base, "b_", keys + cc), keys + cc).withColumn("dist", _distance(cols))


def nearest_neighbour(df: DataFrame, by: list[str], row_id: str = "cand_seq",
                      cols=("cen_d0", "cen_d1", "cen_d2"), per_cell: int = 32, report: Optional[list] = None) -> DataFrame:
    """``by..., row_id, nn_dist``: distance to the nearest other row of the group.

    Equal points are settled by a group-by. The rest look into the cells around them, whose side is small enough that no cell
    holds many points; a neighbour found within the side is final. Those without one walk down from coarse cells
    (``_descend``). Groups of one give no row, nor do rows with a coordinate that is NULL, NaN or infinite.
    """
    cols = list(cols)
    pts = materialize(_finite_only(df.select(*by, row_id, *[F.col(c).cast("double").alias(c) for c in cols]), cols))
    places = materialize(pts.groupBy(*by, *cols).agg(F.count(F.lit(1)).alias("_n")))
    found = [places.where("_n > 1").select(*by, *cols, F.lit(0.0).alias("nn_dist"))]
    todo, spots = places.where("_n = 1").drop("_n"), places.drop("_n")
    ext = spots.agg(*[f(c).alias(n + c) for c in cols for f, n in ((F.min, "lo_"), (F.max, "hi_"))],
                    F.count(F.lit(1)).alias("n")).first()
    if not ext["n"]:
        return pts.select(*by, row_id, F.lit(None).cast("double").alias("nn_dist"))
    widest = max(max(ext["hi_" + c] - ext["lo_" + c] for c in cols), 1e-9)
    side = _first_side(spots, by, cols, widest, ext["n"], per_cell)
    same = F.lit(True)
    for c in cols:
        same = same & (F.col("a_" + c) == F.col("b_" + c))
    least = lambda pairs: pairs.where(~same).groupBy(*by, *[F.col("a_" + c).alias(c) for c in cols]).agg(F.min("dist").alias("nn_dist"))
    hit = materialize(least(_around(todo, spots, by, cols, side)).where(F.col("nn_dist") <= side))
    todo = materialize(todo.join(hit, by + cols, "left_anti"))
    found.append(hit)
    if not todo.isEmpty():  # the place itself is the nearest of two
        found.append(least(_descend(todo, spots, by, [], cols, 2, side, widest, report)))
    return pts.join(union_all(found), by + cols).select(*by, row_id, "nn_dist")


def nearest_rows(queries: DataFrame, targets: DataFrame, keys: list[str], q_id: list[str], t_id: list[str], k: int,
                 cols=("cx", "cy"), per_cell: int = 64, report: Optional[list] = None) -> DataFrame:
    """The ``k`` nearest targets of each query with equal ``keys``: ``keys, q_id, t_id, dist``.

    Ties go to the smaller ``t_id``. Queries look into the cells around them; one that has ``k`` targets within the cell side is
    done, the others walk down from coarse cells (``_descend``), so far pairs are never formed. Queries with fewer than ``k`` targets
    keep all of them. Rows with a coordinate that is NULL, NaN or infinite take no part.
    """
    cols = list(cols)
    targets = materialize(_finite_only(targets.select(*keys, *t_id, *[F.col(c).cast("double").alias(c) for c in cols]), cols))
    todo = materialize(_finite_only(queries.select(*keys, *q_id, *[F.col(c).cast("double").alias(c) for c in cols]), cols))
    span = targets.select(*cols).union(todo.select(*cols)).agg(
        *[(F.max(c) - F.min(c)).alias(c) for c in cols], F.count(F.lit(1)).alias("n")).first()
    widest = max([span[c] or 0.0 for c in cols] + [1e-9])
    side = _first_side(materialize(targets.select(*keys, *cols).distinct()), keys, cols, widest, span["n"], per_cell)
    names = [f"a_{c}" for c in q_id]
    w = Window.partitionBy(*keys, *names).orderBy("dist", *[f"b_{c}" for c in t_id])
    out = [*keys, *[F.col("a_" + c).alias(c) for c in q_id], *[F.col("b_" + c).alias(c) for c in t_id], "dist"]
    top = lambda pairs: pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    full = F.count_if(F.col("dist") <= side).over(Window.partitionBy(*keys, *names)) >= k
    hit = materialize(top(_around(todo, targets, keys, cols, side)).withColumn("_full", full).where("_full").select(*out))
    todo = materialize(todo.join(hit.select(*keys, *q_id).distinct(), keys + q_id, "left_anti"))
    if todo.isEmpty():
        return hit
    return hit.unionByName(top(_descend(todo, targets, keys, q_id, cols, k, side, widest, report)).select(*out))


# ---------------------------------------------------------------- masks
def _runs(vox: DataFrame, keys: list[str], line: list[str], along: str) -> DataFrame:
    """Set cells of a line collapsed to runs ``keys, line, lo, hi``. A line is one image row."""
    w = Window.partitionBy(*keys, *line).orderBy(along)
    isl = vox.select(*keys, *line, along).withColumn("_i", F.col(along) - F.dense_rank().over(w))
    return isl.groupBy(*keys, *line, "_i").agg(F.min(along).alias("lo"), F.max(along).alias("hi")).drop("_i")


def _run_ids(runs: DataFrame, line: list[str]) -> DataFrame:
    """Add ``_rid``: line coordinates and start packed into one long, in that order, with the widths that they need."""
    cols = [*line, "lo"]
    ends = runs.agg(*[f(c).cast("long").alias(f"{n}_{c}") for c in cols for n, f in (("a", F.min), ("z", F.max))]).first()
    if ends[f"a_{cols[0]}"] is None:
        return runs.withColumn("_rid", F.lit(None).cast("long"))
    width = {c: max(1, (ends[f"z_{c}"] - ends[f"a_{c}"]).bit_length()) for c in cols}
    if sum(width.values()) > 62:
        raise ValueError(f"coordinates span too much for one run id: {width} bits")
    rid, shift = F.lit(0).cast("long"), 0
    for c in reversed(cols):
        rid = rid + F.shiftleft(F.col(c).cast("long") - ends[f"a_{c}"], shift)
        shift += width[c]
    return runs.withColumn("_rid", rid)


def _label_runs(g, starts, line):
    """Position in its group of the first run of each run's component. Rows are sorted by group, line and start; runs of one line
    don't meet, so those that touch a run are neighbours on each adjacent line."""
    n = len(g["lo"])
    axes, widths = [], []
    for c in [*line, "lo", "hi"]:
        axes.append(g[c].astype(np.int64) - int(g["lo" if c == "hi" else c].min()) + 1)
        widths.append(int(axes[-1].max()) + 2)
    *at, lo, hi = axes
    *wide, _, span = widths
    if math.prod(wide) * span * len(starts) > 2 ** 62:
        if len(starts) == 2:
            raise ValueError(f"coordinates span too much for one group of runs: {widths}")
        return np.concatenate([_label_runs({c: a[x:y] for c, a in g.items()}, np.array([0, y - x]), line) for x, y in zip(starts[:-1], starts[1:])])
    code = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    for a, w in zip(at, wide):
        code = code * w + a
    first, last = code * span + lo, code * span + hi
    us, vs = [], []
    for o in itertools.product((-1, 0, 1), repeat=len(line)):
        if o <= (0,) * len(line):
            continue
        step = 0
        for d, w in zip(o, wide):
            step = step * w + d
        low = np.searchsorted(last, first + step * span - 1, "left")
        met = np.maximum(np.searchsorted(first, last + step * span + 1, "right") - low, 0)
        u = np.repeat(np.arange(n), met)
        us.append(u)
        vs.append(np.arange(len(u)) - np.repeat(np.cumsum(met) - met, met) + low[u])
    u, v = np.concatenate(us), np.concatenate(vs)
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            break
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, label[label]):
            label = label[label]
    return label - np.repeat(starts[:-1], np.diff(starts))


def _run_components(runs: DataFrame, keys: list[str], line: list[str], limit: int = RUN_LIMIT) -> DataFrame:
    """Add ``comp`` to runs; runs on adjacent lines touch when their spans meet within one cell. Groups with up to ``limit`` runs
    are labelled as arrays, larger ones by joins."""
    small, large = split_by_size(materialize(runs), keys, limit)
    label = lambda g, starts: (np.ones(len(g["lo"]), dtype=bool), _label_runs(g, starts, line))
    out = per_bin(small, keys, [*line, "lo"], [*line, "lo", "hi"], label, [*keys, *line, "lo", "hi"], "comp")
    return out if large is None else out.unionByName(_run_components_joined(materialize(large), keys, line))


def _run_components_joined(runs: DataFrame, keys: list[str], line: list[str]) -> DataFrame:
    """``_run_components`` without groups. The size that Spark expects of runs knows nothing of the rows that an explode made, so
    the joins say that no side is to be sent through the driver."""
    runs = _run_ids(runs, line)
    forward = [o for o in itertools.product((-1, 0, 1), repeat=len(line)) if o > (0,) * len(line)]
    off = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"o{i}") for i, v in enumerate(o)]) for o in forward]))
    a = S.prefixed(runs.withColumn("_o", off), "a_", keys)
    a = a.withColumns({c: F.col("a_" + c) + F.col(f"a__o.o{i}") for i, c in enumerate(line)})
    b = S.prefixed(runs, "b_", keys + line)
    edges = (a.join(b.hint("merge"), keys + line)
             .where((F.col("a_lo") <= F.col("b_hi") + 1) & (F.col("b_lo") <= F.col("a_hi") + 1))
             .select(*keys, F.col("a__rid").alias("u"), F.col("b__rid").alias("v")))
    return label_nodes(runs.hint("merge"), edges, keys, "_rid", "comp").drop("_rid").select(*keys, *line, "lo", "hi", "comp")


def voxel_components(vox: DataFrame, connectivity: str = "volume") -> DataFrame:
    """Components of ``volume_id, d0, d1, d2``: 26-connected in the volume or 8-connected per slice.

    One row per run of cells: ``volume_id, (d2,) line..., lo, hi, comp``.
    """
    if connectivity == "volume":
        keys, line, along = ["volume_id"], ["d0", "d1"], "d2"
    else:
        keys, line, along = ["volume_id", "d2"], ["d0"], "d1"
    return _run_components(_runs(vox, keys, line, along), keys, line)


def component_sizes(vox: DataFrame) -> DataFrame:
    """Voxels per 26-connected component."""
    return (voxel_components(vox).groupBy("volume_id", "comp")
            .agg(F.sum(F.col("hi") - F.col("lo") + 1).cast("long").alias("n_voxels")))


def slice_labels(vox: DataFrame, merge_gap: float = C.MERGE_GAP, min_area: int = C.MIN_BOX_AREA) -> DataFrame:
    """Per slice: 8-connected components, chained while their boxes are ``merge_gap`` apart or
    less, one union box per chain with at least ``min_area`` set cells. Ids follow (r0, c0)."""
    keys = ["volume_id", "d2"]
    comp = materialize(voxel_components(vox, "slice").groupBy(*keys, "comp").agg(
        F.min("d0").alias("r0"), F.min("lo").alias("c0"), F.max("d0").alias("r1"), F.max("hi").alias("c1"),
        F.sum(F.col("hi") - F.col("lo") + 1).alias("area")))
    pad = (merge_gap + 1.0) / 2.0
    grown = comp.withColumns({
        "x1": F.col("c0") - pad, "x2": F.col("c1") + pad, "y1": F.col("r0") - pad, "y2": F.col("r1") + pad})
    edges = (S.overlap_pairs(grown, grown.hint("merge"), keys, S.AXES_2D, S.CELL_2D)
             .where((F.col("a_comp") < F.col("b_comp")) & (B.box_gap() <= merge_gap))
             .select(*keys, F.col("a_comp").alias("u"), F.col("b_comp").alias("v")))
    merged = (label_nodes(comp, edges, keys, "comp", "lesion").groupBy(*keys, "lesion")
              .agg(F.min("r0").alias("r0"), F.min("c0").alias("c0"), F.max("r1").alias("r1"),
                   F.max("c1").alias("c1"), F.sum("area").cast("long").alias("area"))
              .where(F.col("area") >= min_area))
    order = Window.partitionBy(*keys).orderBy("r0", "c0", "lesion")
    return merged.select(
        "volume_id", F.col("d2").alias("slice_z"), "r0", "c0", "r1", "c1",
        (F.row_number().over(order) - 1).cast("long").alias("component_id"), "area")


def mask_boxes_3d(vox: DataFrame) -> DataFrame:
    """Tight inclusive storage box of each volume's mask."""
    return vox.groupBy("volume_id").agg(*[
        f(f"d{i}").cast("long").alias(f"{n}_d{i}") for n, f in (("min", F.min), ("max", F.max)) for i in range(3)])


def mask_boxes_2d(vox: DataFrame) -> DataFrame:
    """Tight half-open box of each slice of the mask."""
    return vox.groupBy("volume_id", F.col("d2").alias("slice_z")).agg(
        F.min("d1").cast("double").alias("x1"), F.min("d0").cast("double").alias("y1"),
        (F.max("d1") + 1).cast("double").alias("x2"), (F.max("d0") + 1).cast("double").alias("y2"))


def regrid_mask(vox: DataFrame, meta: DataFrame) -> DataFrame:
    """Nearest-voxel resampling of a mask: target cell i reads source
    floor((i + 0.5) * n_native / n_iso) on each axis.

    The map is inverted, so each source voxel produces the targets that read it and nothing
    is scanned densely; every target reads one source, so no distinct is needed.
    """
    m = meta.select("volume_id", "native_shape", "iso_shape")
    out = vox.join(m, "volume_id")
    for i in range(3):
        n = F.col("iso_shape")[i]
        f = n / F.col("native_shape")[i]
        guess_lo = F.greatest(F.floor(F.col(f"d{i}") * f - 1.5), F.lit(0)).cast("long")
        guess_hi = F.least(F.ceil((F.col(f"d{i}") + 1) * f + 0.5), n - 1).cast("long")
        cells = F.when(guess_hi >= guess_lo, F.sequence(guess_lo, guess_hi)).otherwise(F.array().cast("array<bigint>"))
        out = out.withColumn(f"_t{i}", F.explode(cells)).where(
            F.floor((F.col(f"_t{i}") + 0.5) * F.col("native_shape")[i] / n) == F.col(f"d{i}"))
    return out.select("volume_id", *[F.col(f"_t{i}").alias(f"d{i}") for i in range(3)])
