"""Ranks, numbering, folds, sampling and selection rules."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tubelens import config as C
from tubelens.operators import prefix as P
from tubelens.operators.grouped import BIN, split_by_size
from tubelens.session import materialize

RANK_LIMIT = 1_000_000


def rank_candidates(df: DataFrame, by=("detector_of_origin", "public_id"), seq: str = "cand_seq",
                    limit: int = RANK_LIMIT) -> DataFrame:
    """Add ``rank`` (1 = highest score_max, ties by ``seq``) and ``rank_norm`` = rank / group size.

    Groups above ``limit`` are ranked over range blocks instead of in one window partition.
    """
    keys = list(by)
    order = [F.col("score_max").desc(), F.col(seq).asc()]
    small, large = split_by_size(df, keys, limit)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    out = small.drop(BIN).withColumns({"rank": F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"), "_n": n})
    if large is not None:
        blocks = P.range_blocks(large, keys, order)
        run = P.running(blocks, keys, order, {"rank": ("sum", F.lit(1).cast("long"))}).drop(P.BLOCK)
        out = out.unionByName(P.join_groups(run, blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys))
    return out.withColumn("rank_norm", F.col("rank") / F.col("_n")).drop("_n")


def number_candidates(df: DataFrame, order: list[Column], by=("detector_of_origin",), out: str = "cand_seq") -> DataFrame:
    """Add a 0-based number that runs across the volumes of each detector in the given order."""
    blocks = P.range_blocks(materialize(df), list(by), order)  # sampling for the ranges reads it too
    run = P.running(blocks, list(by), order, {out: ("sum", F.lit(1).cast("long"))})
    return run.withColumn(out, F.col(out) - 1).drop(P.BLOCK)


def seeded_order(seed: Column, row_id: Column) -> Column:
    """A hash order that every engine computes alike."""
    return F.md5(F.concat_ws(":", seed.cast("string"), row_id.cast("string")))


def stratified_folds(df: DataFrame, k: int = C.FOLDS, seed: int = C.FOLD_SEED, row_id: str = "volume_id",
                     label: str = "label") -> DataFrame:
    """Add ``fold``: within each label, position in seeded order modulo ``k``."""
    d = df.withColumn("_o", seeded_order(F.lit(seed), F.col(row_id)))
    order = [F.col("_o"), F.col(row_id)]
    blocks = P.range_blocks(d, [label], order)
    run = P.running(blocks, [label], order, {"_p": ("sum", F.lit(1).cast("long"))})
    return run.withColumn("fold", (F.col("_p") - 1) % k).drop("_p", "_o", P.BLOCK)


def sample_epoch(samples: DataFrame, ratio: int = C.NEG_POS_RATIO, seed: int = 0, epoch: int = 0) -> DataFrame:
    """All positives and ``ratio`` times as many negatives without replacement (all, if fewer),
    in an order that depends only on (seed, epoch): adds ``pos_in_epoch``.

    ``samples`` has ``volume_id, slice_z, is_lesion``.
    """
    tag = F.lit(f"{seed}:{epoch}")
    d = materialize(samples.withColumn("_o", seeded_order(tag, F.concat_ws(":", "volume_id", "slice_z"))))
    order = [F.col("_o"), F.col("volume_id"), F.col("slice_z")]
    neg = P.dense_index(d.where(~F.col("is_lesion")), order, "_i")
    n_pos = d.where("is_lesion").agg(F.count(F.lit(1))).scalar()
    kept = d.where("is_lesion").unionByName(neg.where(F.col("_i") < ratio * n_pos).drop("_i"))
    return P.dense_index(kept, order, "pos_in_epoch").drop("_o")


# ---------------------------------------------------------------- selection rules (metric tables)
def monotonicity_violations(df: DataFrame, by=(), tol: float = 1e-9) -> DataFrame:
    """Steps of ``thresh, recall`` where recall drops although the threshold is lowered."""
    w = Window.partitionBy(*by).orderBy(F.col("thresh").desc())  # one row per swept threshold
    d = df.withColumns({"thresh_hi": F.lag("thresh").over(w), "recall_hi": F.lag("recall").over(w)})
    return d.where(F.col("recall") < F.col("recall_hi") - tol).select(
        *by, "thresh_hi", F.col("thresh").alias("thresh_lo"), "recall_hi", F.col("recall").alias("recall_lo"),
        (F.col("recall_hi") - F.col("recall")).alias("drop"))


def _usable(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def select_epoch(df: DataFrame, min_epoch: int = C.SELECT_MIN_EPOCH, tol: float = C.SELECT_CPM_TOL, by=()) -> DataFrame:
    """One epoch per group of ``epoch, cpm[, ceiling]`` rows.

    With a ceiling and ``tol > 0``: within ``tol`` of the best CPM, the highest ceiling, then the
    earliest epoch. Otherwise the best CPM, then the latest. All-undefined CPM: the latest epoch. A group with no
    epoch from ``min_epoch`` on is an error.
    """
    keys = list(by)
    counts = F.col("epoch") >= min_epoch
    d = df.withColumns({"cpm": F.when(counts, _usable("cpm")), "_counts": counts})
    best = d.groupBy(*keys).agg(F.max("cpm").alias("_best"), F.max(F.when(F.col("_counts"), F.col("epoch"))).alias("_last"))
    j = d.join(best, keys) if keys else P.attach(d, best)
    if "ceiling" in df.columns and tol > 0:
        ceil = F.coalesce(_usable("ceiling"), F.lit(float("-inf")))
        pick = F.max(F.when(F.col("cpm") >= F.col("_best") - tol, F.struct(ceil.alias("c"), (-F.col("epoch")).alias("e"))))
        chosen = -pick["e"]
    else:
        chosen = F.max(F.when(F.col("cpm").isNotNull(), F.struct("cpm", F.col("epoch").alias("e"))))["e"]
    none = F.raise_error(F.lit(f"no epoch from {min_epoch} on to choose from")).cast("long")
    return j.groupBy(*keys).agg(F.coalesce(chosen.cast("long"), F.max("_last").cast("long"), none).alias("epoch"))


def selection_stability(df: DataFrame, min_epoch: int = C.SELECT_MIN_EPOCH, k: int = 3, by=()) -> DataFrame:
    """Spread of the ``k`` best CPMs of each group (later epoch first on ties)."""
    d = df.where(F.col("epoch") >= min_epoch).withColumn("cpm", _usable("cpm")).where(F.col("cpm").isNotNull())
    w = Window.partitionBy(*by).orderBy(F.col("cpm").desc(), F.col("epoch").desc())  # one row per epoch
    top = d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return top.groupBy(*by).agg((F.max("cpm") - F.min("cpm")).alias("spread"), F.count(F.lit(1)).alias("n_top"))


def choose_operating_point(df: DataFrame, frac: float = C.RECALL_FRAC) -> DataFrame:
    """Of ``thresh, recall, cpm, pool_mean`` rows with recall >= frac * max: the highest CPM, then
    the smaller pool, then the lower threshold."""
    top = df.agg(F.max("recall")).scalar()
    return df.where(F.col("recall") >= frac * top - 1e-12).orderBy(
        F.col("cpm").desc(), F.col("pool_mean").asc(), F.col("thresh").asc()).limit(1)


def cheapest_config(df: DataFrame, target: float, budget: float) -> DataFrame:
    """Of ``config, recall, pool_mean, pool_max`` rows: the smallest pool that reaches ``target``
    within ``budget``; also the best recall within the budget. One row; NULL config if none."""
    fit = F.col("pool_max") <= budget
    good = fit & (F.col("recall") >= target - 1e-9)
    pick = F.min(F.when(good, F.struct("pool_mean", "config", "recall", "pool_max")))
    return df.agg(pick.alias("p"), F.max(F.when(fit, F.col("recall"))).alias("best_in_budget_recall")).select(
        "p.config", "p.recall", "p.pool_mean", "p.pool_max", "best_in_budget_recall")


def best_dedup(df: DataFrame, budget: float, target: float) -> DataFrame:
    """Of ``method, recall, pool_mean`` rows within budget and at target: the best recall, then
    the smaller pool, then the method name. One row; NULL method if none."""
    ok = (F.col("pool_mean") <= budget) & (F.col("recall") >= target)
    pick = F.min(F.when(ok, F.struct((-F.col("recall")).alias("r"), "pool_mean", "method")))
    return df.agg(pick.alias("p")).select("p.method", (-F.col("p.r")).alias("recall"), "p.pool_mean")


def recall_knee(df: DataFrame, frac: float = C.RECALL_FRAC) -> DataFrame:
    """Highest threshold whose recall is at least ``frac`` of the maximum."""
    top = df.agg(F.max("recall")).scalar()
    return df.where(F.col("recall") >= frac * top).orderBy(F.col("thresh").desc()).limit(1)
