"""Running totals and exact percentiles over data of any size.

A window without ``partitionBy`` would put the whole table in one task. Here the table is
range-partitioned on a unique order and written once, so block boundaries are fixed; totals per
block give each block its offset, and the window runs inside the block only.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tubelens.session import materialize

BLOCK = "_block"


def range_blocks(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Range-partition by ``(by, order)``, tag the block and fix the result on storage."""
    ranged = df.repartitionByRange(*[F.col(c) for c in by], *order)
    return materialize(ranged.withColumn(BLOCK, F.spark_partition_id()))


def join_groups(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` in which NULL is a key like any other."""
    other = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(other, cond).drop(*[f"_k_{k}" for k in keys])


_FN = {"sum": F.sum, "max": F.max}


def running(df: DataFrame, by: list[str], order: list[Column], cols: dict[str, tuple[str, Column]],
            reverse: bool = False) -> DataFrame:
    """Add inclusive running aggregates to the output of ``range_blocks``.

    ``cols`` maps a new column to ``("sum"|"max", value)``. With ``reverse`` the run goes from
    the end; ``order`` must then be the reversed order.
    """
    inner = Window.partitionBy(*by, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({f"_l_{o}": _FN[fn](v).over(inner) for o, (fn, v) in cols.items()})
    totals = df.groupBy(*by, BLOCK).agg(*[_FN[fn](v).alias(f"_t_{o}") for o, (fn, v) in cols.items()])
    # one row per (group, block): bounded by the number of partitions plus groups
    edge = F.col(BLOCK).desc() if reverse else F.col(BLOCK).asc()
    before = Window.partitionBy(*by).orderBy(edge).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, BLOCK, *[
        _FN[fn](f"_t_{o}").over(before).alias(f"_o_{o}") for o, (fn, _) in cols.items()])
    joined = join_groups(local, offsets, by + [BLOCK])
    out = {}
    for o, (fn, _) in cols.items():
        inside, offset = F.col(f"_l_{o}"), F.col(f"_o_{o}")
        out[o] = inside + F.coalesce(offset, F.lit(0)) if fn == "sum" else F.greatest(inside, offset)
    return joined.withColumns(out).drop(*[p + o for o in cols for p in ("_l_", "_o_")])


def dense_index(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """Add a 0-based index in the given total order."""
    blocks = range_blocks(df, [], order)
    out = running(blocks, [], order, {name: ("sum", F.lit(1).cast("long"))})
    return out.withColumn(name, F.col(name) - 1).drop(BLOCK)


def _value_blocks(per_value: DataFrame, by: list[str], value: str, names) -> DataFrame:
    order = [F.col(value).asc()]
    blocks = range_blocks(per_value, by, order)
    return running(blocks, by, order, {f"cum_{n}": ("sum", F.col(n)) for n in names}).drop(BLOCK)


def value_runs(df: DataFrame, by: list[str], value: str, counts: dict[str, Column]) -> DataFrame:
    """Per distinct value: the given counts and their inclusive running sums ``cum_*``."""
    per_value = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        *[F.sum(c.cast("long")).alias(n) for n, c in counts.items()])
    return _value_blocks(materialize(per_value), by, value, counts)  # the range sampling reads it too


def exact_percentiles(df: DataFrame, by: list[str], value: str, qs) -> DataFrame:
    """Linear-interpolation percentiles per group: ``by..., p<q>..., n``; NULLs are skipped.

    Only distinct values and their counts are sorted, and no group is held by one task.
    """
    return _pick(value_runs(df, by, value, {"n": F.lit(1)}), by, value, qs)


def exact_percentiles_weighted(per_value: DataFrame, by: list[str], value: str, weight: str, qs) -> DataFrame:
    """The same from rows that are already distinct values with their counts."""
    return _pick(_value_blocks(per_value.withColumnRenamed(weight, "n"), by, value, ["n"]), by, value, qs)


def _pick(runs: DataFrame, by: list[str], value: str, qs) -> DataFrame:
    totals = runs.groupBy(*by).agg(F.sum("n").alias("_total"))
    joined = join_groups(runs, totals, by) if by else attach(runs, totals)
    aggs = []
    for q in qs:
        pos = F.lit(q / 100.0) * (F.col("_total") - 1)
        aggs += [F.min(F.when(F.col("cum_n") > F.floor(pos), F.col(value))).alias(f"_lo{q}"),
                 F.min(F.when(F.col("cum_n") > F.ceil(pos), F.col(value))).alias(f"_hi{q}")]
    picked = joined.groupBy(*by).agg(F.max("_total").alias("n"), *aggs)
    return picked.select(*by, *[_interpolated(q).alias(f"p{q}") for q in qs], "n")


def _interpolated(q) -> Column:
    pos = F.lit(q / 100.0) * (F.col("n") - 1)
    lo, hi = F.col(f"_lo{q}").cast("double"), F.col(f"_hi{q}").cast("double")
    return lo + (hi - lo) * (pos - F.floor(pos))


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a global aggregate (exactly one row) to every row."""
    return df.crossJoin(F.broadcast(one_row))
