"""Run an array rule on groups of bounded size, many groups per Python call.

Groups are hashed into bins of about ``limit`` rows. A bin is one Arrow batch for one
grouped-pandas call, which sorts it once and hands each group to the rule as array views, so
small groups cost microseconds. Groups above ``limit`` are returned apart.
"""
from __future__ import annotations

import math
from typing import Callable, Optional

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

BIN = "_bin"


def split_by_size(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, Optional[DataFrame]]:
    """``(small, large)``: groups up to ``limit`` rows with a bin number, and the other rows or None.

    One count per group decides; only its extremes and total reach the driver. Large keys are
    joined back, never listed; when all groups are large there is nothing to join.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    no_key = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))  # joins would lose it: it counts as small
    s = sizes.agg(F.min("_n").alias("least"), F.max("_n").alias("top"), F.sum("_n").alias("total"), F.max(no_key).alias("odd")).first()
    large = None
    if s["least"] is not None and s["least"] > limit and not s["odd"]:
        return df.where(F.lit(False)).withColumn(BIN, F.lit(0).cast("long")), df
    if (s["top"] or 0) > limit:
        big = sizes.where(F.col("_n") > limit).select(*keys)
        large = df.join(big, keys, "left_semi")
        df = df.join(big, keys, "left_anti")
    cores = df.sparkSession.sparkContext.defaultParallelism
    bins = max(math.ceil((s["total"] or 0) / max(limit, 1)), 8 * cores)
    return df.withColumn(BIN, F.pmod(F.xxhash64(*keys), F.lit(bins))), large


def per_group(df: DataFrame, keys: list[str], order: list[str], cols: list[str], rule: Callable,
              out: list[str], value: Optional[str] = None) -> DataFrame:
    """Apply ``rule`` to every group of a binned frame.

    Rows arrive sorted by ``order``. ``rule(arrays)`` gets a dict of arrays and returns
    ``(kept mask, value array or None)``. The result has the ``out`` columns of kept rows
    and, if named, the value as LONG.
    """
    def every(arrays: dict, starts: np.ndarray) -> tuple:
        parts = [rule({c: a[lo:hi] for c, a in arrays.items()}) for lo, hi in zip(starts[:-1], starts[1:])]
        return np.concatenate([p[0] for p in parts]), None if value is None else np.concatenate([p[1] for p in parts])

    return per_bin(df, keys, order, cols, every, out, value)


def per_bin(df: DataFrame, keys: list[str], order: list[str], cols: list[str], rule: Callable,
            out: list[str], value: Optional[str] = None) -> DataFrame:
    """As ``per_group``, but ``rule(arrays, starts)`` gets all groups of a bin at once: group ``i`` is the rows
    ``starts[i]`` to ``starts[i + 1]``."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in out) + (f", {value} long" if value else "")

    def pick(g: dict, starts: np.ndarray) -> pd.DataFrame:
        mask, values = rule({c: g[c] for c in dict.fromkeys([*keys, *cols])}, starts)
        res = pd.DataFrame({c: g[c][mask] for c in out})
        return res if value is None else res.assign(**{value: values[mask]})

    return frame_per_bin(df, keys, order, [*cols, *out], pick, schema)


def frame_per_bin(df: DataFrame, keys: list[str], order: list[str], cols: list[str], rule: Callable, schema: str) -> DataFrame:
    """As ``per_bin``, but ``rule(arrays, starts)`` gives the frame that is returned, in the columns of ``schema``."""
    need = list(dict.fromkeys([*keys, *order, *cols]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cols_of = {c: pdf[c].to_numpy() for c in need}
        sortable = [pd.factorize(a, sort=True)[0] if a.dtype == object else a for a in (cols_of[c] for c in [*keys, *order])]
        at = np.lexsort(sortable[::-1])
        new = np.zeros(len(at), dtype=bool)
        new[0] = True
        for a in sortable[:len(keys)]:
            v = a[at]
            new[1:] |= v[1:] != v[:-1]
        return rule({c: a[at] for c, a in cols_of.items()}, np.append(np.flatnonzero(new), len(at)))

    # the work per byte is high, so the number of tasks is set here and not merged by size
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.select(BIN, *need).repartition(tasks, BIN).groupBy(BIN).applyInPandas(run, schema)
