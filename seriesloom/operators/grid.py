"""Irregular readings onto a regular grid (problem 1).

Method: a harmonic seasonal regression with trend per key, fitted from normal
equations that are summed where the rows lie (a plain aggregation, so each task
sends one row of 20 sums per key), predicts every grid slot; residuals at the
two observed neighbours of a gap are bridged linearly over it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.periods import let

RIDGE = 1e-3  # keeps the equations solvable for a key with few readings


def _terms(x: Column, season: int, harmonics: int) -> list[Column]:
    """1, trend, cosines and sines; the sine at half the season is zero on a grid and left out."""
    terms = [F.lit(1.0), x / F.lit(10.0 * season)]
    for h in range(1, harmonics + 1):
        angle = x * F.lit(2 * np.pi * h / season)
        terms.append(F.cos(angle))
        if 2 * h != season:
            terms.append(F.sin(angle))
    return terms


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(upper: pd.Series, right: pd.Series) -> pd.Series:
    """Solve stacked symmetric systems given by their upper triangles."""
    if not len(upper):
        return pd.Series([], dtype=object)
    b = np.stack([np.asarray(r, dtype=float) for r in right])
    p = b.shape[1]
    a = np.zeros((len(b), p, p))
    i, j = np.triu_indices(p)
    a[:, i, j] = np.stack([np.asarray(u, dtype=float) for u in upper])
    a[:, j, i] = a[:, i, j]
    penalty = RIDGE * np.eye(p)
    penalty[0, 0] = RIDGE * 1e-3
    return pd.Series(list(np.linalg.solve(a + penalty, b[:, :, None])[:, :, 0]))


def regular_grid(points: DataFrame, keys: list[str], index: str, value: str, season: int = 4, harmonics: int = 2, bounded: bool = True) -> DataFrame:
    """One row per key and grid slot between the key's first and last reading.

    ``points`` has at most one row per (keys, index). Rows whose key, index or
    value is null (or NaN) are no readings and are dropped. Returns ``keys``,
    ``index``, ``value`` (observed, else bridged prediction), ``fitted`` (the
    regression alone) and ``is_observed``. Where ``bounded``, a fill between two
    readings that are not negative is none either; where the equations give no
    finite prediction the gap is bridged in a straight line, so every slot has a
    value. A key with one reading yields that one row; an empty table yields
    none. Columns of ``points`` other than the named ones are ignored, so
    clashing names do no harm.
    """
    obs = points.select(*keys, F.col(index).cast("int").alias("_i"), F.col(value).cast("double").alias("_v"))
    obs = obs.filter(F.col("_i").isNotNull() & F.col("_v").isNotNull() & ~F.isnan("_v"))
    ts = _terms(F.col("_i").cast("double") - F.lit(8060.0), season, harmonics)
    p = len(ts)
    lettered = obs.select(*keys, "_v", *[t.alias(f"_t{k}") for k, t in enumerate(ts)])
    sums = [F.sum(F.col(f"_t{i}") * F.col(f"_t{j}")) for i in range(p) for j in range(i, p)]
    fits = (
        lettered.groupBy(*keys)
        .agg(F.array(*sums).alias("_u"), F.array(*[F.sum(F.col(f"_t{i}") * F.col("_v")) for i in range(p)]).alias("_r"))
        .select(*keys, _solve("_u", "_r").alias("_b"))
    )
    w = Window.partitionBy(*keys).orderBy("_i")
    spans = obs.withColumn("_ni", F.lead("_i").over(w)).withColumn("_nv", F.lead("_v").over(w))

    def fit(i: Column) -> Column:
        total = F.lit(0.0)
        for k, t in enumerate(_terms(i.cast("double") - F.lit(8060.0), season, harmonics)):
            total = total + F.col("_b")[k] * t
        return total

    # AQE may split a key's rows here: fits has one row per key, so the join carries no group to one task
    joined = spans.join(fits, keys, "inner")
    slots = joined.withColumn("_g", F.explode(F.sequence("_i", F.coalesce(F.col("_ni") - 1, F.col("_i")))))
    share = (F.col("_g") - F.col("_i")) / (F.col("_ni") - F.col("_i"))
    left, right = F.col("_v") - fit(F.col("_i")), F.col("_nv") - fit(F.col("_ni"))
    seen = F.col("_g") == F.col("_i")
    straight = F.col("_v") + share * (F.col("_nv") - F.col("_v"))
    fill = let(fit(F.col("_g")) + left + share * (right - left), lambda x: F.when(F.abs(x) < F.lit(1e300), x).otherwise(straight))
    if bounded:
        fill = let(fill, lambda x: F.when((x < 0) & (F.col("_v") >= 0) & (F.col("_nv") >= 0), 0.0).otherwise(x))
    return slots.select(
        *keys,
        F.col("_g").alias(index),
        F.when(seen, F.col("_v")).otherwise(fill).alias(value),
        fit(F.col("_g")).alias("fitted"),
        seen.alias("is_observed"),
    )
