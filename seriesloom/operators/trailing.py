"""Rolling totals over trailing periods (problem 2).

Method: binary doubling. On a dense grid the sums of 1, 2, 4, 8, 16 slots are
each made from two shifted copies of the one before, and a window of any length
is put together from the blocks of its binary digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(28,6)"  # exact sums, whatever the order of the rows


def dense(points: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Every slot from a key's first to its last non-null value; null or absent counts as 0.

    ``points`` has at most one row per (keys, index). NaN counts as null. Keys
    without any value yield no row.
    """
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    obs = points.select(*keys, F.col(index).cast("int").alias("_i"), v.alias("_v")).filter("_i is not null and _v is not null")
    w = Window.partitionBy(*keys).orderBy("_i")
    return (
        obs.withColumn("_n", F.lead("_i").over(w))
        .withColumn("_g", F.explode(F.sequence("_i", F.coalesce(F.col("_n") - 1, F.col("_i")))))
        .select(*keys, F.col("_g").alias(index), F.when(F.col("_g") == F.col("_i"), F.col("_v")).otherwise(0.0).cast(MONEY).alias(value))
    )


def trailing_totals(points: DataFrame, keys: list[str], index: str, value: str, windows: tuple[int, ...] = (2, 4, 8)) -> DataFrame:
    """Totals and averages over each trailing window, for every slot of every key.

    Adds ``total_n``, ``average_n`` and ``full_n`` (whether n slots lie inside
    the key's range). Before that the total covers the slots there are and the
    average divides by their number. One shuffle and one sort serve all windows.
    """
    grid = dense(points, keys, index, value)
    w = Window.partitionBy(*keys).orderBy(index)
    out = grid.withColumn("_pos", F.row_number().over(w)).withColumn("_s1", F.col(value))
    zero = F.lit(0).cast(MONEY)
    size = 1
    while size * 2 <= max(windows):
        block = F.col(f"_s{size}") + F.coalesce(F.lag(f"_s{size}", size).over(w), zero)
        out = out.withColumn(f"_s{2 * size}", block.cast(MONEY))
        size *= 2
    for n in sorted(set(windows)):
        total, done, bit = None, 0, size
        while bit:
            if n & bit:
                block = F.col(f"_s{bit}") if not done else F.coalesce(F.lag(f"_s{bit}", done).over(w), zero)
                total = block if total is None else total + block
                done += bit
            bit //= 2
        out = out.withColumn(f"total_{n}", total.cast(MONEY))
        out = out.withColumn(f"average_{n}", F.col(f"total_{n}").cast("double") / F.least(F.col("_pos"), F.lit(n)))
        out = out.withColumn(f"full_{n}", F.col("_pos") >= n)
    keep = [c for n in sorted(set(windows)) for c in (f"total_{n}", f"average_{n}", f"full_{n}")]
    return out.select(*keys, index, value, *keep)
