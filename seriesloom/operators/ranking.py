"""A global rank without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.session import cut_lineage


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the 1-based place of each row in the total order.

    Rows are spread by ranges of the order and numbered inside their range; the
    number of rows in the ranges before (one row per partition) is added. The
    ranges are drawn from a sample, so they are written down before they are used twice.
    """
    keyed = df.select("*", *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    names = [f"_o{i}" for i in range(len(order))]
    spread = keyed.repartitionByRange(*[F.col(n).asc_nulls_first() for n in names]).withColumn("_p", F.spark_partition_id())
    placed = cut_lineage(spread.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*[F.col(n).asc_nulls_first() for n in names]))))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return placed.join(F.broadcast(before), "_p").withColumn(name, F.col("_r") + F.col("_b")).drop("_p", "_r", "_b", *names)
