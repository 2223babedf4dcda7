"""Words of a printed page to cells: rows from their height, columns from the white space between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page_cells(words: DataFrame, key: str) -> DataFrame:
    """(key, row, col, text) from (key, text, x0, x1, top, bottom).

    Words whose tops lie within half a line of the one above share a row; words
    of a row less than 1.5 median character widths apart share a cell; cells
    that overlap across rows share a column.
    """
    w = Window.partitionBy(key).orderBy("top", "x0")
    line = F.expr(f"percentile(bottom - top, 0.5) over (partition by {key})")
    char = F.expr(f"percentile((x1 - x0) / greatest(length(text), 1), 0.5) over (partition by {key})")
    r = words.withColumn("_gap", 1.5 * char).withColumn("_line", line)
    r = r.withColumn("_new", F.when(F.col("top") - F.lag("top").over(w) <= F.col("_line") / 2, 0).otherwise(1)).withColumn("row", F.sum("_new").over(w) - 1)
    v = Window.partitionBy(key, "row").orderBy("x0", "x1")
    r = r.withColumn("_c", F.sum(F.when(F.col("x0") - F.lag("x1").over(v) < F.col("_gap"), 0).otherwise(1)).over(v))
    cells = r.groupBy(key, "row", "_c").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda t: t["text"]), " ").alias("text"))
    c = Window.partitionBy(key).orderBy("x0", "x1", "row")
    reach = F.max("x1").over(c.rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("_n", F.when(reach.isNull() | (F.col("x0") > reach), 1).otherwise(0)).withColumn("col", F.sum("_n").over(c) - 1)
    return cells.select(key, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "text")
