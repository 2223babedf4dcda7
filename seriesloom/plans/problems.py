"""Queries for the general data problems over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.periods import quarter_label
from seriesloom.operators.diff import revenue_conflicts, revenue_differences
from seriesloom.operators.grid import regular_grid
from seriesloom.operators.latest import latest_by_slot, number_or_null, quarter_rows
from seriesloom.operators.spikes import EXPLAINED, FLOOR, FROZEN, STEEPNESS, revenue_implausible
from seriesloom.operators.trailing import trailing_totals
from seriesloom.operators.units import convert_amounts, misconverted
from seriesloom.plans import problem_sql
from seriesloom.session import table


def _grid(spark: SparkSession, d: str) -> DataFrame:
    rows = quarter_rows(table(spark, d, "quarterly_revenue"), "series_identity", "value_reported", "reported_at", "row_id")
    rows = rows.withColumn("value_reported", number_or_null(F.col("value_reported"))).filter("value_reported is not null and series_identity is not null")
    points = latest_by_slot(rows, ["series_identity", "q"], F.col("reported_at"), F.col("row_id"), [F.col("value_reported")])
    return regular_grid(points, ["series_identity"], "q", "value_reported")


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every series with exactly one row per quarter; gaps are predicted, to four places, and marked."""
    g = _grid(spark, d)
    return g.select("series_identity", quarter_label(F.col("q")).alias("period"), F.round("value_reported", 4).alias("value_reported"), F.round("fitted", 4).alias("fitted"), F.when(F.col("is_observed"), "observed").otherwise("filled").alias("status"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The quarters the grid fills: those that come out of it with a predicted value."""
    return _grid(spark, d).filter("not is_observed and value_reported is not null and not isnan(value_reported)").select("series_identity", quarter_label(F.col("q")).alias("period"))


def _trailing(spark: SparkSession, d: str, windows: tuple[int, ...]) -> DataFrame:
    rows = quarter_rows(table(spark, d, "quarterly_revenue"), "series_identity", "value_normalized_usd_millions", "reported_at", "row_id").filter("series_identity is not null")
    points = latest_by_slot(rows, ["series_identity", "q"], F.col("reported_at"), F.col("row_id"), [F.col("value_normalized_usd_millions")])
    return trailing_totals(points, ["series_identity"], "q", "value_normalized_usd_millions", windows)


def p2_trailing(spark: SparkSession, d: str) -> DataFrame:
    """Totals and averages over the trailing two, four and eight quarters of every series and quarter."""
    t = _trailing(spark, d, (2, 4, 8))
    sums = [F.col(f"total_{n}").cast("double").alias(f"total_{n}") for n in (2, 4, 8)]
    return t.select("series_identity", quarter_label(F.col("q")).alias("period"), *sums, *[f"average_{n}" for n in (2, 4, 8)], *[f"full_{n}" for n in (2, 4, 8)])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The last quarter of each series' highest trailing four-quarter total, the earliest of equals."""
    t = _trailing(spark, d, (4,)).filter("full_4")
    best = F.max(F.struct(F.round("total_4", 3).alias("t"), (-F.col("q")).alias("q"))).alias("b")
    return t.groupBy("series_identity").agg(best).select("series_identity", quarter_label(-F.col("b.q")).alias("period"))


def _differences(spark: SparkSession, d: str) -> DataFrame:
    return revenue_differences(table(spark, d, "quarterly_revenue"), table(spark, d, "revenue_export"))


def p4_differences(spark: SparkSession, d: str) -> DataFrame:
    """One row per record that differs, with the differing fields."""
    return _differences(spark, d).select("row_id", "status", F.transform("differences", lambda x: F.concat_ws("=", x["field"], F.concat_ws("|", F.coalesce(x["left_value"], F.lit("null")), F.coalesce(x["right_value"], F.lit("null"))))).alias("differences"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("status") == "missing_in_right", F.array(F.lit("missing_in_export"))).when(F.col("status") == "missing_in_left", F.array(F.lit("missing_in_revenue")))
    return _differences(spark, d).select("row_id", F.explode(F.coalesce(said, F.transform("differences", lambda x: x["field"]))).alias("difference"))


def p4_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Records whose repeated rows differ within one copy."""
    return revenue_conflicts(table(spark, d, "quarterly_revenue"), table(spark, d, "revenue_export"))


def p5_converted(spark: SparkSession, d: str) -> DataFrame:
    """Every datapoint's amount in millions of US dollars, or the reason there is none."""
    return convert_amounts(table(spark, d, "datapoints"), table(spark, d, "fx_rates")).withColumnRenamed("id", "datapoint_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return misconverted(convert_amounts(table(spark, d, "datapoints"), table(spark, d, "fx_rates"))).select(F.col("id").alias("datapoint_id"))


def p7_implausible(spark: SparkSession, d: str) -> DataFrame:
    """Every implausible record with what is wrong with it."""
    return revenue_implausible(table(spark, d, "quarterly_revenue"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return revenue_implausible(table(spark, d, "quarterly_revenue")).select("row_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_grid, p2_found, p2_trailing, p4_found, p4_differences, p4_conflicts, p5_found, p5_converted, p7_found, p7_implausible)}
_P7 = problem_sql.p7(EXPLAINED, FLOOR, STEEPNESS, FROZEN)
ORACLES = {"p7_implausible": _P7, "p7_found": f"SELECT DISTINCT row_id FROM ({_P7})"}
