"""Records from loads: one row per key and slot, the latest one counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.periods import period_label, quarter_index


def latest_by_slot(rows: DataFrame, keys: list[str], when: Column, tie: Column, payload: list[Column]) -> DataFrame:
    """The payload of the row with the greatest (when, tie) per key.

    A row loaded twice falls into the same group, so no pass over row ids is
    needed. Max of a struct is combined before the shuffle: a key that holds a
    third of the rows sends one row per task.
    """
    best = F.max(F.struct(when.alias("_when"), tie.alias("_tie"), *payload)).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, "_best.*").drop("_when")


def quarter_rows(revenue: DataFrame, *columns: str) -> DataFrame:
    """The named columns and ``q``, of rows whose period is a single quarter."""
    # exploding what is not null evaluates the label once; a filter would be pushed down and evaluate it again
    q = F.filter(F.array(quarter_index(period_label(F.col("period")))), lambda i: i.isNotNull())
    return revenue.select(*columns, F.explode(q).alias("q"))


def number_or_null(value: Column) -> Column:
    """NaN and infinities are no figures."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(1e300)), value)
