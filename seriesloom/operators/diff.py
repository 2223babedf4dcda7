"""Differences between two copies of data (problem 4).

Method: a null-safe full outer join on the key, comparing normalised columns
into an array of (field, left value, right value).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.numeric import text_number
from seriesloom.functions.periods import period_label


@dataclass(frozen=True)
class Field:
    """A compared field: its name, the normal form on either side, and how near numbers must be."""

    name: str
    left: Column
    right: Column
    tolerance: float | None = None


def one_per_key(rows: DataFrame, key: str, fields: list[tuple[str, Column]]) -> DataFrame:
    """One row per key; of repeated rows the greatest by the normalised fields counts, the same on every run."""
    packed = rows.select(F.col(key).alias("_key"), F.struct(*[c.alias(n) for n, c in fields]).alias("_f"))
    return packed.groupBy("_key").agg(F.max("_f").alias("_f"))


def compare_copies(left: DataFrame, right: DataFrame, key: str, fields: list[Field]) -> DataFrame:
    """Keys that stand on one side only or differ, with the differences field by field.

    Returns ``key``, ``status`` (``missing_in_right``, ``missing_in_left``,
    ``differs``) and ``differences`` (array of field, left_value, right_value as
    text). Null keys are one key, matched null-safely. A field null on both
    sides is equal, null on one side differs. Repeated rows of a key are one
    row, the greatest; where they conflict ``conflicting_rows`` tells. Only the key and the fields are carried, so extra or clashing columns
    do no harm. Both empty: no rows.
    """
    a = one_per_key(left, key, [(f.name, f.left) for f in fields]).select("_key", F.col("_f").alias("_l"))
    b = one_per_key(right, key, [(f.name, f.right) for f in fields]).select(F.col("_key").alias("_key2"), F.col("_f").alias("_r"))
    both = a.join(b, a["_key"].eqNullSafe(b["_key2"]), "full_outer")
    cells = []
    for f in fields:
        x, y = F.col(f"_l.{f.name}"), F.col(f"_r.{f.name}")
        same = x.eqNullSafe(y)
        if f.tolerance is not None:
            same = same | F.coalesce(F.abs(x - y) <= f.tolerance, F.lit(False))
        cells.append(F.when(~same, F.struct(F.lit(f.name).alias("field"), x.cast("string").alias("left_value"), y.cast("string").alias("right_value"))))
    found = both.select(
        F.coalesce("_key", "_key2").alias(key),
        F.when(F.col("_r").isNull(), "missing_in_right").when(F.col("_l").isNull(), "missing_in_left").otherwise("differs").alias("status"),
        F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.array_compact(F.array(*cells))).alias("differences"),
    )
    return found.filter((F.col("status") != "differs") | (F.size("differences") > 0))


def conflicting_rows(rows: DataFrame, key: str, fields: list[tuple[str, Column]]) -> DataFrame:
    """(key, field, least, greatest): fields in which the repeated rows of one key differ within one copy.

    A field null in some rows and not in others differs; its extremes are those
    of the values there are. Extremes combine before the shuffle.
    """
    packed = rows.select(F.col(key).alias("_key"), *[c.alias(f"_{n}") for n, c in fields])
    ends = [f for n, _ in fields for f in (F.min(f"_{n}").alias(f"lo_{n}"), F.max(f"_{n}").alias(f"hi_{n}"), F.count(f"_{n}").alias(f"n_{n}"))]
    g = packed.groupBy("_key").agg(F.count("*").alias("n"), *ends)
    differs = lambda n: F.coalesce(F.col(f"lo_{n}") != F.col(f"hi_{n}"), F.lit(False)) | ((F.col(f"n_{n}") > 0) & (F.col(f"n_{n}") < F.col("n")))
    found = F.array_compact(F.array(*[F.when(differs(n), F.struct(F.lit(n).alias("field"), F.col(f"lo_{n}").cast("string").alias("least"), F.col(f"hi_{n}").cast("string").alias("greatest"))) for n, _ in fields]))
    return g.filter("n > 1").select(F.col("_key").alias(key), F.explode(found).alias("f")).select(key, "f.*")


def plain_name(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"[\s ]+", " ")))


def meant_period(c: Column) -> Column:
    """The period key, or the plain text where it names no period."""
    return F.coalesce(period_label(c), plain_name(c))


def revenue_fields() -> list[Field]:
    """The compared fields of quarterly_revenue and revenue_export."""
    value = F.col("value_reported")
    return [
        Field("drug_name", plain_name(F.col("drug_name")), plain_name(F.col("drug_name"))),
        Field("period", meant_period(F.col("period")), meant_period(F.col("period"))),
        Field("value_reported", F.when(~F.isnan(value), value), text_number(value), 0.0005 + 1e-9),
        Field("currency", plain_name(F.col("currency")), plain_name(F.col("currency"))),
    ]


def revenue_differences(revenue: DataFrame, export: DataFrame) -> DataFrame:
    """quarterly_revenue against revenue_export by ``row_id``."""
    return compare_copies(revenue, export, "row_id", revenue_fields())


def revenue_conflicts(revenue: DataFrame, export: DataFrame) -> DataFrame:
    """Rows of one ``row_id`` that differ within either copy."""
    fields = revenue_fields()
    a = conflicting_rows(revenue, "row_id", [(f.name, f.left) for f in fields]).select("row_id", F.lit("revenue").alias("copy"), "field", "least", "greatest")
    return a.unionByName(conflicting_rows(export, "row_id", [(f.name, f.right) for f in fields]).select("row_id", F.lit("export").alias("copy"), "field", "least", "greatest"))
