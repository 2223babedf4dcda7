"""Best representative of each duplicate group (problem 6).

Method: field-by-field survivorship. One aggregation takes, for each attribute,
the extreme of a composite struct (non-null, trust, completeness, recency,
value), and with the same order the record that survives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.geo import normalize_geography
from seriesloom.functions.periods import loose_date, period_label
from seriesloom.llm.names import product_classes
from seriesloom.vocab import SOURCE_ORDER

FIELDS = ["value_normalized_usd_millions", "fx_rate_to_usd", "rounding_uncertainty_usd_millions", "scope", "source_quote"]
KEYS = ["job_id", "product", "period_key", "place"]


def source_rank(kind: Column) -> Column:
    """Place in SOURCE_ORDER whatever the case and separators; unknown kinds rank with ``other``; none is last."""
    k = F.regexp_replace(F.lower(F.trim(kind)), r"[\s\-_]+", "_")
    place = F.array_position(F.array(*[F.lit(s) for s in SOURCE_ORDER]), k)
    return F.when(kind.isNull(), len(SOURCE_ORDER) + 1).when(place == 0, SOURCE_ORDER.index("other") + 1).otherwise(place).cast("int")


def readings(datapoints: DataFrame, sources: DataFrame, drug_jobs: DataFrame) -> DataFrame:
    """One row per datapoint with its figure (KEYS) and what it is ranked by.

    A label for two products is a product of its own: the set of the classes of
    its parts. Rows of one id are one record. A label that names no class is
    itself the product; a period that cannot be read is its own text.
    """
    columns = ["job_id", "source_id", "product_label", "period", "geography", "normalization_status", "value_as_reported", *FIELDS, "combined_with", "extracted_at"]
    rows = datapoints.groupBy("id").agg(F.max(F.struct(*columns)).alias("r")).select("id", "r.*")
    src = sources.groupBy(F.col("id").alias("source_id")).agg(F.min(source_rank(F.col("source_type"))).alias("src"), F.max(loose_date(F.col("source_date"))).alias("dated"))
    rows = rows.join(src, "source_id", "left")
    classes = product_classes(drug_jobs, datapoints)
    single = F.coalesce(F.size("combined_with"), F.lit(0)) <= 0
    # the parts of a two-product label are looked up one by one, then put together again
    parts = F.when(single, F.array("product_label")).otherwise(F.transform(F.split("product_label", r"\s+/\s+|\s*\+\s*|\s+and\s+"), lambda p: F.trim(p)))
    labels = rows.select("product_label", single.alias("single"), parts.alias("parts")).distinct()
    looked = labels.select("product_label", "single", F.explode("parts").alias("name")).join(classes, "name", "left")
    looked = looked.groupBy("product_label", "single").agg(F.array_join(F.sort_array(F.collect_set(F.coalesce("class", F.concat(F.lit("?"), F.lower(F.trim("name")))))), "&").alias("product"))
    rows = rows.withColumn("single", single).join(looked, ["product_label", "single"], "left")
    period = F.coalesce(period_label(F.col("period")), F.lower(F.trim("period")))
    number = lambda c: F.col(c).isNotNull() & (~F.isnan(c) if c in FIELDS[:3] else F.lit(True))
    held = sum((number(c).cast("int") for c in FIELDS), F.lit(0))
    return rows.select(
        "*", period.alias("period_key"), normalize_geography(F.col("geography")).alias("place"),
        (F.col("normalization_status") != F.lit("ok")).alias("doubt"), F.coalesce("src", F.lit(len(SOURCE_ORDER) + 1)).alias("trust"),
        (-held).alias("lacking"), (-F.coalesce(F.datediff("dated", F.lit("1900-01-01")), F.lit(-1))).alias("age"),
    )


def survivors(rows: DataFrame) -> DataFrame:
    """One surviving record per figure: the record that ranks first, and each attribute from the first reading that has it.

    Order: status ``ok`` first, then source trust, more of FIELDS known, later
    source date (unknown last), smaller id. Null statuses count as not ok. The
    minimum of a struct is combined before the shuffle, so a figure with a third
    of all readings sends one row per task. ``n_readings`` counts the readings.
    """
    doubt = F.coalesce("doubt", F.lit(True))
    order = [doubt.alias("doubt"), F.col("trust"), F.col("lacking"), F.col("age"), F.col("id")]
    best = [F.min(F.struct(*order)).alias("best"), F.count("*").alias("n_readings")]
    for c in ["value_as_reported", *FIELDS]:
        value = F.when(~F.isnan(c), F.col(c)) if c not in ("scope", "source_quote") else F.col(c)
        best.append(F.min(F.struct(value.isNull().alias("none"), *order, value.alias("value"))).alias(f"_{c}"))
    out = rows.groupBy(*KEYS).agg(*best)
    return out.select(*KEYS, F.col("best.id").alias("datapoint_id"), "n_readings", *[F.col(f"_{c}.value").alias(c) for c in ["value_as_reported", *FIELDS]])
