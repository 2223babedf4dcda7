"""Views over the stored tables in the shapes the operators take, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.periods import let, period_end, period_label, quarter_index
from seriesloom.plans.problem_sql import label, qidx
from seriesloom.session import table

_END = (
    "(CASE WHEN k LIKE '____Q_' THEN last_day(make_date(CAST(substr(k,1,4) AS INT), CAST(substr(k,6,1) AS INT)*3, 1)) "
    "WHEN k LIKE '____H_' THEN last_day(make_date(CAST(substr(k,1,4) AS INT), CAST(substr(k,6,1) AS INT)*6, 1)) "
    "WHEN k LIKE '____M9' THEN make_date(CAST(substr(k,1,4) AS INT), 9, 30) WHEN length(k) = 4 THEN make_date(CAST(k AS INT), 12, 31) END)"
)
_TYPE = "(CASE WHEN k LIKE '____Q_' THEN 'quarterly' WHEN k LIKE '____H_' THEN 'six_month' WHEN k LIKE '____M9' THEN 'nine_month' ELSE 'annual' END)"
_CONFIDENCE = "(CASE validation_status WHEN 'confirmed' THEN 0.95 WHEN 'auto_pass' THEN 0.8 ELSE NULL END)"


def observations(spark: SparkSession, d: str) -> DataFrame:
    """quarterly_revenue's records with a figure, as sales observations."""
    q = table(spark, d, "quarterly_revenue")
    k = F.explode(F.filter(F.array(period_label(F.col("period"))), lambda x: x.isNotNull())).alias("k")
    cols = ["drug_name", "manufacturer", "geography", "revenue_scope", "formulation", "k", "value_reported", "value_normalized_usd_millions", "currency", "series_identity", "source_type", "validation_status", "source_quote"]
    rows = q.select("row_id", "reported_at", *[c for c in cols if c != "k"], k)
    r = rows.groupBy("row_id").agg(F.max(F.struct("reported_at", *cols)).alias("r")).select("row_id", "r.*").filter("value_reported is not null and not isnan(value_reported)")
    kind = let(F.col("k"), lambda x: F.when(x.like("____Q_"), "quarterly").when(x.like("____H_"), "six_month").when(x.like("____M9"), "nine_month").otherwise("annual"))
    return r.select(
        F.col("row_id").alias("id"), F.col("drug_name").alias("product"), F.col("manufacturer").alias("issuer"), F.col("k").alias("period"), F.col("value_reported").alias("value"),
        F.col("value_normalized_usd_millions").alias("usd"), "currency", "geography", "revenue_scope", kind.alias("period_type"), F.lit("calendar").alias("period_basis"),
        F.col("formulation").alias("formulation_scope"), period_end(F.col("k")).alias("period_end"),
        F.when(F.col("validation_status") == "confirmed", 0.95).when(F.col("validation_status") == "auto_pass", 0.8).alias("confidence"),
        quarter_index(F.col("k")).alias("q"), F.col("series_identity").alias("series"), "source_type", F.col("validation_status").alias("status"), F.col("reported_at"), "source_quote",
    )


OBS = (
    f"labelled AS (SELECT *, {label('period')} AS k FROM quarterly_revenue), "
    "records AS (SELECT row_id AS id, any_value(drug_name) AS product, any_value(manufacturer) AS issuer, any_value(k) AS k, any_value(value_reported) AS value, "
    "any_value(value_normalized_usd_millions) AS usd, any_value(currency) AS currency, any_value(geography) AS geography, any_value(revenue_scope) AS revenue_scope, "
    f"any_value(formulation) AS formulation_scope, any_value(series_identity) AS series, any_value(source_type) AS source_type, any_value(validation_status) AS validation_status, max(reported_at) AS reported_at, "
    "any_value(source_quote) AS source_quote FROM labelled WHERE k IS NOT NULL GROUP BY row_id), "
    f"obs AS (SELECT id, product, issuer, k AS period, value, usd, currency, geography, revenue_scope, {_TYPE} AS period_type, 'calendar' AS period_basis, formulation_scope, "
    f"{_END} AS period_end, {_CONFIDENCE} AS confidence, {qidx('k')} AS q, series, source_type, validation_status AS status, reported_at, source_quote FROM records WHERE value IS NOT NULL)"
)


def cells(spark: SparkSession, d: str) -> DataFrame:
    """One figure per series and quarter: the latest record's, in the reported currency."""
    o = observations(spark, d).filter("q is not null")
    best = F.max(F.struct("reported_at", "id", "value", "usd", "product", "geography", "currency", "issuer", "revenue_scope")).alias("b")
    return o.groupBy("series", "q").agg(best).select("series", "q", "b.id", "b.value", "b.usd", "b.product", "b.geography", "b.currency", "b.issuer", "b.revenue_scope")


CELLS = f"{OBS}, cells AS (SELECT series, q, id, value, usd, product, geography, currency, issuer, revenue_scope FROM (SELECT *, row_number() OVER (PARTITION BY series, q ORDER BY reported_at DESC, id DESC) AS rn FROM obs WHERE q IS NOT NULL) WHERE rn = 1)"


def launches(spark: SparkSession, d: str) -> DataFrame:
    """A launch date per product, the first day of its first quarter; unknown for names of a length divisible by three."""
    o = observations(spark, d).filter("q is not null").groupBy("product").agg(F.min("period_end").alias("e"))
    day = F.when(F.length("product") % 3 != 0, F.trunc(F.col("e"), "quarter"))
    return o.select("product", day.alias("launch_date"), F.year(day).alias("launch_year"))


LAUNCHES = (
    "launches AS (SELECT product, CASE WHEN length(product) % 3 <> 0 THEN CAST(date_trunc('quarter', min(period_end)) AS DATE) END AS launch_date, "
    "year(CASE WHEN length(product) % 3 <> 0 THEN CAST(date_trunc('quarter', min(period_end)) AS DATE) END) AS launch_year FROM obs WHERE q IS NOT NULL GROUP BY product)"
)


def estimates(spark: SparkSession, d: str) -> DataFrame:
    """Cited peak estimates: annual regional records stand in for them."""
    o = observations(spark, d).filter("period_type = 'annual' and revenue_scope = 'Regional'")
    kind = F.when(F.col("id") % 3 == 0, "consensus").when(F.col("id") % 3 == 1, "modeled").otherwise("management")
    return o.select("id", "product", kind.alias("estimate_type"), "value", "currency", "geography", "revenue_scope", "formulation_scope", F.to_date("reported_at").alias("as_of_date"))


ESTIMATES = (
    "estimates AS (SELECT id, product, CASE id % 3 WHEN 0 THEN 'consensus' WHEN 1 THEN 'modeled' ELSE 'management' END AS estimate_type, value, currency, geography, revenue_scope, formulation_scope, "
    "CAST(reported_at AS DATE) AS as_of_date FROM obs WHERE period_type = 'annual' AND revenue_scope = 'Regional')"
)
