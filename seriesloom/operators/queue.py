"""Quality issues, the publishing gate and the choice of rows to validate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.text import quote_contains

SAMPLE_RATE = 0.10  # share of otherwise unquestioned rows sent to validation


def quality_issues(obs: DataFrame) -> DataFrame:
    """(id, issue, severity): the row rules, and every later reading of a series' period after the first."""
    blank = F.coalesce(F.trim("source_quote"), F.lit("")) == ""
    family = F.col("revenue_scope").isin("Product family", "Formulation-specific", "Franchise") & F.col("formulation_scope").isNull()
    rules = [
        ("missing_source_quote", "high", blank),
        ("source_evidence_missing_value", "high", ~blank & ~quote_contains(F.col("source_quote"), F.col("value"))),
        ("annual_classified_as_quarterly", "high", (F.col("period_type") == "annual") & F.col("period").contains("Q") & (F.col("status") == "auto_pass")),
        ("company_total_as_product", "high", (F.col("revenue_scope") == "Company total") & (F.col("status") == "auto_pass")),
        ("negative_revenue", "medium", F.col("value") < 0),
        ("unclear_currency", "medium", F.coalesce("currency", F.lit("")) == ""),
        ("missing_formulation", "medium", family),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(n).alias("issue"), F.lit(s).alias("severity"))) for n, s, cond in rules]))
    rows = obs.select("id", F.explode(found).alias("i")).select("id", "i.*")
    first = obs.groupBy("series", "period").agg(F.min(F.struct("reported_at", "id")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    again = obs.join(first.select("series", "period", F.col("f.id").alias("first_id")), ["series", "period"]).filter("id != first_id")
    return rows.unionByName(again.select("id", F.lit("duplicate_period_scope_formulation").alias("issue"), F.lit("medium").alias("severity")))


def auto_pass_gate(obs: DataFrame, issues: DataFrame) -> DataFrame:
    """(id, gate): a high issue, a missing citation, a longer span or low confidence hold a row for review."""
    high = issues.filter("severity = 'high'").select("id").distinct().withColumn("high", F.lit(True))
    held = F.coalesce("high", F.lit(False)) | (F.coalesce(F.trim("source_quote"), F.lit("")) == "") | F.col("period_type").isin("six_month", "nine_month") | (F.coalesce("confidence", F.lit(0.0)) < 0.7)
    return obs.join(high, "id", "left").select("id", F.when(held, "needs_review").otherwise("auto_pass").alias("gate"))


def review_tasks(obs: DataFrame, sample: bool) -> DataFrame:
    """(id, reason), the first reason that applies; the sample is drawn by a hash, so it is the same on every run."""
    a, b = Window.partitionBy("series").orderBy("period", "id"), Window.partitionBy("series").orderBy(F.desc("period"), F.desc("id"))
    o = obs.withColumn("a", F.row_number().over(a)).withColumn("b", F.row_number().over(b))
    reason = F.when(F.coalesce("confidence", F.lit(0.0)) < 0.7, "low_confidence").when(F.col("a") <= 2, "early_launch").when(F.col("b") <= 2, "recent_period").when(F.col("status") == "needs_review", "needs_review")
    if sample:
        reason = F.coalesce(reason, F.when((F.col("status") == "auto_pass") & (F.pmod(F.xxhash64("id"), F.lit(1000)) < SAMPLE_RATE * 1000), "random_auto_pass_sample"))
    return o.select("id", reason.alias("reason")).filter("reason is not null")
