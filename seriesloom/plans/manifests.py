"""Queries over manifests, companion lines, JSON lines and extraction cadence."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.periods import quarter_label
from seriesloom.operators.manifests import cadence, companion_lines, researched_products
from seriesloom.plans.base import CELLS, cells
from seriesloom.plans.problem_sql import LABEL_OF
from seriesloom.session import shared_folder, table
from seriesloom.sources.files import write_jsonl

QUERIES, ORACLES = {}, {}
c = F.col


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


_DOCS = ["id", "job_id", "source_type", "source_title", "source_url", "source_date", "filing_type", "relevant_datapoints_found"]


@query("q_s30_json_lines", f"SELECT {', '.join(_DOCS)} FROM source_documents")
def s30(spark: SparkSession, d: str) -> DataFrame:
    """source_documents written as JSON lines and read back."""
    rows = table(spark, d, "source_documents").select(*_DOCS)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.jsonl"
    write_jsonl(rows, path)
    return spark.read.schema(rows.schema).json(path)


_META = "meta AS (SELECT lower(trim(drug_name)) AS stem, max(generic_name) AS generic_name, max(manufacturer) AS issuer FROM drug_jobs WHERE drug_name IS NOT NULL GROUP BY 1)"


@query("q_s31_researched_products", f"WITH {CELLS}, {_META}, r AS (SELECT series, q, value, currency, cells.issuer AS own, meta.* FROM cells LEFT JOIN meta ON lower(trim(product)) = stem) "
       f"SELECT series, {LABEL_OF.format('q')} AS period, generic_name, coalesce(own, issuer) AS issuer, CASE WHEN r.currency = 'USD' THEN value ELSE value * usd_per_unit END AS usd, CASE WHEN r.currency <> 'USD' AND usd_per_unit IS NULL THEN 'missing_rate' END AS problem FROM r LEFT JOIN fx_rates f ON r.currency = f.currency AND q // 4 = f.calendar_year")  # fmt: skip
def s31(spark: SparkSession, d: str) -> DataFrame:
    """The latest figures as manifests of their products, with the jobs' metadata."""
    rows = cells(spark, d).select("series", F.lower(F.trim("product")).alias("stem"), quarter_label(c("q")).alias("period"), "value", "currency", "issuer")
    meta = table(spark, d, "drug_jobs").filter("drug_name is not null").groupBy(F.lower(F.trim("drug_name")).alias("stem")).agg(F.max("generic_name").alias("generic_name"), F.max("manufacturer").alias("issuer"))
    return researched_products(rows, meta, table(spark, d, "fx_rates")).select("series", "period", "generic_name", "issuer", "usd", "problem")


_LINES = (
    f"{CELLS}, g AS (SELECT product, min(series) AS gold FROM cells GROUP BY 1), ge AS (SELECT g.product, gold, max(q) AS gold_end, any_value(issuer) AS gold_issuer FROM g JOIN cells ON series = gold GROUP BY 1, 2), "
    "ln AS (SELECT c.series, any_value(c.product) AS product, min(c.q) AS lo, any_value(c.issuer) AS issuer, any_value(c.geography) AS geography, any_value(c.revenue_scope) AS scope FROM cells c GROUP BY 1), "
    "jd AS (SELECT series, CASE WHEN lo > gold_end OR ln.issuer <> gold_issuer THEN CASE WHEN ln.issuer <> gold_issuer THEN 'successor_issuer' WHEN scope = 'Regional' THEN 'narrower_line' ELSE 'renamed_line' END END AS relation, lo, gold_end, geography FROM ln JOIN ge USING (product) WHERE series <> gold), "
    "ok AS (SELECT *, CASE WHEN coalesce(trim(geography), '') = '' THEN 'no_reason_to_stand_apart' WHEN relation IS NOT NULL AND lo <= gold_end THEN 'overlaps_the_series' END AS problem FROM jd)"
)


@query("q_s32_companion_lines", f"WITH {_LINES} SELECT series, CASE WHEN problem IS NOT NULL THEN 'refused' WHEN relation IS NULL THEN 'companion' ELSE 'continuation' END AS role, relation, problem FROM ok")
def s32(spark: SparkSession, d: str) -> DataFrame:
    """Each product's further series beside its first: companions, continuations, and those that cannot stand."""
    k = cells(spark, d)
    line = k.groupBy("series").agg(F.min("product").alias("product"), F.min("q").alias("lo"), F.max("q").alias("hi"), F.min("issuer").alias("issuer"), F.min("geography").alias("why_separate"), F.min("revenue_scope").alias("scope"))
    gold = line.groupBy("product").agg(F.min(F.struct("series", "hi", "issuer")).alias("g")).select("product", c("g.series").alias("gold"), c("g.hi").alias("gold_end"), c("g.issuer").alias("gold_issuer"))
    j = line.join(gold, "product").filter("series != gold")
    other = c("issuer") != c("gold_issuer")
    relation = F.when((c("lo") > c("gold_end")) | other, F.when(other, "successor_issuer").when(c("scope") == "Regional", "narrower_line").otherwise("renamed_line"))
    lines = j.select("series", "product", "lo", "gold_end", "why_separate", relation.alias("relation"), F.lit(None).cast("array<string>").alias("line_includes"), c("issuer").alias("evidence"))
    return companion_lines(lines).select("series", "role", "relation", "problem")


@query("q_k08_cadence", f"WITH {CELLS}, s AS (SELECT series, max(q) AS last, count(*) AS n FROM cells GROUP BY 1), t AS (SELECT max(q) AS now FROM cells) "
       f"SELECT series, CASE WHEN last >= now - 3 AND n >= 2 THEN 'quarterly' ELSE 'one_off' END AS cadence, CASE WHEN last >= now - 3 AND n >= 2 THEN {LABEL_OF.format('(last + 1)')} END AS due FROM s, t")  # fmt: skip
def k08(spark: SparkSession, d: str) -> DataFrame:
    k = cells(spark, d)
    return cadence(k, "series", "q").select("series", "cadence", quarter_label(c("due")).alias("due"))
