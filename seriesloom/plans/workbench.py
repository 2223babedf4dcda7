"""Queries of the review queue, dashboard, products list, exports and job administration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.functions.periods import quarter_label
from seriesloom.functions.text import analog_key, is_missing, normalize_value
from seriesloom.operators.annual import money_sum
from seriesloom.operators.ranking import global_rank
from seriesloom.operators.queue import auto_pass_gate, quality_issues, review_tasks
from seriesloom.plans.base import CELLS, LAUNCHES, OBS, cells, launches, observations
from seriesloom.plans.problem_sql import LABEL_OF, label, qidx
from seriesloom.plans.readings import DP, RANKED, SRC, ranked, readings, sources
from seriesloom.plans.series import _gaps
from seriesloom.session import table
from seriesloom.vocab import SOURCE_ORDER

QUERIES, ORACLES = {}, {}
c = F.col


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """drug_jobs' records: rows of one id are one job."""
    j = table(spark, d, "drug_jobs")
    rest = [x for x in j.columns if x != "id"]
    return j.groupBy("id").agg(F.max(F.struct("updated_at", *[x for x in rest if x != "updated_at"])).alias("r")).select("id", "r.*")


JOB = "jobs AS (SELECT DISTINCT * FROM drug_jobs)"
_KEY = "lower(trim(regexp_replace(drug_name, '\\s+', ' ', 'g')))"
_GAPSQL = f"{CELLS}, gp AS (SELECT g.series, g.q FROM (SELECT series, unnest(range(min(q), max(q) + 1)) AS q FROM cells GROUP BY series) g ANTI JOIN cells c2 ON g.series = c2.series AND g.q = c2.q), names AS (SELECT series, any_value(product) AS product FROM cells GROUP BY 1), missing AS (SELECT DISTINCT product, q FROM gp JOIN names USING (series))"


def missing_quarters(spark: SparkSession, d: str) -> DataFrame:
    k = cells(spark, d)
    return _gaps(k).join(k.groupBy("series").agg(F.min("product").alias("product")), "series").select("product", "q").distinct()


def _union(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = observations(spark, d)
    held = o.filter("q is not null and status in ('auto_pass', 'confirmed')").select("product", "q").distinct()
    asked = o.select("product").distinct().select("product", F.explode(F.sequence(F.lit(2023 * 4), F.lit(2023 * 4 + 3))).alias("q"))
    return held, missing_quarters(spark, d), asked


_HELD = f"{_GAPSQL}, held AS (SELECT DISTINCT product, q FROM obs WHERE q IS NOT NULL AND status IN ('auto_pass', 'confirmed')), asked AS (SELECT product, unnest(range(8092, 8096)) AS q FROM (SELECT DISTINCT product FROM obs)), alln AS (SELECT product, q FROM held UNION SELECT product, q FROM missing UNION SELECT product, q FROM asked)"


@query("q_g06_completeness", f"WITH {_HELD} SELECT a.product, coalesce(h.n, 0) AS held, coalesce(m.n, 0) AS missing, round(100.0 * coalesce(h.n, 0) / a.n, 1) AS pct FROM (SELECT product, count(*) AS n FROM alln GROUP BY 1) a LEFT JOIN (SELECT product, count(*) AS n FROM held GROUP BY 1) h USING (product) LEFT JOIN (SELECT product, count(*) AS n FROM missing GROUP BY 1) m USING (product)")
def g06(spark: SparkSession, d: str) -> DataFrame:
    return completeness(*_union(spark, d))


def completeness(held: DataFrame, missing: DataFrame, asked: DataFrame) -> DataFrame:
    """Held quarters as a share of those asked for, held or missing; three flags per quarter in one aggregation."""
    tag = lambda df, h, m: df.select("product", "q", F.lit(h).alias("h"), F.lit(m).alias("m"))
    rows = tag(held, 1, 0).unionByName(tag(missing, 0, 1)).unionByName(tag(asked, 0, 0)).groupBy("product", "q").agg(F.max("h").alias("h"), F.max("m").alias("m"))
    g = rows.groupBy("product").agg(F.sum("h").alias("held"), F.sum("m").alias("missing"), F.count("*").alias("n"))
    return g.select("product", "held", "missing", F.round(100.0 * c("held") / c("n"), 1).alias("pct"))


QUERIES["q_c22_refresh_completeness"], ORACLES["q_c22_refresh_completeness"] = g06, ORACLES["q_g06_completeness"]


@query("q_u02_asked_held_missing", f"WITH {_HELD} SELECT product, q FROM alln")
def u02(spark: SparkSession, d: str) -> DataFrame:
    held, missing, asked = _union(spark, d)
    return held.unionByName(missing).unionByName(asked).distinct()


@query("q_u04_asked_minus_answered", f"WITH {_HELD} SELECT a.product, {LABEL_OF.format('a.q')} AS period FROM asked a ANTI JOIN held h ON a.product = h.product AND a.q = h.q")
def u04(spark: SparkSession, d: str) -> DataFrame:
    held, _, asked = _union(spark, d)
    return asked.join(held, ["product", "q"], "left_anti").select("product", quarter_label(c("q")).alias("period"))


@query("q_g07_published_quarters", f"WITH {OBS} SELECT product, count(DISTINCT period) AS published FROM obs WHERE q IS NOT NULL AND status IN ('auto_pass', 'confirmed') GROUP BY 1")
def g07(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d).filter("q is not null and status in ('auto_pass', 'confirmed')")
    return o.groupBy("product").agg(F.count_distinct("period").alias("published"))


# --- review queue ------------------------------------------------------------------------------

_QUEUE = (
    f"{_GAPSQL}, qu AS (SELECT 'flagged' AS kind, product, period, 'needs_review' AS reason, CAST(id AS VARCHAR) AS item FROM obs WHERE status = 'needs_review' AND q IS NOT NULL UNION ALL SELECT 'missing', product, {LABEL_OF.format('q')}, 'gap', product || '/' || q FROM missing)"
)


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Flagged figures and missing quarters in one list."""
    flagged = observations(spark, d).filter("status = 'needs_review' and q is not null").select(F.lit("flagged").alias("kind"), "product", "period", F.lit("needs_review").alias("reason"), c("id").cast("string").alias("item"))
    m = missing_quarters(spark, d)
    gaps = m.select(F.lit("missing").alias("kind"), "product", quarter_label(c("q")).alias("period"), F.lit("gap").alias("reason"), F.concat("product", F.lit("/"), c("q").cast("string")).alias("item"))
    return flagged.unionByName(gaps)


@query("q_j01_flagged_queue", f"WITH {_QUEUE} SELECT product, period, item FROM qu WHERE kind = 'flagged'")
def j01(spark: SparkSession, d: str) -> DataFrame:
    return review_queue(spark, d).filter("kind = 'flagged'").select("product", "period", "item")


@query("q_j02_missing_queue", f"WITH {_QUEUE} SELECT product, period FROM qu WHERE kind = 'missing'")
def j02(spark: SparkSession, d: str) -> DataFrame:
    return review_queue(spark, d).filter("kind = 'missing'").select("product", "period")


@query("q_u01_queue_union", f"WITH {_QUEUE} SELECT * FROM qu")
def u01(spark: SparkSession, d: str) -> DataFrame:
    return review_queue(spark, d)


@query("q_g08_open_queue_counts", f"WITH {_QUEUE} SELECT product, count(*) FILTER (kind = 'flagged') AS flagged, count(*) FILTER (kind = 'missing') AS missing FROM qu GROUP BY 1")
def g08(spark: SparkSession, d: str) -> DataFrame:
    return review_queue(spark, d).groupBy("product").agg(F.count_if(c("kind") == "flagged").alias("flagged"), F.count_if(c("kind") == "missing").alias("missing"))


_GROUPS = f"{_QUEUE}, gq AS (SELECT product, period, count(*) AS items, list_sort(list(DISTINCT kind)) AS kinds, list_sort(list(DISTINCT reason)) AS reasons FROM qu GROUP BY 1, 2)"


def queue_groups(spark: SparkSession, d: str) -> DataFrame:
    return review_queue(spark, d).groupBy("product", "period").agg(F.count("*").alias("items"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.collect_set("reason")).alias("reasons"))


@query("q_g28_queue_groups", f"WITH {_GROUPS} SELECT * FROM gq")
def g28(spark: SparkSession, d: str) -> DataFrame:
    return queue_groups(spark, d)


@query("q_t01_queue_page", f"WITH {_GROUPS} SELECT product, period, items FROM gq ORDER BY product, period LIMIT 50 OFFSET 100")
def t01(spark: SparkSession, d: str) -> DataFrame:
    """The third page of fifty groups; paging is the feature."""
    return page(queue_groups(spark, d).select("product", "period", "items"), ["product", "period"], 50, 100)


def page(df: DataFrame, order: list[str], limit: int, offset: int) -> DataFrame:
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(limit, 1), 500))


# --- jobs and products -------------------------------------------------------------------------


@query("q_w18_newest_job", f"WITH {JOB} SELECT key, id FROM (SELECT {_KEY} AS key, id, row_number() OVER (PARTITION BY {_KEY} ORDER BY created_at DESC, id DESC) AS rn FROM jobs) WHERE rn = 1")
def w18(spark: SparkSession, d: str) -> DataFrame:
    j = jobs(spark, d).groupBy(analog_key(c("drug_name")).alias("key")).agg(F.max(F.struct("created_at", "id")).alias("b"))
    return j.select("key", c("b.id").alias("id"))


@query("q_g14_dedupe_jobs", f"WITH {JOB} SELECT key, id, completeness_pct FROM (SELECT {_KEY} AS key, id, completeness_pct, row_number() OVER (PARTITION BY {_KEY} ORDER BY coalesce(completeness_pct, 0) DESC, updated_at DESC, id DESC) AS rn FROM jobs) WHERE rn = 1 AND key <> ''")
def g14(spark: SparkSession, d: str) -> DataFrame:
    j = jobs(spark, d).groupBy(analog_key(c("drug_name")).alias("key")).agg(F.max(F.struct(F.coalesce("completeness_pct", F.lit(0.0)).alias("p"), F.coalesce("updated_at", "created_at").alias("t"), "id", "completeness_pct")).alias("b"))
    return j.filter("key != ''").select("key", c("b.id").alias("id"), c("b.completeness_pct").alias("completeness_pct"))


@query("q_g10_overview", f"WITH {JOB} SELECT 'job:' || status AS what, count(*) AS n FROM jobs GROUP BY 1 UNION ALL SELECT 'datapoints', count(DISTINCT id) FROM datapoints UNION ALL SELECT 'source_documents', count(DISTINCT id) FROM source_documents")
def g10(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t: table(spark, d, t).agg(F.count_distinct("id").alias("n")).select(F.lit(t).alias("what"), "n")
    by = jobs(spark, d).groupBy(F.concat(F.lit("job:"), "status").alias("what")).agg(F.count("*").alias("n"))
    return by.unionByName(one("datapoints")).unionByName(one("source_documents"))


@query(
    "q_g25_run_status",
    f"WITH {JOB}, r AS (SELECT run_id, bool_and(status IN ('ready_for_review', 'completed', 'failed', 'cancelled')) AS done, bool_or(status = 'failed') AS f, bool_or(status = 'ready_for_review') AS rr, bool_or(status = 'completed') AS cc, bool_or(status = 'cancelled') AS x FROM jobs GROUP BY 1) "
    "SELECT run_id, CASE WHEN NOT done THEN 'running' WHEN f AND NOT rr AND NOT cc THEN 'failed' WHEN rr THEN 'ready_for_review' WHEN x AND NOT cc THEN 'cancelled' ELSE 'completed' END AS status FROM r",
)
def g25(spark: SparkSession, d: str) -> DataFrame:
    has = lambda s: F.bool_or(c("status") == s)
    done = F.bool_and(c("status").isin("ready_for_review", "completed", "failed", "cancelled"))
    status = F.when(~done, "running").when(has("failed") & ~has("ready_for_review") & ~has("completed"), "failed").when(has("ready_for_review"), "ready_for_review").when(has("cancelled") & ~has("completed"), "cancelled").otherwise("completed")
    return jobs(spark, d).groupBy("run_id").agg(status.alias("status"))


@query("q_c48_stranded_jobs", f"WITH {JOB}, n AS (SELECT job_id, bool_and(NOT list_contains(flags, 'label_not_understood')) AS decided FROM datapoints GROUP BY 1) SELECT jobs.id, CASE WHEN status = 'queued' THEN 'requeue' WHEN coalesce(decided, false) THEN 'settle' ELSE 'fail' END AS action FROM jobs LEFT JOIN n ON jobs.id = n.job_id WHERE status IN ('queued', 'running')")
def c48(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "datapoints").groupBy(c("job_id").alias("id")).agg(F.bool_and(~F.array_contains("flags", "label_not_understood")).alias("decided"))
    j = jobs(spark, d).filter(c("status").isin("queued", "running")).join(n, "id", "left")
    return j.select("id", F.when(c("status") == "queued", "requeue").when(F.coalesce("decided", F.lit(False)), "settle").otherwise("fail").alias("action"))


@query("q_g15_phase3_programs", f"WITH {JOB} SELECT lower(trim(manufacturer)) AS sponsor, {_KEY} AS asset, list_sort(list(DISTINCT id)) AS trials FROM jobs WHERE manufacturer IS NOT NULL GROUP BY 1, 2")
def g15(spark: SparkSession, d: str) -> DataFrame:
    j = jobs(spark, d).filter("manufacturer is not null")
    return j.groupBy(F.lower(F.trim("manufacturer")).alias("sponsor"), analog_key(c("drug_name")).alias("asset")).agg(F.array_sort(F.collect_set("id")).alias("trials"))


@query("q_g31_earliest_approval", f"WITH {JOB} SELECT {_KEY} AS key, coalesce(min(CAST(created_at AS DATE)) FILTER (status = 'completed'), min(CAST(created_at AS DATE))) AS first_day, CASE WHEN count(*) FILTER (status = 'completed') > 0 THEN 'original' ELSE 'any' END AS basis FROM jobs GROUP BY 1")
def g31(spark: SparkSession, d: str) -> DataFrame:
    day, first = F.to_date("created_at"), c("status") == "completed"
    return jobs(spark, d).groupBy(analog_key(c("drug_name")).alias("key")).agg(F.coalesce(F.min(F.when(first, day)), F.min(day)).alias("first_day"), F.when(F.count_if(first) > 0, "original").otherwise("any").alias("basis"))


_EAV = f"{JOB}, eav AS (SELECT id, {_KEY} AS key, field, value, list_position(['completed', 'ready_for_review', 'running'], status) AS sr FROM (SELECT id, drug_name, status, unnest(['generic', 'ticker', 'cik', 'indication']) AS field, unnest([generic_name, ticker, cik, indication]) AS value FROM jobs) WHERE value IS NOT NULL)"


def profile_fields(spark: SparkSession, d: str) -> DataFrame:
    """Jobs' profile as (key, field, value, rank of the job's status, job)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), c(x).alias("value")) for f, x in (("generic", "generic_name"), ("ticker", "ticker"), ("cik", "cik"), ("indication", "indication"))])
    rank = F.coalesce(F.nullif(F.array_position(F.array(F.lit("completed"), F.lit("ready_for_review"), F.lit("running")), c("status")), F.lit(0)), F.lit(99))
    e = jobs(spark, d).select("id", analog_key(c("drug_name")).alias("key"), rank.alias("sr"), F.explode(pairs).alias("p"))
    return e.select("id", "key", "sr", "p.*").filter("value is not null")


@query("q_g13_selected_profile", f"WITH {_EAV}, r AS (SELECT *, row_number() OVER (PARTITION BY key, field ORDER BY coalesce(nullif(sr, 0), 99), id) AS rn FROM eav) SELECT key, " + ", ".join(f"max(value) FILTER (field = '{f}' AND rn = 1) AS {f}" for f in ("generic", "ticker", "cik", "indication")) + " FROM r GROUP BY 1")
def g13(spark: SparkSession, d: str) -> DataFrame:
    best = lambda f: F.min(F.when(c("field") == f, F.struct("sr", "id", "value")))["value"].alias(f)
    return profile_fields(spark, d).groupBy("key").agg(*[best(f) for f in ("generic", "ticker", "cik", "indication")])


@query("q_t10_select_assertion", f"WITH {_EAV} SELECT key, field, arg_min(value, (coalesce(nullif(sr, 0), 99), id)) AS value FROM eav GROUP BY 1, 2")
def t10(spark: SparkSession, d: str) -> DataFrame:
    return profile_fields(spark, d).groupBy("key", "field").agg(F.min(F.struct("sr", "id", "value")).alias("m")).select("key", "field", c("m.value").alias("value"))


@query("q_t09_fields_to_judge", f"WITH {_EAV}, f AS (SELECT key, field, count(DISTINCT lower(trim(value))) > 1 AS conflict FROM eav GROUP BY 1, 2) SELECT key, field, conflict, row_number() OVER (PARTITION BY key ORDER BY conflict DESC, CASE field WHEN 'indication' THEN 6 ELSE 99 END, field) AS place FROM f")
def t09(spark: SparkSession, d: str) -> DataFrame:
    f = profile_fields(spark, d).filter(~is_missing(c("value"))).groupBy("key", "field").agg((F.count_distinct(F.lower(F.trim("value"))) > 1).alias("conflict"))
    w = Window.partitionBy("key").orderBy(F.desc("conflict"), F.when(c("field") == "indication", 6).otherwise(99), "field")
    return f.withColumn("place", F.row_number().over(w))


@query("q_b15_label_metadata", f"WITH {_EAV}, v AS (SELECT key, field, arg_min(value, (id)) AS value, count(DISTINCT lower(trim(value))) AS spellings FROM eav GROUP BY 1, 2) SELECT key, field, value, spellings > 1 AS conflict FROM v")
def b15(spark: SparkSession, d: str) -> DataFrame:
    """First value per field wins, a later disagreement is recorded."""
    return profile_fields(spark, d).groupBy("key", "field").agg(F.min_by("value", "id").alias("value"), (F.count_distinct(F.lower(F.trim("value"))) > 1).alias("conflict"))


@query("q_b16_identity", f"WITH {JOB}, t AS (SELECT ticker, count(DISTINCT cik) AS n, min(cik) AS cik FROM jobs WHERE cik IS NOT NULL AND ticker IS NOT NULL GROUP BY 1), m AS (SELECT lower(trim(manufacturer)) AS m, count(DISTINCT cik) AS n, min(cik) AS cik FROM jobs WHERE cik IS NOT NULL AND manufacturer IS NOT NULL GROUP BY 1) "
       "SELECT j.id, coalesce(j.cik, CASE WHEN t.n = 1 THEN t.cik END, CASE WHEN m.n = 1 THEN m.cik END) AS cik, CASE WHEN j.cik IS NOT NULL THEN 'stated' WHEN t.n = 1 THEN 'ticker' WHEN m.n = 1 THEN 'name' ELSE 'unresolved' END AS basis FROM jobs j LEFT JOIN t USING (ticker) LEFT JOIN m ON lower(trim(j.manufacturer)) = m.m")  # fmt: skip
def b16(spark: SparkSession, d: str) -> DataFrame:
    j = jobs(spark, d).withColumn("m", F.lower(F.trim("manufacturer")))
    known = j.filter("cik is not null")
    by = lambda k, n: known.filter(c(k).isNotNull()).groupBy(k).agg(F.count_distinct("cik").alias(f"n_{n}"), F.min("cik").alias(f"cik_{n}"))
    x = j.join(by("ticker", "t"), "ticker", "left").join(by("m", "m"), "m", "left")
    t, m = F.when(c("n_t") == 1, c("cik_t")), F.when(c("n_m") == 1, c("cik_m"))
    return x.select("id", F.coalesce("cik", t, m).alias("cik"), F.when(c("cik").isNotNull(), "stated").when(c("n_t") == 1, "ticker").when(c("n_m") == 1, "name").otherwise("unresolved").alias("basis"))


@query("q_c38_backfill", f"WITH {JOB} SELECT DISTINCT {_KEY} AS canonical FROM jobs WHERE product_id IS NULL AND NOT EXISTS (SELECT 1 FROM jobs k WHERE k.product_id IS NOT NULL AND lower(trim(regexp_replace(k.drug_name, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(jobs.drug_name, '\\s+', ' ', 'g'))))")
def c38(spark: SparkSession, d: str) -> DataFrame:
    j = jobs(spark, d).withColumn("canonical", analog_key(c("drug_name")))
    return j.filter("product_id is null").join(j.filter("product_id is not null").select("canonical").distinct(), "canonical", "left_anti").select("canonical").distinct()


@query("q_c39_record_decisions", f"WITH {JOB}, old AS (SELECT DISTINCT manufacturer, drug_name FROM jobs WHERE status = 'completed' AND manufacturer IS NOT NULL), new AS (SELECT DISTINCT manufacturer, drug_name FROM jobs WHERE status <> 'completed' AND manufacturer IS NOT NULL) SELECT manufacturer, drug_name, 'kept' AS outcome FROM old UNION ALL SELECT n.manufacturer, n.drug_name, 'inserted' FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.manufacturer = n.manufacturer AND o.drug_name = n.drug_name)")
def c39(spark: SparkSession, d: str) -> DataFrame:
    """Upsert of decisions: confirmed ones stay, unknown pairs are inserted."""
    j = jobs(spark, d).filter("manufacturer is not null")
    pair = ["manufacturer", "drug_name"]
    old, new = j.filter("status = 'completed'").select(*pair).distinct(), j.filter("status != 'completed'").select(*pair).distinct()
    return old.withColumn("outcome", F.lit("kept")).unionByName(new.join(old, pair, "left_anti").withColumn("outcome", F.lit("inserted")))


@query("q_c37_profile_judgment", f"WITH {_EAV}, j AS (SELECT id, field, value, id LIKE '%a%' AS contradicted, CASE WHEN id LIKE '%b%' THEN value ELSE value || ' revised' END AS cv, CASE WHEN id LIKE '%c%' THEN 0.4 ELSE 0.8 END AS conf FROM eav) SELECT id, field, CASE WHEN NOT contradicted THEN 'search_inconclusive' WHEN conf < 0.6 THEN 'correction_low_confidence' ELSE 'search_corroborated' END AS flag FROM j")
def c37(spark: SparkSession, d: str) -> DataFrame:
    """A correction counts only if contradicted, cited, confident and truly different; a value inside its correction is not different."""
    from seriesloom.functions.text import conflicting

    e = profile_fields(spark, d).withColumn("cv", F.when(c("id").contains("b"), c("value")).otherwise(F.concat("value", F.lit(" revised")))).withColumn("conf", F.when(c("id").contains("c"), 0.4).otherwise(0.8))
    flag = F.when(~c("id").contains("a"), "search_inconclusive").when(is_missing(c("cv")), "contradicted_without_replacement").when(c("conf") < 0.6, "correction_low_confidence").when(~conflicting(c("value"), c("cv")), "search_corroborated").otherwise("corrected_by_search")
    return e.select("id", "field", flag.alias("flag"))


# --- dashboard ---------------------------------------------------------------------------------

_DASH = (
    f"{CELLS}, {LAUNCHES}, dsh AS (SELECT product, any_value(issuer) AS company, count(DISTINCT series) AS series, count(DISTINCT q) AS quarters, min(q) AS fq, max(q) AS lq, max(usd) AS top, count(*) AS figures FROM cells GROUP BY 1), "
    "dd AS (SELECT dsh.*, launch_date, CASE WHEN top < 500 THEN '<500' WHEN top <= 1000 THEN '500-1000' WHEN top IS NOT NULL THEN '>1000' END AS bucket FROM dsh LEFT JOIN launches USING (product))"
)


def dashboard(spark: SparkSession, d: str) -> DataFrame:
    """One row per product for the overview; every child is aggregated before it is joined."""
    from seriesloom.functions.numeric import peak_bucket

    g = cells(spark, d).groupBy("product").agg(F.min("issuer").alias("company"), F.count_distinct("series").alias("series"), F.count_distinct("q").alias("quarters"), F.min("q").alias("fq"), F.max("q").alias("lq"), F.max("usd").alias("top"), F.count("*").alias("figures"))
    return g.join(launches(spark, d).select("product", "launch_date"), "product", "left").withColumn("bucket", peak_bucket(c("top")))


@query("q_c26_dashboard_preview", f"WITH {_DASH} SELECT product, company, series, quarters, fq, lq, figures, launch_date, bucket FROM dd")
def c26(spark: SparkSession, d: str) -> DataFrame:
    return dashboard(spark, d).drop("top")


QUERIES["q_j04_dashboard_assembly"], ORACLES["q_j04_dashboard_assembly"] = c26, ORACLES["q_c26_dashboard_preview"]


@query("q_g11_kpis", f"WITH {_DASH} SELECT count(*) AS products, count(DISTINCT company) AS companies, CAST(sum(CAST(top AS DECIMAL(24,6))) AS DOUBLE) AS peak_total, sum(figures)::BIGINT AS figures, count(launch_date) AS with_launch FROM dd")
def g11(spark: SparkSession, d: str) -> DataFrame:
    return kpis(dashboard(spark, d))


def kpis(rows: DataFrame) -> DataFrame:
    """Headline numbers; an empty sum is null, not zero."""
    return rows.agg(F.count("*").alias("products"), F.count_distinct("company").alias("companies"), money_sum("top").alias("peak_total"), F.sum("figures").alias("figures"), F.count("launch_date").alias("with_launch"))


@query("q_c46_filtered_kpis", f"WITH {_DASH} SELECT count(*) AS products, count(DISTINCT company) AS companies, CAST(sum(CAST(top AS DECIMAL(24,6))) AS DOUBLE) AS peak_total, sum(figures)::BIGINT AS figures, count(launch_date) AS with_launch FROM dd WHERE bucket = '500-1000'")
def c46(spark: SparkSession, d: str) -> DataFrame:
    return kpis(dashboard(spark, d).filter("bucket = '500-1000'"))


@query("q_g12_filter_options", f"WITH {_DASH} SELECT 'company' AS field, min(company) AS option FROM dd GROUP BY lower(company) UNION ALL SELECT 'bucket', min(bucket) FROM dd WHERE bucket IS NOT NULL GROUP BY lower(bucket)")
def g12(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.array(F.struct(F.lit("company").alias("field"), c("company").alias("option")), F.struct(F.lit("bucket").alias("field"), c("bucket").alias("option")))
    e = dashboard(spark, d).select(F.explode(pairs).alias("p")).select("p.*").filter("option is not null")
    return e.groupBy("field", F.lower("option").alias("k")).agg(F.min("option").alias("option")).drop("k")


@query("q_c47_cascading_options", f"WITH {_DASH} SELECT 'company' AS field, company AS option FROM dd WHERE bucket = '>1000' GROUP BY company UNION ALL SELECT 'bucket', bucket FROM dd WHERE company LIKE 'F%' AND bucket IS NOT NULL GROUP BY bucket")
def c47(spark: SparkSession, d: str) -> DataFrame:
    """Options under the choice bucket >1000 and companies with F: each field ignores its own choice."""
    rows = dashboard(spark, d)
    one = rows.filter("bucket = '>1000'").select(F.lit("company").alias("field"), c("company").alias("option"))
    return one.unionByName(rows.filter("company like 'F%' and bucket is not null").select(F.lit("bucket").alias("field"), c("bucket").alias("option"))).distinct()


@query("q_w16_series_end_reason", f"WITH lb AS (SELECT *, {label('period')} AS k FROM quarterly_revenue), q AS (SELECT *, {qidx('k')} AS q FROM lb WHERE k LIKE '____Q_'), l AS (SELECT series_identity, max(q) AS lq FROM q WHERE value_reported IS NOT NULL GROUP BY 1), "
       "a AS (SELECT series_identity, CASE WHEN contains(source_quote, 'not separately disclosed') THEN 'not_disclosed' END AS reason FROM q JOIN l USING (series_identity) WHERE q > lq) SELECT series_identity, CASE WHEN count(DISTINCT reason) = 1 THEN min(reason) END AS reason FROM a GROUP BY 1")  # fmt: skip
def w16(spark: SparkSession, d: str) -> DataFrame:
    """The one reason recorded for the quarters after a series' last figure, if there is exactly one."""
    from seriesloom.operators.latest import quarter_rows

    q = quarter_rows(table(spark, d, "quarterly_revenue"), "series_identity", "value_reported", "source_quote")
    last = q.filter("value_reported is not null").groupBy("series_identity").agg(F.max("q").alias("lq"))
    after = q.join(last, "series_identity").filter("q > lq")
    reason = F.when(c("source_quote").contains("not separately disclosed"), "not_disclosed")
    return after.groupBy("series_identity").agg(F.count_distinct(reason).alias("n"), F.min(reason).alias("reason")).select("series_identity", F.when(c("n") == 1, c("reason")).alias("reason"))


@query("q_w19_newest_peak", f"WITH {OBS} SELECT product, arg_max(value, (reported_at, id)) AS peak FROM obs WHERE period_type = 'annual' GROUP BY 1")
def w19(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).filter("period_type = 'annual'").groupBy("product").agg(F.max(F.struct("reported_at", "id", "value")).alias("b")).select("product", c("b.value").alias("peak"))


@query("q_g16_best_per_period", f"WITH {OBS} SELECT product, period, id FROM (SELECT *, row_number() OVER (PARTITION BY product, period ORDER BY list_position(['sec_filing', 'annual_report', 'quarterly_report', 'earnings_release', 'company_ir', 'investor_presentation', 'transcript'], source_type), id) AS rn FROM obs) WHERE rn = 1")
def g16(spark: SparkSession, d: str) -> DataFrame:
    from seriesloom.plans.readings import source_rank

    o = observations(spark, d).groupBy("product", "period").agg(F.min(F.struct(source_rank(c("source_type")).alias("r"), "id")).alias("m"))
    return o.select("product", "period", c("m.id").alias("id"))


_SHARE = f"{CELLS}, n AS (SELECT issuer, count(DISTINCT series) AS n FROM cells GROUP BY 1)"


@query("q_g18_concentration", f"WITH {_SHARE} SELECT arg_max(issuer, (n, issuer)) AS largest, round(100.0 * max(n) / sum(n), 1) AS share_pct, count(*) AS issuers, 100.0 * max(n) / sum(n) <= 40 AS balanced FROM n")
def g18(spark: SparkSession, d: str) -> DataFrame:
    n = cells(spark, d).groupBy("issuer").agg(F.count_distinct("series").alias("n"))
    share = F.lit(100.0) * F.max("n") / F.sum("n")
    return n.agg(F.max_by("issuer", F.struct("n", "issuer")).alias("largest"), F.round(share, 1).alias("share_pct"), F.count("*").alias("issuers"), (share <= 40).alias("balanced"))


_CAT = f"{OBS}, qs AS (SELECT DISTINCT product FROM obs WHERE period_type = 'quarterly'), an AS (SELECT DISTINCT product FROM obs WHERE period_type = 'annual'), jb AS (SELECT DISTINCT {_KEY} AS product FROM drug_jobs)"


@query("q_g19_catalog_coverage", f"WITH {_CAT}, a AS (SELECT lower(product) AS product, 'quarterly' AS part FROM qs UNION SELECT lower(product), 'annual_only' FROM an WHERE product NOT IN (SELECT product FROM qs) UNION SELECT product, 'excluded' FROM jb WHERE product NOT IN (SELECT lower(product) FROM obs)) SELECT part, count(*) AS n FROM a GROUP BY 1")
def g19(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).groupBy("part").agg(F.count("*").alias("n"))


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """Every requested or reported product with the part of the catalog it belongs to."""
    o = observations(spark, d).groupBy(F.lower("product").alias("product")).agg(F.bool_or(c("period_type") == "quarterly").alias("qs"), F.bool_or(c("period_type") == "annual").alias("an"))
    j = table(spark, d, "drug_jobs").select(analog_key(c("drug_name")).alias("product")).distinct().withColumn("job", F.lit(True))
    x = o.join(j, "product", "full_outer")
    part = F.when(c("qs"), "quarterly").when(c("an"), "annual_only").when(c("qs").isNull(), "excluded")
    return x.select("product", part.alias("part"), F.coalesce("job", F.lit(False)).alias("requested")).filter("part is not null")


@query("q_g20_unaccounted", f"WITH {_CAT} SELECT lower(product) AS product FROM (SELECT DISTINCT product FROM obs) WHERE lower(product) NOT IN (SELECT product FROM jb) GROUP BY 1")
def g20(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).filter("part != 'excluded' and not requested").select("product").unionByName(
        observations(spark, d).groupBy(F.lower("product").alias("product")).agg(F.bool_or(c("period_type").isin("quarterly", "annual")).alias("k")).filter("not k").select("product")
    )


@query("q_u05_catalog_sets", f"WITH {_CAT} SELECT product, 'both' AS side FROM (SELECT product FROM jb INTERSECT SELECT lower(product) FROM qs) UNION ALL SELECT product, 'only_requested' FROM (SELECT product FROM jb EXCEPT SELECT lower(product) FROM obs)")
def u05(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    j = table(spark, d, "drug_jobs").select(analog_key(c("drug_name")).alias("product"))
    both = j.intersect(o.filter("period_type = 'quarterly'").select(F.lower("product").alias("product")))
    return both.withColumn("side", F.lit("both")).unionByName(j.subtract(o.select(F.lower("product").alias("product"))).withColumn("side", F.lit("only_requested")))


QUERIES["q_b13_product_role"] = lambda spark, d: catalog(spark, d).select("product", "part")
ORACLES["q_b13_product_role"] = f"WITH {_CAT} SELECT lower(product) AS product, 'quarterly' AS part FROM qs GROUP BY 1 UNION ALL SELECT lower(product), 'annual_only' FROM an WHERE product NOT IN (SELECT product FROM qs) GROUP BY 1 UNION ALL SELECT product, 'excluded' FROM jb WHERE product NOT IN (SELECT lower(product) FROM obs)"

# --- quality and validation --------------------------------------------------------------------

_ISS = (
    f"{OBS}, sp AS (SELECT *, regexp_replace(regexp_replace(printf('%.10f', value), '0+$', ''), '\\.$', '') AS f10, replace(coalesce(source_quote, ''), ',', '') AS qt FROM obs), "
    "iss AS (SELECT id, 'missing_source_quote' AS issue, 'high' AS severity FROM sp WHERE coalesce(trim(source_quote), '') = '' UNION ALL SELECT id, 'source_evidence_missing_value', 'high' FROM sp WHERE coalesce(trim(source_quote), '') <> '' AND NOT (contains(qt, f10) OR contains(qt, printf('%.1f', value)) OR contains(qt, printf('%.0f', value))) "
    "UNION ALL SELECT id, 'negative_revenue', 'medium' FROM sp WHERE value < 0 UNION ALL SELECT id, 'missing_formulation', 'medium' FROM sp WHERE revenue_scope IN ('Product family', 'Formulation-specific', 'Franchise') AND formulation_scope IS NULL "
    "UNION ALL SELECT id, 'duplicate_period_scope_formulation', 'medium' FROM (SELECT id, row_number() OVER (PARTITION BY series, period ORDER BY reported_at, id) AS rn FROM sp) WHERE rn > 1)"
)


@query("q_c18_quality_checks", f"WITH {_ISS} SELECT * FROM iss")
def c18(spark: SparkSession, d: str) -> DataFrame:
    return quality_issues(observations(spark, d))


@query(
    "q_c19_auto_pass_gate",
    f"WITH {_ISS}, hi AS (SELECT DISTINCT id FROM iss WHERE severity = 'high') SELECT sp.id, CASE WHEN hi.id IS NOT NULL OR coalesce(trim(source_quote), '') = '' OR period_type IN ('six_month', 'nine_month') OR coalesce(confidence, 0) < 0.7 THEN 'needs_review' ELSE 'auto_pass' END AS gate FROM sp LEFT JOIN hi ON sp.id = hi.id",
)
def c19(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    return auto_pass_gate(o, quality_issues(o))


_TASKS = (
    f"{OBS}, o AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY period, id) AS a, row_number() OVER (PARTITION BY series ORDER BY period DESC, id DESC) AS b FROM obs WHERE q IS NOT NULL) "
    "SELECT id, CASE WHEN coalesce(confidence, 0) < 0.7 THEN 'low_confidence' WHEN a <= 2 THEN 'early_launch' WHEN b <= 2 THEN 'recent_period' WHEN status = 'needs_review' THEN 'needs_review' END AS reason FROM o WHERE coalesce(confidence, 0) < 0.7 OR a <= 2 OR b <= 2 OR status = 'needs_review'"
)


@query("q_w12_validation_tasks", f"WITH {_TASKS}")
def w12(spark: SparkSession, d: str) -> DataFrame:
    return review_tasks(observations(spark, d).filter("q is not null"), sample=False)


def w12_sampled(spark: SparkSession, d: str) -> DataFrame:
    return review_tasks(observations(spark, d).filter("q is not null"), sample=True)


QUERIES["q_w12_validation_sample"] = w12_sampled


_NEARLY = "abs({0} - expected) <= greatest(abs(expected) * 0.005::DOUBLE, 0.05::DOUBLE)"


@query("q_g24_eval_score", f"WITH {CELLS}, {DP}, want AS (SELECT lower(product) AS key, {LABEL_OF.format('q')} AS period, usd AS expected FROM cells WHERE revenue_scope = 'Worldwide'), got AS (SELECT lower(product) AS key, period, min(value) AS lo, max(value) AS hi FROM dp WHERE scope = 'Worldwide' AND value IS NOT NULL GROUP BY 1, 2) "
       f"SELECT CASE WHEN lo IS NULL THEN 'no_answer' WHEN {_NEARLY.format('lo')} AND {_NEARLY.format('hi')} THEN 'correct' WHEN {_NEARLY.format('lo')} OR {_NEARLY.format('hi')} THEN 'conflicting' ELSE 'wrong' END AS verdict, count(*) AS n FROM want LEFT JOIN got USING (key, period) GROUP BY 1")  # fmt: skip
def g24(spark: SparkSession, d: str) -> DataFrame:
    """Each expected figure (the latest of a worldwide series) against the readings: correct, wrong, conflicting or no answer."""
    want = cells(spark, d).filter("revenue_scope = 'Worldwide'").select(F.lower("product").alias("key"), quarter_label(c("q")).alias("period"), c("usd").alias("expected"))
    got = readings(spark, d).filter("scope = 'Worldwide' and value is not null").select(F.lower("product").alias("key"), "period", "value")
    g = got.groupBy("key", "period").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    j = want.join(g, ["key", "period"], "left")
    near = lambda x: F.abs(c(x) - c("expected")) <= F.greatest(F.abs("expected") * 0.005, F.lit(0.05))
    verdict = F.when(c("lo").isNull(), "no_answer").when(near("lo") & near("hi"), "correct").when(near("lo") | near("hi"), "conflicting").otherwise("wrong")
    return j.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("q_p06_published_quarter", f"WITH {OBS} SELECT id FROM obs WHERE period_type = 'quarterly' AND status IN ('auto_pass', 'confirmed')")
def p06(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).filter("period_type = 'quarterly' and status in ('auto_pass', 'confirmed')").select("id")


@query("q_p31_withheld", f"WITH {DP}, {SRC} SELECT dp.id FROM dp JOIN src ON dp.source_id = src.id WHERE regexp_replace(lower(trim(source_type)), '[\\s_-]+', '_', 'g') IN ('investor_presentation', 'transcript') AND status <> 'ok'")
def p31(spark: SparkSession, d: str) -> DataFrame:
    """Readings of presentations and transcripts that are not settled."""
    kind = F.regexp_replace(F.lower(F.trim("source_type")), r"[\s_-]+", "_")
    s = sources(spark, d).select(c("id").alias("source_id"), kind.alias("kind")).filter(c("kind").isin("investor_presentation", "transcript"))
    return readings(spark, d).filter("status != 'ok'").join(s, "source_id", "left_semi").select("id")


# --- sources and top-k -------------------------------------------------------------------------

_FITS = f"({SOURCE_ORDER})"


@query("q_t03_prioritized_sources", f"WITH {SRC}, r AS (SELECT *, coalesce(nullif(list_position({_FITS}, regexp_replace(lower(trim(source_type)), '[\\s_-]+', '_', 'g')), 0), 8) AS fit FROM src) SELECT job_id, id, row_number() OVER (PARTITION BY job_id ORDER BY fit, relevant DESC, id) AS place FROM r")
def t03(spark: SparkSession, d: str) -> DataFrame:
    from seriesloom.plans.readings import source_rank

    s = sources(spark, d).withColumn("fit", source_rank(c("source_type")))
    return s.select("job_id", "id", F.row_number().over(Window.partitionBy("job_id").orderBy("fit", F.desc("relevant_datapoints_found"), "id")).alias("place"))


@query("q_t04_model_budget", f"WITH {SRC}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY relevant DESC, filed DESC NULLS LAST, id) AS rn FROM src WHERE retrieval_status = 'success') SELECT job_id, id FROM r WHERE rn <= 3")
def t04(spark: SparkSession, d: str) -> DataFrame:
    """The three sources of each job a model may read; the budget is the feature."""
    from seriesloom.functions.periods import loose_date

    s = sources(spark, d).filter("retrieval_status = 'success'").withColumn("filed", loose_date(c("source_date")))
    w = Window.partitionBy("job_id").orderBy(F.desc("relevant_datapoints_found"), F.desc_nulls_last("filed"), "id")
    return s.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("job_id", "id")


@query("q_t07_authority_order", f"WITH {SRC} SELECT source_type, count(*) AS n FROM src GROUP BY 1")
def t07(spark: SparkSession, d: str) -> DataFrame:
    return sources(spark, d).groupBy("source_type").agg(F.count("*").alias("n"))


@query("q_t12_recent_logs", "SELECT event_id, event_type, value FROM events WHERE event_type <> 'view' AND contains(props, '1') ORDER BY ts DESC, event_id DESC LIMIT 200")
def t12(spark: SparkSession, d: str) -> DataFrame:
    """The 200 newest events of a level that hold a substring; a top-k report."""
    e = table(spark, d, "events").filter((c("event_type") != "view") & c("props").contains("1"))
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "event_type", "value")


@query("q_t14_series_without_peak", f"WITH {CELLS}, x AS (SELECT series, max(usd) AS top, max(q) AS lq FROM cells GROUP BY 1) SELECT series, top, row_number() OVER (ORDER BY -coalesce(top, 0), series) AS place FROM x WHERE lq < 8099")
def t14(spark: SparkSession, d: str) -> DataFrame:
    x = cells(spark, d).groupBy("series").agg(F.max("usd").alias("top"), F.max("q").alias("lq")).filter("lq < 8099")
    return global_rank(x.select("series", "top"), [-F.coalesce("top", F.lit(0.0)), c("series")], "place")


@query("q_s33_table_browser", f"WITH {JOB} SELECT id, drug_name, status FROM jobs WHERE drug_name ILIKE '%vo%' OR manufacturer ILIKE '%vo%' OR generic_name ILIKE '%vo%' ORDER BY created_at DESC, id LIMIT 100")
def s33(spark: SparkSession, d: str) -> DataFrame:
    return browse(jobs(spark, d), "vo", ["drug_name", "manufacturer", "generic_name"]).select("id", "drug_name", "status")


def browse(df: DataFrame, needle: str, columns: list[str], limit: int = 100, offset: int = 0) -> DataFrame:
    """Rows whose text columns hold the needle, newest first, one page."""
    hit = F.lit(False)
    for x in columns:
        hit = hit | F.coalesce(c(x).ilike(f"%{needle}%"), F.lit(False))
    return df.filter(hit).orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


@query("q_s28_powerbi_quarters", f"WITH {OBS} SELECT product, issuer, geography, period, value, currency FROM obs WHERE period_type = 'quarterly' AND status IN ('auto_pass', 'confirmed')")
def s28(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).filter("period_type = 'quarterly' and status in ('auto_pass', 'confirmed')").select("product", "issuer", "geography", "period", "value", "currency")


@query("q_j11_filing_window", f"WITH {SRC}, w AS (SELECT DISTINCT id AS job_id, CAST(created_at AS DATE) - 730 AS since, CAST(created_at AS DATE) AS until FROM drug_jobs) SELECT src.id FROM src JOIN w ON src.job_id = w.job_id AND filed BETWEEN since AND until")
def j11(spark: SparkSession, d: str) -> DataFrame:
    from seriesloom.functions.periods import loose_date

    w = jobs(spark, d).select(c("id").alias("job_id"), F.date_sub(F.to_date("created_at"), 730).alias("since"), F.to_date("created_at").alias("until"))
    s = sources(spark, d).withColumn("filed", loose_date(c("source_date")))
    return s.join(w, "job_id").filter("filed between since and until").select("id")


@query("q_j14_attach_attributes", f"WITH {CELLS}, a AS (SELECT {_KEY} AS key, min(indication) AS indication FROM drug_jobs GROUP BY 1) SELECT series, q, indication FROM cells JOIN a ON lower(product) = key")
def j14(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "drug_jobs").groupBy(analog_key(c("drug_name")).alias("key")).agg(F.min("indication").alias("indication"))
    return cells(spark, d).withColumn("key", F.lower("product")).join(a, "key").select("series", "q", "indication")


@query("q_j15_target_pairs", f"WITH {JOB}, p AS (SELECT id, {_KEY} AS key, indication FROM jobs WHERE indication IS NOT NULL), t AS (SELECT * FROM p) SELECT t.id AS target, count(*) AS candidates FROM t JOIN p USING (indication) WHERE t.key <> p.key GROUP BY 1")
def j15(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of every job with an indication: the indication's jobs less those of its own key, so no pairs are formed."""
    p = jobs(spark, d).select("id", analog_key(c("drug_name")).alias("key"), "indication").filter("indication is not null and key is not null")
    n = p.groupBy("indication", "key").agg(F.count("*").alias("own"))
    of = n.groupBy("indication").agg(F.sum("own").alias("all"))
    t = p.join(n, ["indication", "key"]).join(of, "indication").filter("all > own")
    return t.select(c("id").alias("target"), (F.col("all") - F.col("own")).alias("candidates"))


@query("q_x09_formulations", f"WITH {JOB} SELECT id, list_sort(list_distinct(list_filter(list_transform(string_split('Nasal;nasal; XR ;' || coalesce(generic_name, ''), ';'), lambda x: trim(lower(x))), lambda x: x <> ''))) AS forms FROM jobs")
def x09(spark: SparkSession, d: str) -> DataFrame:
    raw = F.split(F.concat(F.lit("Nasal;nasal; XR ;"), F.coalesce("generic_name", F.lit(""))), ";")
    return jobs(spark, d).select("id", F.array_sort(F.array_distinct(F.filter(F.transform(raw, lambda x: F.trim(F.lower(x))), lambda x: x != ""))).alias("forms"))


@query("q_x41_merge_aliases", f"WITH {JOB} SELECT id, len(list_distinct(list_filter([lower(trim(drug_name)), lower(trim(generic_name)), lower(trim(ticker))], lambda x: x IS NOT NULL))) AS n FROM jobs")
def x41(spark: SparkSession, d: str) -> DataFrame:
    each = F.array(*[F.lower(F.trim(x)) for x in ("drug_name", "generic_name", "ticker")])
    return jobs(spark, d).select("id", F.size(F.array_distinct(F.array_compact(each))).cast("long").alias("n"))


ORACLES["q_x28b_profile_spellings"] = f"WITH {_EAV} SELECT field, count(DISTINCT lower(trim(regexp_replace(regexp_replace(coalesce(value, ''), '\\s+', ' ', 'g'), '[\\s.]+$', '')))) AS n FROM eav GROUP BY 1"
QUERIES["q_x28b_profile_spellings"] = lambda spark, d: profile_fields(spark, d).groupBy("field").agg(F.count_distinct(normalize_value(c("value"))).alias("n"))
