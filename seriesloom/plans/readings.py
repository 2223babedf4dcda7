"""Queries over competing readings: joins, checks, adjudication, selection, derivation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.geo import normalize_geography, slug
from seriesloom.functions.periods import let, loose_date, period_end, period_label
from seriesloom.operators import readings as R
from seriesloom.plans.base import _END, CELLS, cells, observations
from seriesloom.plans.problem_sql import LABEL_OF, label
from seriesloom.session import table
from seriesloom.vocab import SOURCE_ORDER

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def readings(spark: SparkSession, d: str) -> DataFrame:
    """datapoints' records as readings, with what their source adds."""
    cols = ["job_id", "source_id", "product_label", "period", "period_type", "geography", "scope", "value_as_reported", "value_normalized_usd_millions", "rounding_uncertainty_usd_millions", "source_quote", "normalization_status", "flags", "combined_with", "extracted_at", "source_unit", "source_currency", "fingerprint_signature"]
    r = table(spark, d, "datapoints").groupBy("id").agg(F.max(F.struct(*cols)).alias("r")).select("id", "r.*")
    v = lambda c: F.when(~F.isnan(c), F.col(c))
    return r.select(
        "id", "job_id", "source_id", F.col("product_label").alias("product"), period_label(F.col("period")).alias("period"), "period_type", "geography", F.coalesce("scope", F.lit("")).alias("scope"),
        v("value_as_reported").alias("reported"), v("value_normalized_usd_millions").alias("value"), v("rounding_uncertainty_usd_millions").alias("bound"), F.col("source_quote").alias("quote"),
        F.col("normalization_status").alias("status"), "flags", F.col("combined_with").alias("combined"), F.struct("extracted_at", "id").alias("ordinal"), "extracted_at", "source_unit", "source_currency", F.col("fingerprint_signature").alias("signature"),
    )


DP = (
    f"dlab AS (SELECT *, {label('period')} AS k FROM datapoints), dp AS (SELECT id, any_value(job_id) AS job_id, any_value(source_id) AS source_id, any_value(product_label) AS product, any_value(k) AS period, any_value(period_type) AS period_type, any_value(geography) AS geography, "
    "coalesce(any_value(scope), '') AS scope, any_value(value_as_reported) AS reported, any_value(value_normalized_usd_millions) AS value, any_value(rounding_uncertainty_usd_millions) AS bound, any_value(source_quote) AS quote, any_value(normalization_status) AS status, "
    "any_value(flags) AS flags, any_value(combined_with) AS combined, max(extracted_at) AS extracted_at, any_value(source_unit) AS source_unit, any_value(source_currency) AS source_currency, any_value(fingerprint_signature) AS signature FROM dlab GROUP BY id), "
    "fig AS (SELECT * FROM dp WHERE NOT list_contains(flags, 'label_not_understood')), val AS (SELECT * FROM fig WHERE value IS NOT NULL)"
)


def sources(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_documents")
    return s.groupBy("id").agg(F.max(F.struct("job_id", "source_type", "source_title", "source_url", "source_date", "filing_type", "accession_number", "retrieval_status", "parsing_status", "relevant_datapoints_found")).alias("r")).select("id", "r.*")


_LOOSE = (
    "(CASE WHEN regexp_matches(source_date, '^\\d{4}-\\d{2}-\\d{2}') THEN TRY_CAST(substr(source_date, 1, 10) AS DATE) WHEN regexp_matches(source_date, '^\\d{8}$') THEN CAST(try_strptime(source_date, '%Y%m%d') AS DATE) "
    "WHEN regexp_matches(source_date, '^\\d{1,2} [A-Za-z]{3} \\d{4}$') THEN CAST(try_strptime(source_date, '%d %b %Y') AS DATE) WHEN regexp_matches(source_date, '^[A-Za-z]{4,9} \\d{1,2},? \\d{4}$') THEN CAST(try_strptime(replace(source_date, ',', ''), '%B %d %Y') AS DATE) "
    "WHEN regexp_matches(source_date, '^[A-Za-z]{3} \\d{1,2},? \\d{4}$') THEN CAST(try_strptime(replace(source_date, ',', ''), '%b %d %Y') AS DATE) END)"
)
SRC = f"src AS (SELECT id, max(job_id) AS job_id, any_value(source_type) AS source_type, any_value(source_title) AS source_title, any_value(source_url) AS source_url, any_value({_LOOSE}) AS filed, any_value(filing_type) AS filing_type, any_value(accession_number) AS accession_number, any_value(retrieval_status) AS retrieval_status, max(relevant_datapoints_found) AS relevant FROM source_documents GROUP BY id)"


@query("q_d16_filing_date", f"WITH {SRC} SELECT id, filed FROM src")
def d16(spark: SparkSession, d: str) -> DataFrame:
    return sources(spark, d).select("id", loose_date(F.col("source_date")).alias("filed"))


@query("q_j05_stored_document", f"WITH {DP}, {SRC}, fs AS (SELECT job_id, min(id) AS fallback FROM src GROUP BY 1) SELECT dp.id, coalesce(src.id, fallback) AS document_id, coalesce(src.source_url, f2.source_url) AS url FROM dp LEFT JOIN src ON dp.source_id = src.id LEFT JOIN fs ON dp.job_id = fs.job_id LEFT JOIN src f2 ON f2.id = fs.fallback")
def j05(spark: SparkSession, d: str) -> DataFrame:
    s = sources(spark, d).select("id", "job_id", "source_url")
    by_id = s.select(F.col("id").alias("source_id"), F.col("source_url").alias("url1"), F.col("id").alias("sid"))
    first = s.groupBy("job_id").agg(F.min(F.struct("id", "source_url")).alias("f"))
    r = readings(spark, d).select("id", "job_id", "source_id").join(by_id, "source_id", "left").join(first, "job_id", "left")
    return r.select("id", F.coalesce("sid", "f.id").alias("document_id"), F.coalesce("url1", "f.source_url").alias("url"))


_ORDER = SOURCE_ORDER
_KIND = "regexp_replace(lower(trim(source_type)), '[\\s_-]+', '_', 'g')"
_SRANK = f"(CASE WHEN source_type IS NULL THEN 10 ELSE coalesce(nullif(list_position([{', '.join(repr(x) for x in _ORDER)}], {_KIND}), 0), 8) END)"


def source_rank(kind):
    k = F.regexp_replace(F.lower(F.trim(kind)), r"[\s_-]+", "_")
    at = F.array_position(F.array(*[F.lit(x) for x in _ORDER]), k)
    return F.when(kind.isNull(), 10).otherwise(F.when(at == 0, 8).otherwise(at)).cast("int")


def ranked(spark: SparkSession, d: str) -> DataFrame:
    """Readings with their claim strength: own period, producer, source."""
    s = sources(spark, d).select(F.col("id").alias("source_id"), "source_type", loose_date(F.col("source_date")).alias("filed"), "accession_number")
    r = readings(spark, d).join(s, "source_id", "left")
    method = F.when(F.col("status").startswith("derived"), F.col("status")).when(F.col("source_type") == "llm_search", "llm").otherwise("table")
    return r.select(
        "*", R.own_period_rank(F.col("filed"), period_end(F.col("period"))).alias("own"), R.claim_rank(method).alias("claim"), source_rank(F.col("source_type")).alias("fit"),
        F.when(F.col("status") == "ok", 0.9).when(F.col("status").startswith("derived"), 0.7).alias("confidence"),
    )


RANKED = (
    f"{DP}, {SRC}, rk AS (SELECT dp.*, src.source_type, src.filed, src.accession_number, CASE WHEN filed IS NULL OR ({_END.replace('k ', 'dp.period ').replace('(k,', '(dp.period,').replace('(k)', '(dp.period)').replace('CAST(k ', 'CAST(dp.period ')}) IS NULL THEN 1 "
    f"WHEN filed <= ({_END.replace('k ', 'dp.period ').replace('(k,', '(dp.period,').replace('(k)', '(dp.period)').replace('CAST(k ', 'CAST(dp.period ')}) + 120 THEN 0 ELSE 2 END AS own, "
    f"CASE WHEN status LIKE 'derived%' THEN 2 WHEN source_type = 'llm_search' THEN 3 ELSE 1 END AS claim, {_SRANK} AS fit, CASE WHEN status = 'ok' THEN 0.9 WHEN status LIKE 'derived%' THEN 0.7 END AS confidence FROM dp LEFT JOIN src ON dp.source_id = src.id)"
)


@query("q_j12_claim_ranking", f"WITH {RANKED} SELECT id, own, claim, fit FROM rk")
def j12(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d).select("id", "own", "claim", "fit")


@query("q_t06_reading_rank", f"WITH {SRC} SELECT id, {_SRANK} AS rank FROM src")
def t06(spark: SparkSession, d: str) -> DataFrame:
    return sources(spark, d).select("id", source_rank(F.col("source_type")).alias("rank"))


_KEY = "job_id, product, period, scope"
_AGREE = "abs({a} - {b}) <= greatest(coalesce(CASE WHEN {x} IS NOT NULL OR {y} IS NOT NULL THEN 2 * greatest({x}, {y}) END, 0.005 * greatest(abs({a}), abs({b}))), 0.05)"
_WIN = "ROW_NUMBER() OVER (PARTITION BY job_id, product, period, scope ORDER BY own, claim, fit, -coalesce(confidence, 0.0), id)"


@query(
    "q_c15_reconcile",
    f"WITH {RANKED}, v AS (SELECT *, {_WIN} AS rn FROM rk WHERE value IS NOT NULL), w AS (SELECT {_KEY}, id AS winner, value AS wv, bound AS wb, own AS wo, claim AS wc, fit AS wf FROM v WHERE rn = 1), n AS (SELECT {_KEY}, count(*) AS n FROM v GROUP BY ALL) "
    f"SELECT v.job_id, v.product, v.period, v.scope, v.id, winner, n, CASE WHEN v.id = winner THEN 'winner' WHEN {_AGREE.format(a='v.value', b='wv', x='v.bound', y='wb')} THEN 'corroborates' WHEN own = wo AND claim = wc AND fit = wf THEN 'contests' ELSE 'superseded' END AS standing FROM v "
    "JOIN w ON v.job_id = w.job_id AND v.product = w.product AND v.period = w.period AND v.scope = w.scope JOIN n ON v.job_id = n.job_id AND v.product = n.product AND v.period = n.period AND v.scope = n.scope",
)
def c15(spark: SparkSession, d: str) -> DataFrame:
    r = ranked(spark, d).filter("value is not null").select("job_id", "product", "period", "scope", "id", "value", "bound", "confidence", "own", "claim", "fit")
    return R.reconcile(r, ["job_id", "product", "period", "scope"], ["own", "claim", "fit"])


@query(
    "q_j17_corroboration",
    f"WITH {RANKED}, v AS (SELECT *, {_WIN} AS rn FROM rk WHERE value IS NOT NULL), w AS (SELECT {_KEY}, id AS winner, value AS wv, bound AS wb FROM v WHERE rn = 1) SELECT winner, count(*) AS corroborations FROM v JOIN w USING ({_KEY}) WHERE v.id <> winner AND {_AGREE.format(a='v.value', b='wv', x='v.bound', y='wb')} GROUP BY 1",
)
def j17(spark: SparkSession, d: str) -> DataFrame:
    return c15(spark, d).filter("standing = 'corroborates'").groupBy("winner").agg(F.count("*").alias("corroborations"))


@query("q_j18_self_contradiction", f"WITH {RANKED} SELECT job_id, product, period, scope, accession_number, max(value) - min(value) AS spread FROM rk WHERE value IS NOT NULL AND accession_number IS NOT NULL GROUP BY ALL HAVING max(value) - min(value) > greatest(0.005 * max(abs(value)), 0.05)")
def j18(spark: SparkSession, d: str) -> DataFrame:
    r = ranked(spark, d).filter("value is not null and accession_number is not null")
    g = r.groupBy("job_id", "product", "period", "scope", "accession_number").agg((F.max("value") - F.min("value")).alias("spread"), F.max(F.abs("value")).alias("top"))
    return g.filter("spread > greatest(0.005d * top, 0.05d)").drop("top")


_SQUASH = "trim(regexp_replace(replace(lower({c}), '.', ''), '[^a-z0-9]+', ' ', 'g'))"
_SLUG = "regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_PLACE = (
    "(CASE WHEN {c} IS NULL OR " + _SQUASH + " = '' THEN 'unspecified' WHEN " + _SQUASH + " IN ('worldwide', 'global') THEN 'worldwide' WHEN " + _SQUASH + " IN ('us', 'usa', 'united states') THEN 'united-states' WHEN " + _SQUASH
    + " IN ('ex us', 'outside of us', 'outside the us', 'rest of world') THEN 'ex-united-states' WHEN " + _SQUASH + " IN ('north america', 'americas') THEN 'north-america' WHEN " + _SQUASH + " IN ('europe', 'japan') THEN " + _SQUASH + " ELSE 'unrecognised-' || " + _SLUG + " END)"
)


def place_sql(c: str) -> str:
    return _PLACE.replace("{c}", c)


def slug_sql(c: str) -> str:
    return _SLUG.replace("{c}", c)


def identity(issuer, product, scope, geography, formulation, reported_as, currency, kind, combined):
    """Eight slugs that say which series a reading belongs to."""
    stated = lambda s, other: let(s, lambda x: F.when(x != "", x).otherwise(other))
    token = F.when(scope == "Worldwide", "product-family").otherwise(slug(scope))
    line = stated(slug(reported_as), F.when(combined, "combined-unnamed").otherwise("own"))
    ends = [stated(slug(x), F.lit("unstated")) for x in (issuer, product)], [stated(slug(x), F.lit("unstated")) for x in (currency, kind)]
    return F.concat_ws("_", *ends[0], stated(token, F.lit("unstated")), let(geography, lambda g: slug(normalize_geography(g))), stated(slug(formulation), F.lit("unstated")), line, *ends[1])


_ID = (
    f"coalesce(nullif({slug_sql('product')}, ''), 'unstated') || '_' || coalesce(nullif(CASE WHEN scope = 'Worldwide' THEN 'product-family' ELSE {slug_sql('scope')} END, ''), 'unstated') || '_' || {place_sql('geography')} || '_unstated_' || "
    f"CASE WHEN len(combined) > 0 THEN {slug_sql('combined[1]')} ELSE 'own' END || '_' || coalesce(nullif({slug_sql('source_currency')}, ''), 'unstated') || '_' || {slug_sql('period_type')}"
)


def identified(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    named = F.try_element_at("combined", F.lit(1))
    full = identity(none, F.col("product"), F.col("scope"), F.col("geography"), none, named, F.col("source_currency"), F.col("period_type"), F.coalesce(F.size("combined"), F.lit(0)) > 0)
    return ranked(spark, d).withColumn("identity", F.regexp_replace(full, "^unstated_", "")).withColumn("publishes", R.understood(F.col("flags")))


@query("q_x04_series_identity", f"WITH {DP} SELECT id, {_ID} AS identity FROM dp")
def x04(spark: SparkSession, d: str) -> DataFrame:
    return identified(spark, d).select("id", "identity")


_SELECT = (
    f"{RANKED}, ident AS (SELECT *, {_ID} AS identity, NOT list_contains(flags, 'label_not_understood') AS publishes FROM rk), "
    "win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, period, period_type, identity ORDER BY own, claim, fit, id) AS rn FROM ident WHERE publishes AND value IS NOT NULL) WHERE rn = 1), "
    f"jj AS (SELECT i.id, w.id AS wid, w.own AS wo, w.claim AS wc, w.fit AS wf, coalesce({_AGREE.format(a='i.value', b='w.value', x='i.bound', y='w.bound')}, false) AS same, i.identity = w.identity AS mine "
    "FROM ident i LEFT JOIN win w ON i.job_id = w.job_id AND i.period = w.period AND i.period_type = w.period_type), "
    "sel AS (SELECT id, bool_or(coalesce(wid = id, false)) AS won, arg_min(wid, (wo, wc, wf, wid)) FILTER (same) AS sid, arg_min(wid, (wo, wc, wf, wid)) FILTER (mine) AS oid FROM jj GROUP BY id)"
)


@query("q_c16_select_series", f"WITH {_SELECT} SELECT id, CASE WHEN won THEN 'selected' WHEN sid IS NOT NULL THEN 'duplicate' WHEN oid IS NOT NULL THEN 'superseded' END AS selection, CASE WHEN won THEN id ELSE coalesce(sid, oid) END AS held_by FROM sel")
def c16(spark: SparkSession, d: str) -> DataFrame:
    r = identified(spark, d).select("id", "job_id", "period", "period_type", "identity", "value", "bound", "publishes", "own", "claim", "fit")
    return R.select_series(r, ["job_id", "period", "period_type"], "identity", ["own", "claim", "fit"])


@query("q_w11_series_standing", f"WITH {_SELECT} SELECT job_id, count(*) FILTER (won) AS selected, count(*) FILTER (NOT won AND sid IS NOT NULL) AS duplicate, count(*) FILTER (NOT won AND sid IS NULL AND oid IS NOT NULL) AS superseded, count(*) FILTER (NOT won AND sid IS NULL AND oid IS NULL) AS undecided FROM sel JOIN dp USING (id) GROUP BY 1")
def w11(spark: SparkSession, d: str) -> DataFrame:
    s = c16(spark, d).join(readings(spark, d).select("id", "job_id"), "id")
    n = lambda x: F.count_if(F.col("selection") == x if x else F.col("selection").isNull())
    return s.groupBy("job_id").agg(n("selected").alias("selected"), n("duplicate").alias("duplicate"), n("superseded").alias("superseded"), n(None).alias("undecided"))


@query("q_c17_settled_duplicates", f"WITH {_SELECT} SELECT id, sid AS held_by, 'Same figure as ' || sid AS explanation FROM sel WHERE NOT won AND sid IS NOT NULL")
def c17(spark: SparkSession, d: str) -> DataFrame:
    return c16(spark, d).filter("selection = 'duplicate'").select("id", "held_by", F.concat(F.lit("Same figure as "), "held_by").alias("explanation"))


# --- checks ------------------------------------------------------------------------------------

_LAST = "(SELECT *, row_number() OVER (PARTITION BY job_id, product, scope, period, period_type ORDER BY extracted_at DESC, id DESC) AS rn FROM val)"
_SUMS = (
    f"lastv AS (SELECT *, CAST(substr(period, 1, 4) AS INT) AS year FROM {_LAST} WHERE rn = 1), "
    "qs AS (SELECT job_id, product, scope, year, count(*) AS c4, CAST(sum(CAST(value AS DECIMAL(24,6))) AS DOUBLE) AS s4, CASE WHEN count(bound) = 4 THEN sum(bound) END AS u4 FROM lastv WHERE period_type = 'quarterly' GROUP BY ALL), "
    "chk AS (SELECT t.job_id, t.product, t.scope, t.year, t.period_type, t.value AS total, s4 AS summed, CASE WHEN u4 + t.bound IS NOT NULL THEN greatest(u4 + t.bound, 0.05) ELSE abs(t.value) * 0.02 END AS allowed "
    "FROM lastv t JOIN qs USING (job_id, product, scope, year) WHERE t.period_type = 'annual' AND c4 = 4 AND t.value <> 0)"
)


@query("q_g21_quarters_sum", f"WITH {DP}, {_SUMS} SELECT * FROM chk WHERE abs(summed - total) > allowed")
def g21(spark: SparkSession, d: str) -> DataFrame:
    return R.quarters_against_totals(readings(spark, d))


_JUMP = "jump AS (SELECT job_id, product, id, lag(period) OVER w AS period_before, period, value, lag(value) OVER w AS before FROM val WHERE period_type = 'quarterly' WINDOW w AS (PARTITION BY job_id, product ORDER BY period, extracted_at, id)), jumps AS (SELECT job_id, product, id, period_before, period, greatest(abs(value), abs(before)) / least(abs(value), abs(before)) AS ratio FROM jump WHERE value <> 0 AND before <> 0 AND greatest(abs(value), abs(before)) / nullif(least(abs(value), abs(before)), 0) >= 100)"


@query("q_w08_scale_continuity", f"WITH {DP}, {_JUMP} SELECT * FROM jumps")
def w08(spark: SparkSession, d: str) -> DataFrame:
    return R.scale_jumps(readings(spark, d))


_CONF = (
    "cg AS (SELECT job_id, product, period, period_type, scope, count(*) AS n, min(value) AS low, max(value) AS high, arg_min(bound, (value, extracted_at, id)) AS _x, min((value, extracted_at, id)) AS lo, max((value, extracted_at, id)) AS hi FROM val GROUP BY job_id, product, period, period_type, scope), "
    "cc AS (SELECT cg.*, l.bound AS lb, h.bound AS hb, CASE WHEN lo[3] <> hi[3] AND l.bound + h.bound IS NOT NULL THEN greatest(l.bound + h.bound, 0.05) ELSE greatest(abs(high) * 0.005, 0.05) END AS allowed FROM cg JOIN val l ON l.id = lo[3] JOIN val h ON h.id = hi[3]), "
    "conf AS (SELECT job_id, product, period, period_type, scope, n, low, high, allowed FROM cc WHERE high - low > allowed)"
)


@query("q_c09_conflicting_values", f"WITH {DP}, {_CONF} SELECT * FROM conf")
def c09(spark: SparkSession, d: str) -> DataFrame:
    return R.conflicts(readings(spark, d))


def spelled(value, quote):
    """Whether the figure stands in its quote as a number of its own."""
    plain = F.translate(F.coalesce(quote, F.lit("")), ",", "")
    forms = [F.format_string("%.0f", value), F.format_string("%.1f", value), F.format_string("%.3f", value), F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), "0+$", ""), r"\.$", "")]
    tokens = F.regexp_extract_all(plain, F.lit(r"\d+(?:\.\d+)?"), 0)
    whole = F.abs(value - F.round(value, 0)) < 1e-9
    one = F.abs(value - F.round(value, 1)) < 1e-9
    return F.array_contains(tokens, forms[3]) | (whole & F.array_contains(tokens, forms[0])) | (one & F.array_contains(tokens, forms[1])) | F.array_contains(tokens, forms[2])


_TOK = "regexp_extract_all(replace(coalesce(quote, ''), ',', ''), '\\d+(?:\\.\\d+)?')"
_F6 = "regexp_replace(regexp_replace(printf('%.6f', reported), '0+$', ''), '\\.$', '')"
_SPELLED = f"(list_contains({_TOK}, {_F6}) OR (abs(reported - round(reported, 0)) < 1e-9 AND list_contains({_TOK}, printf('%.0f', reported))) OR (abs(reported - round(reported, 1)) < 1e-9 AND list_contains({_TOK}, printf('%.1f', reported))) OR list_contains({_TOK}, printf('%.3f', reported)))"


@query("q_c10_value_in_quote", f"WITH {DP} SELECT id, period FROM fig WHERE NOT {_SPELLED}")
def c10(spark: SparkSession, d: str) -> DataFrame:
    return R.states_a_figure(readings(spark, d)).filter(~spelled(F.col("reported"), F.col("quote"))).select("id", "period")


@query("q_c11_normalization_failed", f"WITH {DP} SELECT id, period, status FROM dp WHERE value IS NULL")
def c11(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).filter("value is null").select("id", "period", "status")


def findings(spark: SparkSession, d: str) -> DataFrame:
    """All findings as (code, severity, job_id, product, period)."""
    tag = lambda df, code, severity, period="period": df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "job_id", "product", F.col(period).cast("string").alias("period"))
    r = readings(spark, d)
    out = tag(R.quarters_against_totals(r), "quarters_sum_to_period_total", "error", "year")
    out = out.unionByName(tag(R.scale_jumps(r), "scale_continuity", "error")).unionByName(tag(R.conflicts(r), "conflicting_values", "error"))
    quote = R.states_a_figure(r).filter(~spelled(F.col("reported"), F.col("quote")))
    return out.unionByName(tag(quote, "value_supported_by_quote", "error")).unionByName(tag(r.filter("value is null"), "normalization_failed", "warning"))


_FINDINGS = (
    f"{DP}, {_SUMS}, {_JUMP}, {_CONF}, finds AS (SELECT 'quarters_sum_to_period_total' AS code, 'error' AS severity, job_id, product, CAST(year AS VARCHAR) AS period FROM chk WHERE abs(summed - total) > allowed UNION ALL SELECT 'scale_continuity', 'error', job_id, product, period FROM jumps "
    f"UNION ALL SELECT 'conflicting_values', 'error', job_id, product, period FROM conf UNION ALL SELECT 'value_supported_by_quote', 'error', job_id, product, period FROM fig WHERE NOT {_SPELLED} UNION ALL SELECT 'normalization_failed', 'warning', job_id, product, period FROM dp WHERE value IS NULL)"
)


@query("q_c08_run_checks", f"WITH {_FINDINGS} SELECT * FROM finds")
def c08(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d)


@query("q_t15_findings_in_order", f"WITH {_FINDINGS} SELECT code, severity, count(*) AS n, row_number() OVER (ORDER BY severity, code) AS place FROM finds GROUP BY 1, 2")
def t15(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    g = findings(spark, d).groupBy("code", "severity").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy("severity", "code")))


# --- adjudication ------------------------------------------------------------------------------

_ADJ = "CASE WHEN status LIKE 'derived%' THEN 'derived' ELSE 'stated' END"


@query(
    "q_c12_adjudicate_reported",
    f"WITH {DP}, g AS (SELECT job_id, product, period, count(*) FILTER (scope = 'Worldwide') AS k, count(DISTINCT {_ADJ}) FILTER (scope = 'Worldwide') AS b, min(round(value, 6)) FILTER (scope = 'Worldwide') AS lo, max(round(value, 6)) FILTER (scope = 'Worldwide') AS hi FROM val GROUP BY ALL) "
    "SELECT job_id, product, period, CASE WHEN k = 0 THEN 'impossible' WHEN b <= 1 AND hi - lo <= 1.0 THEN 'resolved' ELSE 'needs_review' END AS verdict, CASE WHEN k = 0 THEN 'scope_not_reported' WHEN b > 1 THEN 'restated_basis' WHEN lo = hi THEN 'single_stated_value' WHEN hi - lo <= 1.0 THEN 'agrees_within_rounding' ELSE 'sources_disagree' END AS code, "
    "CASE WHEN k > 0 AND b <= 1 AND hi - lo <= 1.0 THEN hi END AS value FROM g",
)
def c12(spark: SparkSession, d: str) -> DataFrame:
    r = R.states_a_value(readings(spark, d)).withColumn("basis", F.when(F.col("status").startswith("derived"), "derived").otherwise("stated"))
    return R.adjudicate(r, "Worldwide", ["job_id", "product", "period"])


_SPANS = (
    f"{CELLS}, tot AS (SELECT series, CAST(substr(period, 1, 4) AS INT) AS y, arg_max(value, (reported_at, id)) FILTER (period_type = 'annual') AS fy, arg_max(value, (reported_at, id)) FILTER (period LIKE '____H1') AS h1 FROM obs WHERE period_type IN ('annual', 'six_month') GROUP BY 1, 2), "
    "qv AS (SELECT series, CAST(floor(q / 4) AS INT) AS y, " + ", ".join(f"max(value) FILTER (q % 4 = {i}) AS q{i + 1}" for i in range(4)) + " FROM cells GROUP BY 1, 2), st AS (SELECT series, min(q) AS s FROM cells GROUP BY 1)"
)


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Per series and year the stated quarters, half and full year; a bound of 0.05 each, unknown for series of odd length names."""
    c = cells(spark, d)
    bound = F.when(F.length("series") % 2 == 0, 0.05)
    q = c.groupBy("series", F.floor(F.col("q") / 4).cast("int").alias("y")).agg(*[F.max(F.when(F.col("q") % 4 == i, F.struct("value", bound.alias("bound")))).alias(f"q{i + 1}") for i in range(4)])
    o = observations(spark, d).filter("period_type = 'annual' or period like '____H1'")
    t = o.groupBy("series", F.substring("period", 1, 4).cast("int").alias("y")).agg(
        F.max(F.when(F.col("period_type") == "annual", F.struct("reported_at", "id", "value"))).alias("f"), F.max(F.when(F.col("period_type") != "annual", F.struct("reported_at", "id", "value"))).alias("h")
    )
    start = c.groupBy("series").agg(F.min("q").alias("s"))
    j = t.join(q, ["series", "y"], "left").join(start, "series", "left")
    span = lambda x: F.when(F.col(x).isNotNull(), F.struct(F.col(f"{x}.value").alias("value"), bound.alias("bound")))
    return j.select("series", "y", "q1", "q2", "q3", "q4", span("f").alias("fy"), span("h").alias("h1"), F.lit(None).cast("struct<value:double,bound:double>").alias("m9"), F.when(F.floor(F.col("s") / 4) == F.col("y"), F.col("s") % 4 + 1).otherwise(1).cast("int").alias("start"))


_ADJT = (
    f"WITH {_SPANS}, a AS (SELECT t.series, t.y, t.fy AS total, coalesce(q1, 0) + coalesce(q2, 0) + coalesce(q3, 0) + coalesce(q4, 0) AS s, (q1 IS NOT NULL)::INT + (q2 IS NOT NULL)::INT + (q3 IS NOT NULL)::INT + (q4 IS NOT NULL)::INT AS n FROM tot t LEFT JOIN qv USING (series, y) WHERE fy IS NOT NULL), "
    "b AS (SELECT *, CASE WHEN n = 4 THEN CASE WHEN abs(s - total) <= 2.5 THEN 'parts_reconcile' WHEN s > total + 2.5 THEN 'parts_exceed_total' ELSE 'parts_fall_short_of_total' END WHEN n = 3 THEN CASE WHEN round(total - s, 6) < -2.5 THEN 'residual_is_negative' ELSE 'single_residual' END ELSE 'underdetermined_residual' END AS code FROM a) "
    "SELECT series, y, code, CASE WHEN code IN ('parts_reconcile', 'single_residual') THEN 'resolved' WHEN code = 'underdetermined_residual' THEN 'needs_review' ELSE 'impossible' END AS verdict, CASE code WHEN 'parts_reconcile' THEN total WHEN 'single_residual' THEN greatest(round(total - s, 6), 0) END AS value FROM b"
)


@query("q_c13_adjudicate_total", _ADJT)
def c13(spark: SparkSession, d: str) -> DataFrame:
    s = spans(spark, d).filter("fy is not null")
    stated = sum((F.coalesce(F.col(f"q{i}.value"), F.lit(0.0)) for i in range(1, 5)), F.lit(0.0))
    n = sum((F.col(f"q{i}").isNotNull().cast("int") for i in range(1, 5)), F.lit(0))
    status, code, value = R.adjudicate_total(F.col("fy.value"), stated, n, F.lit(4))
    return s.select("series", "y", code.alias("code"), status.alias("verdict"), value.alias("value"))


@query("q_c14_adjudicate_positional", f"WITH {DP} SELECT signature, CASE WHEN count(DISTINCT scope) = 1 THEN 'resolved' ELSE 'needs_review' END AS verdict, CASE WHEN count(DISTINCT scope) = 1 THEN 'unique_alignment' ELSE 'ambiguous_scope' END AS code FROM val GROUP BY 1")
def c14(spark: SparkSession, d: str) -> DataFrame:
    one = F.count_distinct("scope") == 1
    return R.states_a_value(readings(spark, d)).groupBy("signature").agg(F.when(one, "resolved").otherwise("needs_review").alias("verdict"), F.when(one, "unique_alignment").otherwise("ambiguous_scope").alias("code"))


def _derive_sql() -> str:
    """The derivation unrolled as nested selects: annual first, then the half."""
    sql = "SELECT t.series, t.y, q1, q2, q3, q4, fy, h1, CASE WHEN floor(s / 4) = t.y THEN s % 4 + 1 ELSE 1 END AS st, CASE WHEN length(t.series) % 2 = 0 THEN 0.05 END AS ub FROM tot t LEFT JOIN qv USING (series, y) LEFT JOIN st USING (series)"
    made = []
    for total, members in (("fy", (1, 2, 3, 4)), ("h1", (1, 2))):
        absent = " + ".join(f"(CASE WHEN {m} >= st AND q{m} IS NULL THEN 1 ELSE 0 END)" for m in members)
        sql = f"SELECT *, {absent} AS ab_{total} FROM ({sql})"
        parts = []
        for target in members:
            rest = " + ".join(f"(CASE WHEN {m} >= st THEN CAST(coalesce(q{m}, 0) AS DECIMAL(24,6)) ELSE 0 END)" for m in members if m != target)
            count = " + ".join(f"(CASE WHEN {m} >= st THEN 1 ELSE 0 END)" for m in members)
            tag = f"d_{total}_{target}"
            made.append((tag, target, f"{total}_less_quarters_{target}", f"ub * ({count})"))
            parts.append(f"CASE WHEN {total} IS NOT NULL AND ab_{total} = 1 AND {target} >= st AND q{target} IS NULL AND {total} - CAST({rest} AS DOUBLE) >= -0.05 THEN round({total} - CAST({rest} AS DOUBLE), 6) END AS {tag}")
        sql = f"SELECT *, {', '.join(parts)} FROM ({sql})"
        sql = f"SELECT * REPLACE ({', '.join(f'coalesce(q{m}, d_{total}_{m}) AS q{m}' for m in members)}) FROM ({sql})"
    rows = " UNION ALL ".join(f"SELECT series, y, {n} AS quarter, '{rule}' AS rule, {tag} AS value, {bound} AS bound FROM dd WHERE {tag} IS NOT NULL" for tag, n, rule, bound in made)
    return f"{_SPANS}, dd AS ({sql}), der AS ({rows})"


_DERIVED = _derive_sql()


@query("q_c05_complete_quarters", f"WITH {_DERIVED} SELECT *, coalesce(bound > 0.1 * abs(value) AND value <> 0, false) AS held FROM der")
def c05(spark: SparkSession, d: str) -> DataFrame:
    return R.derive_quarters(spans(spark, d), ["series", "y"])


@query("q_c06_complete_series", f"WITH {_DERIVED} SELECT series, {LABEL_OF.format('q')} AS period, value, 'reported' AS origin FROM cells UNION ALL SELECT series, y || 'Q' || quarter, value, CASE WHEN coalesce(bound > 0.1 * abs(value), false) THEN 'derived_held' ELSE 'derived' END FROM der WHERE value > 0")
def c06(spark: SparkSession, d: str) -> DataFrame:
    from seriesloom.functions.periods import quarter_label

    made = R.derive_quarters(spans(spark, d), ["series", "y"]).filter("value > 0")
    made = made.select("series", F.concat(F.col("y").cast("string"), F.lit("Q"), F.col("quarter").cast("string")).alias("period"), "value", F.when(F.col("held"), "derived_held").otherwise("derived").alias("origin"))
    return cells(spark, d).select("series", quarter_label(F.col("q")).alias("period"), "value", F.lit("reported").alias("origin")).unionByName(made)


@query(
    "q_c07_split_quarter",
    "WITH p AS (SELECT o_custkey AS k, year(o_orderdate) AS y, quarter(o_orderdate) AS qn, CAST(date_trunc('month', o_orderdate) AS DATE) AS begins, last_day(CAST(o_orderdate AS DATE)) AS ends, CAST(sum(CAST(o_totalprice AS DECIMAL(24,6))) AS DOUBLE) AS v FROM orders GROUP BY ALL) "
    "SELECT k, y, qn, CASE WHEN count(*) = 3 THEN CAST(sum(CAST(v AS DECIMAL(24,6))) AS DOUBLE) END AS value FROM p GROUP BY k, y, qn",
)
def c07(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    day = F.col("o_orderdate")
    p = o.groupBy(F.col("o_custkey").alias("k"), F.year(day).alias("y"), F.quarter(day).alias("qn"), F.trunc(day, "month").alias("begins")).agg(F.sum(F.col("o_totalprice").cast("decimal(24,6)")).cast("double").alias("value"))
    p = p.withColumn("ends", F.last_day("begins")).withColumn("s", F.make_date(F.col("y"), F.col("qn") * 3 - 2, F.lit(1))).withColumn("e", F.last_day(F.make_date(F.col("y"), F.col("qn") * 3, F.lit(1))))
    return R.split_quarter(p, ["k", "y", "qn"], "s", "e")


@query("q_g30_combined_bound", f"WITH {DP} SELECT job_id, product, period, CASE WHEN count(bound) = count(*) THEN sum(bound) END AS bound FROM val GROUP BY ALL")
def g30(spark: SparkSession, d: str) -> DataFrame:
    return R.states_a_value(readings(spark, d)).groupBy("job_id", "product", "period").agg(R.combined_bound(F.col("bound")).alias("bound"))


# --- anti-joins and unions ---------------------------------------------------------------------


@query("q_j08_prose_only_where_silent", f"WITH {RANKED}, t AS (SELECT DISTINCT job_id, product, period FROM rk WHERE source_type IN ('sec_filing', 'annual_report', 'quarterly_report') AND NOT list_contains(flags, 'label_not_understood')) SELECT id FROM rk r WHERE source_type IN ('transcript', 'other') AND NOT EXISTS (SELECT 1 FROM t WHERE t.job_id = r.job_id AND t.product = r.product AND t.period = r.period)")
def j08(spark: SparkSession, d: str) -> DataFrame:
    r = ranked(spark, d)
    stated = r.filter(F.col("source_type").isin("sec_filing", "annual_report", "quarterly_report") & R.understood(F.col("flags"))).select("job_id", "product", "period").distinct()
    return r.filter(F.col("source_type").isin("transcript", "other")).join(stated, ["job_id", "product", "period"], "left_anti").select("id")


@query("q_j09_derived_where_weaker", f"WITH {RANKED}, m AS (SELECT job_id, product, period, min(claim) AS m FROM rk WHERE status NOT LIKE 'derived%' GROUP BY ALL) SELECT r.id FROM rk r LEFT JOIN m USING (job_id, product, period) WHERE r.status LIKE 'derived%' AND (m IS NULL OR m > 2)")
def j09(spark: SparkSession, d: str) -> DataFrame:
    r = ranked(spark, d)
    m = r.filter(~F.col("status").startswith("derived")).groupBy("job_id", "product", "period").agg(F.min("claim").alias("m"))
    return r.filter(F.col("status").startswith("derived")).join(m, ["job_id", "product", "period"], "left").filter("m is null or m > 2").select("id")


@query("q_u09_all_producers", f"WITH {RANKED} SELECT claim, coalesce(source_type, 'none') AS source_type, count(*) AS n, count(value) AS figures FROM rk GROUP BY 1, 2")
def u09(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d).groupBy("claim", F.coalesce("source_type", F.lit("none")).alias("source_type")).agg(F.count("*").alias("n"), F.count("value").alias("figures"))


@query("q_c49_only_combined", f"WITH {DP} SELECT job_id, period FROM dp WHERE period_type = 'quarterly' GROUP BY 1, 2 HAVING bool_and(len(combined) > 0)")
def c49(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).filter("period_type = 'quarterly'").groupBy("job_id", "period").agg(F.bool_and(F.size("combined") > 0).alias("only")).filter("only").select("job_id", "period")


@query("q_p29_scale_disagrees", f"WITH {DP} SELECT id FROM dp WHERE upper(source_currency) IN ('USD', '$', 'US$') AND value IS NOT NULL AND reported <> 0 AND value <> 0 AND (greatest(abs(value), abs(reported * CASE WHEN lower(coalesce(source_unit, '')) LIKE '%billion%' THEN 1000 WHEN lower(coalesce(source_unit, '')) LIKE '%thousand%' THEN 0.001 ELSE 1 END)) / least(abs(value), abs(reported * CASE WHEN lower(coalesce(source_unit, '')) LIKE '%billion%' THEN 1000 WHEN lower(coalesce(source_unit, '')) LIKE '%thousand%' THEN 0.001 ELSE 1 END))) >= 10")
def p29(spark: SparkSession, d: str) -> DataFrame:
    from seriesloom.functions.numeric import scale_to_millions

    r = readings(spark, d).filter(F.upper("source_currency").isin("USD", "$", "US$") & F.col("value").isNotNull() & (F.col("reported") != 0) & (F.col("value") != 0))
    x, y = F.abs("value"), F.abs(scale_to_millions(F.col("reported"), F.col("source_unit")))
    return r.filter(F.greatest(x, y) / F.least(x, y) >= 10).select("id")


@query("q_p07_states_a_figure", f"WITH {DP} SELECT id FROM fig")
def p07(spark: SparkSession, d: str) -> DataFrame:
    return R.states_a_figure(readings(spark, d)).select("id")


@query("q_p08_held_for_bound", f"WITH {DP} SELECT id FROM dp WHERE bound <> 0 AND value <> 0 AND bound > 0.1 * abs(value)")
def p08(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).filter("bound != 0 and value != 0 and bound > 0.1d * abs(value)").select("id")


@query("q_p30_unquestioned", f"WITH {DP} SELECT id FROM dp WHERE NOT list_has_any(flags, ['label_not_understood', 'restated'])")
def p30(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).filter(~F.arrays_overlap("flags", F.array(F.lit("label_not_understood"), F.lit("restated")))).select("id")
