"""Scalar operators, each applied to whole columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions import geo, numeric, periods, text
from seriesloom.operators import readings as R
from seriesloom.plans.base import OBS, observations
from seriesloom.plans.problem_sql import label, qidx
from seriesloom.plans.readings import DP, SRC, _LOOSE, place_sql, readings, slug_sql, sources
from seriesloom.session import table
from seriesloom.vocab import DOSE_CONTEXT, EARLIEST_DAYS, MONEY_CONTEXT, TAXONOMY_MEMBER, TAXONOMY_NAME, FX_USD_PER_UNIT, MISSING_SPELLINGS, REGISTRANT_CONNECTIVES, REGISTRANT_SUFFIXES, REPORT_LAG_DAYS

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def over(name: str, source, key: str, value, sql_from: str, sql_value: str, alias: str = "value", sql_key: str | None = None):
    """Register ``value`` over every row of ``source`` under ``name``, with its SQL."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return source(spark, d).select(key, value().alias(alias))

    QUERIES[name] = run
    ORACLES[name] = sql_from.replace("{sel}", f"{sql_key or key}, {sql_value} AS {alias}")


def orders(spark, d):
    return table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))


ORD = "SELECT {sel} FROM (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders)"
DPQ = "WITH " + DP + " SELECT {sel} FROM dp"
SRQ = "WITH " + SRC + " SELECT {sel} FROM src"
OBQ = "WITH " + OBS + " SELECT {sel} FROM obs"
JOBS = "SELECT {sel} FROM (SELECT DISTINCT * FROM drug_jobs)"


def jobs(spark, d):
    return table(spark, d, "drug_jobs").distinct()


c = F.col
over("q_d01_quarter_of_month", orders, "o_orderkey", lambda: periods.quarter_of_month(F.month("day")), ORD, "(month(day) - 1) // 3 + 1")
over("q_d02_period_label", orders, "o_orderkey", lambda: periods.label_of(F.year("day"), F.lit(3) * (c("o_orderkey") % 4 + 1), F.quarter("day")), ORD,
     "CASE o_orderkey % 4 WHEN 0 THEN year(day) || 'Q' || quarter(day) WHEN 1 THEN year(day) || CASE WHEN quarter(day) > 2 THEN 'H2' ELSE 'H1' END WHEN 2 THEN year(day) || 'M9' ELSE CAST(year(day) AS VARCHAR) END")
over("q_d03_period_months", observations, "id", lambda: periods.period_months(c("period")), OBQ, "CASE period_type WHEN 'quarterly' THEN 3 WHEN 'six_month' THEN 6 WHEN 'nine_month' THEN 9 ELSE 12 END")
over("q_d05_quarter_end", orders, "o_orderkey", lambda: periods.quarter_end(F.year("day"), F.quarter("day")), ORD, "last_day(make_date(year(day), quarter(day) * 3, 1))")
over("q_d06_fiscal_period_end", orders, "o_orderkey", lambda: F.concat_ws("-", periods.fiscal_month(F.month("day"), F.day("day"), F.year("day"))["year"].cast("string"), periods.fiscal_month(F.month("day"), F.day("day"), F.year("day"))["month"].cast("string")), ORD,
     "CASE WHEN day(day) <= 7 THEN year(day - INTERVAL (day(day)) DAY) || '-' || month(day - INTERVAL (day(day)) DAY) ELSE year(day) || '-' || month(day) END")
over("q_d08_normalize_period", lambda s, d: table(s, d, "datapoints").select("id", "period").distinct(), "id", lambda: periods.period_label(c("period")), "SELECT {sel} FROM (SELECT DISTINCT id, period FROM datapoints)", label("period"))
over("q_d13_months_between", lambda s, d: jobs(s, d).select("id", "created_at", "updated_at").distinct(), "id", lambda: periods.months_between_calendar(c("created_at"), c("updated_at")), "SELECT {sel} FROM (SELECT DISTINCT id, created_at, updated_at FROM drug_jobs)",
     "(year(updated_at) - year(created_at)) * 12 + month(updated_at) - month(created_at)")
over("q_d14_quarter_index", orders, "o_orderkey", lambda: periods.date_quarter_index(c("day")), ORD, "year(day) * 4 + quarter(day) - 1")
over("q_d15_quarter_containing", orders, "o_orderkey", lambda: periods.quarter_label(periods.date_quarter_index(c("day"))), ORD, "year(day) || 'Q' || quarter(day)")
over("q_d17_period_end", observations, "id", lambda: periods.period_end(c("period")), OBQ, "period_end")
over("q_d18_months_of_span", lambda s, d: jobs(s, d).select("id", "created_at", "updated_at").distinct(), "id", lambda: F.bround(F.datediff("updated_at", "created_at") * 37 / 30.44).cast("int"), "SELECT {sel} FROM (SELECT DISTINCT id, created_at, updated_at FROM drug_jobs)",
     "CAST(round_even(date_diff('day', CAST(created_at AS DATE), CAST(updated_at AS DATE)) * 37 / 30.44, 0) AS INT)")
over("q_d19_span_label", orders, "o_orderkey", lambda: periods.quarter_label(periods.date_quarter_index(F.date_add("day", 45))), ORD, "year(day + 45) || 'Q' || quarter(day + 45)")
over("q_d21_openfda_date", orders, "o_orderkey", lambda: periods.loose_date(F.date_format("day", "yyyyMMdd")), ORD, "CAST(strptime(strftime(day, '%Y%m%d'), '%Y%m%d') AS DATE)")
over("q_d22_comparative_period", observations, "id", lambda: periods.year_before(c("period")), OBQ, "(CAST(substr(period, 1, 4) AS INT) - 1) || substr(period, 5)")
over("q_d24_approval_era", orders, "o_orderkey", lambda: F.when(F.year("day") < 1996, "pre-1996").when(F.year("day") >= 2000, "2000+").otherwise(periods.era(F.year("day"))), ORD,
     "CASE WHEN year(day) < 1996 THEN 'pre-1996' WHEN year(day) >= 2000 THEN '2000+' ELSE CAST(floor(year(day) / 5) * 5 AS INT) || '-' || CAST(floor(year(day) / 5) * 5 + 4 AS INT) END")
over("q_d27_era_start", orders, "o_orderkey", lambda: F.regexp_extract(F.regexp_replace(periods.era(F.year("day")), "pre-", ""), r"^(\d+)", 1).try_cast("int"), ORD, "CAST(floor(year(day) / 5) * 5 AS INT)")


@query("q_d04_period_span", f"WITH {OBS} SELECT id, CAST(CASE period_type WHEN 'quarterly' THEN period_end - INTERVAL 2 MONTH WHEN 'six_month' THEN period_end - INTERVAL 5 MONTH WHEN 'annual' THEN period_end - INTERVAL 11 MONTH END AS DATE) AS first_month_of, period_end AS last_day FROM obs")
def d04(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    span = periods.period_span(c("period"), periods.period_months(c("period")))
    return o.select("id", F.add_months("period_end", -(periods.period_months(c("period")) - 1)).alias("first_month_of"), span["end"].alias("last_day"))


@query("q_d09_period_key", f"WITH {OBS} SELECT DISTINCT period, substr(period, 1, 4) || 'M9' AS key FROM obs WHERE period_type = 'quarterly'")
def d09(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d).filter("period_type = 'quarterly'").select("period").distinct()
    return o.select("period", periods.label_of(F.substring("period", 1, 4), F.lit(9), F.lit(None).cast("int")).alias("key"))


_D07 = " UNION ALL ".join(f"SELECT id, y, {q} AS qn, last_day(make_date(y, {q * 3}, 1)) + {REPORT_LAG_DAYS[q]} AS by_day, last_day(make_date(y, {q * 3}, 1)) + {EARLIEST_DAYS} AS from_day, since, until FROM yy" for q in (1, 2, 3, 4))


@query("q_d07_quarters_reported_in", f"WITH w AS (SELECT DISTINCT id, CAST(created_at AS DATE) - 365 AS since, CAST(created_at AS DATE) AS until FROM drug_jobs), yy AS (SELECT *, unnest(range(year(since) - 1, year(until) + 1)) AS y FROM w), x AS ({_D07}) SELECT id, list(y || 'Q' || qn ORDER BY y, qn) AS quarters FROM x WHERE by_day >= since AND from_day <= until GROUP BY 1")
def d07(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "drug_jobs").select("id", F.date_sub(F.to_date("created_at"), 365).alias("since"), F.to_date("created_at").alias("until")).distinct()
    return w.select("id", quarters_reported_in(c("since"), c("until")).alias("quarters"))


def quarters_reported_in(since, until):
    """Quarters whose reports, at their usual lag and no earlier than 20 days on, fall into the window."""
    idx = F.sequence((F.year(since) - 1) * 4, F.year(until) * 4 + 3)
    end = lambda i: F.last_day(F.make_date(F.floor(i / 4).cast("int"), ((i % 4) * 3 + 3).cast("int"), F.lit(1)))
    lag = lambda i: F.when(i % 4 == 3, REPORT_LAG_DAYS[4]).otherwise(REPORT_LAG_DAYS[1])
    return F.transform(F.filter(idx, lambda i: (F.date_add(end(i), lag(i)) >= since) & (F.date_add(end(i), EARLIEST_DAYS) <= until)), lambda i: periods.quarter_label(i))


@query("q_d20_period_bounds", "SELECT o_orderkey, last_day(CAST(o_orderdate AS DATE)) AS ends, CAST(date_trunc('month', CAST(o_orderdate AS DATE)) - INTERVAL ((o_orderkey % 4) * 3 + 2) MONTH AS DATE) AS begins FROM orders")
def d20(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    end = F.last_day(F.to_date(F.date_format("day", "yyyyMMdd"), "yyyyMMdd"))
    return o.select("o_orderkey", end.alias("ends"), F.trunc(F.add_months(end, (-((c("o_orderkey") % 4 + 1) * 3 - 1)).cast("int")), "month").alias("begins"))


@query("q_d25_annual_keys", f"WITH {OBS} SELECT series, list_sort(list_distinct(list(substr(period, 1, 4)))) AS years FROM obs GROUP BY 1")
def d25(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).groupBy("series").agg(F.array_sort(F.collect_set(F.substring("period", 1, 4))).alias("years"))


@query("q_d26_after_the_document", f"WITH {DP}, {SRC} SELECT dp.id, {qidx('dp.period')} > year(filed) * 4 + quarter(filed) - 1 AS after FROM dp JOIN src ON dp.source_id = src.id WHERE dp.period LIKE '____Q_' AND filed IS NOT NULL")
def d26(spark: SparkSession, d: str) -> DataFrame:
    s = sources(spark, d).select(c("id").alias("source_id"), periods.loose_date(c("source_date")).alias("filed")).filter("filed is not null")
    r = readings(spark, d).filter("period like '____Q_'").join(s, "source_id")
    return r.select("id", (periods.quarter_index(c("period")) > periods.date_quarter_index(c("filed"))).alias("after"))


@query("q_d29_quarter_range", f"WITH {OBS}, s AS (SELECT series, min(q) AS lo, max(q) AS hi FROM obs WHERE q IS NOT NULL GROUP BY 1) SELECT series, list_transform(range(lo, hi + 1), lambda x: CAST(floor(x / 4) AS INT) || 'Q' || (x % 4 + 1)) AS quarters FROM s")
def d29(spark: SparkSession, d: str) -> DataFrame:
    s = observations(spark, d).filter("q is not null").groupBy("series").agg(F.min("q").alias("lo"), F.max("q").alias("hi"))
    return s.select("series", F.transform(F.sequence("lo", "hi"), lambda i: periods.quarter_label(i)).alias("quarters"))


_FISCAL = f"WITH {OBS}, r AS (SELECT currency, calendar_year AS y, usd_per_unit AS r FROM fx_rates)"


@query("q_d30_fiscal_year_usd", f"{_FISCAL} SELECT o.id, o.value * (0.5 * a.r + 0.5 * b.r) AS usd, 0.5 * a.r + 0.5 * b.r AS rate FROM obs o LEFT JOIN r a ON o.currency = a.currency AND CAST(substr(period, 1, 4) AS INT) - 1 = a.y LEFT JOIN r b ON o.currency = b.currency AND CAST(substr(period, 1, 4) AS INT) = b.y WHERE period_type = 'annual' AND o.currency <> 'USD'")
def d30(spark: SparkSession, d: str) -> DataFrame:
    """A fiscal year ending in June: the mean of the rates of its own four quarters, two in either year; null where one is missing."""
    o = observations(spark, d).filter("period_type = 'annual' and currency != 'USD'").withColumn("y", F.substring("period", 1, 4).cast("int"))
    fx = table(spark, d, "fx_rates")
    rate = lambda n, shift: fx.select("currency", (c("calendar_year") + shift).alias("y"), c("usd_per_unit").alias(n))
    j = o.join(rate("a", 1), ["currency", "y"], "left").join(rate("b", 0), ["currency", "y"], "left")
    mean = 0.5 * c("a") + 0.5 * c("b")
    return j.select("id", (c("value") * mean).alias("usd"), mean.alias("rate"))


@query("q_j13_quarterly_usd", f"{_FISCAL} SELECT o.id, CASE WHEN o.currency = 'USD' THEN value ELSE value * r.r END AS usd, CASE WHEN o.currency <> 'USD' AND r.r IS NULL THEN 'missing_rate' END AS problem FROM obs o LEFT JOIN r ON o.currency = r.currency AND CAST(substr(period, 1, 4) AS INT) = r.y WHERE period_type = 'quarterly'")
def j13(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d).filter("period_type = 'quarterly'").withColumn("y", F.substring("period", 1, 4).cast("int"))
    j = o.join(table(spark, d, "fx_rates").select("currency", c("calendar_year").alias("y"), c("usd_per_unit").alias("r")), ["currency", "y"], "left")
    usd = c("currency") == "USD"
    return j.select("id", F.when(usd, c("value")).otherwise(c("value") * c("r")).alias("usd"), F.when(~usd & c("r").isNull(), "missing_rate").alias("problem"))


# --- numbers -----------------------------------------------------------------------------------

_FXV = ", ".join(f"('{cur}', {y}, {r})" for cur, t in FX_USD_PER_UNIT.items() for y, r in t.items())


@query(
    "q_n01_normalize",
    f"WITH {OBS}, fx(cur, y, r) AS (VALUES {_FXV}), n AS (SELECT id, value, currency, CAST(substr(period, 1, 4) AS INT) AS yy, r FROM obs LEFT JOIN fx ON currency = cur AND CAST(substr(period, 1, 4) AS INT) = fx.y) SELECT id, CASE WHEN currency = 'USD' THEN round(value, 6) ELSE round(value * r, 6) END AS usd_millions, CASE WHEN currency = 'USD' OR r IS NOT NULL THEN 'ok' ELSE 'no_fx_rate_for_' || currency || '_' || yy END AS status FROM n",
)
def n01(spark: SparkSession, d: str) -> DataFrame:
    fx = spark.createDataFrame([(cur, y, r) for cur, t in FX_USD_PER_UNIT.items() for y, r in t.items()], "currency string, y int, r double")
    o = observations(spark, d).withColumn("y", F.substring("period", 1, 4).cast("int")).join(F.broadcast(fx), ["currency", "y"], "left")
    usd = c("currency") == "USD"
    status = F.when(usd | c("r").isNotNull(), "ok").otherwise(F.concat(F.lit("no_fx_rate_for_"), "currency", F.lit("_"), c("y").cast("string")))
    return o.select("id", F.round(F.when(usd, c("value")).otherwise(c("value") * c("r")), 6).alias("usd_millions"), status.alias("status"))


over("q_n02_scale_to_millions", readings, "id", lambda: numeric.scale_to_millions(c("reported"), c("source_unit")), DPQ, "reported * CASE WHEN lower(coalesce(source_unit, '')) LIKE '%billion%' THEN 1000.0 WHEN lower(coalesce(source_unit, '')) LIKE '%thousand%' THEN 0.001 ELSE 1.0 END")
over("q_n03_usd_only", observations, "id", lambda: numeric.usd_only_millions(c("value") * 1e6, c("currency")), OBQ, "CASE WHEN currency = 'USD' THEN value * 1000000.0 / 1000000.0 END")
over("q_n04_rounding_uncertainty", orders, "o_orderkey", lambda: numeric.declared_bound(F.when(c("o_orderkey") % 5 == 0, "INF").when(c("o_orderkey") % 5 == 1, F.lit(None)).otherwise((-(c("o_orderkey") % 5) - 1).cast("string"))), ORD, "CASE o_orderkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN NULL WHEN 2 THEN 1000 / 2e6 WHEN 3 THEN 10000 / 2e6 ELSE 100000 / 2e6 END")
over("q_n05_agrees", lambda s, d: readings(s, d).filter("value is not null"), "id", lambda: numeric.agrees(c("reported"), c("value"), c("bound")), "WITH " + DP + " SELECT {sel} FROM dp WHERE value IS NOT NULL",
     "abs(reported - value) <= greatest(coalesce(2 * bound, 0.005 * greatest(abs(reported), abs(value))), 0.05)")
over("q_n06_rounding_tolerance", orders, "o_orderkey", lambda: numeric.rounding_tolerance(c("o_orderkey") % 7), ORD, "0.5 * (o_orderkey % 7 + 1)")
over("q_n11_percent_change", lambda s, d: table(s, d, "events"), "event_id", lambda: numeric.percent_change(c("value"), c("user_id") % 10 * 1.0), "SELECT {sel} FROM events", "CASE WHEN user_id % 10 <> 0 THEN (value - user_id % 10) / (user_id % 10) * 100 END")
over("q_n12_looks_like_change", lambda s, d: table(s, d, "events"), "event_id", lambda: numeric.looks_like_change(c("user_id") % 100 * 1.0, c("value"), c("user_id") % 10 * 1.0), "SELECT {sel} FROM events", "coalesce(CASE WHEN user_id % 10 <> 0 THEN abs(user_id % 100 - (value - user_id % 10) / (user_id % 10) * 100) <= 0.6 END, false)")
# --- lists of figures as SQL -------------------------------------------------------------------

NUMBERS = (
    "nt AS (SELECT *, list_filter(list_transform(regexp_extract_all(quote, '-?\\(?\\d[\\d,]*\\.?\\d*\\)?'), lambda t: {'v': (CASE WHEN t LIKE '(%' AND t LIKE '%)' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) * TRY_CAST(replace(regexp_replace(t, '[()]', '', 'g'), ',', '') AS DOUBLE), 'dot': contains(t, '.')}), lambda x: x.v IS NOT NULL) AS l FROM dp WHERE quote IS NOT NULL), "
    "num AS (SELECT * EXCLUDE (l), list_transform(list_filter(range(1, len(l) + 1), lambda i: len(list_filter(l[1:i], lambda x: x.dot OR abs(x.v) >= 10)) > 0), lambda i: l[i].v) AS n FROM nt)"
)
COMPARATIVE = (
    f"{NUMBERS}, hv AS (SELECT *, len(n) // 2 AS half, greatest(len(n) // 2, 1) AS w FROM num), "
    "pt AS (SELECT *, n[1:w] AS a, n[half + 1:half + w] AS b FROM hv), "
    "cmp AS (SELECT * EXCLUDE (a, b), CASE WHEN coalesce(len(n) >= 3 AND abs(n[1] - n[2] - n[3]) <= 0.15 AND (len(n) < 4 OR n[2] = 0 OR abs(100 * (n[1] - n[2]) / n[2] - n[4]) <= 1.5) AND abs(n[1] - reported) <= 0.15, false) THEN n[2] "
    "WHEN coalesce(len(n) >= 6 AND len(n) % 2 = 0 AND abs(list_sum(a) - 2 * a[-1]) <= 0.15 AND abs(list_sum(b) - 2 * b[-1]) <= 0.15, false) THEN b[list_filter(range(1, len(a) + 1), lambda i: abs(a[i] - reported) <= 0.15)[1]] END AS v FROM pt)"
)


def text_number_sql(x: str) -> str:
    """Text to a number, over a list of texts ``x``."""
    joined = f"list_transform({x}, lambda t: regexp_replace(regexp_replace(regexp_replace(trim(t), '\\s', '', 'g'), '[−–]', '-', 'g'), '^\\((.*)\\)$', '-\\1'))"
    plain = f"list_transform({joined}, lambda t: CASE WHEN regexp_matches(t, '^[-+]?\\d{{1,3}}(\\.\\d{{3}})+,\\d+$') THEN replace(replace(t, '.', ''), ',', '.') ELSE replace(t, ',', '') END)"
    return f"list_transform({plain}, lambda t: CASE WHEN regexp_matches(t, '^[-+]?(\\d+\\.?\\d*|\\.\\d+)([eE][-+]?\\d+)?$') THEN TRY_CAST(regexp_replace(t, '^\\+', '') AS DOUBLE) END)"


over("q_n15_peak_bucket", observations, "id", lambda: numeric.peak_bucket(c("value")), OBQ, "CASE WHEN value < 500 THEN '<500' WHEN value <= 1000 THEN '500-1000' ELSE '>1000' END")
over("q_n16_number_spellings", lambda s, d: readings(s, d).filter("reported is not null"), "id", lambda: F.array_sort(numeric.spellings(c("reported"))), "WITH " + DP + " SELECT {sel} FROM dp WHERE reported IS NOT NULL",
     "list_sort(list_distinct(list_filter(list_concat(" + "[" + ", ".join(f"CASE WHEN abs(round(reported, {k}) - reported) < 1e-9 THEN replace(format('{{:,.{k}f}}', reported), ',', '') END" for k in range(4)) + "], [" + ", ".join(f"CASE WHEN abs(round(reported, {k}) - reported) < 1e-9 THEN format('{{:,.{k}f}}', reported) END" for k in range(4)) + "]), lambda x: x IS NOT NULL)))")
over("q_n17_decimals", orders, "o_orderkey", lambda: numeric.declared_decimals(F.when(c("o_orderkey") % 3 == 0, "32767").when(c("o_orderkey") % 3 == 1, " ").otherwise("-3")), ORD, "CASE o_orderkey % 3 WHEN 0 THEN 'INF' WHEN 1 THEN NULL ELSE '-3' END")
over("q_n10_stated_number", lambda s, d: table(s, d, "revenue_export").select("row_id", "value_reported").distinct(), "row_id", lambda: numeric.text_number(c("value_reported")), "SELECT {sel} FROM (SELECT DISTINCT row_id, value_reported FROM revenue_export)",
     "TRY_CAST(CASE WHEN trim(value_reported) LIKE '(%)' THEN '-' || replace(trim(trim(value_reported), '()'), ',', '') ELSE replace(replace(trim(value_reported), ',', ''), '+', CASE WHEN value_reported LIKE '%e+%' THEN '+' ELSE '' END) END AS DOUBLE)")
over("q_n07_parse_numbers", lambda s, d: readings(s, d).filter("quote is not null"), "id", lambda: text.number_tokens(c("quote")), "WITH " + DP + ", " + NUMBERS + " SELECT {sel} FROM num", "n", alias="numbers")
over("q_n13_comparative_value", lambda s, d: readings(s, d).filter("quote is not null"), "id", lambda: text.comparative_value(c("quote"), c("reported")), "WITH " + DP + ", " + COMPARATIVE + " SELECT {sel} FROM cmp", "v")


def cell_number(cell):
    """One table cell to a number: a lone dash is 0, a percentage is none, parentheses are negative."""
    t = F.trim(cell)
    return F.when(t.rlike(r"^[-–—]+$"), 0.0).when(t.contains("%"), None).otherwise(numeric.text_number(F.regexp_replace(t, r"[$€£¥]", "")))


over("q_n09_cell_number", lambda s, d: table(s, d, "revenue_export").select("row_id", "value_reported").distinct(), "row_id", lambda: cell_number(c("value_reported")), "SELECT {sel} FROM (SELECT DISTINCT row_id, value_reported FROM revenue_export)",
     "CASE WHEN trim(value_reported) = '-' THEN 0.0 ELSE TRY_CAST(CASE WHEN trim(value_reported) LIKE '(%)' THEN '-' || replace(trim(trim(value_reported), '()'), ',', '') ELSE replace(replace(trim(value_reported), ',', ''), '+', CASE WHEN value_reported LIKE '%e+%' THEN '+' ELSE '' END) END AS DOUBLE) END")
over("q_n08_tokenize_row", lambda s, d: readings(s, d).filter("quote like '%|%'"), "id", lambda: F.transform(F.split("quote", r"\s*\|\s*"), lambda x: F.when(~x.rlike(r"^[-–—]+$"), numeric.text_number(x))), "WITH " + DP + " SELECT {sel} FROM dp WHERE quote LIKE '%|%'", text_number_sql("regexp_split_to_array(quote, '\\s*\\|\\s*')"), alias="cells")


@query("q_n18_adds_up", "WITH s AS (SELECT l_orderkey, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(24,6))) AS parts, max(o_totalprice) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT l_orderkey, abs(total - CAST(parts AS DOUBLE)) <= 0.5 * n AS adds_up FROM s")
def n18(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(c("l_extendedprice").cast("decimal(24,6)")).cast("double").alias("parts"))
    o = table(spark, d, "orders").select(c("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return li.join(o, "l_orderkey").select("l_orderkey", (F.abs(c("o_totalprice") - c("parts")) <= 0.5 * c("n")).alias("adds_up"))


# --- text --------------------------------------------------------------------------------------

_ws = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_nv = lambda x: f"lower(trim(regexp_replace(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'), '[\\s.]+$', '')))"
_MISS = ", ".join(f"'{m}'" for m in MISSING_SPELLINGS)
_dropped = ", ".join(f"'{w}'" for w in [*REGISTRANT_SUFFIXES, *REGISTRANT_CONNECTIVES])

over("q_x01_normalize_geography", readings, "id", lambda: geo.normalize_geography(c("geography")), DPQ, place_sql("geography"))
over("q_x02_squash", readings, "id", lambda: geo.squash(c("product")), DPQ, "trim(regexp_replace(replace(lower(product), '.', ''), '[^a-z0-9]+', ' ', 'g'))")
over("q_x03_slug", readings, "id", lambda: geo.slug(c("product")), DPQ, slug_sql("product"))
over("q_x05_scope_key", observations, "id", lambda: F.when(c("revenue_scope") == "Worldwide", "Product family").otherwise(c("revenue_scope")), OBQ, "CASE revenue_scope WHEN 'Worldwide' THEN 'Product family' ELSE revenue_scope END")
over("q_x06_reason_code", lambda s, d: jobs(s, d).select("id", F.concat(F.lit("["), "status", F.lit("] at "), "current_step").alias("reason")).distinct(), "id", lambda: text.reason_code(c("reason")), "SELECT {sel} FROM (SELECT DISTINCT id, status FROM drug_jobs)", "status")
over("q_x07_analog_key", lambda s, d: jobs(s, d).select("id", "drug_name").distinct(), "id", lambda: text.analog_key(c("drug_name")), "SELECT {sel} FROM (SELECT DISTINCT id, drug_name FROM drug_jobs)", f"lower({_ws('drug_name')})")
over("q_x08_product_identity", lambda s, d: jobs(s, d).select("id", "drug_name", "generic_name").distinct(), "id", lambda: text.product_identity(c("drug_name"), [c("drug_name"), c("generic_name")]), "SELECT {sel} FROM (SELECT DISTINCT id, drug_name, generic_name FROM drug_jobs)",
     f"lower({_ws('drug_name')}) || ':' || substr(sha256(lower(drug_name) || '::' || lower(coalesce(generic_name, ''))), 1, 24)")
over("q_x10_normalize_registrant", lambda s, d: jobs(s, d).select("id", "manufacturer").distinct(), "id", lambda: text.registrant(c("manufacturer")), "SELECT {sel} FROM (SELECT DISTINCT id, manufacturer FROM drug_jobs)",
     f"array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(manufacturer, '')), '[^a-z0-9&\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x NOT IN ({_dropped}) AND x <> ''), ' ')")
over("q_x11_form_family", sources, "id", lambda: text.form_family(c("filing_type")), SRQ, "regexp_replace(regexp_extract(upper(coalesce(filing_type, '')), '^([^/\\s]*)', 1), 'T+$', '')")
over("q_x12_exhibit_number", lambda s, d: table(s, d, "part").select("p_partkey", F.concat(F.lit(" ex-"), (c("p_size") + 80).cast("string"), F.lit(".1")).alias("t")), "p_partkey", lambda: text.exhibit_number(c("t")), "SELECT {sel} FROM part", "CAST(p_size + 80 AS VARCHAR)")
over("q_x13_canonical_member", lambda s, d: jobs(s, d).select("id", F.concat(F.lit("co:"), F.regexp_replace("drug_name", " ", ""), F.lit("Member")).alias("m")).distinct(), "id", lambda: text.canonical_member(c("m")), "SELECT {sel} FROM (SELECT DISTINCT id, drug_name FROM drug_jobs)", "regexp_replace(lower(drug_name), '[^a-z0-9]', '', 'g')")
over("q_x14_member_words", lambda s, d: table(s, d, "part").select("p_partkey", F.concat(F.lit("us-gaap:"), F.initcap("p_name"), F.lit("SalesMember")).alias("m")), "p_partkey", lambda: text.member_words(c("m")), "SELECT {sel} FROM part",
     "list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ') || ['sales'], lambda x: x <> '')", alias="words")
over("q_x16_candidates_fingerprint", lambda s, d: jobs(s, d).groupBy("run_id").agg(F.collect_set("drug_name").alias("p")), "run_id", lambda: text.candidates_fingerprint(c("p")), "SELECT {sel} FROM (SELECT run_id, list(DISTINCT trim(drug_name)) AS p FROM drug_jobs GROUP BY 1)", "substr(sha256(array_to_string(list_sort(list_distinct(p)), chr(10))), 1, 16)")
over("q_x17_product_aliases", lambda s, d: jobs(s, d).select("id", "drug_name", "generic_name").distinct(), "id", lambda: text.product_aliases(c("drug_name"), c("generic_name")), "SELECT {sel} FROM (SELECT id, list_filter(list_transform(list_filter(list_concat([drug_name, generic_name], regexp_split_to_array(coalesce(drug_name, ''), '[|,;/]'), regexp_split_to_array(coalesce(generic_name, ''), '[|,;/]')), lambda a: a IS NOT NULL), lambda a: trim(regexp_replace(regexp_replace(a, '\\([^)]*\\)', ' ', 'g'), '\\s+', ' ', 'g'))), lambda a: length(a) >= 3) AS l FROM (SELECT DISTINCT id, drug_name, generic_name FROM drug_jobs))",
     "list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(list_transform(l, lambda a: lower(a)), lower(l[i])) = i), lambda i: l[i])", alias="aliases")
over("q_x20_clean_label", readings, "id", lambda: text.clean_label(c("product")), DPQ, "trim(regexp_replace(regexp_replace(regexp_replace(product, '[®™*†‡§]|\\((?:TM|R|SM)\\)', '', 'g'), '\\s*(?:\\(\\d{1,2}\\)|\\[\\d{1,2}\\])\\s*$', ''), '\\s+', ' ', 'g'))")
over("q_x28_normalize_value", lambda s, d: jobs(s, d).select("id", "indication").distinct(), "id", lambda: text.normalize_value(c("indication")), "SELECT {sel} FROM (SELECT DISTINCT id, indication FROM drug_jobs)", _nv("indication"))
over("q_x29_route_terms", lambda s, d: table(s, d, "part"), "p_partkey", lambda: text.route_terms(F.concat("p_type", F.lit("; "), "p_brand", F.lit("/"), "p_type")), "SELECT {sel} FROM part", f"list_sort(list_distinct([lower({_ws('p_type')}), lower({_ws('p_brand')})]))", alias="terms")
over("q_x32_normalize_for_match", lambda s, d: table(s, d, "documents").select("doc_id", "text"), "doc_id", lambda: F.md5(text.collapse(c("text"))), "SELECT {sel} FROM documents", f"md5({_ws('text')})")
over("q_x34_shape_signature", readings, "id", lambda: F.substring(F.sha2(F.concat_ws("|", F.coalesce("source_unit", F.lit("")), F.coalesce("source_currency", F.lit("")), "period_type"), 256), 1, 16), DPQ, "substr(sha256(coalesce(source_unit, '') || '|' || coalesce(source_currency, '') || '|' || period_type), 1, 16)")
over("q_x36_slug_of_parts", observations, "id", lambda: geo.slug(F.concat_ws(" ", "product", "geography", "period")), OBQ, slug_sql("product || ' ' || geography || ' ' || period"))
over("q_x39_evidence_hash", lambda s, d: table(s, d, "events"), "event_id", lambda: F.sha2(F.to_json(F.struct(c("event_type"), c("user_id"))), 256), "SELECT {sel} FROM events", """sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}')""")
over("q_p19_is_missing_value", lambda s, d: table(s, d, "revenue_export").select("row_id", "value_reported").distinct(), "row_id", lambda: text.is_missing(c("value_reported")), "SELECT {sel} FROM (SELECT DISTINCT row_id, value_reported FROM revenue_export)", f"value_reported IS NULL OR lower(regexp_replace({_ws('value_reported')}, '^\\.+|\\.+$', '', 'g')) IN ({_MISS})")
over("q_p20_values_conflict", lambda s, d: jobs(s, d).select("id", "drug_name", "generic_name").distinct(), "id", lambda: text.conflicting(c("drug_name"), c("generic_name")), "SELECT {sel} FROM (SELECT DISTINCT id, drug_name, generic_name FROM drug_jobs)",
     f"coalesce(generic_name IS NOT NULL AND {_nv('drug_name')} <> {_nv('generic_name')} AND NOT contains({_nv('drug_name')}, {_nv('generic_name')}) AND NOT contains({_nv('generic_name')}, {_nv('drug_name')}), false)")
over("q_p22_names_a_quarter", lambda s, d: table(s, d, "quarterly_revenue").select("row_id", "period").distinct(), "row_id", lambda: F.coalesce(periods.period_label(c("period")).rlike(r"^\d{4}Q[1-4]$"), F.lit(False)), "SELECT {sel} FROM (SELECT DISTINCT row_id, period FROM quarterly_revenue)", f"coalesce({label('period')} LIKE '____Q_', false)")
over("q_p16_placeholder_period", readings, "id", lambda: ~c("period").rlike("[0-9]") & (c("period") != "unknown"), DPQ, "NOT regexp_matches(period, '[0-9]') AND period <> 'unknown'")
over("q_p24_reports_a_period", sources, "id", lambda: text.reports_a_period(c("filing_type")), SRQ, "coalesce(filing_type IN ('10-K', '10-Q', '20-F', '40-F', '6-K'), false)")
over("q_p33_is_fetchable", sources, "id", lambda: text.fetchable(c("source_url")), SRQ, "coalesce(source_url LIKE 'http%://%', false)")
over("q_p26_states_an_amount", readings, "id", lambda: c("source_currency").isNull() | c("source_currency").rlike("^[A-Z]{3}$"), DPQ, "source_currency IS NULL OR regexp_matches(source_currency, '^[A-Z]{3}$')")
over("q_t05_reading_order", sources, "id", lambda: F.when(text.form_family(c("filing_type")).isin("10-K", "20-F", "40-F"), 0).when(text.reports_a_period(c("filing_type")), 1).otherwise(2), SRQ, "CASE WHEN filing_type IN ('10-K', '20-F', '40-F') THEN 0 WHEN filing_type IN ('10-Q', '6-K') THEN 1 ELSE 2 END")
over("q_t08_claim_rank", readings, "id", lambda: R.claim_rank(c("status")), DPQ, "CASE WHEN status LIKE 'derived%' THEN 2 ELSE 8 END")
over("q_t11_scope_rank", observations, "id", lambda: F.when(c("revenue_scope").isin("Product family", "Worldwide"), 0).when(c("revenue_scope") == "U.S.", 3).when(c("revenue_scope") == "ex-U.S.", 4).otherwise(99), OBQ, "CASE revenue_scope WHEN 'Worldwide' THEN 0 WHEN 'Product family' THEN 0 WHEN 'U.S.' THEN 3 WHEN 'ex-U.S.' THEN 4 ELSE 99 END")
over("q_p01_product_scopes", observations, "id", lambda: c("revenue_scope").isin("Product family", "Formulation-specific", "U.S.", "Worldwide"), OBQ, "revenue_scope IN ('Product family', 'Formulation-specific', 'U.S.', 'Worldwide')")
over("q_p10_quote_mentions_product", lambda s, d: readings(s, d).filter("quote is not null"), "id", lambda: text.mentions(c("quote"), F.array("product")), "WITH " + DP + " SELECT {sel} FROM dp WHERE quote IS NOT NULL", f"contains(lower({_ws('quote')}), lower(product)) OR contains(lower({_ws('quote')}), lower({_ws('product')}))")
over("q_p14_dosage_not_revenue", lambda s, d: readings(s, d).filter("quote is not null"), "id", lambda: c("quote").rlike(DOSE_CONTEXT) & ~c("quote").rlike(MONEY_CONTEXT), "WITH " + DP + " SELECT {sel} FROM dp WHERE quote IS NOT NULL", f"regexp_matches(quote, '{DOSE_CONTEXT}') AND NOT regexp_matches(quote, '{MONEY_CONTEXT}')")
over("q_p15_noise_quote", lambda s, d: readings(s, d).filter("quote is not null"), "id", lambda: c("quote").rlike(TAXONOMY_MEMBER) | (F.trim("quote").rlike(TAXONOMY_NAME) & c("quote").contains(":")), "WITH " + DP + " SELECT {sel} FROM dp WHERE quote IS NOT NULL", f"regexp_matches(quote, '{TAXONOMY_MEMBER}') OR (regexp_matches(trim(quote), '{TAXONOMY_NAME}') AND contains(quote, ':'))")
over("q_p17_quote_contains_value", lambda s, d: readings(s, d).filter("quote is not null and reported is not null"), "id", lambda: text.quote_contains(c("quote"), c("reported")), "WITH " + DP + " SELECT {sel} FROM dp WHERE quote IS NOT NULL AND reported IS NOT NULL",
     "contains(replace(quote, ',', ''), regexp_replace(regexp_replace(printf('%.10f', reported), '0+$', ''), '\\.$', '')) OR contains(replace(quote, ',', ''), printf('%.1f', reported)) OR contains(replace(quote, ',', ''), printf('%.0f', reported))")
over("q_a06_segments_to_members", lambda s, d: table(s, d, "part").select("p_partkey", F.concat(F.lit("Brand="), "p_brand", F.lit("; Type="), "p_type", F.lit(";;")).alias("s")), "p_partkey", lambda: F.array_sort(F.map_values(text.segments_map(c("s")))), "SELECT {sel} FROM part", "list_sort([p_brand, p_type])", alias="members")
over("q_a14_cell", lambda s, d: readings(s, d), "id", lambda: F.array_join("flags", ", "), DPQ, "array_to_string(flags, ', ')")
over("q_a12_stated_labels", lambda s, d: readings(s, d), "id", lambda: F.filter(F.transform("flags", lambda x: F.trim(x)), lambda x: x != ""), DPQ, "list_filter(list_transform(flags, lambda x: trim(x)), lambda x: x <> '')", alias="labels")
over("q_a09_field_enrichment", lambda s, d: jobs(s, d).select("id", "generic_name", "indication").distinct(), "id", lambda: F.coalesce("generic_name", F.concat(F.lit("suggested: "), "indication")), "SELECT {sel} FROM (SELECT DISTINCT id, generic_name, indication FROM drug_jobs)", "coalesce(generic_name, 'suggested: ' || indication)")
over("q_a10_merge_enrichment", lambda s, d: jobs(s, d).select("id", "ticker", "cik", "drug_name").distinct(), "id", lambda: F.concat_ws("; ", F.coalesce("ticker", "cik", "drug_name"), "drug_name"), "SELECT {sel} FROM (SELECT DISTINCT id, ticker, cik, drug_name FROM drug_jobs)", "coalesce(ticker, cik, drug_name) || '; ' || drug_name")
over("q_a07_searched_identity", lambda s, d: table(s, d, "events"), "event_id", lambda: F.when(F.try_parse_json("props").isNull(), "unreadable").when(F.get_json_object("props", "$.k").isNull(), "no_key").otherwise("read"), "SELECT {sel} FROM events", "CASE WHEN NOT json_valid(props) THEN 'unreadable' WHEN json_extract_string(props, '$.k') IS NULL THEN 'no_key' ELSE 'read' END")
