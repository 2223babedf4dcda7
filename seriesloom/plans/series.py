"""Series analytics: annual roll-up, peaks, uptake, coverage, matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.functions.periods import quarter_label
from seriesloom.operators import annual as A
from seriesloom.plans.base import CELLS, ESTIMATES, LAUNCHES, OBS, cells, estimates, launches, observations
from seriesloom.plans.problem_sql import LABEL_OF
from seriesloom.vocab import PRODUCT_SCOPES, SCOPE_KEY

QUERIES, ORACLES = {}, {}
SCOPE = ", ".join(SCOPE_KEY)
ALLOWED = ", ".join(f"'{s}'" for s in PRODUCT_SCOPES)
AS_OF = "2017-06-30"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product, period, " + SCOPE + " ORDER BY confidence DESC NULLS LAST, id) AS rn FROM {src}) WHERE rn = 1)"
BEST_USD = BEST.format(src=f"(SELECT * FROM obs WHERE currency = 'USD' AND revenue_scope IN ({ALLOWED}))")
ANNUAL = (
    f"{BEST_USD}, y AS (SELECT *, substr(period, 1, 4) AS year FROM best WHERE period_type IN ('annual', 'quarterly')), "
    f"stated AS (SELECT product, year, {SCOPE}, max(value) AS value, list(id ORDER BY period, id) AS input_ids FROM y WHERE period_type = 'annual' GROUP BY ALL), "
    f"rolled AS (SELECT product, year, {SCOPE}, CAST(sum(CAST(value AS DECIMAL(24,6))) AS DOUBLE) AS value, list(id ORDER BY period, id) AS input_ids FROM y WHERE period_type = 'quarterly' GROUP BY ALL HAVING count(*) = 4), "
    "annual AS (SELECT * FROM stated UNION ALL SELECT r.* FROM rolled r WHERE NOT EXISTS (SELECT 1 FROM stated s WHERE s.product = r.product AND s.year = r.year AND s.currency = r.currency "
    "AND s.geography = r.geography AND s.revenue_scope = r.revenue_scope AND s.formulation_scope IS NOT DISTINCT FROM r.formulation_scope))"
)


@query("q_g01_one_per_period", f"WITH {OBS}, {BEST.format(src='obs')} SELECT id, product, period, geography, value FROM best")
def g01(spark: SparkSession, d: str) -> DataFrame:
    return A.one_per_period(observations(spark, d)).select("id", "product", "period", "geography", "value")


@query("q_g02_annual_sales", f"WITH {OBS}, {ANNUAL} SELECT product, year, geography, revenue_scope, value, input_ids FROM annual")
def g02(spark: SparkSession, d: str) -> DataFrame:
    return A.annual_sales(observations(spark, d)).select("product", "year", "geography", "revenue_scope", "value", "input_ids")


_PEAKS = (
    f"w AS (SELECT a.*, CAST(year AS INT) AS y, lead(value, 1) OVER o AS v1, lead(value, 2) OVER o AS v2 FROM annual a WINDOW o AS (PARTITION BY product, {SCOPE} ORDER BY CAST(year AS INT))), "
    f"g AS (SELECT product, {SCOPE}, count(*) AS n, min(y) AS lo, max(y) AS hi, arg_max(y, (value, -y)) AS py, max(value) AS pv, arg_max(coalesce(v1 < value AND v2 < value, false), (value, -y)) AS ok, "
    f"arg_max(input_ids, (value, -y)) AS ids FROM w GROUP BY product, {SCOPE}), "
    "p AS (SELECT g.*, CASE WHEN n < 3 THEN 'insufficient_annual_history' WHEN hi - lo + 1 <> n THEN 'annual_history_has_gaps' "
    "WHEN l.launch_year IS NOT NULL AND lo > l.launch_year THEN 'history_begins_after_launch' WHEN l.launch_year IS NULL AND py = lo THEN 'series_begins_at_its_maximum' WHEN NOT ok THEN 'peak_not_yet_observed' END AS reason "
    "FROM g LEFT JOIN launches l ON g.product = l.product)"
)


@query(
    "q_w05_mature_peak",
    f"WITH {OBS}, {LAUNCHES}, {ANNUAL}, {_PEAKS} SELECT product, geography, revenue_scope, n, CASE WHEN reason IS NULL THEN py END AS peak_year, CASE WHEN reason IS NULL THEN pv END AS value, CASE WHEN reason IS NULL THEN ids END AS input_ids, reason FROM p",
)
def w05(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    p = A.partition_peaks(A.annual_sales(o), launches(spark, d))
    return p.select("product", "geography", "revenue_scope", "n", "peak_year", "value", "input_ids", "reason")


@query(
    "q_w09_partitions",
    f"WITH {OBS}, {ANNUAL}, g AS (SELECT product, {SCOPE}, count(*) AS n FROM annual GROUP BY ALL) SELECT product, geography, revenue_scope, n, "
    "row_number() OVER (PARTITION BY product ORDER BY n DESC, currency, geography, revenue_scope, period_basis, formulation_scope NULLS FIRST) AS place FROM g",
)
def w09(spark: SparkSession, d: str) -> DataFrame:
    g = A.annual_sales(observations(spark, d)).groupBy("product", *SCOPE_KEY).agg(F.count("*").alias("n"))
    w = Window.partitionBy("product").orderBy(F.desc("n"), *[F.col(c).asc_nulls_first() for c in SCOPE_KEY])
    return g.select("product", "geography", "revenue_scope", "n", F.row_number().over(w).alias("place"))


_CHOSEN = (
    f"{_PEAKS}, r AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY n DESC, {', '.join(c + ' NULLS FIRST' for c in SCOPE_KEY)}) AS i FROM p), "
    "o AS (SELECT product, min(reason) FILTER (i = 1) AS first_reason, arg_min(pv, i) FILTER (reason IS NULL) AS ov, arg_min(ids, i) FILTER (reason IS NULL) AS oi, arg_min(geography, i) FILTER (reason IS NULL) AS og, "
    "arg_min(revenue_scope, i) FILTER (reason IS NULL) AS os, arg_min(currency, i) FILTER (reason IS NULL) AS oc, arg_min(coalesce(formulation_scope, '~'), i) FILTER (reason IS NULL) AS of FROM r GROUP BY product), "
    f"now AS (SELECT * FROM estimates WHERE date_diff('day', as_of_date, DATE '{AS_OF}') BETWEEN 0 AND 365), "
    "e AS (SELECT product, count(*) FILTER (estimate_type = 'consensus') AS nc, count(DISTINCT (currency, geography, revenue_scope, coalesce(formulation_scope, '~'))) FILTER (estimate_type = 'consensus') AS scopes, "
    "median(value) FILTER (estimate_type = 'consensus') AS med, list(id ORDER BY id) FILTER (estimate_type = 'consensus') AS cids, arg_max(value, (as_of_date, -id)) FILTER (estimate_type = 'modeled') AS mv, "
    "arg_max(id, (as_of_date, -id)) FILTER (estimate_type = 'modeled') AS mid FROM now GROUP BY product), "
    "chosen AS (SELECT t.product, CASE WHEN ov IS NOT NULL THEN 'observed' WHEN nc > 0 AND scopes = 1 THEN 'consensus' WHEN mid IS NOT NULL THEN 'modeled' END AS estimate_type, "
    "CASE WHEN ov IS NOT NULL THEN ov WHEN nc > 0 AND scopes = 1 THEN med ELSE mv END AS value, CASE WHEN ov IS NOT NULL THEN oi WHEN nc > 0 AND scopes = 1 THEN cids WHEN mid IS NOT NULL THEN [mid] END AS input_ids, "
    "CASE WHEN ov IS NOT NULL OR (nc > 0 AND scopes = 1) OR mid IS NOT NULL THEN NULL WHEN first_reason IS NOT NULL THEN first_reason WHEN scopes > 1 THEN 'consensus_estimates_disagree_on_scope' ELSE 'no_current_peak_estimate' END AS reason, "
    "og, os, oc, nullif(of, '~') AS of FROM (SELECT DISTINCT product FROM obs) t LEFT JOIN o USING (product) LEFT JOIN e USING (product))"
)


def chosen_peaks(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    peaks = A.partition_peaks(A.annual_sales(o), launches(spark, d))
    return A.select_peak(peaks, estimates(spark, d), o.select("product").distinct(), AS_OF)


@query("q_c01_select_peak", f"WITH {OBS}, {LAUNCHES}, {ESTIMATES}, {ANNUAL}, {_CHOSEN} SELECT product, estimate_type, value, input_ids, reason FROM chosen")
def c01(spark: SparkSession, d: str) -> DataFrame:
    return chosen_peaks(spark, d).select("product", "estimate_type", "value", "input_ids", "reason")


def _peaks_for_uptake(spark: SparkSession, d: str) -> DataFrame:
    return chosen_peaks(spark, d).withColumnsRenamed({"value": "peak_value", "reason": "peak_reason", "estimate_type": "peak_type"}).drop("input_ids")


_UPTAKE = (
    f"qb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product, period, {SCOPE} ORDER BY confidence DESC NULLS LAST, id) AS rn FROM obs WHERE period_type = 'quarterly') WHERE rn = 1), "
    "u AS (SELECT b.*, c.value AS peak, c.reason AS preason, l.launch_date, coalesce(c.value > 0, false) AND c.reason IS NULL AS usable, "
    "coalesce(c.value > 0, false) AND c.reason IS NULL AND coalesce(b.currency = c.oc AND b.revenue_scope = c.os AND lower(b.geography) = lower(c.og) AND b.formulation_scope IS NOT DISTINCT FROM c.of, false) AS hit "
    "FROM qb b LEFT JOIN chosen c USING (product) LEFT JOIN launches l USING (product)), "
    "pp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product, period ORDER BY hit DESC, id DESC) AS r2 FROM u) WHERE r2 = 1), "
    "ww AS (SELECT *, row_number() OVER o AS pos, q - lag(q, 3) OVER o AS span, sum(CAST(value AS DECIMAL(24,6))) OVER (o ROWS 3 PRECEDING) AS s, list(id) OVER (o ROWS 3 PRECEDING) AS ids FROM pp WINDOW o AS (PARTITION BY product, hit ORDER BY q)), "
    "xx AS (SELECT *, CASE WHEN launch_date IS NULL THEN 'missing_launch_anchor' WHEN NOT usable THEN 'missing_selected_peak' WHEN NOT hit THEN 'incompatible_sales_scope' WHEN pos < 4 THEN 'insufficient_history' WHEN span <> 3 THEN 'nonconsecutive_quarters' END AS reason2 FROM ww)"
)


@query(
    "q_c02_uptake",
    f"WITH {OBS}, {LAUNCHES}, {ESTIMATES}, {ANNUAL}, {_CHOSEN}, {_UPTAKE} SELECT product, period, CASE WHEN reason2 IS NULL THEN CAST(s AS DOUBLE) / peak END AS value, CASE WHEN reason2 IS NULL THEN CAST(s AS DOUBLE) END AS numerator, "
    "CASE WHEN usable THEN peak END AS denominator, CASE WHEN hit THEN (year(period_end) - year(launch_date)) * 12 + month(period_end) - month(launch_date) END AS months_since_launch, reason2 AS reason, CASE WHEN reason2 IS NULL THEN ids END AS input_ids FROM xx",
)
def c02(spark: SparkSession, d: str) -> DataFrame:
    return A.uptake(observations(spark, d), _peaks_for_uptake(spark, d), launches(spark, d))


@query(
    "q_c03_time_to_threshold",
    f"WITH {OBS}, {LAUNCHES}, {ESTIMATES}, {ANNUAL}, {_CHOSEN}, sc AS (SELECT b.*, c.value AS peak, c.value * 0.9 AS bar, l.launch_date FROM obs b JOIN chosen c USING (product) JOIN launches l USING (product) "
    "WHERE coalesce(b.currency = c.oc AND b.revenue_scope = c.os AND lower(b.geography) = lower(c.og) AND b.formulation_scope IS NOT DISTINCT FROM c.of, false)), "
    f"dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product, period, {SCOPE} ORDER BY confidence DESC NULLS LAST, id) AS rn FROM sc WHERE period_end >= launch_date) WHERE rn = 1), "
    "cand AS (SELECT product, period_end, period FROM (SELECT *, q - lag(q, 3) OVER o AS span, CAST(sum(CAST(value AS DECIMAL(24,6))) OVER (o ROWS 3 PRECEDING) AS DOUBLE) AS v FROM dd WHERE period_type = 'quarterly' WINDOW o AS (PARTITION BY product ORDER BY period)) WHERE span = 3 AND v >= bar "
    "UNION ALL SELECT product, period_end, period FROM dd WHERE period_type = 'annual' AND value >= bar), h AS (SELECT product, min((period_end, period)) AS m FROM cand GROUP BY 1), "
    "f AS (SELECT product, count(*) AS n, count(*) FILTER (period_end >= launch_date) AS nd FROM sc GROUP BY 1), "
    "z AS (SELECT c.product, c.value * 0.9 AS threshold, l.launch_date, h.m, CASE WHEN c.value IS NULL OR c.reason IS NOT NULL THEN 'missing_selected_peak' WHEN c.estimate_type <> 'observed' THEN 'peak_is_not_observed' WHEN f.n IS NULL THEN 'incompatible_sales_scope' "
    "WHEN nd = 0 THEN 'undated_observations' WHEN h.m IS NULL THEN 'threshold_not_reached' END AS reason FROM chosen c JOIN launches l USING (product) LEFT JOIN f USING (product) LEFT JOIN h USING (product)) "
    "SELECT product, CASE WHEN reason IS NULL THEN (year(m[1]) - year(launch_date)) * 12 + month(m[1]) - month(launch_date) END AS months_since_launch, CASE WHEN reason IS NULL THEN m[2] END AS period, threshold, reason FROM z",
)
def c03(spark: SparkSession, d: str) -> DataFrame:
    return A.time_to_threshold(observations(spark, d), _peaks_for_uptake(spark, d), launches(spark, d))


@query(
    "q_w01_rolling_four",
    f"WITH {CELLS}, r AS (SELECT series, q, count(*) OVER w AS n, CAST(sum(CAST(value AS DECIMAL(24,6))) OVER w AS DOUBLE) AS r4q FROM cells WINDOW w AS (PARTITION BY series ORDER BY q RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)) SELECT series, q, r4q FROM r WHERE n = 4",
)
def w01(spark: SparkSession, d: str) -> DataFrame:
    return A.rolling_four(cells(spark, d), ["series"])


_ROLLED = f"{CELLS}, r AS (SELECT series, q, count(*) OVER w AS n, CAST(sum(CAST(value AS DECIMAL(24,6))) OVER w AS DOUBLE) AS r4q FROM cells WINDOW w AS (PARTITION BY series ORDER BY q RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)), full4 AS (SELECT * FROM r WHERE n = 4)"
_ROLLPEAK = (
    f"{_ROLLED}, b AS (SELECT series, arg_max(q, (r4q, -q)) AS peak_q, max(r4q) AS r4q FROM full4 GROUP BY 1), e AS (SELECT series, min(q) AS fq, max(q) AS lq, count(*) AS held FROM cells GROUP BY 1), "
    "rp AS (SELECT e.series, peak_q, r4q, lq - peak_q AS quarters_after, lq - fq + 1 - held AS missing, CASE WHEN r4q IS NULL THEN 'no_full_window' WHEN lq - peak_q < 2 THEN 'not_yet_observed' ELSE 'observed' END AS status FROM e LEFT JOIN b USING (series))"
)


@query("q_w03_rolling_peak", f"WITH {_ROLLPEAK} SELECT * FROM rp")
def w03(spark: SparkSession, d: str) -> DataFrame:
    return A.rolling_peak(cells(spark, d), ["series"])


@query("q_w04_peak_window", f"WITH {_ROLLPEAK} SELECT series, r4q, {LABEL_OF.format('(peak_q - 3)')} || '-' || {LABEL_OF.format('peak_q')} AS span FROM rp WHERE peak_q IS NOT NULL")
def w04(spark: SparkSession, d: str) -> DataFrame:
    p = A.rolling_peak(cells(spark, d), ["series"]).filter("peak_q is not null")
    return p.select("series", "r4q", F.concat(quarter_label(F.col("peak_q") - 3), F.lit("-"), quarter_label(F.col("peak_q"))).alias("span"))


@query("q_w21_benchmark", f"WITH {_ROLLPEAK} SELECT series, round(r4q, 1) AS benchmark, {LABEL_OF.format('peak_q')} AS label FROM rp WHERE peak_q IS NOT NULL")
def w21(spark: SparkSession, d: str) -> DataFrame:
    p = A.rolling_peak(cells(spark, d), ["series"]).filter("peak_q is not null")
    return p.select("series", F.round("r4q", 1).alias("benchmark"), quarter_label(F.col("peak_q")).alias("label"))


_YEARS = f"{CELLS}, yt AS (SELECT series, CAST(floor(q / 4) AS INT) AS y, CAST(sum(CAST(value AS DECIMAL(24,6))) AS DOUBLE) AS value, list(id ORDER BY q) AS input_ids FROM cells GROUP BY 1, 2 HAVING count(DISTINCT q) = 4)"


def year_totals(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    g = c.groupBy("series", F.floor(F.col("q") / 4).cast("int").alias("y")).agg(F.count("*").alias("n"), A.money_sum("value").alias("value"), F.array_sort(F.collect_list(F.struct("q", "id"))).alias("i"))
    return g.filter("n = 4").select("series", "y", "value", F.transform("i", lambda x: x["id"]).alias("input_ids"))


@query("q_g03_full_year_totals", f"WITH {_YEARS} SELECT * FROM yt")
def g03(spark: SparkSession, d: str) -> DataFrame:
    return year_totals(spark, d)


@query(
    "q_w06_observed_peak_all_lower",
    f"WITH {_YEARS}, a AS (SELECT *, max(value) OVER (PARTITION BY series ORDER BY y ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later, count(value) OVER (PARTITION BY series ORDER BY y ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nl, "
    "lag(y) OVER (PARTITION BY series ORDER BY y) AS py, lead(y) OVER (PARTITION BY series ORDER BY y) AS ny, max(value) OVER (PARTITION BY series) AS top FROM yt), "
    "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY y) AS rn FROM a WHERE value = top) WHERE rn = 1) "
    "SELECT series, y AS year, value, CASE WHEN nl < 2 OR later >= value THEN 'not_yet_observed' WHEN coalesce(y - py, 1) <> 1 OR coalesce(ny - y, 1) <> 1 THEN 'year_missing_beside_maximum' ELSE 'observed' END AS status FROM f",
)
def w06(spark: SparkSession, d: str) -> DataFrame:
    return A.annual_peak_all_lower(year_totals(spark, d), ["series"])


_GAPS = f"{CELLS}, sp AS (SELECT series, min(q) AS lo, max(q) AS hi, count(*) AS held FROM cells GROUP BY 1), gaps AS (SELECT g.series, g.q FROM (SELECT series, unnest(range(lo, hi + 1)) AS q FROM sp) g ANTI JOIN cells c ON g.series = c.series AND g.q = c.q)"


def _gaps(c: DataFrame) -> DataFrame:
    w = Window.partitionBy("series").orderBy("q")
    n = c.select("series", "q", F.lead("q").over(w).alias("n"))
    return n.filter("n > q + 1").select("series", F.explode(F.sequence(F.col("q") + 1, F.col("n") - 1)).alias("q"))


@query("q_w14_gap_fill", f"WITH {_GAPS} SELECT series, {LABEL_OF.format('q')} AS period FROM gaps")
def w14(spark: SparkSession, d: str) -> DataFrame:
    return _gaps(cells(spark, d)).select("series", quarter_label(F.col("q")).alias("period"))


@query(
    "q_g17_coverage",
    f"WITH {_GAPS}, m AS (SELECT series, list({LABEL_OF.format('q')} ORDER BY q) AS missing FROM gaps GROUP BY 1) SELECT series, hi - lo + 1 AS expected, held AS observed, round(100.0 * held / (hi - lo + 1), 1) AS coverage_pct, coalesce(missing, []) AS missing, held >= 12 AND held = hi - lo + 1 AS eligible FROM sp LEFT JOIN m USING (series)",
)
def g17(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    m = _gaps(c).groupBy("series").agg(F.transform(F.array_sort(F.collect_list("q")), lambda x: quarter_label(x)).alias("missing"))
    s = c.groupBy("series").agg(F.min("q").alias("lo"), F.max("q").alias("hi"), F.count("*").alias("observed"))
    s = s.withColumn("expected", F.col("hi") - F.col("lo") + 1).join(m, "series", "left")
    return s.select("series", "expected", "observed", F.round(F.lit(100.0) * F.col("observed") / F.col("expected"), 1).alias("coverage_pct"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"), ((F.col("observed") >= 12) & (F.col("observed") == F.col("expected"))).alias("eligible"))


@query(
    "q_w17_launch_gap_review",
    f"WITH {CELLS}, {LAUNCHES}, s AS (SELECT series, any_value(product) AS product, min(q) AS fq FROM cells GROUP BY 1), g AS (SELECT series, fq - (year(launch_date) * 4 + quarter(launch_date) - 1) AS gap FROM s JOIN launches USING (product)) "
    "SELECT series, gap, CASE WHEN gap IS NULL THEN 'no_launch_date' WHEN gap <= 0 THEN 'none' WHEN gap <= 4 THEN 'small' WHEN gap <= 8 THEN 'moderate' ELSE 'large' END AS band FROM g",
)
def w17(spark: SparkSession, d: str) -> DataFrame:
    s = cells(spark, d).groupBy("series").agg(F.min("product").alias("product"), F.min("q").alias("fq")).join(launches(spark, d), "product")
    gap = F.col("fq") - (F.year("launch_date") * 4 + F.quarter("launch_date") - 1)
    band = F.when(gap.isNull(), "no_launch_date").when(gap <= 0, "none").when(gap <= 4, "small").when(gap <= 8, "moderate").otherwise("large")
    return s.select("series", gap.alias("gap"), band.alias("band"))


@query("q_w15_commercial_start", f"WITH {CELLS}, {LAUNCHES}, s AS (SELECT c.product, min(c.q) AS q FROM cells c JOIN launches l USING (product) WHERE l.launch_date IS NOT NULL AND make_date(CAST(floor(c.q / 4) AS INT), (c.q % 4) * 3 + 1, 1) >= l.launch_date GROUP BY 1) SELECT product, {LABEL_OF.format('q')} AS commercial_start FROM s")
def w15(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).join(launches(spark, d).filter("launch_date is not null"), "product")
    first_day = F.make_date(F.floor(F.col("q") / 4).cast("int"), (F.col("q") % 4) * 3 + 1, F.lit(1))
    return c.filter(first_day >= F.col("launch_date")).groupBy("product").agg(F.min("q").alias("q")).select("product", quarter_label(F.col("q")).alias("commercial_start"))


_STATED = "st AS (SELECT series, CAST(substr(period, 1, 4) AS INT) AS y, arg_max(value, (reported_at, id)) AS stated FROM obs WHERE period_type = 'annual' GROUP BY 1, 2)"


@query("q_g22_year_reconciliation", f"WITH {_YEARS}, {_STATED} SELECT series, y AS year, value AS summed, stated, abs(value - stated) AS gap FROM yt JOIN st USING (series, y) WHERE abs(value - stated) > 2.5")
def g22(spark: SparkSession, d: str) -> DataFrame:
    stated = observations(spark, d).filter("period_type = 'annual'").groupBy("series", F.substring("period", 1, 4).cast("int").alias("y")).agg(F.max(F.struct("reported_at", "id", "value")).alias("b"))
    j = year_totals(spark, d).join(stated.select("series", "y", F.col("b.value").alias("stated")), ["series", "y"])
    gap = F.abs(F.col("value") - F.col("stated"))
    return j.filter(gap > 2.5).select("series", F.col("y").alias("year"), F.col("value").alias("summed"), "stated", gap.alias("gap"))


@query("q_g23_series_consistency", f"WITH {OBS} SELECT product AS line, count(DISTINCT currency) AS currencies, count(DISTINCT geography) AS geographies, count(DISTINCT revenue_scope) AS scopes FROM obs GROUP BY 1 HAVING count(DISTINCT currency) > 1 OR count(DISTINCT geography) > 1 OR count(DISTINCT revenue_scope) > 1")
def g23(spark: SparkSession, d: str) -> DataFrame:
    """Lines that mix currencies, geographies or scopes; taken by product, since the stored series are uniform."""
    g = observations(spark, d).groupBy(F.col("product").alias("line")).agg(F.count_distinct("currency").alias("currencies"), F.count_distinct("geography").alias("geographies"), F.count_distinct("revenue_scope").alias("scopes"))
    return g.filter("currencies > 1 or geographies > 1 or scopes > 1")


_BENCH = f"{_ROLLPEAK}, {ESTIMATES}, ue AS (SELECT product, median(value) AS est FROM estimates WHERE estimate_type IN ('consensus', 'modeled') AND currency = 'USD' GROUP BY 1), sp2 AS (SELECT series, any_value(product) AS product FROM cells GROUP BY 1)"


@query("q_c41_benchmark_choice", f"WITH {_BENCH} SELECT series, CASE WHEN r4q IS NULL AND est IS NULL THEN NULL WHEN est IS NULL OR r4q >= est THEN r4q ELSE est END AS benchmark, CASE WHEN r4q IS NULL AND est IS NULL THEN 'none' WHEN est IS NULL OR r4q >= est THEN 'observed_r4q' ELSE 'median_estimate' END AS basis FROM rp JOIN sp2 USING (series) LEFT JOIN ue USING (product)")
def c41(spark: SparkSession, d: str) -> DataFrame:
    est = estimates(spark, d).filter("estimate_type in ('consensus', 'modeled') and currency = 'USD'").groupBy("product").agg(F.expr("percentile(value, 0.5)").alias("est"))
    c = cells(spark, d)
    p = A.rolling_peak(c, ["series"]).join(c.groupBy("series").agg(F.min("product").alias("product")), "series").join(est, "product", "left")
    own = F.col("est").isNull() | F.coalesce(F.col("r4q") >= F.col("est"), F.lit(False))
    none = F.col("r4q").isNull() & F.col("est").isNull()
    return p.select("series", F.when(none, None).when(own, F.col("r4q")).otherwise(F.col("est")).alias("benchmark"), F.when(none, "none").when(own, "observed_r4q").otherwise("median_estimate").alias("basis"))


@query(
    "q_c42_peak_status",
    f"WITH {_ROLLPEAK}, sr AS (SELECT series, bool_or(source_type = 'investor_presentation') AS restricted FROM obs GROUP BY 1) SELECT series, CASE WHEN restricted AND r4q IS NULL THEN 'restricted' WHEN r4q IS NULL THEN 'not_judged' WHEN missing > 0 AND quarters_after < 2 THEN 'gap_near_end' WHEN quarters_after < 2 THEN 'not_yet_observed' ELSE 'observed' END AS status FROM rp JOIN sr USING (series)",
)
def c42(spark: SparkSession, d: str) -> DataFrame:
    r = observations(spark, d).groupBy("series").agg(F.bool_or(F.col("source_type") == "investor_presentation").alias("restricted"))
    p = A.rolling_peak(cells(spark, d), ["series"]).join(r, "series")
    status = F.when(F.col("restricted") & F.col("r4q").isNull(), "restricted").when(F.col("r4q").isNull(), "not_judged").when((F.col("missing") > 0) & (F.col("quarters_after") < 2), "gap_near_end").when(F.col("quarters_after") < 2, "not_yet_observed").otherwise("observed")
    return p.select("series", status.alias("status"))


@query(
    "q_c43_uptake_sheet",
    f"WITH {_ROLLPEAK}, x AS (SELECT c.series, c.q, c.q - min(c.q) OVER (PARTITION BY c.series) AS n, value, r4q, peak_q, status FROM cells c JOIN rp USING (series) WHERE r4q > 0) "
    "SELECT series, q, 'Year ' || CAST(floor(n / 4) + 1 AS INT) || ' Q' || (n % 4 + 1) AS launch_column, CASE WHEN status = 'observed' AND q > peak_q THEN 1.0 ELSE greatest(0.0, least(1.0, value / (r4q / 4))) END AS uptake FROM x",
)
def c43(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    x = c.join(A.rolling_peak(c, ["series"]).filter("r4q > 0"), "series")
    n = F.col("q") - F.min("q").over(Window.partitionBy("series"))
    x = x.withColumn("n", n)
    held = (F.col("status") == "observed") & (F.col("q") > F.col("peak_q"))
    return x.select("series", "q", F.concat(F.lit("Year "), (F.floor(F.col("n") / 4) + 1).cast("string"), F.lit(" Q"), (F.col("n") % 4 + 1).cast("string")).alias("launch_column"), F.when(held, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / (F.col("r4q") / 4)))).alias("uptake"))


@query(
    "q_c40_build_peaks",
    f"WITH {_ROLLPEAK}, yt AS (SELECT series, CAST(floor(q / 4) AS INT) AS y, CAST(sum(CAST(value AS DECIMAL(24,6))) AS DOUBLE) AS value FROM cells GROUP BY 1, 2 HAVING count(DISTINCT q) = 4), am AS (SELECT series, max(value) AS top, arg_max(y, (value, -y)) AS ty FROM yt GROUP BY 1) "
    f"SELECT series, CASE WHEN status = 'observed' THEN 'quarterly' WHEN top IS NOT NULL THEN 'annual' ELSE 'none' END AS basis, CASE WHEN status = 'observed' THEN r4q ELSE top END AS value, CASE WHEN status = 'observed' THEN {LABEL_OF.format('peak_q')} WHEN ty IS NOT NULL THEN CAST(ty AS VARCHAR) END AS at FROM rp LEFT JOIN am USING (series)",
)
def c40(spark: SparkSession, d: str) -> DataFrame:
    top = year_totals(spark, d).groupBy("series").agg(F.max(F.struct("value", (-F.col("y")).alias("ny"))).alias("t"))
    p = A.rolling_peak(cells(spark, d), ["series"]).join(top, "series", "left")
    own = F.col("status") == "observed"
    return p.select("series", F.when(own, "quarterly").when(F.col("t").isNotNull(), "annual").otherwise("none").alias("basis"), F.when(own, F.col("r4q")).otherwise(F.col("t.value")).alias("value"), F.when(own, quarter_label(F.col("peak_q"))).otherwise((-F.col("t.ny")).cast("string")).alias("at"))


@query(
    "q_b10_launch_aligned",
    f"WITH {CELLS}, {LAUNCHES}, k AS (SELECT *, coalesce(product, series, '') AS key FROM cells), f AS (SELECT key, min(q) AS first FROM k GROUP BY 1), l AS (SELECT product AS key, year(launch_date) * 4 + quarter(launch_date) - 1 AS launch FROM launches), "
    "x AS (SELECT k.series, value, q - coalesce(launch, first) AS n, launch IS NOT NULL AS stated FROM k JOIN f USING (key) LEFT JOIN l USING (key)) "
    "SELECT series, n, 'Year ' || CAST(floor(n / 4) + 1 AS BIGINT) || ' Q' || ((n % 4 + 4) % 4 + 1) AS launch_column, stated, value FROM x",
)
def b10(spark: SparkSession, d: str) -> DataFrame:
    """Every cell by its offset from the launch, in long form, so that no history is too long.

    The anchor is the stated launch quarter, else the product's first reported quarter; ``stated`` says which.
    """
    c = cells(spark, d).withColumn("key", F.coalesce("product", "series", F.lit("")))  # a series without a product stands for itself
    stated = launches(spark, d).select(F.col("product").alias("key"), (F.year("launch_date") * 4 + F.quarter("launch_date") - 1).alias("launch"))
    anchors = c.groupBy("key").agg(F.min("q").alias("first")).join(stated, "key", "left")
    x = c.join(anchors, "key").withColumn("n", F.col("q") - F.coalesce("launch", "first"))
    label = F.concat(F.lit("Year "), (F.floor(F.col("n") / 4) + 1).cast("string"), F.lit(" Q"), (F.pmod("n", F.lit(4)) + 1).cast("string"))
    return x.select("series", "n", label.alias("launch_column"), F.col("launch").isNotNull().alias("stated"), "value")


@query("q_b09_quarter_matrix", f"WITH {CELLS} SELECT series, {LABEL_OF.format('q')} AS quarter, value FROM cells")
def b09(spark: SparkSession, d: str) -> DataFrame:
    """Every cell of the series x calendar-quarter matrix in long form, so that no period is left out; a blank is no row."""
    return cells(spark, d).select("series", quarter_label(F.col("q")).alias("quarter"), "value")


_ONE = (
    "ranked AS (SELECT product, period, id, value, revenue_scope, reported_at, list_position(['Product family', 'Formulation-specific', 'U.S.', 'ex-U.S.', 'Worldwide', 'Regional', 'Unknown'], revenue_scope) AS sr FROM obs WHERE period_type = 'quarterly' AND status IN ('auto_pass', 'confirmed')), "
    "bestscope AS (SELECT product, min(sr) AS sr FROM ranked GROUP BY 1), kept AS (SELECT ranked.* FROM ranked JOIN bestscope USING (product, sr)), "
    "onefig AS (SELECT product, period, count(*) AS n, count(DISTINCT value) AS figures, max(value) AS top FROM kept GROUP BY 1, 2)"
)


def one_figure_per_period(o: DataFrame) -> DataFrame:
    """Per product the best scope's figures; a period with several different ones is contested and has none."""
    order = ["Product family", "Formulation-specific", "U.S.", "ex-U.S.", "Worldwide", "Regional", "Unknown"]
    r = o.filter("period_type = 'quarterly' and status in ('auto_pass', 'confirmed')").withColumn("sr", F.array_position(F.array(*[F.lit(s) for s in order]), F.col("revenue_scope")))
    best = r.groupBy("product").agg(F.min("sr").alias("sr"))
    g = r.join(best, ["product", "sr"]).groupBy("product", "period").agg(F.count("*").alias("n"), F.count_distinct("value").alias("figures"), F.max("value").alias("top"))
    state = F.when(F.col("n") == 1, "single").when(F.col("figures") == 1, "equal").otherwise("contested")
    return g.select("product", "period", state.alias("state"), F.when(F.col("figures") == 1, F.col("top")).alias("value"))


@query("q_w20_one_figure_per_period", f"WITH {OBS}, {_ONE} SELECT product, period, CASE WHEN n = 1 THEN 'single' WHEN figures = 1 THEN 'equal' ELSE 'contested' END AS state, CASE WHEN figures = 1 THEN top END AS value FROM onefig")
def w20(spark: SparkSession, d: str) -> DataFrame:
    return one_figure_per_period(observations(spark, d))


@query("q_c45_chart_series", f"WITH {OBS}, {_ONE} SELECT period, count(*) FILTER (figures = 1) AS products, count(*) FILTER (figures > 1) AS holes, CAST(sum(CAST(top AS DECIMAL(24,6))) FILTER (figures = 1) AS DOUBLE) AS total FROM onefig GROUP BY 1")
def c45(spark: SparkSession, d: str) -> DataFrame:
    one = one_figure_per_period(observations(spark, d))
    return one.groupBy("period").agg(F.count("value").alias("products"), F.count_if(F.col("value").isNull()).alias("holes"), A.money_sum("value").alias("total"))


@query("q_u03_annual_union", f"WITH {OBS}, {ANNUAL} SELECT product, year, count(*) AS series, CAST(sum(CAST(value AS DECIMAL(24,6))) AS DOUBLE) AS total FROM annual GROUP BY 1, 2")
def u03(spark: SparkSession, d: str) -> DataFrame:
    return A.annual_sales(observations(spark, d)).groupBy("product", "year").agg(F.count("*").alias("series"), A.money_sum("value").alias("total"))
