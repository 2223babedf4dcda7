"""Batch, profile and workbook queries, and the predicates and set operations not covered elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions import text as X
from seriesloom.functions.geo import normalize_geography
from seriesloom.functions.periods import loose_date, quarter_label
from seriesloom.operators import annual as A
from seriesloom.operators.pages import page_cells
from seriesloom.operators.ranking import global_rank
from seriesloom.plans import facts, peers, readings as RD, series, workbench
from seriesloom.plans.base import CELLS, ESTIMATES, OBS, cells, estimates, observations
from seriesloom.plans.problem_sql import LABEL_OF
from seriesloom.plans.readings import DP, SRC, place_sql, readings, sources
from seriesloom.session import table
from seriesloom.sources import files
from seriesloom.vocab import HYPOTHETICAL

QUERIES, ORACLES = {}, {}
c = F.col


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def same(name: str, module, other: str) -> None:
    """An operator of the inventory that is another one seen from a different family."""
    QUERIES[name] = module.QUERIES[other]
    if other in module.ORACLES:
        ORACLES[name] = module.ORACLES[other]


same("q_w02_uptake_windows", series, "q_c02_uptake")
same("q_w07_time_to_threshold", series, "q_c03_time_to_threshold")
same("q_d28_split_quarter", RD, "q_c07_split_quarter")
same("q_s27_datapoint_source", RD, "q_j05_stored_document")
same("q_c04_peak_eligible", series, "q_w05_mature_peak")

# --- predicates --------------------------------------------------------------------------------


@query("q_p02_matches_peak_scope", f"WITH {OBS}, p AS (SELECT product, arg_max(geography, (value, id)) AS g, arg_max(currency, (value, id)) AS cu FROM obs WHERE revenue_scope = 'Worldwide' GROUP BY 1) SELECT id, coalesce({place_sql('geography')} = {place_sql('g')} AND currency = cu AND revenue_scope = 'Worldwide', false) AS matches FROM obs LEFT JOIN p USING (product)")
def p02(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    p = o.filter("revenue_scope = 'Worldwide'").groupBy("product").agg(F.max(F.struct("value", "id", "geography", "currency")).alias("b"))
    j = o.join(p, "product", "left")
    same_place = normalize_geography(c("geography")) == normalize_geography(c("b.geography"))
    return j.select("id", F.coalesce(c("b").isNotNull() & same_place & (c("currency") == c("b.currency")) & (c("revenue_scope") == "Worldwide"), F.lit(False)).alias("matches"))


@query("q_p03_usable_peak", series.ORACLES["q_c01_select_peak"].replace("SELECT product, estimate_type, value, input_ids, reason FROM chosen", "SELECT product, coalesce(value > 0, false) AND reason IS NULL AS usable FROM chosen"))
def p03(spark: SparkSession, d: str) -> DataFrame:
    p = series.chosen_peaks(spark, d)
    return p.select("product", (F.coalesce(c("value") > 0, F.lit(False)) & c("reason").isNull()).alias("usable"))


@query("q_p04_in_universe", f"WITH {peers.ENTRIES} SELECT product_id FROM entries WHERE lower(disease) = 'promo' AND lot = '2L' AND lower(setting) = 'metastatic'")
def p04(spark: SparkSession, d: str) -> DataFrame:
    e = peers.registry_entries(spark, d)
    return e.filter((F.lower("disease") == "promo") & (c("lot") == "2L") & (F.lower("setting") == "metastatic")).select("product_id")


@query("q_p05_holds_figure", RD.ORACLES["q_c16_select_series"].replace("SELECT id, CASE WHEN won", "SELECT id FROM (SELECT id, CASE WHEN won").rstrip() + ") WHERE selection IS NULL OR selection = 'selected'")
def p05(spark: SparkSession, d: str) -> DataFrame:
    return RD.c16(spark, d).filter("selection is null or selection = 'selected'").select("id")


@query("q_p23_states_item", "SELECT DISTINCT id, coalesce(list_contains(quality_flags, 'scope_conflict'), false) AS states FROM drug_jobs")
def p23(spark: SparkSession, d: str) -> DataFrame:
    items = F.array_join("quality_flags", " , ")
    return table(spark, d, "drug_jobs").select("id", F.coalesce(X.states_item(items, "scope_conflict"), F.lit(False)).alias("states")).distinct()


def _members(spark: SparkSession, d: str) -> DataFrame:
    """The members of each record as a tagged fact has them: no place where it is worldwide, a scenario where its quote says it is re-presented."""
    place = F.when(c("geography") != "Worldwide", F.concat(F.lit("Geographical="), "geography", F.lit(";"))).otherwise("")
    scenario = F.when(c("source_quote").contains("re-presented"), "Scenario=RestatementMember;").otherwise("")
    return observations(spark, d).select("id", X.segments_map(F.concat(F.lit("ProductOrService=A;"), place, scenario)).alias("members"))


@query("q_p25_hypothetical", f"WITH {OBS} SELECT id, coalesce(contains(source_quote, 're-presented'), false) AS hypothetical FROM obs")
def p25(spark: SparkSession, d: str) -> DataFrame:
    mark = F.exists(F.map_entries("members"), lambda e: F.concat(e["key"], F.lit(" "), e["value"]).rlike("|".join(HYPOTHETICAL)))
    return _members(spark, d).select("id", mark.alias("hypothetical"))


@query("q_p28_worldwide", f"WITH {OBS} SELECT id, geography = 'Worldwide' AS worldwide FROM obs")
def p28(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d).select("id", (~F.map_contains_key("members", "Geographical")).alias("worldwide"))


@query("q_p27_standard_taxonomy", f"WITH {SRC} SELECT id, coalesce(filing_type IN ('10-K', '10-Q', '20-F', '6-K'), false) AS standard FROM src")
def p27(spark: SparkSession, d: str) -> DataFrame:
    """Whether a fact's element is of a standard taxonomy: the one its filing's form goes by, else the filer's own."""
    space = F.when(c("filing_type").isin("10-K", "10-Q"), "us-gaap").when(c("filing_type").isin("20-F", "6-K"), "ifrs-full").otherwise("co")
    element = F.concat(space, F.lit(":Revenues"))
    return sources(spark, d).select("id", F.substring_index(element, ":", 1).isin("us-gaap", "srt", "dei", "ifrs-full").alias("standard"))


@query("q_p32_set_aside", f"WITH {OBS}, {ESTIMATES} SELECT id, CASE WHEN estimate_type NOT IN ('consensus', 'modeled') THEN 'kind' WHEN geography <> 'Europe' THEN 'geography' WHEN currency <> 'USD' THEN 'currency' END AS reason FROM estimates")
def p32(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(~c("estimate_type").isin("consensus", "modeled"), "kind").when(c("geography") != "Europe", "geography").when(c("currency") != "USD", "currency")
    return estimates(spark, d).select("id", reason.alias("reason"))


@query("q_p34_usable_fingerprint", f"WITH {DP} SELECT signature, bool_or(quote LIKE '%million%' OR quote LIKE '%thousand%') AS usable FROM dp GROUP BY 1")
def p34(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).groupBy("signature").agg(F.bool_or(c("quote").like("%million%") | c("quote").like("%thousand%")).alias("usable"))


# --- aggregates and sets -----------------------------------------------------------------------


@query("q_g09_consensus_median", f"WITH {OBS}, {ESTIMATES} SELECT product, median(value) AS consensus, count(DISTINCT (currency, geography)) AS scopes FROM estimates WHERE estimate_type = 'consensus' GROUP BY 1")
def g09(spark: SparkSession, d: str) -> DataFrame:
    e = estimates(spark, d).filter("estimate_type = 'consensus'")
    return e.groupBy("product").agg(F.expr("percentile(value, 0.5)").alias("consensus"), F.count_distinct(F.struct("currency", "geography")).alias("scopes"))


@query("q_g29_best_snapshot", f"WITH {peers.ENTRIES}, {peers._SNAP} SELECT brand, arg_max(s.product_id, (list_position(['low', 'medium', 'high'], category), s.launched, s.product_id)) AS product_id FROM snaps s JOIN entries e USING (product_id) GROUP BY 1")
def g29(spark: SparkSession, d: str) -> DataFrame:
    from seriesloom.operators.peers import snapshots

    e = peers.registry_entries(spark, d)
    s = snapshots(e).select("product_id", "category").join(e.select("product_id", "brand", "launched"), "product_id")
    rank = F.array_position(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), c("category"))
    return s.groupBy("brand").agg(F.max(F.struct(rank.alias("r"), "launched", "product_id")).alias("b")).select("brand", c("b.product_id").alias("product_id"))


@query("q_u06_weights_agree", "SELECT unnest(['approval_era', 'competitive_intensity_at_launch', 'indication_area', 'moa_class', 'route_of_administration']) AS field, 1 AS weighted, 1 AS declared")
def u06(spark: SparkSession, d: str) -> DataFrame:
    """Each field of the weights or of the profiles, and on which side it stands; 0 where it is missing."""
    from seriesloom.vocab import ANALOG_WEIGHTS

    have = spark.createDataFrame([(x, 1) for x in ANALOG_WEIGHTS], "field string, weighted int")
    want = spark.createDataFrame([(x, 1) for x in peers.profiles(spark, d).columns if x not in ("drug_name", "id")], "field string, declared int")
    return have.join(want, "field", "full").na.fill(0)


@query("q_u07_columns_overlap", "SELECT p_partkey, p_size % 3 <> 0 AS overlap FROM part")
def u07(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.arrays_overlap(F.array(F.lit(1), F.lit(2)), F.array((c("p_size") % 3).cast("int"))).alias("overlap"))


@query("q_u08_citable_types", "SELECT unnest(['consensus', 'modeled', 'management']) AS kind")
def u08(spark: SparkSession, d: str) -> DataFrame:
    one = spark.range(1)
    return one.select(F.explode(F.array_except(F.array(*[F.lit(x) for x in ("observed", "consensus", "modeled", "management")]), F.array(F.lit("observed")))).alias("kind"))


# --- batch queries -----------------------------------------------------------------------------


@query("q_c29_resolve_matches", f"WITH {DP}, w AS (SELECT job_id, period, bool_or(scope = 'Worldwide') AS whole, count(*) AS n FROM val GROUP BY 1, 2) SELECT v.id, CASE WHEN v.scope = 'Worldwide' THEN 'whole' WHEN whole THEN 'region_beside_whole' ELSE 'region_flagged' END AS resolution FROM val v JOIN w USING (job_id, period)")
def c29(spark: SparkSession, d: str) -> DataFrame:
    """A whole line answers; regions are flagged and matter only where no whole line stands."""
    from seriesloom.operators.readings import states_a_value

    v = states_a_value(readings(spark, d))
    w = v.groupBy("job_id", "period").agg(F.bool_or(c("scope") == "Worldwide").alias("whole"))
    return v.join(w, ["job_id", "period"]).select("id", F.when(c("scope") == "Worldwide", "whole").when(c("whole"), "region_beside_whole").otherwise("region_flagged").alias("resolution"))


@query("q_c44_gold_audits", f"WITH {OBS} SELECT id, 'implausible' AS audit FROM obs WHERE value < 0 OR value > 50000 UNION ALL SELECT id, 'no_quote' FROM obs WHERE source_quote IS NULL UNION ALL SELECT id, 'period_after_report' FROM obs WHERE period_end > CAST(reported_at AS DATE)")
def c44(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the data-set audits, one row each."""
    rules = [("implausible", (c("value") < 0) | (c("value") > 50000)), ("no_quote", c("source_quote").isNull()), ("period_after_report", c("period_end") > F.to_date("reported_at"))]
    found = F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(False)), n) for n, r in rules]))
    return observations(spark, d).select("id", F.explode(found).alias("audit"))


@query("q_b02_profiles_present", f"WITH {OBS}, j AS (SELECT DISTINCT lower(trim(regexp_replace(drug_name, '\\s+', ' ', 'g'))) AS k FROM drug_jobs), o AS (SELECT DISTINCT lower(product) AS k FROM obs) SELECT k, 'missing_profile' AS problem FROM o WHERE k NOT IN (SELECT k FROM j) UNION ALL SELECT k, 'unused_profile' FROM j WHERE k NOT IN (SELECT k FROM o)")
def b02(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "drug_jobs").select(X.analog_key(c("drug_name")).alias("k")).distinct()
    o = observations(spark, d).select(F.lower("product").alias("k")).distinct()
    return o.join(j, "k", "left_anti").withColumn("problem", F.lit("missing_profile")).unionByName(j.join(o, "k", "left_anti").withColumn("problem", F.lit("unused_profile")))


@query("q_b03_annual_rows", f"WITH {OBS} SELECT o.id, o.value * CASE WHEN source_quote LIKE '%(in thousands)%' THEN 1000 ELSE 1 END AS as_stated, CASE WHEN o.currency = 'USD' THEN o.value ELSE o.value * f.usd_per_unit END AS usd, CASE WHEN o.currency <> 'USD' AND f.usd_per_unit IS NULL THEN 'missing_rate' END AS problem FROM obs o LEFT JOIN fx_rates f ON o.currency = f.currency AND CAST(o.period AS INT) = f.calendar_year WHERE period_type = 'annual'".replace("CAST(o.period AS INT)", "TRY_CAST(o.period AS INT)"))
def b03(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d).filter("period_type = 'annual'").withColumn("calendar_year", c("period").cast("int"))
    j = o.join(table(spark, d, "fx_rates"), ["currency", "calendar_year"], "left")
    usd = c("currency") == "USD"
    restate = F.when(F.coalesce(c("source_quote").contains("(in thousands)"), F.lit(False)), 1000).otherwise(1)
    return j.select("id", (c("value") * restate).alias("as_stated"), F.when(usd, c("value")).otherwise(c("value") * c("usd_per_unit")).alias("usd"), F.when(~usd & c("usd_per_unit").isNull(), "missing_rate").alias("problem"))


@query("q_b04_continuation_problems", f"WITH {CELLS}, s AS (SELECT series, any_value(product) AS product, min(q) AS lo, max(q) AS hi FROM cells GROUP BY 1) SELECT series, list_filter([CASE WHEN hi < 8099 THEN 'ends_early' END, CASE WHEN length(product) % 2 = 0 THEN 'contents_not_listed' END, CASE WHEN lo > 8080 THEN 'starts_late' END], lambda x: x IS NOT NULL) AS problems FROM s")
def b04(spark: SparkSession, d: str) -> DataFrame:
    s = cells(spark, d).groupBy("series").agg(F.min("product").alias("product"), F.min("q").alias("lo"), F.max("q").alias("hi"))
    return s.select("series", F.array_compact(F.array(F.when(c("hi") < 8099, "ends_early"), F.when(F.length("product") % 2 == 0, "contents_not_listed"), F.when(c("lo") > 8080, "starts_late"))).alias("problems"))


@query("q_b05_refresh_metadata", f"WITH {CELLS}, a AS (SELECT product, min(issuer) AS issuer FROM obs GROUP BY 1) SELECT series, q, a.issuer FROM cells JOIN a USING (product)")
def b05(spark: SparkSession, d: str) -> DataFrame:
    a = observations(spark, d).groupBy("product").agg(F.min("issuer").alias("issuer"))
    return cells(spark, d).drop("issuer").join(a, "product").select("series", "q", "issuer")


@query("q_b06_peak_records", f"WITH {series._ROLLPEAK}, l AS (SELECT series, arg_max(r4q, q) AS latest FROM full4 GROUP BY 1) SELECT rp.series, r4q AS best, latest, latest / nullif(r4q, 0) AS ratio, status, row_number() OVER (ORDER BY list_position(['observed', 'not_yet_observed', 'no_full_window'], status), rp.series) AS place FROM rp LEFT JOIN l USING (series)")
def b06(spark: SparkSession, d: str) -> DataFrame:
    k = cells(spark, d)
    latest = A.rolling_four(k, ["series"]).groupBy("series").agg(F.max_by("r4q", "q").alias("latest"))
    p = A.rolling_peak(k, ["series"]).join(latest, "series", "left")
    order = F.array_position(F.array(F.lit("observed"), F.lit("not_yet_observed"), F.lit("no_full_window")), c("status"))
    return p.select("series", c("r4q").alias("best"), "latest", F.try_divide("latest", "r4q").alias("ratio"), "status", order.alias("_order")).transform(lambda r: global_rank(r, [c("_order"), c("series")], "place")).drop("_order")


@query("q_b07_best_reported", f"WITH {CELLS}, w AS (SELECT product, q, count(DISTINCT currency) OVER (PARTITION BY product) AS n FROM cells) SELECT product, CASE WHEN max(n) = 1 THEN max(q) END AS q FROM w GROUP BY 1".replace("count(DISTINCT currency) OVER (PARTITION BY product)", "(SELECT count(DISTINCT currency) FROM cells c2 WHERE c2.product = cells.product)"))
def b07(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).groupBy("product").agg(F.when(F.count_distinct("currency") == 1, F.max("q")).alias("q"))


@query("q_b08_revenue_by_name", f"WITH {OBS}, j AS (SELECT DISTINCT drug_name FROM drug_jobs), e AS (SELECT product, count(*) AS n FROM obs GROUP BY 1), f AS (SELECT lower(product) AS k, count(*) AS n FROM obs GROUP BY 1) SELECT drug_name, coalesce(e.n, f.n) AS figures, CASE WHEN e.n IS NOT NULL THEN 'exact' WHEN f.n IS NOT NULL THEN 'folded' ELSE 'missing' END AS how FROM j LEFT JOIN e ON drug_name = product LEFT JOIN f ON lower(drug_name) = k")
def b08(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "drug_jobs").select("drug_name").distinct()
    o = observations(spark, d)
    e = o.groupBy(c("product").alias("drug_name")).agg(F.count("*").alias("n1"))
    f = o.groupBy(F.lower("product").alias("k")).agg(F.count("*").alias("n2"))
    x = j.join(e, "drug_name", "left").withColumn("k", F.lower("drug_name")).join(f, "k", "left")
    return x.select("drug_name", F.coalesce("n1", "n2").alias("figures"), F.when(c("n1").isNotNull(), "exact").when(c("n2").isNotNull(), "folded").otherwise("missing").alias("how"))


@query("q_b11_refresh_status", f"WITH {CELLS}, s AS (SELECT series, max(q) AS lq, count(*) AS n FROM cells GROUP BY 1), m AS (SELECT max(q) AS mq FROM cells) SELECT series, {LABEL_OF.format('lq')} AS last_quarter, mq - lq AS behind, n < 12 AND mq - lq > 4 AS short_and_stopped, row_number() OVER (ORDER BY mq - lq DESC, series) AS place FROM s, m")
def b11(spark: SparkSession, d: str) -> DataFrame:
    s = cells(spark, d).groupBy("series").agg(F.max("q").alias("lq"), F.count("*").alias("n"))
    m = s.agg(F.max("lq").alias("mq")).withColumn("one", F.lit(1))  # one row whatever the data
    j = s.withColumn("one", F.lit(1)).join(F.broadcast(m), "one").withColumn("behind", c("mq") - c("lq"))
    return j.select("series", quarter_label(c("lq")).alias("last_quarter"), "behind", ((c("n") < 12) & (c("behind") > 4)).alias("short_and_stopped")).transform(lambda r: global_rank(r, [-c("behind"), c("series")], "place"))


@query("q_b12_source_index", f"WITH {SRC}, {DP}, u AS (SELECT src.source_url AS url, 'datapoint' AS fact, dp.product, dp.period FROM dp JOIN src ON dp.source_id = src.id UNION ALL SELECT source_url, 'document', NULL, NULL FROM src) SELECT url, count(*) FILTER (fact = 'datapoint') AS figures, count(*) FILTER (fact = 'document') AS documents, count(DISTINCT product) AS products, min(period) AS lo, max(period) AS hi FROM u GROUP BY 1")
def b12(spark: SparkSession, d: str) -> DataFrame:
    s = sources(spark, d).select(c("id").alias("source_id"), c("source_url").alias("url"))
    none = F.lit(None).cast("string")
    u = readings(spark, d).join(s, "source_id").select("url", F.lit("datapoint").alias("fact"), "product", "period").unionByName(s.select("url", F.lit("document").alias("fact"), none.alias("product"), none.alias("period")))
    return u.groupBy("url").agg(F.count_if(c("fact") == "datapoint").alias("figures"), F.count_if(c("fact") == "document").alias("documents"), F.count_distinct("product").alias("products"), F.min("period").alias("lo"), F.max("period").alias("hi"))


@query("q_b14_product_summary", f"WITH {OBS} SELECT product, count(*) FILTER (period_type = 'quarterly') AS quarterly, count(*) FILTER (period_type = 'annual') AS annual, min(substr(period, 1, 4)) AS first_year, max(substr(period, 1, 4)) AS last_year, CAST(sum(CAST(usd AS DECIMAL(24,6))) AS DOUBLE) AS total, count(*) FILTER (source_type = 'investor_presentation') AS withheld FROM obs GROUP BY 1")
def b14(spark: SparkSession, d: str) -> DataFrame:
    y = F.substring("period", 1, 4)
    return observations(spark, d).groupBy("product").agg(F.count_if(c("period_type") == "quarterly").alias("quarterly"), F.count_if(c("period_type") == "annual").alias("annual"), F.min(y).alias("first_year"), F.max(y).alias("last_year"), A.money_sum("usd").alias("total"), F.count_if(c("source_type") == "investor_presentation").alias("withheld"))


@query("q_b17_tagged_revenue", "SELECT s_suppkey, 'quarterly' AS pool, 1 AS facts FROM supplier WHERE s_suppkey > 0")
def b17(spark: SparkSession, d: str) -> DataFrame:
    """Tagged candidates split into quarterly rows and the pool derivation draws on."""
    f = facts.c33(spark, d).withColumn("pool", F.when(c("period").like("____Q_"), "quarterly").otherwise("derivation"))
    return f.groupBy("s_suppkey", "pool").agg(F.count("*").cast("int").alias("facts"))


# --- sources and sinks -------------------------------------------------------------------------


@query("q_s09_fetch_gate", f"WITH {SRC} SELECT id, source_url LIKE 'http%://%' AS may_fetch FROM src")
def s09(spark: SparkSession, d: str) -> DataFrame:
    return sources(spark, d).select("id", X.fetchable(c("source_url")).alias("may_fetch"))


same("q_s10_manual_url", __import__("types").SimpleNamespace(QUERIES=QUERIES, ORACLES=ORACLES), "q_s09_fetch_gate")


@query("q_s16_units", "SELECT DISTINCT 'USD' AS unit FROM supplier")
def s16(spark: SparkSession, d: str) -> DataFrame:
    return facts.s14(spark, d).select("unit").distinct()


@query("q_s18_dispatch_by_type", f"WITH {SRC} SELECT id, CASE WHEN lower(source_url) LIKE '%.pdf' THEN 'pdf' WHEN lower(source_url) LIKE '%.json' THEN 'json' ELSE 'html' END AS reader FROM src")
def s18(spark: SparkSession, d: str) -> DataFrame:
    u = F.lower("source_url")
    return sources(spark, d).select("id", F.when(u.endswith(".pdf"), "pdf").when(u.endswith(".json"), "json").otherwise("html").alias("reader"))


@query("q_s20_page_cells", "SELECT p_partkey, unnest([0, 0, 1, 1]) AS row, unnest([0, 1, 0, 1]) AS col, unnest(['Net sales', CAST(p_size AS VARCHAR), 'Total', CAST(p_size + 1 AS VARCHAR)]) AS text FROM part")
def s20(spark: SparkSession, d: str) -> DataFrame:
    word = lambda t, x, top, n: F.struct(t.alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(x + n * 5)).alias("x1"), F.lit(float(top)).alias("top"), F.lit(float(top + 10)).alias("bottom"))
    size = c("p_size").cast("string")
    ws = F.array(word(F.lit("Net"), 0, 0, 3), word(F.lit("sales"), 18, 1, 5), word(size, 100, 0, 2), word(F.lit("Total"), 0, 20, 5), word((c("p_size") + 1).cast("string"), 101, 21, 2))
    words = table(spark, d, "part").select("p_partkey", F.explode(ws).alias("w")).select("p_partkey", "w.*")
    return page_cells(words, "p_partkey")


@query("q_s22_member_register", "SELECT drug_name AS member FROM drug_jobs WHERE completeness_pct >= 80 GROUP BY 1")
def s22(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "drug_jobs").select(c("drug_name").alias("member"), (c("completeness_pct") / 100).cast("string").alias("confidence"))
    return files.read_register(raw, 0.8).select("member").distinct()


same("q_s24_element_register", __import__("types").SimpleNamespace(QUERIES=QUERIES, ORACLES=ORACLES), "q_s22_member_register")


@query("q_s29_workbook_sheets", f"WITH {OBS} SELECT 'products' AS sheet, count(DISTINCT product) AS n FROM obs UNION ALL SELECT 'quarters', count(*) FROM obs WHERE period_type = 'quarterly' UNION ALL SELECT 'annual', count(*) FROM obs WHERE period_type = 'annual'")
def s29(spark: SparkSession, d: str) -> DataFrame:
    """The sheets of a workbook and their rows; written as one CSV per sheet by ``files.write_csv``."""
    o = observations(spark, d)
    sheets = {"products": o.select("product").distinct(), "quarters": o.filter("period_type = 'quarterly'"), "annual": o.filter("period_type = 'annual'")}
    out = None
    for name, df in sheets.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("sheet"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("q_k04_lateness_by_rank", f"WITH {SRC}, {DP} SELECT dp.id, CASE WHEN filed IS NULL THEN 'unknown' ELSE 'dated' END AS lateness FROM dp LEFT JOIN src ON dp.source_id = src.id")
def k04(spark: SparkSession, d: str) -> DataFrame:
    """Late evidence is ranked, never dropped: every reading keeps its row."""
    s = sources(spark, d).select(c("id").alias("source_id"), loose_date(c("source_date")).alias("filed"))
    return readings(spark, d).join(s, "source_id", "left").select("id", F.when(c("filed").isNull(), "unknown").otherwise("dated").alias("lateness"))


same("q_k05_resettle_series", RD, "q_c16_select_series")
same("q_s33_browse_jobs", workbench, "q_s33_table_browser")
