"""From observations to annual sales, confirmed peaks and uptake.

Observations carry ``id, product, period, value, currency, geography,
revenue_scope, period_type, period_basis, formulation_scope, period_end,
confidence``. A result without evidence is null with a named reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.geo import normalize_geography
from seriesloom.functions.periods import months_between_calendar, quarter_index
from seriesloom.vocab import CONFIRMING_QUARTERS, PRODUCT_SCOPES, RECENCY_DAYS, SCOPE_KEY, THRESHOLD_SHARE, WINDOW_QUARTERS

MONEY = "decimal(24,6)"


def money_sum(value: str) -> Column:
    return F.sum(F.col(value).cast(MONEY)).cast("double")


def one_per_period(obs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The best reading per product, period and scope: highest confidence, unknown last, then the smallest id.

    A struct minimum combines before the shuffle; the whole row travels once.
    """
    keys = keys or ["product", "period", *SCOPE_KEY]
    rest = [c for c in obs.columns if c not in keys]
    order = F.struct((-F.coalesce("confidence", F.lit(-1.0))).alias("_c"), F.col("id").alias("_i"), F.struct(*rest).alias("_r"))
    return obs.groupBy(*keys).agg(F.min(order).alias("_b")).select(*keys, "_b._r.*")


def annual_sales(obs: DataFrame, currency: str = "USD") -> DataFrame:
    """One figure per product, year and scope: the reported annual one, else the sum of exactly four quarters."""
    best = one_per_period(obs.filter((F.col("currency") == currency) & F.col("revenue_scope").isin(PRODUCT_SCOPES)))
    year = F.substring("period", 1, 4).alias("year")
    keys = ["product", "year", *SCOPE_KEY]
    rows = best.filter(F.col("period_type").isin("annual", "quarterly")).select("*", year)
    annual = F.col("period_type") == "annual"
    ids = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("period", "id")))), lambda x: x["id"])
    sums = rows.groupBy(*keys).agg(
        F.max(F.when(annual, F.col("value"))).alias("a"), F.sum(annual.cast("int")).alias("na"), F.sum((~annual).cast("int")).alias("nq"),
        F.sum(F.when(~annual, F.col("value").cast(MONEY))).cast("double").alias("q"), ids(annual).alias("ia"), ids(~annual).alias("iq"),
    )
    kept = sums.filter("na > 0 or nq = 4")
    stated = F.col("na") > 0
    return kept.select(*keys, F.when(stated, F.col("a")).otherwise(F.col("q")).alias("value"), F.when(stated, F.col("ia")).otherwise(F.col("iq")).alias("input_ids"))


def partition_peaks(annual: DataFrame, launch: DataFrame | None = None) -> DataFrame:
    """The confirmed peak of each product's comparable series, or why there is none.

    ``launch`` has (product, launch_year). Reasons in their order: fewer than
    three years, a gap, a history that begins too late, fewer than two later
    years or one of the next two not lower.
    """
    keys = ["product", *SCOPE_KEY]
    w = Window.partitionBy(*keys).orderBy("y")
    rows = annual.select(*keys, F.col("year").cast("int").alias("y"), "value", "input_ids")
    rows = rows.select("*", F.lead("value", 1).over(w).alias("v1"), F.lead("value", 2).over(w).alias("v2"))
    top = F.max(F.struct("value", (-F.col("y")).alias("ny"), "v1", "v2", "input_ids")).alias("t")
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"), top)
    if launch is not None:
        g = g.join(launch.select("product", "launch_year"), "product", "left")
    else:
        g = g.withColumn("launch_year", F.lit(None).cast("int"))
    peak_year = -F.col("t.ny")
    late = F.when(F.col("launch_year").isNotNull(), F.when(F.col("lo") > F.col("launch_year"), "history_begins_after_launch")).otherwise(F.when(peak_year == F.col("lo"), "series_begins_at_its_maximum"))
    confirmed = F.coalesce((F.col("t.v1") < F.col("t.value")) & (F.col("t.v2") < F.col("t.value")), F.lit(False))
    reason = (
        F.when(F.col("n") < 3, "insufficient_annual_history").when(F.col("hi") - F.col("lo") + 1 != F.col("n"), "annual_history_has_gaps")
        .when(late.isNotNull(), late).when(~confirmed, "peak_not_yet_observed")
    )
    out = g.withColumn("reason", reason)
    return out.select(*keys, "n", F.when(F.col("reason").isNull(), peak_year).alias("peak_year"), F.when(F.col("reason").isNull(), F.col("t.value")).alias("value"), F.when(F.col("reason").isNull(), F.col("t.input_ids")).alias("input_ids"), "reason")


def select_peak(peaks: DataFrame, estimates: DataFrame, products: DataFrame, as_of: str) -> DataFrame:
    """One peak per product: observed, else the median of current consensus, else the newest modeled, else a reason.

    The best supported series with a confirmed peak counts; the reason given is
    that of the best supported series. ``estimates`` has id, product,
    estimate_type, value, currency, geography, revenue_scope, formulation_scope,
    as_of_date.
    """
    scope = F.struct(*[F.col(c) for c in SCOPE_KEY])
    order = F.struct((-F.col("n")).alias("n"), scope.alias("s"))
    rank1 = F.min(F.struct(order.alias("o"), F.col("reason").alias("reason"))).alias("first")
    seen = F.min(F.when(F.col("reason").isNull(), F.struct(order.alias("o"), F.col("value").alias("value"), F.col("input_ids").alias("ids"), scope.alias("scope")))).alias("obs")
    o = peaks.groupBy("product").agg(rank1, seen)
    age = F.datediff(F.to_date(F.lit(as_of)), "as_of_date")
    now = estimates.filter(age.between(0, RECENCY_DAYS))
    cons = F.col("estimate_type") == "consensus"
    e = now.groupBy("product").agg(
        F.sum(cons.cast("int")).alias("nc"),
        F.count_distinct(F.when(cons, F.struct("currency", "geography", "revenue_scope", F.coalesce("formulation_scope", F.lit("~")).alias("f")))).alias("scopes"),
        F.expr("percentile(case when estimate_type = 'consensus' then value end, 0.5)").alias("median"),
        F.array_sort(F.collect_list(F.when(cons, F.col("id")))).alias("cids"),
        F.max(F.when(F.col("estimate_type") == "modeled", F.struct("as_of_date", (-F.col("id")).alias("nid"), "value"))).alias("m"),
    )
    j = products.select("product").join(o, "product", "left").join(e, "product", "left")
    kind = F.when(F.col("obs").isNotNull(), "observed").when((F.col("nc") > 0) & (F.col("scopes") == 1), "consensus").when(F.col("m").isNotNull(), "modeled")
    value = F.when(F.col("obs").isNotNull(), F.col("obs.value")).when((F.col("nc") > 0) & (F.col("scopes") == 1), F.col("median")).otherwise(F.col("m.value"))
    ids = F.when(F.col("obs").isNotNull(), F.col("obs.ids")).when((F.col("nc") > 0) & (F.col("scopes") == 1), F.col("cids")).when(F.col("m").isNotNull(), F.array(-F.col("m.nid")))
    reason = F.when(kind.isNotNull(), F.lit(None)).when(F.col("first.reason").isNotNull(), F.col("first.reason")).when(F.col("scopes") > 1, "consensus_estimates_disagree_on_scope").otherwise("no_current_peak_estimate")
    of = lambda c: F.col(f"obs.scope.{c}").alias(f"peak_{c}")
    return j.select("product", kind.alias("estimate_type"), value.alias("value"), ids.alias("input_ids"), reason.alias("reason"), *[of(c) for c in SCOPE_KEY if c != "period_basis"])


def _in_peak_scope() -> Column:
    same = (F.col("currency") == F.col("peak_currency")) & (F.col("revenue_scope") == F.col("peak_revenue_scope"))
    place = normalize_geography(F.col("geography")) == normalize_geography(F.col("peak_geography"))
    return F.coalesce(same & place & F.col("formulation_scope").eqNullSafe(F.col("peak_formulation_scope")), F.lit(False))


def uptake(obs: DataFrame, peaks: DataFrame, launches: DataFrame) -> DataFrame:
    """Per product and reported quarter the trailing four quarters' share of peak, or the first reason that applies."""
    q = one_per_period(obs.filter("period_type = 'quarterly'")).join(peaks, "product", "left").join(launches.select("product", "launch_date"), "product", "left")
    usable = F.coalesce(F.col("peak_value") > 0, F.lit(False)) & F.col("peak_reason").isNull()
    q = q.withColumn("usable", usable).withColumn("hit", usable & _in_peak_scope())
    # rows of one period in and out of the peak's scope: the one in it, of equals the last in scope order
    pick = F.max(F.struct("hit", F.coalesce("period_basis", F.lit("")).alias("pb"), "id", "value", "period_end")).alias("b")
    p = q.groupBy("product", "period", "usable", "peak_value", "launch_date").agg(pick)
    p = p.select("product", "period", "usable", "peak_value", "launch_date", F.col("b.hit").alias("hit"), F.when(F.col("b.hit"), F.struct("b.id", "b.value", "b.period_end")).alias("r"))
    p = p.withColumn("qi", quarter_index(F.col("period")))
    w = Window.partitionBy("product", "hit").orderBy("qi")
    w4 = w.rowsBetween(-3, 0)
    p = p.select("*", F.row_number().over(w).alias("pos"), (F.col("qi") - F.lag("qi", 3).over(w)).alias("span"), F.sum(F.col("r.value").cast(MONEY)).over(w4).cast("double").alias("s"), F.collect_list("r.id").over(w4).alias("ids"))
    reason = (
        F.when(F.col("launch_date").isNull(), "missing_launch_anchor").when(~F.col("usable"), "missing_selected_peak").when(~F.col("hit"), "incompatible_sales_scope")
        .when(F.col("pos") < WINDOW_QUARTERS, "insufficient_history").when(F.col("span") != WINDOW_QUARTERS - 1, "nonconsecutive_quarters")
    )
    p = p.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return p.select(
        "product", "period", F.when(ok, F.col("s") / F.col("peak_value")).alias("value"), F.when(ok, F.col("s")).alias("numerator"), F.when(F.col("usable"), F.col("peak_value")).alias("denominator"),
        F.when(F.col("hit"), months_between_calendar(F.col("launch_date"), F.col("r.period_end"))).alias("months_since_launch"), "reason", F.when(ok, F.col("ids")).alias("input_ids"),
    )


def time_to_threshold(obs: DataFrame, peaks: DataFrame, launches: DataFrame) -> DataFrame:
    """Months from launch to the first annual or trailing figure of 0.9 of an observed peak, or a reason."""
    p = peaks.join(launches.select("product", "launch_date"), "product").withColumn("bar", F.col("peak_value") * THRESHOLD_SHARE)
    j = obs.join(p, "product").filter(_in_peak_scope())
    dated = one_per_period(j.filter("period_end >= launch_date"))
    dated = dated.withColumn("qi", quarter_index(F.col("period")))
    w = Window.partitionBy("product").orderBy("period")
    quarters = dated.filter("period_type = 'quarterly'").select("product", "period", "period_end", "bar", (F.col("qi") - F.lag("qi", 3).over(w)).alias("span"), F.sum(F.col("value").cast(MONEY)).over(w.rowsBetween(-3, 0)).cast("double").alias("v")).filter("span = 3")
    years = dated.filter("period_type = 'annual'").select("product", "period", "period_end", "bar", F.lit(3).alias("span"), F.col("value").alias("v"))
    hit = quarters.unionByName(years).filter("v >= bar").groupBy("product").agg(F.min(F.struct("period_end", "period")).alias("h"))
    flags = j.groupBy("product").agg(F.count("*").alias("scoped"), F.sum(F.coalesce(F.col("period_end") >= F.col("launch_date"), F.lit(False)).cast("int")).alias("dated"))
    out = p.join(flags, "product", "left").join(hit, "product", "left")
    reason = (
        F.when(F.col("peak_value").isNull() | F.col("peak_reason").isNotNull(), "missing_selected_peak").when(F.col("peak_type") != "observed", "peak_is_not_observed").when(F.col("scoped").isNull(), "incompatible_sales_scope")
        .when(F.col("dated") == 0, "undated_observations").when(F.col("h").isNull(), "threshold_not_reached")
    )
    ok = reason.isNull()
    return out.select("product", F.when(ok, months_between_calendar(F.col("launch_date"), F.col("h.period_end"))).alias("months_since_launch"), F.when(ok, F.col("h.period")).alias("period"), F.col("bar").alias("threshold"), reason.alias("reason"))


def rolling_four(points: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of four consecutive quarters (``q``, ``value``); windows over a gap are left out."""
    w = Window.partitionBy(*keys).orderBy("q").rangeBetween(-3, 0)
    r = points.select(*keys, "q", F.count("value").over(w).alias("n"), F.sum(F.col("value").cast(MONEY)).over(w).cast("double").alias("r4q"))
    return r.filter("n = 4").select(*keys, "q", "r4q")


def rolling_peak(points: DataFrame, keys: list[str]) -> DataFrame:
    """Highest four-quarter total of each series (earliest of equals), the windows after it and what that makes of it."""
    r = rolling_four(points, keys)
    best = r.groupBy(*keys).agg(F.max(F.struct("r4q", (-F.col("q")).alias("nq"))).alias("b"), F.max("q").alias("last_window"), F.count("*").alias("windows"))
    ends = points.filter("value is not null").groupBy(*keys).agg(F.min("q").alias("first_q"), F.max("q").alias("last_q"), F.count("*").alias("held"))
    j = ends.join(best, keys, "left").withColumn("peak_q", -F.col("b.nq"))
    after = F.col("last_q") - F.col("peak_q")
    status = F.when(F.col("b").isNull(), "no_full_window").when(after < CONFIRMING_QUARTERS, "not_yet_observed").otherwise("observed")
    return j.select(*keys, "peak_q", F.col("b.r4q").alias("r4q"), after.alias("quarters_after"), (F.col("last_q") - F.col("first_q") + 1 - F.col("held")).alias("missing"), status.alias("status"))


def annual_peak_all_lower(annual: DataFrame, keys: list[str]) -> DataFrame:
    """Peak year when at least two later years exist and all are lower, and no year is missing beside it."""
    w = Window.partitionBy(*keys).orderBy("y")
    rest = w.rowsBetween(1, Window.unboundedFollowing)
    a = annual.select("*", F.max("value").over(rest).alias("later"), F.count("value").over(rest).alias("n_later"), F.lag("y").over(w).alias("py"), F.lead("y").over(w).alias("ny"), F.max("value").over(Window.partitionBy(*keys)).alias("top"))
    first = a.filter("value = top").groupBy(*keys).agg(F.min(F.struct("y", "value", "later", "n_later", "py", "ny")).alias("t")).select(*keys, "t.*")
    beside = (F.coalesce(F.col("y") - F.col("py"), F.lit(1)) == 1) & (F.coalesce(F.col("ny") - F.col("y"), F.lit(1)) == 1)
    status = F.when(F.col("n_later") < 2, "not_yet_observed").when(F.col("later") >= F.col("value"), "not_yet_observed").when(~beside, "year_missing_beside_maximum").otherwise("observed")
    return first.select(*keys, F.col("y").alias("year"), "value", status.alias("status"))
