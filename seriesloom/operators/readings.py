"""Competing readings of one figure: checks, adjudication, reconciliation, series selection, derivation.

Readings carry ``id, job_id, product, period, period_type, geography, scope,
value`` (millions of US dollars), ``bound`` (rounding, null unknown, 0 exact),
``reported``, ``quote``, ``status``, ``flags``, ``combined``, ``ordinal``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.annual import MONEY
from seriesloom.vocab import BOUND_FRACTION, CLAIM_STRENGTH, NEGLIGIBLE, NOT_UNDERSTOOD, OWN_PERIOD_DAYS, ROUNDING_FLOOR, ROUNDING_TOLERANCE, SCALE_JUMP, SUM_TOLERANCE

CELL = ["job_id", "product", "period", "period_type", "scope"]


def understood(flags: Column) -> Column:
    return ~F.array_contains(F.coalesce(flags, F.array().cast("array<string>")), NOT_UNDERSTOOD)


def states_a_figure(rows: DataFrame) -> DataFrame:
    """Readings that claim to be the product's figure: a label that was not understood claims nothing."""
    return rows.filter(understood(F.col("flags")))


def states_a_value(rows: DataFrame) -> DataFrame:
    return states_a_figure(rows).filter("value is not null")


def combined_bound(value: Column) -> Column:
    """Sum of the bounds, null if any is unknown."""
    return F.when(F.count(value) == F.count("*"), F.sum(value))


def quarters_against_totals(rows: DataFrame) -> DataFrame:
    """Totals of 6, 9 or 12 months that the quarters, all stated, do not add up to. Of repeats the last in order counts."""
    rows = states_a_value(rows).withColumn("year", F.substring("period", 1, 4).cast("int"))
    last = F.max(F.struct("ordinal", "value", "bound")).alias("b")
    key = ["job_id", "product", "scope", "year"]
    q = rows.filter("period_type = 'quarterly'").groupBy(*key, F.substring("period", 6, 1).cast("int").alias("n")).agg(last)
    sums = []
    for k in (2, 3, 4):
        inside = F.col("n") <= k
        sums += [F.sum(inside.cast("int")).alias(f"c{k}"), F.sum(F.when(inside, F.col("b.value").cast(MONEY))).cast("double").alias(f"s{k}"), F.when(F.count(F.when(inside, F.col("b.bound"))) == k, F.sum(F.when(inside, F.col("b.bound")))).alias(f"u{k}")]
    q = q.groupBy(*key).agg(*sums)
    t = rows.filter(F.col("period_type").isin("six_month", "nine_month", "annual")).groupBy(*key, "period_type").agg(last)
    k = F.when(F.col("period_type") == "six_month", 2).when(F.col("period_type") == "nine_month", 3).otherwise(4)
    pick = lambda x: F.when(k == 2, F.col(f"{x}2")).when(k == 3, F.col(f"{x}3")).otherwise(F.col(f"{x}4"))
    j = t.join(q, key).filter(pick("c") == k).select(*key, "period_type", F.col("b.value").alias("total"), pick("s").alias("summed"), (pick("u") + F.col("b.bound")).alias("declared"))
    allowed = F.when(F.col("declared").isNotNull(), F.greatest("declared", F.lit(ROUNDING_FLOOR))).otherwise(F.abs("total") * SUM_TOLERANCE)
    return j.filter((F.col("total") != 0) & (F.abs(F.col("summed") - F.col("total")) > allowed)).select(*key, "period_type", "total", "summed", allowed.alias("allowed"))


def scale_jumps(rows: DataFrame) -> DataFrame:
    """Consecutive quarterly readings of one product that differ a hundredfold."""
    w = Window.partitionBy("job_id", "product").orderBy("period", "ordinal")
    q = states_a_value(rows).filter("period_type = 'quarterly'").select("job_id", "product", "id", "period", "value", F.lag("value").over(w).alias("before"), F.lag("period").over(w).alias("period_before"))
    big, small = F.greatest(F.abs("value"), F.abs("before")), F.least(F.abs("value"), F.abs("before"))
    return q.filter((F.col("value") != 0) & (F.col("before") != 0) & (big / F.nullif(small, F.lit(0.0)) >= SCALE_JUMP)).select("job_id", "product", "id", "period_before", "period", (big / small).alias("ratio"))


def conflicts(rows: DataFrame) -> DataFrame:
    """Cells whose extreme readings differ by more than rounding explains."""
    low = F.min(F.struct("value", "ordinal", "bound", "id")).alias("lo")
    high = F.max(F.struct(F.col("value"), F.col("ordinal"), F.col("bound"), F.col("id"))).alias("hi")
    g = states_a_value(rows).groupBy(*CELL).agg(low, high, F.count("*").alias("n"))
    declared = F.when(F.col("lo.id") != F.col("hi.id"), F.col("lo.bound") + F.col("hi.bound"))
    allowed = F.when(declared.isNotNull(), F.greatest(declared, F.lit(ROUNDING_FLOOR))).otherwise(F.greatest(F.abs("hi.value") * ROUNDING_TOLERANCE, F.lit(ROUNDING_FLOOR)))
    return g.filter(F.col("hi.value") - F.col("lo.value") > allowed).select(*CELL, "n", F.col("lo.value").alias("low"), F.col("hi.value").alias("high"), allowed.alias("allowed"))


def adjudicate(rows: DataFrame, requested: str, keys: list[str]) -> DataFrame:
    """Per group one figure for the requested scope, or why there is none.

    ``basis`` tells differently defined figures apart. Values equal to six
    places are one; a spread of up to 1.0 is rounding and the larger is kept.
    """
    v = F.round("value", 6)
    hit = F.coalesce(F.col("scope") == requested, F.lit(False))
    g = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(hit.cast("int")).alias("k"), F.count_distinct(F.when(hit, F.col("basis"))).alias("bases"),
        F.min(F.when(hit, v)).alias("lo"), F.max(F.when(hit, v)).alias("hi"),
    )
    one, near = F.col("lo") == F.col("hi"), F.col("hi") - F.col("lo") <= 1.0
    code = F.when(F.col("k") == 0, "scope_not_reported").when(F.col("bases") > 1, "restated_basis").when(one, "single_stated_value").when(near, "agrees_within_rounding").otherwise("sources_disagree")
    status = F.when(F.col("k") == 0, "impossible").when((F.col("bases") <= 1) & (one | near), "resolved").otherwise("needs_review")
    return g.select(*keys, status.alias("verdict"), code.alias("code"), F.when(status == "resolved", F.col("hi")).alias("value"))


def adjudicate_total(total: Column, stated: Column, present: Column, expected: Column) -> tuple[Column, Column, Column]:
    """(status, code, value) of a total against its parts."""
    tolerance, missing = 0.5 * (expected + 1), expected - present
    residual = F.round(total - stated, 6)
    code = (
        F.when(expected < 1, "no_parts_expected")
        .when(missing == 0, F.when(F.abs(stated - total) <= tolerance, "parts_reconcile").when(stated > total + tolerance, "parts_exceed_total").otherwise("parts_fall_short_of_total"))
        .when(missing == 1, F.when(residual < -tolerance, "residual_is_negative").otherwise("single_residual"))
        .otherwise("underdetermined_residual")
    )
    status = F.when(code.isin("parts_reconcile", "single_residual"), "resolved").when(code == "underdetermined_residual", "needs_review").otherwise("impossible")
    value = F.when(code == "parts_reconcile", total).when(code == "single_residual", F.greatest(residual, F.lit(0.0)))
    return status, code, value


def claim_rank(method: Column) -> Column:
    case = F.lit(len(CLAIM_STRENGTH))
    for name, n in CLAIM_STRENGTH.items():
        case = F.when(method == name, n).otherwise(case)
    return case


def own_period_rank(filed: Column, period_end: Column) -> Column:
    """0 where the source was filed within the lag of its own period, 2 where later, 1 where unknown."""
    return F.when(filed.isNull() | period_end.isNull(), 1).when(filed <= F.date_add(period_end, OWN_PERIOD_DAYS), 0).otherwise(2)


def agreeing(a: Column, b: Column, bound_a: Column, bound_b: Column) -> Column:
    """One figure twice: within twice the larger declared bound, else half a percent of the larger, 0.05 at least."""
    declared = F.when(bound_a.isNotNull() | bound_b.isNotNull(), 2 * F.greatest(bound_a, bound_b))
    slack = F.coalesce(declared, ROUNDING_TOLERANCE * F.greatest(F.abs(a), F.abs(b)))
    return F.abs(a - b) <= F.greatest(slack, F.lit(ROUNDING_FLOOR))


def reconcile(rows: DataFrame, keys: list[str], strength: list[str]) -> DataFrame:
    """The winner of each group by claim strength, and what each other reading is to it.

    A group is contested where readings of the strongest tier disagree. A
    reading that agrees with the winner corroborates it, any other is
    superseded. Winners are found by a struct minimum, so no group is gathered.
    """
    order = F.struct(*strength, (-F.coalesce("confidence", F.lit(0.0))).alias("nc"), F.col("id"))
    tier = F.struct(*strength).alias("tier")
    win = rows.groupBy(*keys).agg(F.min(F.struct(order.alias("o"), F.col("value").alias("v"), F.col("bound").alias("b"), tier)).alias("w"), F.count("*").alias("n"))
    win = win.select(*keys, "n", F.col("w.o.id").alias("winner"), F.col("w.v").alias("wv"), F.col("w.b").alias("wb"), F.col("w.tier").alias("wt"))
    j = rows.withColumn("tier", F.struct(*strength)).join(win, keys)
    same = agreeing(F.col("value"), F.col("wv"), F.col("bound"), F.col("wb"))
    return j.select(*keys, "id", "winner", "n", F.when(F.col("id") == F.col("winner"), "winner").when(same, "corroborates").when(F.col("tier") == F.col("wt"), "contests").otherwise("superseded").alias("standing"))


def select_series(rows: DataFrame, cell: list[str], identity: str, strength: list[str]) -> DataFrame:
    """One selected reading per (identity, cell); the rest duplicate a figure of their cell, are superseded, or stay undecided."""
    order = F.struct(*strength, "id")
    able = rows.filter("publishes and value is not null")
    winners = able.groupBy(*cell, identity).agg(F.min(F.struct(order.alias("o"), F.col("value").alias("v"), F.col("bound").alias("b"))).alias("w"))
    winners = winners.select(*cell, F.col(identity).alias("w_identity"), F.col("w.o").alias("wo"), F.col("w.v").alias("wv"), F.col("w.b").alias("wb"))
    j = rows.join(winners, cell, "left")
    same = F.coalesce(agreeing(F.col("value"), F.col("wv"), F.col("bound"), F.col("wb")), F.lit(False))
    mine = F.col(identity) == F.col("w_identity")
    g = j.groupBy("id").agg(
        F.bool_or(F.coalesce(F.col("wo.id") == F.col("id"), F.lit(False))).alias("won"), F.min(F.when(same, F.col("wo"))).alias("same"), F.min(F.when(mine, F.col("wo"))).alias("own"),
    )
    selection = F.when(F.col("won"), "selected").when(F.col("same").isNotNull(), "duplicate").when(F.col("own").isNotNull(), "superseded")
    held = F.when(F.col("won"), F.col("id")).when(F.col("same").isNotNull(), F.col("same.id")).otherwise(F.col("own.id"))
    return g.select("id", selection.alias("selection"), held.alias("held_by"))


# --- derivation --------------------------------------------------------------------------------


def derive_quarters(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Quarters that stated totals determine.

    ``spans`` has one row per ``keys`` and year with structs ``q1..q4, h1, m9,
    fy`` of (value, bound), null where unstated, and ``start`` (first quarter
    sold in that year, 1 by default). First differences of two spans, then a
    total less all other quarters where one alone is missing; quarters found
    feed later totals. Residuals below -0.05 are refused. Returns one row per
    derived quarter with value, bound (null if any input's is unknown), rule
    and whether the bound leaves the figure unknown to its first digit.
    """
    null = F.lit(None).cast("struct<value:double,bound:double>")
    df = spans
    made = []

    def put(df: DataFrame, n: int, cond: Column, value: Column, bound: Column, rule: str) -> DataFrame:
        tag = f"d{n}_{rule}"
        made.append((n, tag, rule))
        df = df.withColumn(tag, F.when(F.coalesce(cond & (value >= -NEGLIGIBLE), F.lit(False)), F.struct(F.round(value, 6).alias("value"), bound.alias("bound"))).otherwise(null))
        return df.withColumn(f"q{n}", F.coalesce(F.col(f"q{n}"), F.col(tag)))

    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    for n, outer, inner in ((4, "fy", "m9"), (3, "m9", "h1")):
        df = put(df, n, both(outer, inner) & F.col(f"q{n}").isNull(), F.col(f"{outer}.value") - F.col(f"{inner}.value"), F.col(f"{outer}.bound") + F.col(f"{inner}.bound"), f"{outer}_less_{inner}")
    for total, members in (("fy", (1, 2, 3, 4)), ("m9", (1, 2, 3)), ("h1", (1, 2))):
        sold = {m: F.lit(m) >= F.coalesce(F.col("start"), F.lit(1)) for m in members}
        absent = sum((F.when(sold[m] & F.col(f"q{m}").isNull(), 1).otherwise(0) for m in members), F.lit(0))
        df = df.withColumn("_absent", absent)
        for target in members:
            others = [m for m in members if m != target]
            rest = sum((F.when(sold[m], F.coalesce(F.col(f"q{m}.value").cast(MONEY), F.lit(0).cast(MONEY))).otherwise(F.lit(0).cast(MONEY)) for m in others), F.lit(0).cast(MONEY)).cast("double")
            bound = F.col(f"{total}.bound") + sum((F.when(sold[m], F.col(f"q{m}.bound")).otherwise(0.0) for m in others), F.lit(0.0))
            cond = F.col(total).isNotNull() & (F.col("_absent") == 1) & sold[target] & F.col(f"q{target}").isNull()
            df = put(df, target, cond, F.col(f"{total}.value") - rest, bound, f"{total}_less_quarters_{target}")
    rows = F.array_compact(F.array(*[F.when(F.col(t).isNotNull(), F.struct(F.lit(n).alias("quarter"), F.lit(r).alias("rule"), F.col(f"{t}.value").alias("value"), F.col(f"{t}.bound").alias("bound"))) for n, t, r in made]))
    out = df.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
    return out.withColumn("held", F.coalesce((F.col("bound") > BOUND_FRACTION * F.abs("value")) & (F.col("value") != 0) & (F.col("bound") != 0), F.lit(False)))


def split_quarter(parts: DataFrame, keys: list[str], start: str, end: str, slack_days: int = 7) -> DataFrame:
    """Sum of dated parts (``begins``, ``ends``, ``value``) that tile a quarter: no gap, no overlap, at most a week over its end."""
    w = Window.partitionBy(*keys).orderBy("begins", "ends")
    p = parts.withColumn("before", F.lag("ends").over(w))
    fits = F.coalesce(F.col("begins") == F.date_add("before", 1), F.col("begins") == F.col(start)) & (F.col("begins") <= F.col("ends")) & F.col("value").isNotNull()
    g = p.groupBy(*keys, start, end).agg(F.bool_and(F.coalesce(fits, F.lit(False))).alias("tiled"), F.max("ends").alias("last"), F.sum(F.col("value").cast(MONEY)).cast("double").alias("total"))
    over = F.datediff(F.col("last"), F.col(end))
    return g.select(*keys, F.when(F.col("tiled") & over.between(0, slack_days), F.col("total")).alias("value"))
