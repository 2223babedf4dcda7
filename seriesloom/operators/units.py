"""Quantities recorded in different units (problem 5).

Method: SQL only. Number, unit and currency are extracted from the quote,
aliases are normalised by a join with a fixed table, quote, field and unit-borne
values are coalesced, then factor and rate are applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.periods import period_label

# Spellings of scales (factor to millions).
UNIT_ALIASES = {
    1.0: ["million", "millions", "mn", "mln", "mio", "mio.", "mm", "m", "in millions", "(in millions)", "million(s)", "millionen"],
    0.001: ["thousand", "thousands", "k", "'000", "000", "000s", "(000s)", "000's", "tsd", "tsd.", "in thousands", "(in thousands)", "tausend"],
    1000.0: ["billion", "billions", "bn", "b", "mrd", "mrd.", "in billions", "milliarden"],
    1e-6: ["single", "units", "unit", "ones", "one", "whole currency", "actual", "whole", "in units"],
    10.0: ["crore", "crores", "cr", "cr.", "in crores"],
    0.1: ["lakh", "lakhs", "lac", "lacs", "in lakhs"],
    100.0: ["hundred million", "hundreds of millions", "hundred millions", "億", "oku"],
}
# Spellings of currencies.
CURRENCY_ALIASES = {
    "USD": ["usd", "$", "us$", "u.s. dollars", "us dollars", "u.s. dollar", "dollars", "dollar"],
    "EUR": ["eur", "€", "euro", "euros"],
    "GBP": ["gbp", "£", "pounds sterling", "pound sterling", "pounds", "sterling"],
    "JPY": ["jpy", "¥", "yen", "japanese yen", "円"],
    "CAD": ["cad", "c$", "ca$", "canadian dollars"],
    "AUD": ["aud", "a$", "au$", "australian dollars"],
    "CHF": ["chf", "swiss francs", "sfr"],
    "DKK": ["dkk", "danish kroner", "danish krone"],
    "SEK": ["sek", "swedish kronor", "swedish krona"],
    "NOK": ["nok", "norwegian kroner", "norwegian krone"],
    "INR": ["inr", "₹", "rs", "rs.", "rupees", "indian rupees"],
}

_CODE = r"USD|EUR|GBP|JPY|CAD|AUD|CHF|DKK|SEK|NOK|INR|[Ee]uros?|[Yy]en"
_SIGN = r"US\$|AU\$|CA\$|A\$|C\$|\$|€|£|¥|₹|Rs\.?|" + _CODE
_SCALE = r"hundred million|million|thousand|billion|mln|mn|bn|MM|m|k|K|Mio\.?|Mrd\.?|Tsd\.?|'000|crores?|Cr\.?|lakhs?|lacs?|億|oku"
_NUMBER = r"\d[\d,]*(?:\.\d+)?"
AMOUNT = rf"(?:({_SIGN})\s?)?((?<![\w.,]|[\w.,][-])-?{_NUMBER})(?:\s?({_SCALE})(?![A-Za-z]))?(?:\s?({_CODE})(?![A-Za-z]))?"
DECLARED = r"(?i)\((?:amounts |figures )?(?:in|expressed in) (hundreds of millions|single|thousands|millions|billions|crores|lakhs)(?: of)? ([A-Za-z.' ]+?)\s*(?:,[^)]*)?\)"


def alias_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(alias, factor, unit_currency) and (alias, currency); a scale may carry its currency, as in 'USD millions'."""
    units = [(a, f, None) for f, names in UNIT_ALIASES.items() for a in names]
    scales = {"millions": 1.0, "thousands": 0.001, "billions": 1000.0}
    units += [(f"{c} {s}", f, code) for code, names in CURRENCY_ALIASES.items() for c in names[:3] for s, f in scales.items()]
    units += [("億円", 100.0, "JPY"), ("oku yen", 100.0, "JPY")]
    money = [(a, code) for code, names in CURRENCY_ALIASES.items() for a in names]
    return spark.createDataFrame(units, "alias string, factor double, unit_currency string"), spark.createDataFrame(money, "alias string, currency string")


def _look_up(df: DataFrame, column: str, table: DataFrame, outputs: dict[str, str]) -> DataFrame:
    """Left join of a fixed alias table, renamed; the table has a few hundred rows whatever the data."""
    t = table.select(F.col("alias").alias("_a"), *[F.col(k).alias(v) for k, v in outputs.items()])
    return df.join(F.broadcast(t), F.lower(F.trim(F.col(column))) == F.col("_a"), "left").drop("_a")


def stated_in_quote(quote: Column, value: Column) -> Column:
    """Unit and currency words the quote states for the amount: beside it, else declared for the table."""
    part = lambda i: F.regexp_extract_all(quote, F.lit(AMOUNT), i)
    hits = F.arrays_zip(part(1).alias("before"), part(2).alias("number"), part(3).alias("scale"), part(4).alias("after"))
    own = F.filter(hits, lambda h: F.abs(F.translate(h["number"], ",", "").try_cast("double") - value) <= 1e-9 * F.abs(value) + 1e-12)
    # the mention with most beside it: "after 121.7" repeats a number, "121.7 mn" states it
    best = F.element_at(F.array_sort(F.transform(own, lambda h: F.struct((-(h["scale"] != "").cast("int") - (h["before"] != "").cast("int") - (h["after"] != "").cast("int")).alias("w"), h["before"].alias("before"), h["scale"].alias("scale"), h["after"].alias("after")))), 1)
    blank = lambda c: F.when(c != "", c)
    return F.struct(
        F.coalesce(blank(best["scale"]), blank(F.regexp_extract(quote, DECLARED, 1))).alias("unit"),
        F.coalesce(blank(best["before"]), blank(best["after"]), blank(F.regexp_extract(quote, DECLARED, 2))).alias("currency"),
    )


def convert_amounts(datapoints: DataFrame, fx_rates: DataFrame) -> DataFrame:
    """Each datapoint's amount in millions of US dollars, with the unit, currency and rate used.

    One row per ``id`` (repeats are one record, taken as the greatest row). Adds
    ``factor``, ``currency``, ``rate``, ``converted`` and ``reason`` (null, or
    ``unknown_unit``, ``unknown_currency``, ``no_rate``, ``no_amount``). What the
    quote states for the amount comes first, then the fields, then a currency
    that the unit carries. A recorded rate that is nearer to the table's when
    inverted is the wrong way round and the table's holds; without a table rate
    an inverted-looking one (against the currency's other years) is unknown.
    Null quotes, units and currencies fall through; an empty table gives none.
    """
    spark = datapoints.sparkSession
    unit_table, money_table = alias_tables(spark)
    columns = ["value_as_reported", "source_unit", "source_currency", "fx_rate_to_usd", "value_normalized_usd_millions", "period", "source_quote"]
    base = datapoints.groupBy("id").agg(F.max(F.struct(*columns)).alias("r")).select("id", "r.*")
    base = base.withColumn("_q", stated_in_quote(F.col("source_quote"), F.col("value_as_reported")))
    base = base.select("*", F.col("_q.unit").alias("_qu"), F.col("_q.currency").alias("_qc")).drop("_q", "source_quote")
    base = _look_up(base, "_qu", unit_table, {"factor": "_f1", "unit_currency": "_c4"})
    base = _look_up(base, "source_unit", unit_table, {"factor": "_f2", "unit_currency": "_c3"})
    base = _look_up(base, "_qc", money_table, {"currency": "_c1"})
    base = _look_up(base, "source_currency", money_table, {"currency": "_c2"})
    base = base.withColumn("factor", F.coalesce("_f1", "_f2")).withColumn("currency", F.coalesce("_c1", "_c2", "_c3", "_c4"))
    year = F.substring(period_label(F.col("period")), 1, 4).cast("int")
    base = base.withColumn("_y", year)
    fx = fx_rates.filter("usd_per_unit > 0").groupBy(F.col("currency").alias("_fc"), F.col("calendar_year").alias("_fy")).agg(F.max("usd_per_unit").alias("_fx"))
    usual = fx.groupBy(F.col("_fc").alias("_uc")).agg(F.avg("_fx").alias("_usual"))
    base = base.join(fx, (F.col("currency") == F.col("_fc")) & (F.col("_y") == F.col("_fy")), "left")
    base = base.join(usual, F.col("currency") == F.col("_uc"), "left")
    own = F.when(F.col("fx_rate_to_usd") > 0, F.col("fx_rate_to_usd"))
    off = lambda rate, ref: F.abs(F.ln(rate / ref))
    rate = (
        F.when(F.col("currency") == "USD", 1.0)
        .when(own.isNull(), F.col("_fx"))
        .when(F.col("_fx").isNotNull(), F.when(off(own, F.col("_fx")) <= 0.02, own).otherwise(F.col("_fx")))
        .when(F.col("_usual").isNotNull() & (off(own, F.col("_usual")) > off(1 / own, F.col("_usual"))), F.lit(None).cast("double"))
        .otherwise(own)
    )
    amount = F.when(~F.isnan("value_as_reported"), F.col("value_as_reported"))
    out = base.withColumn("rate", rate).withColumn("converted", amount * F.col("factor") * F.col("rate"))
    reason = F.when(amount.isNull(), "no_amount").when(F.col("factor").isNull(), "unknown_unit").when(F.col("currency").isNull(), "unknown_currency").when(F.col("rate").isNull(), "no_rate")
    return out.select("id", "period", "value_as_reported", "factor", "currency", "rate", "converted", reason.alias("reason"), "value_normalized_usd_millions")


def misconverted(converted: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Convertible amounts whose stored figure is missing or off by more than the tolerance."""
    stored = F.col("value_normalized_usd_millions")
    off = stored.isNull() | F.isnan(stored) | (F.abs(stored - F.col("converted")) > tolerance * F.abs(F.col("converted")))
    return converted.filter(F.col("converted").isNotNull() & off)
