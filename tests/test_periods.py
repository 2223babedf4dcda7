from datetime import date

import pytest
from pyspark.sql import functions as F

from seriesloom.functions import numeric, periods, text
from seriesloom.functions.geo import normalize_geography

LABELS = {
    "2008Q1": "2008Q1", " 2008q1 ": "2008Q1", "2008-Q1": "2008Q1", "2008/Q1": "2008Q1", "Q1-08": "2008Q1", "Q1 '08": "2008Q1", "1Q 2008": "2008Q1", "1Q08": "2008Q1", "QTR 1, 2008": "2008Q1",
    "first quarter 2008": "2008Q1", "Three months ended March 31, 2008": "2008Q1", "Jan-Mar 2008": "2008Q1", "Oct-Dec 2024": "2024Q4", "FY 2010": "2010", "FY2010": "2010", "full year 2010": "2010", "2010": "2010",
    "1H 2012": "2012H1", "H2 2012": "2012H2", "first half 2012": "2012H1", "2012H2": "2012H2", "Nine months ended September 30, 2012": "2012M9", "unknown": None, "": None, "Q5 2012": None,
}


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {t}" for k, t in ((k, {str: "string", int: "int", float: "double", date: "date", list: "array<string>"}[type(v)]) for k, v in cols.items()))).select(expr).first()[0]


def test_period_spellings(spark):
    df = spark.createDataFrame([(k,) for k in LABELS] + [(None,)], "p string")
    got = {r.p: r.k for r in df.select("p", periods.period_label(F.col("p")).alias("k")).collect()}
    assert got == LABELS | {None: None}


def test_quarter_index_and_back(spark):
    df = spark.createDataFrame([("2008Q1",), ("2024Q4",), ("2008",), (None,)], "k string")
    i = periods.quarter_index(F.col("k"))
    rows = df.select("k", i.alias("i"), periods.quarter_label(i).alias("l")).collect()
    assert [(r.k, r.i, r.l) for r in rows] == [("2008Q1", 8032, "2008Q1"), ("2024Q4", 8099, "2024Q4"), ("2008", None, None), (None, None, None)]


@pytest.mark.parametrize("key,start,end", [("2024Q2", date(2024, 4, 1), date(2024, 6, 30)), ("2024H1", date(2024, 1, 1), date(2024, 6, 30)), ("2024M9", date(2024, 1, 1), date(2024, 9, 30)), ("2024", date(2024, 1, 1), date(2024, 12, 31))])
def test_spans(spark, key, start, end):
    r = spark.createDataFrame([(key,)], "k string").select(periods.period_start(F.col("k")), periods.period_end(F.col("k"))).first()
    assert (r[0], r[1]) == (start, end)


@pytest.mark.parametrize("raw,want", [("2021-04-03", date(2021, 4, 3)), ("2021-04-03T00:00:00Z", date(2021, 4, 3)), ("20210403", date(2021, 4, 3)), ("27 Dec 2011", date(2011, 12, 27)), ("August 12, 2011", date(2011, 8, 12)), ("n.d.", None), ("2021-13-40", None)])
def test_loose_dates(spark, raw, want):
    assert one(spark, periods.loose_date(F.col("d")), d=raw) == want


@pytest.mark.parametrize("raw,want", [("(1.5)", -1.5), ("1,234.5", 1234.5), ("+5", 5.0), ("  12 ", 12.0), ("1.230000e+02", 123.0), ("n/a", None), ("-", None), ("", None), ("1.234,5", 1234.5), ("-7.2", -7.2)])
def test_text_numbers(spark, raw, want):
    assert one(spark, numeric.text_number(F.col("v")), v=raw) == want


@pytest.mark.parametrize("raw,want", [("U.S.", "united-states"), ("US", "united-states"), ("ex-US", "ex-united-states"), ("Ex-U.S.", "ex-united-states"), ("Worldwide", "worldwide"), ("global", "worldwide"), ("Acme Territories", "unrecognised-acme-territories"), (" ", "unspecified")])
def test_geographies(spark, raw, want):
    assert one(spark, normalize_geography(F.col("g")), g=raw) == want


def test_row_numbers_and_comparatives(spark):
    q = "Total Tyvaso 398.2 318.9 79.3 25 %"
    assert one(spark, text.number_tokens(F.col("q")), q=q) == [398.2, 318.9, 79.3, 25.0]
    df = spark.createDataFrame([(q, 398.2), (q, 1.0), ("a 1 2", 1.0), (None, 1.0)], "q string, v double")
    assert [r[0] for r in df.select(text.comparative_value(F.col("q"), F.col("v"))).collect()] == [318.9, None, None, None]


@pytest.mark.parametrize("a,b,bound,want", [(159.186, 159.2, None, True), (100.0, 101.0, None, False), (100.0, 101.0, 0.5, True), (0.0, 0.04, None, True)])
def test_agreement(spark, a, b, bound, want):
    df = spark.createDataFrame([(a, b, bound)], "a double, b double, u double")
    assert df.select(numeric.agrees(F.col("a"), F.col("b"), F.col("u"))).first()[0] is want


def test_calendar_months_ignore_days(spark):
    assert one(spark, periods.months_between_calendar(F.col("a"), F.col("b")), a=date(2020, 1, 31), b=date(2020, 3, 1)) == 2
