"""The general data problems on small fixtures: nulls, ties, repeats, empty tables, clashing columns, hot keys."""

import math
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesloom.operators.diff import Field, compare_copies, revenue_differences
from seriesloom.operators.grid import regular_grid
from seriesloom.operators.spikes import mark_implausible
from seriesloom.operators.trailing import trailing_totals
from seriesloom.operators.units import convert_amounts, misconverted

POINTS = "s string, q int, v double"


def test_grid_fills_gaps_and_marks_them(spark):
    rows = [("a", q, 100.0 + 2 * q + 10 * math.cos(math.pi * q / 2)) for q in range(8000, 8040) if q not in (8010, 8011, 8020)]
    got = {r.q: r for r in regular_grid(spark.createDataFrame(rows, POINTS), ["s"], "q", "v").collect()}
    assert sorted(got) == list(range(8000, 8040))
    assert sorted(q for q, r in got.items() if not r.is_observed) == [8010, 8011, 8020]
    for q in (8010, 8011, 8020):
        assert got[q].v == pytest.approx(100 + 2 * q + 10 * math.cos(math.pi * q / 2), rel=1e-3)


def test_grid_edges(spark):
    df = spark.createDataFrame([("a", 5, 1.0), ("b", 1, None), ("b", 2, float("nan")), (None, 3, 1.0), ("c", None, 1.0)], POINTS).withColumn("fitted", F.lit("clash"))
    assert [(r.s, r.q, r.v) for r in regular_grid(df.filter("s is not null"), ["s"], "q", "v").collect()] == [("a", 5, 1.0)]
    assert regular_grid(spark.createDataFrame([], POINTS), ["s"], "q", "v").count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(-50, 50)), min_size=1, max_size=25, unique_by=lambda t: t[0]), st.sampled_from([1, 3, 4, 7, 13]))
def test_trailing_against_brute_force(spark, points, n):
    df = spark.createDataFrame([("a", q, float(v)) for q, v in points], POINTS)
    have, lo, hi = dict(points), min(q for q, _ in points), max(q for q, _ in points)
    got = {r.q: r for r in trailing_totals(df, ["s"], "q", "v", (n,)).collect()}
    assert sorted(got) == list(range(lo, hi + 1))
    for q, r in got.items():
        want = sum(have.get(i, 0) for i in range(max(lo, q - n + 1), q + 1))
        assert float(r[f"total_{n}"]) == want and r[f"full_{n}"] == (q - lo + 1 >= n)


def test_trailing_nulls_count_as_zero_and_ends_are_trimmed(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, None), ("a", 4, 1.0), ("a", 5, float("nan")), ("b", 1, None)], POINTS)
    got = [(r.s, r.q, float(r.total_2)) for r in trailing_totals(df, ["s"], "q", "v", (2,)).orderBy("q").collect()]
    assert got == [("a", 2, 5.0), ("a", 3, 5.0), ("a", 4, 1.0)]
    assert trailing_totals(spark.createDataFrame([], POINTS), ["s"], "q", "v").count() == 0


def test_copies_field_by_field(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (1, "x", 1.0), (2, None, 2.0), (3, "y", None), (None, "n", 1.0), (5, "z", 1.0)], "k int, t string, v double").withColumn("status", F.lit("clash"))
    b = spark.createDataFrame([(1, "X ", 1.0004), (2, "q", 2.0), (3, "y", 0.0), (None, "n", 1.0), (6, "z", 1.0)], "k int, t string, v double")
    fields = [Field("t", F.lower(F.trim("t")), F.lower(F.trim("t"))), Field("v", F.col("v"), F.col("v"), 0.0005)]
    got = {r.k: (r.status, [(x.field, x.left_value, x.right_value) for x in r.differences or []]) for r in compare_copies(a, b, "k", fields).collect()}
    assert got == {2: ("differs", [("t", None, "q")]), 3: ("differs", [("v", None, "0.0")]), 5: ("missing_in_right", []), 6: ("missing_in_left", [])}
    assert compare_copies(a.limit(0), b.limit(0), "k", fields).count() == 0


def test_revenue_copies(spark):
    a = spark.createDataFrame([(1, "Alpha", "2008Q1", 1234.5, "USD"), (2, "Beta", "FY 2010", None, "EUR")], "row_id long, drug_name string, period string, value_reported double, currency string")
    b = spark.createDataFrame([(1, " ALPHA ", "Jan-Mar 2008", "1,234.5", "usd "), (2, "Beta", "Q1 2010", "(3)", "EUR")], "row_id long, drug_name string, period string, value_reported string, currency string")
    got = {r.row_id: sorted(x.field for x in r.differences) for r in revenue_differences(a, b).collect()}
    assert got == {2: ["period", "value_reported"]}


DP = "id string, value_as_reported double, source_unit string, source_currency string, fx_rate_to_usd double, value_normalized_usd_millions double, period string, source_quote string"
CASES = [  # amount, unit, currency, rate, quote -> millions of US dollars or the reason
    (152.8, "Mio.", "$", None, None, 152.8), (139347.0, "(000s)", "US$", None, None, 139.347), (138.9, "USD millions", "local", None, None, 138.9),
    (100.0, None, "EUR", 1.25, "X sold EUR 100 mn in the period, after 90", 125.0), (100.0, "thousands", "USD", None, "(Amounts in millions of euros, except per share data) X 100 90", 125.0),
    (100.0, "millions", "EUR", 0.8, None, 125.0), (2.0, "億円", "¥", 0.01, None, 2.0), (5.0, "crore", "INR", 0.016, None, 0.8), (9.9, None, "USD", None, "X 9.9; some 1.2 million packs shipped", "unknown_unit"),
    (1.0, "millions", "local", None, None, "unknown_currency"), (1.0, "millions", "NOK", None, None, "no_rate"), (None, "millions", "USD", None, None, "no_amount"),
    (0.187, None, None, None, "(Amounts in billions of U.S. dollars, except per share data) Y 0.187 0.2", 187.0), (4012212.0, "ones", "usd", 1.0, "Fe 25mg, 2014q1: 4,012,212", 4.012212), (630.5, "millions", "USD", None, "630.5 crore INR - W, 2019Q1", 0.016 * 6305),
]


def test_units_and_currencies(spark):
    rows = [(str(i), a, u, cur, r, None, "2019Q1", q) for i, (a, u, cur, r, q, _) in enumerate(CASES)]
    fx = spark.createDataFrame([("EUR", 2019, 1.25), ("JPY", 2019, 0.01), ("INR", 2019, 0.016)], "currency string, calendar_year int, usd_per_unit double")
    got = {int(r.id): r for r in convert_amounts(spark.createDataFrame(rows + rows[:3], DP), fx).collect()}
    for i, case in enumerate(CASES):
        want = case[-1]
        assert got[i].reason == want if isinstance(want, str) else got[i].converted == pytest.approx(want), (i, case, got[i])
    assert convert_amounts(spark.createDataFrame([], DP), fx).count() == 0


def test_misconverted_needs_two_percent(spark):
    rows = [(str(i), 100.0, "millions", "USD", None, v, "2019Q1", None) for i, v in enumerate([100.0, 101.9, 103.0, None, float("nan")])]
    fx = spark.createDataFrame([], "currency string, calendar_year int, usd_per_unit double")
    assert sorted(r.id for r in misconverted(convert_amounts(spark.createDataFrame(rows, DP), fx)).collect()) == ["2", "3", "4"]


def marks(spark, values, explained=(), extra=()):
    t = datetime(2020, 1, 1)
    rows = [("s", i, v, t + timedelta(days=i), i, i in explained) for i, v in enumerate(values)] + list(extra)
    df = spark.createDataFrame(rows, "k string, i int, v double, at timestamp, id int, x boolean").withColumn("scale", F.lit("clash"))
    return sorted((r.id, r.problem) for r in mark_implausible(df, "k", "i", "v", F.struct("at", "id"), "id", F.col("x")).collect())


def test_spikes_are_lone_and_steps_are_not(spark):
    base = [100.0 + i for i in range(20)]
    assert marks(spark, base) == []
    up = base.copy()
    up[7] *= 10
    assert marks(spark, up) == [(7, "spike")]
    assert marks(spark, up, explained={7}) == []
    down = base.copy()
    down[7] /= 1000
    assert marks(spark, down, explained={7}) == [(7, "spike")]
    step = [10.0 + i / 10 for i in range(10)] + [100.0 + i for i in range(10)]
    assert marks(spark, step) == []
    launch = [100 * (1 - 0.5**i) + 0.1 for i in range(15)]
    assert marks(spark, launch) == []
    season = [100.0 * (3 if i % 4 == 0 else 1) + i for i in range(24)]
    assert marks(spark, season) == []


def test_impossible_and_frozen(spark):
    assert marks(spark, [5.0, -1.0, 6.0, 0.0, 5.5, 6.5]) == [(1, "impossible"), (3, "impossible")]
    assert marks(spark, [5.0, 7.0, 7.0, 7.0, 7.0, 6.0]) == [(2, "frozen"), (3, "frozen"), (4, "frozen")]
    assert marks(spark, [5.0, 7.0, 7.0, 7.0, 6.0]) == []
    assert marks(spark, [5.0, 7.0, 7.0, None, 7.0, 7.0]) == []


def test_superseded_records_are_tested_too(spark):
    base = [100.0 + i for i in range(12)]
    wrong = ("s", 5, 9000.0, datetime(2019, 1, 1), 99, False)
    assert marks(spark, base, extra=[wrong, wrong]) == [(99, "spike")]
    assert marks(spark, []) == []


def test_a_hot_series_among_small_ones(spark):
    rows = [("hot", i % 60, 100.0 + i % 60, i) for i in range(3000)] + [(f"s{i}", q, 10.0, i * 10 + q) for i in range(200) for q in range(3)]
    df = spark.createDataFrame(rows, "k string, i int, v double, id int")
    assert mark_implausible(df, "k", "i", "v", F.col("id"), "id", F.lit(False)).count() == 0
