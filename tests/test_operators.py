"""Series, readings, peers and sources on literal rows; refusals first."""

from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesloom.operators import annual as A
from seriesloom.operators import peers as P
from seriesloom.operators import prose
from seriesloom.operators import readings as R
from seriesloom.operators.pages import page_cells
from seriesloom.sources import files, markup

ANNUAL = "product string, year string, currency string, geography string, revenue_scope string, period_basis string, formulation_scope string, value double, input_ids array<string>"


def annual(spark, values, product="p"):
    return spark.createDataFrame([(product, str(y), "USD", "Worldwide", "Product family", "calendar", None, float(v), [f"a{y}"]) for y, v in values], ANNUAL)


@pytest.mark.parametrize(
    "values,launch,value,reason",
    [
        ([(2020, 100), (2021, 200), (2022, 300), (2023, 265), (2024, 250)], None, 300.0, None),
        ([(2020, 900), (2021, 700), (2022, 600)], None, None, "series_begins_at_its_maximum"),
        ([(2020, 100), (2021, 400), (2022, 300), (2023, 200)], 2018, None, "history_begins_after_launch"),
        ([(2020, 100), (2021, 400)], None, None, "insufficient_annual_history"),
        ([(2020, 100), (2021, 400), (2023, 300)], None, None, "annual_history_has_gaps"),
        ([(2020, 100), (2021, 400), (2022, 300)], None, None, "peak_not_yet_observed"),
        ([(2020, 100), (2021, 400), (2022, 300), (2023, 400)], None, None, "peak_not_yet_observed"),
    ],
)
def test_peaks_and_refusals(spark, values, launch, value, reason):
    where = spark.createDataFrame([("p", launch)], "product string, launch_year int")
    r = A.partition_peaks(annual(spark, values), where).first()
    assert (r.value, r.reason) == (value, reason)
    assert (r.input_ids is None) == (reason is not None)


OBS = "id long, product string, period string, value double, currency string, geography string, revenue_scope string, period_type string, period_basis string, formulation_scope string, period_end date, confidence double"


def quarter(i, period, value, geography="U.S.", confidence=None, kind="quarterly"):
    y, q = int(period[:4]), int(period[5:] or 4)
    return (i, "p", period, float(value), "USD", geography, "Product family", kind, "calendar", None, date(y, q * 3, 28), confidence)


def test_roll_up_takes_the_stated_year_and_exactly_four_quarters(spark):
    rows = [quarter(i, f"2020Q{i}", 10) for i in (1, 2, 3, 4)] + [quarter(i + 4, f"2021Q{i}", 10) for i in (1, 2, 3)] + [quarter(9, "2022", 55, kind="annual")] + [quarter(9 + i, f"2022Q{i}", 1) for i in (1, 2, 3, 4)]
    rows += [quarter(20, "2020Q1", 99, confidence=0.1)]
    got = {r.year: (r.value, r.input_ids) for r in A.annual_sales(spark.createDataFrame(rows, OBS)).collect()}
    assert got == {"2020": (129.0, [20, 2, 3, 4]), "2022": (55.0, [9])}


def test_uptake_reasons(spark):
    obs = spark.createDataFrame([quarter(i + 1, f"2024Q{i + 1}", 10 * (i + 1)) for i in range(4)] + [quarter(6, "2025Q2", 50), quarter(7, "2025Q3", 1, geography="Japan")], OBS)
    peak = spark.createDataFrame([("p", 200.0, None, "observed", "USD", "US", "Product family", None)], "product string, peak_value double, peak_reason string, peak_type string, peak_currency string, peak_geography string, peak_revenue_scope string, peak_formulation_scope string")
    launch = spark.createDataFrame([("p", date(2024, 1, 1))], "product string, launch_date date")
    got = {r.period: r for r in A.uptake(obs, peak, launch).collect()}
    assert [got[f"2024Q{i}"].reason for i in (1, 2, 3)] == ["insufficient_history"] * 3
    assert (got["2024Q4"].value, got["2024Q4"].input_ids, got["2024Q4"].months_since_launch) == (0.5, [1, 2, 3, 4], 11)
    assert got["2025Q2"].reason == "nonconsecutive_quarters" and got["2025Q3"].reason == "incompatible_sales_scope"
    none = launch.withColumn("launch_date", F.lit(None).cast("date"))
    assert {r.reason for r in A.uptake(obs, peak, none).collect()} == {"missing_launch_anchor"}


def test_rolling_peak_of_the_quarterly_fixture(spark):
    rows = [("s", 2015 * 4 + i, float(v)) for i, v in enumerate([10, 20, 30, 40, 50, 60, 20, 20])]
    r = A.rolling_peak(spark.createDataFrame(rows, "s string, q int, value double"), ["s"]).first()
    assert (r.r4q, r.peak_q, r.quarters_after, r.status) == (180.0, 2016 * 4 + 1, 2, "observed")
    late = A.rolling_peak(spark.createDataFrame([("s", 2015 * 4 + i, float(v)) for i, v in enumerate([10, 20, 30, 40, 50, 60, 55])], "s string, q int, value double"), ["s"]).first()
    assert late.status == "not_yet_observed"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 9)), min_size=1, max_size=18, unique_by=lambda t: t[0]))
def test_windows_over_a_gap_are_left_out(spark, points):
    have = dict(points)
    got = {r.q: r.r4q for r in A.rolling_four(spark.createDataFrame([("s", q, float(v)) for q, v in points], "s string, q int, value double"), ["s"]).collect()}
    assert got == {q: float(sum(have[q - i] for i in range(4))) for q in have if all(q - i in have for i in range(4))}


SPAN = "struct<value:double,bound:double>"


def derive(spark, start=None, **parts):
    names = ["q1", "q2", "q3", "q4", "h1", "m9", "fy"]
    row = tuple((float(parts[n][0]), parts[n][1]) if n in parts else None for n in names)
    df = spark.createDataFrame([("s", 2023, *row, start)], "s string, y int, " + ", ".join(f"{n} {SPAN}" for n in names) + ", start int")
    return sorted((r.quarter, r.value, r.bound) for r in R.derive_quarters(df, ["s", "y"]).collect())


def test_quarters_two_totals_determine(spark):
    assert derive(spark, fy=(540.6, 0.5), m9=(409.6, 0.5)) == [(4, 131.0, 1.0)]
    assert derive(spark, m9=(409.6, 0.5), h1=(267.3, 0.5)) == [(3, 142.3, 1.0)]
    assert derive(spark, fy=(540.6, 0.5), m9=(409.6, 0.5), q4=(131.0, 0.5)) == []
    assert derive(spark, fy=(100, None), q1=(10, 0.5), q2=(20, 0.5), q3=(30, 0.5)) == [(4, 40.0, None)]
    assert derive(spark, fy=(50, 0.5), q1=(10, 0.5), q2=(20, 0.5), q3=(30, 0.5)) == []
    assert derive(spark, start=3, fy=(50, 0.5), q3=(20, 0.5)) == [(4, 30.0, 1.0)]
    assert derive(spark, fy=(50, 0.5), q3=(20, 0.5)) == []


READ = "id string, job_id string, product string, period string, period_type string, scope string, value double, bound double, flags array<string>, ordinal int"


def reading(i, period, kind, value, bound=None, flags=(), scope=""):
    return (str(i), "j", "p", period, kind, scope, float(value), bound, list(flags), i)


def test_checks(spark):
    rows = [reading(i, f"2020Q{i}", "quarterly", 10, 0.5) for i in (1, 2, 3, 4)]
    ok = spark.createDataFrame(rows + [reading(5, "2020", "annual", 42, 0.5)], READ)
    assert R.quarters_against_totals(ok).count() == 0
    off = spark.createDataFrame(rows + [reading(5, "2020", "annual", 43, 0.5)], READ)
    assert [(r.total, r.summed, r.allowed) for r in R.quarters_against_totals(off).collect()] == [(43.0, 40.0, 2.5)]
    jump = spark.createDataFrame([reading(1, "2020Q1", "quarterly", 1), reading(2, "2020Q2", "quarterly", 100), reading(3, "2020Q3", "quarterly", 99, flags=["label_not_understood"])], READ)
    assert [r.id for r in R.scale_jumps(jump).collect()] == ["2"]
    pair = [reading(1, "2020Q1", "quarterly", 121.718), reading(2, "2020Q1", "quarterly", 121.7), reading(3, "2020Q2", "quarterly", 10), reading(4, "2020Q2", "quarterly", 11)]
    assert [r.period for r in R.conflicts(spark.createDataFrame(pair, READ)).collect()] == ["2020Q2"]


def test_one_selected_per_series_and_the_rest_explained(spark):
    rows = [("a", "c", "us", 100.0, None, True, 0), ("b", "c", "us", 100.2, None, True, 1), ("d", "c", "us", 150.0, None, True, 1), ("e", "c", "world", 300.0, None, True, 0), ("f", "c", "world", 300.0, None, False, 0), ("g", "x", "us", 1.0, None, False, 0)]
    df = spark.createDataFrame(rows, "id string, cell string, identity string, value double, bound double, publishes boolean, s int")
    got = {r.id: (r.selection, r.held_by) for r in R.select_series(df, ["cell"], "identity", ["s"]).collect()}
    assert got == {"a": ("selected", "a"), "b": ("duplicate", "a"), "d": ("superseded", "a"), "e": ("selected", "e"), "f": ("duplicate", "e"), "g": (None, None)}


@pytest.mark.parametrize("total,parts,n,code", [(100.0, 100.0, 4, "parts_reconcile"), (100.0, 110.0, 4, "parts_exceed_total"), (100.0, 90.0, 4, "parts_fall_short_of_total"), (100.0, 70.0, 3, "single_residual"), (100.0, 110.0, 3, "residual_is_negative"), (100.0, 10.0, 1, "underdetermined_residual")])
def test_totals_against_parts(spark, total, parts, n, code):
    df = spark.createDataFrame([(total, parts, n)], "t double, p double, n int")
    assert df.select(R.adjudicate_total(F.col("t"), F.col("p"), F.col("n"), F.lit(4))[1]).first()[0] == code


def test_parts_that_tile_a_quarter(spark):
    q = (date(2017, 4, 1), date(2017, 6, 30))
    parts = [("ok", date(2017, 4, 1), date(2017, 6, 15), 3.0, *q), ("ok", date(2017, 6, 16), date(2017, 7, 2), 4.0, *q), ("gap", date(2017, 4, 1), date(2017, 6, 14), 3.0, *q), ("gap", date(2017, 6, 16), date(2017, 6, 30), 4.0, *q), ("over", date(2017, 4, 1), date(2017, 7, 20), 3.0, *q)]
    df = spark.createDataFrame(parts, "k string, begins date, ends date, value double, s date, e date")
    assert {r.k: r.value for r in R.split_quarter(df, ["k"], "s", "e").collect()} == {"ok": 7.0, "gap": None, "over": None}


ENTRY = "product_id string, disease string, lot string, setting string, geography string, launched date, classification string, same_moa boolean, same_route boolean"


def test_launch_peers_and_snapshot(spark):
    e = spark.createDataFrame([(n, dis, lot, "metastatic", "U.S.", date(y, 1, 1), "direct", True, False) for n, dis, lot, y in (("before", "Disease A", "1L", 2020), ("after", "disease a", "1L", 2023), ("wrong-lot", "Disease A", "2L+", 2019), ("other", "Disease B", "1L", 2019), ("target", "Disease A", "1L", 2022))], ENTRY)
    assert [r.peer_id for r in P.launch_peers(e, e.filter("product_id = 'target'")).collect()] == ["before"]
    four = spark.createDataFrame([(str(i), "d", "1L", "s", "g", date(2020, 1, 1 + i), k, False, False) for i, k in enumerate(["direct", "indirect", "substitutable", "near_term_phase3", "direct"])], ENTRY)
    last = {r.product_id: r for r in P.snapshots(four).collect()}["4"]
    assert (last.raw_score, last.marketed_peer_count, last.category) == (2.5, 3, "medium")


def test_bands_put_depth_before_a_hundredth(spark):
    s = spark.createDataFrame([("t", "a", 0.80, 3, None), ("t", "b", 0.79, 5, None), ("t", "c", 0.70, 5, None), ("t", "d", 0.9, 2, None)], "target string, candidate string, score double, compared int, reason string")
    assert [r.candidate for r in P.rank_analogs(s).orderBy("rank").collect()] == ["b", "a", "c"]


def one(spark, column, **values):
    """The value of a column expression over one row."""
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())).select(column.alias("x")).first().x


def test_labels_account_for_every_word(spark):
    read = lambda s: one(spark, prose.read_label(F.col("l"), F.col("own"), F.col("others")), l=s, own=["Calderon"], others=["Calderon XR", "NuVessa"])
    assert read("Calderon - U.S.")["scope"] == "United States"
    assert read("Calderon - Global")["scope"] == "Worldwide"
    assert read("Calderon Ex-U.S.")["scope"] == "International"
    assert read("Calderon - Other")["scope"] == "Other"
    assert read("Calderon / Calderon XR / NuVessa")["combined"] == ["Calderon XR", "NuVessa"]
    assert read("Calderon mystery")["flags"] == ["label_not_understood"] and read(None)["matched"] is None
    assert read("Caldéronn net sales")["matched"] == "Calderon" and read("Total revenue")["is_total"]


def test_sentences_and_changes(spark):
    split = lambda t: one(spark, prose.sentences(F.col("t")), t=t)
    change = lambda t, v: one(spark, prose.states_a_change(F.col("t"), F.col("v")), t=t, v=v)
    assert split("Sales rose. It fell!\n12 13\n• Next") == ["Sales rose.", "It fell!", "12 13", "Next"]
    assert split("U.S. sales were 1.5 in\nQ1; Europe fell.\n\n  3 | 4 \n") == ["U.S. sales were 1.5 in", "Q1;", "Europe fell.", "3 | 4"]
    assert split("") == [] and split(" \n ") == []
    assert change("Sales increased by $12.5 million", 12.5)
    assert not change("Sales increased by 3 million to $12.5 million", 12.5)
    assert not change(None, 12.5) and not change("Sold 12.5 million", 12.5)
    assert split(None) is None


def test_notes_labels_and_competitors(spark):
    note = lambda t: one(spark, prose.read_footnote(F.col("t"), F.col("own"), F.col("others")), t=t, own=["Calderon"], others=["NuVessa"])
    assert note("Includes NuVessa since the launch").asDict() == {"includes": ["NuVessa"], "no_sales": False, "partial": True, "names_own": False}
    assert note("Calderon: no sales in Japan")["no_sales"] and note(None)["includes"] == []
    other = lambda t: one(spark, prose.names_a_competing_product(F.col("t"), F.col("own"), F.col("others")), t=t, own=["Calderon"], others=["NuVessa"])
    assert (other("Calderon + NuVessa"), other("Calderonn sales"), other("NuVessa"), other("other products"), other(None)) == ("nuvessa", None, "nuvessa", "other products", None)


def test_prose_figures(spark):
    read = lambda t: [(r["period"], r["value"], r["unit"]) for r in one(spark, prose.read_prose(F.col("t"), F.array(F.lit("Calderon"))), t=t)]
    assert read("Calderon sold 12.5 million in Q1 2019. Nothing else.") == [("Q1 2019", 12.5, "million")]
    assert read("Calderon sold 1 million in Q1 2019 and 2 million in Q2 2019.") == [("Q1 2019", 1.0, "million"), ("Q2 2019", 2.0, "million")]
    assert read("In Q1 2019, Q2 2019 Calderon sold 1 million, 2 million respectively.") == [("Q1 2019", 1.0, "million"), ("Q2 2019", 2.0, "million")]
    assert read("In Q1 2019, Q2 2019 Calderon sold 1 million, 2 million.") == []
    assert read("Calderon and NuVessa® sold 1 million in Q1 2019.") == [] and read("Together with Calderon 1 million in Q1 2019.") == []
    assert read("In Q1 2019 Calderon rose by 3 million to 9 million.") == [("Q1 2019", 9.0, "million")]
    assert read("NuVessa sold 1 million in Q1 2019.") == [] and read("") == []


def test_indications_once_each(spark):
    t = "Calderon is indicated for the treatment of velar ataxia in adults. Approval of Calderon for Velar Ataxia came in May. Patients with HER2-positive chronic stasis, who relapsed."
    got = [tuple(r) for r in one(spark, prose.parse_indications(F.col("t")), t=t)]
    assert got == [("velar ataxia", None, "adults", None), ("HER2-positive chronic stasis", "chronic", "patients", "HER2-positive")]


def test_lines_of_therapy(spark):
    from seriesloom.plans.texts import line_of_therapy

    said = {"first-line use": "first_line", "after one prior therapy": "second_line_plus", "following two previous systemic regimens": "third_line_plus", "relapsed disease": "subsequent_unspecified", "first-line or after two prior regimens": "unresolved", "disease": "all_lines_or_unspecified", "": "unresolved"}
    assert {t: one(spark, line_of_therapy(F.col("t")), t=t) for t in said} == said


def test_evidence_windows_against_brute_force():
    t = "x" * 2000 + "Calderon 5 million" + "y" * 2500 + "calderon" + "z" * 100 + "Calderon $ 4 and 6 million"
    passages, windows, mentions = prose.evidence(t, ["Calderon"])
    assert mentions == 3 and windows == 2 and "5 million" in passages and "6 million" in passages and prose.evidence(None, ["a", ""]) == ("", 0, 0)


def test_set_cover_prefers_the_widest():
    assert prose.set_cover([(0, 1, [1]), (1, 0, [1, 2, 3]), (2, 1, [4])], {1, 2, 3, 4}, 2) == [(1, 1), (1, 2), (1, 3), (2, 4)]


def test_html_spans(spark):
    html = "<table><tr><th rowspan=2>A</th><th colspan='2'>B</th></tr><tr><td>1</td><td> 2 &amp;\n3</td></tr></table>"
    got = sorted((r.row, r.col, r.text, r.is_origin) for r in markup.html_cells(spark.createDataFrame([(1, html), (2, None), (3, "no table")], "k int, h string"), "k", "h").collect())
    assert got == [(0, 0, "A", True), (0, 1, "B", True), (0, 2, None, False), (1, 0, None, False), (1, 1, "1", True), (1, 2, "2 & 3", True)]


def test_bulk_facts(spark, tmp_path):
    (tmp_path / "sub.tsv").write_text("adsh\tcik\tname\tform\tperiod\tfiled\nA\t9999\tCALDERA\t10-Q\t20250630\t20250801\nB\tbad\tX\t10-Q\t1\t1\n")
    (tmp_path / "dim.tsv").write_text("dimhash\tsegments\tsegt\n0xAA\tProductOrService=Fenwick;\t\n0xDD\t\t\n")
    (tmp_path / "num.tsv").write_text("adsh\ttag\tversion\tddate\tqtrs\tuom\tdimh\tvalue\tdcml\nA\tRevenues\tus-gaap/2025\t20250630\t1\tUSD\t0xAA\t4200000\t-5\nA\tRevenues\tus-gaap/2025\t20250630\t1\tUSD\t0xDD\t9900000\t32767\nA\tRevenues\tus-gaap/2025\t20250630\t1\tUSD\t0xAA\t\t\nB\tR\tv\t20250630\t1\tUSD\t0xAA\t1\t\n")
    cols = lambda n: (tmp_path / f"{n}.tsv").read_text().split("\n")[0].split("\t")
    sub, dim, num = (files.read_tsv(spark, str(tmp_path / f"{n}.tsv"), cols(n)) for n in ("sub", "dim", "num"))
    got = {r.value: r for r in files.bulk_facts(num, files.submissions(sub), dim).collect()}
    assert set(got) == {4200000.0, 9900000.0}
    r = got[4200000.0]
    assert (r.element, r.members, r.start, r.end, r.decimals) == ("us-gaap:Revenues", {"ProductOrService": "Fenwick"}, date(2025, 4, 1), date(2025, 6, 30), "-5")
    assert got[9900000.0].decimals == "INF" and got[9900000.0].members == {}


def test_estimates_file(spark):
    row = ("Example", "consensus", "750", "USD", "Worldwide", "Product family", "2026-08-01", "https://example.test/report")
    ok, bad = files.check_estimates(spark.createDataFrame([row, (row[0], "observed", *row[2:]), (*row[:2], "x", *row[3:])], files.ESTIMATE_COLUMNS))
    assert ok.count() == 1 and sorted(r.problem for r in bad.collect()) == ["estimate_type_not_citable", "value_not_a_number"]


def test_linkbase_signs(spark):
    arcs = spark.createDataFrame([(1, "Net", "Rev", 1), (1, "Net", "Cost", -1), (1, "Rev", "Sales", 1), (1, "Cost", "Labour", 1), (2, "A", "B", 1), (2, "B", "A", 1)], "k int, parent string, child string, weight int")
    got = {(r.k, r.element): (r.root, r.sign) for r in markup.calculation_roots(arcs, "k", 4).filter("k = 1").collect()}
    assert got == {(1, "Rev"): ("Net", 1), (1, "Cost"): ("Net", -1), (1, "Sales"): ("Net", 1), (1, "Labour"): ("Net", -1)}


def test_page_words(spark):
    words = [("p", "Net", 0.0, 15.0, 0.0, 10.0), ("p", "sales", 18.0, 43.0, 1.0, 11.0), ("p", "12", 100.0, 110.0, 0.0, 10.0), ("p", "Total", 0.0, 25.0, 20.0, 30.0), ("p", "13", 101.0, 111.0, 21.0, 31.0)]
    got = sorted((r.row, r.col, r.text) for r in page_cells(spark.createDataFrame(words, "k string, text string, x0 double, x1 double, top double, bottom double"), "k").collect())
    assert got == [(0, 0, "Net sales"), (0, 1, "12"), (1, 0, "Total"), (1, 1, "13")]


def test_csv_and_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], {"k": "v"})], "i int, l array<string>, m map<string,string>")
    files.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().l == "a, b"
    files.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).columns == ["i", "l", "m"]
