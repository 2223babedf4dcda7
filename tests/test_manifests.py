"""Manifests, companion lines, JSON lines, cadence, conflicting rows and the shared folder: literal rows."""

import pytest
from pyspark.sql import functions as F

from seriesloom.operators.diff import conflicting_rows
from seriesloom.operators.grid import regular_grid
from seriesloom.operators.manifests import cadence, companion_lines, researched_products
from seriesloom.operators.spikes import mark_implausible
from seriesloom.sources import files, markup


def test_manifests_take_metadata_and_rates(spark, tmp_path):
    (tmp_path / "alpha_quarterly.csv").write_text("period,value,currency,issuer\n2020Q1,10,EUR,\n2020Q2,5,USD,Own\n1999Q1,5,EUR,\n")
    (tmp_path / "beta_quarterly.csv").write_text("period,value,currency,issuer\n2020Q1,7,,\n")
    (tmp_path / "alpha.meta.json").write_text('{"drug_name": "Alpha",\n "issuer": "Acme"}')
    rows = files.read_manifests(spark, str(tmp_path))
    flat = rows.select("stem", "period", F.col("value").cast("double").alias("value"), "currency", "issuer")
    meta = rows.select("stem", "meta.*").filter("drug_name is not null").distinct()
    fx = spark.createDataFrame([("EUR", 2020, 1.5)], "currency string, calendar_year int, usd_per_unit double")
    got = {(r.stem, r.period): (r.usd, r.issuer, r.problem, r.drug_name) for r in researched_products(flat, meta, fx).collect()}
    assert got == {("alpha", "2020Q1"): (15.0, "Acme", None, "Alpha"), ("alpha", "2020Q2"): (5.0, "Own", None, "Alpha"), ("alpha", "1999Q1"): (None, "Acme", "missing_rate", "Alpha"), ("beta", "2020Q1"): (7.0, None, None, None)}
    assert researched_products(flat.limit(0), meta, fx).count() == 0


def test_companions_and_continuations(spark):
    s = "name string, product string, why_separate string, relation string, line_includes array<string>, evidence string, lo int, gold_end int"
    rows = [
        ("plain", "p", "other territory", None, None, None, 1, 9), ("mute", "p", " ", None, None, None, 1, 9), ("next", "p", "sold on", "successor_issuer", None, "quote", 10, 9), ("early", "p", "sold on", "successor_issuer", None, "quote", 9, 9),
        ("odd", "p", "x", "sideways", None, "quote", 10, 9), ("wide", "p", "x", "broader_line", [], "quote", 10, 9), ("listed", "p", "x", "broader_line", ["q"], "quote", 10, 9), ("bare", "p", "x", "renamed_line", None, "", 10, 9), ("orphan", None, "x", None, None, None, 1, None), ("start", "p", "x", "renamed_line", None, "quote", 10, None),
    ]
    got = {r["name"]: (r["role"], r["problem"]) for r in companion_lines(spark.createDataFrame(rows, s)).collect()}
    assert got == {
        "plain": ("companion", None), "mute": ("refused", "no_reason_to_stand_apart"), "next": ("continuation", None), "early": ("refused", "overlaps_the_series"), "odd": ("refused", "unknown_relation"), "wide": ("refused", "contents_not_listed"),
        "listed": ("continuation", None), "bare": ("refused", "no_evidence"), "orphan": ("refused", "product_without_series"), "start": ("refused", "nothing_to_continue"),
    }


def test_cadence(spark):
    rows = [("a", 1), ("a", 20), ("b", 20), ("c", 1), ("c", 16), ("d", 17), ("d", 16), (None, 20), ("a", None)]
    got = {r.k: (r.cadence, r.due) for r in cadence(spark.createDataFrame(rows, "k string, q int"), "k", "q").collect()}
    assert got == {"a": ("quarterly", 21), "b": ("one_off", None), "c": ("one_off", None), "d": ("quarterly", 18)}
    assert cadence(spark.createDataFrame([], "k string, q int"), "k", "q").count() == 0


def test_json_lines_round_trip(spark, tmp_path):
    rows = [(1, "ü \"x\"\n", ["a", None]), (2, None, []), (3, "", None)]
    df = spark.createDataFrame(rows, "z int, a string, m array<string>")
    files.write_jsonl(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert all(line.startswith(('{"a"', '{"m"', '{"z"')) for line in text.splitlines())
    assert sorted(map(tuple, spark.read.schema(df.schema).json(str(tmp_path / "out")).collect())) == sorted(map(tuple, df.collect()))


def test_rows_that_conflict_within_a_copy(spark):
    rows = [(1, "a", 1.0), (1, "a", 1.0), (2, "a", 1.0), (2, "b", 1.0), (3, None, 2.0), (3, "x", 2.5), (4, None, None), (4, None, None), (None, "p", 1.0), (None, "q", 1.0), (5, "z", 1.0)]
    got = {tuple(r) for r in conflicting_rows(spark.createDataFrame(rows, "id long, n string, v double"), "id", [("n", F.col("n")), ("v", F.col("v"))]).collect()}
    assert got == {(2, "n", "a", "b"), (3, "n", "x", "x"), (3, "v", "2.0", "2.5"), (None, "n", "p", "q")}


def test_fills_are_bounded_and_finite(spark):
    rows = [("a", 0, 5.0), ("a", 1, 0.0), ("a", 3, 0.0), ("a", 4, 6.0), ("b", 0, -4.0), ("b", 2, -4.0), ("c", 0, 1e299), ("c", 40, -1e299)]
    got = {(r.k, r.q): r for r in regular_grid(spark.createDataFrame(rows, "k string, q int, v double"), ["k"], "q", "v").collect()}
    assert got["a", 2].v >= 0 and not got["a", 2].is_observed and got["b", 1].v < 0
    assert all(r.v is not None and abs(r.v) < 1e300 for r in got.values()) and len(got) == 5 + 3 + 41


def test_long_tables_are_read_whole(spark):
    html = "<table>" + "".join(f"<tr><td>{i}</td><td rowspan=2 colspan=x>b</td></tr>" for i in range(450)) + "</table>"
    df = spark.createDataFrame([(1, html)], "k int, h string")
    assert markup.html_cells(df, "k", "h").filter("is_origin").count() == 900
    assert markup.html_cells(df, "k", "h", row_limit=10).filter("is_origin").count() == 20


SPIKES = "k string, i int, v double, rank int, record int, x boolean"


def spiky(spark, values, explained=(), extra=()):
    rows = [("s", i, float(v), 0, i, i in explained) for i, v in enumerate(values)] + list(extra)
    got = mark_implausible(spark.createDataFrame(rows, SPIKES), "k", "i", "v", F.col("rank"), "record", F.col("x")).collect()
    return {(r.record, r.problem) for r in got}


def test_spikes_steps_growth_and_pairs(spark):
    calm = [10, 11, 10, 9, 10, 11, 10, 9, 10, 11]
    assert spiky(spark, [*calm[:5], 1000, *calm[5:]]) == {(5, "spike")}
    assert spiky(spark, [*calm[:5], 0.01, *calm[5:]]) == {(5, "spike")}
    assert spiky(spark, [*calm[:5], 1000, 1000, *calm[5:]]) == {(5, "spike"), (6, "spike")}
    assert spiky(spark, [*calm[:5], 1000, *calm[5:]], explained={5}) == set()
    assert spiky(spark, [1, 10, 100, 1000, 10000, 10100, 10000, 9900]) == set()  # launch growth
    assert spiky(spark, [*calm, *[100 * c for c in calm]]) == set()  # a lasting change of level
    assert spiky(spark, [10, -1, 0, 12, 10]) == {(1, "impossible"), (2, "impossible")}
    assert spiky(spark, [10, 12, 12, 12, 12, 10, 11, 11, 11, 9]) == {(2, "frozen"), (3, "frozen"), (4, "frozen")}
    assert spiky(spark, calm, extra=[("s", 4, 900.0, -1, 99, False), ("s", None, 1.0, 0, 98, False), (None, 1, 1.0, 0, 97, False), ("s", 3, None, 0, 96, False)]) == {(99, "spike")}
    assert spiky(spark, []) == set() and spiky(spark, [5.0]) == set()


def test_no_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace as N

    from seriesloom.session import shared_folder

    class Conf(dict):
        def isEmpty(self):
            return True

    sc = N(_jsc=N(sc=lambda: N(getCheckpointDir=Conf)), getConf=lambda: Conf(), master="spark://host:7077")
    with pytest.raises(RuntimeError):
        shared_folder(N(sparkContext=sc))
