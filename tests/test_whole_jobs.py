"""Queries that once answered for a part of their input: literal rows outside that part."""

from datetime import date

from seriesloom.plans import facts, series, workbench


def test_quarter_matrix_holds_every_quarter(spark, monkeypatch):
    rows = [("s", 2008 * 4, 1.0), ("s", 2019 * 4 + 2, 2.0), ("s", 2024 * 4 + 3, 3.0), ("old", 2011 * 4 + 1, 4.0)]
    monkeypatch.setattr(series, "cells", lambda spark, d: spark.createDataFrame(rows, "series string, q int, value double"))
    got = {(r.series, r.quarter): r.value for r in series.b09(spark, "").collect()}
    assert got == {("s", "2008Q1"): 1.0, ("s", "2019Q3"): 2.0, ("s", "2024Q4"): 3.0, ("old", "2011Q2"): 4.0}


def test_launch_alignment_holds_every_offset(spark, monkeypatch):
    q = 2008 * 4
    rows = [("s", "P", q + 2, 1.0), ("s", "P", q + 67, 2.0), ("t", "U", q + 5, 3.0), ("u", "U", q + 3, 4.0), ("v", "V", q + 1, 5.0), ("w", None, q + 4, 6.0), ("w", None, q + 5, 7.0)]
    monkeypatch.setattr(series, "cells", lambda spark, d: spark.createDataFrame(rows, "series string, product string, q int, value double"))
    stated = [("P", date(2008, 1, 1)), ("U", None), ("V", date(2008, 7, 1))]
    monkeypatch.setattr(series, "launches", lambda spark, d: spark.createDataFrame(stated, "product string, launch_date date"))
    got = sorted((r.series, r.n, r.launch_column, r.stated, r.value) for r in series.b10(spark, "").collect())
    assert got == [
        ("s", 2, "Year 1 Q3", True, 1.0), ("s", 67, "Year 17 Q4", True, 2.0), ("t", 2, "Year 1 Q3", False, 3.0), ("u", 0, "Year 1 Q1", False, 4.0), ("v", -1, "Year 0 Q4", True, 5.0),
        ("w", 0, "Year 1 Q1", False, 6.0), ("w", 1, "Year 1 Q2", False, 7.0),
    ]


def test_every_job_is_a_target(spark, monkeypatch):
    rows = [("01", "A", "x"), ("91", "a ", "x"), ("a2", "B", "x"), ("f3", "C", "x"), ("f4", None, "x"), ("b5", "D", "y"), ("c6", "E", None)]
    monkeypatch.setattr(workbench, "jobs", lambda spark, d: spark.createDataFrame(rows, "id string, drug_name string, indication string"))
    assert {r.target: r.candidates for r in workbench.j15(spark, "").collect()} == {"01": 2, "91": 2, "a2": 3, "f3": 3}


def test_roots_are_climbed_to_the_end(spark, monkeypatch):
    chain = [(1, f"e{i}", f"e{i + 1}", -1 if i == 0 else 1) for i in range(15)]  # e0 is the top, its arc the negative one
    loop = [(2, "A", "B", 1), (2, "B", "A", 1), (2, "T", "C", 1), (2, "C", "D", 1), (2, "D", "C", -1)]
    arcs = "s_suppkey int, parent string, child string, weight int"
    monkeypatch.setattr(facts, "s17", lambda spark, d: spark.createDataFrame(chain + loop, arcs))
    got = {(r.s_suppkey, r.element, r.root, r.sign) for r in facts.c30(spark, "").collect()}
    want = {(1, f"e{i}", "e0", -1) for i in range(1, 16)} | {(2, "A", None, 1), (2, "B", None, 1), (2, "C", "T", -1), (2, "D", "T", -1)}
    assert got == want
