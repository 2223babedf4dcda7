"""The registry: every statement has its query, and queries equal their statements on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CHECKED = ["p1_found", "p2_found", "p2_trailing", "p4_found", "q_g02_annual_sales", "q_c01_select_peak", "q_c02_uptake", "q_c16_select_series", "q_c15_reconcile", "q_c05_complete_quarters", "q_g28_queue_groups", "q_w10_ranked_in_bands", "q_s19_html_table_grid", "q_k03_sessions"]


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(f"{float(v):.9g}") if type(v).__name__ in ("float", "Decimal") else str(v) if type(v).__name__ in ("date", "datetime") else v


def test_every_statement_has_a_query():
    assert not set(entry.oracle_sql()) - set(entry.queries())
    for n in (1, 2, 4, 5, 7):
        assert f"p{n}_found" in entry.queries()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", CHECKED)
def test_against_statement(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    cur = db.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in cur.fetchall())


def test_the_core_needs_no_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['seriesloom.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p9_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
