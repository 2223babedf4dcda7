"""Analogs at size: products alike in all attributes are compared once."""

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import peers as P
from seriesloom.plans import peers as plans

PROFILE = "drug_name string, indication_area string, moa_class string, route_of_administration string, approval_era string, competitive_intensity_at_launch string"


def nodes(plan):
    """A run plan's nodes, those of its adaptive stages too."""
    kind = plan.getClass().getSimpleName()
    inner = [plan.finalPhysicalPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    return [(kind, plan), *[x for p in inner for x in nodes(p)]]


def most(df, kinds, metric):
    """The largest value of the metric in nodes whose kind holds one of the words; ``df`` has been collected."""
    found = [p.metrics().apply(metric).value() for kind, p in nodes(df._jdf.queryExecution().executedPlan()) if any(k in kind for k in kinds) and p.metrics().contains(metric)]
    assert found
    return max(found)


@pytest.fixture(scope="module")
def products(spark):
    """2,000 products with three sets of attributes between them, of which one is silent on all."""
    k = F.col("id") % 3
    text = lambda a, b: F.when(k == 0, a).when(k == 1, b)
    return spark.range(2000).select(F.col("id").cast("string").alias("drug_name"), text("Gout ", "gout flare").alias("a"), text("x", "x").alias("b"), text("PO", "IV").alias("c"), text("2000-2004", "2005-2009").alias("d"), text("low", "high").alias("e")).toDF(*[c.split()[0] for c in PROFILE.split(", ")])


def test_scores_are_made_once_for_products_alike(spark, products):
    df = P.score_analogs(products.filter("drug_name % 20 = 0"), products)
    got = {(r.target, r.candidate): (r.score, r.compared, r.matched, r.reason) for r in df.collect()}
    assert len(got) == 100 * 2000
    assert got["0", "3"] == (1.0, 5, list(P.ANALOG_WEIGHTS), None) and got["0", "0"] == (None, 0, None, "same_product")
    assert got["0", "1"] == (0.4375, 5, ["moa_class"], None) and got["0", "2"] == (0.0, 0, [], None) and got["20", "0"] == (None, 0, None, "no_comparable_attributes")
    assert most(df, ["Join"], "numOutputRows") < 1000


def test_ranking_shuffles_no_pairs(spark, products, monkeypatch):
    monkeypatch.setattr(plans, "profiles", lambda spark, d: products.withColumn("id", F.col("drug_name").cast("bigint")))
    df = plans.w10(spark, "")
    rows = df.collect()
    each = {}
    for r in rows:
        each.setdefault(r.target, []).append(r)
    assert {len(x) for x in each.values()} == {1333} and all(sorted(r.rank for r in x) == list(range(1, len(x) + 1)) for x in each.values())
    # the like are sorted by name; the target is not among them
    like = sorted(str(i) for i in range(0, 2000, 3) if i)
    assert [r.candidate for r in sorted(each["0"], key=lambda r: r.rank)][: len(like)] == like
    assert most(df, ["ShuffleExchange"], "shuffleRecordsWritten") < len(rows) / 4


@pytest.mark.parametrize("twice", [False, True])
def test_ranking_equals_that_of_the_pairs(spark, monkeypatch, twice):
    import random

    rnd = random.Random(5)
    pick = lambda *xs: rnd.choice([None, *xs])
    row = lambda n: (n, pick("gout", "acute gout", "asthma"), pick("x", "y"), pick("PO", "oral", "iv"), pick("2000-2004", "2005-2009", "2015-2019"), pick("low", "medium", "high"))
    rows = [row(f"n{i}") for i in range(160)] + [("alone", "rare", "z", "inhaled", "1980-1984", "low")]
    targets = [*rows[:25], rows[-1], row("not a candidate"), ("other", *rows[3][1:]), ("n90", "rare", "z", "iv", "1980-1984", "high")]
    rows = [r for r in rows if r[0] != "other"] + ([row("n7"), row("n120"), row(None)] if twice else [])
    targets += [row("n9"), row(None)] if twice else []
    t, c = spark.createDataFrame(targets, PROFILE), spark.createDataFrame(rows, PROFILE)
    monkeypatch.setattr(P, "BLOCK_SETS", 5, raising=False)
    monkeypatch.setattr(P, "NAMES_A_ROW", 2, raising=False)
    seen = lambda df: sorted(map(repr, (tuple(r) for r in df.select("target", "candidate", "score", "compared", "band", "rank").collect())))
    got = seen(P.ranked_analogs(t, c))
    assert len(got) > 1000 and got == seen(P.rank_analogs(P.score_analogs(t, c)))


def test_no_row_of_a_ranking_stands_for_many_pairs():
    """Spark's generated code holds all rows that one row yields: names times targets alike must not grow with the tables."""
    import numpy as np
    import pyarrow as pa

    names, targets = [f"n{i:05}" for i in range(9000)], [f"t{i:03}" for i in range(300)]
    sets = np.arange(9000) % 3
    kind = lambda k, **cols: pa.RecordBatch.from_pylist([{"kind": k} | x for x in ([dict(zip(cols, v)) for v in zip(*cols.values())])], pa.schema([("kind", pa.int32()), *[(c, t) for c, t in types.items()]]))
    whole = lambda t: pa.list_(t)
    types = {"below": whole(pa.int64()), "totals": whole(pa.int64()), "drug_name": pa.string(), "set": pa.int32(), "codes": whole(pa.int16()), "bands": whole(pa.int32()), "depths": whole(pa.int32()), "scores": whole(pa.float64()), "targets": whole(pa.string()), "owns": whole(pa.int16())}
    batches = [
        kind(0, below=[[10, 20, 30]], totals=[[3010, 3020, 3030]]), kind(1, drug_name=names, set=sets.tolist()),
        kind(2, codes=[[1, -1, 0]], bands=[[1, 2]], depths=[[5, 4]], scores=[[0.9, 0.5]], targets=[targets], owns=[[0] + [None] * 299]),
    ]
    got = [r for b in P.merged_runs(batches) for r in b.to_pylist()]
    assert max(len(r["candidates"]) * len(r["targets"]) for r in got) <= 1000
    placed = {}
    for r in got:
        assert len(r["targets"]) == 300
        placed |= {(r["run"], r["first"] + i): (n, r["band"], r["compared"], r["score"]) for i, n in enumerate(r["candidates"])}
    # 30 and 10 names of the runs lie in shares before; the second run follows all 3,030 names of the first
    expected = {(0, 30 + i): (n, 1, 5, 0.9) for i, n in enumerate(names[2::3])} | {(1, 3030 + 10 + i): (n, 2, 4, 0.5) for i, n in enumerate(names[0::3])}
    assert placed == expected
