"""Text and linkage problems against brute force; nulls, empty and long texts, ties, repeats, empty tables."""

import random
import re
import unicodedata
from datetime import datetime
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesloom.llm import chars, edits, leakage, names, packing, spans, survivors

DOC = "doc_id long, text string"
WORDS = "alpha beta gamma delta net sales rose fell table note quarter Größe naïve 12 13,5 x_y".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(n))


# --- characters --------------------------------------------------------------------------------


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=12))
def test_code_points_round_trip(texts):
    import pyarrow as pa

    back = []
    for first, codes, bounds in chars.code_points(pa.array([t if t is None else t.encode("utf-8", "replace").decode() for t in texts], pa.string())):
        assert first == len(back)
        back += ["".join(map(chr, codes[a:b])) for a, b in zip(bounds, bounds[1:])]
    assert back == [(t or "").encode("utf-8", "replace").decode() for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=60), st.integers(1, 20))
def test_sliding_minimum_keeps_the_last_of_equals(values, width):
    if len(values) < width:
        return
    v = np.array(values, np.uint64) << np.uint64(40)
    want = [max(range(i, i + width), key=lambda j: (-values[j], j)) for i in range(len(values) - width + 1)]
    assert chars.sliding_last_min(v, width).tolist() == want


def test_equal_windows_hash_equally_anywhere():
    a, b = np.frombuffer("xxabcdefyy".encode("utf-32-le"), np.uint32), np.frombuffer("abcdefzz".encode("utf-32-le"), np.uint32)
    one = chars.window_hashes(chars.prefix_hashes(a), np.array([2, 3]), 6)
    two = chars.window_hashes(chars.prefix_hashes(b), np.array([0]), 6)
    assert one[0] == two[0] and one[1] != two[0]


# --- problem 10 --------------------------------------------------------------------------------


def brute_pairs(docs, n):
    seen = {}
    for k, t in docs:
        for i in range(len(t or "") - n + 1):
            seen.setdefault(t[i : i + n], set()).add(k)
    return {p for v in seen.values() for p in combinations(sorted(v), 2)}


@pytest.fixture(scope="module")
def shared_docs():
    rng = random.Random(5)
    passage, exact = prose(rng, 90), prose(rng, 60)[:320]
    docs = [(i, prose(rng, rng.randrange(5, 120))) for i in range(40)]
    docs += [(50, docs[3][1]), (51, docs[3][1] + " tail"), (52, "ü" + passage[:400] + "é"), (53, prose(rng, 30) + passage[30:500]), (54, "a" + exact + "b"), (55, "c" + exact + "d"), (56, "e" + exact[:319] + "f")]
    docs += [(57, None), (58, ""), (59, "z" * 2000), (60, prose(rng, 40)[:330] * 3)]
    return docs


@pytest.mark.parametrize("length", [320, 64])
def test_shared_spans_against_brute_force(spark, shared_docs, length):
    df = spark.createDataFrame(shared_docs + shared_docs[3:5], DOC).withColumn("h", F.lit(1)).withColumn("pos", F.lit("clash"))
    got = {(r.doc_a, r.doc_b) for r in spans.sharing_pairs(spans.shared_windows(df, length)).collect()}
    assert got == brute_pairs(shared_docs, length)


def test_stretches_cover_what_stands_elsewhere(spark, shared_docs):
    texts = dict(shared_docs)
    got = {(r.doc, r.begin, r.end) for r in spans.stretches(spans.shared_windows(spark.createDataFrame(shared_docs, DOC))).collect()}
    for doc in texts:
        held = [i for i in range(len(texts[doc] or "") - 319) if any(texts[doc][i : i + 320] in (t or "") for k, t in texts.items() if k != doc)]
        covered = {x for i in held for x in range(i, i + 320)}
        assert covered == {x for d, a, b in got if d == doc for x in range(a, b)}


def test_levels_end_and_empty_tables(spark, shared_docs):
    got = {r.doc: r.span for r in spans.levels(spark.createDataFrame(shared_docs, DOC)).collect()}
    whole = len(dict(shared_docs)[50])  # a copy of document 3
    assert got[50] == max(x for x in (320, 640, 1280, 2560) if x <= whole)
    assert got[54] == got[55] == 320 and 56 not in got
    assert spans.sharing_pairs(spans.shared_windows(spark.createDataFrame([], DOC))).count() == 0


@pytest.mark.parametrize("block", [2000, 4])
def test_a_notice_in_many_records(spark, monkeypatch, block):
    monkeypatch.setattr(spans, "PAIR_BLOCK", block)
    rng = random.Random(7)
    notice = prose(rng, 45)
    docs = [(i, prose(rng, 10) + notice + prose(rng, 10)) for i in range(15)] + [(20 + i, prose(rng, 60)) for i in range(5)]
    docs += [(30, docs[16][1]), (31, docs[17][1]), (32, "x" + notice[9:]), (33, notice[:350])]
    got = spans.sharing_pairs(spans.shared_windows(spark.createDataFrame(docs, DOC))).collect()
    assert {(r.doc_a, r.doc_b) for r in got} == brute_pairs(docs, 320) and len(got) == len(set(got))


@pytest.mark.parametrize("order", [1, -1])
def test_different_texts_of_one_record(spark, order):
    rng = random.Random(8)
    one, two, three = prose(rng, 60), prose(rng, 140), prose(rng, 50)
    docs = [(1, one[:500]), (1, two), (2, "head " + one[:450]), (3, three), (4, "head " + two[700:1200]), (4, three + one[:400]), (5, two[:900] + two[:900]), (None, two), (6, None), (6, three[:400])][::order]
    df = spark.createDataFrame(docs, DOC)
    keyed = [(k, t) for k, t in docs if k is not None]
    got = {(r.doc_a, r.doc_b) for r in spans.sharing_pairs(spans.shared_windows(df)).collect()}
    assert got == brute_pairs(keyed, 320) and (1, 4) in got and (3, 6) in got
    parts = {}
    for r in spans.stretches(spans.shared_windows(df)).collect():
        parts.setdefault((r.doc, r.ver), []).append((r.begin, r.end))
    shared = sorted((k[0], sum(e - b for b, e in v)) for k, v in parts.items())
    want = []
    for k, t in keyed:
        held = [i for i in range(len(t or "") - 319) if any(t[i : i + 320] in (u or "") for m, u in keyed if m != k)]
        if held:
            want.append((k, len({x for i in held for x in range(i, i + 320)})))
    assert shared == sorted(want)


def test_classes_hold_every_link(spark, shared_docs):
    rows = spans.sharing_classes(spans.shared_windows(spark.createDataFrame(shared_docs, DOC))).collect()
    members = {}
    for r in rows:
        members.setdefault((r["class"], r.n), set()).add(r.doc)
    assert all(len(v) == n for (_, n), v in members.items()) and len(set(map(frozenset, members.values()))) == len(members)
    assert {p for v in members.values() for p in combinations(sorted(v), 2)} == brute_pairs(shared_docs, 320)


# --- problem 9 ---------------------------------------------------------------------------------


def words(text):
    out, run = [], ""
    for ch in text or "":
        kind = unicodedata.category(ch)
        if kind[0] == "L" or kind == "Nd":
            run += ch.lower() if len(ch.lower()) == 1 else ch
        elif run:
            out.append(run)
            run = ""
    return out + [run] * bool(run)


def brute_leaks(docs, items):
    grams = {}
    for k, t in items:
        w = words(t)
        for i in range(len(w) - 11):
            grams.setdefault(tuple(w[i : i + 12]), set()).add(k)
    return {(d, k) for d, t in docs for w in [words(t)] for i in range(len(w) - 11) for k in grams.get(tuple(w[i : i + 12]), ())}


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.randrange(8, 40))) for i in range(12)] + [(12, None), (13, ""), (14, "short text")]
    docs = [(i, prose(rng, rng.randrange(1, 80))) for i in range(30)]
    for n, (k, reach) in enumerate([(0, 11), (1, 12), (2, 13), (3, 25), (4, 12), (5, 40)]):
        w = items[k][1].split()
        cut = w[1 : 1 + reach]
        docs.append((100 + n, prose(rng, 9) + "\n" + " -- ".join(x.upper() for x in cut) + "... " + prose(rng, 9)))
        docs.append((200 + n, " ".join(w[:6] + ["CHANGED"] + w[7:])))
    docs += [(300, None), (301, ""), (302, items[3][1]), (303, items[3][1] * 2)]
    d = spark.createDataFrame(docs + docs[-2:], DOC).withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(d, i).collect()}
    assert got == brute_leaks(docs, items) and got
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


def test_the_shuffled_way_gives_the_same(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, prose(rng, 30)) for i in range(4)]
    docs = [(i, prose(rng, 5) + " " + items[i % 4][1][20:] + prose(rng, 5)) for i in range(8)]
    d, i = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, leakage.leaks(d, i).collect()))
    monkeypatch.setattr(leakage, "BROADCAST_CHARS", -1)
    assert sorted(map(tuple, leakage.leaks(d, i).collect())) == one == sorted(brute_leaks(docs, items))


# --- problem 8 ---------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=60))
def test_first_fit_decreasing(sizes):
    got = packing.first_fit_decreasing(np.array(sizes, np.int64), 20)
    room, want = [], {}
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = next((b for b, r in enumerate(room) if r >= sizes[k]), None)
        if at is None:
            at = len(room)
            room.append(20)
        room[at] -= sizes[k]
        want[k] = at
    assert got.tolist() == [want[k] for k in range(len(sizes))]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=30), min_size=1, max_size=20))
def test_tokens_as_python_counts_them(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOC)
    got = {r.doc_id: r.n for r in df.select("doc_id", packing.token_count(F.col("text")).alias("n")).collect()}
    kept = [(i, t) for i, t in enumerate(texts) if not any(unicodedata.category(c) == "Cn" for c in t)]
    assert {i: got[i] for i, _ in kept} == {i: len(re.findall(r"\w+|[^\w\s]+", t)) for i, t in kept}


def test_containers_are_valid(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(["w"] * rng.randrange(0, 3000))) for i in range(200)] + [(500, None), (501, ""), (502, "w " * 9000), (503, "w " * 4096)]
    df = spark.createDataFrame(docs + docs[:3], DOC).withColumn("container", F.lit("clash"))
    rows = packing.pack_documents(df, group_items=70).collect()
    room, tokens = {}, {}
    for r in rows:
        room[r.container] = room.get(r.container, 0) + r.n_tokens
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
        assert r.n_tokens <= 2048 and (r.pieces == 1 or r.piece < r.pieces and r.n_tokens == 2048 or r.piece == r.pieces)
    assert max(room.values()) <= 2048
    assert tokens == {k: len(t.split()) for k, t in docs if t is not None}
    assert {r.doc_id for r in rows if r.pieces > 1} == {k for k, t in docs if t and len(t.split()) > 2048}
    assert len(room) <= 1.06 * -(-sum(tokens.values()) // 2048) + 6
    assert packing.pack_documents(spark.createDataFrame([], DOC)).count() == 0


# --- problem 3 ---------------------------------------------------------------------------------


def slow_distance(a, b):
    big = len(a) + len(b)
    d = {(-1, -1): big}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = big, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = big, j
    last = {}
    for i in range(1, len(a) + 1):
        col = 0
        for j in range(1, len(b) + 1):
            r, k, cost = last.get(b[j - 1], 0), col, int(a[i - 1] != b[j - 1])
            if not cost:
                col = j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[r - 1, k - 1] + (i - r - 1) + 1 + (j - k - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


NAME = st.text("abcd", max_size=7)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(NAME, NAME), min_size=1, max_size=10))
def test_edit_distances(pairs):
    a, la, ca = edits.encode([p for p, _ in pairs])
    b, lb, cb = edits.encode([q for _, q in pairs])
    want = [slow_distance(p, q) for p, q in pairs]
    assert edits.distances(a, la, b, lb).tolist() == want
    assert (np.diag(edits.lower_bounds(ca, cb)) <= want).all()


@settings(max_examples=60, deadline=None)
@given(NAME, NAME, NAME)
def test_the_metric_keeps_the_triangle_inequality(x, y, z):
    assert slow_distance(x, z) <= slow_distance(x, y) + slow_distance(y, z)


@pytest.mark.parametrize("head", [32, 4])  # 4: most names are longer and meet by their beginnings
def test_radius_join_is_whole(spark, monkeypatch, head):
    monkeypatch.setattr(names, "HEAD", head)
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(120)]
    every = list(dict.fromkeys(base + [b[:2] + "x" + b[3:] for b in base[:40]] + [b[1:] for b in base[:20]]))
    df = spark.createDataFrame([(s,) for s in every + every[:5]] + [(None,), ("",)], "n string")
    got = {(r.a, r.b): r.d for r in names.radius_join(df, "n", 2).collect()}
    want = {(min(a, b), max(a, b)): v for a, b in combinations(every, 2) if 0 < (v := slow_distance(a, b)) <= 2}
    assert got == want
    assert names.radius_join(df.limit(0), "n", 2).count() == 0


@pytest.mark.parametrize(
    "raw,core,form,generic,short",
    [
        ("Mususelazi", "mususelazi", "", "", False), ("MUSUSELAZI®", "mususelazi", "", "", False), ("mususelazi (TM)", "mususelazi", "", "", False), ("Mususe.", "mususe", "", "", True), ("Cogo-belomo", "cogobelomo", "", "", False),
        ("Gehipe. Nasal", "gehipe", "nasal", "", True), ("HONURAMEDI-SC", "honuramedi", "sc", "", False), ("Bejukabuli Plus 25mg", "bejukabuli", "plus", "", False), ("cogobestat (Cogobelomo Depot)", "cogobelomo", "depot", "cogobestat", False),
        ("Divefejuhu, divefesartan", "divefejuhu", "", "divefesartan", False), ("Nucejijebo Plus [nucejitinib]", "nucejijebo", "plus", "nucejitinib", False), ("Selijajali - selijarasib", "selijajali", "", "selijarasib", False), ("Ro1atorebu", "rolatorebu", "", "", False), ("Sávavoturö", "savavoturo", "", "", False), ("Facalihapa® Depot", "facalihapa", "depot", "", False),
    ],
)
def test_reading_product_names(raw, core, form, generic, short):
    assert names.read_product(raw) == (core, form, generic, short)


@pytest.mark.parametrize(
    "raw,want",
    [
        ("Fani Nofomo Medicines S.A.", (["fani", "nofomo"], "medicines", "")), ("FaniNofomo Meds", (["fani", "nofomo"], "medicines", "")), ("Nofomo, Fani Medicines", (["fani", "nofomo"], "medicines", "")), ("F. Nofomo Medicines", (["nofomo"], "medicines", "f")),
        ("The flolo widika biologics", (["flolo", "widika"], "biologics", "")), ("Hugo & Rakure Pharms GmbH", (["hugo", "rakure"], "pharmaceuticals", "")), ("Humuro", (["humuro"], "", "")), ("Peavo Yihazu BioSci", (["peavo", "yihazu"], "biosciences", "")), ("Nuro & Dibijo Laboratories Société Anonyme", (["dibijo", "nuro"], "laboratories", "")),
    ],
)
def test_reading_company_names(raw, want):
    assert names.read_company(raw) == want


JOB = "id string, drug_name string, generic_name string, manufacturer string, ticker string"
POINT = "job_id string, product_label string, combined_with array<string>"


def classes(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["class"], set()).add(r["name"])
    return {frozenset(v) for v in out.values()}


def test_products_link_and_near_names_stay_apart(spark):
    jobs = [("1", "Bifubobuto", "bifubozumab", None, None), ("2", "Bifuyibuto", "bifuyizumab", None, None), ("3", "Bifubobuto XR", "bifubozumab", None, None), ("4", "Bifbobuto", None, None, None), ("5", None, None, None, None), ("6", "Bifubo.", "bifubozumab", None, None), ("7", "", None, None, None)]
    points = [("1", "BIFUBOBUTO®", []), ("1", "Bifubobuto / Bifuyibuto", ["Bifuyibuto"]), ("2", "Bifuyibuto 25 mg", []), ("4", "Bifubboobuto", None), ("9", "Lonely", []), ("1", "bifubobuto xr", [])]
    got = classes(names.product_classes(spark.createDataFrame(jobs + jobs[:1], JOB).withColumn("node", F.lit("clash")), spark.createDataFrame(points, POINT)))
    assert got == {frozenset(x) for x in ({"Bifubobuto", "BIFUBOBUTO®", "Bifbobuto", "Bifubo.", "Bifubboobuto"}, {"Bifuyibuto", "Bifuyibuto 25 mg"}, {"Bifubobuto XR", "bifubobuto xr"}, {"Lonely"})}
    assert names.product_classes(spark.createDataFrame([], JOB), spark.createDataFrame([], POINT)).count() == 0


def test_affiliates_stay_apart(spark):
    typed = ["Saje & Pomazo Oncology S.A.", "Saje and Pomazo Onc.", "Pomazo & Saje Oncology", "Saje & Pomazo Biologics AG", "S. Pomazo Oncology", "Pomazo", "Tibo Humuro Biologics", "Humuro", "Tiob Humuro Biologics", None, "Inc."]
    df = spark.createDataFrame([(str(i), None, None, m, None) for i, m in enumerate(typed)], JOB)
    got = {c for c in classes(names.company_classes(df)) if len(c) > 1}
    assert got == {frozenset({"Saje & Pomazo Oncology S.A.", "Saje and Pomazo Onc.", "Pomazo & Saje Oncology", "S. Pomazo Oncology"}), frozenset({"Tibo Humuro Biologics", "Humuro", "Tiob Humuro Biologics"})}
    pairs = names.variant_pairs(names.company_classes(df), "manufacturer").collect()
    assert all(r.name_a < r.name_b for r in pairs) and len(pairs) == 9


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(20)], "a string, b string")
    nodes = spark.createDataFrame([(f"n{i:02}",) for i in range(22)], "node string")
    got = {r.node: r["class"] for r in names.components(edges, nodes).collect()}
    assert got == {f"n{i:02}": "n00" if i <= 20 else "n21" for i in range(22)}


# --- problem 6 ---------------------------------------------------------------------------------

FULL = "id string, job_id string, source_id string, product_label string, period string, period_type string, geography string, scope string, value_as_reported double, fx_rate_to_usd double, value_normalized_usd_millions double, source_quote string, normalization_status string, rounding_uncertainty_usd_millions double, combined_with array<string>, extracted_at timestamp"


def point(i, source, status="ok", usd=1.0, quote="q", label="Alpha", period="2020Q1", geo="US", combined=()):
    return (i, "j", source, label, period, "quarterly", geo, None, 1.0, None, usd, quote, status, None, list(combined), datetime(2021, 1, 1))


def test_survivors_in_order_and_field_by_field(spark):
    src = spark.createDataFrame([("s1", "SEC-FILING", "2020-01-01"), ("s2", "transcript", "n.d."), ("s3", "sec_filing", "1 Feb 2021".replace("1 Feb", "01 Feb")), ("s3", "sec_filing", "01 Feb 2021")], "id string, source_type string, source_date string")
    jobs = spark.createDataFrame([("j", "Alpha", None, None, None)], JOB)
    pts = [point("a", "s1"), point("b", "s3", usd=None), point("c", "s2", quote="other"), point("d", "s1", status="derived", geo="U.S."), point("e", None, geo=None), point("f", "s1", period="2020", geo="US"), point("g", "s1", label="Alpha / Beta", combined=["Beta"]), point("h", "s2", label="alpha ", geo="united states")]
    got = {(r.product, r.period_key, r.place): r for r in survivors.survivors(survivors.readings(spark.createDataFrame(pts + pts[:2], FULL).withColumn("doubt", F.lit(1)), src, jobs)).collect()}
    assert len(got) == 4
    best = next(r for k, r in got.items() if k[1:] == ("2020Q1", "united-states") and "&" not in k[0])
    assert (best.datapoint_id, best.n_readings) == ("a", 5)
    pts2 = [point("a", "s1"), point("b", "s3")]
    one = survivors.survivors(survivors.readings(spark.createDataFrame(pts2, FULL), src, jobs)).first()
    assert one.datapoint_id == "b"
    pts3 = [point("a", "s1", usd=None, quote=None, status="ok"), point("b", "s2", usd=7.0, status="late")]
    one = survivors.survivors(survivors.readings(spark.createDataFrame(pts3, FULL), src, jobs)).first()
    assert (one.datapoint_id, one.value_normalized_usd_millions, one.source_quote) == ("a", 7.0, "q")
    assert survivors.survivors(survivors.readings(spark.createDataFrame([], FULL), src, jobs)).count() == 0
