"""Name linking beyond the shapes of the test tables: literal rows."""

from seriesloom.llm import names

JOB = "id string, drug_name string, generic_name string, manufacturer string, ticker string"
POINT = "job_id string, product_label string, combined_with array<string>"


def classes(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["class"], set()).add(r["name"])
    return {frozenset(v) for v in found.values()}


def test_a_long_core_keeps_its_abbreviations(spark):
    whole = "Bifubobutosaremilonapetu"  # 24 letters; the third name is its first twenty
    jobs = [("1", whole, "bifubozumab", None, None), ("2", whole[:9], "bifubozumab", None, None), ("3", whole[:20], "tiporanib", None, None)]
    got = classes(names.product_classes(spark.createDataFrame(jobs, JOB), spark.createDataFrame([], POINT)))
    assert got == {frozenset({whole, whole[:9]}), frozenset({whole[:20]})}


def companies(spark, typed):
    return classes(names.company_classes(spark.createDataFrame([(str(i), None, None, m, t) for i, (m, t) in enumerate(typed)], JOB)))


def test_a_fieldless_slip_links_from_either_side(spark):
    # cores tibohumuro and tibohumura, then tibohumuro and tibohumurz: the slip sorts before and after the name
    for slip in ("Tibo Humura", "Tibo Humurz"):
        assert companies(spark, [("Tibo Humuro Biologics", None), (slip, None)]) == {frozenset({"Tibo Humuro Biologics", slip})}
    # candidates of two fields, one sorting before and one after the slip, are no answer
    got = companies(spark, [("Tibo Humuro Biologics", None), ("Tibo Humurs", None), ("Tibo Humurz Oncology", None)])
    assert frozenset({"Tibo Humurs"}) in got


def test_one_name_companies_have_classes(spark):
    typed = [("Acme Inc.", None), ("ACME", None), ("Acmee Ltd", None), ("Zorbit Oncology", None), ("Zorbit Onc. AG", None), ("Zorbit Biologics", None), ("Zorbit", None), ("Q. Velmar", None), ("Q. Velmar Inc.", None)]
    typed += [("Kolvex", "KV"), ("Kolvexx", "KX")]  # tickers veto
    typed += [("Saje Pomazo Oncology", None), ("Saje Pomazo Biologics", None), ("Pomazo", None), ("Pomazo Inc.", None)]  # two companies answer
    want = [{"Acme Inc.", "ACME", "Acmee Ltd"}, {"Zorbit Oncology", "Zorbit Onc. AG"}, {"Zorbit Biologics"}, {"Zorbit"}, {"Q. Velmar", "Q. Velmar Inc."}, {"Kolvex"}, {"Kolvexx"}]
    want += [{"Saje Pomazo Oncology"}, {"Saje Pomazo Biologics"}, {"Pomazo"}, {"Pomazo Inc."}]
    assert companies(spark, typed) == {frozenset(x) for x in want}


def slow_join(every, radius):
    from itertools import combinations

    from seriesloom.llm import edits

    pairs = list(combinations(sorted(every), 2))
    a, la, _ = edits.encode([p for p, _ in pairs])
    b, lb, _ = edits.encode([q for _, q in pairs])
    return {(p, q): int(d) for (p, q), d in zip(pairs, edits.distances(a, la, b, lb)) if d <= radius}


def test_every_pair_within_the_radius_in_any_script(spark):
    import random

    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeабвгдかきくけ") for _ in range(rng.randrange(1, 12))) for _ in range(30)] + ["".join(rng.choice("abc") for _ in range(n)) for n in (29, 30, 31, 32, 33, 34, 35, 40)]
    every = set(base)
    for s in base:
        for _ in range(3):
            t = s
            for _ in range(rng.randrange(1, 3)):
                i = rng.randrange(len(t) + 1)
                t = rng.choice([t[:i] + "x" + t[i:], t[:i] + t[i + 1 :], t[: max(i - 2, 0)] + t[max(i - 2, 0) : i][::-1] + t[i:], t[: max(i - 2, 0)] + t[max(i - 2, 0) : i][::-1][:1] + "я" + t[max(i - 2, 0) : i][::-1][1:] + t[i:]])
            every.add(t)
    every.discard("")
    df = spark.createDataFrame([(s,) for s in every], "n string")
    for radius in (1, 2):
        assert {(r.a, r.b): r.d for r in names.radius_join(df, "n", radius).collect()} == slow_join(every, radius)


def test_long_names_meet(spark):
    import random

    from seriesloom.llm import edits

    rng = random.Random(5)
    long = ["".join(rng.choice("abc ") for _ in range(n)) for n in (70, 200, 900)]
    near = [s[:50] + "x" + s[51:] + "y" for s in long] + [s[1:-1] for s in long] + [s[:-6] + s[-5] + s[-6] + s[-4:] for s in long]
    got = {(r.a, r.b): r.d for r in names.radius_join(spark.createDataFrame([(s,) for s in long + near], "n string"), "n", 2).collect()}
    for s in long:
        for t in (s[:50] + "x" + s[51:] + "y", s[1:-1]):
            assert got[min(s, t), max(s, t)] == 2
        assert sum(s in p for p in got) == 3
    for _ in range(300):  # the banded form against the whole table
        x = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 8)))
        y = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 8)))
        (a, la, _), (b, lb, _) = edits.encode([x]), edits.encode([y])
        assert edits.within(x, y, 2) == min(3, int(edits.distances(a, la, b, lb)[0]))


def test_comparisons_grow_with_the_names(spark):
    """Pairs compared, on names and variants doubled twice, grow by less than the power 1.3."""
    import math
    import random

    rng = random.Random(4)
    made = []
    for _ in range(1200):
        s = "".join(rng.choice("bdfghjklmnprstvwyz") + rng.choice("aeiou") for _ in range(rng.randrange(4, 7)))
        made += [s] + [s[:i] + s[i + 1 :] for i in rng.sample(range(len(s)), 2)]
    counts = [names.candidate_pairs(spark.createDataFrame([(x,) for x in made[:n]], "n string"), "n", 2).count() for n in (900, 1800, 3600)]
    assert math.log(counts[2] / counts[0], 4) < 1.3


def test_names_of_every_script_have_classes(spark):
    jobs = [("1", "Нурофен", None, None, None), ("2", "НУРОФЕН®", None, None, None), ("3", "Нурафен", None, None, None), ("4", "ガスター", None, None, None), ("5", "カスター", None, None, None), ("6", "123", None, None, None), ("7", "--", None, None, None), ("8", " ", None, None, None), ("9", "®", None, None, None)]
    got = classes(names.product_classes(spark.createDataFrame(jobs, JOB), spark.createDataFrame([], POINT)))
    assert got == {frozenset(x) for x in ({"Нурофен", "НУРОФЕН®", "Нурафен"}, {"ガスター", "カスター"}, {"123"}, {"--"}, {"®"})}
    firms = ["Фарм Сервис", "ФАРМ-СЕРВИС", "武田薬品", "Inc.", "", None]
    assert companies(spark, [(m, None) for m in firms]) == {frozenset(x) for x in ({"Фарм Сервис", "ФАРМ-СЕРВИС"}, {"武田薬品"}, {"Inc."})}


def test_short_and_far_abbreviated_names_with_one_generic(spark):
    jobs = [("1", "Bobuto", "bifubozumab", None, None), ("2", "Babtuto", "bifubozumab", None, None), ("3", "Bob.", "bifubozumab", None, None), ("4", "Babuta", None, None, None)]
    got = classes(names.product_classes(spark.createDataFrame(jobs, JOB), spark.createDataFrame([], POINT)))
    assert got == {frozenset({"Bobuto", "Babtuto", "Bob."}), frozenset({"Babuta"})}  # two edits in six letters, and no generic to bear them out


def test_a_field_cut_short_is_that_field(spark):
    assert names.read_company("Vara & Funore Therap. Ltd.") == (["funore", "vara"], "therapeutics", "")
    assert names.read_company("Vara Labor. Bio.") == (["bio", "vara"], "laboratories", "")  # "bio" begins three fields
    assert companies(spark, [("Kifi & Fejute Therapeutics", None), ("Kifi & Fejute Therap.", None), ("K. Fejute Therapeutics", None)]) == {frozenset({"Kifi & Fejute Therapeutics", "Kifi & Fejute Therap.", "K. Fejute Therapeutics"})}
