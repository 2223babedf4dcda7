"""Variant spellings of names typed by people (problem 3).

Method: metric-space partitioning under the unrestricted Damerau-Levenshtein
metric. The pivots are the sub-spellings of the names: what is left when up to
as many letters are left out as the radius allows. A name lies at a distance of
at most the radius from each of its pivots and is replicated to all of their
cells; two names within the radius always share one, since each edit can be
undone by leaving one letter out on either side; and by the triangle inequality
no cell holds names further apart than twice the radius. Inside the cells the
exact radius join runs with the true metric. Pivots drawn from among the names
themselves do not part them: at radius two nearly every name lies within the
bound of nearly every such pivot.

What a name consists of (brand, generic, strength, formulation; proper names,
field of business, legal form) is read off first, so the metric compares cores.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm.edits import distances, encode, sub_spellings, within
from seriesloom.operators.prose import ACCENTS
from seriesloom.session import cut_lineage, write_once

HEAD = 32  # longer names meet by their first letters, which bounds the pivots of a name
SLIP, STEM = 4, 2  # where no generic name bears a link out: a slip edits at most a quarter of the letters, an abbreviation keeps at least half

# Words that make a formulation of a brand.
FORMULATIONS = {
    "xr", "er", "sr", "cr", "la", "ir", "dr", "sc", "iv", "im", "nasal", "pediatric", "paediatric", "plus", "depot",
    "oral", "forte", "duo", "odt", "inhaled", "inhaler", "hfa", "patch", "gel", "topical", "junior", "combo", "xl",
}
# Endings of nonproprietary names.
GENERIC_ENDINGS = ("mab", "nib", "prazole", "sartan", "stat", "statin", "cept", "limod", "rasib", "ciclib", "gliptin", "gliflozin", "ase", "tide", "vir")
# Fields of business and their short forms.
FIELDS = {
    "pharmaceuticals": ["pharmaceuticals", "pharmaceutical", "pharms", "pharm", "pharma"],
    "therapeutics": ["therapeutics", "therapeutic", "tx", "ther", "thera"],
    "biologics": ["biologics", "biologic", "biol", "biologicals"],
    "medicines": ["medicines", "medicine", "meds", "med"],
    "laboratories": ["laboratories", "laboratory", "labs", "lab"],
    "biosciences": ["biosciences", "bioscience", "biosci", "biosc"],
    "oncology": ["oncology", "onc", "onco", "oncol"],
    "biotech": ["biotech", "biotechnology", "biotechnologies"],
    "healthcare": ["healthcare", "health"],
    "sciences": ["sciences", "science", "sci"],
    "genetics": ["genetics", "genomics"],
}
# Legal forms and fillers, without dots.
LEGAL = {
    "sa", "nv", "plc", "inc", "incorporated", "holdings", "holding", "hldgs", "hldg", "ag", "gmbh", "corp", "corporation", "ltd", "limited", "llc", "lp", "co",
    "company", "kg", "kgaa", "spa", "ab", "as", "bv", "se", "oyj", "kk", "group", "the", "and", "et", "und", "societe", "anonyme", "aktiengesellschaft",
}
_DIGITS = str.maketrans("01356894", "olesbbga")


def fold(s: str) -> str:
    """Lower case without odd spaces; Latin letters without accents, other scripts with their marks."""
    out: list[str] = []
    latin = False
    for c in unicodedata.normalize("NFKD", s):
        if not unicodedata.combining(c):
            latin = c < "\u0250"
        elif latin:
            continue
        out.append(c)
    return " ".join(unicodedata.normalize("NFC", "".join(out)).lower().split())


def _letters(s: str) -> str:
    """The letters of every script, with their marks; digits that look like letters, inside a word, are read as those."""
    s = re.sub(r"(?<=[a-z])[01356894](?=[a-z.]|$)|^[01356894](?=[a-z])", lambda m: m[0].translate(_DIGITS), s)
    return "".join(c for c in s if c.isalpha() or unicodedata.category(c)[0] == "M")


def read_product(raw: str) -> tuple[str, str, str, bool]:
    """(core, formulation, generic, abbreviated) of a product name as typed."""
    s = re.sub(r"\((?:tm|r|c)\)|[®™©*]", " ", raw, flags=re.I)
    s = re.sub(r"\s+tm\s*$|\s+tm(?=\s)", " ", s, flags=re.I)
    s = re.sub(r"\b\d+(?:[.,]\d+)?\s*(?:mg|mcg|µg|ug|g|ml|iu|units?|%)(?:\s*/\s*\d*\s*ml)?(?![a-z])", " ", s, flags=re.I)
    s = " ".join(s.split())
    generic = ""
    m = re.fullmatch(r"(.+?)\s*[(\[](.+?)[)\]]\s*(.*)", s) or re.fullmatch(r"(.+?)(?:\s+[-–—]\s+|\s*[,;]\s+)(.+)()", s)
    if m:
        a, b = m[1].strip(), m[2].strip()
        ga, gb = (fold(x).endswith(GENERIC_ENDINGS) and " " not in x for x in (a, b))
        first = (a[:1].islower() and b[:1].isupper()) if ga == gb else ga
        brand, generic = (b, a) if first else (a, b)
        s = f"{brand} {m[3]}".strip()
    tokens = [t for t in re.split(r"[\s\-_/]+", fold(s)) if t]
    form = ""
    while len(tokens) > 1 and tokens[-1].strip(".") in FORMULATIONS:
        form = f"{tokens.pop().strip('.')} {form}".strip()
    form = form.replace("paediatric", "pediatric")
    short = bool(tokens) and tokens[-1].endswith(".")
    # a name without a letter is compared by what it has
    return _letters("".join(tokens)) or "".join(tokens) or "".join(fold(raw).split()), form, _letters(fold(generic)), short


_FIELD_OF = {alias: name for name, aliases in FIELDS.items() for alias in aliases}


@lru_cache(maxsize=1 << 16)
def _field(token: str, dotted: bool) -> str | None:
    """The field a token means: a known form of it, the beginning of just one, or a long one with a slip or two."""
    if token in _FIELD_OF:
        return _FIELD_OF[token]
    begun = [name for name in FIELDS if name.startswith(token)]
    if len(token) >= (3 if dotted else 5) and len(begun) == 1:
        return begun[0]
    if len(token) < 7:
        return None
    c, n, _ = encode([token] * len(FIELDS))
    k, m, _ = encode(list(FIELDS))
    d = distances(c, n, k, m)
    return list(FIELDS)[int(d.argmin())] if d.min() <= 2 else None


def read_company(raw: str) -> tuple[list[str], str, str]:
    """(proper names, field of business, initial) of a company name as typed."""
    s = re.sub(r"\b([A-Za-z])\.(?=[A-Za-z]\.?)", r"\1", raw)  # N.V. -> NV.
    s = re.sub(r"\b(?:BioSci|BioTech|GmbH|KGaA|SpA)", lambda m: m[0].capitalize(), s)
    s = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", s)
    names, field, initial = [], "", ""
    for token in re.split(r"[\s,;&/+\-]+", fold(s)):
        dotted, t = token.endswith("."), _letters(token)
        if not t or (t in LEGAL and not (dotted and len(t) == 1)):
            continue
        if len(t) == 1:
            initial = t
            continue
        f = _field(t, dotted)
        if f and not field:
            field = f
        else:
            names.append(t)
    # a name of nothing but legal forms, fields or signs is a proper name as it stands
    return sorted(names) or [x for x in ("".join(fold(raw).split()),) if x], field, initial if names else ""


# --- exact radius join -------------------------------------------------------------------------


def cells(names: DataFrame, radius: int) -> DataFrame:
    """(key, s, host, guest): each name of column ``s`` in the cell of each of its pivots.

    A name is its own host and guest up to HEAD letters less the radius. A longer
    one is host with its first HEAD letters and guest with every beginning that
    a host's can be aligned with: those at most ``radius`` longer or shorter.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = pdf["s"].tolist()
            heads = [(i, n[:m], m == min(HEAD, len(n))) for i, n in enumerate(s) for m in sorted({min(HEAD + k, len(n)) for k in range(-radius, radius + 1)})]
            row, key = sub_spellings([h for _, h, _ in heads], radius)
            yield pd.DataFrame({"key": key, "s": [s[heads[r][0]] for r in row], "host": [heads[r][2] for r in row]})

    out = names.select("s").mapInPandas(run, "key long, s string, host boolean")
    return out.groupBy("key", "s").agg(F.max("host").alias("host"))


def _distances_within(a: list[str], b: list[str], radius: int) -> np.ndarray:
    """Distances of pairs, right where they are within the radius; long names apart, the others by blocks of bounded memory."""
    out = np.full(len(a), radius + 1, np.int32)
    short = []
    for i, (x, y) in enumerate(zip(a, b)):
        if max(len(x), len(y)) > 2 * HEAD:
            out[i] = within(x, y, radius)
        else:
            short.append(i)
    for at in range(0, len(short), 2000):
        part = short[at : at + 2000]
        (ca, la, _), (cb, lb, _) = encode([a[i] for i in part]), encode([b[i] for i in part])
        out[part] = distances(ca, la, cb, lb)
    return out


def candidate_pairs(names: DataFrame, column: str, radius: int) -> DataFrame:
    """(a, b): the pairs a < b of distinct strings that share a cell, each once; every pair within ``radius`` is among them."""
    n = names.select(F.col(column).alias("s")).filter("s is not null and s != ''").distinct()
    c = write_once(cells(n, radius))
    shared = c.filter("host").select("key", F.col("s").alias("x")).join(c.select("key", F.col("s").alias("y")), "key").filter("x != y")
    return shared.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().filter(F.abs(F.length("a") - F.length("b")) <= radius)


def radius_join(names: DataFrame, column: str, radius: int) -> DataFrame:
    """(a, b, d): all pairs a < b of distinct strings within ``radius`` (one or two) of the edit metric.

    The join on cells is an equi-join that AQE may split where many names share
    a pivot; its result is written once. Nulls and empty strings join nothing.
    """

    @F.pandas_udf(T.IntegerType())
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_distances_within(a.tolist(), b.tolist(), radius), dtype="int32")

    return write_once(candidate_pairs(names, column, radius).withColumn("d", distance("a", "b")).filter(F.col("d") <= radius))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, class): the least node each node is linked with, by rounds of least-neighbour and short-cut steps.

    Only links between different spellings come here, so classes are small and
    the rounds few; each round is written to the checkpoint folder.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both)
    label = nodes.select("node", F.col("node").alias("class"))
    while True:
        for _ in range(2):  # two steps settle most classes, which are a name and its variants
            seen = both.join(label.select(F.col("node").alias("b"), "class"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("seen"))
            step = label.join(seen, "node", "left").select("node", F.least("class", "seen").alias("class"))
            root = step.select(F.col("node").alias("class"), F.col("class").alias("root"))
            label = step.join(root, "class", "left").select("node", F.least("class", "root").alias("class"))
        label = cut_lineage(label)
        ends = both.filter("a < b").join(label.select(F.col("node").alias("a"), F.col("class").alias("ca")), "a").join(label.select(F.col("node").alias("b"), F.col("class").alias("cb")), "b")
        if ends.filter("ca != cb").isEmpty():
            return label


# --- products ----------------------------------------------------------------------------------

_PRODUCT = T.StructType([T.StructField("core", T.StringType()), T.StructField("form", T.StringType()), T.StructField("said", T.StringType()), T.StructField("short", T.BooleanType())])
_COMPANY = T.StructType([T.StructField("names", T.ArrayType(T.StringType())), T.StructField("field", T.StringType()), T.StructField("initial", T.StringType())])


@F.pandas_udf(_PRODUCT)
def _products(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_product(x) for x in s], columns=["core", "form", "said", "short"])


@F.pandas_udf(_COMPANY)
def _companies(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_company(x) for x in s], columns=["names", "field", "initial"])


# a condition on what they return must not move them before the distinct names
_products, _companies = _products.asNondeterministic(), _companies.asNondeterministic()


def _modes(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent non-null value per key, the least of equals; counted before it is ranked."""
    counts = rows.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(key, value).count()
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("count")).alias("c"), F.col(value).alias("v"))).alias("m")).select(key, F.col("m.v").alias(value))


def product_classes(drug_jobs: DataFrame, datapoints: DataFrame) -> DataFrame:
    """(name, class) of every string of ``drug_name`` and ``product_label`` that names one product.

    Labels for two products are left out. Strings link when their cores are
    equal, within two edits, or one an abbreviation of the other, the
    formulation is the same, and the generic names known of them (from the
    string, its jobs, or the job of a datapoint) are one. Where none is known of
    one side, an edited name must keep three quarters of its letters and an
    abbreviation half; then the label links to its job's product and otherwise
    only to its nearest, best attested candidate. Letters of every script
    count; a name without letters is compared by its figures and signs. Null
    and blank strings name nothing and have no class.
    """
    jobs = drug_jobs.select("id", "drug_name", F.regexp_replace(F.translate(F.lower(F.trim("generic_name")), *ACCENTS), r"[^\p{L}\p{M}]", "").alias("generic")).distinct()
    labels = datapoints.filter(F.coalesce(F.size("combined_with"), F.lit(0)) <= 0).select("job_id", F.col("product_label").alias("name")).filter("name is not null")
    labels = labels.groupBy("job_id", "name").count()
    generics = _modes(jobs.select("id", "generic"), "id", "generic")
    typed = jobs.select(F.col("drug_name").alias("name"), "id").filter("name is not null")
    seen = typed.unionByName(labels.select("name", F.col("job_id").alias("id"))).join(generics, "id", "left").select("name", "generic")
    seen = seen.groupBy("name", "generic").count()
    known = _modes(seen.select("name", "generic"), "name", "generic")
    parsed = seen.select("name").distinct().select("name", _products("name").alias("p")).select("name", "p.*")
    parsed = cut_lineage(parsed.join(known, "name", "left").select("name", "core", "form", "short", F.coalesce(F.when(F.col("said") != "", F.col("said")), "generic").alias("generic")).filter("core != ''"))

    # one node per core and formulation; its generic is the commonest of its strings', its weight their number
    node = F.concat_ws("|", "core", "form")
    weight = parsed.groupBy(node.alias("node"), "core", "form").agg(F.count("*").alias("w"), F.max("short").alias("short"))
    nodes = cut_lineage(weight.join(_modes(parsed.select(node.alias("node"), "generic"), "node", "generic"), "node", "left"))

    near = radius_join(nodes, "core", 2)
    cut = nodes.select("core", F.explode(F.sequence(F.lit(2), F.greatest(F.length("core") - 2, F.lit(2)))).alias("n"))
    cut = cut.filter("n <= length(core) - 2").select(F.col("core").alias("b"), F.expr("substring(core, 1, n)").alias("a"), F.lit(1).alias("d")).distinct()
    stems = cut.join(nodes.select(F.col("core").alias("a")).distinct(), "a").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d")
    close = near.unionByName(stems).groupBy("a", "b").agg(F.min("d").alias("d"))

    side = lambda x: nodes.select(*[F.col(c).alias(f"{c}_{x}") for c in ("node", "core", "form", "generic", "w")])
    pairs = close.join(side("x"), F.col("a") == F.col("core_x")).join(side("y"), (F.col("b") == F.col("core_y")) & (F.col("form_x") == F.col("form_y")))
    pairs = cut_lineage(pairs.select("node_x", "node_y", "core_x", "core_y", "d", "generic_x", "generic_y", "w_x", "w_y"))  # read three times below
    both = F.col("generic_x").isNotNull() & F.col("generic_y").isNotNull()
    agreed = pairs.filter(both & (F.col("generic_x") == F.col("generic_y"))).select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))
    # without a generic on both sides a lone spelling links to its nearest, best attested candidate, if that is near enough
    shorter, longer = F.least(F.length("core_x"), F.length("core_y")), F.greatest(F.length("core_x"), F.length("core_y"))
    slip, stem = (longer - shorter <= 2) & (SLIP * F.col("d") <= shorter), (longer - shorter >= 2) & (STEM * shorter >= longer) & (F.col("d") == 1)
    loose = pairs.filter(~both & (slip | stem))
    of = parsed.select("name", node.alias("node"))
    told = labels.select("name", F.col("job_id").alias("id")).join(jobs.select("id", "drug_name"), "id").select("name", "drug_name").distinct()
    told = told.join(of.withColumnRenamed("node", "a"), "name").join(of.select(F.col("name").alias("drug_name"), F.col("node").alias("b")), "drug_name").filter("a != b")
    told = told.select(F.least("a", "b").alias("node_x"), F.greatest("a", "b").alias("node_y")).distinct()
    key = loose.select("*", F.least("node_x", "node_y").alias("k"), F.greatest("node_x", "node_y").alias("l"))
    same_job = key.join(told.select(F.col("node_x").alias("k"), F.col("node_y").alias("l")), ["k", "l"], "left_semi").select(F.col("k").alias("a"), F.col("l").alias("b"))
    loose = write_once(loose.filter(~_other_syllable("core_x", "core_y", "d")))
    column = lambda x, y: loose.select(F.col(f"node_{x}").alias("a"), F.col(f"node_{y}").alias("b"), "d", F.col(f"w_{y}").alias("w"), F.col(f"generic_{x}").alias("own"), F.col(f"generic_{y}").alias("its"))
    toward = column("x", "y").unionByName(column("y", "x")).filter("own is null")
    doubt = F.col("d") + F.when(F.col("its").isNotNull() | (F.col("w") >= 3), 0).otherwise(1)
    best = toward.groupBy("a").agg(F.min(F.struct(doubt.alias("d"), (-F.col("w")).alias("w"), "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    found = components(agreed.unionByName(same_job).unionByName(best), nodes.select("node"))
    return parsed.select("name", node.alias("node")).join(found, "node").select("name", "class")


def other_syllable(a: str, b: str) -> bool:
    """Two edits in one place, a vowel in both, and no swap of letters: another name's syllable rather than a slip."""
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    q = 0
    while q < min(len(a), len(b)) - p and a[-1 - q] == b[-1 - q]:
        q += 1
    x, y = a[p : len(a) - q], b[p : len(b) - q]
    return max(len(x), len(y)) in (2, 3) and sorted(x) != sorted(y) and all(set(m) & set("aeiou") for m in (x, y))


@F.pandas_udf(T.BooleanType())
def _other_syllable(a: pd.Series, b: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([k == 2 and other_syllable(x, y) for x, y, k in zip(a, b, d)])


# --- companies ---------------------------------------------------------------------------------


def _mirrored(pairs: DataFrame) -> DataFrame:
    """A radius join's pairs in both orders."""
    return pairs.select("a", "b", "d").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))


def _by_field(j: DataFrame) -> DataFrame:
    """(a, b): the links among candidate pairs, which come in both orders, that fields and tickers allow."""
    veto = F.coalesce(F.col("ticker_x") != F.col("ticker_y"), F.lit(False)) & (F.col("d") > 0)
    agreed = j.filter((F.col("field_x") == F.col("field_y")) & (F.col("field_x") != "") & ~veto).select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))
    # no field: only where all candidates state one field
    bare = j.filter((F.col("field_x") == "") & ~veto).groupBy("node_x").agg(F.count_distinct(F.when(F.col("field_y") != "", F.col("field_y"))).alias("k"), F.min(F.struct(F.col("d"), F.col("node_y"))).alias("m"))
    bare = bare.filter("k <= 1").select(F.col("node_x").alias("a"), F.col("m.node_y").alias("b"))
    return agreed.unionByName(bare)


def company_classes(drug_jobs: DataFrame) -> DataFrame:
    """(name, class) of every manufacturer string but null and blank ones.

    Proper names may be reordered, joined, mistyped (two edits), or cut to an
    initial or to one name; legal forms count for nothing; fields of business
    must agree where both are stated. A string without a field or with one name
    only links where exactly one company answers. Tickers that differ veto.
    Where none answers, strings of one name are companies of their own, linked
    among themselves within one edit; where several do, a string stands alone.
    """
    rows = drug_jobs.select(F.col("manufacturer").alias("name"), F.upper(F.trim("ticker")).alias("ticker")).filter("name is not null")
    seen = rows.groupBy("name", "ticker").count()
    ticker = _modes(seen.select("name", "ticker"), "name", "ticker")
    parsed = seen.select("name").distinct().select("name", _companies("name").alias("p")).select("name", "p.*").join(ticker, "name", "left")
    core = F.array_join("names", "")
    parsed = cut_lineage(parsed.withColumn("core", core).filter("core != ''").withColumn("node", F.concat_ws("|", F.concat_ws("+", "names"), "field", "initial")))
    nodes = cut_lineage(parsed.groupBy("node", "names", "core", "field", "initial").agg(F.min("ticker").alias("ticker"), F.count("*").alias("w")))
    full = nodes.filter("size(names) >= 2 and initial = ''")
    part = nodes.filter("size(names) = 1 or initial != ''")

    # full names: cores within the radius; names are kept in alphabetical order, so a slip in a
    # first letter may turn them round and both orders are joined
    turned = F.array_join(F.reverse("names"), "")
    both = full.select("node", F.explode(F.array_distinct(F.array("core", turned))).alias("c"))
    near = radius_join(both, "c", 2)
    same = both.select(F.col("c").alias("a"), F.col("c").alias("b"), F.lit(0).alias("d")).distinct()
    sides = _mirrored(near).unionByName(same)
    info = lambda x: full.select("node", "field", "ticker", "names").select(*[F.col(c).alias(f"{c}_{x}") for c in ("node", "field", "ticker", "names")])
    j = sides.join(both.select(F.col("c").alias("a"), F.col("node").alias("node_x")), "a").join(both.select(F.col("c").alias("b"), F.col("node").alias("node_y")), "b")
    j = j.filter("node_x != node_y").groupBy("node_x", "node_y").agg(F.min("d").alias("d")).join(info("x"), "node_x").join(info("y"), "node_y")
    j = cut_lineage(j.select("node_x", "node_y", "d", "field_x", "field_y", "ticker_x", "ticker_y"))
    joined = components(_by_field(j), full.select("node"))

    # one name, with or without an initial: by each proper name within one edit
    known = full.join(joined, "node").select("class", "field", "ticker", "names")
    words = known.select("class", "field", "ticker", "names", F.explode("names").alias("word"))
    typed = part.select("node", "field", "ticker", "initial", F.col("names")[F.size("names") - 1].alias("word"), (F.size("names") == 1).alias("single"))
    close = radius_join(words.select("word").unionByName(typed.select("word")), "word", 1)
    close = _mirrored(close).unionByName(words.select("word").unionByName(typed.select("word")).distinct().select(F.col("word").alias("a"), F.col("word").alias("b"), F.lit(0).alias("d")))
    hits = typed.select(*[F.col(c).alias(f"p_{c}") for c in typed.columns]).join(close, F.col("p_word") == F.col("a")).join(words, F.col("b") == F.col("word"))
    first = F.exists("names", lambda n: (n != F.col("word")) & n.startswith(F.col("p_initial")))
    fits = ((F.col("p_field") == "") | (F.col("field") == "") | (F.col("p_field") == F.col("field"))) & ((F.col("p_initial") == "") | first)
    fits = fits & F.coalesce(F.col("p_ticker") == F.col("ticker"), F.lit(True))
    hits = write_once(hits.filter(fits).groupBy("p_node", "class").agg(F.min("d").alias("d")))
    nearest = hits.groupBy("p_node").agg(F.min("d").alias("d"))
    hits = hits.join(nearest, ["p_node", "d"])
    one = hits.groupBy("p_node").agg(F.count("*").alias("k"), F.min("class").alias("class")).filter("k = 1").select(F.col("p_node").alias("node"), "class")

    # no company answers: one-name nodes among themselves; several answer: each string by itself
    alone = cut_lineage(typed.join(hits.select(F.col("p_node").alias("node")).distinct(), "node", "left_anti"))
    end = lambda x: alone.filter("single").select(*[F.col(c).alias(f"{c}_{x}") for c in ("node", "field", "ticker", "initial", "word")])
    k = end("x").join(close, F.col("word_x") == F.col("a")).join(end("y"), (F.col("b") == F.col("word_y")) & (F.col("initial_x") == F.col("initial_y")))
    k = k.filter((F.col("node_x") != F.col("node_y")) & F.coalesce(F.col("ticker_x") == F.col("ticker_y"), F.lit(True)))
    own = components(_by_field(k), alone.select("node"))
    classes = joined.unionByName(one).unionByName(own)
    lone = F.concat_ws("|", "node", "name")
    return parsed.select("name", "node").join(classes, "node", "left").select("name", F.coalesce("class", lone).alias("class"))


def variant_pairs(classes: DataFrame, kind: str) -> DataFrame:
    """(kind, name_a, name_b): each two different strings of a class, the smaller first by code point."""
    a, b = classes.select("class", F.col("name").alias("name_a")), classes.select("class", F.col("name").alias("name_b"))
    return a.join(b, "class").filter("name_a < name_b").select(F.lit(kind).alias("kind"), "name_a", "name_b").distinct()
