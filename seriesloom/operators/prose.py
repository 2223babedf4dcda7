"""Readers of labels, notes and prose.

All are column expressions but two: the evidence windows and the cover of
quarters by filings, whose every step depends on the ones before.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Wordings of places in a row label, the first that fits counting.
PLACES = [
    ("International", r"\b(?:ex|outside|non)[- ](?:the )?(?:u\.?s\b|united states)|\binternational\b|\boverseas\b"),
    ("United States", r"\bu\.s\.|\bus\b|\busa\b|\bunited states\b|\bdomestic\b"),
    ("Worldwide", r"\bworldwide\b|\bglobal\b|\bworld\b"),
    ("Rest of world", r"\brest of\b|\brow\b"),
    ("Other", r"\bother\b"),
]
PLACE_WORDS = ["ex", "outside", "non", "the", "u", "s", "us", "usa", "united", "states", "international", "overseas", "domestic", "worldwide", "global", "world", "rest", "of", "row", "other"]
# Words of sums, of lines for several products, and words that say nothing of which product is meant.
SUM_WORDS = ["total", "subtotal", "sum"]
GROUP_WORDS = ["other", "others", "all", "combined", "franchise", "portfolio", "group", "remaining", "sundry", "products"]
PLAIN_WORDS = ["net", "gross", "sales", "sale", "revenue", "revenues", "turnover", "product", "brand", "line", "in", "for", "from", "by", "and", "with", "plus", "reported", "restated"]

ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
LETTER_OR_DIGIT = r"[\p{L}\p{N}]+"
# A stop after a small letter, digit or closing mark ends a sentence; one after a capital is an initial's.
STOP, BREAKS, LOOSE_LINE = r"([\p{Ll}\p{N})%\"”’][.!?;])\s+([\p{Lu}\p{N}(\"“])", r"[\r\n•▪◦●]+", r"[\r\n•▪◦●]+(?=[^\p{L}\r\n•▪◦●]*(?:[\r\n•▪◦●]|\z))"
RISE_OR_FALL = r"(?i)\b(?:rose|risen|rising|grew|grown|growing|climbed|gained|advanced|added|fell|fallen|falling|slid|slipped|dropped|lost|shrank|up|down|higher|lower|(?:in|de)creas\w+|declin\w+|reduc\w+)\b"
BY_AMOUNT = r"(?i)\bby (?:about |some |nearly |almost )?[^\d\s]{0,3}\s?(\d[\d,]*(?:\.\d+)?)"
TO_AMOUNT = r"(?i)\b(?:to|at|reached|of) (?:about |some |nearly |almost )?[^\d\s]{0,3}\s?(\d[\d,]*(?:\.\d+)?)"
QUARTER = r"(?:Q[1-4][ -/]?(?:19|20)\d{2}|(?:19|20)\d{2}[ -/]?Q[1-4]|[1-4]Q ?(?:19|20)\d{2}|(?:first|second|third|fourth) quarter (?:19|20)\d{2})"
MONEY = r"(?:\d[\d,]*(?:\.\d+)? (?:million|billion|thousand|crore|m))"
PAIRED, GROUPED = r"(?i)\brespectively\b|\bin turn\b", r"(?i)\b(?:together|combined|in total|altogether|sum of)\b"
DISEASE = r"(?:indicated for (?:the )?(?:treatment|relief|prevention) of|[Aa]pproval of [\p{L}\p{N} -]{2,60}? for|label of [\p{L}\p{N} -]{2,60}? lists|[Pp]atients with) ([\p{L}][\p{L}\p{N}'’ -]{2,80}?)(?: switched| came| at \d|[.,;(]| who | in (?:adults|children)|$)"
SETTING = r"(?i)\b(metastatic|adjuvant|neoadjuvant|maintenance|advanced|chronic|acute)\b"
POPULATION = r"(?i)\b(adults|adult patients|children|pediatric patients|adolescents|patients)\b"
MARKER = r"\b([A-Z][A-Z0-9]+(?:[-/][A-Z0-9]+)*[- ](?:positive|negative))\b"


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.lower(c), *ACCENTS), F.lit(LETTER_OR_DIGIT), 0)


def squash(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(c), *ACCENTS), r"[^\p{L}\p{N}]", "")


def _listed(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _none(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def near(a: Column, b: Column) -> Column:
    """A spelling variant: of five letters or more, at most a fifth of them edited."""
    return (F.length(a) >= 5) & (F.length(b) >= 5) & (F.levenshtein(a, b) * 5 <= F.greatest(F.length(a), F.length(b)))


# --- sentences -----------------------------------------------------------------------------------


def sentences(text: Column) -> Column:
    """The sentences in order, white space collapsed; null for null.

    Lines and bullets end a sentence, as do stops before a capital or a figure.
    A line without a letter belongs to the one above it, where there is one.
    """
    marked = F.regexp_replace(F.regexp_replace(text, LOOSE_LINE, " "), STOP, "$1\n$2")
    lines = F.transform(F.split(marked, BREAKS), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.filter(lines, lambda s: s != "")


def states_a_change(quote: Column, value: Column) -> Column:
    """The amount is what something rose or fell by, and is nowhere given as a level."""
    is_value = lambda t: F.coalesce(F.translate(t, ",", "").try_cast("double") == value, F.lit(False))
    said = lambda pattern: F.exists(F.regexp_extract_all(quote, F.lit(pattern), 1), is_value)
    return F.coalesce(quote.rlike(RISE_OR_FALL) & said(BY_AMOUNT) & ~said(TO_AMOUNT), F.lit(False))


# --- labels and notes ------------------------------------------------------------------------------


def read_label(label: Column, own: Column, others: Column) -> Column:
    """What the words of a row label account for.

    A struct of ``matched`` (the own name the label holds or, failing that, one
    that a word of it is a variant of), ``scope``, ``is_total``, ``combined``
    (other products named), ``residue`` (words nothing accounts for) and
    ``flags``. Null labels hold nothing; null lists are empty.
    """
    own, others = F.coalesce(own, _none()), F.coalesce(others, _none())
    text, joined = F.lower(F.coalesce(label, F.lit(""))), squash(F.coalesce(label, F.lit("")))
    holds = lambda n: (squash(n) != "") & joined.contains(squash(n))
    exact = F.try_element_at(F.filter(own, holds), F.lit(1))
    variant = F.try_element_at(F.filter(own, lambda n: F.exists(words(text), lambda w: near(w, squash(n)))), F.lit(1))
    matched, combined = F.coalesce(exact, variant), F.filter(others, holds)
    scope = F.lit(None).cast("string")
    for place, wording in reversed(PLACES):
        scope = F.when(text.rlike(wording), place).otherwise(scope)
    total = F.arrays_overlap(words(text), _listed(SUM_WORDS))
    known = F.concat(F.flatten(F.transform(F.concat(own, combined), words)), _listed(PLACE_WORDS + SUM_WORDS + PLAIN_WORDS))
    rest = F.filter(words(text), lambda w: ~F.array_contains(known, w) & ~F.exists(own, lambda n: near(w, squash(n))))
    residue = F.nullif(F.array_join(rest, " "), F.lit(""))
    flags = F.array_compact(F.array(F.when(matched.isNotNull() & residue.isNotNull(), "label_not_understood"), F.when(matched.isNotNull() & (F.size(combined) > 0), "combined_line")))
    return F.struct(matched.alias("matched"), scope.alias("scope"), total.alias("is_total"), combined.alias("combined"), residue.alias("residue"), flags.alias("flags"))


NO_SALES, PART_PERIOD = r"\bno (?:net )?sales\b|\bnot yet (?:on sale|launched|sold)\b|\bnothing was sold\b", r"\bpart of the (?:period|quarter|year)\b|\bsince (?:its |the )?(?:launch|acquisition)\b|\bup to (?:its |the )?(?:sale|divestment)\b"


def read_footnote(note: Column, own: Column, others: Column) -> Column:
    """A note's meaning: which other products it includes, no sales, part of a period only, own product named."""
    low = F.lower(F.coalesce(note, F.lit("")))
    own, others = F.coalesce(own, _none()), F.coalesce(others, _none())
    held = F.filter(others, lambda o: low.contains(F.lower(o)))
    includes = F.when(low.rlike(r"\binclud(?:es|ing|ed)\b|\btogether with\b"), held).otherwise(_none())
    return F.struct(includes.alias("includes"), low.rlike(NO_SALES).alias("no_sales"), low.rlike(PART_PERIOD).alias("partial"), F.exists(own, lambda a: low.contains(F.lower(a))).alias("names_own"))


JOINERS = r"(?i)\s*[+&;,/]\s*|\s+(?:and|with|plus)\s+"


def names_a_competing_product(label: Column, own: Column, siblings: Column) -> Column:
    """The first part of a label that is another product: one joined to others, a group of products, or a known sibling."""
    own, siblings = F.coalesce(own, _none()), F.coalesce(siblings, _none())
    meant = lambda p: F.array_join(F.filter(words(p), lambda w: ~F.array_contains(_listed(PLAIN_WORDS), w)), " ")
    parts = F.filter(F.transform(F.split(F.coalesce(label, F.lit("")), JOINERS), meant), lambda p: p != "")
    mine = lambda p: F.exists(own, lambda n: p.contains(F.array_join(words(n), " ")) | F.array_join(words(n), " ").contains(p) | near(F.translate(p, " ", ""), squash(n)))
    group = lambda p: F.forall(F.split(p, " "), lambda w: F.array_contains(_listed(GROUP_WORDS), w))
    known = lambda p: F.exists(siblings, lambda s: F.array_join(words(s), " ") == p)
    return F.try_element_at(F.filter(parts, lambda p: ~mine(p) & (group(p) | (F.size(parts) > 1) | known(p))), F.lit(1))


# --- figures in prose ------------------------------------------------------------------------------


def read_prose(text: Column, names: Column) -> Column:
    """(sentence, period, value, unit) of the figures prose states of a product.

    Taken are sentences that name the product, with as many quarters as amounts:
    one of each, or each amount beside its own quarter in turn, or a word that
    pairs them. Refused are sums over products, sentences with another
    product's trade mark, and amounts by which something changed.
    """
    ours = lambda s: F.exists(names, lambda n: (n != "") & F.lower(s).contains(F.lower(n)))
    marked = lambda s: F.forall(F.regexp_extract_all(s, F.lit(r"([\p{L}\p{N}-]+)[®™]"), 1), lambda m: F.exists(names, lambda n: F.lower(n).contains(F.lower(m))))
    kept = F.filter(sentences(text), lambda s: F.coalesce(ours(s) & marked(s) & ~s.rlike(GROUPED), F.lit(False)))

    def figures(s: Column) -> Column:
        level = F.regexp_replace(s, rf"(?i)\bby (?:about |some |nearly |almost )?{MONEY}\b", "by so much")
        tokens = F.regexp_extract_all(level, F.lit(rf"(?i)\b(?:{QUARTER}|{MONEY})\b"), 0)
        is_quarter = lambda t: t.rlike(rf"(?i)^{QUARTER}$")
        quarters, amounts = F.filter(tokens, is_quarter), F.filter(tokens, lambda t: ~is_quarter(t))
        later = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
        in_turn = F.forall(F.arrays_zip(later.alias("b"), F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))).alias("a")), lambda z: is_quarter(z["a"]) != is_quarter(z["b"]))
        fits = (F.size(quarters) > 0) & (F.size(quarters) == F.size(amounts)) & (in_turn | s.rlike(PAIRED))
        read = lambda z: F.struct(s.alias("sentence"), z["q"].alias("period"), F.translate(F.substring_index(z["a"], " ", 1), ",", "").try_cast("double").alias("value"), F.lower(F.substring_index(z["a"], " ", -1)).alias("unit"))
        return F.when(fits, F.transform(F.arrays_zip(quarters.alias("q"), amounts.alias("a")), read)).otherwise(F.array().cast("array<struct<sentence:string,period:string,value:double,unit:string>>"))

    return F.flatten(F.transform(kept, figures))


def parse_indications(text: Column) -> Column:
    """(disease, setting, population, biomarker) of the sentences that state an indication, each disease once."""
    blank = lambda c: F.nullif(c, F.lit(""))
    one = lambda s: F.struct(blank(F.trim(F.regexp_extract(s, DISEASE, 1))).alias("disease"), F.lower(blank(F.regexp_extract(s, SETTING, 1))).alias("setting"), F.lower(blank(F.regexp_extract(s, POPULATION, 1))).alias("population"), blank(F.regexp_extract(s, MARKER, 1)).alias("biomarker"))
    stated = F.filter(F.transform(sentences(text), one), lambda i: i["disease"].isNotNull())
    keys = F.transform(stated, lambda i: F.lower(i["disease"]))
    return F.filter(stated, lambda i, k: F.array_position(keys, F.lower(i["disease"])) == k + 1)


# --- greedy readers ----------------------------------------------------------------------------------


def evidence(text: str | None, names: list[str], reach: int = 900, most: int = 28, cap: int = 45_000) -> tuple[str, int, int]:
    """(passages, windows, mentions): the best windows around mentions, never overlapping, in the order of the text; the budget is the feature."""
    t = text or ""
    found = []
    for n in names:
        for m in re.finditer(re.escape(n), t, re.I) if n else ():
            a, b = max(0, m.start() - reach), min(len(t), m.end() + reach)
            found.append((-len(re.findall(r"\d[\d,.]*\s*(?:million|billion|m\b)|[$€£]\s*\d", t[a:b])), a, b))
    kept: list[tuple[int, int]] = []
    for _, a, b in sorted(found):
        if len(kept) < most and all(b <= x or a >= y for x, y in kept):
            kept.append((a, b))
    return "\n...\n".join(t[a:b] for a, b in sorted(kept))[:cap], len(kept), len(found)


EVIDENCE = T.StructType([T.StructField("passages", T.StringType()), T.StructField("windows", T.IntegerType()), T.StructField("mentions", T.IntegerType())])


@F.pandas_udf(EVIDENCE)
def evidence_windows(text: pd.Series, names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([evidence(t, list(n)) for t, n in zip(text, names)], columns=["passages", "windows", "mentions"])


def set_cover(filings: list[tuple[int, int, list[int]]], wanted: set[int], ceiling: int) -> list[tuple[int, int]]:
    """(row, quarter) of a greedy cover: most open quarters first, then reading order, then row; at most ``ceiling`` filings a quarter."""
    covered: set[int] = set()
    spent: dict[int, int] = {}
    chosen: list[tuple[int, int]] = []
    left = {row: (order, set(states) & wanted) for row, order, states in filings}
    while True:
        open_now = [(-len(q - covered), order, row) for row, (order, q) in left.items() if q - covered]
        if not open_now:
            return chosen
        _, _, row = min(open_now)
        new = {q for q in left.pop(row)[1] - covered if spent.get(q, 0) < ceiling}
        if not new:
            return chosen
        covered |= new
        for q in sorted(new):
            spent[q] = spent.get(q, 0) + 1
            chosen.append((row, q))
