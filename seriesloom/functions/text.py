"""Text, name and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesloom.vocab import MISSING_SPELLINGS, PERIODIC_FORMS, REGISTRANT_CONNECTIVES, REGISTRANT_SUFFIXES


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def analog_key(name: Column) -> Column:
    return F.lower(collapse(name))


def normalize_value(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "), r"[\s.]+$", "")))


def is_missing(c: Column) -> Column:
    v = F.lower(F.regexp_replace(collapse(c), r"^\.+|\.+$", ""))
    return c.isNull() | v.isin(MISSING_SPELLINGS)


def conflicting(a: Column, b: Column) -> Column:
    """Neither missing, different, and neither inside the other."""
    x, y = normalize_value(a), normalize_value(b)
    return F.coalesce(~is_missing(a) & ~is_missing(b) & (x != "") & (y != "") & (x != y) & ~x.contains(y) & ~y.contains(x), F.lit(False))


def registrant(name: Column) -> Column:
    """A filer's name without punctuation, legal forms and connectives, order kept."""
    parts = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9&\s]", " "), r"\s+", " ")), " ")
    drop = F.array(*[F.lit(w) for w in [*REGISTRANT_SUFFIXES, *REGISTRANT_CONNECTIVES]])
    return F.array_join(F.filter(parts, lambda w: ~F.array_contains(drop, w) & (w != "")), " ")


def form_family(form: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.upper(F.coalesce(form, F.lit(""))), r"^([^/\s]*)", 1), "T+$", "")


def reports_a_period(form: Column) -> Column:
    return form.isNotNull() & (form != "") & form_family(form).isin(PERIODIC_FORMS)


def exhibit_number(declared: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(F.trim(declared)), r"^EX-(\d+)", 1), F.lit(""))


def states_item(items: Column, item: str) -> Column:
    return F.array_contains(F.transform(F.split(F.coalesce(items, F.lit("")), ","), lambda x: F.trim(x)), item)


def canonical_member(member: Column) -> Column:
    local = F.regexp_replace(F.element_at(F.split(member, ":"), -1), "Member$", "")
    return F.regexp_replace(F.lower(local), "[^a-z0-9]", "")


def split_camel(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])", " "), r"(?<=[A-Z])(?=[A-Z][a-z])", " ")


def member_words(c: Column) -> Column:
    local = F.regexp_replace(F.element_at(F.split(c, ":"), -1), "Member$", "")
    return F.filter(F.split(F.lower(split_camel(local)), "[^a-z0-9]+"), lambda w: w != "")


def candidates_fingerprint(products: Column) -> Column:
    kept = F.array_sort(F.array_distinct(F.filter(F.transform(products, lambda p: F.trim(p)), lambda p: p != "")))
    return F.substring(F.sha2(F.array_join(kept, "\n"), 256), 1, 16)


def product_identity(brand: Column, parts: list[Column]) -> Column:
    """Folded brand, a colon and the first 24 hex digits of a hash over the parts."""
    body = F.concat_ws("::", *[F.lower(F.coalesce(p, F.lit(""))) for p in parts])
    return F.concat(analog_key(brand), F.lit(":"), F.substring(F.sha2(body, 256), 1, 24))


def route_terms(values: Column) -> Column:
    terms = F.transform(F.split(F.coalesce(values, F.lit("")), r"[;,/]"), lambda t: F.lower(collapse(t)))
    return F.array_sort(F.array_distinct(F.filter(terms, lambda t: t != "")))


def clean_label(cell: Column) -> Column:
    """A row label without trademark signs and footnote marks."""
    return collapse(F.regexp_replace(F.regexp_replace(cell, r"[®™*†‡§]|\((?:TM|R|SM)\)", ""), r"\s*(?:\(\d{1,2}\)|\[\d{1,2}\])\s*$", ""))


def product_aliases(product: Column, generic: Column) -> Column:
    """Brand and generic, split on bars, commas and semicolons, without parentheticals; of three letters or more, each once whatever its case."""
    raw = F.concat(F.array(product, generic), F.split(F.coalesce(product, F.lit("")), r"[|,;/]"), F.split(F.coalesce(generic, F.lit("")), r"[|,;/]"))
    plain = F.transform(F.array_compact(raw), lambda a: collapse(F.regexp_replace(a, r"\([^)]*\)", " ")))
    kept = F.filter(plain, lambda a: F.length(a) >= 3)
    empty = F.array().cast("array<string>")
    return F.aggregate(kept, empty, lambda acc, a: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(a)), acc).otherwise(F.array_append(acc, a)))


def mentions(quote: Column, aliases: Column) -> Column:
    q, spaced = F.lower(collapse(F.coalesce(quote, F.lit("")))), F.lower(collapse(split_camel(F.coalesce(quote, F.lit("")))))
    return F.exists(aliases, lambda a: q.contains(F.lower(a)) | spaced.contains(F.lower(collapse(split_camel(a)))))


def quote_contains(quote: Column, value: Column) -> Column:
    """Whether the quote spells the value in one of its plain forms, commas ignored; ties round to even as in C."""
    q = F.lower(F.translate(F.coalesce(quote, F.lit("")), ",", ""))
    trimmed = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", value), "0+$", ""), r"\.$", "")
    return F.coalesce(q.contains(trimmed) | q.contains(F.translate(F.format_number(value, 1), ",", "")) | q.contains(F.translate(F.format_number(value, 0), ",", "")), F.lit(False))


def verbatim(quote: Column, source: Column, least: int = 1) -> Column:
    """The quote stands in the source, exactly or up to whitespace."""
    q, s = collapse(quote), collapse(source)
    return F.coalesce((F.length(F.trim(quote)) >= least) & (source.contains(quote) | s.contains(q)), F.lit(False))


def fetchable(url: Column) -> Column:
    """http(s) with a public host."""
    scheme, host = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|0\.|::1|172\.(1[6-9]|2\d|3[01])\.)") | host.rlike(r"\.(internal|local)$")
    return F.coalesce(F.lower(scheme).isin("http", "https") & (host != "") & ~private, F.lit(False))


def reason_code(reason: Column) -> Column:
    """The code in front of a recorded reason: ``[code] prose``."""
    return F.nullif(F.regexp_extract(reason, r"^\[([a-z0-9_]+)\]", 1), F.lit(""))


def segments_map(segments: Column) -> Column:
    """``axis=member;axis=member;`` to a map; blank parts are dropped, of a repeated axis the last counts."""
    pairs = F.filter(F.split(F.coalesce(segments, F.lit("")), ";"), lambda p: p.contains("="))
    entries = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.trim(F.substring_index(p, "=", -1)).alias("value")))
    empty = F.expr("cast(array() as array<struct<key:string,value:string>>)")
    last = F.aggregate(entries, empty, lambda acc, e: F.concat(F.filter(acc, lambda x: x["key"] != e["key"]), F.array(e)))
    return F.map_from_entries(last)


def number_tokens(text: Column) -> Column:
    """The figures of a row, parentheses negative; leading small whole numbers (footnote marks) are dropped."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"-?\(?\d[\d,]*\.?\d*\)?"), 0)
    read = F.transform(raw, lambda t: F.struct(
        (F.when(t.startswith("(") & t.endswith(")"), -1.0).otherwise(1.0) * F.translate(F.regexp_replace(t, r"[()]", ""), ",", "").try_cast("double")).alias("v"), t.contains(".").alias("dot")))
    read = F.filter(read, lambda x: x["v"].isNotNull())
    empty = F.array().cast("array<double>")
    mark = lambda x: ~x["dot"] & (F.abs(x["v"]) < 10)
    return F.aggregate(read, empty, lambda acc, x: F.when((F.size(acc) == 0) & mark(x), acc).otherwise(F.array_append(acc, x["v"])))


def comparative_value(quote: Column, current: Column) -> Column:
    """The prior year's figure where arithmetic proves the row's layout, else null."""
    n = number_tokens(quote)
    at = lambda i: F.try_element_at(n, F.lit(i))
    change = (F.size(n) >= 3) & (F.abs(at(1) - at(2) - at(3)) <= 0.15)
    percent = (F.size(n) < 4) | (at(2) == 0) | (F.abs(100 * F.try_divide(at(1) - at(2), at(2)) - at(4)) <= 1.5)
    one = F.coalesce(change & percent & (F.abs(at(1) - current) <= 0.15), F.lit(False))
    half = (F.size(n) / 2).cast("int")
    first, second = F.slice(n, 1, F.greatest(half, F.lit(1))), F.slice(n, half + 1, F.greatest(half, F.lit(1)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    closes = lambda a: F.abs(total(a) - 2 * F.try_element_at(a, F.lit(-1))) <= 0.15
    even = F.coalesce((F.size(n) >= 6) & (F.size(n) % 2 == 0) & closes(first) & closes(second), F.lit(False))
    hit = F.filter(F.arrays_zip(first.alias("a"), second.alias("b")), lambda z: F.abs(z["a"] - current) <= 0.15)
    return F.when(one, at(2)).when(even, F.try_element_at(hit, F.lit(1))["b"])
