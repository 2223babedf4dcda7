"""Number and unit expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_number(raw: Column) -> Column:
    """Text in any of the usual styles to a double; ``''``, ``n/a``, ``-`` and other words are null.

    ``(1.5)`` is -1.5; commas or spaces group thousands; ``1.234,5`` is read
    with a decimal comma; a plus sign, exponents and outer spaces are allowed.
    """
    s = F.regexp_replace(F.regexp_replace(F.trim(raw), r"[\s ]", ""), "[−–]", "-")
    inner = F.regexp_replace(s, r"^\((.*)\)$", "-$1")
    plain = F.when(inner.rlike(r"^[-+]?\d{1,3}(\.\d{3})+,\d+$"), F.translate(F.translate(inner, ".", ""), ",", ".")).otherwise(F.translate(inner, ",", ""))
    ok = plain.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$")
    return F.when(ok, plain.try_cast("double"))


def percent_change(current: Column, prior: Column) -> Column:
    return F.try_divide(current - prior, prior) * 100


def looks_like_change(candidate: Column, current: Column, prior: Column) -> Column:
    """Whether a figure is the percent change of its neighbours, within 0.6 points."""
    return F.coalesce(F.abs(candidate - percent_change(current, prior)) <= 0.6, F.lit(False))


def declared_bound(decimals: Column) -> Column:
    """Half a unit in the last declared place, in millions; INF is exact, null is unknown."""
    return F.when(decimals == "INF", F.lit(0.0)).otherwise(F.pow(F.lit(10.0), -decimals.try_cast("int")) / 2e6)


def agrees(left: Column, right: Column, bound: Column) -> Column:
    """Two figures agree within twice the declared bound, or 0.5 percent where none is declared, and 0.05 at least."""
    slack = F.coalesce(2 * bound, 0.005 * F.greatest(F.abs(left), F.abs(right)))
    return F.abs(left - right) <= F.greatest(slack, F.lit(0.05))


def rounding_tolerance(parts: Column) -> Column:
    return 0.5 * (parts + 1)


def band_for_peers(count: Column) -> Column:
    return F.when(count < 2, "low").when(count < 5, "medium").when(count.isNotNull(), "high")


def peak_bucket(value: Column) -> Column:
    return F.when(value < 500, "<500").when(value <= 1000, "500-1000").when(value.isNotNull(), ">1000")


# Words in a free-text unit and their scale to millions, first hit counts.
UNIT_WORDS = [("billion", 1000.0), ("thousand", 0.001), ("million", 1.0)]


def scale_to_millions(value: Column, unit: Column) -> Column:
    """Scale by a free-text unit; anything unknown counts as millions."""
    u = F.lower(F.coalesce(unit, F.lit("")))
    case = F.lit(1.0)
    for word, scale in reversed(UNIT_WORDS):
        case = F.when(u.contains(word), scale).otherwise(case)
    return value * case


def usd_only_millions(value: Column, unit: Column) -> Column:
    return F.when(unit == "USD", value / 1e6)


def spellings(value: Column) -> Column:
    """Ways a figure may be printed: plain, grouped, with up to three decimals."""
    forms = [F.format_number(value, d) for d in (0, 1, 2, 3)]
    same = [F.abs(F.round(value, d) - value) < 1e-9 for d in (0, 1, 2, 3)]
    each = [F.when(ok, form) for ok, form in zip(same, forms)]
    plain = [F.translate(e, ",", "") for e in each]
    return F.array_compact(F.array_distinct(F.array(*plain, *each)))


def declared_decimals(raw: Column) -> Column:
    s = F.trim(raw)
    return F.when(s == "32767", "INF").when(s != "", s)
