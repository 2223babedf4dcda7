"""Period and date expressions (Column in, Column out; no Python per row).

A period key is ``YYYYQn`` (quarter), ``YYYYHn`` (half), ``YYYYM9`` (nine
months) or ``YYYY`` (year). A quarter index is ``year * 4 + quarter - 1``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months in which a quarter ends or which name it.
QUARTER_WORDS = {
    "first": 1, "second": 2, "third": 3, "fourth": 4,
    "march": 1, "june": 2, "september": 3, "december": 4,
    "jan-mar": 1, "apr-jun": 2, "jul-sep": 3, "oct-dec": 4,
}
# Span in months by period type.
TYPE_MONTHS = {"quarterly": 3, "six_month": 6, "nine_month": 9, "annual": 12}


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it.

    Binds through a one-element array, which keeps generated code small where
    the optimizer would copy a long expression into a filter and a projection.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _year(text: Column) -> Column:
    """A year of four digits, or of two in this century."""
    n = text.cast("int")
    return F.when(F.length(text) == 2, n + 2000).otherwise(n)


def _word(text: Column) -> Column:
    case = F.lit(None).cast("int")
    for word, n in QUARTER_WORDS.items():
        case = F.when(text == word, n).otherwise(case)
    return case


def period_label(raw: Column) -> Column:
    """Free text to a period key; null where the text names no single period.

    >>> # " 2008Q1 ", "Q1-08", "1Q08", "QTR 1, 2008", "first quarter 2008",
    >>> # "Three months ended March 31, 2008", "Jan-Mar 2008" -> 2008Q1
    """
    s = F.lower(F.trim(F.regexp_replace(raw, r"[\s ]+", " ")))
    ex = lambda pattern, i: F.regexp_extract(s, pattern, i)
    lead = r"^(\d{4})[-/ ]?q([1-4])$"
    tail = r"^(?:q([1-4])|([1-4])q|qtr ([1-4]),?)[-/ ]*'?(\d{4}|\d{2})$"
    word = r"^(?:(first|second|third|fourth) quarter|(?:three|3) months ended (march|june|september|december) \d{1,2},?|(jan-mar|apr-jun|jul-sep|oct-dec))(?: of)? (\d{4})$"
    half = r"^(?:([12])h|h([12])|(first|second) half)(?: of)?[- ]?(\d{4})$"
    half_lead = r"^(\d{4})[-/ ]?h([12])$"
    nine = r"^(?:(?:nine|9) months ended september \d{1,2},?|9m) ?(\d{4})$"
    nine_lead = r"^(\d{4})[-/ ]?m9$"
    six = r"^(?:six|6) months ended june \d{1,2},? (\d{4})$"
    year = r"^(?:fy ?|full year |(?:year|twelve months|12 months) ended december \d{1,2},? )?((?:19|20)\d{2})$"
    key = lambda y, mark, n: F.concat(y.cast("string"), F.lit(mark), n.cast("string"))
    tail_q = F.concat(ex(tail, 1), ex(tail, 2), ex(tail, 3))
    word_q = _word(F.concat(ex(word, 1), ex(word, 2), ex(word, 3)))
    half_h = F.concat(ex(half, 1), ex(half, 2), F.when(ex(half, 3) == "first", "1").when(ex(half, 3) == "second", "2").otherwise(""))
    return (
        F.when(s.rlike(lead), key(ex(lead, 1), "Q", ex(lead, 2)))
        .when(s.rlike(tail), key(_year(ex(tail, 4)), "Q", tail_q))
        .when(s.rlike(word), key(ex(word, 4), "Q", word_q))
        .when(s.rlike(year), ex(year, 1))
        .when(s.rlike(half), key(ex(half, 4), "H", half_h))
        .when(s.rlike(half_lead), key(ex(half_lead, 1), "H", ex(half_lead, 2)))
        .when(s.rlike(nine), key(ex(nine, 1), "M", F.lit("9")))
        .when(s.rlike(nine_lead), key(ex(nine_lead, 1), "M", F.lit("9")))
        .when(s.rlike(six), key(ex(six, 1), "H", F.lit("1")))
    )


def quarter_index(label: Column) -> Column:
    """Quarter key to its index; null for any other label or a year before 1900."""

    def index(k: Column) -> Column:
        ok = k.rlike(r"^(?:19|20|21)\d{2}Q[1-4]$")
        return F.when(ok, F.substring(k, 1, 4).cast("int") * 4 + F.substring(k, 6, 1).cast("int") - 1)

    return let(label, index)


def quarter_label(index: Column) -> Column:
    return F.concat(F.floor(index / 4).cast("string"), F.lit("Q"), (F.pmod(index, F.lit(4)) + 1).cast("string"))


def quarter_of_month(month: Column) -> Column:
    return F.floor((month - 1) / 3).cast("int") + 1


def label_of(year: Column, months: Column, quarter: Column) -> Column:
    """(year, span in months, quarter) to a key; null for a span that has none."""
    y = year.cast("string")
    return (
        F.when((months == 3) & quarter.isNotNull(), F.concat(y, F.lit("Q"), quarter.cast("string")))
        .when(months == 6, F.concat(y, F.lit("H"), F.when(quarter > 2, "2").otherwise("1")))
        .when(months == 9, F.concat(y, F.lit("M9")))
        .when(months == 12, y)
    )


def period_months(key: Column) -> Column:
    """Span of a key in months; null where it is no key."""
    return (
        F.when(key.rlike(r"^\d{4}Q[1-4]$"), 3).when(key.rlike(r"^\d{4}H[12]$"), 6)
        .when(key.rlike(r"^\d{4}M9$"), 9).when(key.rlike(r"^\d{4}$"), 12)
    )


def period_end(key: Column) -> Column:
    """Last day of a key's span."""
    y = F.substring(key, 1, 4).cast("int")
    n = F.substring(key, 6, 1).cast("int")
    month = (
        F.when(period_months(key) == 3, n * 3).when(period_months(key) == 6, n * 6)
        .when(period_months(key) == 9, F.lit(9)).when(period_months(key) == 12, F.lit(12))
    )
    return F.last_day(F.make_date(y, month, F.lit(1)))


def period_start(key: Column) -> Column:
    return F.add_months(F.date_add(period_end(key), 1), -period_months(key))


def period_span(key: Column, months: Column) -> Column:
    """(first day, last day), null when the key and the span disagree."""
    return F.when(period_months(key) == months, F.struct(period_start(key).alias("start"), period_end(key).alias("end")))


def quarter_end(year: Column, quarter: Column) -> Column:
    return F.last_day(F.make_date(year, quarter * 3, F.lit(1)))


def fiscal_month(month: Column, day: Column, year: Column) -> Column:
    """Month and year a fiscal period belongs to: an end in the first seven days is the month before's."""
    back = day <= 7
    return F.struct(
        F.when(back & (month == 1), 12).when(back, month - 1).otherwise(month).alias("month"),
        F.when(back & (month == 1), year - 1).otherwise(year).alias("year"),
    )


def months_between_calendar(start: Column, end: Column) -> Column:
    """Calendar months between two dates, days ignored."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def date_quarter_index(day: Column) -> Column:
    return (F.year(day) * 4 + F.quarter(day) - 1).cast("int")


def year_before(key: Column) -> Column:
    """The same key one year earlier."""
    return F.when(period_months(key).isNotNull(), F.concat((F.substring(key, 1, 4).cast("int") - 1).cast("string"), F.substring(key, 5, 10)))


def era(year: Column, width: int = 5) -> Column:
    """Bucket of years as ``2005-2009``."""
    low = F.floor(year / width) * width
    return F.when(year.isNotNull(), F.concat(low.cast("string"), F.lit("-"), (low + width - 1).cast("string")))


def loose_date(text: Column) -> Column:
    """Lenient text to date: ISO, ISO with time, ``yyyymmdd``, ``27 Dec 2011``, ``August 12, 2011``."""
    s = F.trim(text)
    return (
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"))
        .when(s.rlike(r"^\d{8}$"), F.try_to_date(s, "yyyyMMdd"))
        .when(s.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4}$"), F.try_to_date(s, "d MMM yyyy"))
        .when(s.rlike(r"^\d{1,2} [A-Za-z]{4,9} \d{4}$"), F.try_to_date(s, "d MMMM yyyy"))
        .when(s.rlike(r"^[A-Za-z]{4,9} \d{1,2},? \d{4}$"), F.try_to_date(F.regexp_replace(s, ",", ""), "MMMM d yyyy"))
        .when(s.rlike(r"^[A-Za-z]{3} \d{1,2},? \d{4}$"), F.try_to_date(F.regexp_replace(s, ",", ""), "MMM d yyyy"))
    )
