"""Geographies as a small controlled vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings (squashed: lower case, no dots, single spaces) and the place they mean.
PLACES = {
    "worldwide": ["worldwide", "global"],
    "united-states": ["us", "usa", "united states"],
    "ex-united-states": ["ex us", "outside of us", "outside the us", "rest of world"],
    "north-america": ["north america", "americas"],
    "europe": ["europe"],
    "japan": ["japan"],
}


def squash(raw: Column) -> Column:
    """Without dots, lower, everything else that is no letter or digit a space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(raw), r"\.", ""), r"[^a-z0-9]+", " "))


def slug(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(raw), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def normalize_geography(raw: Column) -> Column:
    """The place meant; ``unspecified`` for null or wordless; ``unrecognised-<slug>`` for other words."""
    s = squash(raw)
    known = F.create_map(*[F.lit(x) for place, names in PLACES.items() for n in names for x in (n, place)])
    return F.when(raw.isNull() | (s == ""), "unspecified").otherwise(F.coalesce(F.try_element_at(known, s), F.concat(F.lit("unrecognised-"), slug(s))))
