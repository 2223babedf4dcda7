"""Products researched into manifests, the lines that accompany them, and how often each is read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How a line may carry on from a series that stopped.
RELATIONS = ["broader_line", "successor_issuer", "renamed_line", "narrower_line"]
STILL_REPORTED = 3  # quarters a series may lag behind the newest figure of all and still count as reported


def researched_products(rows: DataFrame, meta: DataFrame, fx_rates: DataFrame) -> DataFrame:
    """Manifest rows with their stem's metadata and the value in US dollars.

    ``rows``: stem, period (year first), value, currency, and any more; ``meta``:
    one row per stem. What a row states itself (an issuer, a currency) holds over
    the metadata; a currency that is missing is USD. Adds ``usd`` and
    ``problem`` (``missing_rate`` where the year has no rate). A stem without
    metadata keeps nulls. Rates are a fixed table of a few hundred rows.
    """
    shared = [x for x in meta.columns if x != "stem" and x in rows.columns]
    m = meta.select("stem", *[F.col(x).alias(f"_{x}" if x in shared else x) for x in meta.columns if x != "stem"])
    j = rows.join(m, "stem", "left")
    j = j.select(*[F.coalesce(F.col(x), F.col(f"_{x}")).alias(x) if x in shared else F.col(x) for x in rows.columns], *[x for x in m.columns if x != "stem" and x[1:] not in shared])
    j = j.withColumn("currency", F.coalesce("currency", F.lit("USD"))).withColumn("_year", F.substring("period", 1, 4).try_cast("int"))
    rate = fx_rates.groupBy(F.col("currency").alias("_c"), F.col("calendar_year").alias("_y")).agg(F.max("usd_per_unit").alias("_rate"))
    j = j.join(F.broadcast(rate), (F.col("currency") == F.col("_c")) & (F.col("_year") == F.col("_y")), "left")
    home = F.col("currency") == "USD"
    out = j.withColumn("usd", F.when(home, F.col("value")).otherwise(F.col("value") * F.col("_rate"))).withColumn("problem", F.when(~home & F.col("_rate").isNull(), "missing_rate"))
    return out.drop("_c", "_y", "_rate", "_year")


def companion_lines(lines: DataFrame) -> DataFrame:
    """Lines an issuer printed beside a product's series, with ``role`` and ``problem``.

    ``lines``: product, why_separate, relation (null for a plain companion),
    line_includes, evidence, lo (the line's first period) and gold_end (the last
    of the product's own series). A line must say why it stands apart and belong
    to a product with a series; a continuation must name a known relation, quote
    its evidence, list what a broader line holds, and begin after the series
    ends. ``role`` is ``companion``, ``continuation`` or ``refused``, with the
    first problem found.
    """
    goes_on = F.col("relation").isNotNull()
    none = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    problem = (
        F.when(F.col("product").isNull() | (F.col("gold_end").isNull() & ~goes_on), "product_without_series")
        .when(none("why_separate"), "no_reason_to_stand_apart")
        .when(goes_on & ~F.col("relation").isin(RELATIONS), "unknown_relation")
        .when((F.col("relation") == "broader_line") & (F.coalesce(F.size("line_includes"), F.lit(0)) <= 0), "contents_not_listed")
        .when(goes_on & none("evidence"), "no_evidence")
        .when(goes_on & F.col("gold_end").isNull(), "nothing_to_continue")
        .when(goes_on & (F.col("lo") <= F.col("gold_end")), "overlaps_the_series")
    )
    out = lines.withColumn("problem", problem)
    return out.withColumn("role", F.when(F.col("problem").isNotNull(), "refused").when(goes_on, "continuation").otherwise("companion"))


def cadence(figures: DataFrame, key: str, index: str) -> DataFrame:
    """(key, cadence, due): a series of two quarters or more that is still reported is read ``quarterly``, next for the quarter after its last; any other once (``one_off``)."""
    s = figures.filter(F.col(key).isNotNull() & F.col(index).isNotNull()).groupBy(key).agg(F.max(index).alias("last"), F.count_distinct(index).alias("n"))
    now = s.agg(F.max("last").alias("now"))  # one row
    going = (F.col("last") >= F.col("now") - STILL_REPORTED) & (F.col("n") >= 2)
    return s.join(F.broadcast(now)).select(key, F.when(going, "quarterly").otherwise("one_off").alias("cadence"), F.when(going, F.col("last") + 1).alias("due"))
