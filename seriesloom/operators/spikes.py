"""Implausible spikes in measurements (problem 7).

Method: an undecimated wavelet decomposition of the logged series at scales one
and two, in its robust form, the multiscale median transform (Starck, Murtagh
and Bijaoui): the smooth of scale one is the median of three neighbours, that of
scale two the median of five values of the first, and the detail coefficients
are what each smooth takes away. A level shift or steady growth leaves no detail
in either, a lone value all of its height. Details are scaled by the series' own
median absolute detail of the linear transform; those beyond the threshold are
spikes. Runs of zero detail in the Haar transform of the values themselves
reveal frozen values, bounds reveal impossible ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.latest import quarter_rows
from seriesloom.session import write_once

# Words by which a quote explains a one-off surge.
EXPLAINED = (
    r"(?i)stocking|channel fill|bought forward|buy(?:ing)?[- ]?(?:in|forward)|pull[- ]?forward|tender|catch[- ]?up|single (?:government |bulk |large )?(?:purchase|order)"
    r"|one[- ](?:time|off)|will not recur|non-?recurring|exceptional|ahead of (?:the|a) |before the (?:holiday|price)|plant restart|stockpil|emergency"
)
FLOOR, STEEPNESS = 0.7, 1.2  # a log detail must exceed FLOOR + STEEPNESS * the series' scale
FROZEN = 4  # consecutive slots of one value


def mark_implausible(readings: DataFrame, key: str, index: str, value: str, rank: Column, record: str, explained: Column) -> DataFrame:
    """Flag readings that cannot be right given how their series otherwise behaves.

    Returns one row per (record, problem): ``impossible`` (zero or negative),
    ``spike`` (far above or below the slots around it, beyond the series' usual
    variation; surges that ``explained`` covers, steps, launches and ends of a
    series are none) and ``frozen`` (second and later of FROZEN or more
    consecutive slots of one value). Of several readings in a slot the one with
    the greatest ``rank`` speaks for it; the others are tested in its place
    against the same neighbours. Null and NaN values, keys and slots are left
    out; repeated rows of a record are one; an empty table gives none.

    The readings are written once, in the six columns needed, and read for each
    test. They are combined to one row per (key, slot) before the windows, so a
    hot key costs its slots only.
    """
    v = F.col(value).cast("double")
    rows = readings.select(
        F.col(key).alias("k"), F.col(index).alias("i"), v.alias("v"), rank.alias("rank"), F.col(record).alias("record"), F.coalesce(explained, F.lit(False)).alias("x")
    ).filter("k is not null and i is not null and v is not null and not isnan(v)")
    rows = write_once(rows)
    slots = rows.groupBy("k", "i").agg(F.max(F.struct("rank", "record", "v", "x")).alias("b"), F.min("record").alias("lo"), F.max("record").alias("hi"))
    slots = slots.select("k", "i", F.col("b.record").alias("record"), F.col("b.v").alias("v"), F.col("b.x").alias("x"), (F.col("lo") != F.col("hi")).alias("several"))
    marked = _frozen(slots)
    # zero and negative values have no place on a log scale; the series goes on without them
    log = details(marked.filter("v > 0").withColumn("y", F.ln("v")), "k", "i", "y")
    log = log.withColumn("spike", F.coalesce(_stands_out(F.col("y") - F.col("smooth")), F.lit(False)))
    told = log.select("k", "i", "record", "several", "l1", "r1", "l2", "r2", "c_l1", "c_r1", "c_l2", "c_r2", "scale", "spike")
    spikes = told.filter("spike").select("record", F.lit("spike").alias("problem"))
    # other readings of a slot take its place among its neighbours
    crowded = told.filter("several").drop("spike").withColumnRenamed("record", "winner")
    second = rows.filter("v > 0").select("k", "i", "record", F.ln("v").alias("y"), "x").join(crowded, ["k", "i"]).filter("record != winner")
    second = second.filter(_stands_out(F.col("y") - _replaced())).select("record", F.lit("spike").alias("problem"))
    frozen = marked.filter((F.col("run_length") >= FROZEN) & ~F.col("starts")).select("record", F.lit("frozen").alias("problem"))
    impossible = rows.filter("v <= 0").select("record", F.lit("impossible").alias("problem"))
    return impossible.unionByName(spikes).unionByName(second).unionByName(frozen).distinct().withColumnRenamed("record", record)


def _median(*values: Column) -> Column:
    return F.element_at(F.array_sort(F.array(*values)), len(values) // 2 + 1)


def details(series: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """The series with ``c`` (smooth of scale one), ``smooth`` (of scale two), the neighbours they rest on, and ``scale``.

    ``value - c`` and ``c - smooth`` are the detail coefficients of the two
    scales and add up to ``value - smooth``. Beyond the ends of a series its last
    values go on, so growth from a launch leaves no detail. ``scale`` is the
    median of the series' absolute linear details, as a standard deviation.
    """
    w = Window.partitionBy(key).orderBy(index)
    y = F.col(value)
    for n in (1, 2):
        series = series.withColumn(f"l{n}", F.lag(y, n).over(w)).withColumn(f"r{n}", F.lead(y, n).over(w))
    series = series.withColumn("c", _median(y, F.coalesce("l1", y), F.coalesce("r1", y)))
    series = series.withColumn("d", F.abs(y - (F.col("l1") + F.col("r1")) / 2)).withColumn("scale", F.expr(f"percentile(d, 0.5) over (partition by {key})") * 1.4826)
    for n in (1, 2):
        series = series.withColumn(f"c_l{n}", F.lag("c", n).over(w)).withColumn(f"c_r{n}", F.lead("c", n).over(w))
    return series.withColumn("smooth", _second(F.col("c"), [F.col(f"c_{x}") for x in ("l1", "r1", "l2", "r2")]))


def _second(c: Column, around: list[Column]) -> Column:
    """The median of five smooths of scale one; beyond an end the last one goes on."""
    l1, r1, l2, r2 = around
    return _median(c, F.coalesce(l1, c), F.coalesce(r1, c), F.coalesce(l2, l1, c), F.coalesce(r2, r1, c))


def _replaced() -> Column:
    """The smooth of scale two with another reading ``y`` in the slot: its own smooths and its neighbours' follow it."""
    y, l1, r1, l2, r2 = (F.col(c) for c in ("y", "l1", "r1", "l2", "r2"))
    c = _median(y, l1, r1)
    left, right = _median(l1, y, F.coalesce(l2, l1)), _median(r1, y, F.coalesce(r2, r1))
    return _second(c, [left, right, F.col("c_l2"), F.col("c_r2")])


def _stands_out(detail: Column) -> Column:
    """The coefficient exceeds the threshold, on a slot with neighbours on both sides; upward only where nothing explains it."""
    limit = FLOOR + STEEPNESS * F.coalesce(F.col("scale"), F.lit(0.0))
    inner = F.col("l1").isNotNull() & F.col("r1").isNotNull()
    return inner & (((detail > limit) & ~F.col("x")) | (detail < -limit))


def _frozen(slots: DataFrame) -> DataFrame:
    """Slots with ``starts`` (their Haar detail against the slot before is not zero) and ``run_length``, the slots of the run of zero detail they lie in."""
    w = Window.partitionBy("k").orderBy("i")
    zero = ((F.col("v") - F.lag("v").over(w)) / 2 == 0) & (F.lag("i").over(w) == F.col("i") - 1)
    runs = slots.withColumn("starts", ~F.coalesce(zero, F.lit(False))).withColumn("run", F.sum(F.col("starts").cast("int")).over(w))
    # the run's length by a second window on the same partitioning: no further shuffle
    return runs.withColumn("run_length", F.count("*").over(Window.partitionBy("k", "run")))


def revenue_implausible(revenue: DataFrame) -> DataFrame:
    """quarterly_revenue's single-quarter records that cannot be right."""
    rows = quarter_rows(revenue.withColumn("x", F.col("source_quote").rlike(EXPLAINED)), "series_identity", "value_reported", "reported_at", "row_id", "x")
    return mark_implausible(rows, "series_identity", "q", "value_reported", F.struct("reported_at", "row_id"), "row_id", F.col("x"))
