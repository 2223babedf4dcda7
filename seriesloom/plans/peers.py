"""Queries on competitors and analogs; parts stand in for products (see ``registry_entries`` and ``profiles``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.numeric import band_for_peers
from seriesloom.functions.periods import era
from seriesloom.operators import peers as P
from seriesloom.session import table, write_once

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


_LOTS = ["1L", "2L", "2L+", "3L+", "any"]


def registry_entries(spark: SparkSession, d: str) -> DataFrame:
    """Parts as registry entries: type is the disease, size the line, first shipment the launch."""
    ships = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min(F.to_date("l_shipdate")).alias("launched"))
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "direct").when(k % 4 == 1, "indirect").when(k % 4 == 2, "substitutable").otherwise("near_term_phase3")
    return table(spark, d, "part").join(ships, "p_partkey").select(
        k.alias("product_id"), F.col("p_type").alias("disease"), F.element_at(F.array(*[F.lit(x) for x in _LOTS]), (F.col("p_size") % 5 + 1).cast("int")).alias("lot"),
        F.when(k % 2 == 0, "metastatic").otherwise("Adjuvant").alias("setting"), F.lit("U.S.").alias("geography"), "launched", kind.alias("classification"), (F.col("p_size") % 2 == 0).alias("same_moa"), (F.col("p_size") % 3 == 0).alias("same_route"),
        F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_size").alias("size"),
    )


ENTRIES = (
    "ships AS (SELECT l_partkey AS p_partkey, min(CAST(l_shipdate AS DATE)) AS launched FROM lineitem GROUP BY 1), entries AS (SELECT p_partkey AS product_id, p_type AS disease, (['1L', '2L', '2L+', '3L+', 'any'])[p_size % 5 + 1] AS lot, "
    "CASE WHEN p_partkey % 2 = 0 THEN 'metastatic' ELSE 'Adjuvant' END AS setting, 'U.S.' AS geography, launched, CASE p_partkey % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'indirect' WHEN 2 THEN 'substitutable' ELSE 'near_term_phase3' END AS classification, "
    "p_size % 2 = 0 AS same_moa, p_size % 3 = 0 AS same_route, p_brand AS brand, p_name AS name, p_size AS size FROM part JOIN ships USING (p_partkey))"
)
_PEER = "{c} FILTER (e.product_id <> t.product_id)"
_SNAP = (
    "snap AS (SELECT t.product_id, t.geography, t.launched, (SELECT count(*) FROM entries x WHERE x.disease = t.disease AND x.lot = t.lot AND x.setting = t.setting) AS universe, "
    + ", ".join(f"CAST(count(*) FILTER (e.product_id <> t.product_id AND e.classification = '{c}') AS INT) AS {c}_count" for c in ("direct", "indirect", "substitutable", "near_term_phase3"))
    + ", CAST(count(*) FILTER (e.product_id <> t.product_id AND e.same_moa) AS INT) AS same_moa_count, CAST(count(*) FILTER (e.product_id <> t.product_id AND e.same_route) AS INT) AS same_route_count "
    "FROM entries t JOIN entries e ON e.disease = t.disease AND e.lot = t.lot AND e.setting = t.setting AND e.launched <= t.launched GROUP BY t.product_id, t.geography, t.launched, t.disease, t.lot, t.setting), "
    "snaps AS (SELECT *, direct_count + indirect_count + substitutable_count AS marketed_peer_count, direct_count * 1.0::DOUBLE + indirect_count * 0.5::DOUBLE + substitutable_count * 0.75::DOUBLE + near_term_phase3_count * 0.25::DOUBLE AS raw_score, CAST(NULL AS VARCHAR) AS reason, "
    "CASE WHEN direct_count + indirect_count + substitutable_count < 2 THEN 'low' WHEN direct_count + indirect_count + substitutable_count < 5 THEN 'medium' ELSE 'high' END AS category FROM snap)"
)


@query("q_j06_launch_peers", f"WITH {ENTRIES} SELECT t.product_id AS target_id, e.product_id AS peer_id, e.launched AS peer_launched, e.classification FROM entries t JOIN entries e ON e.disease = t.disease AND e.lot = t.lot AND e.setting = t.setting AND e.launched <= t.launched AND e.product_id <> t.product_id WHERE t.product_id % 50 = 0")
def j06(spark: SparkSession, d: str) -> DataFrame:
    e = registry_entries(spark, d)
    return P.launch_peers(e, e.filter("product_id % 50 = 0"))


@query("q_g04_snapshot", f"WITH {ENTRIES}, {_SNAP} SELECT * FROM snaps")
def g04(spark: SparkSession, d: str) -> DataFrame:
    return P.snapshots(registry_entries(spark, d))


@query("q_g05_universe_entries", f"WITH {ENTRIES} SELECT lower(disease) AS u_disease, lot, lower(setting) AS u_setting, count(*) AS n FROM entries GROUP BY ALL")
def g05(spark: SparkSession, d: str) -> DataFrame:
    return P.with_universe(registry_entries(spark, d)).groupBy("u_disease", "lot", "u_setting").agg(F.count("*").alias("n"))


@query("q_c23_categorize", f"WITH {ENTRIES}, {_SNAP} SELECT product_id, category, count(*) OVER () AS cohort_size FROM snaps")
def c23(spark: SparkSession, d: str) -> DataFrame:
    s = P.snapshots(registry_entries(spark, d)).select("product_id", "category")
    # the cohort's size is one number: a global count joined on a constant, not a window over one partition
    n = s.agg(F.count("*").alias("cohort_size")).withColumn("one", F.lit(1))
    return s.withColumn("one", F.lit(1)).join(F.broadcast(n), "one").drop("one")


@query("q_c25_compare_to_rule", f"WITH {ENTRIES}, {_SNAP} SELECT product_id, (['low', 'medium', 'high'])[product_id % 3 + 1] AS model_label, category AS rule_label, CASE WHEN product_id % 7 = 0 THEN NULL ELSE (['low', 'medium', 'high'])[product_id % 3 + 1] = category END AS agrees FROM snaps")
def c25(spark: SparkSession, d: str) -> DataFrame:
    label = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("product_id") % 3 + 1).cast("int"))
    return P.snapshots(registry_entries(spark, d)).select("product_id", label.alias("model_label"), F.col("category").alias("rule_label"), F.when(F.col("product_id") % 7 != 0, label == F.col("category")).alias("agrees"))


@query("q_j07_earlier_year_peers", f"WITH {ENTRIES}, y AS (SELECT disease, year(launched) AS y, count(DISTINCT product_id) AS n FROM entries GROUP BY 1, 2) SELECT e.product_id, coalesce((SELECT sum(n) FROM y WHERE y.disease = e.disease AND y.y < year(e.launched)), 0)::BIGINT AS peers FROM entries e")
def j07(spark: SparkSession, d: str) -> DataFrame:
    return earlier_year_counts(registry_entries(spark, d)).select("product_id", "peers")


def earlier_year_counts(entries: DataFrame) -> DataFrame:
    """Distinct products of the indication launched in a strictly earlier year: counted by year, then summed."""
    from pyspark.sql import Window

    y = entries.groupBy("disease", F.year("launched").alias("y")).agg(F.count_distinct("product_id").alias("n"))
    w = Window.partitionBy("disease").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    before = y.select("disease", "y", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("peers"))
    return entries.withColumn("y", F.year("launched")).join(before, ["disease", "y"])


@query("q_b01_product_attributes", f"WITH {ENTRIES}, y AS (SELECT disease, year(launched) AS y, count(DISTINCT product_id) AS n FROM entries GROUP BY 1, 2), c AS (SELECT e.product_id, e.disease, e.launched, coalesce((SELECT sum(n) FROM y WHERE y.disease = e.disease AND y.y < year(e.launched)), 0)::BIGINT AS peers FROM entries e) SELECT product_id, peers, CASE WHEN peers <= 1 THEN 'low' WHEN peers <= 4 THEN 'medium' ELSE 'high' END AS band, CAST(floor(year(launched) / 5) * 5 AS INT) || '-' || CAST(floor(year(launched) / 5) * 5 + 4 AS INT) AS era FROM c")
def b01(spark: SparkSession, d: str) -> DataFrame:
    e = earlier_year_counts(registry_entries(spark, d))
    band = F.when(F.col("peers") <= 1, "low").when(F.col("peers") <= 4, "medium").otherwise("high")
    return e.select("product_id", "peers", band.alias("band"), era(F.year("launched")).alias("era"))


@query("q_n14_band_for_peers", f"WITH {ENTRIES}, {_SNAP} SELECT category, count(*) AS n FROM snaps GROUP BY 1")
def n14(spark: SparkSession, d: str) -> DataFrame:
    return P.snapshots(registry_entries(spark, d)).groupBy(band_for_peers(F.col("marketed_peer_count")).alias("category")).agg(F.count("*").alias("n"))


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """Parts as product profiles; some attributes are undeclared."""
    e = registry_entries(spark, d)
    k = F.col("product_id")
    s = P.snapshots(e).select("product_id", "category")
    return e.join(s, "product_id").select(
        k.cast("string").alias("drug_name"), k.alias("id"), F.when(k % 11 != 0, F.col("disease")).alias("indication_area"), F.when(k % 7 != 0, F.col("brand")).alias("moa_class"),
        F.when(k % 5 == 0, "PO").when(k % 5 == 1, "Oral").when(k % 5 == 2, "IV").when(k % 5 == 3, " subq ").alias("route_of_administration"), era(F.year("launched")).alias("approval_era"), F.when(k % 13 != 0, F.col("category")).alias("competitive_intensity_at_launch"),
    )


_PROF = (
    f"{ENTRIES}, {_SNAP}, prof AS (SELECT CAST(e.product_id AS VARCHAR) AS drug_name, e.product_id AS id, CASE WHEN e.product_id % 11 <> 0 THEN lower(disease) END AS ia, CASE WHEN e.product_id % 7 <> 0 THEN lower(brand) END AS mo, "
    "CASE e.product_id % 5 WHEN 0 THEN 'oral' WHEN 1 THEN 'oral' WHEN 2 THEN 'intravenous' WHEN 3 THEN 'subcutaneous' END AS ro, CAST(floor(year(e.launched) / 5) * 5 AS INT) AS er, CASE WHEN e.product_id % 13 <> 0 THEN category END AS ci FROM entries e JOIN snaps s ON e.product_id = s.product_id), "
    "sc AS (SELECT t.drug_name AS target, c.drug_name AS candidate, CASE WHEN t.ia IS NULL THEN NULL WHEN c.ia IS NULL THEN NULL WHEN t.ia = c.ia THEN 1.0 WHEN contains(t.ia, c.ia) OR contains(c.ia, t.ia) THEN 0.5 ELSE 0.0 END AS s1, CASE WHEN t.mo IS NULL OR c.mo IS NULL THEN NULL WHEN t.mo = c.mo THEN 1.0 ELSE 0.0 END AS s2, "
    "CASE WHEN t.ro IS NULL OR c.ro IS NULL THEN NULL WHEN t.ro = c.ro THEN 1.0 ELSE 0.0 END AS s3, CASE WHEN t.ci IS NULL OR c.ci IS NULL THEN NULL WHEN t.ci = c.ci THEN 1.0 WHEN abs(list_position(['low','medium','high'], t.ci) - list_position(['low','medium','high'], c.ci)) = 1 THEN 0.5 ELSE 0.0 END AS s4, "
    "CASE WHEN t.er = c.er THEN 1.0 WHEN abs(t.er - c.er) <= 5 THEN 0.5 ELSE 0.0 END AS s5, (t.ia IS NOT NULL)::INT * 1.0::DOUBLE + (t.mo IS NOT NULL)::INT * 1.0::DOUBLE + (t.ro IS NOT NULL)::INT * 0.75::DOUBLE + (t.ci IS NOT NULL)::INT * 0.75::DOUBLE + 0.5::DOUBLE AS av FROM prof t JOIN prof c ON t.id % 50 = 0), "
    "scored AS (SELECT target, candidate, CASE WHEN target <> candidate THEN round_even((coalesce(s1, 0)::DOUBLE + coalesce(s2, 0)::DOUBLE + coalesce(s3, 0)::DOUBLE * 0.75 + coalesce(s4, 0)::DOUBLE * 0.75 + coalesce(s5, 0)::DOUBLE * 0.5) / av, 4) END AS score, "
    "CASE WHEN target <> candidate THEN (s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT + (s4 IS NOT NULL)::INT + (s5 IS NOT NULL)::INT ELSE 0 END AS compared, CASE WHEN target = candidate THEN 'same_product' END AS reason FROM sc)"
)


@query("q_c24_score_analog", f"WITH {_PROF} SELECT target, candidate, score, compared, reason FROM scored")
def c24(spark: SparkSession, d: str) -> DataFrame:
    p = write_once(profiles(spark, d))
    return P.score_analogs(p.filter("id % 50 = 0"), p).drop("matched")


_BANDS = (
    f"WITH RECURSIVE {_PROF}, okk AS (SELECT * FROM scored WHERE reason IS NULL AND compared >= 3), ops AS (SELECT target, max(score) AS top, 1 AS band FROM okk GROUP BY 1 UNION ALL SELECT o.target, (SELECT max(k.score) FROM okk k WHERE k.target = o.target AND o.top - k.score > 0.05) AS top, o.band + 1 FROM ops o "
    "WHERE (SELECT max(k.score) FROM okk k WHERE k.target = o.target AND o.top - k.score > 0.05) IS NOT NULL), b AS (SELECT okk.*, (SELECT max(band) FROM ops WHERE ops.target = okk.target AND ops.top >= okk.score) AS band FROM okk) "
    "SELECT target, candidate, score, compared, band, row_number() OVER (PARTITION BY target ORDER BY band, compared DESC, score DESC, candidate) AS rank FROM b"
)


@query("q_w10_ranked_in_bands", _BANDS)
def w10(spark: SparkSession, d: str) -> DataFrame:
    p = write_once(profiles(spark, d))
    return P.ranked_analogs(p.filter("id % 50 = 0"), p)


@query("q_t13_rank_refusals", f"WITH {_PROF} SELECT target, candidate, CASE WHEN reason IS NOT NULL THEN reason ELSE 'too_few_attributes' END AS reason FROM scored WHERE reason IS NOT NULL OR compared < 3")
def t13(spark: SparkSession, d: str) -> DataFrame:
    p = profiles(spark, d)
    s = P.score_analogs(p.filter("id % 50 = 0"), p)
    return s.filter("reason is not null or compared < 3").select("target", "candidate", F.coalesce("reason", F.lit("too_few_attributes")).alias("reason"))


@query("q_d23_approval_period", f"WITH {ENTRIES} SELECT product_id, CAST(floor(year(launched) / 5) * 5 AS INT) || '-' || CAST(floor(year(launched) / 5) * 5 + 4 AS INT) AS era FROM entries")
def d23(spark: SparkSession, d: str) -> DataFrame:
    return registry_entries(spark, d).select("product_id", era(F.year("launched")).alias("era"))


@query("q_c50_assessment_validated", f"WITH {ENTRIES}, {_SNAP} SELECT product_id, CASE WHEN product_id % 9 = 0 THEN 'label_not_in_vocabulary' WHEN product_id % 10 = 0 THEN 'confidence_not_in_vocabulary' WHEN product_id % 8 = 0 AND marketed_peer_count = 0 THEN 'cites_peer_not_on_roster' END AS refusal FROM snaps")
def c50(spark: SparkSession, d: str) -> DataFrame:
    """Model answers are checked: label and confidence in their vocabularies, every cited peer on the roster."""
    k = F.col("product_id")
    s = P.snapshots(registry_entries(spark, d)).select("product_id", F.when(k % 9 == 0, "extreme").otherwise("low").alias("label"), F.when(k % 10 == 0, "sure").otherwise("high").alias("confidence"), F.when(k % 8 == 0, F.array(F.lit("A"))).otherwise(F.array().cast("array<string>")).alias("named"), F.when(F.col("marketed_peer_count") > 0, F.array(F.lit("A"))).otherwise(F.array().cast("array<string>")).alias("roster"))
    words = ["low", "medium", "high"]
    refusal = F.when(~F.col("label").isin(words), "label_not_in_vocabulary").when(~F.col("confidence").isin(words), "confidence_not_in_vocabulary").when(F.size(F.array_except("named", "roster")) > 0, "cites_peer_not_on_roster")
    return s.select("product_id", refusal.alias("refusal"))
