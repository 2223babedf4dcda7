"""Event-time queries, run over the stored events as one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.session import table
from seriesloom.streaming import events as E


def k01(spark: SparkSession, d: str) -> DataFrame:
    t = E.tumbling(table(spark, d, "events"), "1 hour")
    return t.select(F.unix_timestamp("begins").alias("begins"), "event_type", "n", F.round("total", 4).alias("total"))


def k02(spark: SparkSession, d: str) -> DataFrame:
    return E.sliding(table(spark, d, "events"), "1 hour", "30 minutes").select(F.unix_timestamp("begins").alias("begins"), "event_type", "n")


def k03(spark: SparkSession, d: str) -> DataFrame:
    return E.sessions(table(spark, d, "events"), "30 minutes").select("user_id", F.unix_timestamp("begins").alias("begins"), "n")


def k06(spark: SparkSession, d: str) -> DataFrame:
    return E.first_seen(table(spark, d, "events")).groupBy("event_type").agg(F.count("*").alias("n"))


QUERIES = {"q_k01_tumbling_windows": k01, "q_k02_sliding_windows": k02, "q_k03_sessions": k03, "q_k06_dedup_within_watermark": k06}
_W = "CAST(epoch(date_trunc('hour', ts)) AS BIGINT)"
ORACLES = {
    "q_k01_tumbling_windows": f"SELECT {_W} AS begins, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "q_k02_sliding_windows": "SELECT b AS begins, event_type, count(*) AS n FROM (SELECT event_type, unnest([CAST(floor(epoch(ts) / 1800) AS BIGINT) * 1800, CAST(floor(epoch(ts) / 1800) AS BIGINT) * 1800 - 1800]) AS b FROM events) GROUP BY 1, 2",
    "q_k03_sessions": "WITH e AS (SELECT user_id, epoch(ts) AS t, epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, CAST(floor(min(t)) AS BIGINT) AS begins, count(*) AS n FROM s GROUP BY user_id, g",
    "q_k06_dedup_within_watermark": "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_id, event_type FROM events) GROUP BY 1",
}
