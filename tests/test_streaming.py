from datetime import datetime, timedelta

from seriesloom.streaming import events as E

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def rows(n):
    return [(i, T0 + timedelta(minutes=i * 10), i % 2, "view", 1.0) for i in range(n)]


def test_a_stream_gives_the_batch_counts_once_windows_close(spark, tmp_path):
    df = spark.createDataFrame(rows(30), SCHEMA)
    df.write.parquet(str(tmp_path / "in"))
    stream = E.tumbling(E.read_stream(spark, str(tmp_path / "in"), df), "1 hour")
    q = stream.writeStream.format("memory").queryName("win").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.n for r in spark.table("win").collect()} == {6}
    assert sum(r.n for r in E.tumbling(df, "1 hour").collect()) == 30


def test_sessions_split_at_the_gap(spark):
    late = [(100, T0 + timedelta(days=1), 0, "view", 1.0)]
    assert E.sessions(spark.createDataFrame(rows(6) + late, SCHEMA), "30 minutes").filter("user_id = 0").count() == 2


def test_upserts_are_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id int, v int, x string")
    for k in range(2):
        df.write.mode("overwrite").parquet(str(tmp_path / "in"))
        E.upsert_batches(E.read_stream(spark, str(tmp_path / "in"), df), str(tmp_path / "out"), "id", "v", str(tmp_path / f"cp{k}")).awaitTermination()
    assert sorted((r.id, r.x) for r in E.latest_state(spark, str(tmp_path / "out"), "id", "v").collect()) == [(1, "b"), (2, "c")]
