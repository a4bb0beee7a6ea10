from clademill.streaming import telemetry
from tests.conftest import DATA


def test_streams(spark, tmp_path):
    # In the order of time: rows behind the watermark would be dropped.
    spark.read.parquet(f"{DATA}/events.parquet").repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "e"))
    events = telemetry.admitted(telemetry.read_events(spark, str(tmp_path / "e"), files=10))
    total = spark.read.parquet(f"{DATA}/events.parquet")
    assert telemetry.run_once(telemetry.once(events), "once_").count() == total.count()
    days = telemetry.run_once(telemetry.daily(events), "daily_", "update")
    assert days.groupBy("day", "event_type").agg({"events": "max"}).selectExpr("sum(`max(events)`)").first()[0] == total.count()
    assert telemetry.run_once(telemetry.per_minute(events), "minute_", "update").count() > 0
    states = telemetry.run_once(telemetry.job_states(events), "jobs_", "update")
    assert states.select("user_id").distinct().count() == total.select("user_id").distinct().count()


def test_upsert_keeps_the_last_row_of_each_key(spark, tmp_path):
    write = telemetry.upsert(str(tmp_path / "t"), ["k"])
    write(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), 0)
    write(spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), 1)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t/v1")).collect()) == [(1, "a"), (2, "c"), (3, "d")]
