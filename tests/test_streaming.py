from datetime import datetime, timedelta

from medialoom.streaming import jobs

T = datetime(2024, 1, 1)


def test_follow():
    assert jobs.follow("none", ["queue", "start", "finish"]) == "completed"
    assert jobs.follow("processing", ["queue"]) == "processing"
    assert jobs.follow("pending", ["finish", "start", "fail", "retry"]) == "pending"


def test_queue_stream(spark, tmp_path):
    schema = "set_id bigint, ts timestamp, action string"
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, T, "queue"), (2, T, "queue"), (1, T + timedelta(seconds=1), "start")], schema).coalesce(1).write.parquet(source)
    seen: dict[int, tuple] = {}

    def keep(batch, _):
        seen.update({r.set_id: (r.state, r.n_events) for r in batch.collect()})

    def run():
        q = jobs.job_states(jobs.read_events(spark, source, schema)).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    assert seen == {1: ("processing", 2), 2: ("pending", 1)}
    spark.createDataFrame([(1, T + timedelta(seconds=2), "finish")], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert seen[1] == ("completed", 3)


def test_activity(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(T, "click"), (T + timedelta(minutes=3), "click"), (T + timedelta(minutes=30), "view"), (T + timedelta(hours=9), "view")], "ts timestamp, event_type string").write.parquet(source)
    rows = []
    q = jobs.activity(jobs.read_events(spark, source, "ts timestamp, event_type string")).writeStream.foreachBatch(lambda b, _: rows.extend(b.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.event_type, r.n) for r in rows} >= {("click", 2), ("view", 1)}
