from quillgrid.streaming import tasks

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
SF = "/root/testdata/sf0.001"


def drain(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_match_batches(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    where = str(tmp_path / "in")
    batch.repartition(2).write.parquet(where)
    batch.limit(40).coalesce(1).write.mode("append").parquet(where)  # events that come twice
    events = tasks.event_stream(spark, where, SCHEMA, "3650 days")
    assert drain(spark, tasks.deduplicated(events), "dedup", "append").count() == batch.count()
    got = drain(spark, tasks.progress_by_window(events), "windows", "complete")
    assert got.agg({"n": "sum"}).first()[0] == batch.count() + 40
    states = drain(spark, tasks.task_states(events), "states", "update")
    last = {r.task: r for r in states.orderBy("events").collect()}
    counts = {r.user_id: r["count"] for r in spark.read.schema(SCHEMA).parquet(where).groupBy("user_id").count().collect()}
    assert {k: v.events for k, v in last.items()} == counts
