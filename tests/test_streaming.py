"""Streams against their batch twins on the same rows."""

from __future__ import annotations

import time

from conftest import SF
from pyspark.sql import functions as F

from tessera.operators import linking
from tessera.plans import linked
from tessera.streaming import ledger as stream


def run(df, name, mode, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(240)
    return df.sparkSession.table(name)


def test_ledger_stream_equals_batch(spark, tmp_path):
    """Three files, a batch each, whose events are mixed up within the watermark, and a later meeting that closes the others."""
    events = linked.shaped_events(spark, SF).where("meeting_id < 12").drop("shape").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("order_index") * 60))
    late = spark.createDataFrame([(99, "E1", "TASK_CREATE", "RULE", "close the books", "An", 0)], "meeting_id long, event_id string, event_type string, extraction_source string, action_text string, assignee string, order_index long")
    last = late.withColumn("ts", F.timestamp_seconds(F.lit(1_700_900_000)))
    mixed_up = F.floor((F.col("order_index") + F.when(F.col("order_index") % 3 == 0, 20).otherwise(0)) / 45)  # 20 minutes late
    for part, own in enumerate([events.where(mixed_up == 0), events.where(mixed_up >= 1), last]):
        own.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"f{part}"))
        time.sleep(1.1)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    found = run(stream.tasks(source, end_after="2 hours"), "tasks_stream", "update", tmp_path)
    last = {(r.meeting_id, r.task_id): tuple(r) for r in found.collect()}  # rows come in the order of the batches
    closed = {k: v for k, v in last.items() if k[0] < 12}
    assert closed == {(r.meeting_id, r.task_id): tuple(r) for r in linking.folded(events).collect()}


def test_sessions_and_duplicates(spark, tmp_path):
    rows = [(1, "k1", "2024-01-01 00:00:00", 1.0), (1, "k1", "2024-01-01 00:10:00", 2.0), (1, "k2", "2024-01-01 09:00:00", 4.0), (2, "k3", "2024-01-03 00:00:00", 8.0)]
    df = spark.createDataFrame(rows, "user_id long, idempotency_key string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "s"))
    source = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    done = {(r.user_id, r.n, r.total) for r in run(stream.sessions(source()), "sessions_stream", "append", tmp_path).collect()}
    assert {(1, 2, 3.0), (1, 1, 4.0)} <= done
    assert run(stream.submitted_once(source()), "once_stream", "append", tmp_path).count() == 3


def test_state_outlives_batches_without_rows_of_a_meeting(spark, tmp_path):
    """Files, a batch each: the meeting's first event, others' events hours later, the end of its task, and a day later."""
    schema = "meeting_id long, event_id string, event_type string, extraction_source string, related_task_id string, action_text string, assignee string, deadline_mention_id string, order_index long, ts string"
    files = [
        [(1, "E1", "TASK_CREATE", "RULE", "", "write report", "An", "", 1, "2024-01-01 08:00:00")],
        [(2, "E1", "TASK_CREATE", "RULE", "", "other", "An", "", 1, "2024-01-01 12:00:00"), (2, "E2", "TASK_CREATE", "RULE", "", "third", "", "", 2, "2024-01-01 13:00:00")],
        [(1, "E2", "TASK_CANCEL", "RULE", "TASK-000001", "", "", "", 2, "2024-01-01 14:00:00"), (1, "E3", "TASK_CREATE", "RULE", "", "second", "Chi", "", 3, "2024-01-01 14:01:00")],
        [(3, "E1", "TASK_CREATE", "RULE", "", "last", "An", "", 1, "2024-01-02 12:00:00")],
    ]
    frames = []
    for i, rows in enumerate(files):
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "gap"))
        frames.append(df)
        time.sleep(1.1)
    source = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "gap"))
    found = run(stream.tasks(source), "gap_stream", "update", tmp_path)
    last = {(r.meeting_id, r.task_id): r.status for r in found.collect()}
    assert last[1, "TASK-000001"] == "CANCELLED" and last[1, "TASK-000002"] == "CONFIRMED"
    everything = frames[0].unionByName(frames[1]).unionByName(frames[2])
    assert {k: v for k, v in last.items() if k[0] < 3} == {(r.meeting_id, r.task_id): r.status for r in linking.folded(everything).collect()}
