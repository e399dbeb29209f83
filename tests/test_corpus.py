"""Scans of folders with broken and missing files, writers, and saved ledgers that go on."""

from __future__ import annotations

import json

from conftest import SF
from pyspark.sql import functions as F

from tessera.operators import linking
from tessera.plans import linked
from tessera.sources import corpus


def test_scans_bear_anything(spark, tmp_path):
    def put(case, **files):
        for name, content in files.items():
            folder = tmp_path / "cases" / case
            folder.mkdir(parents=True, exist_ok=True)
            (folder / name.replace("__", ".")).write_bytes(content)

    good = {"metadata__json": b'{"case_id": "A"}', "transcript__txt": "﻿An: chào".encode(), "expected_output__json": b'{"tasks": [{"x": 1}]}'}
    put("A", **good)
    put("B", **(good | {"metadata__json": b"{"}), meeting_note__txt=b"n", other__bin=b"\xff\xfe")
    put("C", transcript__vtt=b"WEBVTT", transcript__srt=b"1")
    put("D", **(good | {"expected_output__json": b""}))
    put("E", other__txt=b"nothing")
    found = {r.case_id: r for r in corpus.cases(spark, str(tmp_path / "cases")).select("case_id", "problem", "transcript", "transcript_file", "meeting_note").collect()}
    assert {k: r.problem for k, r in found.items()} == {"A": None, "B": "BROKEN_METADATA", "C": "MISSING_METADATA", "D": "MISSING_EXPECTED_OUTPUT"}
    assert found["A"].transcript == "An: chào" and found["C"].transcript_file == "transcript.srt" and found["B"].meeting_note == "n"

    traces = tmp_path / "traces"
    traces.mkdir()
    (traces / "a.json").write_text(json.dumps({"meeting_id": "M1", "clauses": [{"clause_id": "C1"}, {"clause_id": "C2"}], "records": [{"r": 1}]}))
    (traces / "b.json").write_text(json.dumps({"meeting_id": "M1", "clauses": [], "records": {"no": "list"}}))
    (traces / "c.json").write_text(json.dumps([{"r": 1}, {"r": 2}]))
    (traces / "d.json").write_text("not json")
    (traces / "e.json").write_text(json.dumps({"meeting_id": "M2", "clauses": [{"clause_id": "C1"}, {"clause_id": "C1"}]}))
    got = {r.file: (r.meeting_id, r.n_clauses, len(r.records), r.problem) for r in corpus.traces(spark, str(traces)).collect()}
    assert got == {"a.json": ("M1", 2, 1, None), "b.json": ("M1", 0, 0, "REPEATED_MEETING"), "c.json": (None, 0, 2, "NO_MEETING_ID"), "d.json": (None, 0, 0, "BROKEN_JSON"), "e.json": ("M2", 2, 0, "REPEATED_CLAUSE")}


def test_lines_are_written_in_order_and_reported(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, i, f"text {i}") for i in range(50)], "k int, i int, t string")
    n, digest = corpus.write_lines(rows.repartition(5), str(tmp_path / "a"), ["k", "i"])
    assert (n, digest) == corpus.write_lines(rows.repartition(3), str(tmp_path / "b"), ["k", "i"]) and n == 50
    assert digest != corpus.write_lines(rows.where("i > 0"), str(tmp_path / "c"), ["k", "i"])[1]
    read = [json.loads(x) for p in sorted((tmp_path / "a").glob("part-*")) for x in p.read_text().splitlines()]
    assert [(x["k"], x["i"]) for x in read] == sorted((i % 3, i) for i in range(50))


def test_a_replayed_batch_counts_once(spark, tmp_path):
    schema = "i int, t string"
    for part in range(3):
        spark.createDataFrame([(part * 10 + i, "x") for i in range(5)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{part}"))
    commit = corpus.committed_once(str(tmp_path / "out"))

    def twice(batch, number):
        commit(batch, number)
        commit(batch, number)  # as after a failure between the write and the checkpoint

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = source.writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = corpus.committed(spark, str(tmp_path / "out"), source.schema)
    assert sorted(r.i for r in found.collect()) == sorted(part * 10 + i for part in range(3) for i in range(5))


def test_saved_ledgers_go_on(spark):
    events = linked.shaped_events(spark, SF)
    whole = {tuple(map(str, r)) for r in linking.folded(events).collect()}
    saved = linking.checkpoints(events.where("order_index < 30"))
    going_on = linking.checkpoints(events.where("order_index >= 30"), saved)
    assert {tuple(map(str, r)) for r in linking.restored(going_on).collect()} == whole
    last = {r.meeting_id: r.last_index for r in going_on.collect()}
    assert last == {r.meeting_id: r.n for r in events.groupBy("meeting_id").agg(F.max("order_index").alias("n")).collect()}
    assert {tuple(map(str, r)) for r in linking.restored(linking.checkpoints(events.where("meeting_id < 0"), going_on)).collect()} == whole
