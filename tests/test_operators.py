"""Operators on rows written by hand: what SQL can't express, and the Vietnamese rules."""

from __future__ import annotations

import datetime as dt

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import cues, dates, evaluation, extraction, ledger, segments
from tessera.sources import transcripts


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0]


def test_normal_forms(spark):
    assert one(spark, T.normalized(F.col("t")), t="  Thứ  6, CN \n Straße ") == "thứ sáu, chủ nhật strasse"
    assert one(spark, T.match_form(F.col("t")), t="Đổi thành: Báo-cáo!") == "doi thanh: bao-cao"


def test_speakers_and_stamps(spark):
    speaker, said = T.speaker_and_text(F.col("t"))
    for raw, name, rest in (("<v An Nguyễn>Xin &amp; chào", "An Nguyễn", "Xin & chào"), ("Bình: tôi sẽ gửi", "Bình", "tôi sẽ gửi"), ("không tên", "Unknown", "không tên")):
        assert (one(spark, speaker, t=raw), one(spark, said, t=raw)) == (name, rest)
    assert one(spark, T.stamp_ms(F.col("t")), t="01:02:03,4") == 3_723_400
    assert one(spark, T.stamp_ms(F.col("t")), t="02:03") == 123_000


def test_readers_number_captions_and_carry_speakers(spark):
    plain = "TITLE: x\n[00:01] An: một\nhai\n\n--- END OF PART 1\n[01:00:00] Bình: ba\nCòn: bốn"
    vtt = "WEBVTT\n\n1\n00:01.000 --> 00:02.500\nAn: xin\nchào\n\nghi chú\n\n00:03.000 --> 00:04.000\n\n00:05.000 --> 00:06.000\n<v B>ok\n"
    files = spark.createDataFrame([(1, "a.txt", plain), (2, "b.vtt", vtt)], "meeting_id long, file_name string, transcript string")
    got = [(r.meeting_id, r.caption_id, r.speaker_raw, r.start_ms, r.text_raw) for r in transcripts.captions(files).orderBy("meeting_id", "order_index").collect()]
    assert got == [
        (1, "CAP-000001", "An", 1000, "một"), (1, "CAP-000002", "An", None, "hai"), (1, "CAP-000003", "Bình", 3_600_000, "ba"), (1, "CAP-000004", "Còn", None, "bốn"),
        (2, "CAP-000001", "An", 1000, "xin chào"), (2, "CAP-000002", "B", 5000, "ok"),
    ]


def test_package_and_back(spark):
    whole = transcripts.package(F.col("i"), F.col("m"), F.col("d"), F.col("n"), F.col("t"))
    rows = [("M1", "Weekly  plan", "2024-02-01", " note\nmore ", "An: hi\nB: x"), ("", "", "", "", "An: hi"), (None, None, None, "only a note", "  An: hi"), ("M2", None, None, None, "x")]
    df = spark.createDataFrame(rows, "i string, m string, d string, n string, t string").select(whole.alias("p"))
    packed = [r.p for r in df.collect()]
    assert packed[0] == (
        "=== MEETING METADATA ===\nmeeting_id: M1\nmeeting_title: Weekly plan\nmeeting_date: 2024-02-01\n=== END MEETING METADATA ===\n=== MEETING NOTE ===\nnote\nmore\n=== END MEETING NOTE ===\n=== TRANSCRIPT ===\nAn: hi\nB: x"
    )
    assert packed[1] == "An: hi"
    got = [tuple(r.x) for r in df.select(transcripts.unpackaged(F.col("p")).alias("x")).collect()]
    assert got == [("An: hi\nB: x", "note\nmore", "M1", "Weekly plan", "2024-02-01"), ("An: hi", None, "", "", ""), ("An: hi", "only a note", "", "", ""), ("x", None, "M2", "", "")]
    broken = packed[0].replace("=== TRANSCRIPT ===", "=== TEXT ===")
    assert tuple(one(spark, transcripts.unpackaged(F.col("p")), p=broken)) == (broken, None, "", "", "")


def test_srt_is_read_like_vtt(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,500\nAn: xin chào\n\n2\n00:00:03,250 --> 00:00:04,000\nkhông tên\n"
    files = spark.createDataFrame([(1, "a.srt", srt)], "meeting_id long, file_name string, transcript string")
    got = [(r.caption_id, r.speaker_raw, r.start_ms, r.end_ms, r.text_raw) for r in transcripts.captions(files).orderBy("order_index").collect()]
    assert got == [("CAP-000001", "An", 1000, 2500, "xin chào"), ("CAP-000002", "Unknown", 3250, 4000, "không tên")]


def test_live_captions_grow(spark):
    rows = [(1, f"CAP-{i:06d}", "An", 1000 * i, 1000 * i + 900, t, i) for i, t in enumerate(("tôi sẽ", "tôi sẽ gửi", "tôi sẽ gửi báo cáo", "khác hẳn", "tôi sẽ"))]
    captions = spark.createDataFrame(rows, "meeting_id long, caption_id string, speaker_raw string, start_ms long, end_ms long, text_raw string, order_index long")
    got = segments.merged_captions(captions).orderBy("order_index").collect()
    assert [(r.text_raw, r.merged, r.start_ms, r.end_ms) for r in got] == [("tôi sẽ gửi báo cáo", 3, 0, 2900), ("khác hẳn", 1, 3000, 3900), ("tôi sẽ", 1, 4000, 4900)]


def test_sentences_and_clauses(spark):
    assert one(spark, segments.sentence_list(F.col("t")), t="Xong chưa? Rồi. Chốt lại 2.5 điểm; hết\nNữa") == ["Xong chưa?", "Rồi.", "Chốt lại 2.5 điểm;", "hết", "Nữa"]
    assert one(spark, segments.clause_list(F.col("t")), t="An sẽ gửi báo cáo, còn Bình kiểm tra và Chi sẽ cập nhật") == ["An sẽ gửi báo cáo", "còn Bình kiểm tra", "và Chi sẽ cập nhật"]
    address = "Xem https://a.org/correction? Rồi đổi thành 1.5. Xong"
    assert one(spark, segments.sentence_list(F.col("t")), t=address) == ["Xem https://a.org/correction? Rồi", "đổi thành 1.5.", "Xong"]
    long = " ".join(["a"] * 50 + ["b,"] + ["c"] * 40)
    assert [len(x.split()) for x in segments.shortened(long)] == [51, 40]


def test_cues_and_strategies(spark):
    texts = ["Em sẽ gửi báo cáo trước thứ sáu", "Có nên hủy không", "Đổi thành thứ hai cho task 7", "Chào mọi người", "Nếu rảnh thì em sẽ làm"]
    rows = spark.createDataFrame([(1, f"C{i}", i, t) for i, t in enumerate(texts)], "meeting_id long, clause_id string, order_index long, text_raw string")
    rows = rows.withColumn("text_normalized", T.normalized(F.col("text_raw")))
    got = cues.annotated(rows, F.col("text_raw").contains("thứ")).withColumn("s", cues.strategy()).orderBy("order_index").collect()
    assert [r.s for r in got] == ["RULE", "CONTEXT", "RULE", "CONTEXT", "AI"]
    assert got[0].flags == ["ACTION_VERB", "DATE_MENTION", "FIRST_PERSON_COMMITMENT"] and got[0].score == 6
    assert cues.windows(cues.annotated(rows, F.lit(False)), 1, 1).count() == 3


def test_dates(spark):
    day = F.lit(dt.date(2026, 7, 29))  # a Wednesday
    cases = {
        "gửi trước thứ Sáu nhé": "2026-07-30", "send it by next Tuesday": "2026-08-04", "deadline thứ tư": "2026-08-05", "xong ngày mai": "2026-07-30", "vào 5/3": "2027-03-05",
        "trong vòng ba ngày": "2026-08-01", "within 2 working days": None, "thứ hai hoặc thứ ba": None, "on 2026-02-30": None, "ngày 1 tháng 9 năm 2026": "2026-09-01", "chào": "none",
    }
    rows = spark.createDataFrame([(1, t, 0, t) for t in cases], "meeting_id long, clause_id string, order_index long, text_raw string").withColumn("text_normalized", T.normalized(F.col("text_raw")))
    got = {r.clause_id: r.due for r in dates.mentions(rows).select("clause_id", dates.resolved(day, day).cast("string").alias("due")).collect()}
    assert got == {k: v for k, v in cases.items() if v != "none"}


def event(i, kind, action, source="RULE", target="", owner="", due="", anchor="", confidence=0.7):
    return (1, f"E{i}", kind, target, action, owner, due, source, confidence, [f"C{i}"], anchor or f"C{i}", i)


EVENT = "meeting_id long, event_id string, event_type string, related_task_id string, action_text string, assignee string, deadline_mention_id string, extraction_source string, confidence double, source_clause_ids array<string>, anchor_clause_id string, order_index long"


def test_dedupe_keeps_the_better_source_and_all_evidence(spark):
    rows = [event(1, "TASK_CREATE", "Gửi báo cáo", "AI", anchor="X"), event(2, "TASK_CREATE", "gửi  bao cao", "RULE", anchor="X"), event(3, "TASK_CREATE", "khác", anchor="X")]
    got = ledger.deduplicated(spark.createDataFrame(rows, EVENT)).orderBy("order_index").collect()
    assert [(r.event_id, r.source_clause_ids, r.n_merged) for r in got] == [("E2", ["C1", "C2"], 2), ("E3", ["C3"], 1)]


def test_ledger_fold(spark):
    rows = [
        event(1, "TASK_CREATE", "Viết báo cáo", owner="An"), event(2, "DEADLINE_REPLACE", "viết báo cáo", due="D1"), event(3, "OWNER_REASSIGN", "Viết báo cáo", owner="Bình; Chi"),
        event(4, "TASK_CANCEL", "", target="TASK-000001"), event(5, "TASK_CREATE", "viết báo cáo", owner="An"), event(6, "DEADLINE_SET", "chưa có", due="D2"),
        event(7, "TASK_CREATE", "việc mới", source="AI"), event(8, "TASK_REFERENCE", "nhắc tới", source="RULE_REFERENCE"),
    ]
    got = ledger.folded(spark.createDataFrame(rows, EVENT)).orderBy("task_id").collect()
    assert [(r.task_name, r.assignee, r.deadline_mention_id, r.status, r.n_events) for r in got] == [("Viết báo cáo", "Bình; Chi", "D1", "CANCELLED", 4), ("nhắc tới", "", "", "PROVISIONAL", 1)]
    assert ledger.visible(ledger.folded(spark.createDataFrame(rows, EVENT))).count() == 0


def test_context_dates_are_read_from_conversations(spark, tmp_path):
    from tessera.plans.evidence import dat05_context_dates

    rows = [(1, 0, "hello"), (1, 1, None), (2, 0, "hello"), (2, 1, "so the meeting date is 2023-07-09"), (4, 0, "today is 2024-02-05, and on 2023-01-01 we met")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r.conv_id: r.meeting_date for r in dat05_context_dates(spark, str(tmp_path)).collect()}
    assert found == {1: "2024-02-02", 2: None, 4: "2024-02-05"}


CAPTION = "meeting_id long, caption_id string, speaker_raw string, start_ms long, end_ms long, text_raw string, order_index long"


def test_from_captions_to_events_and_tasks(spark):
    said = ["Anh An: ", "Chào mọi người", "Bình, em hãy gửi báo cáo doanh thu trước thứ sáu nhé", "Dạ, em sẽ chuẩn bị hợp đồng mẫu", "Hủy task kiểm thử"]
    who = ["Anh An", "An", "An", "Chi", "anh  An"]
    rows = [(1, f"CAP-{i:06d}", w, 5000 * i, 5000 * i + 900, t, i) for i, (w, t) in enumerate(zip(who, said, strict=True)) if i]
    rows.append((1, "CAP-000009", "Bình", 60_000, 61_000, "ok", 9))
    clauses = segments.preprocessed(spark.createDataFrame(rows, CAPTION))
    annotated = cues.annotated(clauses, F.col("text_normalized").contains("thứ sáu")).withColumn("deadline_mention_id", F.when(F.array_contains("flags", "DATE_MENTION"), "D1"))
    got = [(r.event_type, r.action_text, r.assignee, r.deadline_mention_id) for r in extraction.events(annotated).orderBy("order_index").collect()]
    assert got == [("OWNER_ASSIGN", "Gửi báo cáo doanh thu", "Bình", "D1"), ("TASK_COMMITMENT", "Chuẩn bị hợp đồng mẫu", "Chi", ""), ("TASK_CANCEL", "", "", "")]
    assert {r.speaker_id for r in clauses.where("speaker_name = 'An'").collect()} == {clauses.where("speaker_name = 'An'").first().speaker_id}
    assert clauses.orderBy("order_index").first().source_caption_ids == ["CAP-000001"]


def test_actions_are_cleaned_and_judged(spark):
    cases = {
        "kiểm tra lại dữ liệu và viết báo cáo tuần, em nhớ nhé": ("Viết báo cáo tuần", True), "còn việc gửi hợp đồng trước thứ hai": ("Gửi hợp đồng", True), "làm như vậy": ("Làm như vậy", False),
        "cập nhật lại task 5": ("Cập nhật lại task 5", False), "gửi biên bản sau cuộc họp": ("Gửi biên bản sau cuộc họp", False), "cam kết sẽ deploy pipeline, thứ sáu": ("Deploy pipeline", True), "": ("", False),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", extraction.clean_action(F.col("t")).alias("a"))
    assert {r.t: (r.a, r.c) for r in df.select("t", "a", extraction.is_concrete(F.col("a")).alias("c")).collect()} == cases


@settings(max_examples=150, deadline=None)
@given(rows=st.integers(1, 4), columns=st.integers(1, 4), data=st.data())
def test_best_pairs_equal_all_pairings(rows, columns, data):
    values = data.draw(st.lists(st.sampled_from((0.0, 0.0, 0.72, 0.8, 0.9, 1.0)), min_size=rows * columns, max_size=rows * columns))
    score = np.array(values).reshape(rows, columns)
    pairs = evaluation.best_pairs(score)
    assert len({r for r, _ in pairs}) == len(pairs) == len({c for _, c in pairs}) and all(score[r, c] > 0 for r, c in pairs)
    assert abs(sum(1e6 + score[r, c] for r, c in pairs) - evaluation.brute_pairs(score)) < 1e-6


def test_fuzzy_pairing_counts_pairs_before_scores(spark):
    schema = "case_id long, task_id long, task_key string, task_name string"
    expected = spark.createDataFrame([(1, 1, "", "Gửi báo cáo"), (1, 2, "", "Gửi báo cáo doanh thu tháng"), (2, 1, "k", "x")], schema)
    actual = spark.createDataFrame([(1, 7, "", "gui bao cao doanh thu"), (1, 8, "", "Gửi báo cáo"), (2, 9, "k", "anything"), (2, 10, "", "x")], schema)
    got = sorted((r.case_id, r.expected_id, r.actual_id) for r in evaluation.paired(expected, actual).collect())
    assert got == [(1, 1, 8), (1, 2, 7), (2, 1, 9)]
