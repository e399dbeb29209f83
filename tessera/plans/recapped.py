"""Queries over recaps: meetings made from `events` that end in a recap of one of several forms, and what its rows must say.

The last clauses of a meeting are those of a form (user_id modulo their number); {k} is the number in `props` of the meeting's first
row. What stands for a form in SQL was worked out by hand from the rules, row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import sequence_id
from tessera.operators import recap_rows as R
from tessera.operators.extraction import participants_of
from tessera.plans.rendered import ORDERED_SQL, _ordered
from tessera.plans.said import sql_text

#: What is said (speaker, text), and what it yields (clause by place, form, kind, action, owner, deadline's words).
FORMS: tuple[tuple[tuple[tuple[str, str], ...], tuple[tuple[int, str, str, str, str, str], ...]], ...] = (
    (
        (("Bình", "Em đang xem lại"), ("Chi", "Dạ"), ("An", "Recap lần cuối nhé"), ("Chi", "Vâng"), ("An", "Task 1 - Bình, viết báo cáo {k} - deadline 20/02/2024"), ("Chi", "ok"),
         ("An", "Task 2: Chi, kiểm tra dashboard {k}, hạn 21/02/2024"), ("An", "Task 3 - Bình, đã hủy"), ("Chi", "Em muốn hỏi thêm một việc khác"), ("An", "Task 4 - An, gửi tài liệu {k}")),
        ((4, "NUMBERED", "OWNER_ASSIGN", "Viết báo cáo {k}", "Bình", "deadline 20/02/2024"), (6, "NUMBERED", "OWNER_ASSIGN", "Kiểm tra dashboard {k}", "Chi", "21/02/2024")),
    ),
    (
        (("Bình", "Em đang xem lại"), ("Chi", "Dạ"), ("An", "Final recap of the meeting"), ("An", "Task review contract {k} mới, owner Bình, deadline 2024-02-20"), ("An", "và task update dashboard {k}, do Chi")),
        ((3, "NUMBERED", "OWNER_ASSIGN", "Review contract {k}", "Bình", "deadline 2024-02-20"), (4, "NUMBERED", "OWNER_ASSIGN", "Update dashboard {k}", "Chi", "")),
    ),
    (
        (("Bình", "Em đang xem lại"), ("Chi", "Dạ"), ("An", 'Tổng kết toàn bộ: task "Viết báo cáo {k}" - owner Bình, deadline 20/02/2024; task "Release plan {k}": đã hủy')),
        ((2, "INLINE", "OWNER_ASSIGN", "Viết báo cáo {k}", "Bình", "deadline 20/02/2024"), (2, "INLINE", "TASK_CANCEL", "Lập Release plan {k}", "", "")),
    ),
    (
        (("An", 'Task A: "Viết kịch bản kiểm thử {k}" do Bình phụ trách'), ("Bình", 'Task B: "Gửi tài liệu {k}"'), ("Chi", 'Task B đổi tên thành "Gửi tài liệu hướng dẫn {k}"'), ("An", "Recap cuối: A (Bình, 20/02/2024) và B (Chi)")),
        ((3, "COMPACT", "OWNER_ASSIGN", "Viết kịch bản kiểm thử {k}", "Bình", "20/02/2024"), (3, "COMPACT", "OWNER_ASSIGN", "Gửi tài liệu hướng dẫn {k}", "Chi", "")),
    ),
    (
        (("Bình", "Em đang xem lại"), ("Chi", "Dạ"), ("An", "Final list - Bình: viết báo cáo {k}, dl 20/02/2024 - Chi: chuẩn bị dữ liệu test {k} - Khách: chờ")),
        ((2, "BULLET", "OWNER_ASSIGN", "Viết báo cáo {k}", "Bình", "20/02/2024"), (2, "BULLET", "OWNER_ASSIGN", "Chuẩn bị dữ liệu test {k}", "Chi", "")),
    ),
    (
        (("Bình", "Em đang cấu hình sandbox {k}"), ("Chi", "Dạ"), ("An", "Recap lại tổng thể"), ("An", "Bình: cấu hình"), ("An", "viết báo cáo {k} trước ngày 21/02/2024"), ("An", "Chi: cái này chưa chốt"), ("An", "Tôi sẽ kiểm tra dashboard {k}")),
        ((3, "SECTION", "OWNER_ASSIGN", "Cấu hình sandbox {k}", "Bình", ""), (4, "SECTION", "OWNER_ASSIGN", "Viết báo cáo {k}", "Bình", "trước ngày 21/02/2024"), (6, "SECTION", "OWNER_ASSIGN", "Kiểm tra dashboard {k}", "An", "")),
    ),
    (
        (("Bình", "Em đang xem lại"), ("Chi", "Dạ"), ("An", "Chốt lại: release notes {k}: Chi, ngày 20/02/2024; các task khác giữ nguyên"), ("An", "thứ ba, em kiểm tra dashboard {k}")),
        ((2, "STRUCTURED", "OWNER_ASSIGN", "Viết Release notes {k}", "Chi", "ngày 20/02/2024"), (2, "STRUCTURED", "OWNER_ASSIGN", "Kiểm tra dashboard {k}", "An", "")),
    ),
    (
        (("Bình", "Em đang xem lại"), ("Chi", "Dạ"), ("An", "Recap nhanh: Chi và Bình cấu hình sandbox {k} và viết báo cáo {k}, kèm tài liệu hướng dẫn {k}"), ("An", "An hủy demo"), ("Bình", "Chi kiểm tra dashboard {k}")),
        ((2, "NAMED", "OWNER_ASSIGN", "Cấu hình sandbox {k}", "Chi; Bình", ""), (2, "NAMED", "OWNER_ASSIGN", "Viết báo cáo {k}", "Chi; Bình", ""), (2, "NAMED", "OWNER_ASSIGN", "Soạn tài liệu hướng dẫn {k}", "Chi; Bình", "")),
    ),
    (
        (("Bình", "Em đang xem lại"), ("Chi", "Dạ"), ("An", "Action items: monitoring cluster {k}: Bình, trước thứ sáu; task dashboard {k}: An và Bình"), ("Chi", "staging {k}: An")),
        ((2, "STRUCTURED", "OWNER_ASSIGN", "Cấu hình Monitoring cluster {k}", "Bình", "trước thứ sáu"), (2, "STRUCTURED", "OWNER_ASSIGN", "Cập nhật Dashboard {k}", "An; Bình", "")),
    ),
    ((("Bình", "Em đang xem lại"), ("Chi", "Dạ"), ("An", "Chúng ta dừng ở đây {k}")), ()),
)


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_id, clause_id, order_index, speaker_name, text_raw."""
    own = W.partitionBy("meeting_id")
    rows = _ordered(spark, sf_dir).withColumn("n", F.count("*").over(own)).withColumn("number", F.min(F.when(F.col("order_index") == 0, F.col("k"))).over(own))
    lines = spark.createDataFrame([(f, len(said) - 1 - i, s, t) for f, (said, _) in enumerate(FORMS) for i, (s, t) in enumerate(said)], "form int, back int, speaker string, said string")
    rows = rows.withColumn("form", (F.col("meeting_id") % len(FORMS)).cast("int")).withColumn("back", (F.col("n") - 1 - F.col("order_index")).cast("int"))
    rows = rows.join(F.broadcast(lines), ["form", "back"], "left")
    talk = F.element_at(F.array(*map(F.lit, ("Chúng ta trao đổi tiếp", "Phần đó ổn rồi", "Ngân sách thì sao", "We talked about it last week"))), (F.col("event_id") % 4).cast("int") + 1)
    speaker = F.element_at(F.array(*map(F.lit, ("An", "Bình", "Chi"))), (F.col("event_id") % 3).cast("int") + 1)
    return rows.select(
        "meeting_id", sequence_id("CLAUSE", F.col("order_index") + 1).alias("clause_id"), "order_index", F.coalesce("speaker", speaker).alias("speaker_name"),
        F.coalesce(F.replace("said", F.lit("{k}"), F.col("number")), talk).alias("text_raw"),
    )


def ext09_recap_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each meeting's recap, with the words of their deadlines."""
    rows = R.segment_deadlines(R.events(meetings(spark, sf_dir)))
    return rows.select("meeting_id", "clause_id", "form", "event_type", "action_text", "assignee", "deadline_text", "extraction_source")


_ROWS = ", ".join(
    f"({f}, {len(said) - 1 - i}, {', '.join(map(sql_text, (form, kind, action, owner, due)))}, '{'RULE_RECAP' if form == 'NAMED' else 'RULE_FINAL_RECAP'}')"
    for f, (said, rows) in enumerate(FORMS) for i, form, kind, action, owner, due in rows
)
EXT09 = f"""WITH {ORDERED_SQL}, m AS (SELECT meeting_id, count(*) AS n, max(k) FILTER (order_index = 0) AS number FROM ordered GROUP BY meeting_id),
r(form_no, back, form, event_type, action_text, assignee, deadline_text, extraction_source) AS (VALUES {_ROWS})
SELECT meeting_id, printf('CLAUSE-%06d', n - back) AS clause_id, form, event_type, replace(action_text, '{{k}}', number) AS action_text, assignee, deadline_text, extraction_source FROM m JOIN r ON form_no = meeting_id % {len(FORMS)}"""


def ext07_final_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clauses of each meeting's last final recap."""
    return R.final_block(meetings(spark, sf_dir)).select("meeting_id", "clause_id", "marks", "marker_speaker")


#: Clauses of the final block, by form (places from 0), the first of them the marker.
BLOCKS = {0: (2, 4, 6, 7), 1: (2, 3, 4), 2: (2,), 3: (3,), 4: (2,), 5: (2, 3, 4, 5, 6)}
EXT07 = f"""WITH {ORDERED_SQL}, m AS (SELECT meeting_id, count(*) AS n FROM ordered GROUP BY meeting_id),
b(form_no, back, marks) AS (VALUES {", ".join(f"({f}, {len(FORMS[f][0]) - 1 - i}, {i == places[0]})" for f, places in BLOCKS.items() for i in places)})
SELECT meeting_id, printf('CLAUSE-%06d', n - back) AS clause_id, marks, 'An' AS marker_speaker FROM m JOIN b ON form_no = meeting_id % {len(FORMS)}"""


def ext04_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lettered tasks were last said to be, and who owns them."""
    rows = meetings(spark, sf_dir)
    return R.definitions(rows, participants_of(rows)).select("meeting_id", "label", F.col("known").alias("action"), F.col("known_owner").alias("owner"))


EXT04 = f"""WITH {ORDERED_SQL}, m AS (SELECT meeting_id, max(k) FILTER (order_index = 0) AS number FROM ordered GROUP BY meeting_id)
SELECT meeting_id, label, replace(action, '{{k}}', number) AS action, owner FROM m, (VALUES ('A', 'Viết kịch bản kiểm thử {{k}}', 'Bình'), ('B', 'Gửi tài liệu hướng dẫn {{k}}', '')) t(label, action, owner)
WHERE meeting_id % {len(FORMS)} = 3"""


def ext02_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where participants are named in the clauses of a meeting."""
    rows = meetings(spark, sf_dir)
    found = rows.join(participants_of(rows), "meeting_id").withColumn("x", F.explode(R.occurrences(F.col("text_raw"), F.col("participants"))))
    return found.select("meeting_id", "clause_id", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("x.name").alias("name"))


EXT02 = f"""WITH {ORDERED_SQL}, m AS (SELECT *, count(*) OVER w AS n, max(k) FILTER (order_index = 0) OVER w AS number FROM ordered WINDOW w AS (PARTITION BY meeting_id)),
l(form_no, back, said) AS (VALUES {", ".join(f"({f}, {len(said) - 1 - i}, {sql_text(t)})" for f, (said, _) in enumerate(FORMS) for i, (_, t) in enumerate(said))}),
t AS (SELECT meeting_id, printf('CLAUSE-%06d', order_index + 1) AS clause_id, replace(said, '{{k}}', number) AS text FROM m JOIN l ON form_no = meeting_id % {len(FORMS)} AND back = n - 1 - order_index),
p AS (SELECT meeting_id, clause_id, text, name, unnest(range(1, length(text) + 1)) AS i FROM t, (VALUES ('An'), ('Bình'), ('Chi')) x(name))
SELECT meeting_id, clause_id, CAST(i - 1 AS INTEGER) AS start, CAST(i - 1 + length(name) AS INTEGER) AS "end", name FROM p WHERE lower(substr(text, i, length(name))) = lower(name)
  AND (i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '[\\pL\\pN_]')) AND NOT regexp_matches(coalesce(substr(text, i + length(name), 1), ''), '[\\pL\\pN_]')"""

QUERIES = {
    "ext09_recap_events": (ext09_recap_events, EXT09), "ext07_final_blocks": (ext07_final_blocks, EXT07), "ext04_definitions": (ext04_definitions, EXT04), "ext02_occurrences": (ext02_occurrences, EXT02),
}
