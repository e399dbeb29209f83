"""Queries over what is handed out and over notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import final, notes
from tessera.operators.dates import anchored
from tessera.plans.rendered import MEETING_DATE, ORDERED_SQL, _ordered
from tessera.plans.said import SAID_FLAGS_SQL, annotated, keywords_sql, match_sql, matches, re2, sql_text

def _day() -> F.Column:
    return F.lit(MEETING_DATE).cast("date")


#: Mentions: text, relation, kind, and the day each stands for from the meeting on 2024-02-01.
MENTIONS = (
    ("by 2024-02-13", "ON_OR_BEFORE", "ANCHOR", "2024-02-13"), ("2024-02-13", "ON_DATE", "ANCHOR", "2024-02-13"), ("trước 17h ngày 13/02/2024", "BEFORE_TIME", "ANCHOR", "2024-02-13"),
    ("deadline 13/02/2024", "ON_DATE", "ANCHOR", "2024-02-13"), ("tomorrow", "ON_DATE", "RELATIVE_DAY", "2024-02-02"), ("on 2024-02-30", "ON_DATE", "ANCHOR", ""), ("from 2024-02-20", "ON_DATE", "ANCHOR", "2024-02-20"), ("20/02/2024", "ON_DATE", "ANCHOR", "2024-02-20"),
)


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda i: F.element_at(F.array(*(F.lit(m[i]) for m in MENTIONS)), (F.col("event_id") % len(MENTIONS)).cast("int") + 1)
    rows = _ordered(spark, sf_dir).select(
        "meeting_id", F.concat(F.lit("D"), "order_index").alias("mention_id"), F.concat(F.lit("C"), "order_index").alias("clause_id"), "order_index", (F.col("event_id") % 3).alias("span_start"), of(0).alias("raw_text"), of(1).alias("relation"),
        of(2).alias("date_type"), F.lit(None).cast("string").alias("count"), F.when(F.col("event_id") % 5 < 2, "START_DATE").otherwise("DEADLINE").alias("purpose"),
    )
    return anchored(rows)


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six tasks a meeting; each event is a clause and a mention of its task."""
    at = F.array_sort(F.collect_list(F.struct("order_index")))
    rows = _ordered(spark, sf_dir).groupBy("meeting_id", (F.col("event_id") % 6).alias("task_id")).agg(at.alias("at"))
    ids = lambda p: F.transform("at", lambda x: F.concat(F.lit(p), x["order_index"]))
    return rows.select("meeting_id", "task_id", ids("C").alias("source_clause_ids"), ids("D").alias("history"), F.element_at(ids("D"), -1).alias("deadline_mention_id"))


_CTE = f"""m AS (SELECT meeting_id, order_index AS i, event_id % 6 AS task_id, event_id % 3 AS span, event_id % 5 < 2 AS starts, [{', '.join(sql_text(m[0]) for m in MENTIONS)}][event_id % 8 + 1] AS raw_text, [{', '.join(sql_text(m[1]) for m in MENTIONS)}][event_id % 8 + 1] AS relation,
    nullif([{', '.join(sql_text(m[3]) for m in MENTIONS)}][event_id % 8 + 1], '') AS day FROM ordered)"""


def dat14_start_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = final.start_dates(_tasks(spark, sf_dir), _mentions(spark, sf_dir), _day())
    return found.select("meeting_id", "task_id", F.col("start_date").cast("string").alias("start_date"), "explicit_start")


DAT14 = f"""WITH {ORDERED_SQL}, {_CTE}, s AS (SELECT meeting_id, task_id, last(day ORDER BY i, span) FILTER (starts AND day IS NOT NULL) AS day FROM m GROUP BY meeting_id, task_id)
SELECT meeting_id, task_id, coalesce(day, '{MEETING_DATE}') AS start_date, day IS NOT NULL AS explicit_start FROM s"""


def dat15_deadline_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _tasks(spark, sf_dir).withColumn("start_date", _day())
    found = final.deadline_texts(tasks, _mentions(spark, sf_dir), _day())
    return found.select("meeting_id", "task_id", F.col("due_date").cast("string").alias("due_date"), "due_text")


DAT15 = f"""WITH {ORDERED_SQL}, {_CTE}, n AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, task_id ORDER BY i DESC) AS back FROM m), c AS (SELECT meeting_id, task_id, raw_text AS now_text, relation AS now_relation, day AS due FROM n WHERE back = 1),
k AS (SELECT m.*, due, relation = 'BEFORE_TIME' AS timed, {matches('raw_text', final.LABELLED)} AS labelled FROM m JOIN c USING (meeting_id, task_id) WHERE (day IS NOT DISTINCT FROM due AND relation = now_relation AND (day IS NULL) = (due IS NULL)) OR (due IS NOT NULL AND day = due AND relation = 'BEFORE_TIME'))
SELECT meeting_id, task_id, any_value(due) AS due_date, first(raw_text ORDER BY timed DESC, labelled DESC, length(trim(raw_text)) DESC, i) AS due_text FROM k GROUP BY meeting_id, task_id"""


def dat16_handovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("Trực an ninh {} từ thứ năm", "Trực an ninh {} đến hết thứ tư", "Support {} until Friday", "support {} from monday", "Gửi báo cáo {}")))
    rows = _ordered(spark, sf_dir)
    tasks = rows.select(
        "meeting_id", "event_id", F.replace(F.element_at(names, (F.col("event_id") % 5).cast("int") + 1), F.lit("{}"), (F.col("order_index") % 3).cast("string")).alias("task_name"), _day().alias("start_date"),
        F.when(F.col("event_id") % 4 != 0, F.date_add(_day(), (F.col("event_id") % 20).cast("int"))).alias("due_date"),
    )
    return final.handed_over(tasks).select("event_id", F.col("start_date").cast("string").alias("start_date"))


DAT16 = f"""WITH {ORDERED_SQL}, t AS (SELECT meeting_id, event_id, event_id % 5 AS form, order_index % 3 AS n, CASE WHEN event_id % 4 <> 0 THEN DATE '{MEETING_DATE}' + CAST(event_id % 20 AS INTEGER) END AS due FROM ordered),
e AS (SELECT meeting_id, CASE form WHEN 1 THEN 0 ELSE 3 END AS receiver, n, max(due) AS ended FROM t WHERE form IN (1, 2) GROUP BY ALL)
SELECT event_id, CAST(coalesce(ended + 1, DATE '{MEETING_DATE}') AS VARCHAR) AS start_date FROM t LEFT JOIN e ON e.meeting_id = t.meeting_id AND e.receiver = t.form AND e.n = t.n AND ended IS NOT NULL"""

TITLES = ("Rà soát ngân sách quý 1.", "W12-MEETING", "API gateway", "Weekly Planning", "kế hoạch tuần", "", "test 3")


def scl05_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of stretches of four events as meetings, with up to three tasks."""
    rows = _ordered(spark, sf_dir).withColumn("m", F.concat_ws("-", "meeting_id", F.floor(F.col("order_index") / 4)))
    task = F.when(
        F.col("order_index") % 4 < F.col("meeting_id") % 4,
        F.struct("order_index", F.struct(
            F.concat(F.lit("Gửi báo cáo "), F.col("event_id") % 9).alias("task_name"), F.when(F.col("event_id") % 3 != 0, "An").otherwise("").alias("assignee"),
            F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("báo cáo "), F.col("event_id") % 9)).when(F.col("event_id") % 2 == 0, "thứ sáu").otherwise("").alias("due_text"),
        ).alias("t")),
    )
    rows = rows.groupBy("m").agg(F.transform(F.array_sort(F.collect_list(task)), lambda x: x["t"]).alias("tasks"), F.min("event_id").alias("first"))
    title = F.element_at(F.array(*map(F.lit, TITLES)), (F.col("first") % len(TITLES)).cast("int") + 1)
    return rows.select("m", final.summary(title, F.col("tasks"), F.col("first") % 2 == 0, F.col("first") % 3 == 0).alias("summary"))


_small = lambda c: f"lower(substr({c}, 1, 1)) || substr({c}, 2)"
SCL05 = f"""WITH {ORDERED_SQL}, t AS (SELECT meeting_id || '-' || order_index // 4 AS m, event_id, order_index AS i, order_index % 4 < meeting_id % 4 AS is_task, 'Gửi báo cáo ' || event_id % 9 AS name, event_id % 3 <> 0 AS owned,
    CASE WHEN event_id % 4 = 0 THEN 'báo cáo ' || event_id % 9 WHEN event_id % 2 = 0 THEN 'thứ sáu' ELSE '' END AS due FROM ordered),
g AS (SELECT m, min(event_id) AS first, count(*) FILTER (is_task) AS n, coalesce(list({_small('name')} ORDER BY i) FILTER (is_task), []) AS acts,
    string_agg(CASE WHEN owned THEN 'An sẽ ' ELSE 'Cần phân công người thực hiện ' END || {_small('name')} || CASE WHEN due <> '' AND NOT contains(lower(name), lower(due)) THEN ' (' || due || ')' ELSE '' END, '; ' ORDER BY i) FILTER (is_task) AS parts FROM t GROUP BY m),
o AS (SELECT *, trim([{', '.join(map(sql_text, TITLES))}][first % {len(TITLES)} + 1], ' .') AS title FROM g),
p AS (SELECT *, CASE WHEN title = '' OR regexp_matches(title, {sql_text('(?i)' + final.TECHNICAL)}) THEN CASE n WHEN 0 THEN '' WHEN 1 THEN acts[1] WHEN 2 THEN acts[1] || ' và ' || acts[2] ELSE acts[1] || ', ' || acts[2] || ' và các đầu việc liên quan' END ELSE title END AS topic FROM o)
SELECT m, trim(concat_ws(' ', CASE WHEN topic = '' THEN '' WHEN starts_with(lower(topic), 'rà soát ') THEN 'Cuộc họp rà soát ' || substr(topic, 9) || '.' WHEN regexp_matches(topic, '^[A-Z]{{2,}}\\b') OR regexp_matches(topic, '^[A-Z][A-Za-z]*(?:\\s+[A-Z][A-Za-z]*)+$')
    THEN 'Cuộc họp tập trung vào ' || topic || '.' ELSE 'Cuộc họp tập trung vào ' || {_small('topic')} || '.' END, CASE WHEN n = 0 THEN CASE WHEN first % 2 = 0 THEN 'Các task cũ được đề cập đã bị hủy; không có task active mới.' ELSE 'Chưa chốt công việc mới.' END
    ELSE n || ' công việc được chốt: ' || parts || '.' END)) || CASE WHEN first % 3 = 0 THEN '' ELSE ' Không có Meeting Note; kết quả được trích xuất từ transcript.' END AS summary FROM p"""

NOTE_ROWS = (
    "- @An gửi báo cáo doanh thu, dl: thứ sáu", "Chủ đề: ngân sách quý", "kw: budget, forecast", "Meeting notes", "1) Bình: kiểm tra dashboard?", "* hủy task 7", "handoff to Chi (Chi)", "ok", "todo: viết kịch bản -> Dũng", "pending phần tài liệu",
    "[x] task A-12 deadline 20/2; review spec", "•", "agenda - kế hoạch", "deploy release pipeline", "đổi owner -> Bình",
)


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.element_at(F.array(*map(F.lit, NOTE_ROWS)), (F.col("event_id") % len(NOTE_ROWS)).cast("int") + 1)
    lines = F.array_sort(F.collect_list(F.struct("order_index", row.alias("row"))))
    return _ordered(spark, sf_dir).groupBy("meeting_id").agg(F.array_join(F.transform(lines, lambda x: x["row"]), "\n").alias("content"))


def scl06_note_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes.note_rows(_notes(spark, sf_dir))
    return rows.select("meeting_id", "line_no", "text", "kind", "confidence", *(F.array_join(c, "|").alias(c) for c in ("owners", "labels", "deadlines", "operations")))


_every = lambda c, p: f"regexp_extract_all({c}, {sql_text('(?i)' + re2(p))}, 1)"
_owners = " || ".join(_every("text", p) for p in notes.OWNERS)
NOTES_SQL = (
    ORDERED_SQL
    + f""", raw AS (SELECT meeting_id, CAST(order_index AS INTEGER) AS line_no, trim(regexp_replace([{', '.join(map(sql_text, NOTE_ROWS))}][event_id % {len(NOTE_ROWS)} + 1], {sql_text('(?i)' + re2(notes.PREFIX))}, '')) AS text FROM ordered),
k AS (SELECT *, {match_sql('text')} AS normal, {keywords_sql('text')} AS keywords, list_transform({_every('text', notes.LABEL)}, lambda x: 'Task ' || upper(x)) AS labels, list_transform({_every('text', notes.DEADLINE)}, lambda x: trim(x)) AS deadlines, {_owners} AS owner_list FROM raw),
rows AS (SELECT *, list_filter(owner_list, lambda x, i: list_position(owner_list, x) = i) AS owners, CASE WHEN text = '' THEN 'NOISE/1.0' WHEN {matches('text', notes.TOPIC)} THEN 'TOPIC/0.9' WHEN {matches('text', notes.KEYWORDS)} THEN 'TOPIC/0.45'
    WHEN len(keywords) <= 2 AND {matches('normal', notes.HEADER)} THEN 'HEADER/0.9' WHEN contains(text, '?') OR {matches('normal', notes.QUESTION)} OR {matches('text', notes.QUESTION)} THEN 'QUESTION/0.95' WHEN {matches('normal', notes.CANCEL, notes.STATE)} THEN 'STATE_HINT/0.8'
    WHEN len(labels) > 0 OR len(owner_list) > 0 OR len(deadlines) > 0 OR len(keywords) >= 2 THEN 'ACTION_HINT/0.65' ELSE 'TOPIC/0.45' END AS kc,
    list_filter([CASE WHEN {matches('normal', notes.CANCEL)} THEN 'CANCEL' END, CASE WHEN {matches('normal', notes.STATE)} THEN 'STATE' END], lambda x: x IS NOT NULL) AS operations FROM k)"""
)
SCL06 = f"""WITH {NOTES_SQL} SELECT meeting_id, line_no, text, split_part(kc, '/', 1) AS kind, split_part(kc, '/', 2)::DOUBLE AS confidence, array_to_string(owners, '|') AS owners, array_to_string(labels, '|') AS labels, array_to_string(deadlines, '|') AS deadlines,
  array_to_string(operations, '|') AS operations FROM rows"""


def scl07_note_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes.claims(notes.note_rows(_notes(spark, sf_dir)))
    level = F.element_at(F.array(*map(F.lit, ("CONTRADICTED", "FULL_GROUNDED", "PARTIAL_GROUNDED", "UNGROUNDED"))), F.col("line_no") % 4 + 1)
    signal, proposes = notes.authority(level, F.when(F.col("line_no") % 3 == 0, "AUTO_OVERVIEW").otherwise(F.col("source")))
    return rows.select("meeting_id", "claim_id", "action_hint", "owner_hint", "date_hint", "operation_hint", signal.alias("signal"), proposes.alias("may_propose"))


SCL07 = f"""WITH {NOTES_SQL} SELECT meeting_id, 'NCLAIM-' || substr(sha256(meeting_id || chr(31) || line_no || chr(31) || normal), 1, 16) AS claim_id, coalesce(labels[1], text) AS action_hint, owners[1] AS owner_hint, deadlines[1] AS date_hint, operations[1] AS operation_hint,
  CASE line_no % 4 WHEN 0 THEN 'NEGATIVE' WHEN 1 THEN 'STRONG' WHEN 2 THEN 'MEDIUM' ELSE CASE WHEN line_no % 3 = 0 THEN 'CONTEXT_ONLY' ELSE 'WEAK' END END AS signal, line_no % 4 IN (1, 2) OR (line_no % 4 = 3 AND line_no % 3 <> 0) AS may_propose
FROM rows WHERE split_part(kc, '/', 1) IN ('ACTION_HINT', 'STATE_HINT')"""


def scl08_note_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of clauses with those that note rows grounded in them add; a row is grounded in the clause of its number and the next."""
    rows = notes.note_rows(_notes(spark, sf_dir))
    at = F.explode(F.array(F.col("line_no") + 1, F.col("line_no") + 2))
    grounded = rows.select("meeting_id", "line_no", at.alias("n")).select(
        "meeting_id", "line_no", F.format_string("CLAUSE-%06d", "n").alias("clause_id"), F.element_at(F.array(*map(F.lit, ("GROUNDED", "AMBIGUOUS", "UNGROUNDED"))), F.col("n") % 3 + 1).alias("status"), (F.col("n") % 10 / 10).alias("score"),
    )
    out = notes.enriched(annotated(spark, sf_dir), notes.cues(rows, grounded))
    return out.select("meeting_id", "clause_id", F.array_join("flags", ",").alias("flags"))


SCL08 = f"""WITH {NOTES_SQL}, {SAID_FLAGS_SQL.replace(ORDERED_SQL + ', ', '')}, g AS (SELECT *, unnest([line_no + 1, line_no + 2]) AS n FROM rows WHERE split_part(kc, '/', 1) IN ('ACTION_HINT', 'STATE_HINT')),
x AS (SELECT meeting_id, printf('CLAUSE-%06d', n) AS clause_id, list_filter(['NOTE_' || CASE n % 3 WHEN 0 THEN 'GROUNDED' ELSE 'AMBIGUOUS' END || '_' || CASE WHEN starts_with(kc, 'ACTION') THEN 'ACTION' ELSE 'STATE' END, CASE WHEN len(labels) > 0 THEN 'NOTE_TASK_LABEL_HINT' END,
    CASE WHEN len(owners) > 0 THEN 'NOTE_OWNER_HINT' END, CASE WHEN len(deadlines) > 0 THEN 'NOTE_DEADLINE_HINT' END], lambda v: v IS NOT NULL) AS more FROM g WHERE n % 3 <> 2),
a AS (SELECT meeting_id, clause_id, flatten(list(more)) AS more FROM x GROUP BY ALL)
SELECT f.meeting_id, f.clause_id, array_to_string(list_sort(list_distinct(flags || coalesce(more, []))), ',') AS flags FROM flagged f LEFT JOIN a USING (meeting_id, clause_id)"""

QUERIES = {
    "dat14_start_dates": (dat14_start_dates, DAT14), "dat15_deadline_texts": (dat15_deadline_texts, DAT15), "dat16_handovers": (dat16_handovers, DAT16), "scl05_summaries": (scl05_summaries, SCL05), "scl06_note_rows": (scl06_note_rows, SCL06),
    "scl07_note_claims": (scl07_note_claims, SCL07), "scl08_note_flags": (scl08_note_flags, SCL08),
}
