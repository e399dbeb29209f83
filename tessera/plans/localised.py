"""Queries over decisions by strict rules, on sentences of their own shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import normalized
from tessera.operators import cues, guards
from tessera.operators import local_extraction as L
from tessera.operators import references as R
from tessera.plans.rendered import table
from tessera.plans.said import HAS_DATE_SQL, SAID_FLAGS_SQL, SAID_SQL, has_date, match_sql, matches, re2, said, sql_text, words_sql

_list = lambda values: ", ".join(map(sql_text, values))

SENTENCES = (
    "Task A-1: viết báo cáo tuần, owner An", "Bình sẽ cập nhật tài liệu dự án", "Em sẽ gửi hợp đồng trước thứ sáu", "giao cho Chi viết kịch bản kiểm thử", "Dũng, việc này anh giao cho em kiểm tra log server", "assign review deck to An",
    "An please update the board page", "hủy task B2", "chuyển task B2 cho Chi", "B2 đổi tên thành gửi báo cáo tuần", "deadline của task B2 là ngày 20/02/2024", "đổi deadline đi", "ok", "Có thể làm sau", "Đã hoàn thành rồi", "ai làm gì",
    "em sẽ làm", "cancel báo cáo tuần cũ", "bàn giao hợp đồng mẫu to An", "Đang progress", "Bình giúp xử lý lỗi đăng nhập", "giao cho team làm", "phân công Chi làm", "chào cả nhà", "We should test it", "chuyển hồ sơ cho ai", "task C3 - it", "Mình nhận soạn hồ sơ thầu",
)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, SENTENCES)), (F.col("order_index") % len(SENTENCES)).cast("int") + 1)
    rows = said(spark, sf_dir).withColumn("text_raw", text).withColumn("text_normalized", normalized(F.col("text_raw")))
    return cues.annotated(rows, has_date()).withColumn("deadline_id", F.when(has_date(), F.concat(F.lit("D-"), "clause_id")).otherwise(""))


def ext17_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.decisions(_rows(spark, sf_dir))


_g = lambda p, i: f"regexp_extract(t, {sql_text('(?i)' + re2(p))}, {i})"
_f = lambda p: matches("t", p)
_action = lambda c: f"trim(regexp_replace({c}, {sql_text('(?i)' + re2(L.TRAILER))}, ''), ' ,;:-')"
_plain = lambda c: match_sql(_action(c))
_concrete = lambda c: (
    f"({_plain(c)} <> '' AND NOT {matches(_plain(c), L.VAGUE_ACTION)} AND {matches(_plain(c), L.ACTION)} AND len(list_filter({words_sql(f'''regexp_replace({_plain(c)}, {sql_text('(?i)^.*?' + re2(L.ACTION))}, ' ')''')}, lambda w: w NOT IN ({_list(L.NO_CONTENT)}))) > 0)"
)
_person = lambda c: f"regexp_replace(trim({c}), {sql_text('(?i)' + re2(L.ADDRESS))}, '')"
_owns = lambda c: f"({match_sql(_person(c))} <> '' AND {match_sql(_person(c))} NOT IN ({_list(L.NO_OWNERS)}) AND length({match_sql(_person(c))}) >= 2)"
_assigned = f"substr(t, length(regexp_extract(t, {sql_text('(?i)^(.*?)(?:^|[^' + chr(92) + 'pL' + chr(92) + 'pN_])(?:' + L.ASSIGNED_VERBS + ')(?:$|[^' + chr(92) + 'pL' + chr(92) + 'pN_])')}, 1)) + 2)"
_way = [
    _f(L.CANCEL), f"{_f(L.REASSIGN)} AND {_owns(_g(L.REASSIGN, 2))}", f"{_f(L.RENAME)} AND {_concrete(_g(L.RENAME, 2))}", f"{_f(L.DEADLINE)} AND due <> ''", _f(L.VAGUE_CHANGE), "noise", f"list_has_any(flags, [{_list(L.NO_EVENT)}])",
    matches(match_sql("t"), L.ROOT_QUESTION), f"{_f(L.LABELLED)} AND {_concrete(_g(L.LABELLED, 2))}", f"{_f(L.FIRST_PERSON)} AND {_concrete(_g(L.FIRST_PERSON, 1))} AND {_owns('speaker_name')}",
    f"{_f(L.NAMED)} AND {_concrete(_g(L.NAMED, 2))} AND {_owns(_g(L.NAMED, 1))}", f"{_f(L.ASSIGNED)} AND {_owns(_g(L.ASSIGNED, 1))} AND {_concrete(_assigned)}", f"{_f(L.ASSIGNED)} AND {_owns(_g(L.ASSIGNED, 1))}",
    f"{_f(L.VOCATIVE)} AND {_concrete(_g(L.VOCATIVE, 2))} AND {_owns(_g(L.VOCATIVE, 1))}", f"{_f(L.ENGLISH)} AND {_concrete(_g(L.ENGLISH, 1))} AND {_owns(_g(L.ENGLISH, 2))}", f"{_f(L.PLEASE)} AND {_concrete(_g(L.PLEASE, 2))} AND {_owns(_g(L.PLEASE, 1))}",
    " OR ".join(map(_f, (L.LABELLED, L.FIRST_PERSON, L.NAMED, L.ASSIGNED, L.VOCATIVE, L.PLEASE, L.ENGLISH))),
]
_named = lambda p: (f"CASE WHEN regexp_matches(trim({_g(p, 1)}), '^[A-Za-z0-9-]+$') THEN trim({_g(p, 1)}) ELSE '' END", f"CASE WHEN regexp_matches(trim({_g(p, 1)}), '^[A-Za-z0-9-]+$') THEN '' ELSE trim({_g(p, 1)}) END")
EXT17 = f"""WITH {SAID_SQL}, local AS (SELECT * REPLACE ([{_list(SENTENCES)}][order_index % {len(SENTENCES)} + 1] AS text_raw) FROM said){SAID_FLAGS_SQL[len(SAID_SQL):].replace('FROM said', 'FROM local')},
x AS (SELECT *, trim(text_raw) AS t, CASE WHEN {HAS_DATE_SQL} THEN 'D-' || clause_id ELSE '' END AS due, NOT list_has_any(flags, [{_list(guards.PRESERVED)}]) AND NOT {matches('text_raw', '\\btask\\s*[- ]?[a-z0-9]+\\b')}
    AND ({matches(match_sql('text_raw'), guards.BACKCHANNEL)} OR {matches(match_sql('text_raw'), guards.LOGISTICS)}) AS noise FROM flagged),
y AS (SELECT *, CASE {' '.join(f'WHEN {w} THEN {i}' for i, w in enumerate(_way))} ELSE 99 END AS way FROM x)
SELECT meeting_id, clause_id, CASE WHEN way IN (0, 1, 2, 3, 8, 9, 10, 11, 13, 14, 15) THEN 'EVENTS' WHEN way IN (4, 12, 16) THEN 'UNRESOLVED_REFERENCE' ELSE 'NO_EVENT' END AS decision,
  CASE WHEN way = 0 THEN 'EXPLICIT_CANCELLATION' WHEN way IN (1, 2) THEN 'EXPLICIT_HANDOFF' WHEN way = 3 THEN 'EXPLICIT_DEADLINE_CHANGE' WHEN way IN (4, 12, 16) THEN 'VAGUE_REFERENCE' WHEN way = 5 THEN 'INSUFFICIENT_CONTEXT'
    WHEN way = 6 THEN CASE WHEN list_contains(flags, 'PAST_COMPLETED') THEN 'PAST_WORK' ELSE 'SUGGESTION_ONLY' END WHEN way = 7 THEN 'QUESTION_ONLY' WHEN way IN (9, 10) THEN 'EXPLICIT_COMMITMENT' WHEN way IN (8, 11, 13, 14, 15) THEN 'EXPLICIT_ASSIGNMENT'
    WHEN {_f(L.QUESTION)} THEN 'QUESTION_ONLY' WHEN {_f(L.PROGRESS)} THEN 'PROGRESS_UPDATE' ELSE 'INSUFFICIENT_CONTEXT' END AS reason,
  CASE way WHEN 0 THEN 'CANCEL' WHEN 1 THEN 'REASSIGN' WHEN 2 THEN 'RENAME' WHEN 3 THEN 'REPLACE_DEADLINE' ELSE CASE WHEN way IN (8, 9, 10, 11, 13, 14, 15) THEN 'CREATE' ELSE '' END END AS operation,
  CASE way WHEN 0 THEN {_named(L.CANCEL)[0]} WHEN 1 THEN {_named(L.REASSIGN)[0]} WHEN 2 THEN {_g(L.RENAME, 1)} WHEN 3 THEN {_g(L.DEADLINE, 1)} WHEN 8 THEN {_g(L.LABELLED, 1)} ELSE '' END AS label,
  CASE way WHEN 0 THEN {_named(L.CANCEL)[1]} WHEN 1 THEN {_named(L.REASSIGN)[1]} ELSE '' END AS hint,
  CASE way WHEN 1 THEN {_person(_g(L.REASSIGN, 2))} WHEN 8 THEN trim({_g(L.LABELLED, 3)}) WHEN 9 THEN {_person('speaker_name')} WHEN 10 THEN {_person(_g(L.NAMED, 1))} WHEN 11 THEN {_person(_g(L.ASSIGNED, 1))} WHEN 13 THEN trim({_g(L.VOCATIVE, 1)})
    WHEN 14 THEN {_g(L.ENGLISH, 2)} WHEN 15 THEN {_person(_g(L.PLEASE, 1))} ELSE '' END AS assignee,
  CASE way WHEN 2 THEN trim({_g(L.RENAME, 2)}) WHEN 8 THEN {_action(_g(L.LABELLED, 2))} WHEN 9 THEN {_action(_g(L.FIRST_PERSON, 1))} WHEN 10 THEN {_action(_g(L.NAMED, 2))} WHEN 11 THEN {_action(_assigned)} WHEN 13 THEN {_action(_g(L.VOCATIVE, 2))}
    WHEN 14 THEN {_action(_g(L.ENGLISH, 1))} WHEN 15 THEN {_action(_g(L.PLEASE, 2))} ELSE '' END AS action, CASE WHEN way = 3 OR way IN (8, 9, 10, 11, 13, 14, 15) THEN due ELSE '' END AS deadline FROM y"""


def ext18_response_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of ten clauses, with answers spoiled by rule."""
    rows = said(spark, sf_dir).withColumn("segment_id", F.concat_ws("-", "meeting_id", F.floor(F.col("order_index") / 10)))
    i = F.col("order_index")
    answers = rows.where(i % 37 != 5).select(
        "segment_id", F.explode(F.when(i % 41 == 3, F.array("clause_id", "clause_id")).otherwise(F.array("clause_id"))).alias("clause_id"), F.when(i % 29 == 2, "UNRESOLVED_REFERENCE").otherwise("EVENTS").alias("decision"),
        F.when(i % 2 == 0, "CREATE").alias("operation"), F.when(i % 31 == 4, "CLAUSE-0").when(i % 3 == 0, F.col("clause_id")).alias("anchor_clause_id"),
    )
    return L.response_errors(rows.select("segment_id", "clause_id"), answers).withColumn("errors", F.array_join("errors", ","))


EXT18 = f"""WITH {SAID_SQL} SELECT meeting_id || '-' || order_index // 10 AS segment_id, array_to_string(list_filter([CASE WHEN bool_or(order_index % 41 = 3 AND order_index % 37 <> 5) THEN 'REPEATED' END, CASE WHEN bool_or(order_index % 37 = 5) THEN 'NOT_ALL_AND_ONLY' END,
  CASE WHEN bool_or(order_index % 31 = 4 AND order_index % 37 <> 5) THEN 'ANCHORED_ELSEWHERE' END, CASE WHEN bool_or(order_index % 29 = 2 AND order_index % 2 = 0 AND order_index % 37 <> 5) THEN 'UNRESOLVED_CREATES' END], lambda x: x IS NOT NULL), ',') AS errors FROM said GROUP BY 1"""


def off05_idempotency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions (orders) by the key of their parts and configuration: how many jobs, and how many repetitions."""
    key = F.sha2(F.concat_ws("\u0000", "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").cast("string"), F.lit("rules=v1;model=none")), 256)
    rows = table(spark, sf_dir, "orders").groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("job"))
    return rows.select("job", F.substring("key", 1, 16).alias("key"), (F.col("n") - 1).alias("repeated"))


OFF05 = """SELECT min(o_orderkey) AS job, substr(sha256(concat_ws(chr(0), o_orderstatus, o_orderpriority, CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 'rules=v1;model=none')), 1, 16) AS key, count(*) - 1 AS repeated FROM orders GROUP BY 2"""

NAMING = (
    'nhắc lại task "Budget report", và task Viết spec thanh toán đang active', "task này xong rồi", "Task deployment pipeline của em", "task có tên là “Kiểm thử”", "xem task TASK-12: gửi hợp đồng đã xong", "task b", "Task migration trạng thái là open",
    "task ghi chú không còn cần; task dashboard được giao",
)


def ext15_named_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, NAMING)), (F.col("order_index") % len(NAMING)).cast("int") + 1)
    return R.references(said(spark, sf_dir).withColumn("text_raw", text))


_edge = sql_text(R.EDGE)
_stop = lambda c, q: c if q else f"regexp_replace({c}, {sql_text('(?i)' + re2(R.STOP))}, '')"
_label = lambda c, q: f"regexp_replace(trim(regexp_replace({_stop(f'trim(regexp_replace({c}, {chr(39)}{chr(92)}s+{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)}), {_edge})', q)}, {sql_text('(?i)' + re2(R.FILLER))}, ''), {_edge}), {sql_text('(?i)' + re2(R.NUMBERED))}, '')"
EXT15N = f"""WITH {SAID_SQL}, n AS (SELECT meeting_id, clause_id, [{_list(NAMING)}][order_index % {len(NAMING)} + 1] AS t FROM said),
q AS (SELECT meeting_id, clause_id, t, true AS quoted, unnest(regexp_extract_all(t, {sql_text('(?i)' + re2(R.QUOTED))}, 1)) AS raw FROM n UNION ALL SELECT meeting_id, clause_id, t, false, unnest(regexp_extract_all(t, {sql_text('(?i)' + re2(R.PLAIN))}, 1)) FROM n),
k AS (SELECT *, CASE WHEN quoted THEN {_label('raw', True)} ELSE {_label('raw', False)} END AS label FROM q WHERE quoted OR NOT regexp_matches(raw, '^(?i)(?:c[oó]\\s+t[eê]n\\s+l[aà]\\s*)?["“]')),
m AS (SELECT *, trim({match_sql('label')}) AS own FROM k)
SELECT meeting_id, clause_id, upper(substr(label, 1, 1)) || substr(label, 2) AS label, (CASE WHEN {matches('t', R.ACTIVE)} THEN 0.98 WHEN quoted THEN 0.92 ELSE 0.88 END)::DOUBLE AS confidence, CASE WHEN {matches('t', R.ACTIVE)} THEN 'RULE_REFERENCE_ACTIVE' ELSE 'RULE_REFERENCE' END AS source
FROM m WHERE own <> '' AND NOT {matches('own', R.VAGUE)} AND (quoted OR len(list_filter(string_split(own, ' '), lambda w: length(w) > 1)) >= 2 OR {matches('own', guards.DELIVERABLE)})"""

QUERIES = {
    "ext17_decisions": (ext17_decisions, EXT17), "ext18_response_errors": (ext18_response_errors, EXT18), "off05_idempotency": (off05_idempotency, OFF05), "ext15_named_tasks": (ext15_named_tasks, EXT15N),
}
