"""Queries over grounding: owners and deadlines of events, claims of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import sequence_id
from tessera.operators import grounding as G
from tessera.plans.rendered import ORDERED_SQL, _ordered
from tessera.plans.said import match_sql, matches, sql_text

NAMES = ("An", "Bình", "Chi", "Dũng")

#: What is said, by event_id: {p} is a participant other than the speaker.
SAID = (
    "Em sẽ gửi báo cáo doanh thu {k} trước thứ sáu", "{p} phụ trách dashboard {k} nhé", "Dạ, em nhận", "Anh {p}, gửi giúp tài liệu {k}", "Hạn của task B{k} là ngày mai", "ok", "Chúng ta đổi deadline báo cáo doanh thu {k}",
    "Mình hủy việc gửi báo cáo doanh thu {k}", "Vâng, em làm trong tuần này", "Xong dashboard {k} rồi",
)


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)
    k = F.col("event_id")
    text = F.replace(F.replace(of(SAID, k), F.lit("{k}"), (F.coalesce(F.expr("try_cast(k as int)"), F.lit(0)) % 5).cast("string")), F.lit("{p}"), of(NAMES, F.floor(k / 3) + 1))
    flags = F.when(k % 10 == 7, F.array(F.lit("CANCELLATION"))).when(k % 10 == 6, F.array(F.lit("CORRECTION"))).otherwise(F.array().cast("array<string>"))
    return _ordered(spark, sf_dir).select(
        "meeting_id", sequence_id("CLAUSE", F.col("order_index") + 1).alias("clause_id"), "order_index", "event_id", of(NAMES, F.floor(k / 3)).alias("speaker_name"), text.alias("text_raw"), flags.alias("flags")
    )


_CLAUSES = ORDERED_SQL + f""", c AS (SELECT meeting_id, event_id, order_index, printf('CLAUSE-%06d', order_index + 1) AS clause_id, [{", ".join(map(sql_text, NAMES))}][event_id // 3 % 4 + 1] AS speaker,
    replace(replace([{", ".join(map(sql_text, SAID))}][event_id % 10 + 1], '{{k}}', CAST(coalesce(TRY_CAST(k AS INTEGER), 0) % 5 AS VARCHAR)), '{{p}}', [{", ".join(map(sql_text, NAMES))}][(event_id // 3 + 1) % 4 + 1]) AS said FROM ordered)"""


def jon12_owner_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each clause's event belongs to its speaker, to the next participant or to both, and rests on it and the clause before."""
    rows, k = clauses(spark, sf_dir), F.col("event_id")
    other = F.element_at(F.array(*map(F.lit, NAMES)), ((F.floor(k / 3) + 1) % 4).cast("int") + 1)
    owner = F.when(k % 4 == 0, F.concat_ws("; ", "speaker_name", other)).when(k % 4 == 1, other).when(k % 4 == 2, F.col("speaker_name")).otherwise("")
    events = rows.select(
        "meeting_id", F.concat_ws("/", "meeting_id", "clause_id").alias("event_id"), F.when(k % 7 == 0, "OWNER_REASSIGN").otherwise("OWNER_ASSIGN").alias("event_type"), owner.alias("assignee"),
        F.array("clause_id", sequence_id("CLAUSE", F.col("order_index"))).alias("source_clause_ids"),
    )
    return G.owner_evidence(events, rows)


_NAMED = "CASE owner " + " ".join(f"WHEN '{n}' THEN regexp_extract(said, '(?i)(?:^|[^\\pL\\pN_])({n})(?:$|[^\\pL\\pN_])', 1)" for n in NAMES) + " END"
JON12 = f"""WITH {_CLAUSES}, e AS (SELECT *, [{", ".join(map(sql_text, NAMES))}][(event_id // 3 + 1) % 4 + 1] AS other FROM c),
o AS (SELECT *, unnest(CASE event_id % 4 WHEN 0 THEN [speaker, other] WHEN 1 THEN [other] WHEN 2 THEN [speaker] ELSE [] END) AS owner FROM e),
s AS (SELECT o.meeting_id, o.clause_id AS event, o.event_id % 7 = 0 AS again, owner, step, c.clause_id, c.speaker, c.said FROM o CROSS JOIN (VALUES (0), (1)) t(step) JOIN c ON c.meeting_id = o.meeting_id AND c.order_index = o.order_index - step),
f AS (SELECT *, {matches("said", G.ACCEPTANCE)} AS accepts, {matches("said", G.SELF_COMMITMENT)} AS commits, {matches("said", G.ROLE_ASSIGNMENT)} AS role, speaker = owner AS speaks, {_NAMED} AS named FROM s),
g AS (SELECT *, CASE WHEN named <> '' THEN named WHEN speaks AND (accepts OR commits) THEN speaker END AS span FROM f)
SELECT meeting_id, meeting_id || '/' || event AS event_id, owner, clause_id, span, CASE WHEN again THEN 'OWNER_REASSIGNMENT' WHEN speaks AND accepts THEN 'EXPLICIT_ACCEPTANCE' WHEN speaks AND commits THEN 'SELF_COMMITMENT' WHEN role THEN 'ROLE_ASSIGNMENT' ELSE 'DIRECT_ASSIGNMENT' END AS evidence_type
FROM g WHERE span IS NOT NULL QUALIFY row_number() OVER (PARTITION BY meeting_id, event, owner ORDER BY step) = 1"""


def jon13_deadline_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose deadline is mentioned in their own clause, in one up to four later, or nowhere."""
    rows, i = clauses(spark, sf_dir), F.col("order_index")
    mentions = rows.where("event_id % 10 in (0, 4, 6, 8)").select("meeting_id", F.concat(F.lit("D"), "order_index").alias("date_mention_id"), "clause_id")
    events = rows.select(
        "meeting_id", F.concat_ws("/", "meeting_id", "clause_id").alias("event_id"), F.when(i % 3 == 0, "Gửi báo cáo doanh thu 1").when(i % 3 == 1, "dashboard").otherwise("gửi tài liệu").alias("action_text"),
        F.when(i % 8 == 0, "báo cáo doanh thu 2").otherwise("").alias("related_task_hint"), F.when(i % 6 == 5, "").otherwise(F.concat(F.lit("D"), i + F.col("event_id") % 5)).alias("deadline_mention_id"),
        F.array("clause_id").alias("source_clause_ids"),
    )
    return G.deadline_attachments(events, mentions, rows)


JON13 = f"""WITH {_CLAUSES}, e AS (SELECT meeting_id, clause_id, order_index AS i, order_index + event_id % 5 AS due, {match_sql("CASE WHEN order_index % 8 = 0 THEN 'báo cáo doanh thu 2' WHEN order_index % 3 = 0 THEN 'Gửi báo cáo doanh thu 1' WHEN order_index % 3 = 1 THEN 'dashboard' ELSE 'gửi tài liệu' END")} AS hint FROM c WHERE order_index % 6 <> 5),
m AS (SELECT meeting_id, order_index, clause_id, {match_sql("said")} AS said FROM c WHERE event_id % 10 IN (0, 4, 6, 8))
SELECT e.meeting_id, e.meeting_id || '/' || e.clause_id AS event_id, coalesce(m.clause_id, '') AS mention_clause_id, CASE WHEN m.clause_id IS NULL THEN 'UNRESOLVED' WHEN m.order_index = e.i THEN 'SAME_ACTION_SOURCE'
  WHEN hint LIKE '% %' AND (contains(m.said, hint) OR regexp_matches(m.said, '(?:^|[^a-z0-9_])task\\s+[a-z0-9-]+')) THEN 'EXPLICIT_TASK_LABEL' WHEN abs(m.order_index - e.i) = 1 THEN 'ADJACENT_SUPPORT' ELSE 'UNRESOLVED' END AS attachment_type
FROM e LEFT JOIN m ON m.meeting_id = e.meeting_id AND m.order_index = e.due"""

#: Claims of each meeting's note: text, action, owner, date and operation.
CLAIMS = (
    ("An gửi báo cáo doanh thu 1 trước thứ sáu", "gửi báo cáo doanh thu 1", "An", "thứ sáu", None), ("dashboard 2 phụ trách", "phụ trách dashboard 2", "Chi", None, None), ("Hủy gửi báo cáo doanh thu 3", "gửi báo cáo doanh thu 3", None, None, "CANCEL"),
    ("Mua máy chủ mới", None, None, None, None), ("đổi deadline báo cáo doanh thu 4", "đổi deadline báo cáo doanh thu 4", None, None, "STATE"), ("gửi tài liệu 0", "gửi giúp tài liệu 0", "", None, "gửi"),
)


def jon08_note_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each meeting supports the claims of its note."""
    rows = clauses(spark, sf_dir)
    claims = spark.createDataFrame([(i, *c) for i, c in enumerate(CLAIMS)], "claim_id int, text string, action_hint string, owner_hint string, date_hint string, operation_hint string")
    own = rows.select("meeting_id").distinct().withColumn("one", F.lit(1)).join(F.broadcast(claims.withColumn("one", F.lit(1))), "one").drop("one")
    found = G.grounded_claims(own, rows)
    return found.select("meeting_id", "claim_id", "level", F.array_join("clause_ids", ",").alias("clause_ids"), F.round("semantic", 6).alias("semantic"), F.round("lexical", 6).alias("lexical"), F.round("margin", 6).alias("margin"), F.array_join("against", ",").alias("against"))


QUERIES = {
    "jon12_owner_evidence": (jon12_owner_evidence, JON12), "jon13_deadline_attachments": (jon13_deadline_attachments, JON13), "jon08_note_claims": (jon08_note_claims, None),
}
