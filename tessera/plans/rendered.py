"""Meetings made from the `events` table: a deterministic text, or a task event, for each row.

user_id is the meeting, the order of (ts, event_id) is the clause order, and k is the number in `props`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import normalized, sequence_id

#: The date on which every rendered meeting takes place.
MEETING_DATE = "2024-02-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    k = F.coalesce(F.regexp_extract("props", "([0-9]+)", 1), F.lit(""))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("meeting_id"), "event_id", "event_type", "ts", (order - 1).alias("order_index"), k.alias("k"))


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    text = (
        F.when(kind == "signup", F.concat(F.lit("I will prepare report "), "k", F.lit(" by 2024-02-13")))
        .when(kind == "purchase", F.concat(F.lit("Tomorrow we will send invoice "), "k"))
        .when(kind == "error", F.concat(F.lit("Cancel task "), "k"))
        .when(kind == "click", F.concat(F.lit("Move to 2024-03-05 for task "), "k"))
        .otherwise(F.concat(F.lit("Maybe we should review page "), "k", F.lit(" before Friday")))
    )
    rows = _ordered(spark, sf_dir).withColumn("text_raw", text)
    return rows.select(
        "meeting_id", sequence_id("CLAUSE", F.col("order_index") + 1).alias("clause_id"), "order_index", F.concat(F.lit("P"), F.col("event_id") % 3).alias("speaker_name"),
        "text_raw", normalized(F.col("text_raw")).alias("text_normalized"),
    )


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    event = (
        F.when(kind == "signup", "TASK_CREATE").when(kind == "purchase", "OWNER_ASSIGN").when(kind == "error", "TASK_CANCEL").when(kind == "click", "DEADLINE_REPLACE").otherwise("OWNER_REASSIGN")
    )
    rows = _ordered(spark, sf_dir).withColumn("number", (F.col("k").cast("long") % 7).cast("string"))
    return rows.select(
        "meeting_id", sequence_id("EVENT", F.col("order_index") + 1).alias("event_id"), event.alias("event_type"), F.lit("").alias("related_task_id"),
        F.concat(F.lit("Report "), "number").alias("action_text"), F.when(kind.isin("purchase", "view"), F.concat(F.lit("P"), F.col("event_id") % 3)).otherwise("").alias("assignee"),
        F.when(kind == "click", F.concat(F.lit("DATE-"), F.col("event_id") % 5)).otherwise("").alias("deadline_mention_id"),
        F.when(F.col("event_id") % 4 == 0, "AI").otherwise("RULE").alias("extraction_source"), F.lit(0.7).alias("confidence"),
        F.array(sequence_id("CLAUSE", F.col("order_index") + 1)).alias("source_clause_ids"), sequence_id("CLAUSE", F.floor(F.col("order_index") / 4) * 4 + 1).alias("anchor_clause_id"),
        F.col("order_index").cast("long").alias("order_index"), F.concat(F.lit("REPORT-"), "number").alias("bound_task_id"),
    )


ORDERED_SQL = """
ordered AS (
  SELECT user_id AS meeting_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS order_index,
         coalesce(regexp_extract(props, '([0-9]+)', 1), '') AS k
  FROM events
)"""

CLAUSES_SQL = (
    ORDERED_SQL
    + """, clauses AS (
  SELECT meeting_id, printf('CLAUSE-%06d', order_index + 1) AS clause_id, order_index, 'P' || (event_id % 3) AS speaker_name, event_type, k,
    CASE event_type WHEN 'signup' THEN 'I will prepare report ' || k || ' by 2024-02-13' WHEN 'purchase' THEN 'Tomorrow we will send invoice ' || k
      WHEN 'error' THEN 'Cancel task ' || k WHEN 'click' THEN 'Move to 2024-03-05 for task ' || k
      ELSE 'Maybe we should review page ' || k || ' before Friday' END AS text_raw
  FROM ordered
)"""
)

FLAGGED_SQL = (
    CLAUSES_SQL
    + r""", marked AS (
  SELECT *, lower(text_raw) AS t FROM clauses
), flagged AS (
  SELECT *, list_sort(list_filter([
    CASE WHEN regexp_matches(t, '\b(i|we)\s+(will|shall|can take|will own)\b') THEN 'FIRST_PERSON_COMMITMENT' END,
    CASE WHEN regexp_matches(t, '\bmoved?\s+to\b') THEN 'CORRECTION' END,
    CASE WHEN regexp_matches(t, '\bcancel(led)?\b') THEN 'CANCELLATION' END,
    CASE WHEN regexp_matches(t, '\b(maybe|should)\b') THEN 'BRAINSTORM' END,
    CASE WHEN regexp_matches(t, '\b(maybe|should)\b') THEN 'SUGGESTION_ONLY' END,
    CASE WHEN regexp_matches(t, '\btask\s*[- ]?[a-z0-9]+\b') THEN 'EXPLICIT_TASK_LABEL' END,
    CASE WHEN regexp_matches(t, '\b(prepare|send|review)\b') THEN 'ACTION_VERB' END,
    CASE WHEN regexp_matches(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}|tomorrow|friday') THEN 'DATE_MENTION' END
  ], lambda x: x IS NOT NULL)) AS flags FROM marked
), scored AS (
  SELECT *, list_sum(list_transform(flags, lambda f: CASE f WHEN 'FIRST_PERSON_COMMITMENT' THEN 3 WHEN 'CANCELLATION' THEN 3 WHEN 'CORRECTION' THEN 2
      WHEN 'DATE_MENTION' THEN 2 WHEN 'ACTION_VERB' THEN 1 WHEN 'EXPLICIT_TASK_LABEL' THEN 1 ELSE -3 END)) AS score,
    len(list_filter(flags, lambda f: f NOT IN ('BRAINSTORM', 'SUGGESTION_ONLY'))) AS positive,
    list_has_any(flags, ['CORRECTION', 'CANCELLATION']) AS change,
    list_contains(flags, 'FIRST_PERSON_COMMITMENT') AS commitment
  FROM flagged
), candidates AS (
  SELECT *, change OR commitment AS candidate, CASE WHEN NOT (change OR commitment) THEN 'CONTEXT'
    WHEN change THEN CASE WHEN list_contains(flags, 'EXPLICIT_TASK_LABEL') THEN 'RULE' ELSE 'AI' END
    WHEN score >= 6 AND commitment AND list_contains(flags, 'ACTION_VERB') AND NOT list_contains(flags, 'BRAINSTORM') THEN 'RULE' ELSE 'AI' END AS strategy
  FROM scored
)"""
)

EVENTS_SQL = (
    ORDERED_SQL
    + """, task_events AS (
  SELECT meeting_id, printf('EVENT-%06d', order_index + 1) AS event_id,
    CASE event_type WHEN 'signup' THEN 'TASK_CREATE' WHEN 'purchase' THEN 'OWNER_ASSIGN' WHEN 'error' THEN 'TASK_CANCEL'
      WHEN 'click' THEN 'DEADLINE_REPLACE' ELSE 'OWNER_REASSIGN' END AS event_type,
    'Report ' || (CAST(k AS BIGINT) % 7) AS action_text, CASE WHEN event_type IN ('purchase', 'view') THEN 'P' || (event_id % 3) ELSE '' END AS assignee,
    CASE WHEN event_type = 'click' THEN 'DATE-' || (event_id % 5) ELSE '' END AS deadline_mention_id,
    CASE WHEN event_id % 4 = 0 THEN 'AI' ELSE 'RULE' END AS extraction_source, printf('CLAUSE-%06d', order_index + 1) AS source_clause_id,
    printf('CLAUSE-%06d', order_index // 4 * 4 + 1) AS anchor_clause_id, order_index, 'REPORT-' || (CAST(k AS BIGINT) % 7) AS bound_task_id
  FROM ordered
)"""
)
