"""Queries over guards, relevance and recaps, on meetings of many shapes of sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import guards, recaps
from tessera.plans.said import SAID_FLAGS_SQL, SAID_SQL, annotated, keywords_sql, match_sql, matches, said, sql_text, words_sql

_VERBS = "|".join(guards.PLAIN_VERBS)
_list = lambda values: ", ".join(map(sql_text, values))


def guard_sql(column: str) -> str:
    """The guard of a phrase as SQL over `column`."""
    own = f"trim({match_sql(column)})"
    verb = f"regexp_extract({own}, '^({_VERBS})(?: |$)', 1)"
    starts = " OR ".join(f"starts_with({own}, {sql_text(x)})" for x in guards.VAGUE_START)
    return f"""CASE WHEN coalesce({own}, '') = '' THEN 'EMPTY' WHEN {own} IN ({_list(guards.PRONOUN_ONLY)}) THEN 'PRONOUN_ONLY' WHEN {own} IN ({_list(guards.VAGUE)}) OR {starts} THEN 'VAGUE_ADMIN'
  WHEN {verb} = '' THEN 'NO_ACTION_VERB' WHEN len(list_filter({words_sql(f'substr({own}, length({verb}) + 1)')}, lambda w: w NOT IN ({_list(guards.NON_OBJECT)}))) = 0 THEN 'NO_OBJECT' ELSE 'CONCRETE' END"""


def cue07_action_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir).select("meeting_id", "clause_id", guards.action_guard(F.col("text_raw")).alias("guard"))


CUE07 = f"WITH {SAID_SQL} SELECT meeting_id, clause_id, {guard_sql('text_raw')} AS guard FROM said"


def cue09_section_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir).select("meeting_id", "clause_id", guards.ends_section_only(F.col("text_raw")).alias("section_only"))


CUE09 = f"""WITH {SAID_SQL}, m AS (SELECT *, {match_sql('text_raw')} AS own FROM said)
SELECT meeting_id, clause_id, {matches('own', guards.SECTION_END)} AND NOT {matches('own', guards.TASK_OBJECT)} AND NOT {matches('own', guards.TERMINAL)} AS section_only FROM m"""


def cue10_promotable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows the word task, and whether it may become a task."""
    label = F.regexp_extract("text_raw", "(?iU)\\btask\\s+(.+)$", 1)
    rows = said(spark, sf_dir).select("meeting_id", "clause_id", F.when(label == "", F.col("text_raw")).otherwise(label).alias("label"))
    return rows.select("meeting_id", "clause_id", guards.promotable(F.col("label")).alias("promotable"))


CUE10 = f"""WITH {SAID_SQL}, l AS (SELECT *, regexp_extract(text_raw, '(?i)(?:^|[^\\pL\\pN_])task\\s+(.+)$', 1) AS tail FROM said),
m AS (SELECT *, trim({match_sql("CASE WHEN tail = '' THEN text_raw ELSE tail END")}) AS own FROM l)
SELECT meeting_id, clause_id, own <> '' AND NOT {matches('own', *guards.NOT_A_REFERENCE)} AND len(string_split(own, ' ')) >= 2
  AND (regexp_matches(own, '^(?:{_VERBS})(?: |$)') OR {matches('own', '(?:^|\\s[-:]\\s|\\btask\\s+\\d+\\s*[:-]\\s)(?:.*[^\\pL\\pN_])?(?:' + _VERBS + ')\\b')} OR {matches('own', guards.DELIVERABLE)}) AS promotable FROM m"""


def cue11_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses by how much they matter; topics are the keywords of sentences that change the subject."""
    rows = annotated(spark, sf_dir).withColumn("keywords", T.keywords(F.col("text_raw")))
    topics = rows.where(F.col("text_raw").startswith("Chuyển sang chủ đề")).groupBy("meeting_id").agg(F.slice(F.array_sort(F.collect_set("keywords")), 1, 12).alias("topics"))
    rows = rows.join(topics, "meeting_id", "left")
    shared = lambda t: F.size(F.array_intersect("keywords", t)) / F.least(F.size(t), F.size("keywords"))
    on_topic = F.coalesce(F.exists("topics", lambda t: (F.size("keywords") > 0) & (F.size(t) > 0) & (shared(t) >= 0.45)), F.lit(False))
    kind, score, reasons = guards.relevance(F.col("order_index") % 13 == 0, on_topic)
    return rows.select("meeting_id", "clause_id", kind.alias("relevance"), score.alias("score"), F.array_join(reasons, ",").alias("reasons"))


CUE11 = f"""WITH {SAID_FLAGS_SQL}, k AS (SELECT *, {match_sql('text_raw')} AS own, {keywords_sql('text_raw')} AS keywords FROM flagged),
t AS (SELECT meeting_id, list(keywords ORDER BY keywords)[1:12] AS topics FROM (SELECT DISTINCT meeting_id, keywords FROM k WHERE starts_with(text_raw, 'Chuyển sang chủ đề')) GROUP BY meeting_id),
r AS (SELECT k.*, list_sort(list_intersect(flags, [{_list(guards.PRESERVED)}])) || CASE WHEN {matches('text_raw', '\\btask\\s*[- ]?[a-z0-9]+\\b')} THEN ['TASK_LABEL'] ELSE [] END AS kept,
  {matches('own', guards.BACKCHANNEL)} OR {matches('own', guards.LOGISTICS)} AS noise, order_index % 13 = 0 AS grounded,
  coalesce(len(list_filter(topics, lambda t: len(keywords) > 0 AND len(t) > 0 AND len(list_intersect(keywords, t)) / least(len(t), len(keywords)) >= 0.45)) > 0, false) AS on_topic
  FROM k LEFT JOIN t USING (meeting_id))
SELECT meeting_id, clause_id, CASE WHEN len(kept) > 0 THEN 'MANDATORY' WHEN noise THEN 'NOISE' WHEN grounded OR on_topic THEN 'LIKELY' ELSE 'CONTEXT' END AS relevance,
  (CASE WHEN len(kept) > 0 THEN 100.0 WHEN noise THEN -30.0 WHEN grounded THEN 25.0 WHEN on_topic THEN 10.0 ELSE 0.0 END)::DOUBLE AS score,
  array_to_string(kept || CASE WHEN len(kept) > 0 THEN [] WHEN noise THEN ['HARD_NOISE'] WHEN grounded THEN ['NOTE_GROUNDED'] WHEN on_topic THEN ['TOPIC_MATCH'] ELSE [] END, ',') AS reasons FROM r"""


def cue13_recap_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of stretches of eight clauses, so that all scopes occur."""
    rows = said(spark, sf_dir).withColumn("meeting_id", F.concat_ws("-", "meeting_id", F.floor(F.col("order_index") / 8)))
    return recaps.scopes(rows)


CUE13 = f"""WITH {SAID_SQL}, s AS (SELECT meeting_id || '-' || order_index // 8 AS meeting_id, {matches('text_raw', *recaps.CLOSURES)} AS closing,
  CASE WHEN {matches('text_raw', *recaps.AUTHORITATIVE)} THEN 3 WHEN {matches('text_raw', *recaps.COMPLETE)} THEN 2 WHEN {matches('text_raw', *recaps.ANY)} THEN 1 ELSE 0 END AS level FROM said)
SELECT meeting_id, bool_or(closing) AS closes, [{_list(recaps.LEVELS)}][max(level) + 1] AS scope FROM s GROUP BY meeting_id"""

QUERIES = {
    "cue07_action_guard": (cue07_action_guard, CUE07), "cue09_section_ends": (cue09_section_ends, CUE09), "cue10_promotable": (cue10_promotable, CUE10),
    "cue11_relevance": (cue11_relevance, CUE11), "cue13_recap_scopes": (cue13_recap_scopes, CUE13),
}
