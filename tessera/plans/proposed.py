"""Queries over proposals of tasks, on meetings of many shapes of sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import proposals as P
from tessera.operators.cues import VERBS
from tessera.plans.guarding import guard_sql
from tessera.plans.said import HAS_DATE_SQL, SAID_FLAGS_SQL, annotated, has_date, matches, re2, sql_text, words_sql

_list = lambda values: ", ".join(map(sql_text, values))


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.seeds(annotated(spark, sf_dir), has_date())


def evd01_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeds(spark, sf_dir).select("meeting_id", "seed_id", F.array_join("roles", ",").alias("roles"), "rule_confidence")


_OWNER = f"list_has_any(flags, ['DIRECT_ASSIGNMENT', 'FIRST_PERSON_COMMITMENT']) OR {matches('text_raw', P.COMMITMENT, P.ASSIGNMENT)}"
SEEDS_SQL = (
    SAID_FLAGS_SQL
    + f""", seeds AS (SELECT *, 'SEED-' || clause_id AS seed_id, list_filter([
    CASE WHEN list_contains(flags, 'CONFIRMATION') OR {matches('text_raw', P.ACCEPTANCE)} THEN 'ACCEPTANCE' END,
    CASE WHEN list_contains(flags, 'ACTION_VERB') OR {matches('text_raw', P.ACTION)} THEN 'ACTION' END, CASE WHEN {_OWNER} THEN 'AUTHORITY' END, CASE WHEN {HAS_DATE_SQL} THEN 'DEADLINE' END,
    CASE WHEN list_has_any(flags, [{_list(P.CHANGING)}]) THEN 'MUTATION' END, CASE WHEN list_has_any(flags, [{_list(P.AGAINST)}]) THEN 'NEGATIVE' END, CASE WHEN {_OWNER} THEN 'OWNER' END,
    CASE WHEN {matches('text_raw', P.RECAP)} THEN 'RECAP' END, CASE WHEN {matches('text_raw', P.REFERENCE)} THEN 'TASK_REFERENCE' END], lambda x: x IS NOT NULL) AS roles FROM flagged),
s AS (SELECT * FROM seeds WHERE len(roles) > 0)"""
)

EVD01 = f"""WITH {SEEDS_SQL} SELECT meeting_id, seed_id, array_to_string(roles, ',') AS roles,
  round(least(0.99, 0.45 + len(list_filter(flags, lambda f: f IN ('FIRST_PERSON_COMMITMENT', 'DIRECT_ASSIGNMENT', 'CONFIRMATION', 'DATE_MENTION', 'CORRECTION', 'CANCELLATION', 'REJECTION', 'ACTION_VERB', 'EXPLICIT_TASK_LABEL'))) * 0.12), 6)::DOUBLE AS rule_confidence FROM s"""


def jon03_seed_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.relations(_seeds(spark, sf_dir)).select("meeting_id", "nucleus", "support", "relation", F.col("distance").cast("long").alias("distance"), "score", "scope")


RELATIONS_SQL = (
    SEEDS_SQL
    + """, p AS (SELECT a.meeting_id, a.seed_id AS nucleus, b.seed_id AS support, abs(b.order_index - a.order_index) AS distance, b.order_index >= a.order_index AS not_before, b.roles, a.speaker_name = b.speaker_name AS same,
    b.order_index > a.order_index AND a.speaker_name = b.speaker_name AND NOT EXISTS (SELECT 1 FROM s c WHERE c.meeting_id = a.meeting_id AND c.order_index > a.order_index AND c.order_index < b.order_index
      AND list_has_any(c.roles, ['ACTION', 'TASK_REFERENCE'])) AS follows
  FROM s a JOIN s b ON a.meeting_id = b.meeting_id AND a.seed_id <> b.seed_id AND abs(b.order_index - a.order_index) <= 24),
k AS (SELECT *, CASE WHEN distance <= 3 AND list_contains(roles, 'AUTHORITY') THEN 'AUTHORIZES/LOCAL' WHEN distance <= 3 AND list_contains(roles, 'DEADLINE') THEN 'HAS_DEADLINE/LOCAL'
    WHEN distance <= 3 AND list_contains(roles, 'ACCEPTANCE') AND not_before THEN 'ACCEPTS/RESPONSE' WHEN distance <= 3 AND list_contains(roles, 'OWNER') THEN 'OWNS/LOCAL'
    WHEN same AND distance <= 1 THEN 'CONTINUES_ACTION/LOCAL' WHEN follows AND list_contains(roles, 'AUTHORITY') THEN 'AUTHORIZES/SAME_SPEAKER_FOLLOW_UP'
    WHEN follows AND list_contains(roles, 'DEADLINE') THEN 'HAS_DEADLINE/SAME_SPEAKER_FOLLOW_UP' WHEN follows AND list_contains(roles, 'OWNER') THEN 'OWNS/SAME_SPEAKER_FOLLOW_UP' END AS kind FROM p),
f AS (SELECT *, split_part(kind, '/', 1) AS relation, split_part(kind, '/', 2) AS scope FROM k WHERE kind IS NOT NULL),
g AS (SELECT *, round(1 - distance / (CASE scope WHEN 'SAME_SPEAKER_FOLLOW_UP' THEN 25.0 ELSE 4.0 END) * 0.25, 3)::DOUBLE AS score FROM f),
relations AS (SELECT meeting_id, nucleus, support, relation, distance, score, scope FROM g
  UNION ALL SELECT meeting_id, nucleus, support, 'HAS_DEADLINE', distance, score, scope FROM g WHERE relation <> 'HAS_DEADLINE' AND list_contains(roles, 'DEADLINE')
  UNION ALL SELECT meeting_id, nucleus, support, 'ACCEPTS', distance, score, 'RESPONSE' FROM g WHERE relation <> 'ACCEPTS' AND list_contains(roles, 'ACCEPTANCE') AND not_before AND distance <= 3)"""
)

JON03 = f"WITH {RELATIONS_SQL} SELECT * FROM relations"


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _seeds(spark, sf_dir)
    return P.clusters(found, P.relations(found))


def evd02_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.transform("links", lambda x: F.concat_ws(":", x["support"], x["relation"]))
    return _clusters(spark, sf_dir).select("meeting_id", "clause_id", "kind", F.array_join(links, ",").alias("links"))


CLUSTERS_SQL = (
    RELATIONS_SQL
    + """, clusters AS (SELECT s.*, CASE WHEN list_contains(roles, 'MUTATION') THEN 'UPDATE' WHEN NOT list_contains(roles, 'ACTION') OR list_has_any(roles, ['NEGATIVE', 'RECAP']) THEN 'REFERENCE' ELSE 'CREATE' END AS kind FROM s)"""
)

EVD02 = f"""WITH {CLUSTERS_SQL} SELECT c.meeting_id, clause_id, kind, coalesce(string_agg(support || ':' || relation, ',' ORDER BY distance, support, relation), '') AS links
FROM clusters c LEFT JOIN relations r ON r.meeting_id = c.meeting_id AND r.nucleus = c.seed_id GROUP BY ALL"""


def ext20_action_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotated(spark, sf_dir).select("meeting_id", "clause_id", F.explode(P.action_spans(F.col("text_raw"))).alias("span"))
    return rows.select("meeting_id", "clause_id", "span.start", "span.text")


_SPAN_START = sql_text("(?i)^(?:" + "|".join(P.SPAN_VERBS) + ")(?:$|[^\\pL\\pN_])")
_SPAN_END = re2(P.SPAN_END)
SPANS_SQL = f"""list_filter(list_transform(list_filter(range(1, length(text_raw) + 1),
    lambda i: regexp_matches(substr(text_raw, i), {_SPAN_START}) AND (i = 1 OR NOT regexp_matches(substr(text_raw, i - 1, 1), '[\\pL\\pN_]'))),
    lambda i: {{'start': CAST(i - 1 AS INTEGER), 'text': rtrim(CASE WHEN regexp_matches(substr(text_raw, i), {sql_text('(?i)' + _SPAN_END)}) THEN regexp_extract(substr(text_raw, i), {sql_text('(?is)^(.*?)(?:' + _SPAN_END + ')')}, 1)
      ELSE substr(text_raw, i) END, ' ,.;:!?')}}), lambda x: x.text <> '')"""

EXT20 = f"WITH {SAID_FLAGS_SQL}, x AS (SELECT meeting_id, clause_id, unnest({SPANS_SQL}) AS span FROM flagged) SELECT meeting_id, clause_id, span.start AS start, span.text AS text FROM x"


def _identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.identities(_clusters(spark, sf_dir), annotated(spark, sf_dir))


def evd03_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identities(spark, sf_dir).select("meeting_id", "clause_id", "kind", "identity", "variant", F.coalesce("text", F.lit("")).alias("text"))


IDENTITIES_SQL = (
    CLUSTERS_SQL
    + f""", spans AS (SELECT meeting_id, clause_id, unnest({SPANS_SQL}) AS span FROM clusters),
cut AS (SELECT meeting_id, clause_id, span.start AS start, span.text AS text, 'FULL_BOUNDARY' AS variant FROM spans
  UNION SELECT meeting_id, clause_id, span.start, rtrim(array_to_string(string_split(span.text, ' ')[1:n], ' '), ' ,.;:!?'), 'TOKEN_PREFIX' FROM spans, (SELECT unnest(range(2, 8)) AS n) WHERE n <= len(string_split(span.text, ' '))),
one AS (SELECT meeting_id, clause_id, start, text, min(variant) AS variant FROM cut WHERE text <> '' GROUP BY ALL),
named AS (SELECT c.*, start, text, coalesce(variant, 'NO_SPAN') AS variant, CASE WHEN text IS NOT NULL AND kind = 'CREATE' THEN 'CREATE' ELSE 'REFERENCE' END AS role_kind FROM clusters c LEFT JOIN one o USING (meeting_id, clause_id)),
identities AS (SELECT *, 'PID-' || substr(sha256(role_kind || '|' || coalesce(nullif(lower(trim(text, ' ,.;:!?')), ''), clause_id)), 1, 16) AS identity FROM named)"""
)

EVD03 = f"WITH {IDENTITIES_SQL} SELECT meeting_id, clause_id, role_kind AS kind, identity, variant, coalesce(text, '') AS text FROM identities"


def ext19_action_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotated(spark, sf_dir).withColumn("frame", P.frame(F.col("text_raw")))
    return rows.select("meeting_id", "clause_id", F.when(F.col("frame.guard") == "CONCRETE", F.col("frame.action")).otherwise("").alias("action"), "frame.verb", "frame.object", "frame.guard")


_EDGE = " .,:;!?-–—"


def frame_sql(column: str, source: str, name: str) -> str:
    """CTEs that add action, verb, object and guard of `column` to the rows of `source`."""
    action = f"trim(trim(regexp_replace({column}, '\\s+', ' ', 'g')), {sql_text(_EDGE)})"
    for p in P.FRAME_START:
        action = f"regexp_replace({action}, {sql_text('(?i)' + re2(p))}, '')"
    for p in (P.FRAME_METHOD, P.FRAME_TIME, P.FRAME_QUESTION):
        action = f"trim(regexp_replace({action}, {sql_text('(?i)' + re2(p))}, ''))"
    verbs = "|".join(sorted(VERBS, key=lambda v: (-len(v), v)))
    return f"""{name}_a AS (SELECT *, trim({action}, {sql_text(_EDGE)}) AS bare FROM {source}),
{name}_b AS (SELECT *, upper(substr(bare, 1, 1)) || substr(bare, 2) AS action FROM {name}_a),
{name}_c AS (SELECT *, coalesce(nullif(lower(regexp_extract(action, {sql_text('(?i)^(' + verbs + ')(?:$|[^\\pL\\pN_])')}, 1)), ''), split_part(action, ' ', 1)) AS low FROM {name}_b),
{name} AS (SELECT *, upper(substr(low, 1, 1)) || substr(low, 2) AS verb, trim(substr(action, length(low) + 1)) AS object, {guard_sql('action')} AS guard FROM {name}_c)"""


EXT19 = f"WITH {SAID_FLAGS_SQL}, {frame_sql('text_raw', 'flagged', 'framed')} SELECT meeting_id, clause_id, CASE WHEN guard = 'CONCRETE' THEN action ELSE '' END AS action, verb, object, guard FROM framed"


def evd05_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic score, score and decision of each identity (the selected ones need 0.9 and authority)."""
    return P.ranked(_identities(spark, sf_dir)).select("meeting_id", "clause_id", "identity", "variant", "semantic", "score", "decision")


EVD05 = f"""WITH {IDENTITIES_SQL}, {frame_sql('text', 'identities', 'framed')},
links AS (SELECT meeting_id, nucleus AS seed_id, list_distinct(list(relation)) AS linked FROM relations GROUP BY ALL),
n AS (SELECT *, len(list_filter({words_sql('lower(object)')}, lambda w: w NOT IN ({_list(P.GENERIC)}))) AS concrete FROM framed),
m AS (SELECT n.*, coalesce(linked, []) AS linked, CASE WHEN text IS NULL OR guard <> 'CONCRETE' THEN 0.0 ELSE round(least(1.0, 0.55 + CASE WHEN concrete >= 2 THEN 0.25 WHEN concrete >= 1 THEN 0.10 ELSE 0.0 END
    + CASE WHEN concrete >= 4 THEN 0.10 ELSE 0.0 END + CASE WHEN NOT {matches('text', P.SPECULATIVE)} THEN 0.10 ELSE 0.0 END), 3) END::DOUBLE AS semantic FROM n LEFT JOIN links USING (meeting_id, seed_id)),
z AS (SELECT *, text IS NOT NULL AND role_kind = 'CREATE' AS proposed, CASE WHEN list_has_any(roles, ['NEGATIVE', 'RECAP']) THEN 0.0 ELSE round(least(1.0,
    CASE WHEN text IS NOT NULL AND role_kind = 'CREATE' THEN 0.55 ELSE 0.0 END + CASE WHEN text IS NOT NULL AND guard = 'CONCRETE' THEN 0.20 ELSE 0.0 END + CASE WHEN semantic >= 0.75 THEN 0.05 ELSE 0.0 END
    + CASE WHEN list_has_any(linked, ['AUTHORIZES', 'ACCEPTS']) THEN 0.15 ELSE 0.0 END + CASE WHEN list_contains(linked, 'OWNS') THEN 0.05 ELSE 0.0 END
    + CASE WHEN list_contains(linked, 'HAS_DEADLINE') THEN 0.05 ELSE 0.0 END), 3) END::DOUBLE AS score FROM m)
SELECT meeting_id, clause_id, identity, variant, semantic, score, CASE WHEN proposed AND guard = 'CONCRETE' AND list_contains(roles, 'AUTHORITY') AND semantic >= 0.75 AND score >= 0.90 THEN 'SELECTED' ELSE 'HELD_OUT' END AS decision FROM z"""

QUERIES = {
    "evd01_seeds": (evd01_seeds, EVD01), "jon03_seed_relations": (jon03_seed_relations, JON03), "evd02_clusters": (evd02_clusters, EVD02), "ext20_action_spans": (ext20_action_spans, EXT20),
    "evd03_identities": (evd03_identities, EVD03), "ext19_action_frames": (ext19_action_frames, EXT19), "evd05_ranking": (evd05_ranking, EVD05),
}
