"""Queries over candidates and their routes, on meetings of many shapes of sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import proposals as P
from tessera.operators import routing as R
from tessera.plans.proposed import SPANS_SQL
from tessera.plans.said import HAS_DATE_SQL, SAID_FLAGS_SQL, annotated, has_date, match_sql, matches, sql_text

_list = lambda values: ", ".join(map(sql_text, values))

ACTIVE = ("DIRECT_ASSIGNMENT", "SELF_COMMITMENT")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.action_candidates(annotated(spark, sf_dir, lambda t: R.marked(t.withColumn("due", has_date()).withColumn("action", F.get(P.action_spans(F.col("text_raw")), 0)["text"]))))


def win05_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select(
        "meeting_id", "candidate_id", F.array_join("primary", ",").alias("primary"), F.array_join("support", ",").alias("support"), "kind", "state", F.array_join("signals", ",").alias("signals"), F.array_join("against", ",").alias("against")
    )


CANDIDATES_SQL = (
    SAID_FLAGS_SQL
    + f""", a AS (SELECT *, ({SPANS_SQL})[1].text AS action, {HAS_DATE_SQL} AS due, CASE WHEN {matches('text_raw', R.ACCEPT)} THEN 'ACCEPT' WHEN list_contains(flags, 'ROOT_QUESTION') AND len({SPANS_SQL}) > 0 THEN 'ASK' END AS mark FROM flagged),
b AS (SELECT a.*, (SELECT p.mark FROM a p WHERE p.meeting_id = a.meeting_id AND p.order_index < a.order_index AND p.mark IS NOT NULL ORDER BY p.order_index DESC LIMIT 1) AS last_mark,
    (SELECT struct_pack(mark := n.mark, clause_id := n.clause_id, order_index := n.order_index) FROM a n WHERE n.meeting_id = a.meeting_id AND n.order_index > a.order_index AND n.mark IS NOT NULL ORDER BY n.order_index LIMIT 1) AS nxt FROM a),
c AS (SELECT *, coalesce(mark = 'ACCEPT' AND last_mark = 'ASK', false) AS taken, list_sort(list_intersect(flags, [{_list(R.CREATING)}])) AS positive, list_sort(list_intersect(flags, [{_list(P.AGAINST)}])) AS negative FROM b),
d AS (SELECT *, coalesce(mark = 'ASK', false) AS asking, coalesce(mark = 'ASK' AND nxt.mark = 'ACCEPT', false) AS accepted,
    NOT coalesce(mark = 'ASK', false) AND NOT taken AND action IS NOT NULL AND (len(positive) > 0 OR list_contains(flags, 'ACTION_VERB')) AS plain_one FROM c),
e AS (SELECT *, CASE WHEN accepted THEN 'CREATE' WHEN asking THEN 'UNKNOWN' WHEN list_has_any(flags, [{_list(P.CHANGING)}]) THEN 'MUTATION' WHEN {matches('text_raw', R.RECAP_ITEM)} THEN 'RECAP_ITEM' WHEN len(negative) > 0 THEN 'UNKNOWN' ELSE 'CREATE' END AS kind,
    due AND NOT asking AND NOT plain_one AND NOT taken AS only_due FROM d),
f AS (SELECT *, CASE WHEN accepted THEN 'ACCEPTED' WHEN asking OR kind IN ('MUTATION', 'UNKNOWN') THEN 'REFERENCE_ONLY' WHEN kind = 'RECAP_ITEM' OR list_contains(flags, 'CONFIRMATION') THEN 'CONFIRMED' ELSE 'PROPOSED' END AS state,
    CASE WHEN accepted THEN ['EXPLICIT_ACCEPTANCE', 'QUESTION_THEN_ACCEPTANCE'] WHEN asking THEN ['QUESTION_UNCONFIRMED'] ELSE positive END AS signals,
    CASE WHEN accepted THEN [] WHEN asking THEN ['ROOT_QUESTION'] ELSE negative END AS against, CASE WHEN accepted THEN [clause_id, nxt.clause_id] ELSE [clause_id] END AS prim,
    CASE WHEN accepted THEN nxt.order_index ELSE order_index END AS last_at FROM e),
candidates AS (SELECT *, CASE WHEN kind = 'CREATE' THEN coalesce((SELECT list(s.clause_id ORDER BY s.order_index) FROM f s WHERE s.meeting_id = f.meeting_id AND s.only_due AND s.order_index > f.last_at
      AND NOT EXISTS (SELECT 1 FROM f g WHERE g.meeting_id = f.meeting_id AND g.order_index > f.last_at AND g.order_index < s.order_index AND NOT g.only_due)), []) ELSE [] END AS support,
    'ACAND-' || substr(sha256(array_to_string(prim, '|') || '|' || lower(trim(action))), 1, 16) AS candidate_id FROM f WHERE asking OR plain_one)"""
)

WIN05 = f"""WITH {CANDIDATES_SQL} SELECT meeting_id, candidate_id, array_to_string(prim, ',') AS primary, array_to_string(support, ',') AS support, kind, state, array_to_string(signals, ',') AS signals, array_to_string(against, ',') AS against FROM candidates"""


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir)
    texts = annotated(spark, sf_dir).select("meeting_id", F.col("clause_id").alias("accepting"), F.col("text_raw").alias("accepted_text"))
    rows = rows.withColumn("accepting", F.when(F.size("primary") == 2, F.col("primary")[1])).join(texts, ["meeting_id", "accepting"], "left")
    rows = rows.withColumn("said", F.concat_ws(" ", "text_raw", "accepted_text")).withColumn("authority", R.authority())
    return rows.withColumn("commitment", R.commitment_route(F.col("authority"), ACTIVE))


def evd07_commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("meeting_id", "candidate_id", "authority", "commitment")


AUTHORITY_SQL = (
    CANDIDATES_SQL
    + f""", q AS (SELECT c.*, concat_ws(' ', c.text_raw, t.text_raw) AS said FROM candidates c LEFT JOIN flagged t ON t.meeting_id = c.meeting_id AND len(prim) = 2 AND t.clause_id = prim[2]),
r AS (SELECT *, CASE WHEN state = 'ACCEPTED' THEN 'EXPLICIT_ACCEPTANCE' WHEN list_contains(against, 'ROOT_QUESTION') OR (state = 'REFERENCE_ONLY' AND contains(array_to_string(signals, ' '), 'QUESTION')) THEN 'QUESTION_UNCONFIRMED'
    WHEN list_contains(against, 'REJECTION') THEN 'REJECTION' WHEN list_contains(against, 'CANCELLATION') THEN 'CANCELLATION' WHEN list_contains(against, 'PAST_COMPLETED') THEN 'PAST_COMPLETED'
    WHEN list_contains(against, 'HYPOTHETICAL') THEN 'HYPOTHETICAL' WHEN list_contains(against, 'SUGGESTION_ONLY') THEN 'SUGGESTION_ONLY' WHEN list_contains(against, 'PROGRESS_UPDATE') THEN 'PROGRESS_ONLY'
    WHEN list_contains(against, 'ADMIN_FOLLOWUP') THEN 'ADMIN_FOLLOWUP' WHEN {matches('said', R.CONDITIONAL)} THEN 'CONDITIONAL' WHEN {matches('said', R.FOLLOWING_UP)} THEN 'ADMIN_FOLLOWUP'
    WHEN kind IN ('MUTATION', 'REFERENCE', 'UNKNOWN') OR state = 'REFERENCE_ONLY' THEN 'REFERENCE_ONLY' WHEN list_contains(signals, 'DIRECT_ASSIGNMENT') THEN 'DIRECT_ASSIGNMENT'
    WHEN list_contains(signals, 'FIRST_PERSON_COMMITMENT') THEN 'SELF_COMMITMENT' WHEN state = 'CONFIRMED' THEN 'CONFIRMED_ACTION' ELSE 'REFERENCE_ONLY' END AS authority FROM q),
routed AS (SELECT *, CASE WHEN authority IN ({_list(R.DROPPED)}) THEN 'DROP' WHEN authority IN ({_list(R.CONTEXT_ONLY)}) THEN 'CONTEXT_ONLY' WHEN authority IN ({_list(ACTIVE)}) THEN 'LOCAL_CREATE' ELSE 'AI_CREATE_CHECK' END AS commitment FROM r)"""
)

EVD07 = f"WITH {AUTHORITY_SQL} SELECT meeting_id, candidate_id, authority, commitment FROM routed"


def evd06_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, authority and parts of confidence of each candidate as a proposal."""
    rows = _candidates(spark, sf_dir)
    kind = F.when(F.col("kind") == "CREATE", "CREATE").when(F.col("kind") == "MUTATION", "UPDATE").otherwise("REFERENCE")
    signals = F.when(F.col("kind") == "RECAP_ITEM", F.array_sort(F.array_union("signals", F.array(F.lit("RECAP_REFERENCE"))))).otherwise(F.col("signals"))
    part = lambda test, low=0.0: F.when(test, 1.0).otherwise(low)
    return rows.select(
        "meeting_id", "candidate_id", kind.alias("proposal_kind"), F.array_join(signals, ",").alias("authority"), part(F.size("signals") > 0, 0.35).alias("rule_cue"), part(F.size("against") == 0).alias("negative_guard"),
        part(F.size("primary") + F.size("support") > 1).alias("multi_clause"),
    )


EVD06 = f"""WITH {CANDIDATES_SQL} SELECT meeting_id, candidate_id, CASE kind WHEN 'CREATE' THEN 'CREATE' WHEN 'MUTATION' THEN 'UPDATE' ELSE 'REFERENCE' END AS proposal_kind,
  array_to_string(list_sort(CASE WHEN kind = 'RECAP_ITEM' THEN list_distinct(signals || ['RECAP_REFERENCE']) ELSE signals END), ',') AS authority, (CASE WHEN len(signals) > 0 THEN 1.0 ELSE 0.35 END)::DOUBLE AS rule_cue,
  (CASE WHEN len(against) = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS negative_guard, (CASE WHEN len(prim) + len(support) > 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS multi_clause FROM candidates"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence with scores of a made-up classifier and notes, from the clause's place."""
    i = F.col("order_index")
    rows = R.evidence(annotated(spark, sf_dir))
    score = lambda a, n: F.when(i % 9 != 4, F.pmod(i * a, F.lit(100)) / n)
    return rows.select(
        *rows.columns, score(37, 100).alias("action_score"), score(53, 125).alias("update_score"), score(71, 150).alias("other_score"), F.when(i % 4 == 0, F.pmod(i * 3, F.lit(10)) / 10).alias("note_score"), (i % 4 == 0).alias("note_action"),
        (i % 16 == 0).alias("note_state"), (i % 3 == 0).alias("one_target"),
    )


def evd08_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evidence(spark, sf_dir).withColumn("x", R.route())
    return rows.select("meeting_id", "clause_id", "x.route", F.round("x.confidence", 6).alias("confidence"), F.array_join("x.reasons", ",").alias("reasons"))


_any = lambda flags: f"list_has_any(flags, [{_list(flags)}])"
EVIDENCE_SQL = (
    SAID_FLAGS_SQL
    + f""", ev AS (SELECT *, {_any(R.CREATING)} AS creates, {_any(P.CHANGING)} AS changes, {_any(R.STRONGLY_AGAINST)} AS strongly, coalesce(CASE WHEN order_index % 9 <> 4 THEN order_index * 37 % 100 / 100 END, 0) AS act,
    coalesce(CASE WHEN order_index % 9 <> 4 THEN order_index * 53 % 100 / 125 END, 0) AS upd, coalesce(CASE WHEN order_index % 9 <> 4 THEN order_index * 71 % 100 / 150 END, 0) AS oth,
    coalesce(CASE WHEN order_index % 4 = 0 THEN order_index * 3 % 10 / 10 END, 0) AS note, order_index % 4 = 0 AS note_action, order_index % 16 = 0 AS note_state, order_index % 3 = 0 AS one_target FROM flagged),
way AS (SELECT *, CASE WHEN (changes OR note_state) AND one_target THEN 1 WHEN (changes OR note_state) AND (changes OR upd >= 0.45) THEN 2 WHEN changes OR note_state THEN 3 WHEN strongly THEN 4 WHEN act >= 0.82 THEN 5 WHEN act >= 0.45 THEN 6
    WHEN upd >= 0.45 THEN 7 WHEN note_action OR note_state THEN 8 ELSE 9 END AS way FROM ev),
routes AS (SELECT *, ['LOCAL_MUTATION', 'AI_MUTATION_CHECK', 'CONTEXT_ONLY', 'CONTEXT_ONLY', 'LOCAL_CREATE', 'AI_CREATE_CHECK', 'AI_MUTATION_CHECK', 'CONTEXT_ONLY', 'DROP'][way] AS route,
    round(CASE way WHEN 1 THEN greatest(upd, note, CASE WHEN changes THEN 1.0 ELSE 0.0 END) WHEN 2 THEN greatest(upd, note, 0.5) WHEN 3 THEN greatest(note, oth) WHEN 4 THEN greatest(oth, 0.5) WHEN 5 THEN act WHEN 6 THEN act WHEN 7 THEN upd
      WHEN 8 THEN greatest(note, oth) ELSE oth END, 6)::DOUBLE AS confidence,
    CASE way WHEN 1 THEN ['MUTATION_SIGNAL', 'UNIQUE_RULE_TARGET'] WHEN 2 THEN ['MUTATION_SIGNAL', 'TARGET_REQUIRES_RESOLUTION'] WHEN 3 THEN ['NOTE_STATE_WITHOUT_MUTATION_EVIDENCE']
      WHEN 4 THEN ['STRONG_NEGATIVE_GUARD', CASE WHEN list_contains(flags, 'ROOT_QUESTION') THEN 'QUESTION_GUARD' END, CASE WHEN list_contains(flags, 'HYPOTHETICAL') THEN 'HYPOTHETICAL_GUARD' END, CASE WHEN list_contains(flags, 'PAST_COMPLETED') THEN 'PAST_COMPLETED_GUARD' END]
      WHEN 5 THEN [CASE WHEN creates THEN 'RULE_CREATE_CORROBORATED' END, 'CLASSIFIER_CLEAR_ACTION', CASE WHEN note_action THEN 'NOTE_ACTION_CORROBORATED' END]
      WHEN 6 THEN ['CLASSIFIER_POSSIBLE_ACTION', CASE WHEN creates THEN 'RULE_CREATE_SIGNAL' END, CASE WHEN note_action THEN 'NOTE_ACTION_SIGNAL' END] WHEN 7 THEN ['CLASSIFIER_UPDATE_ONLY', 'TARGET_REQUIRES_RESOLUTION']
      WHEN 8 THEN ['NOTE_SIGNAL_BELOW_ROUTING_THRESHOLD'] ELSE ['INSUFFICIENT_ACTION_OR_MUTATION_EVIDENCE'] END AS reasons FROM way)"""
)

EVD08 = f"WITH {EVIDENCE_SQL} SELECT meeting_id, clause_id, route, confidence, array_to_string(list_filter(reasons, lambda x: x IS NOT NULL), ',') AS reasons FROM routes"


def evd09_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evidence(spark, sf_dir).withColumn("x", R.route())
    decisions = rows.select("meeting_id", "clause_id", F.round("x.confidence", 6).alias("confidence"), "against_strongly")
    candidates = _routed(spark, sf_dir).select("meeting_id", F.explode("primary").alias("clause_id"), "kind", "state", "commitment")
    return R.preflight(decisions, candidates, 3).drop("against_strongly")


EVD09 = f"""WITH {AUTHORITY_SQL}, {EVIDENCE_SQL.replace(SAID_FLAGS_SQL + ', ', '')}, held AS (SELECT meeting_id, unnest(prim) AS clause_id, kind, state, commitment FROM routed),
g AS (SELECT meeting_id, clause_id, bool_or(commitment IN ('DROP', 'CONTEXT_ONLY')) AS hard, bool_or(kind NOT IN ('MUTATION', 'REFERENCE', 'UNKNOWN', 'RECAP_ITEM') AND state <> 'REFERENCE_ONLY') AS grounded FROM held GROUP BY ALL),
w AS (SELECT routes.meeting_id, routes.clause_id, confidence, CASE WHEN strongly THEN 'EVIDENCE_HARD_NEGATIVE' WHEN coalesce(hard, false) THEN 'COMMITMENT_HARD_NEGATIVE' WHEN coalesce(grounded, false) THEN 'ELIGIBLE' ELSE 'NO_GROUNDED_CREATE_SPAN' END AS reason
  FROM routes LEFT JOIN g USING (meeting_id, clause_id))
SELECT *, reason = 'ELIGIBLE' AND row_number() OVER (PARTITION BY meeting_id, reason = 'ELIGIBLE' ORDER BY confidence DESC, clause_id) <= 3 AS selected FROM w"""


def evd10_create_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals of a clause's first two words, spoiled by rule in one way or another."""
    i = F.col("order_index")
    rows = annotated(spark, sf_dir).select(
        "meeting_id", "clause_id", "flags", "speaker_name", F.when(i % 17 != 0, F.col("text_raw")).alias("text_raw"), (i % 13 != 0).alias("in_context"), (i % 11 != 0).alias("cites_primary"),
        F.when(i % 7 == 0, "nothing of it").otherwise(F.array_join(F.slice(F.split("text_raw", " "), 1, 2), " ")).alias("action_span"), F.when(i % 5 == 0, "em").when(i % 5 == 1, "Zed").alias("owner_span"),
        F.when(i % 3 == 0, "D1").otherwise("").alias("deadline_id"), F.when(i % 6 == 0, F.col("clause_id")).otherwise("CLAUSE-0").alias("deadline_clause_id"),
    )
    return rows.select("meeting_id", "clause_id", F.array_join(R.create_refusals(), ",").alias("refusals"))


_guards = ", ".join(f"CASE WHEN list_contains(flags, '{f}') THEN '{r}' END" for f, r in R.GUARDS)
EVD10 = f"""WITH {SAID_FLAGS_SQL} SELECT meeting_id, clause_id, CASE WHEN order_index % 17 = 0 THEN 'UNKNOWN_SOURCE_CLAUSE' WHEN order_index % 13 = 0 THEN 'SOURCE_OUTSIDE_BOUNDED_CONTEXT' WHEN order_index % 11 = 0 THEN 'PRIMARY_SOURCE_NOT_CITED'
  WHEN order_index % 7 = 0 AND NOT contains({match_sql('text_raw')}, 'nothing of it') THEN 'UNGROUNDED_ACTION_SPAN' WHEN order_index % 5 = 0 AND NOT contains({match_sql('text_raw')}, 'em') THEN 'UNGROUNDED_OWNER_SPAN'
  WHEN order_index % 5 = 1 THEN 'UNGROUNDED_OWNER_SPAN' WHEN order_index % 3 = 0 AND order_index % 6 <> 0 THEN 'INVALID_DEADLINE_MENTION' ELSE array_to_string(list_filter([{_guards}, CASE WHEN NOT list_contains(flags, 'ROOT_QUESTION') AND ends_with(rtrim(text_raw), '?') THEN 'QUESTION' END], lambda x: x IS NOT NULL), ',') END AS refusals FROM flagged"""


def evd10_mutation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("order_index")
    kinds = F.array(*map(F.lit, (*R.OWNER_TYPES, *R.DEADLINE_TYPES, *R.END_TYPES)))
    rows = annotated(spark, sf_dir).select(
        "meeting_id", "clause_id", "flags", "speaker_name", "text_raw", F.when(i % 31 == 0, "DROP").otherwise("AI_MUTATION_CHECK").alias("route"), F.when(i % 29 == 0, "UNRESOLVED").otherwise("LINK").alias("decision"),
        (F.pmod(i * 37, F.lit(100)) / 100 + 0.3).alias("confidence"), (i % 23 != 0).alias("supplied"), F.when(i % 19 == 0, None).when(i % 17 == 0, "CANCELLED").otherwise("CONFIRMED").alias("task_status"),
        (i % 13 != 0).alias("in_context"), (i % 11 != 0).alias("cites_primary"), (i % 43 != 0).alias("anchor_primary"), (i % 41 != 0).alias("anchor_cited"), F.element_at(kinds, (i % 6).cast("int") + 1).alias("event_type"),
        F.when(i % 3 == 0, "task").when(i % 3 == 1, "").alias("owner_span"), F.when(i % 2 == 0, "D1").otherwise("").alias("deadline_id"), F.when(i % 4 == 0, F.col("clause_id")).alias("deadline_clause_id"),
    )
    return rows.select("meeting_id", "clause_id", R.mutation_refusal(0.5).alias("outcome"))


EVD10M = f"""WITH {SAID_FLAGS_SQL}, m AS (SELECT *, order_index AS i, [{_list((*R.OWNER_TYPES, *R.DEADLINE_TYPES, *R.END_TYPES))}][order_index % 6 + 1] AS kind, CASE order_index % 3 WHEN 0 THEN 'task' ELSE '' END AS span, CASE WHEN order_index % 2 = 0 THEN 'D1' ELSE '' END AS due FROM flagged),
n AS (SELECT *, kind IN ({_list(R.OWNER_TYPES)}) AS owns, kind IN ({_list(R.DEADLINE_TYPES)}) AS dates FROM m)
SELECT meeting_id, clause_id, CASE WHEN i % 31 = 0 THEN 'INVALID_CANDIDATE_ROUTE' WHEN i % 29 = 0 THEN 'UNRESOLVED' WHEN i * 37 % 100 / 100 + 0.3 < 0.5 THEN 'LOW_CONFIDENCE' WHEN i % 23 = 0 THEN 'UNKNOWN_TASK_ID' WHEN i % 19 = 0 THEN 'TASK_NOT_AVAILABLE_AT_ANCHOR'
  WHEN i % 17 = 0 THEN 'TERMINAL_TASK' WHEN i % 13 = 0 THEN 'SOURCE_OUTSIDE_BOUNDED_CONTEXT' WHEN i % 11 = 0 THEN 'PRIMARY_SOURCE_NOT_CITED' WHEN i % 43 = 0 THEN 'ANCHOR_OUTSIDE_PRIMARY' WHEN i % 41 = 0 THEN 'ANCHOR_NOT_CITED'
  WHEN NOT (CASE kind WHEN 'TASK_CANCEL' THEN list_contains(flags, 'CANCELLATION') WHEN 'TASK_REJECT' THEN list_contains(flags, 'REJECTION') ELSE {_any(P.CHANGING)} END) THEN 'EVENT_TYPE_NOT_GROUNDED'
  WHEN owns AND span = '' THEN 'MISSING_OWNER_SPAN' WHEN owns AND NOT contains({match_sql('text_raw')}, 'task') THEN 'UNGROUNDED_OWNER_SPAN' WHEN NOT owns AND span <> '' THEN 'OWNER_NOT_ALLOWED_FOR_EVENT'
  WHEN dates AND i % 4 <> 0 THEN 'INVALID_DEADLINE_MENTION' WHEN NOT dates AND due <> '' THEN 'DEADLINE_NOT_ALLOWED_FOR_EVENT' ELSE 'ACCEPTED' END AS outcome FROM n"""

QUERIES = {
    "win05_candidates": (win05_candidates, WIN05), "evd06_proposals": (evd06_proposals, EVD06), "evd07_commitments": (evd07_commitments, EVD07), "evd08_routes": (evd08_routes, EVD08), "evd09_preflight": (evd09_preflight, EVD09),
    "evd10_create_checks": (evd10_create_checks, EVD10), "evd10_mutation_checks": (evd10_mutation_checks, EVD10M),
}
