"""Queries over offline analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import offline as O
from tessera.operators import proposals as P
from tessera.plans.proposed import SPANS_SQL
from tessera.plans.rendered import EVENTS_SQL, table, task_events
from tessera.plans.said import SAID_FLAGS_SQL, SAID_SQL, annotated, match_sql, matches, said, sql_text, words_sql
from tessera.sources import transcripts

_list = lambda values: ", ".join(map(sql_text, values))
SOURCES = ("AI", "RULE", "HUMAN_NOTE", "RULE_CONTEXT", "RULE_REFERENCE", "RULE_FINAL_RECAP", "RULE_RECAP", "AI_CREATE_PROPOSAL", "AI_MUTATION_ROUTER", "RULE")


def off03_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = task_events(spark, sf_dir)
    source = F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("order_index") % len(SOURCES)).cast("int") + 1)
    return rows.groupBy("meeting_id", O.origin(source, F.col("event_type")).alias("origin")).agg(F.count("*").alias("n"))


_origins = " ".join(f"WHEN src IN ({_list(s)}) THEN '{n}'" for s, n in O.ORIGINS)
OFF03 = f"""WITH {EVENTS_SQL}, s AS (SELECT *, [{_list(SOURCES)}][order_index % {len(SOURCES)} + 1] AS src FROM task_events)
SELECT meeting_id, CASE {_origins} WHEN event_type IN ({_list(O.MUTATIONS)}) THEN 'RULE_MUTATION' WHEN event_type = 'OWNER_ASSIGN' THEN 'RULE_EXPLICIT_ASSIGNMENT' ELSE 'RULE_EXPLICIT_COMMITMENT' END AS origin, count(*) AS n FROM s GROUP BY ALL"""


def off04_case_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    route = O.ai_route(k % 4, k % 3, k % 5 < 2, F.when(k % 7 == 0, 1).otherwise(0), k % 2)
    return table(spark, sf_dir, "orders").groupBy(route.alias("route")).agg(F.count("*").alias("n"))


OFF04 = """SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'rule_only' WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 5 < 2 THEN 'ai_fallback_skipped_no_candidate' ELSE 'ai_fallback_not_configured' END WHEN o_orderkey % 7 = 0 THEN 'ai_fallback_failed'
  WHEN o_orderkey % 2 > 0 THEN 'ai_fallback_unresolved' ELSE 'ai_fallback_resolved' END AS route, count(*) AS n FROM orders GROUP BY route"""


def off06_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    task = F.create_map(*(x for f in O.TASK_FIELDS for x in (F.lit(f), F.when((k % 13 == 0) & F.lit(f == "status"), "Done").otherwise("Proposed" if f == "status" else "x"))))
    short = F.create_map(F.lit("task_name"), F.lit("x"))
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit("j").alias("job_id"), F.when(k % 31 == 0, "other").otherwise("j").alias("route_job_id"), F.lit("h").alias("content_hash"), F.when(k % 29 == 0, "x").otherwise("h").alias("job_content_hash"),
        F.when(k % 11 == 0, F.array(short)).otherwise(F.array(task)).alias("tasks"), F.when(k % 7 == 0, "  ").otherwise("An").alias("reviewer"),
        F.when(k % 5 == 0, "2024-02-01T10:00:00").when(k % 17 == 0, "").otherwise("2024-02-01T10:00:00+07:00").alias("reviewed_at"), (k % 3 != 0).alias("approval"),
    )
    return rows.select("o_orderkey", O.feedback_refusal().alias("outcome"))


OFF06 = """SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN 'JOB_DIFFERS' WHEN o_orderkey % 29 = 0 THEN 'CONTENT_DIFFERS' WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN 'INVALID_TASK' WHEN o_orderkey % 7 = 0 THEN 'REVIEWER_REQUIRED'
  WHEN o_orderkey % 17 = 0 AND o_orderkey % 5 <> 0 THEN 'TIME_REQUIRED' WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN 'TIME_OR_APPROVAL_INVALID' ELSE 'ACCEPTED' END AS outcome FROM orders"""

_PRIORITY = {"final": 0, "state": 1, "event": 2, "bridge": 3}


def off14_merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of four stages on the same tasks, with gaps that the next stage fills."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("case_id"), F.when(k % 19 == 0, "").otherwise(F.concat(F.lit("t"), k % 6)).alias("task_key"), F.element_at(F.array(*map(F.lit, ("bridge", "event", "final", "state"))), (k % 4).cast("int") + 1).alias("source"), k.alias("ordinal"),
        F.when(k % 3 == 0, F.concat(F.lit("P"), k % 5)).otherwise("").alias("assignee"), F.when(k % 2 == 0, F.concat(F.lit("D"), k % 7)).otherwise("").alias("due_date"),
    )
    return O.merged_sources(rows, _PRIORITY, ("assignee", "due_date")).withColumn("provenance", F.array_join("provenance", ","))


OFF14 = """WITH r AS (SELECT user_id AS case_id, event_id AS k, 't' || event_id % 6 AS task_key, ['bridge', 'event', 'final', 'state'][event_id % 4 + 1] AS source, [3, 2, 0, 1][event_id % 4 + 1] AS p, CASE WHEN event_id % 3 = 0 THEN 'P' || event_id % 5 END AS a,
    CASE WHEN event_id % 2 = 0 THEN 'D' || event_id % 7 END AS d FROM events WHERE event_id % 19 <> 0), s AS (SELECT case_id, task_key, source, min(p) AS p FROM r GROUP BY ALL)
SELECT case_id, task_key, first(source ORDER BY p, k) AS source, coalesce(first(a ORDER BY p, k) FILTER (a IS NOT NULL), '') AS assignee, coalesce(first(d ORDER BY p, k) FILTER (d IS NOT NULL), '') AS due_date,
  (SELECT string_agg(source, ',' ORDER BY p) FROM s WHERE s.case_id = r.case_id AND s.task_key = r.task_key) AS provenance FROM r GROUP BY case_id, task_key"""


def off28_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        (F.floor(k / 3) * 2 + (k % 3 == 2).cast("int")).alias("proposal_id"), F.when(k % 5 == 0, "REFERENCE").otherwise("CREATE").alias("decision"), (k % 2).cast("string").alias("span"), (F.pmod(k * 37, F.lit(100)) / 100).alias("confidence"),
    )
    return O.consensus(rows)


OFF28 = """WITH r AS (SELECT event_id // 3 * 2 + CASE WHEN event_id % 3 = 2 THEN 1 ELSE 0 END AS proposal_id, CASE WHEN event_id % 5 = 0 THEN 'REFERENCE' ELSE 'CREATE' END AS decision, event_id % 2 AS span, event_id * 37 % 100 / 100 AS c FROM events),
g AS (SELECT proposal_id, count(*) AS n, count(DISTINCT decision || span) AS kinds, min(decision) AS d, min(c) AS low, max(c) AS high FROM r GROUP BY proposal_id)
SELECT proposal_id, CASE WHEN (n = 2 AND kinds = 1) OR (n = 1 AND high >= 0.9) THEN d ELSE 'UNRESOLVED' END AS decision, CASE WHEN n = 2 AND kinds = 1 THEN 'teacher_consensus' WHEN n = 1 AND high >= 0.9 THEN 'teacher_single' ELSE 'unresolved' END AS source,
  CASE WHEN n = 2 AND kinds = 1 THEN low ELSE high END AS confidence FROM g"""


def off16_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    case = F.when(k % 9 == 0, F.concat(F.lit("W1-SHORT-"), k)).otherwise(F.concat_ws("-", F.lit("W1"), F.lit("SHORT"), F.concat(F.lit("C"), k % 3), F.lit("N1"), F.concat(F.lit("D"), k % 4), F.concat(F.lit("T"), k % 5), k))
    template, fam = O.family(case)
    return table(spark, sf_dir, "orders").groupBy(template.alias("template"), fam.alias("family")).agg(F.count("*").alias("n"))


OFF16 = """SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' ELSE 'T' || o_orderkey % 5 END AS template, CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' ELSE 'D' || o_orderkey % 4 || '-T' || o_orderkey % 5 END AS family, count(*) AS n FROM orders GROUP BY ALL"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotated(spark, sf_dir).select("meeting_id", "clause_id", "order_index", F.explode(P.lattice(P.action_spans(F.col("text_raw")))).alias("s"))
    return rows.select("meeting_id", "clause_id", "order_index", "s.start", (F.col("s.start") + F.length("s.text")).alias("end"), "s.text")


_SPANS = f"""a AS (SELECT meeting_id, clause_id, order_index, unnest({SPANS_SQL}) AS s FROM flagged),
sp AS (SELECT meeting_id, clause_id, order_index, s.start AS b, s.text AS text FROM a UNION SELECT meeting_id, clause_id, order_index, s.start, rtrim(array_to_string(string_split(s.text, ' ')[1:n], ' '), ' ,.;:!?') FROM a, (SELECT unnest(range(2, 8)) AS n) WHERE n <= len(string_split(s.text, ' '))),
spans AS (SELECT *, b + length(text) AS e FROM sp WHERE text <> '')"""


def off22_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.longest_occurrences(_spans(spark, sf_dir)).withColumn("end", F.col("end").cast("int"))


OFF22 = f"WITH {SAID_FLAGS_SQL}, {_SPANS} SELECT meeting_id, clause_id, first(b ORDER BY e - b DESC, b, text DESC) AS start, CAST(first(e ORDER BY e - b DESC, b, text DESC) AS INTEGER) AS \"end\", first(text ORDER BY e - b DESC, b, text DESC) AS text FROM spans GROUP BY meeting_id, clause_id"


def ml09_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of lattice spans against gold: each clause's longest span, without its last two characters in every third clause."""
    spans = _spans(spark, sf_dir).distinct()
    gold = O.longest_occurrences(spans).withColumn("end", F.col("end") - F.when(F.substring("clause_id", -1, 1).isin("0", "3", "6", "9"), 2).otherwise(0))
    rows = spans.withColumn("proposal_id", F.concat_ws(":", "clause_id", "start", "end")).withColumn("kind", F.when(F.col("order_index") % 5 == 0, "UPDATE").otherwise("CREATE"))
    return O.training_labels(rows, gold).select("meeting_id", "proposal_id", F.round("label", 6).alias("label"))


ML09 = f"""WITH {SAID_FLAGS_SQL}, {_SPANS}, d AS (SELECT DISTINCT * FROM spans), g AS (SELECT meeting_id, clause_id, first(b ORDER BY e - b DESC, b, text DESC) AS gb, first(e ORDER BY e - b DESC, b, text DESC) - CASE WHEN clause_id[-1] IN ('0', '3', '6', '9') THEN 2 ELSE 0 END AS ge FROM d GROUP BY meeting_id, clause_id),
o AS (SELECT d.*, greatest(0, least(e, ge) - greatest(b, gb)) / (greatest(e, ge) - least(b, gb)) AS iou FROM d JOIN g USING (meeting_id, clause_id))
SELECT meeting_id, clause_id || ':' || b || ':' || e AS proposal_id, round(CASE WHEN order_index % 5 = 0 OR iou < 0.8 THEN 0.0 ELSE iou END, 6)::DOUBLE AS label FROM o"""


def ext22_suppressed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best spans of a clause that don't overlap much, by a made-up score."""
    rows = _spans(spark, sf_dir).withColumn("score", F.pmod(F.col("end") * 13 + F.col("start"), F.lit(97)) / 97)
    found = rows.groupBy("meeting_id", "clause_id").agg(O.nms(F.collect_set(F.struct("score", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))).alias("kept"))
    return found.select("meeting_id", "clause_id", F.array_join(F.transform("kept", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("kept"))


EXT22 = f"""WITH RECURSIVE {SAID_FLAGS_SQL}, {_SPANS}, d AS (SELECT DISTINCT meeting_id, clause_id, b, e, (e * 13 + b) % 97 AS score FROM spans), n AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, clause_id ORDER BY score DESC, b, e) AS i FROM d),
w AS (SELECT meeting_id, clause_id, i, [{{'b': b, 'e': e}}] AS kept FROM n WHERE i = 1
  UNION ALL SELECT n.meeting_id, n.clause_id, n.i, CASE WHEN len(kept) >= 3 OR len(list_filter(kept, lambda k: greatest(0, least(k.e, n.e) - greatest(k.b, n.b)) / (greatest(k.e, n.e) - least(k.b, n.b)) >= 0.8)) > 0 THEN kept ELSE list_append(kept, {{'b': n.b, 'e': n.e}}) END
  FROM w JOIN n ON n.meeting_id = w.meeting_id AND n.clause_id = w.clause_id AND n.i = w.i + 1)
SELECT meeting_id, clause_id, array_to_string(list_transform(kept, lambda k: k.b || ':' || k.e), ',') AS kept FROM w QUALIFY row_number() OVER (PARTITION BY meeting_id, clause_id ORDER BY i DESC) = 1"""


def _featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.action_features(annotated(spark, sf_dir, O.phrased).withColumn("note_supported", F.col("order_index") % 6 == 0))


def ml01_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _featured(spark, sf_dir).select("meeting_id", "clause_id", F.array_join(F.transform(F.array(*O.FEATURES), lambda x: x.cast("int").cast("string")), ",").alias("features"))


_WEIGHTS = "CASE f " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in {"FIRST_PERSON_COMMITMENT": 3, "DIRECT_ASSIGNMENT": 3, "CONFIRMATION": 2, "DATE_MENTION": 2, "CORRECTION": 2, "CANCELLATION": 3, "REJECTION": 2, "ACTION_VERB": 1, "EXPLICIT_TASK_LABEL": 1}.items()) + " ELSE -3 END"
_flag = lambda f: f"list_contains(flags, '{f}')"
_feature_sql = {k: _flag(v) for k, v in O._FLAG_FEATURES.items()} | {
    "has_owner_name": "len(list_filter(names, lambda n: contains(' ' || plain || ' ', ' ' || n || ' '))) > 0", "is_question": "list_contains(flags, 'ROOT_QUESTION') OR ends_with(rtrim(text_raw), '?')", "speaker_changed": "coalesce(before <> speaker_name, false)",
    "first_person": matches("plain", O.FIRST_PERSON), "second_person": matches("plain", O.SECOND_PERSON), "note_supported": "order_index % 6 = 0",
}
FEATURES_SQL = (
    SAID_FLAGS_SQL
    + f""", nm AS (SELECT meeting_id, list(DISTINCT array_to_string({words_sql(match_sql('speaker_name'))}, ' ')) AS names FROM flagged GROUP BY meeting_id),
pl AS (SELECT f.*, names, array_to_string({words_sql(match_sql('text_raw'))}, ' ') AS plain, lag(speaker_name) OVER (PARTITION BY f.meeting_id ORDER BY order_index) AS before, coalesce(list_sum(list_transform(flags, lambda f: {_WEIGHTS})), 0) AS score FROM flagged f JOIN nm USING (meeting_id)),
ft AS (SELECT *, [{', '.join(f"CASE WHEN {_feature_sql[n]} THEN 1 ELSE 0 END" if n in _feature_sql else 'CAST(score AS INTEGER)' for n in O.FEATURES)}] AS v FROM pl)"""
)
ML01 = f"WITH {FEATURES_SQL} SELECT meeting_id, clause_id, array_to_string(v, ',') AS features FROM ft"

_MEAN, _SCALE = [0.1 * (i % 4) for i in range(17)], [1.0 + 0.5 * (i % 3) for i in range(17)]
_MODEL = [[((7 * i + 3 * j) % 11 - 5) / 5 for i in range(17)] for j in range(4)]
_BIAS = [0.1, -0.2, 0.0, 0.3]


def ml02_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frozen linear model of four classes over the standardised features (its numbers made by rule)."""
    p = O.linear_probabilities(F.array(*O.FEATURES), _MEAN, _SCALE, _MODEL, _BIAS)
    return _featured(spark, sf_dir).withColumn("p", p).select("meeting_id", "clause_id", *(F.round(F.get("p", j), 6).alias(f"p{j}") for j in range(4)))


_z = lambda j: " + ".join(f"(v[{i + 1}] - {_MEAN[i]}::DOUBLE) / {_SCALE[i]} * {_MODEL[j][i]}::DOUBLE" for i in range(17)) + f" + {_BIAS[j]}::DOUBLE"
ML02 = f"""WITH {FEATURES_SQL}, lg AS (SELECT meeting_id, clause_id, {', '.join(f'{_z(j)} AS z{j}' for j in range(4))} FROM ft), ex AS (SELECT *, exp(z0) AS e0, exp(z1) AS e1, exp(z2) AS e2, exp(z3) AS e3 FROM lg)
SELECT meeting_id, clause_id, {', '.join(f'round(e{j} / (e0 + e1 + e2 + e3), 6) AS p{j}' for j in range(4))} FROM ex"""


def off02_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, ("CLEAR_ACTION", "NON_ACTION", "POSSIBLE_ACTION", "UPDATE_ONLY", "NON_ACTION"))), (F.col("order_index") * 3 % 5).cast("int") + 1)
    return O.agreement(annotated(spark, sf_dir).withColumn("label", label))


OFF02 = f"""WITH {FEATURES_SQL}, l AS (SELECT *, ['CLEAR_ACTION', 'NON_ACTION', 'POSSIBLE_ACTION', 'UPDATE_ONLY', 'NON_ACTION'][order_index * 3 % 5 + 1] AS label, list_has_any(flags, [{_list(O.RULE_ACTIONS)}]) AND score > 0 AS r FROM ft), m AS (SELECT *, label IN ('CLEAR_ACTION', 'POSSIBLE_ACTION') AS c FROM l)
SELECT meeting_id, count(*) AS clauses, count(*) FILTER (label = 'CLEAR_ACTION') AS would_create, count(*) FILTER (label = 'POSSIBLE_ACTION') AS would_review, count(*) FILTER (label = 'UPDATE_ONLY') AS would_update, count(*) FILTER (r) AS rule_actions,
  count(*) FILTER (r = c) AS agree, count(*) FILTER (r <> c) AS disagree FROM m GROUP BY meeting_id"""

_ACTS = ("Hoàn thành đúng hạn", "Gửi", "Gửi báo cáo", "Cập nhật như vậy", "Send the invite", "Làm")


def _policy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("order_index")
    return task_events(spark, sf_dir).select(
        "meeting_id", "event_id", "event_type", F.element_at(F.array(*map(F.lit, _ACTS)), (i % len(_ACTS)).cast("int") + 1).alias("action_text"), F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("Bì"), i % 3)).alias("assignee"),
        F.when((i % 9 == 0) & (i % 3 == 0), "RULE_CONTEXT").when(i % 5 == 0, "AI").otherwise("RULE").alias("extraction_source"),
    )


_POLICY = f"""pe AS (SELECT meeting_id, event_id, event_type, [{_list(_ACTS)}][order_index % {len(_ACTS)} + 1] AS act, CASE WHEN order_index % 4 = 0 THEN '' ELSE 'Bì' || order_index % 3 END AS owner, CASE WHEN order_index % 9 = 0 THEN 'RULE_CONTEXT' WHEN order_index % 5 = 0 THEN 'AI' ELSE 'RULE' END AS src FROM task_events)"""


def pol01_context_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.without_pointers(_policy_events(spark, sf_dir)).select("meeting_id", "event_id")


POL01 = f"""WITH {EVENTS_SQL}, {_POLICY} SELECT meeting_id, event_id FROM pe WHERE NOT (src = 'RULE' AND event_type IN ({_list(O.POSITIVE)}) AND regexp_matches({match_sql('act')}, {sql_text(O.POINTING)})
  AND EXISTS (SELECT 1 FROM pe c WHERE c.meeting_id = pe.meeting_id AND c.src = 'RULE_CONTEXT' AND c.owner <> '' AND {match_sql('c.owner')} = {match_sql('pe.owner')}))"""


def pol02_long_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _policy_events(spark, sf_dir)
    meetings = rows.groupBy("meeting_id").agg((F.count("*") + F.when(F.col("meeting_id") % 2 == 0, 80).otherwise(0)).alias("clauses")).withColumn("scope", F.when(F.col("meeting_id") % 3 == 0, "NONE").otherwise("COMPLETE"))
    return O.long_context(rows, meetings).groupBy("meeting_id", "extraction_source").agg(F.count("*").alias("n"))


POL02 = f"""WITH {EVENTS_SQL}, {_POLICY}, n AS (SELECT meeting_id, count(*) + CASE WHEN meeting_id % 2 = 0 THEN 80 ELSE 0 END AS clauses FROM pe GROUP BY meeting_id)
SELECT meeting_id, CASE WHEN clauses >= 80 AND meeting_id % 3 <> 0 AND src = 'RULE' AND event_type IN ({_list(O.POSITIVE)}) AND {matches('trim(act)', O.COMMUNICATION)} THEN 'RULE_CONTEXT' ELSE src END AS extraction_source, count(*) AS n FROM pe JOIN n USING (meeting_id) GROUP BY ALL"""


def off09_identity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests (orders with their line numbers modulo three as candidates) by customer."""
    candidate = F.when(F.col("l_quantity") > 20, (F.col("l_linenumber") % 3).cast("string"))  # small lines are no candidates
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(candidate).alias("task_ids"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(lines, "o_orderkey", "left")
    return O.identity_audit(rows.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("request_id"), F.coalesce("task_ids", F.array().cast("array<string>")).alias("task_ids")))


OFF09 = """WITH l AS (SELECT l_orderkey, count(*) FILTER (l_quantity > 20) AS n, count(DISTINCT CASE WHEN l_quantity > 20 THEN l_linenumber % 3 END) AS d FROM lineitem GROUP BY l_orderkey)
SELECT o_custkey AS case_id, count(*) AS requests, CAST(coalesce(sum(n), 0) AS BIGINT) AS candidates, count(*) FILTER (coalesce(n, 0) = 0) AS empty, count(*) FILTER (n <> d) AS repeated FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY o_custkey"""


def off31_diarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as diarised segments, written as lines of a speaker."""
    part = F.struct("turn", F.struct(F.when(F.col("turn") % 5 == 4, " ").otherwise(F.col("role")).alias("speaker"), "text").alias("s"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["s"]).alias("segments"))
    return rows.select("conv_id", F.sha2(transcripts.diarised(F.col("segments")), 256).alias("sha"))


OFF31 = r"""SELECT conv_id, sha256(coalesce(string_agg(role || ': ' || trim(regexp_replace(text, '[\r\n]', ' ', 'g')), chr(10) ORDER BY turn) FILTER (turn % 5 <> 4 AND trim(text) <> ''), '') || chr(10)) AS sha FROM conversations GROUP BY conv_id"""


def src13_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as bytes with marks of UTF-8 and UTF-16, without marks, empty and broken, and read again."""
    i = F.col("order_index") % 5
    text = F.col("text_raw")
    content = (
        F.when(i == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))).when(i == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).when(i == 2, F.encode(text, "UTF-8"))
        .when(i == 3, F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"))).otherwise(F.when(F.col("order_index") % 2 == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.lit("C328"))))
    )
    return said(spark, sf_dir).select("meeting_id", "clause_id", transcripts.decoded(content).alias("text"))


SRC13 = f"WITH {SAID_SQL} SELECT meeting_id, clause_id, CASE WHEN order_index % 5 < 4 THEN text_raw END AS text FROM said"

QUERIES = {
    "off02_agreement": (off02_agreement, OFF02), "off03_origins": (off03_origins, OFF03), "off04_case_routes": (off04_case_routes, OFF04), "off06_feedback": (off06_feedback, OFF06), "off09_identity_audit": (off09_identity_audit, OFF09),
    "off14_merged_sources": (off14_merged_sources, OFF14), "off16_families": (off16_families, OFF16), "off22_occurrences": (off22_occurrences, OFF22), "off28_consensus": (off28_consensus, OFF28), "off31_diarised": (off31_diarised, OFF31),
    "ml01_features": (ml01_features, ML01), "ml02_probabilities": (ml02_probabilities, ML02), "ml09_labels": (ml09_labels, ML09), "ext22_suppressed_spans": (ext22_suppressed_spans, EXT22), "pol01_context_authority": (pol01_context_authority, POL01),
    "pol02_long_context": (pol02_long_context, POL02), "src13_decoded": (src13_decoded, SRC13),
}
