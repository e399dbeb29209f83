"""Queries over retrieval and reduction: events of meetings on tasks that are bound, named or only like what they say."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import reduction as R
from tessera.operators import retrieval as V
from tessera.plans.rendered import EVENTS_SQL, ORDERED_SQL, _ordered, table, task_events
from tessera.functions.text import plain as plain_text
from tessera.plans.said import match_sql, sql_text

_OPS = R.OPERATIONS

#: Names of tasks (a number follows), and what events call them.
LNK_NAMES = ("Gửi báo cáo doanh thu ", "Kiểm tra dashboard ", "Viết kịch bản kiểm thử ", "Prepare release plan ", "Review contract ")
LNK_HINTS = (
    "gui bao cao doanh thu 0", "Gửi báo cáo doanh thu", "kiểm tra dashboards 1", "release plan 0", "prepare the release plan 2", "Review contracts 3", "contract", "viết kịch bản kiểm thử 1", "làm việc khác", "Viết kịch bản kiểm tra",
)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations on five tasks a meeting; every ninth event is a repetition of the one that is nine places before."""
    rows = _ordered(spark, sf_dir)
    i = F.col("order_index")
    own = rows.select(
        "meeting_id", F.concat(F.lit("T"), F.col("event_id") % 5).alias("task_id"), F.concat(F.lit("E"), "event_id").alias("event_id"), F.element_at(F.array(*map(F.lit, _OPS)), (F.col("event_id") * 3 % 11).cast("int") + 1).alias("operation"),
        F.floor(i / 2).alias("place"), F.concat(F.lit("Action "), F.col("event_id") % 3).alias("action"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("P"), F.col("event_id") % 4)).otherwise("").alias("assignee"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("D"), F.col("event_id") % 7)).otherwise("").alias("deadline"), F.concat(F.lit("C"), i).alias("clause_id"), "order_index",
    )
    return own.unionAll(own.where("order_index % 9 = 0").withColumn("place", F.col("place") + 4)).drop("order_index")


_EV = ORDERED_SQL + f""", own AS (SELECT meeting_id, 'T' || event_id % 5 AS task_id, 'E' || event_id AS event_id, event_id * 3 % 11 AS rank, order_index // 2 AS place, 'Action ' || event_id % 3 AS action,
    CASE WHEN event_id % 4 <> 0 THEN 'P' || event_id % 4 ELSE '' END AS assignee, CASE WHEN event_id % 3 <> 0 THEN 'D' || event_id % 7 ELSE '' END AS deadline, 'C' || order_index AS clause_id, order_index FROM ordered),
ev AS (SELECT * EXCLUDE (order_index) FROM own UNION ALL SELECT meeting_id, task_id, event_id, rank, place + 4, action, assignee, deadline, clause_id FROM own WHERE order_index % 9 = 0),
num AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, task_id ORDER BY place, rank, event_id) AS i FROM ev),
walk AS (SELECT meeting_id, task_id, 0::BIGINT AS i, false AS made, '' AS action, '' AS assignee, '' AS deadline, 'ACTIVE' AS status, []::VARCHAR[] AS seen, []::VARCHAR[] AS clauses, []::VARCHAR[] AS unresolved, NULL::BIGINT AS first, NULL::BIGINT AS last FROM num WHERE i = 1
  UNION ALL SELECT s.meeting_id, s.task_id, e.i, s.made OR rank = 0,
    CASE WHEN makes THEN e.action WHEN works AND rank = 4 THEN e.action ELSE s.action END, CASE WHEN makes THEN e.assignee WHEN works AND rank IN (2, 3) AND e.assignee <> '' THEN e.assignee ELSE s.assignee END,
    CASE WHEN makes THEN e.deadline WHEN works AND rank = 7 THEN '' WHEN works AND rank IN (5, 6) THEN e.deadline ELSE s.deadline END,
    CASE WHEN works AND rank = 8 THEN 'CANCELLED' WHEN works AND rank = 9 THEN 'REJECTED' WHEN works AND rank = 10 THEN 'ACTIVE' ELSE s.status END,
    CASE WHEN makes OR works THEN list_append(s.seen, e.event_id) ELSE s.seen END, CASE WHEN (makes OR works) AND NOT list_contains(s.clauses, e.clause_id) THEN list_append(s.clauses, e.clause_id) ELSE s.clauses END,
    CASE WHEN NOT makes AND NOT works AND NOT list_contains(s.seen, e.event_id) THEN list_append(s.unresolved, e.event_id) ELSE s.unresolved END, CASE WHEN makes THEN e.place ELSE s.first END, CASE WHEN makes OR works THEN e.place ELSE s.last END
  FROM walk s JOIN num e ON e.meeting_id = s.meeting_id AND e.task_id = s.task_id AND e.i = s.i + 1, LATERAL (SELECT rank = 0 AND NOT s.made AS makes, s.made AND NOT list_contains(s.seen, e.event_id)
    AND (rank = 0 OR CASE rank WHEN 2 THEN s.assignee = '' WHEN 3 THEN e.assignee <> '' WHEN 4 THEN e.action <> '' WHEN 5 THEN s.deadline = '' AND e.deadline <> '' WHEN 6 THEN e.deadline <> '' WHEN 10 THEN s.status IN ('CANCELLED', 'REJECTED') ELSE true END) AS works) w),
done AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY meeting_id, task_id ORDER BY i DESC) = 1)"""


def led07_strict_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.reduced(_events(spark, sf_dir))
    return rows.select("meeting_id", "task_id", "made", "action", "assignee", "deadline", "status", F.array_join("clauses", ",").alias("clauses"), F.array_join("unresolved", ",").alias("unresolved"), "first", "last")


LED07S = f"WITH RECURSIVE {_EV} SELECT meeting_id, task_id, made, action, assignee, deadline, status, array_to_string(clauses, ',') AS clauses, array_to_string(unresolved, ',') AS unresolved, first, last FROM done"


def led08_recap_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = R.reduced(_events(spark, sf_dir)).where("made")
    linked = tasks.where("task_id in ('T0', 'T3')").select("meeting_id", "task_id", F.when(F.col("task_id") == "T0", "An").otherwise("").alias("assignee"), F.when(F.col("task_id") == "T3", "D99").otherwise("").alias("deadline"))
    scope = tasks.select("meeting_id").distinct().withColumn("scope", F.when(F.col("meeting_id") % 2 == 0, "COMPLETE").otherwise("PARTIAL"))
    return R.after_recap(tasks, linked, scope)


LED08 = f"""WITH RECURSIVE {_EV} SELECT meeting_id, task_id, CASE WHEN task_id = 'T0' THEN 'An' ELSE assignee END AS assignee, CASE WHEN task_id = 'T3' THEN 'D99' ELSE deadline END AS deadline,
  CASE WHEN meeting_id % 2 = 0 AND task_id NOT IN ('T0', 'T3') AND status = 'ACTIVE' THEN 'CANCELLED' ELSE status END AS status FROM done WHERE made"""


def lnk03_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that give an id, a label, a name or nearly one, on tasks (every fourth clause) of which some share labels and names."""
    rows = _ordered(spark, sf_dir)
    i = F.col("order_index")
    tasks = rows.groupBy("meeting_id", F.floor(i / 4).alias("j")).count().select(
        "meeting_id", F.concat(F.lit("T"), "j").alias("task_id"), F.array(F.concat(F.lit("Task "), F.col("j") % 7)).alias("labels"),
        F.array(F.concat(F.element_at(F.array(*map(F.lit, LNK_NAMES)), (F.col("j") % len(LNK_NAMES)).cast("int") + 1), F.floor(F.col("j") / 9)), F.concat(F.lit("alias "), "j")).alias("names"),
    )
    events = rows.select(
        "meeting_id", "event_id", F.when(i % 5 == 0, F.concat(F.lit("T"), i % 15)).otherwise("").alias("target_task_id"), F.when(i % 3 == 0, F.concat(F.lit("TASK  "), i % 8)).otherwise("").alias("label"),
        F.when(i % 2 == 0, F.element_at(F.array(*map(F.lit, LNK_HINTS)), (F.col("event_id") % len(LNK_HINTS)).cast("int") + 1)).when(i % 7 == 0, F.concat(F.lit("Alias "), i % 14)).otherwise("").alias("hint"),
    )
    return R.targets(events, tasks)


def _ratios(left: list[str], right: list[str]) -> str:
    """Rows (a, b, ratio) of texts for the SQL side, by the standard library."""
    return ", ".join(f"({sql_text(a)}, {sql_text(b)}, {SequenceMatcher(None, a, b).ratio()!r}::DOUBLE)" for a in sorted(set(left)) for b in sorted(set(right)))


_LNK_FORMS = [plain_text(f"{name}{n}") for name in LNK_NAMES for n in range(4)]
LNK03 = f"""WITH {ORDERED_SQL}, t AS (SELECT meeting_id, order_index // 4 AS j, {match_sql(f"[{', '.join(map(sql_text, LNK_NAMES))}][(order_index // 4) % {len(LNK_NAMES)} + 1] || (order_index // 4) // 9")} AS name FROM ordered GROUP BY ALL),
e AS (SELECT *, order_index AS i, CASE WHEN order_index % 5 = 0 THEN order_index % 15 END AS id, CASE WHEN order_index % 3 = 0 THEN order_index % 8 END AS label,
    CASE WHEN order_index % 2 = 0 THEN {match_sql(f"[{', '.join(map(sql_text, LNK_HINTS))}][event_id % {len(LNK_HINTS)} + 1]")} WHEN order_index % 7 = 0 THEN 'alias ' || order_index % 14 END AS hint FROM ordered),
x(a, b, ratio) AS (VALUES {_ratios([plain_text(h) for h in LNK_HINTS] + [f"alias {n}" for n in range(0, 14, 7)], _LNK_FORMS)}),
near AS (SELECT e.meeting_id, event_id, j, ratio, row_number() OVER w AS place, coalesce(lead(ratio) OVER w, -1) AS second FROM e JOIN t USING (meeting_id) JOIN x ON a = hint AND b = name
    WHERE len(list_intersect(list_filter(string_split(hint, ' '), lambda w: w <> ''), list_filter(string_split(name, ' '), lambda w: w <> ''))) > 0 WINDOW w AS (PARTITION BY e.meeting_id, event_id ORDER BY ratio DESC, 'T' || j DESC))
SELECT meeting_id, event_id, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.meeting_id = e.meeting_id AND j = id) THEN 'T' || id
  WHEN label IS NOT NULL THEN (SELECT CASE WHEN count(*) = 1 THEN 'T' || min(j) END FROM t WHERE t.meeting_id = e.meeting_id AND j % 7 = label)
  WHEN (SELECT count(*) FROM t WHERE t.meeting_id = e.meeting_id AND (name = hint OR 'alias ' || j = hint)) = 1 THEN (SELECT 'T' || min(j) FROM t WHERE t.meeting_id = e.meeting_id AND (name = hint OR 'alias ' || j = hint))
  WHEN hint IS NOT NULL THEN (SELECT CASE WHEN ratio >= 0.8 AND (second < 0 OR ratio - second >= 0.15) THEN 'T' || j END FROM near WHERE near.meeting_id = e.meeting_id AND near.event_id = e.event_id AND place = 1) END AS task_id FROM e"""


def agg02_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at anchors of four clauses; every second change has a target."""
    rows = task_events(spark, sf_dir)
    i = F.col("order_index")
    rows = rows.withColumn("related_task_id", F.when((i % 2 == 0) & F.col("event_type").isin(*R.MUTATIONS), F.concat(F.lit("TASK-"), i % 3)).otherwise(""))
    rows = rows.withColumn("deadline_mention_id", F.when(F.col("event_type").isin("DEADLINE_REPLACE", "TASK_CREATE"), F.concat(F.lit("DATE-"), i % 2)).otherwise(""))
    return R.suppressed(rows).select("meeting_id", "event_id", F.array_join("source_clause_ids", ",").alias("evidence"), "corroborated_by_rule")


AGG02 = f"""WITH {EVENTS_SQL}, e AS (SELECT meeting_id, event_id, event_type AS t, extraction_source AS src, source_clause_id AS c, anchor_clause_id AS a, order_index AS i, CASE WHEN event_type IN ('DEADLINE_REPLACE', 'TASK_CREATE') THEN 'DATE-' || order_index % 2 ELSE '' END AS due,
    CASE WHEN order_index % 2 = 0 AND event_type IN ('OWNER_REASSIGN', 'DEADLINE_REPLACE', 'TASK_CANCEL') THEN 'TASK-' || order_index % 3 ELSE '' END AS target FROM task_events),
f AS (SELECT * FROM e WHERE NOT (src = 'AI' AND t = 'DEADLINE_REPLACE' AND EXISTS (SELECT 1 FROM e o WHERE o.meeting_id = e.meeting_id AND o.a = e.a AND o.due = e.due AND o.t IN ('TASK_CREATE', 'OWNER_ASSIGN') AND o.src <> 'AI'))),
m AS (SELECT * FROM f WHERE t IN ('OWNER_REASSIGN', 'DEADLINE_REPLACE', 'TASK_CANCEL')),
b AS (SELECT meeting_id, t, a, first(event_id ORDER BY CASE src WHEN 'AI' THEN 1 ELSE 2 END DESC, i) AS winner FROM m WHERE target <> '' GROUP BY meeting_id, t, a HAVING count(DISTINCT target) = 1),
l AS (SELECT m.*, winner FROM m JOIN b USING (meeting_id, t, a) WHERE target = ''),
x AS (SELECT meeting_id, winner, list(c ORDER BY i) AS more, list(due) FILTER (src <> 'AI' AND t = 'DEADLINE_REPLACE') AS dues FROM l GROUP BY meeting_id, winner)
SELECT f.meeting_id, f.event_id, array_to_string([c] || coalesce(more, []), ',') AS evidence, f.src = 'AI' AND coalesce(list_contains(dues, f.due), false) AS corroborated_by_rule FROM f LEFT JOIN x ON x.meeting_id = f.meeting_id AND x.winner = f.event_id
WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.meeting_id = f.meeting_id AND l.event_id = f.event_id)"""

_ACTIONS = ("Gửi báo cáo doanh thu", "Kiểm tra dashboard", "Viết kịch bản kiểm thử", "Cập nhật tài liệu", "Review dashboard metrics", "Gửi báo cáo tuần")


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 7 < 4")
    of = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)
    k = F.col("vec_id")
    return rows.select(
        (k % 40).alias("meeting_id"), F.concat(F.lit("TASK-"), k).alias("task_id"), F.array(of(_ACTIONS, k), F.concat(F.lit("task "), k % 9)).alias("aliases"), F.col("embedding").alias("vector"), F.array(of(("An", "Bình", "Chi"), k)).alias("owners"),
        F.array(of(("t1", "t2"), k)).alias("topics"), (k % 90).alias("last_index"),
    )


def ret05_task_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second state of the tasks (some renamed, some gone, some new) does to an index of the first."""
    text = V.representation(F.col("aliases")[0], F.col("aliases"), F.col("owners"), F.col("topics"))
    rows = _tasks(spark, sf_dir).select("task_id", text.alias("text"), "last_index")
    new = rows.where("last_index % 6 <> 1").select("task_id", F.when(F.col("last_index") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return V.index_changes(rows.where("last_index % 6 <> 2").select("task_id", "text"), new)


RET05 = """SELECT 'TASK-' || vec_id AS task_id, CASE WHEN vec_id % 90 % 6 = 1 THEN 'REMOVED' WHEN vec_id % 90 % 6 = 2 THEN 'EMBEDDED' WHEN vec_id % 90 % 5 = 0 THEN 'EMBEDDED' ELSE 'KEPT' END AS state FROM embeddings WHERE vec_id % 7 < 4"""


def ret06_task_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    of = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)
    queries = table(spark, sf_dir, "embeddings").where("vec_id % 7 >= 4").select(
        (k % 41).alias("meeting_id"), F.col("vec_id").cast("string").alias("query_id"), F.when(k % 11 == 0, F.concat(F.lit("TASK-"), k - k % 7)).otherwise("").alias("explicit_id"),
        F.when(k % 3 == 0, F.concat(F.lit("Task "), k % 9)).otherwise(F.concat(of(_ACTIONS, k), F.lit(" lại"))).alias("action_ref"), F.col("embedding").alias("vector"), F.array(of(("an", "Bình", "Zed"), k)).alias("owners"), F.array(of(("t1", "t3"), k)).alias("topics"),
        (k % 120).alias("order_index"),
    )
    found = V.linked(queries, _tasks(spark, sf_dir), blocks=16)
    return found.select("query_id", "status", "task_id", "reason", F.round("margin", 6).alias("margin"), F.array_join("candidates", ",").alias("candidates"))


_arr = lambda values: "[" + ", ".join(map(sql_text, values)) + "]"
_set = lambda c: f"list_distinct(list_filter(regexp_split_to_array({match_sql(c)}, '[^\\pL\\pN_]+'), lambda w: w <> ''))"
_RET_REFS = [plain_text(f"Task {n}") for n in range(9)] + [plain_text(f"{a} lại") for a in _ACTIONS]
_RET_ALIASES = [plain_text(a) for a in _ACTIONS] + [f"task {n}" for n in range(9)]
RET06L = f"""WITH x(a, b, ratio) AS (VALUES {_ratios(_RET_REFS, _RET_ALIASES)}), t AS (SELECT vec_id % 40 AS meeting_id, 'TASK-' || vec_id AS task_id, {_arr(_ACTIONS)}[vec_id % 6 + 1] AS a1, 'task ' || vec_id % 9 AS a2, embedding::DOUBLE[] AS v, ['an', 'binh', 'chi'][vec_id % 3 + 1] AS owner, ['t1', 't2'][vec_id % 2 + 1] AS topic, vec_id % 90 AS last_index FROM embeddings WHERE vec_id % 7 < 4),
q AS (SELECT vec_id % 41 AS meeting_id, vec_id::VARCHAR AS query_id, CASE WHEN vec_id % 11 = 0 THEN 'TASK-' || (vec_id - vec_id % 7) ELSE '' END AS explicit_id, CASE WHEN vec_id % 3 = 0 THEN 'Task ' || vec_id % 9 ELSE {_arr(_ACTIONS)}[vec_id % 6 + 1] || ' lại' END AS ref,
    embedding::DOUBLE[] AS v, ['an', 'binh', 'zed'][vec_id % 3 + 1] AS owner, ['t1', 't3'][vec_id % 2 + 1] AS topic, vec_id % 120 AS i FROM embeddings WHERE vec_id % 7 >= 4),
j AS (SELECT q.meeting_id, query_id, explicit_id, task_id, coalesce({match_sql('ref')} IN ({match_sql('a1')}, a2), false) AS exact, greatest(0.0, least(1.0, list_cosine_similarity(q.v, t.v))) AS semantic,
    greatest((SELECT ratio FROM x WHERE a = {match_sql('ref')} AND b = {match_sql('a1')}), (SELECT ratio FROM x WHERE a = {match_sql('ref')} AND b = a2), len(list_intersect({_set('ref')}, {_set('a1')})) / len(list_distinct({_set('ref')} || {_set('a1')})), len(list_intersect({_set('ref')}, {_set('a2')})) / len(list_distinct({_set('ref')} || {_set('a2')}))) AS lexical,
    CASE WHEN q.topic = t.topic THEN 1.0 ELSE 0.0 END AS topic, CASE WHEN q.owner = t.owner THEN 1.0 ELSE 0.0 END AS owner, CASE WHEN i < last_index THEN 0.0 ELSE greatest(0.0, 1 - least(i - last_index, 200) / 200) END AS recency FROM q LEFT JOIN t USING (meeting_id)),
s AS (SELECT *, round(least(1.0, greatest(0.0, 0.55::DOUBLE * semantic + 0.2::DOUBLE * lexical + 0.1::DOUBLE * topic + 0.1::DOUBLE * owner + 0.05::DOUBLE * recency)), 6) AS total FROM j),
r AS (SELECT *, row_number() OVER w AS place, coalesce(lead(total) OVER w, 0.0) AS second FROM s WINDOW w AS (PARTITION BY meeting_id, query_id ORDER BY total DESC, task_id)),
g AS (SELECT meeting_id, query_id, any_value(explicit_id) AS explicit_id, max(CASE WHEN task_id = explicit_id THEN task_id END) AS by_id, count(task_id) FILTER (exact) AS n_exact, max(CASE WHEN exact THEN task_id END) AS by_alias, max(task_id) FILTER (place = 1) AS best,
    max(total) FILTER (place = 1) AS total, max(second) FILTER (place = 1) AS second, max(lexical) FILTER (place = 1) AS lexical, max(semantic) FILTER (place = 1) AS semantic, string_agg(task_id, ',' ORDER BY place) FILTER (place <= 5) AS listed,
    string_agg(task_id, ',' ORDER BY place) FILTER (place <= 5 AND exact) AS listed_exact, count(task_id) AS n FROM r GROUP BY meeting_id, query_id),
a AS (SELECT *, round(greatest(0.0, total - second), 6) AS gap FROM g),
d AS (SELECT *, CASE WHEN n = 0 THEN 'NO_ACTIVE_TASK_CANDIDATES' WHEN explicit_id <> '' AND by_id IS NOT NULL THEN 'EXACT_TASK_ID' WHEN explicit_id <> '' THEN 'UNKNOWN_EXPLICIT_TASK_ID' WHEN n_exact = 1 THEN 'EXACT_ALIAS' WHEN n_exact > 1 THEN 'MULTIPLE_EXACT_ALIAS_MATCHES'
    WHEN total >= 0.78 AND gap >= 0.12 THEN CASE WHEN lexical >= semantic THEN 'LEXICAL_DIRECT_LINK' ELSE 'SEMANTIC_DIRECT_LINK' END WHEN total >= 0.6 THEN 'AMBIGUOUS_TOP_K' ELSE 'BELOW_TASK_LINK_THRESHOLD' END AS reason FROM a)
SELECT query_id, CASE WHEN reason IN ('EXACT_TASK_ID', 'EXACT_ALIAS', 'LEXICAL_DIRECT_LINK', 'SEMANTIC_DIRECT_LINK') THEN 'DIRECT_LINK' WHEN reason IN ('MULTIPLE_EXACT_ALIAS_MATCHES', 'AMBIGUOUS_TOP_K') THEN 'AI_MUTATION_CHECK' ELSE 'UNRESOLVED' END AS status,
  CASE reason WHEN 'EXACT_TASK_ID' THEN by_id WHEN 'EXACT_ALIAS' THEN by_alias WHEN 'LEXICAL_DIRECT_LINK' THEN best WHEN 'SEMANTIC_DIRECT_LINK' THEN best END AS task_id, reason,
  round(CASE WHEN reason IN ('EXACT_TASK_ID', 'EXACT_ALIAS') THEN 1.0 WHEN reason IN ('NO_ACTIVE_TASK_CANDIDATES', 'UNKNOWN_EXPLICIT_TASK_ID') THEN 0.0 ELSE gap END, 6)::DOUBLE AS margin,
  coalesce(CASE WHEN reason = 'MULTIPLE_EXACT_ALIAS_MATCHES' THEN listed_exact WHEN reason IN ('LEXICAL_DIRECT_LINK', 'SEMANTIC_DIRECT_LINK', 'AMBIGUOUS_TOP_K', 'BELOW_TASK_LINK_THRESHOLD') THEN listed END, '') AS candidates FROM d"""


def ret04_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the score of each conversation's turns against its first turn's words."""
    rows = table(spark, sf_dir, "conversations")
    first = rows.groupBy("conv_id").agg(F.min_by("text", "turn").alias("ref"), F.min("turn").alias("at"))
    pairs = rows.join(first, "conv_id")
    return pairs.select("conv_id", "turn", F.round(V.shared_words(F.col("ref"), F.array("text", "role")), 6).alias("lexical"), F.round(V.recency(F.col("turn"), F.col("at"), 10), 6).alias("recency"))


RET04 = f"""WITH f AS (SELECT conv_id, arg_min(text, turn) AS ref, min(turn) AS at0 FROM conversations GROUP BY conv_id),
p AS (SELECT c.*, at0, {match_sql('ref')} AS own, {_set('ref')} AS x, {_set('text')} AS y, {_set('role')} AS z FROM conversations c JOIN f USING (conv_id))
SELECT conv_id, turn, round(CASE WHEN own = '' THEN 0.0 ELSE greatest(CASE WHEN len(list_distinct(x || y)) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / len(list_distinct(x || y)) END, CASE WHEN len(list_distinct(x || z)) = 0 THEN 0.0 ELSE len(list_intersect(x, z)) / len(list_distinct(x || z)) END) END, 6)::DOUBLE AS lexical,
  round(greatest(0.0, 1 - least(turn - at0, 10) / 10), 6)::DOUBLE AS recency FROM p"""


def ret08_topic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of the three nearest topics (labels) of each query's meeting."""
    k = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings")
    clauses = rows.where("vec_id % 10 <> 0").select((k % 8).alias("meeting_id"), k.alias("clause_id"), k.alias("order_index"), F.col("label").alias("topic_id"), F.col("embedding").alias("vector"))
    queries = rows.where("vec_id % 10 = 0").select((k % 8).alias("meeting_id"), k.alias("query_id"), F.col("embedding").alias("vector"))
    return V.by_topic(queries, clauses, blocks=8).select("query_id", "topic_id", "clause_id", "place")


RET08 = """WITH c AS (SELECT vec_id % 8 AS m, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 10 <> 0), q AS (SELECT vec_id % 8 AS m, vec_id AS query_id, embedding::DOUBLE[] AS w FROM embeddings WHERE vec_id % 10 = 0),
p AS (SELECT m, label, vec_id, unnest(range(0, len(v))) AS i, unnest(v) AS x FROM c), a AS (SELECT m, label, i, avg(x) AS x FROM p GROUP BY ALL), z AS (SELECT m, label, list(x ORDER BY i) AS v FROM a GROUP BY m, label),
f AS (SELECT m, label, min(vec_id) AS first FROM c GROUP BY ALL),
t AS (SELECT q.m, query_id, w, label, row_number() OVER (PARTITION BY query_id ORDER BY round(greatest(0.0, least(1.0, list_cosine_similarity(w, v))), 6) DESC, first, label) AS tp FROM q JOIN z USING (m) JOIN f USING (m, label) QUALIFY tp <= 3)
SELECT query_id, t.label AS topic_id, vec_id AS clause_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tp, round(greatest(0.0, least(1.0, list_cosine_similarity(w, v))), 6) DESC, vec_id) AS INTEGER) AS place FROM t JOIN c ON c.m = t.m AND c.label = t.label QUALIFY place <= 12"""

QUERIES = {
    "led07_strict_reducer": (led07_strict_reducer, LED07S), "led08_recap_snapshots": (led08_recap_snapshots, LED08), "lnk03_targets": (lnk03_targets, LNK03), "agg02_suppressed": (agg02_suppressed, AGG02),
    "ret04_scores": (ret04_scores, RET04), "ret05_task_index": (ret05_task_index, RET05), "ret06_task_links": (ret06_task_links, RET06L), "ret08_topic_search": (ret08_topic_search, RET08),
}
