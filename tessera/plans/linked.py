"""Queries over the ledger with linking: task events of many shapes, the fold, what it counts, merges and operations.

The shape of an event is event_id modulo their number; {k} is the number in `props` modulo 4, {p} a participant. What a fold
leaves can't be said in SQL: `tests/test_linking.py` holds every task of the table against a ledger that compares everything.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import sequence_id
from tessera.operators import linking, recaps
from tessera.plans.rendered import _ordered, table
from tessera.sources import corpus

NAMES = ("An", "Bình", "Chi", "Dũng", "Giang")


class Shape(NamedTuple):
    kind: str
    source: str
    action: str
    owner: str = ""
    due: bool = False
    target: str = ""
    hint: str = ""
    confidence: float = 0.7


SHAPES = (
    Shape("TASK_CREATE", "RULE", "Viết báo cáo doanh thu quý {k}", "{p}"),
    Shape("TASK_CREATE", "RULE", "Prepare release plan {k}", "{p}", True),
    Shape("TASK_COMMITMENT", "RULE", "gửi bộ dữ liệu khách hàng {k}", "{p}"),
    Shape("OWNER_ASSIGN", "RULE", "báo cáo doanh thu quý {k}", "{p}"),
    Shape("DEADLINE_SET", "RULE", "báo cáo doanh thu quý {k}", "", True),
    Shape("DEADLINE_REPLACE", "RULE", "", "", True),
    Shape("TASK_CANCEL", "RULE", "release plan {k}"),
    Shape("TASK_REFERENCE", "RULE_REFERENCE", "migration plan {k}", confidence=0.88),
    Shape("OWNER_ASSIGN", "RULE", "migration plan {k}", "{p}"),
    Shape("TASK_REFERENCE", "RULE_REFERENCE_ACTIVE", "Budget dashboard {k}", confidence=0.92),
    Shape("TASK_CREATE", "HUMAN_NOTE", "Update API module", "{p}"),
    Shape("TASK_CREATE", "RULE", "Update API module for the customer portal", "{p}"),
    Shape("TASK_CREATE", "RULE_FINAL_RECAP", "Task {k}: Review contract with the bank", "{p}", True),
    Shape("TASK_CREATE", "RULE_FINAL_RECAP", "Task 9: Review contract with the agency", "{p}"),
    Shape("OWNER_REASSIGN", "RULE", "Review contract with the bank", "{p}"),
    Shape("DEADLINE_SET", "RULE", "", "{p}", True),
    Shape("DEADLINE_SET", "AI", "migration plan {k}", "", True),
    Shape("DEADLINE_REPLACE", "AI", "", "", True, "TASK-000001"),
    Shape("TASK_CREATE", "AI", "Invent something new {k}", "{p}"),
    Shape("TASK_CREATE", "AI_CREATE_PROPOSAL", "Draft the wireframe {k}", "{p}"),
    Shape("TASK_REJECT", "RULE", "Draft the wireframe {k}"),
    Shape("TASK_CREATE", "RULE", "Draft wireframe {k}", "{p}"),
    Shape("OWNER_REASSIGN", "RULE", "", "{p}; {q}", False, "TASK-000002"),
    Shape("TASK_CANCEL", "RULE", "", "", False, "TASK-000404"),
    Shape("TASK_CREATE", "RULE_CONTEXT", "Gửi dataset khách hàng {k}", "{p}"),
    Shape("TASK_COMMITMENT", "RULE_NOTE_CUE", "gửi dataset khách hàng {k}", "{q}", True),
    Shape("TASK_REFERENCE", "RULE", "chuyện cũ"),
    Shape("OWNER_ASSIGN", "RULE_RECAP", "Prepare release plan {k} and tell the board", "{p}"),
    Shape("TASK_REFERENCE", "RULE_REFERENCE", "chuyện kia", confidence=0.8),
    Shape("OWNER_ASSIGN", "RULE", "chuyện kia", "{q}"),
    Shape("TASK_CREATE", "RULE_PENDING_CONFIRMATION", "Kiểm tra sandbox thanh toán", "{p}"),
    Shape("TASK_REJECT", "RULE", "", "", hint="kiểm tra sandbox thanh toán"),
    Shape("TASK_CREATE", "RULE", "A - Kiểm thử màn hình {k}", "{p}"),
    Shape("TASK_CREATE", "RULE", "B - Kiểm thử màn hình {k}", "{p}"),
    Shape("DEADLINE_REPLACE", "RULE", "Kiểm thử màn hình {k}", "{p}", True),
    Shape("OWNER_ASSIGN", "RULE", "", "{p}"),
    Shape("TASK_CREATE", "HUMAN_NOTE", "Viết tài liệu có vẻ giống nhau?", "{p}"),
    Shape("TASK_CREATE", "RULE", "Write weekly notes {k}", "", False, "NOTE-{k}"),
    Shape("OWNER_ASSIGN", "RULE", "Chốt lịch phỏng vấn"),
)


def shaped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task events of each meeting, with the number of their shape."""
    names = F.array(*map(F.lit, NAMES))
    name = lambda n: F.element_at(names, (n % len(NAMES)).cast("int") + 1)
    filled = lambda text: F.replace(F.replace(F.replace(text, F.lit("{k}"), (F.coalesce(F.expr("try_cast(k as int)"), F.lit(0)) % 4).cast("string")), F.lit("{p}"), name(F.floor(F.col("event_id") / 11))), F.lit("{q}"), name(F.floor(F.col("event_id") / 3)))
    shapes = spark.createDataFrame([(i, *s) for i, s in enumerate(SHAPES)], "shape int, kind string, source string, action string, owner string, due boolean, target string, hint string, confidence double")
    rows = _ordered(spark, sf_dir).withColumn("shape", (F.col("event_id") % len(SHAPES)).cast("int")).join(F.broadcast(shapes), "shape")
    return rows.select(
        "meeting_id", sequence_id("EVENT", F.col("order_index") + 1).alias("event_id"), F.col("kind").alias("event_type"), filled(F.col("target")).alias("related_task_id"),
        F.col("hint").alias("related_task_hint"), filled(F.col("action")).alias("action_text"), filled(F.col("owner")).alias("assignee"),
        F.when(F.col("due"), F.concat(F.lit("DATE-"), F.col("event_id") % 5)).otherwise("").alias("deadline_mention_id"), F.col("source").alias("extraction_source"), "confidence",
        F.array(sequence_id("CLAUSE", F.col("order_index") + 1)).alias("source_clause_ids"), (F.col("event_id") % 2 == 0).alias("corroborated_by_rule"),
        F.col("order_index").cast("long").alias("order_index"), "shape",
    )


def led02_linked_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every task of every meeting: name, owners, deadline, state, aliases and evidence."""
    listed = lambda c: F.array_join(c, "|").alias(c)
    found = linking.folded(shaped_events(spark, sf_dir))
    return found.select(*[listed(c) if t.startswith("array") else c for c, t in found.dtypes])


def lnk01_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How events found their task, meeting by meeting."""
    return linking.counted(shaped_events(spark, sf_dir))


def led05_merged_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible tasks after those that are one have been merged."""
    found = linking.folded(shaped_events(spark, sf_dir), merge=True).where(~F.col("status").isin("PROVISIONAL", "CANCELLED", "REJECTED"))
    return found.select("meeting_id", "task_id", "task_name", "assignee", "deadline_mention_id", "status", F.array_join("events", "|").alias("events"))


def led04_mutual_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of a meeting that are each other's best and only match (0.84, margin 0.08) by all their names."""
    tasks = linking.folded(shaped_events(spark, sf_dir)).where(~F.col("status").isin("PROVISIONAL", "CANCELLED", "REJECTED"))
    owners = F.filter(F.split("assignee", "; "), lambda x: x != "")
    return linking.merge_candidates(tasks.withColumn("owners", owners)).withColumn("score", F.round("score", 6))


def snk04_resumed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of ledgers that were saved after the events before each meeting's thirtieth and went on with the others."""
    events = shaped_events(spark, sf_dir)
    saved = linking.checkpoints(events.where("order_index < 30"))
    found = linking.restored(linking.checkpoints(events.where("order_index >= 30"), saved))
    return found.select("meeting_id", "task_id", "task_name", "assignee", "deadline_mention_id", "status", F.array_join("events", "|").alias("events"))


def src10_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as folders of cases, some of their files broken or left out, and scanned again."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line")))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    k = F.col("conv_id")
    case = F.format_string("CASE-%06d", k)
    files = F.array(
        F.when(k % 7 != 1, F.struct(F.lit("metadata.json").alias("file"), F.when(k % 11 == 3, "{broken").otherwise(F.concat(F.lit('{"case_id": "'), case, F.lit('", "turns": '), F.size("lines").cast("string"), F.lit("}"))).alias("text"))),
        F.when(k % 7 != 2, F.struct(F.lit("transcript.txt").alias("file"), text.alias("text"))),
        F.when(k % 7 != 4, F.struct(F.lit("expected_output.json").alias("file"), F.lit('{"tasks": []}').alias("text"))),
        F.when(k % 2 == 0, F.struct(F.lit("meeting_note.txt").alias("file"), F.lit("note").alias("text"))),
    )
    path = f"{corpus.shared_folder(spark)}/cases-{uuid.uuid4().hex}"
    corpus.write_cases(rows.select(case.alias("case_id"), F.explode(F.array_compact(files)).alias("x")).select("case_id", "x.*"), path)
    found = corpus.cases(spark, path)
    turns = F.try_variant_get("metadata_json", "$.turns", "int")
    return found.select("case_id", "problem", turns.alias("turns"), F.size(F.split("transcript", "\n")).alias("n_lines"), F.sha2("transcript", 256).alias("sha"), F.col("meeting_note").isNotNull().alias("has_note"))


SRC10 = r"""WITH c AS (SELECT conv_id AS k, count(*) AS n, string_agg(concat_ws(': ', role, text), chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT printf('CASE-%06d', k) AS case_id, CASE WHEN k % 7 = 1 THEN 'MISSING_METADATA' WHEN k % 7 = 2 THEN 'MISSING_TRANSCRIPT' WHEN k % 7 = 4 THEN 'MISSING_EXPECTED_OUTPUT' WHEN k % 11 = 3 THEN 'BROKEN_METADATA' END AS problem,
  CASE WHEN k % 7 <> 1 AND k % 11 <> 3 THEN CAST(n AS INTEGER) END AS turns, CASE WHEN k % 7 <> 2 THEN CAST(len(string_split(t, chr(10))) AS INTEGER) END AS n_lines, CASE WHEN k % 7 <> 2 THEN sha256(t) END AS sha, k % 2 = 0 AS has_note FROM c"""


def src11_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meetings written as traces, some of them broken, without id, or with a clause twice, and scanned again."""
    k = F.col("meeting_id")
    rows = shaped_events(spark, sf_dir).groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("order_index", F.element_at("source_clause_ids", 1).alias("clause_id")))).alias("cs"))
    ids = F.transform("cs", lambda x: F.struct(x["clause_id"].alias("clause_id")))
    ids = F.when(k % 5 == 2, F.concat(ids, F.slice(ids, 1, 1))).otherwise(ids)
    whole = F.to_json(F.struct(F.when(k % 5 != 3, F.concat(F.lit("M"), k)).alias("meeting_id"), ids.alias("clauses"), F.slice(ids, 1, 3).alias("records")))
    body = F.when(k % 5 == 1, F.substr(whole, F.lit(1), F.length(whole) - 5)).when(k % 5 == 4, F.to_json(F.slice(ids, 1, 2))).otherwise(whole)
    path = f"{corpus.shared_folder(spark)}/traces-{uuid.uuid4().hex}"
    corpus.write_cases(rows.select(F.lit("all").alias("case_id"), F.format_string("M-v1-%06d.json", k).alias("file"), body.alias("text")), path)
    return corpus.traces(spark, path).select("file", "meeting_id", "n_clauses", F.size("records").alias("n_records"), "problem")


SRC11 = r"""WITH m AS (SELECT user_id AS k, count(*) AS n FROM events GROUP BY user_id)
SELECT printf('M-v1-%06d.json', k) AS file, CASE WHEN k % 5 IN (0, 2) THEN 'M' || k END AS meeting_id, CAST(CASE k % 5 WHEN 0 THEN n WHEN 2 THEN n + 1 WHEN 3 THEN n ELSE 0 END AS INTEGER) AS n_clauses,
  CAST(CASE k % 5 WHEN 1 THEN 0 WHEN 4 THEN least(n, 2) ELSE least(n + CASE WHEN k % 5 = 2 THEN 1 ELSE 0 END, 3) END AS INTEGER) AS n_records, CASE k % 5 WHEN 1 THEN 'BROKEN_JSON' WHEN 2 THEN 'REPEATED_CLAUSE' WHEN 3 THEN 'NO_MEETING_ID' WHEN 4 THEN 'NO_MEETING_ID' END AS problem FROM m"""


def snk05_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task events as JSON Lines, and the report of what was written."""
    rows = shaped_events(spark, sf_dir).select("meeting_id", "order_index", "event_id", "event_type", "action_text")
    n, digest = corpus.write_lines(rows, f"{corpus.shared_folder(spark)}/lines-{uuid.uuid4().hex}", ["meeting_id", "order_index"])
    return spark.createDataFrame([(n, digest)], "n long, digest string")


def _snapshot_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Visible tasks; clauses that tell their state at the end: both first tasks (0), one and something unknown (1), one twice (2), without a row of
    others (3), by user_id modulo 5; and scopes, of which every seventh isn't authoritative."""
    tasks = linking.folded(shaped_events(spark, sf_dir)).where(~F.col("status").isin("PROVISIONAL", "CANCELLED", "REJECTED"))
    tasks = corpus.stored(tasks.select("meeting_id", "task_id", "task_name", "assignee", "deadline_mention_id", "status", "last_index"), "visible-tasks")  # read five times
    k = F.col("meeting_id") % 5
    names = tasks.groupBy("meeting_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("task_id", "task_name"))), lambda x: F.regexp_replace(x["task_name"], "[,;:?-]", " ")).alias("names"))
    first, second = F.element_at("names", 1), F.coalesce(F.try_element_at("names", F.lit(2)), F.lit("nothing like it"))
    listed = F.when(k == 0, F.concat_ws(", ", first, second)).when(k == 1, F.concat_ws(" và ", first, F.lit("mua xe mới"))).when(k == 2, F.concat_ws("; ", first, first)).otherwise(first)
    said = F.array(F.struct(F.lit(1).alias("order_index"), F.lit("An").alias("speaker_name"), F.concat(F.lit("Final recap: tasks active: "), listed).alias("text_raw")),
                   F.struct(F.lit(2).alias("order_index"), F.lit("An").alias("speaker_name"), F.when(k == 3, "hết").otherwise("Hủy: demo").alias("text_raw")),
                   F.struct(F.lit(3).alias("order_index"), F.lit("Chi").alias("speaker_name"), F.lit("tasks active: another").alias("text_raw")))
    clauses = names.select("meeting_id", F.explode(said).alias("x")).select("meeting_id", "x.*")
    scope = names.select("meeting_id", F.when(F.col("meeting_id") % 7 == 6, "COMPLETE").otherwise("AUTHORITATIVE").alias("scope"))
    return tasks, clauses, scope


def pol04_active_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks that final recaps leave active."""
    tasks, clauses, scope = _snapshot_inputs(spark, sf_dir)
    return recaps.active_snapshot(tasks, recaps.active_labels(clauses), scope).select("meeting_id", "task_id", "task_name", "assignee", "status")


QUERIES = {
    "pol04_active_snapshot": (pol04_active_snapshot, None),
    "snk04_resumed_tasks": (snk04_resumed_tasks, None), "src10_cases": (src10_cases, SRC10), "src11_traces": (src11_traces, SRC11), "snk05_lines": (snk05_lines, None),
    "led04_mutual_merges": (led04_mutual_merges, None),
    "led02_linked_tasks": (led02_linked_tasks, None), "lnk01_link_counts": (lnk01_link_counts, None), "led05_merged_tasks": (led05_merged_tasks, None),
}
