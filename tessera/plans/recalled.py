"""Queries over topics, contexts in tiers, memory as of a clause, and the replay of retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import sequence_id
from tessera.operators import memory, topics
from tessera.operators import retrieval as V
from tessera.plans.linked import NAMES, shaped_events
from tessera.plans.rendered import ORDERED_SQL, _ordered, table
from tessera.plans.said import match_sql, sql_text
from tessera.sources import corpus

#: What is said, by event_id: two of them begin a topic.
SAID = (
    "Chuyển sang ngân sách quý này", "ok", "Báo cáo doanh thu cần thêm số liệu của tháng trước", "Next item is the release plan for the customer portal", "We have to look at the dashboard again", "Dạ vâng",
    "Gửi bộ dữ liệu khách hàng cho đội kiểm thử", "Task Budget dashboard vẫn còn mở", "An và Bình xem lại hợp đồng với ngân hàng",
)


def _of(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses with a vector each: that of the embedding of the same number, modulo 500."""
    rows, k = _ordered(spark, sf_dir), F.col("event_id")
    vectors = F.broadcast(table(spark, sf_dir, "embeddings").where("vec_id < 500").select(F.col("vec_id").alias("v"), F.col("embedding").alias("vector")))  # v is below 500
    text = F.concat_ws(" ", _of(SAID, k), "k")
    return rows.withColumn("v", F.floor(k / 3) % 500).join(vectors, "v").select(
        "meeting_id", sequence_id("CLAUSE", F.col("order_index") + 1).alias("clause_id"), "order_index", _of(NAMES, F.floor(k / 2)).alias("speaker_name"), F.floor(k / 2).alias("caption"), text.alias("text_raw"), "vector",
    )


def ret07_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic of each clause."""
    return topics.segmented(spoken(spark, sf_dir)).select("meeting_id", "clause_id", "topic_id")


_MEAN = "list_transform(range(1, 65), lambda i: list_sum(list_transform({0}, lambda v: v[i])) / len({0}))"
_LIST = "[" + ", ".join(map(sql_text, SAID)) + "]"
RET07 = f"""WITH RECURSIVE {ORDERED_SQL}, c AS (SELECT meeting_id, order_index, event_id, event_id // 2 AS caption, event_id // 2 % {len(NAMES)} AS speaker, {match_sql(f"{_LIST}[event_id % {len(SAID)} + 1] || CASE WHEN k = '' THEN '' ELSE ' ' || k END")} AS said, embedding::DOUBLE[] AS v
    FROM ordered JOIN embeddings ON vec_id = event_id // 3 % 500),
m AS (SELECT *, regexp_matches(said, '^(?:chuyen sang|tiep theo|ve phan|con chuyen|next item|moving on|regarding)(?:[^a-z0-9_]|$)') AS marks, lag(caption) OVER w AS before FROM c WINDOW w AS (PARTITION BY meeting_id ORDER BY order_index)),
t AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> caption OR marks THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY order_index) AS turn FROM m),
g AS (SELECT meeting_id, turn, first(marks ORDER BY order_index) AS marks, len(list_filter(string_split(string_agg(said, ' ' ORDER BY order_index), ' '), lambda x: x <> '')) < 4 AS short, list(v ORDER BY order_index) AS vs FROM t GROUP BY meeting_id, turn),
u AS (SELECT meeting_id, turn, marks, short, {_MEAN.format("vs")} AS v FROM g),
walk AS (SELECT meeting_id, turn, 1 AS topic, [v] AS recent FROM u WHERE turn = 1
  UNION ALL SELECT w.meeting_id, u.turn, w.topic + b::INTEGER, CASE WHEN b THEN [u.v] ELSE list_append(w.recent, u.v)[-3:] END FROM walk w JOIN u ON u.meeting_id = w.meeting_id AND u.turn = w.turn + 1,
    LATERAL (SELECT u.marks OR (NOT u.short AND greatest(0.0, least(1.0, list_cosine_similarity({_MEAN.format("w.recent")}, u.v))) < 0.42) AS b) x)
SELECT t.meeting_id, printf('CLAUSE-%06d', order_index + 1) AS clause_id, printf('TOPIC-%04d', topic) AS topic_id FROM t JOIN walk USING (meeting_id, turn)"""


def win13_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of every seventh clause, with tasks that rest on clauses of the whole meeting."""
    rows = topics.segmented(spoken(spark, sf_dir))
    asked = rows.where("order_index % 7 = 3").select("meeting_id", F.concat_ws("/", "meeting_id", "clause_id").alias("query_id"), "order_index", "vector")
    i, size = F.col("order_index"), F.lit(40)
    ids = lambda step, n: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda j: F.format_string("CLAUSE-%06d", ((i * step + j * 9 + F.col("task_at") * 5) % size + 1).cast("int")))
    evidence = asked.select("query_id", "order_index", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("task_at")).select("query_id", "task_at", ids(3, 4).alias("source_ids"), ids(5, 5).alias("history_ids"))
    found = topics.contexts(asked, rows, evidence)
    return found.select("query_id", F.array_join("ids", ",").alias("clause_ids"), F.array_join("tiers", ",").alias("tiers"), "characters", "clause_cap", "character_cap")


def win12_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks that were there before every ninth clause, ranked by what is said around it."""
    rows = spoken(spark, sf_dir)
    windows = rows.where("order_index % 9 = 8").select("meeting_id", F.col("clause_id").alias("window_id"), "order_index", F.col("text_raw").alias("context"))
    found = memory.candidates(shaped_events(spark, sf_dir), windows)
    return found.select("meeting_id", "window_id", "place", "task_id", "task_name", F.array_join("aliases", "|").alias("aliases"), "assignee", "status", "last_index")


def ret09_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What retrieval would have said of each change, from the tasks before it, and whether the ledger agrees."""
    events = shaped_events(spark, sf_dir)
    seen = corpus.stored(memory.versions(events).drop("clauses"), "versions")  # read twice
    vectors = F.broadcast(table(spark, sf_dir, "embeddings").where("vec_id < 500").select(F.col("vec_id").alias("v"), F.col("embedding").alias("vector")))
    key = F.concat_ws("/", "meeting_id", "event_id")
    with_vector = lambda df, of: df.withColumn("v", F.pmod(F.xxhash64(of), F.lit(500))).join(vectors, "v")
    asked = events.where(F.col("event_type").isin(*memory.MUTATE)).select(
        key.alias("meeting_id"), key.alias("query_id"), F.col("related_task_id").alias("explicit_id"), F.when(F.col("related_task_hint") != "", F.col("related_task_hint")).otherwise(F.col("action_text")).alias("action_ref"),
        F.filter(F.array("assignee"), lambda x: x != "").alias("owners"), F.array(F.lit("t")).alias("topics"), "order_index", F.col("meeting_id").cast("string").alias("dealt"),
    )
    tasks = seen.where("task_id is not null").select(
        key.alias("meeting_id"), "task_id", "aliases", "forms", "owners", "owner_forms", F.array(F.lit("t")).alias("topics"), F.array(F.lit("t")).alias("topic_forms"), "last_index",
        F.col("meeting_id").cast("string").alias("dealt"),
    )
    found = V.linked(with_vector(asked, F.col("action_ref")), with_vector(tasks, F.try_element_at("aliases", F.lit(1))))
    bound = seen.groupBy(key.alias("query_id")).agg(F.max("bound").alias("bound"))
    return found.join(bound, "query_id").select("query_id", "status", "reason", "task_id", "bound", F.col("task_id").eqNullSafe(F.col("bound")).alias("agrees"))


QUERIES = {
    "ret07_topics": (ret07_topics, RET07), "win13_contexts": (win13_contexts, None), "win12_memory": (win12_memory, None), "ret09_replay": (ret09_replay, None),
}
