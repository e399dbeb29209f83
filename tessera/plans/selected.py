"""Queries over windows, contexts, pools and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import selection as S
from tessera.plans.rendered import table
from tessera.plans.said import SAID_SQL, said


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window per clause: around some (their number modulo 17 under 5) with their context, around the others without; every third of them for rules."""
    near = W.partitionBy("meeting_id").orderBy("order_index").rowsBetween(-3, 5)
    wide = F.col("order_index") * 7 % 17 < 5
    rows = said(spark, sf_dir).withColumn("context", F.when(wide, F.collect_list("order_index").over(near)).otherwise(F.array("order_index")))
    return rows.select("meeting_id", "order_index", "context", (F.col("order_index") % 10).alias("score"), F.when(F.col("order_index") % 3 == 0, "RULE").otherwise("AI").alias("strategy"))


_WINDOWS_SQL = SAID_SQL + """, w AS (SELECT meeting_id, order_index, list(order_index) OVER (PARTITION BY meeting_id ORDER BY order_index ROWS BETWEEN 3 PRECEDING AND 5 FOLLOWING) AS near FROM said),
ws AS (SELECT meeting_id, CASE WHEN order_index * 7 % 17 < 5 THEN near ELSE [order_index] END AS context, order_index % 10 AS score, CASE WHEN order_index % 3 = 0 THEN 'RULE' ELSE 'AI' END AS strategy, order_index FROM w)"""


def _fold_sql(source: str, joins: str, ai: bool) -> str:
    """A recursive walk over the numbered windows of `source`; `c` is the one that grows, `n` the next."""
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY order_index) AS i FROM {source}),
walk AS (SELECT meeting_id, i, 1 AS number, [order_index] AS prim, context, score, strategy, 1 AS members FROM numbered WHERE i = 1
  UNION ALL SELECT n.meeting_id, n.i, CASE WHEN {joins} THEN c.number ELSE c.number + 1 END, CASE WHEN {joins} THEN c.prim || [n.order_index] ELSE [n.order_index] END,
    CASE WHEN {joins} THEN list_sort(list_distinct(c.context || n.context)) ELSE n.context END, CASE WHEN {joins} THEN greatest(c.score, n.score) ELSE n.score END,
    CASE WHEN {joins} AND {'true' if ai else 'false'} AND (c.strategy = 'AI' OR n.strategy = 'AI') THEN 'AI' WHEN {joins} THEN c.strategy ELSE n.strategy END, CASE WHEN {joins} THEN c.members + 1 ELSE 1 END
  FROM walk c JOIN numbered n ON n.meeting_id = c.meeting_id AND n.i = c.i + 1)
SELECT meeting_id, CAST(number AS INTEGER) AS number, array_to_string(prim, ',') AS "primary", len(context)::INTEGER AS n, CAST(score AS INTEGER) AS score, strategy, CAST(members AS INTEGER) AS members FROM walk QUALIFY row_number() OVER (PARTITION BY meeting_id, number ORDER BY i DESC) = 1"""


_UNION = "len(list_distinct(c.context || n.context))"
_NEAR = "n.context[1] - c.context[-1] <= 3"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("meeting_id", "number", F.array_join(F.transform("primary", lambda x: x.cast("string")), ",").alias("primary"), "n", "score", "strategy", "members")


def win02_merged_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(S.merged_windows(_windows(spark, sf_dir), most=30))


_MERGES = f"((len(c.context) + len(n.context) - {_UNION}) / least(len(c.context), len(n.context)) >= 0.60 OR (c.strategy = 'AI' AND n.strategy = 'AI' AND {_UNION} <= 30 AND {_NEAR}))"
WIN02 = f"WITH RECURSIVE {_WINDOWS_SQL}, {_fold_sql('ws', _MERGES, True)}"


def win03_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(S.batches(_windows(spark, sf_dir), most=24))


WIN03 = f"WITH RECURSIVE {_WINDOWS_SQL}, ai AS (SELECT * FROM ws WHERE strategy = 'AI'), {_fold_sql('ai', f'({_UNION} <= 24 AND {_NEAR})', False)}"


def win04_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of twenty clauses, one to three of them in focus, cut to eight."""
    i = F.col("order_index")
    rows = said(spark, sf_dir).select(
        "meeting_id", F.floor(i / 20).alias("window_id"), i.cast("long").alias("order_index"), (i % 20 == 7).alias("focus"),
        F.element_at(F.array(*map(F.lit, ("CONTEXT", "NOISE", "LIKELY", "CONTEXT", "MANDATORY", "CONTEXT", "NOISE"))), (i * 5 % 7).cast("int") + 1).alias("relevance"), (i % 3 == 0).alias("on_topic"), (i % 11 == 0).alias("grounded"),
    )
    return S.compacted(rows, most=8)


WIN04 = f"""WITH {SAID_SQL}, c AS (SELECT meeting_id, order_index // 20 AS window_id, order_index, order_index % 20 = 7 AS focus, ['CONTEXT', 'NOISE', 'LIKELY', 'CONTEXT', 'MANDATORY', 'CONTEXT', 'NOISE'][order_index * 5 % 7 + 1] AS relevance,
    order_index % 3 = 0 AS on_topic, order_index % 11 = 0 AS grounded FROM said),
d AS (SELECT c.*, focus OR relevance = 'MANDATORY' AS needed, coalesce((SELECT min(abs(f.order_index - c.order_index)) FROM c f WHERE f.meeting_id = c.meeting_id AND f.window_id = c.window_id AND f.focus), 999) AS distance FROM c),
p AS (SELECT *, CAST(CASE relevance WHEN 'MANDATORY' THEN 100 WHEN 'LIKELY' THEN 60 WHEN 'CONTEXT' THEN 10 ELSE -100 END + CASE WHEN distance <= 2 THEN 35 ELSE greatest(0, 20 - distance * 2) END + CASE WHEN on_topic THEN 25 ELSE 0 END + CASE WHEN grounded THEN 20 ELSE 0 END AS BIGINT) AS priority,
    sum(CASE WHEN needed THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id, window_id) AS n_needed FROM d)
SELECT meeting_id, window_id, order_index, priority FROM p QUALIFY needed OR row_number() OVER (PARTITION BY meeting_id, window_id, needed ORDER BY priority DESC, order_index) <= 8 - n_needed"""


def seg11_bounded_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.bounded_context(said(spark, sf_dir), most=160)
    return rows.select("meeting_id", "clause_id", F.array_join(F.transform("context", lambda x: x.cast("string")), ",").alias("context"), F.col("focus_start").cast("long").alias("focus_start"))


SEG11 = f"""WITH {SAID_SQL}, a AS (SELECT f.meeting_id, f.clause_id, f.order_index AS i, c.order_index AS j, length(c.text_raw) AS size, sum(length(c.text_raw)) OVER (PARTITION BY f.meeting_id, f.clause_id ORDER BY abs(c.order_index - f.order_index), c.order_index) AS upto
  FROM said f JOIN said c ON c.meeting_id = f.meeting_id AND c.order_index BETWEEN f.order_index - 3 AND f.order_index + 5)
SELECT meeting_id, clause_id, coalesce(string_agg(j, ',' ORDER BY j) FILTER (upto <= 160), '') AS context, CAST(coalesce(sum(size + 1) FILTER (upto <= 160 AND j < i), 0) AS BIGINT) AS focus_start FROM a GROUP BY meeting_id, clause_id"""


def win08_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice", -4).alias("confidence"))
    return S.ranks(rows, "o_custkey", "o_orderkey", "confidence").select("o_orderkey", "source_rank", "confidence_rank")


WIN08 = """SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS source_rank,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, -4) DESC, o_orderkey) AS INTEGER) AS confidence_rank FROM orders"""


def _proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("case_id"), k.alias("proposal_id"), F.element_at(F.array(*map(F.lit, ("LATTICE", "NEURAL", "BOTH"))), (k % 3).cast("int") + 1).alias("source"), (k % 4 == 0).alias("supported"),
        F.when(k % 3 != 0, F.pmod(k * 13, F.lit(7)) / 10).otherwise(0.0).alias("neural"), (F.pmod(k * 11, F.lit(5)) / 10).alias("rule"), (k % 50).alias("order_index"), (k % 9).alias("start"), (k % 9 + k % 5).alias("end"),
    )


def win09_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pool(_proposals(spark, sf_dir), most=20).select("case_id", "proposal_id", "place")


WIN09 = """WITH p AS (SELECT user_id AS case_id, event_id AS k, event_id % 3 AS s FROM events)
SELECT case_id, k AS proposal_id, CAST(row_number() OVER w AS INTEGER) AS place FROM p
WINDOW w AS (PARTITION BY case_id ORDER BY CASE s WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE 2 END, k % 4 <> 0, CASE WHEN s <> 0 THEN k * 13 % 7 ELSE 0 END DESC, k * 11 % 5 DESC, k % 50, k % 9, k % 9 + k % 5, k) QUALIFY row_number() OVER w <= 20"""


def win14_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("proposal_id")
    reasons = F.element_at(F.array(*map(F.lit, ("SUGGESTION", "QUESTION", "PAST_COMPLETED", "PROGRESS_ONLY", "RECAP_ITEM", "", "", ""))), (k % 8).cast("int") + 1)
    rows = _proposals(spark, sf_dir).select(
        "case_id", "proposal_id", "order_index", F.array(reasons).alias("reasons"), F.element_at(F.array(*map(F.lit, ("UPDATE", "REFERENCE", "CREATE", "CREATE", "CREATE"))), (k % 5).cast("int") + 1).alias("kind"), (k % 31 == 0).alias("ambiguous"),
        (k % 3 != 0).alias("has_text"), (k % 2 == 0).alias("owned"), (k % 7 == 0).alias("dated"), (k % 6 == 0).alias("positive"),
    )
    return S.hard_negatives(rows).select("case_id", "proposal_id", "reason", "place")


WIN14 = f"""WITH p AS (SELECT user_id AS case_id, event_id AS k, CASE WHEN event_id % 31 = 0 THEN 'SIBLING_AMBIGUITY' WHEN event_id % 8 = 0 THEN 'SUGGESTION_ONLY' WHEN event_id % 8 = 1 THEN 'QUESTION_UNACCEPTED' WHEN event_id % 8 = 2 THEN 'PAST_COMPLETED'
    WHEN event_id % 8 = 3 THEN 'PROGRESS_ONLY' WHEN event_id % 8 = 4 THEN 'RECAP_DUPLICATE' WHEN event_id % 5 = 0 THEN 'MUTATION_ONLY' WHEN event_id % 5 = 1 THEN 'REFERENCE_ONLY' WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'OWNER_FRAGMENT'
    WHEN event_id % 3 = 0 AND event_id % 7 = 0 THEN 'DEADLINE_FRAGMENT' ELSE 'LEXICAL_NEAR' END AS reason FROM events WHERE event_id % 6 <> 0),
h(reason, hard) AS (VALUES {', '.join(f"('{r}', {n})" for r, n in S.HARDNESS)})
SELECT case_id, k AS proposal_id, reason, CAST(row_number() OVER w AS INTEGER) AS place FROM p JOIN h USING (reason) WINDOW w AS (PARTITION BY case_id ORDER BY hard, k % 50, k) QUALIFY row_number() OVER w <= 8"""

_THRESHOLDS, _BUDGETS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8), (1, 2, 3, 5, 8, 13, 21)


def win11_policy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("event_id") * 7919 % 1000 / 1000
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("item"), p.alias("p"), ((F.col("event_type") == "purchase") | (F.col("event_id") % 10 < F.floor(p * 5))).cast("int").alias("y"))
    found = S.policy_grid(rows, _THRESHOLDS, _BUDGETS)
    return found.select("threshold", "budget", "actual", "matched", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"), "best")


WIN11 = f"""WITH s AS (SELECT user_id AS case_id, event_id, event_id * 7919 % 1000 / 1000 AS p, CASE WHEN event_type = 'purchase' OR event_id % 10 < floor(event_id * 7919 % 1000 / 1000 * 5) THEN 1 ELSE 0 END AS y FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY p DESC, event_id) AS place FROM s), t AS (SELECT unnest({list(_THRESHOLDS)})::DOUBLE AS threshold), b AS (SELECT unnest({list(_BUDGETS)})::INTEGER AS budget),
g AS (SELECT threshold, budget, count(*) FILTER (place <= budget AND p >= threshold) AS actual, CAST(coalesce(sum(y) FILTER (place <= budget AND p >= threshold), 0) AS BIGINT) AS matched, sum(y) AS expected FROM r, t, b GROUP BY threshold, budget),
m AS (SELECT *, CASE WHEN actual = 0 THEN 0.0 ELSE matched / actual END AS precision, matched / expected AS recall FROM g), f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m)
SELECT threshold, budget, actual, matched, round(precision, 6)::DOUBLE AS precision, round(recall, 6) AS recall, round(f1, 6)::DOUBLE AS f1,
  row_number() OVER (ORDER BY precision >= 0.48 DESC, CASE WHEN precision >= 0.48 THEN f1 ELSE precision END DESC, recall DESC, threshold DESC, budget) = 1 AS best FROM f"""

QUERIES = {
    "win02_merged_windows": (win02_merged_windows, WIN02), "win03_batches": (win03_batches, WIN03), "win04_compacted": (win04_compacted, WIN04), "seg11_bounded_context": (seg11_bounded_context, SEG11),
    "win08_ranks": (win08_ranks, WIN08), "win09_pool": (win09_pool, WIN09), "win14_hard_negatives": (win14_hard_negatives, WIN14), "win11_policy_grid": (win11_policy_grid, WIN11),
}
