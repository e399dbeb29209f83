"""From task events to tasks: duplicates of events, the fold of a meeting's ledger, and what needs no fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import match_form
from tessera.operators import linking
from tessera.operators.linking import CREATE

# Rank of sources, states that aren't shown.
SOURCE_RANK = {
    "HUMAN": 5, "RULE_FINAL_RECAP": 5, "HUMAN_NOTE": 4, "RULE_RECAP": 3, "RULE_CONTEXT": 2, "RULE_NOTE_CUE": 2, "RULE_REFERENCE_ACTIVE": 2,
    "RULE_REFERENCE": 2, "RULE": 2, "AI": 1, "AI_CREATE_PROPOSAL": 1,
}
HIDDEN = ("PROVISIONAL", "CANCELLED", "REJECTED")


def rank_of(source: Column) -> Column:
    ranks = F.create_map(*(F.lit(x) for pair in SOURCE_RANK.items() for x in pair))
    return F.coalesce(F.try_element_at(ranks, source), F.lit(0))


def event_key() -> Column:
    """What makes two events the same, as a text."""
    anchor = F.coalesce(F.nullif("anchor_clause_id", F.lit("")), F.element_at("source_clause_ids", -1), F.col("event_id"))
    text = lambda *parts: F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    kind, target, owner, due = F.col("event_type"), F.col("related_task_id"), match_form(F.col("assignee")), F.col("deadline_mention_id")
    return (
        F.when(target != "", text(F.lit("TARGETED"), kind, target, anchor, owner, due))
        .when(kind.isin(*CREATE) & (F.col("extraction_source") == "RULE_FINAL_RECAP"), text(F.lit("FINAL_LIST"), F.col("event_id")))
        .when(kind.isin(*CREATE), text(F.lit("CREATE"), kind, match_form(F.col("action_text")), anchor))
        .when(kind == "TASK_REFERENCE", text(F.lit("REFERENCE"), match_form(F.col("action_text")), anchor))
        .otherwise(text(F.lit("UNTARGETED_MUTATION"), kind, anchor, match_form(F.col("action_text")), owner, due))
    )


def deduplicated(events: DataFrame) -> DataFrame:
    """One event per key: the best by source and confidence, the earlier of equals, with the evidence of all."""
    keyed = events.withColumn("key", event_key()).withColumn("rank", rank_of(F.col("extraction_source")))
    best = F.struct("rank", "confidence", (-F.col("order_index")).alias("earlier"), "event_id")
    evidence = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "event_id", "source_clause_ids"))), lambda x: x["source_clause_ids"])))
    names = [c for c in events.columns if c not in ("meeting_id", "source_clause_ids")]
    return keyed.groupBy("meeting_id", "key").agg(F.max_by(F.struct(*names), best).alias("e"), evidence.alias("source_clause_ids"), F.count("*").alias("n_merged")).select(
        "meeting_id", "e.*", "source_clause_ids", "n_merged"
    )


def folded(events: DataFrame) -> DataFrame:
    """Tasks of each meeting after all its events (see `linking`)."""
    return linking.folded(events)


def reduced(events: DataFrame) -> DataFrame:
    """The same for events whose target is known (bound_task_id): the last value of each field, with no state at all."""
    order = W.partitionBy("meeting_id", "bound_task_id").orderBy("order_index", "event_id")
    ended = F.max(F.when(F.col("event_type").isin("TASK_CANCEL", "TASK_REJECT"), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, -1))
    live = events.withColumn("ended", F.coalesce(ended, F.lit(0))).where("ended = 0")
    status = (
        F.when(F.col("event_type") == "TASK_CANCEL", "CANCELLED").when(F.col("event_type") == "TASK_REJECT", "REJECTED")
        .when(F.col("event_type") == "OWNER_REASSIGN", "REASSIGNED").when(F.col("event_type").isin(*CREATE), "CONFIRMED")
    )
    at = F.struct("order_index", "event_id")
    deadline = F.col("event_type").isin(*CREATE, "DEADLINE_SET", "DEADLINE_REPLACE") & (F.col("deadline_mention_id") != "")
    return live.withColumn("now", status).groupBy("meeting_id", F.col("bound_task_id").alias("task_id")).agg(
        F.max_by("now", F.when(F.col("now").isNotNull(), at)).alias("status"), F.coalesce(F.max_by("deadline_mention_id", F.when(deadline, at)), F.lit("")).alias("deadline_mention_id"),
        F.min("order_index").alias("first_index"), F.max("order_index").alias("last_index"), F.count("*").alias("n_events"),
    )


def visible(tasks: DataFrame) -> DataFrame:
    return tasks.where(~F.col("status").isin(*HIDDEN))
