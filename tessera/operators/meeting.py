"""From a meeting's captions to its tasks as they are handed out: all steps of the library in one plan.

Clauses, their date mentions and cue flags yield rule events, the recap yields events of its rows; these, without duplicates, are
folded into the ledger; visible tasks get their dates, the best wording of their deadline, and their evidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import cues, dates, extraction, final, ledger, linking, recap_rows, segments
from tessera.operators.temporal import purpose
from tessera.sources.corpus import stored

RESULT = ("meeting_id", "task_id", "task_name", "assignee", "start_date", "due_date", "due_text", "status", "evidence")


def date_mentions(clauses: DataFrame) -> DataFrame:
    """Mentions of dates with their id and purpose."""
    found = dates.mentions(clauses).join(clauses.select("meeting_id", "clause_id", "text_raw"), ["meeting_id", "clause_id"])
    ident = F.concat_ws("-", F.lit("DATE"), "clause_id", "span_start")
    return found.withColumn("mention_id", ident).withColumn("purpose", purpose(F.col("text_raw"), F.col("span_start"), F.col("span_end"))).drop("text_raw")


def events(clauses: DataFrame, mentions: DataFrame) -> DataFrame:
    """Rule and recap events of clauses (meeting_id, clause_id, order_index, speaker_name, text_raw, text_normalized), without
    duplicates, in the form of the ledger."""
    due = mentions.where("purpose = 'DEADLINE'")
    last = due.groupBy("meeting_id", "clause_id").agg(F.max_by("mention_id", "span_start").alias("deadline_mention_id"))
    has = mentions.select("meeting_id", "clause_id").distinct().withColumn("dated", F.lit(True))
    rows = clauses.join(has, ["meeting_id", "clause_id"], "left").join(last, ["meeting_id", "clause_id"], "left")
    ruled = stored(extraction.events(stored(cues.annotated(rows, F.coalesce("dated", F.lit(False))), "annotated")), "rule-events")
    said = recap_rows.segment_deadlines(stored(recap_rows.events(clauses.select("meeting_id", "clause_id", "order_index", "speaker_name", "text_raw")), "recap-events"))
    by_text = due.groupBy("meeting_id", "clause_id", F.col("raw_text").alias("deadline_text")).agg(F.max_by("mention_id", "span_start").alias("deadline_mention_id"))
    said = said.join(by_text, ["meeting_id", "clause_id", "deadline_text"], "left")
    cancels = F.col("event_type") == "TASK_CANCEL"
    said = said.select(
        "meeting_id", "clause_id", "order_index", "event_type", F.when(cancels, "").otherwise(F.col("action_text")).alias("action_text"), "assignee", F.when(cancels, F.col("action_text")).otherwise("").alias("related_task_hint"),
        F.coalesce("deadline_mention_id", F.lit("")).alias("deadline_mention_id"), F.lit(0.99).alias("confidence"), "extraction_source", F.col("place").alias("place"),
    )
    both = ruled.withColumn("place", F.lit(-1)).unionByName(said)
    ident = F.format_string("EVENT-%06d-%04d-%s", F.col("order_index").cast("long"), (F.col("place") + 1).cast("long"), "clause_id")
    ready = both.select(
        "meeting_id", ident.alias("event_id"), "event_type", F.lit("").alias("related_task_id"), "related_task_hint", "action_text", "assignee", "deadline_mention_id", "extraction_source", "confidence",
        F.array("clause_id").alias("source_clause_ids"), F.col("clause_id").alias("anchor_clause_id"), F.col("order_index").cast("long").alias("order_index"),
    )
    return ledger.deduplicated(ready)


def results(clauses: DataFrame, meeting_date: str) -> DataFrame:
    """The visible tasks of each meeting (RESULT). clauses: those of `segments.preprocessed`."""
    day = F.lit(meeting_date).cast("date")
    clauses = stored(clauses, "clauses")
    mentions = stored(date_mentions(clauses), "mentions")
    tasks = stored(ledger.visible(linking.folded(stored(events(clauses, mentions), "events"))), "tasks")
    own = tasks.select("meeting_id", "task_id", "task_name", "assignee", "deadline_mention_id", F.col("deadline_history").alias("history"), F.col("clauses").alias("source_clause_ids"))
    started = own.join(final.start_dates(own, mentions, day), ["meeting_id", "task_id"])
    due = final.deadline_texts(started, mentions, day)
    dated = final.handed_over(started.join(due, ["meeting_id", "task_id"], "left"))
    lines = own.select("meeting_id", "task_id", F.explode("source_clause_ids").alias("clause_id")).join(clauses.select("meeting_id", "clause_id", "order_index", F.concat_ws(": ", "speaker_name", "text_raw").alias("line")), ["meeting_id", "clause_id"])
    evidence = lines.groupBy("meeting_id", "task_id").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "line"))), lambda x: x["line"])), "\n").alias("evidence"))
    out = dated.join(evidence, ["meeting_id", "task_id"], "left")
    return out.select(
        "meeting_id", "task_id", "task_name", "assignee", F.col("start_date").cast("string").alias("start_date"), F.coalesce(F.col("due_date").cast("string"), F.lit("")).alias("due_date"), F.coalesce("due_text", F.lit("")).alias("due_text"),
        F.lit("Proposed").alias("status"), F.coalesce("evidence", F.lit("")).alias("evidence"),
    )


def from_captions(captions: DataFrame, meeting_date: str) -> DataFrame:
    """`results` of captions as the sources read them."""
    return results(segments.preprocessed(captions), meeting_date)
