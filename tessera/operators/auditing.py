"""Audit of expected tasks against their transcript: names, owners, dates, and due dates that their words don't mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import match_form, normalized, plain, words_of
from tessera.operators.dates import mentions, resolved

# Words that say nothing of a task, what can't be resolved from its words alone, and how much of a name must be said.
NO_ACTION = ("việc", "viec", "the", "a", "an", "to", "for", "and")
NOT_RESOLVED = "ngay lam viec|\\bthu \\w+\\s*-\\s*thu \\w+\\b|\\btu thu \\w+\\s+den thu \\w+\\b|\\bthu \\w+\\s+\\d{1,2}\\s*(?:h|gio)\\b"
SAID = 0.6


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(words_of(match_form(text)), lambda w: (F.length(w) > 1) & ~w.isin(*sorted({plain(x) for x in NO_ACTION}))))


def issues(tasks: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, task_no, level (ERROR, WARNING), field and issue of expected tasks. tasks: case_id, task_no, task_name, assignee, start_date,
    due_date, due_date_text (texts; nulls are empty); cases: case_id, meeting_date, transcript. A due text is resolved if
    it holds exactly one date and no working days, ranges or times of a weekday. A transcript's words are cut once per case."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    own = tasks.select("case_id", "task_no", *(text(c).alias(c) for c in ("task_name", "assignee", "start_date", "due_date", "due_date_text")))
    said = cases.select("case_id", F.col("meeting_date").cast("string").alias("meeting_date"), match_form(F.coalesce("transcript", F.lit(""))).alias("said"), _tokens(F.coalesce("transcript", F.lit(""))).alias("said_words"))
    rows = own.join(said, "case_id")
    day = lambda c: F.when(F.col(c).rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.try_to_date(F.col(c), "yyyy-MM-dd"))
    nth = F.row_number().over(W.partitionBy("case_id", match_form(F.col("task_name")), match_form(F.col("assignee"))).orderBy("task_no"))
    rows = rows.withColumn("nth", nth).withColumn("start", day("start_date")).withColumn("due", day("due_date")).withColumn("words", _tokens(F.col("task_name")))
    rows = rows.withColumn("begin", F.when(F.col("start_date") != "", F.col("start")).otherwise(F.col("meeting_date").cast("date")))

    key = F.concat_ws("/", "case_id", "task_no")
    likely = rows.where((F.col("due_date_text") != "") & ~match_form(F.col("due_date_text")).rlike(f"(?U){NOT_RESOLVED}"))
    likely = likely.select("case_id", "task_no", "begin", F.col("meeting_date").cast("date").alias("meeting"), key.alias("clause_id"), F.lit(0).alias("meeting_id"), F.lit(0).alias("order_index"), F.col("due_date_text").alias("text_raw"), normalized(F.col("due_date_text")).alias("text_normalized"))
    found = mentions(likely).join(likely.select("clause_id", "case_id", "task_no", "begin", "meeting"), "clause_id")
    found = found.withColumn("n", F.count("*").over(W.partitionBy("clause_id"))).where("n = 1").withColumn("meant", resolved(F.col("meeting"), F.col("begin"))).where("meant is not null")
    rows = rows.join(found.select("case_id", "task_no", F.col("meant").cast("string").alias("meant")), ["case_id", "task_no"], "left")

    missing = F.filter(F.transform(F.split("assignee", "[;,]"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.contains(F.col("said"), match_form(x)))
    share = F.size(F.array_intersect("words", "said_words")) / F.size("words")
    issue = lambda test, level, field, name: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(field).alias("field"), F.lit(name).alias("issue")))
    each = F.array_compact(F.array(
        issue(F.col("nth") > 1, "ERROR", "task", "duplicate_task_identity"), issue(F.col("task_name") == "", "ERROR", "task_name", "empty"), issue((F.size("words") > 0) & (share < SAID), "ERROR", "task_name", "low_transcript_token_overlap"),
        issue(F.size(missing) > 0, "ERROR", "assignee", "not_found_in_transcript"), issue((F.col("start_date") != "") & F.col("start").isNull(), "ERROR", "start_date", "invalid_iso_date"),
        issue((F.col("due_date") != "") & F.col("due").isNull(), "ERROR", "due_date", "invalid_iso_date"), issue(F.col("due") < F.col("start"), "ERROR", "due_date", "before_start_date"),
        issue((F.col("due_date_text") != "") & ~F.contains(F.col("said"), match_form(F.col("due_date_text"))), "WARNING", "due_date_text", "not_exactly_found_in_transcript"),
        issue(F.col("meant") != F.col("due_date"), "WARNING", "due_date", "does_not_match_due_date_text"),
    ))
    return rows.select("case_id", "task_no", F.explode(each).alias("x")).select("case_id", "task_no", "x.*")
