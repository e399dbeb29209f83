"""Tasks as they are handed out: start and due dates, the best wording of a deadline, handovers, evidence and the summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import let, match_form
from tessera.operators.dates import resolved

# A shift's end and beginning in a task's name, words that label a deadline, titles that are only ids.
_DAY = "(?:thứ\\s+[\\wÀ-ỹ]+|monday|tuesday|wednesday|thursday|friday|saturday|sunday)"
FROM_DAY = f"\\s+(?:từ|from)\\s+{_DAY}\\s*$"
UNTIL_DAY = f"\\s+(?:đến(?:\\s+hết)?|until|through)\\s+{_DAY}\\s*$"
LABELLED = "\\b(?:deadline|hạn(?:\\s+chót)?|chậm\\s+nhất|trước|before|by)\\b"
TECHNICAL = "^(?:W\\d+-|upload-|(?:smoke|test|demo|sample|transcript|meeting)(?:[-_ ]?[A-Z0-9]+)*|[A-Z0-9]+(?:-[A-Z0-9]+){3,})"

STATE_KEY = ("relation", "date_type", "target_weekday", "week_scope", "explicit_day", "explicit_month", "explicit_year", "duration_days", "relative_day_offset")
HIDDEN = ("PROVISIONAL", "CANCELLED", "REJECTED")


def start_dates(tasks: DataFrame, mentions: DataFrame, meeting: Column) -> DataFrame:
    """meeting_id, task_id, start_date and whether it is explicit: the day of the last mention of a start among a task's clauses
    (tasks: meeting_id, task_id, source_clause_ids; mentions: those of dates, with purpose, order_index and span_start) that
    stands for one, else the meeting's."""
    own = tasks.select("meeting_id", "task_id", F.explode("source_clause_ids").alias("clause_id"))
    starts = mentions.where("purpose = 'START_DATE'").withColumn("day", resolved(meeting, meeting)).where("day is not null").select("meeting_id", "clause_id", "day", "order_index", "span_start")
    found = own.join(starts, ["meeting_id", "clause_id"]).groupBy("meeting_id", "task_id").agg(F.max_by("day", F.struct("order_index", "span_start")).alias("day"))
    out = tasks.select("meeting_id", "task_id").join(found, ["meeting_id", "task_id"], "left")
    return out.select("meeting_id", "task_id", F.coalesce("day", meeting).alias("start_date"), F.col("day").isNotNull().alias("explicit_start"))


def deadline_texts(tasks: DataFrame, mentions: DataFrame, meeting: Column) -> DataFrame:
    """meeting_id, task_id, due_date and due_text. tasks: deadline_mention_id, history (all mentions it has had, in order) and
    start_date. Of mentions that mean the same, the text with a time of day, else with a label, else the longest counts."""
    m = mentions.select("meeting_id", "mention_id", "raw_text", *STATE_KEY)
    key = F.struct(*STATE_KEY)
    now = tasks.join(m.withColumnRenamed("mention_id", "deadline_mention_id"), ["meeting_id", "deadline_mention_id"])
    now = now.select("meeting_id", "task_id", "start_date", key.alias("now_key"), F.col("relation").alias("now_relation"), resolved(meeting, F.col("start_date")).alias("due_date"), "deadline_mention_id", "history")
    all_of = F.array_distinct(F.concat("history", F.array("deadline_mention_id")))
    each = now.select("*", F.posexplode(all_of).alias("nth", "mention_id")).join(m, ["meeting_id", "mention_id"])
    same = key.eqNullSafe(F.col("now_key")) | (
        F.col("due_date").isNotNull() & (resolved(meeting, F.col("start_date")) == F.col("due_date")) & ((F.col("relation") == F.col("now_relation")) | (F.col("relation") == "BEFORE_TIME"))
    )
    quality = F.struct((F.col("relation") == "BEFORE_TIME").cast("int"), F.col("raw_text").rlike(f"(?iU){LABELLED}").cast("int"), F.length(F.trim("raw_text")), (-F.col("nth")).alias("earlier"))
    best = each.where(F.coalesce(same, F.lit(False))).groupBy("meeting_id", "task_id").agg(F.max_by("raw_text", quality).alias("due_text"), F.first("due_date").alias("due_date"))
    return best.select("meeting_id", "task_id", "due_date", "due_text")


def shift_of(name: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(name, f"(?iU){FROM_DAY}", ""), f"(?iU){UNTIL_DAY}", "")
    return match_form(bare)


def handed_over(tasks: DataFrame) -> DataFrame:
    """tasks (meeting_id, task_name, start_date, due_date) of which a shift from some day on starts the day after the last one of
    the same name that ends on a day."""
    base = tasks.withColumn("shift", shift_of(F.col("task_name")))
    ends = base.where(F.col("task_name").rlike(f"(?iU){UNTIL_DAY}") & F.col("due_date").isNotNull()).groupBy("meeting_id", "shift").agg(F.max("due_date").alias("ended"))
    out = base.join(ends, ["meeting_id", "shift"], "left")
    takes = F.col("task_name").rlike(f"(?iU){FROM_DAY}") & F.col("ended").isNotNull()
    return out.withColumn("start_date", F.when(takes, F.date_add("ended", 1)).otherwise(F.col("start_date"))).select(*tasks.columns)


def small(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def summary(title: Column, tasks: Column, cancelled: Column, has_note: Column) -> Column:
    """The summary of a meeting: its topic, and its tasks (array of task_name, assignee, due_text) in a sentence."""
    actions = F.transform(F.filter(tasks, lambda t: F.trim(t["task_name"]) != ""), lambda t: small(F.trim(t["task_name"])))
    fallback = (
        F.when(F.size(actions) == 0, "").when(F.size(actions) == 1, F.get(actions, 0)).when(F.size(actions) == 2, F.concat_ws(" và ", F.get(actions, 0), F.get(actions, 1)))
        .otherwise(F.concat(F.get(actions, 0), F.lit(", "), F.get(actions, 1), F.lit(" và các đầu việc liên quan")))
    )
    own = F.regexp_replace(F.trim(title), "^[ .]+|[ .]+$", "")
    topic = F.when((own == "") | own.rlike(f"(?i){TECHNICAL}"), fallback).otherwise(own)

    def sentence(t: Column) -> Column:
        keeps = t.rlike("^[A-Z]{2,}\\b") | t.rlike("^[A-Z][A-Za-z]*(?:\\s+[A-Z][A-Za-z]*)+$")
        return (
            F.when(t == "", "").when(F.lower(t).startswith("rà soát "), F.concat(F.lit("Cuộc họp rà soát "), F.substr(t, F.lit(9)), F.lit(".")))
            .otherwise(F.concat(F.lit("Cuộc họp tập trung vào "), F.when(keeps, t).otherwise(small(t)), F.lit(".")))
        )

    due = lambda t: F.when((t["due_text"] != "") & ~F.contains(F.lower(t["task_name"]), F.lower(t["due_text"])), F.concat(F.lit(" ("), t["due_text"], F.lit(")"))).otherwise("")
    who = lambda t: F.when(t["assignee"] != "", F.concat(t["assignee"], F.lit(" sẽ "))).otherwise("Cần phân công người thực hiện ")
    parts = F.transform(tasks, lambda t: F.concat(who(t), small(t["task_name"]), due(t)))
    decided = F.concat(F.size(tasks).cast("string"), F.lit(" công việc được chốt: "), F.array_join(parts, "; "), F.lit("."))
    none = F.when(cancelled, "Các task cũ được đề cập đã bị hủy; không có task active mới.").otherwise("Chưa chốt công việc mới.")
    note = F.when(has_note, "").otherwise(" Không có Meeting Note; kết quả được trích xuất từ transcript.")
    return F.concat(F.trim(F.concat_ws(" ", let(topic, sentence), F.when(F.size(tasks) == 0, none).otherwise(decided))), note)
