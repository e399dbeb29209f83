"""Meeting notes: rows by kind with their hints, claims, and what they mean for clauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import keywords, match_form

# What begins a row, and what its words say.
PREFIX = "^\\s*(?:[-*•]+|\\[[ xX]\\]|\\d+[.)]|(?:todo|action|ai|follow[- ]?up)\\s*[:：])\\s*"
QUESTION = "\\?|\\b(?:chua chot|pending|hoi lai|question)\\b"
CANCEL = "\\b(?:bo|huy|drop|cancel)\\b"
STATE = "\\b(?:chuyen|handoff|nhan thay|doi|deadline|dl|ddl|due|eta|han)\\b"
LABEL = "\\btask\\s*[- ]?([a-z0-9]+)\\b"
DEADLINE = "\\b(?:dl|ddl|due|deadline|eta|han)\\s*[:=-]?\\s*([^,;]+)"
OWNERS = ("@([\\wÀ-ỹ'-]+)", "->\\s*([\\wÀ-ỹ'-]+)", "\\(([\\wÀ-ỹ'-]+)\\)", "^\\s*([\\wÀ-ỹ'-]+)\\s*:")
TOPIC = "^(?:chủ\\s*đề|chu\\s*de|topic|agenda|scope)\\s*[:：=-]\\s*(.+)$"
KEYWORDS = "^(?:kw|keywords?|từ\\s*khóa|tu\\s*khoa)\\s*[:：=-]\\s*(.+)$"
HEADER = "\\b(?:note|notes|meeting|agenda|recap)\\b"


def note_rows(notes: DataFrame) -> DataFrame:
    """meeting_id, line_no and each row of a note (meeting_id, content) with kind, confidence, owners, labels, deadlines, operations."""
    lines = F.filter(F.transform(F.split("content", "\\r?\\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = notes.select("meeting_id", F.posexplode(lines).alias("line_no", "raw"))
    rows = rows.withColumn("text", F.trim(F.regexp_replace("raw", f"(?iU){PREFIX}", ""))).withColumn("normal", match_form(F.col("text"))).withColumn("keywords", keywords(F.col("text")))
    text, normal = F.col("text"), F.col("normal")
    every = lambda p: F.regexp_extract_all(text, F.lit(f"(?iU){p}"), F.lit(1))
    rows = rows.withColumn("labels", F.transform(every(LABEL), lambda x: F.concat(F.lit("Task "), F.upper(x)))).withColumn("deadlines", F.transform(every(DEADLINE), lambda x: F.trim(x)))
    rows = rows.withColumn("owners", F.array_distinct(F.concat(*(every(p) for p in OWNERS))))
    is_ = lambda c, p: c.rlike(f"(?iU){p}")
    hints = (F.size("labels") > 0) | (F.size("owners") > 0) | (F.size("deadlines") > 0) | (F.size("keywords") >= 2)
    kind = (
        F.when(text == "", "NOISE/1.0").when(is_(text, TOPIC), "TOPIC/0.9").when(is_(text, KEYWORDS), "TOPIC/0.45").when((F.size("keywords") <= 2) & is_(normal, HEADER), "HEADER/0.9")
        .when(is_(text, QUESTION) | is_(normal, QUESTION), "QUESTION/0.95").when(is_(normal, CANCEL) | is_(normal, STATE), "STATE_HINT/0.8").when(hints, "ACTION_HINT/0.65").otherwise("TOPIC/0.45")
    )
    rows = rows.withColumn("kind", F.split_part(kind, F.lit("/"), F.lit(1))).withColumn("confidence", F.split_part(kind, F.lit("/"), F.lit(2)).cast("double"))
    return rows.withColumn("operations", F.array_compact(F.array(F.when(is_(normal, CANCEL), "CANCEL"), F.when(is_(normal, STATE), "STATE"))))


def claims(rows: DataFrame, source: str = "SECRETARY") -> DataFrame:
    """Rows that say an action or a state, with ids that stay the same when a note is read again."""
    own = rows.where(F.col("kind").isin("ACTION_HINT", "STATE_HINT"))
    key = F.concat_ws("\u001f", F.col("meeting_id").cast("string"), F.col("line_no").cast("string"), "normal")
    return own.select(
        "meeting_id", F.concat(F.lit("NCLAIM-"), F.substring(F.sha2(key, 256), 1, 16)).alias("claim_id"), "line_no", "text", F.coalesce(F.get("labels", 0), "text").alias("action_hint"), F.get("owners", 0).alias("owner_hint"),
        F.get("deadlines", 0).alias("date_hint"), F.get("operations", 0).alias("operation_hint"), F.lit(source).alias("source"),
    )


def authority(level: Column, source: Column) -> tuple[Column, Column]:
    """The signal of a claim by how far the transcript bears it out, and whether a model may propose from it."""
    signal = F.when(level == "CONTRADICTED", "NEGATIVE").when(level == "FULL_GROUNDED", "STRONG").when(level == "PARTIAL_GROUNDED", "MEDIUM").when(source == "AUTO_OVERVIEW", "CONTEXT_ONLY").otherwise("WEAK")
    return signal, signal.isin("STRONG", "MEDIUM", "WEAK")


def cues(rows: DataFrame, grounded: DataFrame) -> DataFrame:
    """Hints by clause, the best grounded first. grounded: meeting_id, line_no, clause_id, status, score."""
    usable = rows.where(F.col("kind").isin("ACTION_HINT", "STATE_HINT"))
    found = grounded.where(F.col("status").isin("GROUNDED", "AMBIGUOUS")).join(usable.select("meeting_id", "line_no", "kind", "labels", "owners", "deadlines"), ["meeting_id", "line_no"])
    place = F.row_number().over(W.partitionBy("meeting_id", "clause_id").orderBy(F.col("score").desc(), "line_no"))
    return found.withColumn("place", place)


def enriched(annotated: DataFrame, cue_rows: DataFrame) -> DataFrame:
    """annotated clauses with the flags that notes add."""
    suffix = F.when(F.col("kind") == "ACTION_HINT", "ACTION").otherwise("STATE")
    more = F.array_compact(F.array(
        F.concat(F.lit("NOTE_"), "status", F.lit("_"), suffix), F.when(F.size("labels") > 0, "NOTE_TASK_LABEL_HINT"), F.when(F.size("owners") > 0, "NOTE_OWNER_HINT"), F.when(F.size("deadlines") > 0, "NOTE_DEADLINE_HINT"),
    ))
    added = cue_rows.groupBy("meeting_id", "clause_id").agg(F.array_distinct(F.flatten(F.collect_list(more))).alias("more"))
    out = annotated.join(added, ["meeting_id", "clause_id"], "left")
    return out.withColumn("flags", F.array_sort(F.array_union("flags", F.coalesce("more", F.array().cast("array<string>"))))).drop("more")
