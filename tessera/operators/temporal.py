"""Temporal expressions: what a date's words mean, the day they stand for, and what a mention of a date is for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import hash_id, let
from tessera.operators.dates import NUMBERS, WEEKDAYS, after_working_days

# Weekdays and numbers in words, the longer first.
_DAYS = "|".join(sorted((w for spelled in WEEKDAYS.values() for w in spelled), key=lambda w: (-len(w), w)))
_COUNT = "\\d+|một|hai|ba|bốn|năm|one|two|three|four|five"
_UNIT = "ngày làm việc|working days?|ngày(?: lịch)?|calendar days?"

# The grammar, in the order in which it is tried.
RANGE = f"\\b(?:từ|from)\\s+({_DAYS})\\s+(?:đến|to|through|until)\\s+({_DAYS})\\b"
ISO = "\\b(\\d{4})-(\\d{1,2})-(\\d{1,2})\\b"
FULL = "\\b(\\d{1,2})[/-](\\d{1,2})[/-](\\d{4})\\b"
WORDED = "\\b(\\d{1,2})\\s+tháng\\s+(\\d{1,2})(?:\\s+năm\\s+(\\d{4}))?\\b"
SHORT = "\\b(\\d{1,2})[/-](\\d{1,2})(?![/-]\\d)\\b"
NEAR = (("\\b(?:ngày kia|day after tomorrow)\\b", 2), ("\\b(?:ngày mai|tomorrow)\\b", 1), ("\\b(?:hôm nay|today)\\b", 0))
AFTER_EVENT = f"\\b({_COUNT})\\s+({_UNIT})\\s+(?:sau khi|after)\\s+([^,.;]+)"
AFTER_MEETING = f"\\b(?:trong vòng|cần|within|need)\\s+({_COUNT})\\s+({_UNIT})\\b"
WEEKDAY = f"\\b({_DAYS})\\b"
RELATIONS = (
    ("BEFORE", "\\b(?:trước|before|prior to)\\b"), ("AFTER", "\\b(?:sau khi|after)\\b"), ("WITHIN", "\\b(?:trong vòng|within|cần)\\b"), ("FROM", "\\b(?:từ|from)\\b"),
)
MEETING, NEXT_WEEK = "MEETING_DATE", "MEETING_DATE_NEXT_WEEK"

# How a text gives the date of its meeting, and cues of starts and deadlines.
_FULL_DATE = "(?:\\d{4}-\\d{1,2}-\\d{1,2}|\\d{1,2}[/-]\\d{1,2}[/-]\\d{4}|\\d{1,2}\\s+tháng\\s+\\d{1,2}\\s+năm\\s+\\d{4})"
CONTEXT = (
    f"\\b(?:hôm\\s+nay|today)\\s+(?:là|is)\\s+(?:ngày\\s+)?{_FULL_DATE}\\b",
    f"\\b(?:ngày\\s+họp|meeting\\s+date)\\s*(?:là|is|:|-)?\\s*(?:ngày\\s+)?{_FULL_DATE}\\b",
    f"\\b(?:cuộc\\s+họp|meeting)\\s+(?:hôm\\s+nay\\s+)?(?:diễn\\s+ra\\s+)?(?:vào|on)?\\s*(?:ngày\\s+)?{_FULL_DATE}\\b",
)
START_CUE = "\\b(?:bắt\\s+đầu|khởi\\s+động|start(?:s|ed|ing)?|commence(?:s|d)?)\\b"
START_MENTION, START_BEFORE = "^\\s*(?:từ|from)\\b", "\\b(?:từ|from)\\s*$"
DEADLINE_CUE = "\\b(?:trước|before|deadline|hạn(?:\\s+chót)?|chậm\\s+nhất|by|đến|due)\\b"


def match_spans(text: Column, pattern: str) -> Column:
    """start and end (from 0, past it) of every match of a pattern, left to right."""
    p = f"(?iU){pattern}"
    between, found = F.split(text, p, -1), F.regexp_extract_all(text, F.lit(p), F.lit(0))
    pairs = F.zip_with(between, found, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("size")))
    step = lambda s, x: F.struct((s["at"] + x["gap"] + x["size"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["size"]).alias("end")))).alias("out"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return F.aggregate(F.filter(pairs, lambda x: x["size"].isNotNull()), none, step)["out"]


def purpose(text: Column, start: Column, end: Column) -> Column:
    """MEETING_DATE, DEADLINE or START_DATE: what the mention text[start:end] is for."""
    meeting = F.lit(False)
    for pattern in CONTEXT:
        meeting = meeting | F.exists(match_spans(text, pattern), lambda s: (start < s["end"]) & (end > s["start"]))
    mention = F.substr(text, start + 1, end - start)
    prefix = F.substr(text, F.greatest(F.lit(1), start - 119), F.least(start, F.lit(120)))
    cued = lambda x: x.rlike(f"(?iU){START_CUE}") & ~F.regexp_replace(x, f"(?siU)^.*(?:{START_CUE})", "").rlike(f"(?iU){DEADLINE_CUE}")
    return (
        F.when(meeting, "MEETING_DATE").when(mention.rlike(f"(?iU){DEADLINE_CUE}"), "DEADLINE").when(mention.rlike(f"(?iU){START_MENTION}"), "START_DATE")
        .when(let(prefix, cued) | prefix.rlike(f"(?iU){START_BEFORE}"), "START_DATE").otherwise("DEADLINE")
    )


def _number(word: Column) -> Column:
    return F.coalesce(*(F.when(word == k, v) for k, v in NUMBERS.items()), F.expr("try_cast(null as int)"), word.try_cast("int"))


def parsed(rows: DataFrame, text: str) -> DataFrame:
    """rows with expression_id, type, relation, target_date (years may be missing: --MM-DD), weekday, amount, unit, anchor."""
    own = F.lower(F.trim(F.col(text)))
    out = rows.withColumn("e", own)
    e = F.col("e")
    has = lambda p: e.rlike(f"(?iU){p}")
    g = lambda p, i: F.regexp_extract(e, f"(?iU){p}", i)
    kind = F.when(has(RANGE), "RANGE").when(has(ISO), "ISO").when(has(FULL), "FULL").when(has(WORDED), "WORDED").when(has(SHORT), "SHORT")
    for pattern, days in NEAR:
        kind = kind.when(has(pattern), f"NEAR{days}")
    kind = kind.when(has(AFTER_EVENT), "EVENT").when(has(AFTER_MEETING), "MEETING").when(has(WEEKDAY), "WEEKDAY").otherwise("UNKNOWN")
    out = out.withColumn("k", kind)
    k = F.col("k")
    pad = lambda p, i, n: F.lpad(g(p, i), n, "0")
    date = (
        F.when(k == "ISO", F.concat_ws("-", pad(ISO, 1, 4), pad(ISO, 2, 2), pad(ISO, 3, 2))).when(k == "FULL", F.concat_ws("-", pad(FULL, 3, 4), pad(FULL, 2, 2), pad(FULL, 1, 2)))
        .when((k == "WORDED") & (g(WORDED, 3) != ""), F.concat_ws("-", pad(WORDED, 3, 4), pad(WORDED, 2, 2), pad(WORDED, 1, 2)))
        .when(k == "WORDED", F.concat(F.lit("--"), pad(WORDED, 2, 2), F.lit("-"), pad(WORDED, 1, 2))).when(k == "SHORT", F.concat(F.lit("--"), pad(SHORT, 2, 2), F.lit("-"), pad(SHORT, 1, 2)))
    )
    named = F.when(k == "RANGE", g(RANGE, 1)).when(k == "WEEKDAY", g(WEEKDAY, 1))
    weekday = F.coalesce(*(F.when(named.isin(*spelled), i) for i, spelled in enumerate(WEEKDAYS.values())))
    amount = F.when(k == "EVENT", _number(g(AFTER_EVENT, 1))).when(k == "MEETING", _number(g(AFTER_MEETING, 1)))
    for _, days in NEAR:
        amount = amount.when(k == f"NEAR{days}", days)
    unit_words = F.when(k == "EVENT", g(AFTER_EVENT, 2)).when(k == "MEETING", g(AFTER_MEETING, 2))
    unit = F.when(F.contains(unit_words, F.lit("làm việc")) | F.contains(unit_words, F.lit("working")), "WORKING_DAY").when(amount.isNotNull(), "CALENDAR_DAY")
    later = F.contains(e, F.lit("tuần sau")) | F.contains(e, F.lit("tuần tới")) | F.contains(e, F.lit("next week"))
    anchor = F.when(k == "EVENT", F.trim(g(AFTER_EVENT, 3))).when(k == "WEEKDAY", F.when(later, NEXT_WEEK).otherwise(MEETING)).when(k.isin("MEETING", "NEAR0", "NEAR1", "NEAR2"), MEETING)
    relation = F.lit("ON")
    for name, pattern in reversed(RELATIONS):
        relation = F.when(has(pattern), name).otherwise(relation)
    relation = F.when(k == "RANGE", "FROM").when(k == "EVENT", "AFTER").when(k == "MEETING", "WITHIN").when(k == "UNKNOWN", F.lit(None)).otherwise(relation)
    type_ = (
        F.when(k == "RANGE", "DATE_RANGE").when(k.isin("ISO", "FULL", "WORDED", "SHORT"), "ABSOLUTE_DATE").when(k.startswith("NEAR"), "RELATIVE_DAY").when(k == "EVENT", "DURATION_AFTER_EVENT")
        .when(k == "MEETING", "DURATION_AFTER_MEETING").when(k == "WEEKDAY", "RELATIVE_WEEKDAY").otherwise("UNKNOWN")
    )
    out = out.select(
        *rows.columns, hash_id("TEMP-", e, 16).alias("expression_id"), type_.alias("type"), relation.alias("relation"), date.alias("target_date"), weekday.alias("weekday"), amount.alias("amount"), unit.alias("unit"),
        anchor.alias("anchor"),
    )
    return out


def anchored(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """rows with anchor_date: that of the event with exactly this id (upper and lower case alike), never of a similar one."""
    known = anchors.groupBy(F.lower("event_id").alias("anchor_key")).agg(F.min_by("event_date", "event_id").alias("anchor_date"))
    return rows.join(known, F.lower("anchor") == F.col("anchor_key"), "left").drop("anchor_key")


def resolved(meeting: Column) -> tuple[Column, Column]:
    """Status and day of parsed rows (with anchor_date)."""
    type_, target, before = F.col("type"), F.col("target_date"), F.coalesce(F.col("relation") == "BEFORE", F.lit(False))
    partial = target.startswith("--")
    this_year = F.try_to_date(F.concat(F.year(meeting).cast("string"), F.substr(target, F.lit(2))), "yyyy-MM-dd")
    next_year = F.try_to_date(F.concat((F.year(meeting) + 1).cast("string"), F.substr(target, F.lit(2))), "yyyy-MM-dd")
    absolute = F.when(partial, F.when(this_year < meeting, next_year).otherwise(this_year)).otherwise(F.try_to_date(target, "yyyy-MM-dd"))
    absolute = F.when(before, F.date_sub(absolute, 1)).otherwise(absolute)
    anchor = F.when(F.col("anchor") == MEETING, meeting).when(F.col("anchor") == NEXT_WEEK, F.date_add(meeting, 7)).otherwise(F.col("anchor_date"))
    back = F.pmod(F.weekday(anchor) - F.col("weekday"), F.lit(7))
    weekday = F.when(before, F.date_sub(anchor, F.when(back == 0, 7).otherwise(back))).otherwise(F.date_add(anchor, F.pmod(F.col("weekday") - F.weekday(anchor), F.lit(7))))
    working = F.when(F.col("amount") == 0, anchor).otherwise(after_working_days(anchor, F.col("amount")))
    shifted = F.when(F.col("unit") == "WORKING_DAY", working).otherwise(F.date_add(anchor, F.col("amount")))
    day = F.when(type_ == "ABSOLUTE_DATE", absolute).when(type_ == "RELATIVE_WEEKDAY", weekday).when(type_.isin("RELATIVE_DAY", "DURATION_AFTER_MEETING", "DURATION_AFTER_EVENT"), shifted)
    status = (
        F.when(type_ == "UNKNOWN", "UNKNOWN_EXPRESSION").when(type_ == "DATE_RANGE", "AMBIGUOUS_RANGE").when((type_ == "ABSOLUTE_DATE") & absolute.isNull(), "INVALID_DATE")
        .when((type_ != "ABSOLUTE_DATE") & anchor.isNull(), "UNRESOLVED_ANCHOR").otherwise("RESOLVED")
    )
    return status, F.when(status == "RESOLVED", day)


def mention_status(day: Column) -> Column:
    """Whether a mention has a day, and if not, why."""
    kind = F.col("date_type")
    return (
        F.when(day.isNotNull(), "RESOLVED").when(kind == "EVENT_DEPENDENT", "EVENT_DEPENDENT").when(kind == "AMBIGUOUS", "AMBIGUOUS").when(kind == "WORKING_DAY_DURATION", "UNSUPPORTED_WORKING_DAY")
        .when(kind.isin("ABSOLUTE_DATE", "DAY_MONTH"), "INVALID_DATE").otherwise("MISSING_ANCHOR")
    )


def meeting_date(requested: Column, context: Column, context_source: Column, today: Column) -> tuple[Column, Column]:
    """The date that counts and where it is from: the request, the transcript or note, or the day of processing."""
    given = F.nullif(requested, F.lit(""))
    found = F.nullif(context, F.lit(""))
    source = F.when(given.isNotNull(), "REQUEST").when(found.isNotNull(), context_source).otherwise("PROCESSING_DATE")
    return F.coalesce(given, found, today), source
