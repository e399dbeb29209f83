"""Date mentions in clauses, and the dates that they stand for."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType

# The parts of date expressions.
_DAY = "(?:thứ hai|thứ ba|thứ tư|thứ năm|thứ sáu|thứ bảy|chủ nhật|monday|tuesday|wednesday|thursday|friday|saturday|sunday)"
_DATE = "(?:\\d{4}-\\d{1,2}-\\d{1,2}|\\d{1,2}[/-]\\d{1,2}(?:[/-]\\d{4})?|(?:\\d{1,2}\\s+tháng\\s+\\d{1,2}(?:\\s+năm\\s+\\d{4})?))"
_NEAR = "(?:hôm nay|ngày mai|ngày kia|today|tomorrow|day after tomorrow)"
_WEEK = "(?:tuần này|tuần sau|tuần tới|this week|next week)"
_ANY = f"(?:ngày\\s+)?(?:{_DATE}|{_NEAR}|(?:next\\s+{_DAY})|{_DAY}(?:\\s+{_WEEK})?)"
_COUNT = "(\\d+|một|hai|ba|bốn|năm|one|two|three|four|five)"

# Relation, type and pattern of each kind of mention, the more specific first.
RULES: tuple[tuple[str, str, str], ...] = (
    ("AMBIGUOUS", "AMBIGUOUS", f"\\b{_DAY}\\s+(?:hoặc|hay|or)\\s+{_DAY}\\b"),
    ("AMBIGUOUS", "AMBIGUOUS", f"\\b(?:trong|during)\\s+{_WEEK}\\b"),
    ("ON_DATE", "ANCHOR", f"\\b{_DAY}\\s+{_DATE}\\b"),
    ("ON_DATE", "ANCHOR", f"\\bdeadline\\s+(?:là\\s+)?{_ANY}"),
    ("ON_DATE", "RELATIVE_DAY", "\\b(?:trong\\s+)?(?:sáng|trưa|chiều|tối)\\s+(?:nay|mai)\\b"),
    ("ON_DATE", "RELATIVE_DAY", "\\bcuối\\s+ngày\\s+(?:hôm\\s+nay|mai|today|tomorrow)\\b"),
    ("BEFORE_TIME", "ANCHOR", f"\\b(?:trước|before)\\s+(?:sáng|trưa|chiều|tối)\\s+{_ANY}"),
    ("BEFORE_TIME", "ANCHOR", f"\\b(?:trước|before)\\s+(?:\\d{{1,2}}(?::\\d{{2}})?\\s*(?:h|giờ|am|pm)|cuối ngày|end of day|eod)\\s+{_ANY}"),
    ("BEFORE_DAY", "ANCHOR", f"\\b(?:trước|before|prior to|không đến)\\s+{_ANY}"),
    ("ON_OR_BEFORE", "ANCHOR", f"\\b(?:chậm nhất|không muộn hơn|no later than|by)\\s+{_ANY}"),
    ("ON_DATE", "ANCHOR", f"\\b(?:từ|from)\\s+{_ANY}"),
    ("ON_DATE", "ANCHOR", f"\\b(?:vào|đến|on|due on)\\s+{_ANY}"),
    ("ON_DATE", "RELATIVE_DAY", f"\\b(?:trong\\s+)?{_NEAR}\\b"),
    ("DURATION", "WORKING_DAY_DURATION", f"\\b(?:trong vòng|cần|within|need)\\s+{_COUNT}\\s+(?:ngày làm việc|working days?)\\b"),
    ("DURATION", "CALENDAR_DURATION", f"\\b(?:trong vòng|cần|within|need)\\s+{_COUNT}\\s+(?:ngày(?: lịch)?|calendar days?)\\b"),
    ("AFTER_EVENT", "EVENT_DEPENDENT", "\\b(?:\\d+|một|hai|ba|bốn|năm|one|two|three|four|five)\\s+(?:ngày làm việc|working days?)\\s+(?:sau khi|after)\\s+[^,.;]+"),
    ("AFTER_EVENT", "EVENT_DEPENDENT", "\\b(?:sau khi|after)\\s+[^,.;]+(?:trong vòng\\s+\\w+\\s+ngày|within\\s+\\w+\\s+days?)?"),
    ("ON_DATE", "ANCHOR", f"\\b(?:ngày\\s+)?{_DATE}\\b"),
)
NUMBERS = {"một": 1, "hai": 2, "ba": 3, "bốn": 4, "năm": 5, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5}
WEEKDAYS = {
    "MONDAY": ("thứ hai", "monday"), "TUESDAY": ("thứ ba", "tuesday"), "WEDNESDAY": ("thứ tư", "wednesday"), "THURSDAY": ("thứ năm", "thursday"),
    "FRIDAY": ("thứ sáu", "friday"), "SATURDAY": ("thứ bảy", "saturday"), "SUNDAY": ("chủ nhật", "sunday"),
}

SPANS = "array<struct<relation:string,date_type:string,start:int,end:int,count:string>>"


def spans_of(text: str) -> list[tuple[str, str, int, int, str | None]]:
    """Mentions by rule, none overlapping one of an earlier rule."""
    found: list[tuple[str, str, int, int, str | None]] = []
    for relation, kind, pattern in RULES:
        for m in re.finditer(pattern, text, re.I):
            if all(m.end() <= a or m.start() >= b for _, _, a, b, _ in found):
                found.append((relation, kind, m.start(), m.end(), m.group(1) if "DURATION" in kind else None))
    return found


def _spans(text: Column) -> Column:
    names = ("relation", "date_type", "start", "end", "count")

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in texts:
            yield values.map(lambda x: [dict(zip(names, s, strict=True)) for s in spans_of(x or "")])

    return F.pandas_udf(run, SPANS, PandasUDFType.SCALAR_ITER)(text)


def mentions(clauses: DataFrame) -> DataFrame:
    """A row per mention: clauses without a digit or a date word never leave the JVM."""
    words = "|".join(["\\d", "ngày", "hôm", "mai", "nay", "tuần", "week", "today", "tomorrow", "sau khi", "after", *(w for x in WEEKDAYS.values() for w in x)])
    likely = clauses.where(F.col("text_normalized").rlike(f"(?iU){words}"))
    rows = likely.withColumn("span", F.explode(_spans(F.col("text_normalized"))))
    raw = F.trim(F.substring(F.col("text_raw"), F.col("span.start") + 1, F.col("span.end") - F.col("span.start")))
    return anchored(rows.select("meeting_id", "clause_id", "order_index", raw.alias("raw_text"), "span.relation", "span.date_type", F.col("span.start").alias("span_start"), F.col("span.end").alias("span_end"), "span.count"))


def anchored(rows: DataFrame) -> DataFrame:
    """Fills day, month, year, offset, weekday and duration of mentions (raw_text, relation, date_type, count)."""
    low = F.lower("raw_text")
    iso, full, short = "\\b(\\d{4})-(\\d{1,2})-(\\d{1,2})\\b", "\\b(\\d{1,2})[/-](\\d{1,2})[/-](\\d{4})\\b", "\\b(\\d{1,2})[/-](\\d{1,2})(?![/-]\\d)\\b"
    words = "(?U)\\b(\\d{1,2})\\s+tháng\\s+(\\d{1,2})(?:\\s+năm\\s+(\\d{4}))?\\b"
    open_kind = F.col("date_type").isin("ANCHOR", "RELATIVE_DAY")
    group = lambda p, i: F.nullif(F.regexp_extract(low, p, i), F.lit("")).cast("int")

    def pick(i_iso: int, i_full: int, i_words: int, i_short: int | None) -> Column:
        out = F.when(low.rlike(iso), group(iso, i_iso)).when(low.rlike(full), group(full, i_full)).when(low.rlike(words), group(words, i_words))
        return F.when(open_kind, out if i_short is None else out.when(low.rlike(short), group(short, i_short)))

    out = rows.withColumn("explicit_day", pick(3, 1, 1, 1)).withColumn("explicit_month", pick(2, 2, 2, 2)).withColumn("explicit_year", pick(1, 3, 3, None))
    dated = F.col("explicit_day").isNotNull()
    part = "(?:sáng|trưa|chiều|tối)"
    offset = (
        F.when(low.rlike("day after tomorrow|ngày kia"), 2)
        .when(low.rlike(f"tomorrow|ngày mai|(?U)\\b{part}\\s+mai\\b"), 1)
        .when(low.rlike(f"today|hôm nay|(?U)\\b{part}\\s+nay\\b"), 0)
    )
    out = out.withColumn("relative_day_offset", F.when(open_kind & ~dated, offset))
    weekday = None
    for name, spelled in WEEKDAYS.items():
        hit = low.rlike(f"(?U)\\b(?:{'|'.join(spelled)})\\b")
        weekday = F.when(hit, name) if weekday is None else weekday.when(hit, name)
    out = out.withColumn("target_weekday", F.when(open_kind & ~dated & F.col("relative_day_offset").isNull(), weekday))
    next_week = low.rlike(f"tuần sau|tuần tới|next week|next {_DAY}")
    out = out.withColumn("week_scope", F.when(F.col("target_weekday").isNotNull(), F.when(next_week, "NEXT_CALENDAR_WEEK").otherwise("NEXT_OCCURRENCE")))
    number = F.coalesce(*(F.when(F.lower("count") == k, v) for k, v in NUMBERS.items()), F.expr("try_cast(count as int)"))
    out = out.withColumn("duration_days", F.when(F.col("date_type").contains("DURATION"), number))
    kind = (
        F.when(F.col("explicit_year").isNotNull(), "ABSOLUTE_DATE").when(dated, "DAY_MONTH").when(F.col("relative_day_offset").isNotNull(), "RELATIVE_DAY")
        .when(F.col("week_scope") == "NEXT_CALENDAR_WEEK", "WEEKDAY_NEXT").when(F.col("week_scope").isNotNull(), "WEEKDAY").otherwise(F.col("date_type"))
    )
    return out.withColumn("date_type", kind).drop("count")


def resolved(meeting: Column, start: Column) -> Column:
    """The date of a mention's columns, null if it has none."""
    today = F.weekday(meeting)
    number = F.coalesce(*(F.when(F.col("target_weekday") == name, i) for i, name in enumerate(WEEKDAYS)))
    delta = F.pmod(number - today, F.lit(7))
    deadline = F.col("raw_text").rlike("(?iU)\\b(?:hạn(?:\\s+chót)?|deadline)\\b")
    later = (delta == 0) & ((F.col("relation") == "BEFORE_DAY") | ((F.col("week_scope") == "NEXT_OCCURRENCE") & deadline))
    weekday = F.when(F.col("week_scope") == "NEXT_CALENDAR_WEEK", F.date_add(meeting, (7 + number - today).cast("int"))).otherwise(
        F.date_add(meeting, (delta + F.when(later, 7).otherwise(0)).cast("int"))
    )

    def on(year: Column) -> Column:
        return F.try_to_date(F.format_string("%04d-%02d-%02d", year, F.col("explicit_month"), F.col("explicit_day")), "yyyy-MM-dd")

    this_year = on(F.coalesce("explicit_year", F.year(meeting)))
    absolute = F.when(F.col("explicit_year").isNull() & (this_year < meeting), on(F.year(meeting) + 1)).otherwise(this_year)
    anchor = (
        F.when(F.col("relative_day_offset").isNotNull(), F.date_add(meeting, F.col("relative_day_offset")))
        .when(F.col("target_weekday").isNotNull(), weekday)
        .when(F.col("explicit_day").isNotNull() & F.col("explicit_month").isNotNull(), absolute)
    )
    return (
        F.when(F.col("date_type").isin("EVENT_DEPENDENT", "WORKING_DAY_DURATION", "AMBIGUOUS", "NONE"), None)
        .when(F.col("date_type") == "CALENDAR_DURATION", F.date_add(start, F.col("duration_days")))
        .when(F.col("relation") == "BEFORE_DAY", F.date_sub(anchor, 1))
        .otherwise(anchor)
    )


def after_working_days(day: Column, n: Column) -> Column:
    """The n-th weekday after day (Monday to Friday), in closed form: from a weekend it counts from Friday."""
    place = F.least(F.weekday(day), F.lit(4))
    friday_or_day = F.date_sub(day, F.weekday(day) - place)
    return F.date_add(friday_or_day, (n + 2 * F.floor((place + n) / 5)).cast("int"))
