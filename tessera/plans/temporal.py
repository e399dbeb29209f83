"""Queries over temporal expressions: a fixed list of phrases, dealt over the events, each with its own meeting date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import dates
from tessera.operators import temporal as T
from tessera.plans.rendered import table
from tessera.plans.said import matches, re2, sql_text

PHRASES = (
    "by 2024-02-13", "trước 2024-05-01", "on 2024-02-30", "5/3/2024", "before 31/12/2024", "ngày 7 tháng 9", "20 tháng 11 năm 2024", "on 29/2", "15/6", "ngày kia", "trước ngày mai", "today", "tomorrow",
    "3 working days after Launch", "hai ngày làm việc sau khi unknown event", "5 calendar days after launch", "within 2 working days", "trong vòng ba ngày", "need 10 working days", "cần 4 ngày làm việc",
    "thứ sáu", "trước thứ hai", "before Friday", "next week Tuesday", "chủ nhật tuần sau", "từ thứ hai đến thứ sáu", "from Monday to Friday", "soon", "", "deadline thứ ba", "from Wednesday",
)
ANCHORS = (("launch", "2024-03-08"), ("Review", "2024-04-01"))


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("event_id") % len(PHRASES)).cast("int") + 1)
    return rows.select("event_id", phrase.alias("phrase"), F.to_date("ts").alias("meeting"))


PHRASES_SQL = f"p AS (SELECT event_id, [{', '.join(map(sql_text, PHRASES))}][event_id % {len(PHRASES)} + 1] AS phrase, CAST(ts AS DATE) AS meeting FROM events)"

_g = lambda p, i: f"regexp_extract(e, {sql_text('(?i)' + re2(p))}, {i})"
_h = lambda p: matches("e", p)
_SHORT = T.SHORT.replace("(?![/-]\\d)", "")  # no look-ahead here: longer dates are taken by the rules before
_numbers = " ".join(f"WHEN {sql_text(k)} THEN {v}" for k, v in dates.NUMBERS.items())
_days = " ".join(f"WHEN {sql_text(w)} THEN {i}" for i, spelled in enumerate(dates.WEEKDAYS.values()) for w in spelled)
_relations = " ".join(f"WHEN {_h(p)} THEN '{n}'" for n, p in T.RELATIONS)
PARSED_SQL = (
    PHRASES_SQL
    + f""", l AS (SELECT *, lower(trim(phrase)) AS e FROM p),
k AS (SELECT *, CASE WHEN {_h(T.RANGE)} THEN 'RANGE' WHEN {_h(T.ISO)} THEN 'ISO' WHEN {_h(T.FULL)} THEN 'FULL' WHEN {_h(T.WORDED)} THEN 'WORDED' WHEN {_h(_SHORT)} THEN 'SHORT'
    {' '.join(f"WHEN {_h(p)} THEN 'NEAR{d}'" for p, d in T.NEAR)} WHEN {_h(T.AFTER_EVENT)} THEN 'EVENT' WHEN {_h(T.AFTER_MEETING)} THEN 'MEETING' WHEN {_h(T.WEEKDAY)} THEN 'WEEKDAY' ELSE 'UNKNOWN' END AS k FROM l),
w AS (SELECT *, CASE k WHEN 'EVENT' THEN {_g(T.AFTER_EVENT, 1)} WHEN 'MEETING' THEN {_g(T.AFTER_MEETING, 1)} END AS number, CASE k WHEN 'EVENT' THEN {_g(T.AFTER_EVENT, 2)} WHEN 'MEETING' THEN {_g(T.AFTER_MEETING, 2)} END AS unit_words FROM k),
parsed AS (SELECT event_id, phrase, meeting, 'TEMP-' || substr(sha256(e), 1, 16) AS expression_id,
    CASE WHEN k = 'RANGE' THEN 'DATE_RANGE' WHEN k IN ('ISO', 'FULL', 'WORDED', 'SHORT') THEN 'ABSOLUTE_DATE' WHEN starts_with(k, 'NEAR') THEN 'RELATIVE_DAY' WHEN k = 'EVENT' THEN 'DURATION_AFTER_EVENT'
      WHEN k = 'MEETING' THEN 'DURATION_AFTER_MEETING' WHEN k = 'WEEKDAY' THEN 'RELATIVE_WEEKDAY' ELSE 'UNKNOWN' END AS type,
    CASE WHEN k = 'RANGE' THEN 'FROM' WHEN k = 'EVENT' THEN 'AFTER' WHEN k = 'MEETING' THEN 'WITHIN' WHEN k = 'UNKNOWN' THEN NULL ELSE CASE {_relations} ELSE 'ON' END END AS relation,
    CASE k WHEN 'ISO' THEN lpad({_g(T.ISO, 1)}, 4, '0') || '-' || lpad({_g(T.ISO, 2)}, 2, '0') || '-' || lpad({_g(T.ISO, 3)}, 2, '0') WHEN 'FULL' THEN lpad({_g(T.FULL, 3)}, 4, '0') || '-' || lpad({_g(T.FULL, 2)}, 2, '0') || '-' || lpad({_g(T.FULL, 1)}, 2, '0')
      WHEN 'WORDED' THEN CASE WHEN {_g(T.WORDED, 3)} <> '' THEN {_g(T.WORDED, 3)} ELSE '-' END || '-' || lpad({_g(T.WORDED, 2)}, 2, '0') || '-' || lpad({_g(T.WORDED, 1)}, 2, '0')
      WHEN 'SHORT' THEN '--' || lpad({_g(_SHORT, 2)}, 2, '0') || '-' || lpad({_g(_SHORT, 1)}, 2, '0') END AS target_date,
    CASE CASE k WHEN 'RANGE' THEN {_g(T.RANGE, 1)} WHEN 'WEEKDAY' THEN {_g(T.WEEKDAY, 1)} END {_days} END AS weekday,
    CASE WHEN starts_with(k, 'NEAR') THEN CAST(substr(k, 5) AS INTEGER) WHEN number IS NOT NULL THEN CASE number {_numbers} ELSE CAST(number AS INTEGER) END END AS amount,
    CASE WHEN contains(unit_words, 'làm việc') OR contains(unit_words, 'working') THEN 'WORKING_DAY' WHEN number IS NOT NULL OR starts_with(k, 'NEAR') THEN 'CALENDAR_DAY' END AS unit,
    CASE WHEN k = 'EVENT' THEN trim({_g(T.AFTER_EVENT, 3)}) WHEN k = 'WEEKDAY' THEN CASE WHEN contains(e, 'tuần sau') OR contains(e, 'tuần tới') OR contains(e, 'next week') THEN 'MEETING_DATE_NEXT_WEEK' ELSE 'MEETING_DATE' END
      WHEN k = 'MEETING' OR starts_with(k, 'NEAR') THEN 'MEETING_DATE' END AS anchor FROM w)"""
)


def dat09_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.parsed(_phrases(spark, sf_dir), "phrase").withColumn("meeting", F.col("meeting").cast("string"))


DAT09 = f"WITH {PARSED_SQL} SELECT * REPLACE (CAST(meeting AS VARCHAR) AS meeting) FROM parsed"


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = spark.createDataFrame(list(ANCHORS), "event_id string, event_date string").withColumn("event_date", F.to_date("event_date"))
    rows = T.anchored(T.parsed(_phrases(spark, sf_dir), "phrase"), anchors)
    status, day = T.resolved(F.col("meeting"))
    return rows.withColumn("status", status).withColumn("day", day)


def dat10_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("event_id", "status", F.col("day").cast("string").alias("day"))


def dat11_trusted_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions that hang on an event, and the day of the event with exactly that id."""
    return _resolved(spark, sf_dir).where("type = 'DURATION_AFTER_EVENT'").select("event_id", "anchor", F.col("anchor_date").cast("string").alias("anchor_date"))


_workday = "(list_filter(list_transform(range(1, 3 * amount + 8), lambda d: base + CAST(d AS INTEGER)), lambda x: isodow(x) < 6))[amount]"
RESOLVED_SQL = (
    PARSED_SQL
    + f""", a AS (SELECT parsed.*, CASE anchor WHEN 'MEETING_DATE' THEN meeting WHEN 'MEETING_DATE_NEXT_WEEK' THEN meeting + 7 ELSE CAST(day AS DATE) END AS base, CAST(day AS DATE) AS anchor_date
  FROM parsed LEFT JOIN (VALUES {', '.join(f"('{i}', '{d}')" for i, d in ANCHORS)}) t(id, day) ON lower(id) = lower(anchor)),
d AS (SELECT *, CASE WHEN type = 'ABSOLUTE_DATE' AND starts_with(target_date, '--') THEN
      CASE WHEN TRY_CAST(year(meeting) || substr(target_date, 2) AS DATE) < meeting THEN TRY_CAST((year(meeting) + 1) || substr(target_date, 2) AS DATE) ELSE TRY_CAST(year(meeting) || substr(target_date, 2) AS DATE) END
    WHEN type = 'ABSOLUTE_DATE' THEN TRY_CAST(target_date AS DATE) END AS absolute FROM a),
resolved AS (SELECT *, CASE WHEN type = 'UNKNOWN' THEN 'UNKNOWN_EXPRESSION' WHEN type = 'DATE_RANGE' THEN 'AMBIGUOUS_RANGE' WHEN type = 'ABSOLUTE_DATE' AND absolute IS NULL THEN 'INVALID_DATE'
    WHEN type <> 'ABSOLUTE_DATE' AND base IS NULL THEN 'UNRESOLVED_ANCHOR' ELSE 'RESOLVED' END AS status,
  CASE WHEN type = 'ABSOLUTE_DATE' THEN absolute - CASE WHEN relation = 'BEFORE' THEN 1 ELSE 0 END
    WHEN type = 'RELATIVE_WEEKDAY' AND relation = 'BEFORE' THEN base - CAST(CASE (isodow(base) - 1 - weekday + 7) % 7 WHEN 0 THEN 7 ELSE (isodow(base) - 1 - weekday + 7) % 7 END AS INTEGER)
    WHEN type = 'RELATIVE_WEEKDAY' THEN base + CAST((weekday - isodow(base) + 1 + 7) % 7 AS INTEGER)
    WHEN unit = 'WORKING_DAY' THEN {_workday} WHEN unit = 'CALENDAR_DAY' THEN base + amount END AS day FROM d)"""
)

DAT10 = f"WITH {RESOLVED_SQL} SELECT event_id, status, CASE WHEN status = 'RESOLVED' THEN CAST(day AS VARCHAR) END AS day FROM resolved"
DAT11 = f"WITH {RESOLVED_SQL} SELECT event_id, anchor, CAST(anchor_date AS VARCHAR) AS anchor_date FROM resolved WHERE type = 'DURATION_AFTER_EVENT'"

#: Mentions as the older rules give them: text, relation, kind.
MENTIONS = (
    ("by 2024-02-13", "ON_OR_BEFORE", "ANCHOR"), ("on 2024-02-30", "ON_DATE", "ANCHOR"), ("before 31/12/2024", "BEFORE_DAY", "ANCHOR"), ("tomorrow", "ON_DATE", "RELATIVE_DAY"), ("15/6", "ON_DATE", "ANCHOR"),
    ("within 2 working days", "DURATION", "WORKING_DAY_DURATION"), ("after launch", "AFTER_EVENT", "EVENT_DEPENDENT"), ("thứ hai hoặc thứ ba", "AMBIGUOUS", "AMBIGUOUS"), ("soon", "ON_DATE", "ANCHOR"),
)


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda i: F.element_at(F.array(*(F.lit(m[i]) for m in MENTIONS)), (F.col("event_id") % len(MENTIONS)).cast("int") + 1)
    rows = table(spark, sf_dir, "events").select("event_id", of(0).alias("raw_text"), of(1).alias("relation"), of(2).alias("date_type"), F.lit(None).cast("string").alias("count"), F.to_date("ts").alias("meeting"))
    rows = dates.anchored(rows)
    return rows.withColumn("old_day", dates.resolved(F.col("meeting"), F.col("meeting")))


def dat13_mention_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir).select("event_id", F.col("old_day").cast("string").alias("day"), T.mention_status(F.col("old_day")).alias("status"))


_rule = lambda i: f"[{', '.join(sql_text(m[i]) for m in MENTIONS)}][event_id % {len(MENTIONS)} + 1]"
MENTIONS_SQL = f"""m AS (SELECT event_id, CAST(ts AS DATE) AS meeting, {_rule(0)} AS raw_text, {_rule(1)} AS relation, {_rule(2)} AS kind FROM events),
x AS (SELECT *, regexp_extract(raw_text, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS iso, regexp_extract(raw_text, '(\\d{{1,2}})/(\\d{{1,2}})/(\\d{{4}})', ['d', 'm', 'y']) AS f, regexp_extract(raw_text, '^(\\d{{1,2}})/(\\d{{1,2}})$', ['d', 'm']) AS s FROM m),
old AS (SELECT *, CASE WHEN kind NOT IN ('ANCHOR', 'RELATIVE_DAY') THEN NULL WHEN iso <> '' THEN TRY_CAST(iso AS DATE) WHEN f.y <> '' THEN TRY_CAST(f.y || '-' || lpad(f.m, 2, '0') || '-' || lpad(f.d, 2, '0') AS DATE)
    WHEN s.d <> '' THEN CASE WHEN CAST(year(meeting) || '-' || lpad(s.m, 2, '0') || '-' || lpad(s.d, 2, '0') AS DATE) < meeting THEN CAST((year(meeting) + 1) || '-' || lpad(s.m, 2, '0') || '-' || lpad(s.d, 2, '0') AS DATE)
      ELSE CAST(year(meeting) || '-' || lpad(s.m, 2, '0') || '-' || lpad(s.d, 2, '0') AS DATE) END
    WHEN raw_text = 'tomorrow' THEN meeting + 1 END - CASE WHEN relation = 'BEFORE_DAY' THEN 1 ELSE 0 END AS day FROM x)"""

DAT13 = f"""WITH {MENTIONS_SQL} SELECT event_id, CAST(day AS VARCHAR) AS day, CASE WHEN day IS NOT NULL THEN 'RESOLVED' WHEN kind = 'EVENT_DEPENDENT' THEN kind WHEN kind = 'AMBIGUOUS' THEN kind
  WHEN kind = 'WORKING_DAY_DURATION' THEN 'UNSUPPORTED_WORKING_DAY' WHEN iso <> '' OR f.y <> '' OR s.d <> '' THEN 'INVALID_DATE' ELSE 'MISSING_ANCHOR' END AS status FROM old"""


def dat12_old_and_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the older rules and the grammar agree, by type; what the grammar alone resolves is safe only within a duration."""
    rows = T.parsed(_mentions(spark, sf_dir).withColumnRenamed("relation", "old_relation"), "raw_text").withColumn("anchor_date", F.lit(None).cast("date"))
    status, day = T.resolved(F.col("meeting"))
    rows = rows.withColumn("status", status).withColumn("day", day)
    both = F.col("old_day").isNotNull() & F.col("day").isNotNull()
    improves = F.col("old_day").isNull() & F.col("day").isNotNull()
    return rows.groupBy("type").agg(
        F.count("*").alias("n"), F.count("old_day").alias("old_resolved"), F.count("day").alias("new_resolved"), F.count_if(both & (F.col("old_day") == F.col("day"))).alias("agree"),
        F.count_if(both & (F.col("old_day") != F.col("day"))).alias("disagree"), F.count_if(improves).alias("improve"), F.count_if(improves & (F.col("type") == "DURATION_AFTER_MEETING")).alias("safe"),
    )


DAT12 = f"""WITH {MENTIONS_SQL}, n AS (SELECT *, CASE WHEN iso <> '' OR f.y <> '' OR s.d <> '' THEN 'ABSOLUTE_DATE' WHEN raw_text = 'tomorrow' THEN 'RELATIVE_DAY' WHEN starts_with(raw_text, 'within') THEN 'DURATION_AFTER_MEETING'
    WHEN contains(raw_text, 'thứ') THEN 'RELATIVE_WEEKDAY' ELSE 'UNKNOWN' END AS type FROM old),
d AS (SELECT *, CASE type WHEN 'ABSOLUTE_DATE' THEN day WHEN 'RELATIVE_DAY' THEN day WHEN 'DURATION_AFTER_MEETING' THEN (list_filter(list_transform(range(1, 12), lambda i: meeting + CAST(i AS INTEGER)), lambda x: isodow(x) < 6))[2]
    WHEN 'RELATIVE_WEEKDAY' THEN meeting + CAST((8 - isodow(meeting)) % 7 AS INTEGER) END AS new FROM n)
SELECT type, count(*) AS n, count(day) AS old_resolved, count(new) AS new_resolved, count(*) FILTER (day = new) AS agree, count(*) FILTER (day <> new) AS disagree, count(*) FILTER (day IS NULL AND new IS NOT NULL) AS improve,
  count(*) FILTER (day IS NULL AND new IS NOT NULL AND type = 'DURATION_AFTER_MEETING') AS safe FROM d GROUP BY type"""

#: Sentences with the mention in brackets.
SENTENCES = (
    "Today is [2024-02-13]", "hôm nay là ngày [13/2/2024] nhé", "send it [by 2024-02-13]", "từ thứ hai, [từ thứ hai]", "we start on [Monday]", "bắt đầu vào [thứ ba]", "start the work before [Friday]", "work from [Monday]",
    "meeting on [5/6/2024] and more", "Gửi báo cáo [thứ sáu]", "khởi động, deadline [thứ năm]", "ngày họp: [20 tháng 11 năm 2024]", "[trước thứ tư] khởi động", "commences [tomorrow]",
)


def dat04_purposes(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.element_at(F.array(*map(F.lit, SENTENCES)), (F.col("event_id") % len(SENTENCES)).cast("int") + 1)
    rows = table(spark, sf_dir, "events").select("event_id", marked.alias("marked"))
    start, end = F.instr("marked", "[") - 1, F.instr("marked", "]") - 2
    return rows.select("event_id", T.purpose(F.regexp_replace("marked", "[\\[\\]]", ""), start, end).alias("purpose"))


_context = " OR ".join(
    f"len(list_filter(range(1, length(t) + 1), lambda i: i - 1 < b AND regexp_matches(substr(t, i), {sql_text('(?i)^' + re2(p)[len('(?:^|[^' + chr(92) + 'pL' + chr(92) + 'pN_])'):])}) AND (i = 1 OR NOT regexp_matches(substr(t, i - 1, 1), '[\\pL\\pN_]'))"
    f" AND i - 1 + length(regexp_extract(substr(t, i), {sql_text('(?i)^' + re2(p)[len('(?:^|[^' + chr(92) + 'pL' + chr(92) + 'pN_])'):])})) > a)) > 0"
    for p in T.CONTEXT
)
DAT04 = f"""WITH s AS (SELECT event_id, [{', '.join(map(sql_text, SENTENCES))}][event_id % {len(SENTENCES)} + 1] AS marked FROM events),
x AS (SELECT *, instr(marked, '[') - 1 AS a, instr(marked, ']') - 2 AS b, replace(replace(marked, '[', ''), ']', '') AS t FROM s),
y AS (SELECT *, substr(t, a + 1, b - a) AS mention, substr(t, greatest(1, a - 119), least(a, 120)) AS prefix FROM x),
z AS (SELECT *, {_context} AS context, {matches('prefix', T.START_CUE)} AND NOT {matches(f"regexp_replace(prefix, {sql_text('(?is)^.*(?:' + re2(T.START_CUE) + ')')}, ' ')", T.DEADLINE_CUE)} AS cued FROM y)
SELECT event_id, CASE WHEN context THEN 'MEETING_DATE' WHEN {matches('mention', T.DEADLINE_CUE)} THEN 'DEADLINE' WHEN {matches('mention', T.START_MENTION)} THEN 'START_DATE'
  WHEN cued OR {matches('prefix', T.START_BEFORE)} THEN 'START_DATE' ELSE 'DEADLINE' END AS purpose FROM z"""


def dat06_effective_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    requested = F.when(F.col("o_orderkey") % 3 == 0, F.to_date("o_orderdate").cast("string")).otherwise("")
    context = F.when(F.col("o_orderkey") % 2 == 0, F.date_add(F.to_date("o_orderdate"), 5).cast("string")).otherwise("")
    source = F.when(F.col("o_orderkey") % 4 == 0, "TRANSCRIPT_CONTEXT").otherwise("MEETING_NOTE_CONTEXT")
    day, of = T.meeting_date(requested, context, source, F.lit("2024-02-01"))
    return rows.select("o_orderkey", day.alias("meeting_date"), of.alias("source"))


DAT06 = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) + 5 AS VARCHAR) ELSE '2024-02-01' END AS meeting_date,
  CASE WHEN o_orderkey % 3 = 0 THEN 'REQUEST' WHEN o_orderkey % 4 = 0 THEN 'TRANSCRIPT_CONTEXT' WHEN o_orderkey % 2 = 0 THEN 'MEETING_NOTE_CONTEXT' ELSE 'PROCESSING_DATE' END AS source FROM orders"""

QUERIES = {
    "dat09_expressions": (dat09_expressions, DAT09), "dat10_resolutions": (dat10_resolutions, DAT10), "dat11_trusted_anchors": (dat11_trusted_anchors, DAT11), "dat12_old_and_new": (dat12_old_and_new, DAT12),
    "dat13_mention_status": (dat13_mention_status, DAT13), "dat04_purposes": (dat04_purposes, DAT04), "dat06_effective_dates": (dat06_effective_dates, DAT06),
}
