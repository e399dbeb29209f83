"""Queries over evidence: spans, references, context dates, recap scope, merged tasks, folds, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import ledger, recaps
from tessera.plans.rendered import CLAUSES_SQL, EVENTS_SQL, MEETING_DATE, clauses, table, task_events
from tessera.plans.said import matches

# Dates in full, and how a text gives the date of its meeting.
_FULL = "(?:\\d{4}-\\d{1,2}-\\d{1,2}|\\d{1,2}[/-]\\d{1,2}[/-]\\d{4}|\\d{1,2}\\s+tháng\\s+\\d{1,2}\\s+năm\\s+\\d{4})"
CONTEXT_DATE = (
    f"(?iU)\\b(?:(?:hôm\\s+nay|today)\\s+(?:là|is)\\s+(?:ngày\\s+)?|(?:ngày\\s+họp|meeting\\s+date)\\s*(?:là|is|:|-)?\\s*(?:ngày\\s+)?|"
    f"(?:cuộc\\s+họp|meeting)\\s+(?:hôm\\s+nay\\s+)?(?:diễn\\s+ra\\s+)?(?:vào|on)?\\s*(?:ngày\\s+)?)({_FULL})\\b"
)


def full_date(text: Column) -> Column:
    """An ISO, D/M/Y or Vietnamese full date, null if there is no such day."""
    iso, other = "^(\\d{4})-(\\d{1,2})-(\\d{1,2})$", "(?U)^(\\d{1,2})(?:[/-]|\\s+tháng\\s+)(\\d{1,2})(?:[/-]|\\s+năm\\s+)(\\d{4})$"
    part = lambda p, *order: F.concat_ws("-", *(F.lpad(F.regexp_extract(text, p, i), 4 if k == 0 else 2, "0") for k, i in enumerate(order)))
    return F.try_to_date(F.when(text.rlike(iso), part(iso, 1, 2, 3)).when(text.rlike(other), part(other, 3, 2, 1)), "yyyy-MM-dd")


def context_dates(text: Column) -> Column:
    """The dates that a text gives for its meeting."""
    return F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(CONTEXT_DATE), F.lit(1)), full_date)))


def dat05_context_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one date that a conversation gives for its meeting, null if there is none or several, over all its texts and a
    sentence on the date put in, in every third conversation with a second one."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "text")
    day = F.date_add(F.lit(MEETING_DATE).cast("date"), (F.col("conv_id") % 50).cast("int"))
    text = F.concat(F.lit("Today is "), day.cast("string"), F.lit(". "), F.when(F.col("conv_id") % 3 == 0, "Meeting on 5/6/2024.").otherwise("Meeting is long."))
    said = rows.unionAll(rows.select("conv_id").distinct().select("conv_id", text.alias("text")))
    found = said.groupBy("conv_id").agg(F.array_distinct(F.flatten(F.collect_set(context_dates(F.col("text"))))).alias("found"))
    return found.select("conv_id", F.when(F.size("found") == 1, F.element_at("found", 1)).cast("string").alias("meeting_date"))


DAT05 = f"""
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE CAST(DATE '{MEETING_DATE}' + CAST(conv_id % 50 AS INTEGER) AS VARCHAR) END AS meeting_date FROM conversations GROUP BY conv_id
"""


def _scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a meeting closes without tasks, and the widest recap in it, on clauses with a closing sentence put in."""
    said = F.when(F.col("order_index") % 17 == 5, "Final recap: no new tasks today").when(F.col("order_index") % 11 == 3, "Quick recap").otherwise(F.col("text_raw"))
    return recaps.scopes(clauses(spark, sf_dir).withColumn("said", said), "said")


def cue12_meeting_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many meetings there are of each scope, and how many of them close without tasks."""
    return _scopes(spark, sf_dir).groupBy("scope").agg(F.count("*").alias("n"), F.count_if("closes").alias("n_closing"))


def cue12_whole_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scopes(spark, sf_dir)


CUE12_CTE = (
    "WITH "
    + CLAUSES_SQL
    + f""", p AS (SELECT meeting_id, CASE WHEN order_index % 17 = 5 THEN 'Final recap: no new tasks today' WHEN order_index % 11 = 3 THEN 'Quick recap' ELSE text_raw END AS said FROM clauses),
s AS (SELECT meeting_id, {matches('said', *recaps.CLOSURES)} AS closing,
  CASE WHEN {matches('said', *recaps.AUTHORITATIVE)} THEN 3 WHEN {matches('said', *recaps.COMPLETE)} THEN 2 WHEN {matches('said', *recaps.ANY)} THEN 1 ELSE 0 END AS level FROM p),
m AS (SELECT meeting_id, bool_or(closing) AS closes, ['NONE', 'PARTIAL', 'COMPLETE', 'AUTHORITATIVE'][max(level) + 1] AS scope FROM s GROUP BY meeting_id)
"""
)
CUE12 = CUE12_CTE + " SELECT scope, count(*) AS n, count(*) FILTER (closes) AS n_closing FROM m GROUP BY scope"
CUE12_WHOLE = CUE12_CTE + " SELECT * FROM m"


def ext15_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that a clause names in quotes (0.92) or plainly (0.88), once per clause."""
    rows = clauses(spark, sf_dir).withColumn("said", F.concat("text_raw", F.when(F.col("order_index") % 5 == 0, ', task "Budget report"').otherwise("")))
    quoted = F.transform(F.regexp_extract_all("said", F.lit('(?iU)\\btask\\s*["“]([^"”]{2,160})["”]'), F.lit(1)), lambda x: F.struct(x.alias("label"), F.lit(0.92).alias("confidence")))
    plain = F.transform(F.regexp_extract_all("said", F.lit('(?iU)\\btask\\s+([^,;.!?"“]{1,180})'), F.lit(1)), lambda x: F.struct(F.trim(x).alias("label"), F.lit(0.88).alias("confidence")))
    found = rows.select("meeting_id", "clause_id", F.explode(F.concat(quoted, plain)).alias("x")).select("meeting_id", "clause_id", "x.*").where("label <> ''")
    return found.groupBy("meeting_id", "clause_id", T.match_form(F.col("label")).alias("label")).agg(F.max("confidence").cast("double").alias("confidence"))


EXT15 = (
    "WITH "
    + CLAUSES_SQL
    + """ SELECT meeting_id, clause_id, k AS label, 0.88::DOUBLE AS confidence FROM clauses WHERE event_type IN ('error', 'click') AND k <> ''
UNION ALL SELECT meeting_id, clause_id, 'budget report', 0.92::DOUBLE FROM clauses WHERE order_index % 5 = 0
"""
)


def ext21_span_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each clause's whole span and its prefixes of two to seven words, with ids."""
    words = F.split("text_raw", " ")
    prefixes = F.transform(F.sequence(F.lit(2), F.least(F.lit(7), F.size(words))), lambda n: F.array_join(F.slice(words, 1, n), " "))
    rows = clauses(spark, sf_dir).where(F.size(words) >= 2).select("meeting_id", "clause_id", F.explode(F.array_distinct(F.concat(F.array("text_raw"), prefixes))).alias("span"))
    return rows.select("meeting_id", "clause_id", "span", T.hash_id("PID-", F.concat_ws("|", F.lit("CREATE"), "clause_id", "span"), 16).alias("span_id"))


EXT21 = (
    "WITH "
    + CLAUSES_SQL
    + """, w AS (SELECT meeting_id, clause_id, text_raw, string_split(text_raw, ' ') AS parts FROM clauses),
s AS (SELECT meeting_id, clause_id, text_raw AS span FROM w UNION SELECT meeting_id, clause_id, array_to_string(parts[1:n], ' ') FROM w, (SELECT unnest(range(2, 8)) AS n) WHERE n <= len(parts))
SELECT meeting_id, clause_id, span, 'PID-' || substr(sha256(concat_ws('|', 'CREATE', clause_id, span)), 1, 16) AS span_id FROM s
"""
)


def out01_final_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible tasks with their due dates and a first line of evidence."""
    tasks = ledger.visible(ledger.reduced(task_events(spark, sf_dir)))
    day = F.date_add(F.lit(MEETING_DATE).cast("date"), F.coalesce(F.expr("try_cast(substr(deadline_mention_id, 6) as int)"), F.lit(0)))
    due = F.when(F.col("deadline_mention_id") != "", day.cast("string")).otherwise("")
    first = clauses(spark, sf_dir).select("meeting_id", F.col("order_index").alias("first_index"), F.concat_ws(": ", "speaker_name", "text_raw").alias("evidence"))
    return tasks.join(first, ["meeting_id", "first_index"], "left").select("meeting_id", "task_id", due.alias("due_date"), "evidence", F.lit("Proposed").alias("status"))


def ml05_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped folds: groups (here source and language) from the largest to the smallest, ties by hash, each to the fold that is
    smallest so far. One row per group goes through one fold in the JVM; the rows themselves are joined to it."""
    groups = table(spark, sf_dir, "documents").groupBy(F.concat_ws("|", "source", "lang").alias("group")).agg(F.count("*").alias("n"))
    listed = groups.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.sha2("group", 256).alias("tie"), "group", "n"))).alias("gs"))
    sizes = F.array(*(F.lit(0).cast("bigint") for _ in range(5)))
    start = F.struct(sizes.alias("sizes"), F.array().cast("array<struct<group:string,n:bigint,fold:int>>").alias("out"))

    def step(s: Column, g: Column) -> Column:
        fold = (F.array_position(s["sizes"], F.array_min(s["sizes"])) - 1).cast("int")
        return F.struct(F.transform(s["sizes"], lambda x, i: F.when(i == fold, x + g["n"]).otherwise(x)).alias("sizes"), F.array_append(s["out"], F.struct(g["group"].alias("group"), g["n"].alias("n"), fold.alias("fold"))).alias("out"))

    return listed.select(F.explode(F.aggregate("gs", start, step)["out"]).alias("x")).select("x.*")


ML05 = """
WITH RECURSIVE g AS (SELECT concat_ws('|', source, lang) AS grp, count(*) AS n FROM documents GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, sha256(grp)) AS i FROM g),
w AS (SELECT 0::BIGINT AS i, ''::VARCHAR AS grp, 0::BIGINT AS n, 0 AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS sizes
  UNION ALL SELECT o.i, o.grp, o.n, f.fold, list_transform(w.sizes, lambda x, k: CASE WHEN k = f.fold + 1 THEN x + o.n ELSE x END) FROM w JOIN o ON o.i = w.i + 1, LATERAL (SELECT CAST(list_position(w.sizes, list_min(w.sizes)) - 1 AS INTEGER) AS fold) f)
SELECT grp AS "group", n, fold FROM w WHERE i > 0
"""


def set05_staged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of several stages in their fixed order: of one anchor and kind, the earliest stage stands."""
    events = task_events(spark, sf_dir).withColumn("stage", F.when(F.col("extraction_source") == "RULE", 1).otherwise(2))
    notes = events.where("order_index % 9 = 0").withColumn("stage", F.lit(0))
    order = W.partitionBy("meeting_id", "event_type", "anchor_clause_id").orderBy("stage", "order_index")
    return notes.unionByName(events).withColumn("n", F.row_number().over(order)).where("n = 1").select("meeting_id", "event_type", "anchor_clause_id", "stage", "event_id")


SET05 = (
    "WITH "
    + EVENTS_SQL
    + """, u AS (SELECT *, 0 AS stage FROM task_events WHERE order_index % 9 = 0 UNION ALL SELECT *, CASE extraction_source WHEN 'RULE' THEN 1 ELSE 2 END FROM task_events)
SELECT meeting_id, event_type, anchor_clause_id, stage, event_id FROM u QUALIFY row_number() OVER (PARTITION BY meeting_id, event_type, anchor_clause_id ORDER BY stage, order_index) = 1
"""
)


def snk01_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON record per meeting, its parts in order."""
    part = F.struct("order_index", F.struct("clause_id", "speaker_name", "text_raw").alias("clause"))
    rows = clauses(spark, sf_dir).groupBy("meeting_id").agg(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["clause"]).alias("clauses"))
    return rows.select("meeting_id", F.sha2(F.to_json(F.struct("meeting_id", "clauses")), 256).alias("sha"), F.size("clauses").alias("n"))


SNK01 = (
    "WITH "
    + CLAUSES_SQL
    + """ SELECT meeting_id, sha256('{"meeting_id":' || meeting_id || ',"clauses":[' || string_agg('{"clause_id":"' || clause_id || '","speaker_name":"' || speaker_name || '","text_raw":"' || text_raw || '"}', ',' ORDER BY order_index) || ']}') AS sha,
  CAST(count(*) AS INTEGER) AS n FROM clauses GROUP BY meeting_id"""
)


def snk03_append_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an append of the second half of the events does to a ledger of the first half: new rows, replays, conflicts."""
    rows = table(spark, sf_dir, "events").select(F.concat_ws("|", "user_id", "event_type").alias("key"), F.round("value", 1).alias("payload"), (F.col("event_id") % 2).alias("half"), "event_id")
    first = W.partitionBy("key").orderBy("event_id")
    old = rows.where("half = 0").withColumn("n", F.row_number().over(first)).where("n = 1").select("key", F.col("payload").alias("known"))
    joined = rows.where("half = 1").join(old, "key", "left")
    outcome = F.when(F.col("known").isNull(), "APPENDED").when(F.col("known") == F.col("payload"), "REPLAYED").otherwise("CONFLICT")
    return joined.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


SNK03 = """
WITH r AS (SELECT concat_ws('|', user_id, event_type) AS key, round(value, 1) AS payload, event_id % 2 AS half, event_id FROM events),
o AS (SELECT key, payload AS known FROM r WHERE half = 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY event_id) = 1)
SELECT CASE WHEN known IS NULL THEN 'APPENDED' WHEN known = payload THEN 'REPLAYED' ELSE 'CONFLICT' END AS outcome, count(*) AS n FROM r LEFT JOIN o USING (key) WHERE half = 1 GROUP BY 1
"""

QUERIES = {
    "dat05_context_dates": (dat05_context_dates, DAT05), "cue12_meeting_scopes": (cue12_meeting_scopes, CUE12), "cue12_whole_meetings": (cue12_whole_meetings, CUE12_WHOLE), "ext15_references": (ext15_references, EXT15), "ext21_span_lattice": (ext21_span_lattice, EXT21), "out01_final_tasks": (out01_final_tasks, None), "ml05_group_folds": (ml05_group_folds, ML05), "set05_staged_union": (set05_staged_union, SET05),
    "snk01_traces": (snk01_traces, SNK01), "snk03_append_once": (snk03_append_once, SNK03),
}
