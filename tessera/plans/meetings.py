"""Queries over meetings: segmentation, cues, dates, windows, events, ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import cues, dates, ledger, segments
from tessera.plans.linked import shaped_events
from tessera.plans.rendered import CLAUSES_SQL, EVENTS_SQL, FLAGGED_SQL, MEETING_DATE, clauses, table, task_events
from tessera.plans.said import SAID_SQL, match_sql, said, sql_text
from tessera.sources import transcripts


def _turn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("meeting_id"), F.col("turn").alias("turn_no"), F.col("text").alias("text_raw"))


def seg01_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", T.normalized(F.col("text")).alias("normal"), T.match_form(F.col("text")).alias("match_form"))


SEG01 = r"""
WITH n AS (SELECT conv_id, turn, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')) AS normal FROM conversations)
SELECT conv_id, turn, normal, regexp_replace(strip_accents(replace(normal, 'đ', 'd')), '[^\p{L}\p{N}_\s:/.-]', '', 'g') AS match_form FROM n
"""


def seg04_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("role").agg(F.count("*").alias("n")).select("role", segments.speaker_id(F.col("role")).alias("speaker_id"), "n")


SEG04 = f"""SELECT role, 'SPK-' || substr(sha256(trim({match_sql("trim(regexp_replace(trim(role), '(?i)^(?:mr|ms|mrs|anh|chị|chi|em|bạn|ban|speaker)\\s+', ''))")})), 1, 8) AS speaker_id, count(*) AS n FROM conversations GROUP BY role"""


def seg04_named_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with forms of address: all of one person have one id."""
    spoken = F.element_at(F.array(*map(F.lit, ("{}", "anh {}", "Chị  {}", "{} ", "Mr {}"))), (F.col("order_index") % 5).cast("int") + 1)
    rows = said(spark, sf_dir).withColumn("name", F.replace(spoken, F.lit("{}"), F.col("speaker_name")))
    return rows.select("meeting_id", "clause_id", segments.display_name(F.col("name")).alias("display"), segments.speaker_id(F.col("name")).alias("speaker_id"))


SEG04N = f"""WITH {SAID_SQL} SELECT meeting_id, clause_id, speaker_name AS display, 'SPK-' || substr(sha256({match_sql('speaker_name')}), 1, 8) AS speaker_id FROM said"""


def _captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as captions of 1 s, on the time axis of the event's second within its day."""
    order = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("meeting_id"), T.sequence_id("CAP", order).alias("caption_id"), F.concat(F.lit("P"), F.col("event_id") % 2).alias("speaker_raw"),
        start.alias("start_ms"), (start + 1000).alias("end_ms"), F.col("event_type").alias("text_raw"), (order - 1).cast("long").alias("order_index"),
    )


def seg05_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments.turns(_captions(spark, sf_dir), max_gap_ms=3_600_000)
    return rows.select("meeting_id", "turn_no", "speaker_name", "text_raw", F.size("source_caption_ids").alias("n_captions"))


SEG05 = """
WITH c AS (
  SELECT user_id AS meeting_id, event_id, event_type, 'P' || (event_id % 2) AS speaker, epoch_ms(ts) AS start_ms, row_number() OVER w - 1 AS i
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), m AS (
  SELECT *, CASE WHEN lag(speaker) OVER w IS NULL OR lag(speaker) OVER w <> speaker OR start_ms - lag(start_ms + 1000) OVER w > 3600000 THEN 1 ELSE 0 END AS is_new
  FROM c WINDOW w AS (PARTITION BY meeting_id ORDER BY i)
), t AS (SELECT *, sum(is_new) OVER (PARTITION BY meeting_id ORDER BY i) AS turn_no FROM m)
SELECT meeting_id, CAST(turn_no AS BIGINT) AS turn_no, any_value(speaker) AS speaker_name, string_agg(event_type, ' ' ORDER BY i) AS text_raw, CAST(count(*) AS INTEGER) AS n_captions
FROM t GROUP BY meeting_id, turn_no
"""


def seg05_capped_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of at most 40 characters."""
    rows = segments.turns(_captions(spark, sf_dir), max_gap_ms=36_000_000, max_characters=40)
    return rows.select("meeting_id", "turn_no", "text_raw", F.size("source_caption_ids").alias("n_captions"))


SEG05C = """
WITH RECURSIVE c AS (
  SELECT user_id AS meeting_id, event_type AS t, event_id % 2 AS speaker, epoch_ms(ts) AS start_ms, row_number() OVER w AS i, lag(event_id % 2) OVER w AS before, epoch_ms(ts) - lag(epoch_ms(ts) + 1000) OVER w AS gap
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), walk AS (
  SELECT meeting_id, i, 1 AS turn_no, length(t) AS size, t FROM c WHERE i = 1
  UNION ALL SELECT c.meeting_id, c.i, CASE WHEN joins THEN turn_no ELSE turn_no + 1 END, CASE WHEN joins THEN size + length(c.t) + 1 ELSE length(c.t) END, c.t
  FROM walk JOIN c ON c.meeting_id = walk.meeting_id AND c.i = walk.i + 1, LATERAL (SELECT c.before = c.speaker AND c.gap <= 36000000 AND walk.size + length(c.t) + 1 <= 40 AS joins) j
)
SELECT meeting_id, CAST(turn_no AS BIGINT) AS turn_no, string_agg(t, ' ' ORDER BY i) AS text_raw, CAST(count(*) AS INTEGER) AS n_captions FROM walk GROUP BY meeting_id, turn_no
"""


def seg06_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turn_rows(spark, sf_dir).withColumn("sentence", segments.sentence_list(F.col("text_raw")))
    return rows.select("meeting_id", "turn_no", F.posexplode("sentence").alias("sentence_no", "text_raw"))


SEG06 = r"""
WITH s AS (
  SELECT conv_id AS meeting_id, turn AS turn_no, regexp_replace(regexp_replace(text, '([!?;])\s+', '\1' || chr(10), 'g'), '\.\s+([A-ZÀ-Ỹ])', '.' || chr(10) || '\1', 'g') AS t FROM conversations
), p AS (
  SELECT meeting_id, turn_no, list_filter(list_transform(regexp_split_to_array(t, '\n+'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM s
)
SELECT meeting_id, turn_no, CAST(unnest(range(0, len(parts))) AS INTEGER) AS sentence_no, unnest(parts) AS text_raw FROM p
"""


ADDRESSED = ("See https://a.org/x? Next one. Done", "Xong chưa? Rồi. Chốt lại 2.5 điểm; hết", "at http://b.c/correction; hold on, wait", "Ngày 1.5. Sau đó đổi thành thứ hai", "one. two! three?four")


def seg06_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of texts with web addresses, decimals and markers."""
    rows = said(spark, sf_dir).withColumn("text", F.element_at(F.array(*map(F.lit, ADDRESSED)), (F.col("order_index") % len(ADDRESSED)).cast("int") + 1))
    return rows.select("meeting_id", "clause_id", F.posexplode(segments.sentence_list(F.col("text"))).alias("nth", "sentence"))


# a marker that stands after a blank; web addresses have none, and their last character gets a joiner behind it
SEG06P = f"""
WITH {SAID_SQL}, a AS (SELECT meeting_id, clause_id, regexp_replace([{', '.join(map(sql_text, ADDRESSED))}][order_index % {len(ADDRESSED)} + 1], '(https?://\\S+)', '\\1' || chr(8288), 'g') AS t FROM said),
b AS (SELECT meeting_id, clause_id, regexp_replace(t, '(?i)(\\s)((?:{'|'.join(segments.MARKERS)})(?:$|[^\\pL\\pN_]))', '\\1' || chr(10) || '\\2', 'g') AS t FROM a),
c AS (SELECT meeting_id, clause_id, regexp_replace(regexp_replace(t, '([!?;])\\s+', '\\1' || chr(10), 'g'), '\\.\\s+([A-ZÀ-Ỹ])', '.' || chr(10) || '\\1', 'g') AS t FROM b),
p AS (SELECT meeting_id, clause_id, list_filter(list_transform(regexp_split_to_array(replace(t, chr(8288), ''), '\\n+'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM c)
SELECT meeting_id, clause_id, CAST(unnest(range(0, len(parts))) AS INTEGER) AS nth, unnest(parts) AS sentence FROM p
"""


def src08_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations packed with title, date and note, and read again; some are broken on purpose."""
    rows = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") + F.col("turn")
    whole = transcripts.package(
        F.when(k % 3 != 0, F.concat(F.lit("M"), "conv_id")).otherwise(""), F.when(k % 2 == 0, "Weekly  plan").otherwise(""), F.lit(""), F.when(k % 4 == 0, F.concat(F.lit(" note of "), "role")), F.trim(F.regexp_replace("text", "\\s+", " "))
    )
    broken = F.when(k % 7 == 0, F.replace(whole, F.lit(transcripts.TRANSCRIPT), F.lit("=== TEXT ==="))).otherwise(whole)
    return rows.select("conv_id", "turn", transcripts.unpackaged(broken).alias("p")).select("conv_id", "turn", F.sha2("p.transcript", 256).alias("sha"), "p.note", "p.meeting_id", "p.meeting_title", "p.meeting_date")


SRC08 = """
WITH r AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, conv_id + turn AS k FROM conversations),
s AS (SELECT *, CASE WHEN k % 3 <> 0 THEN 'M' || conv_id ELSE '' END AS id, CASE WHEN k % 2 = 0 THEN 'Weekly plan' ELSE '' END AS title, CASE WHEN k % 4 = 0 THEN 'note of ' || role END AS note FROM r),
w AS (SELECT *, id <> '' OR title <> '' AS known, k % 7 = 0 AND (id <> '' OR title <> '' OR note IS NOT NULL) AS broken FROM s)
SELECT conv_id, turn, sha256(CASE WHEN broken THEN concat_ws(chr(10), CASE WHEN known THEN '=== MEETING METADATA ===' || chr(10) || 'meeting_id: ' || id || chr(10) || 'meeting_title: ' || title || chr(10) || 'meeting_date: ' || chr(10) || '=== END MEETING METADATA ===' END,
  CASE WHEN note IS NOT NULL THEN '=== MEETING NOTE ===' || chr(10) || note || chr(10) || '=== END MEETING NOTE ===' END, '=== TEXT ===', t) ELSE t END) AS sha,
  CASE WHEN NOT broken THEN note END AS note, CASE WHEN known AND NOT broken THEN id ELSE '' END AS meeting_id, CASE WHEN known AND NOT broken THEN title ELSE '' END AS meeting_title, '' AS meeting_date FROM w
"""


def seg08_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments.clauses(segments.sentences(_turn_rows(spark, sf_dir)))
    return rows.groupBy("meeting_id").agg(F.count("*").alias("n_clauses"), F.max("order_index").alias("last_index"), F.min("clause_id").alias("first_id"), F.sum(F.length("text_raw")).alias("n_chars"))


def seg10_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.blocks(clauses(spark, sf_dir), size=20, overlap=5)


SEG10 = (
    "WITH "
    + CLAUSES_SQL
    + """, sized AS (SELECT *, max(order_index) OVER (PARTITION BY meeting_id) // 20 AS last FROM clauses)
SELECT c.meeting_id, b.block AS block, count(*) FILTER (c.order_index // 20 = b.block) AS n_primary, count(*) FILTER (c.order_index // 20 <> b.block) AS n_context,
       min(c.order_index) AS first_index, max(c.order_index) AS last_index
FROM sized c JOIN (SELECT DISTINCT meeting_id, unnest(range(0, last + 1)) AS block FROM sized) b
  ON b.meeting_id = c.meeting_id AND c.order_index BETWEEN b.block * 20 - 5 AND b.block * 20 + 24
GROUP BY ALL
"""
)


def seg03_live_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments.merged_captions(_captions(spark, sf_dir), max_gap_ms=86_400_000)
    return rows.groupBy("meeting_id").agg(F.count("*").alias("n_kept"), F.sum("merged").alias("n_captions"))


def src01_plain_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as stamped lines and read again."""
    said = F.struct("turn", F.concat(F.lit("["), F.format_string("%02d:%02d", (F.col("turn") / 60).cast("int"), (F.col("turn") % 60).cast("int")), F.lit("] "), "role", F.lit(": "), F.regexp_replace("text", "\\s+", " ")).alias("line"))
    files = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("meeting_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["line"]), "\n").alias("transcript"))
    rows = transcripts.captions(files)
    return rows.select("meeting_id", "caption_id", "speaker_raw", "start_ms", F.length("text_raw").alias("n_chars"))


SRC01 = r"""
SELECT conv_id AS meeting_id, printf('CAP-%06d', row_number() OVER (PARTITION BY conv_id ORDER BY turn)) AS caption_id, role AS speaker_raw,
       CAST(turn * 1000 AS BIGINT) AS start_ms, CAST(length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS INTEGER) AS n_chars
FROM conversations WHERE trim(text) <> ''
"""


def src02_vtt_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as WebVTT cues and read again."""
    stamp = lambda ms: F.format_string("%02d:%02d:%02d.%03d", (ms / 3_600_000).cast("int"), (ms / 60_000 % 60).cast("int"), (ms / 1000 % 60).cast("int"), (ms % 1000).cast("int"))
    start = F.col("order_index") * 1500
    cue = F.struct("order_index", F.concat(stamp(start), F.lit(" --> "), stamp(start + 900), F.lit("\n<v "), "speaker_name", F.lit(">"), "text_raw", F.lit("\n")).alias("cue"))
    files = clauses(spark, sf_dir).groupBy("meeting_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(cue)), lambda x: x["cue"]), "\n")).alias("transcript"))
    return transcripts.captions(files).select("meeting_id", "caption_id", "speaker_raw", "start_ms", "end_ms", "text_raw")


SRC02 = (
    "WITH "
    + CLAUSES_SQL
    + """ SELECT meeting_id, printf('CAP-%06d', order_index + 1) AS caption_id, speaker_name AS speaker_raw, CAST(order_index * 1500 AS BIGINT) AS start_ms,
  CAST(order_index * 1500 + 900 AS BIGINT) AS end_ms, text_raw FROM clauses"""
)


def src06_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").withColumn("plain", T.caption_text(F.col("html")))
    return rows.select("page_id", F.sha2("plain", 256).alias("sha"), F.length("plain").alias("n_chars"))


SRC06 = r"""
WITH p AS (SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'),
  '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), chr(160), ' '), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS plain FROM pages)
SELECT page_id, sha256(plain) AS sha, CAST(length(plain) AS INTEGER) AS n_chars FROM p
"""


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues.annotated(clauses(spark, sf_dir), F.col("text_normalized").rlike("[0-9]{4}-[0-9]{2}-[0-9]{2}|tomorrow|friday"))


def cue04_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _annotated(spark, sf_dir)
    return rows.select("meeting_id", "clause_id", F.array_join("flags", ",").alias("flags"), "score", "rule_confidence")


CUE04 = (
    "WITH "
    + FLAGGED_SQL
    + " SELECT meeting_id, clause_id, array_to_string(flags, ',') AS flags, CAST(score AS INTEGER) AS score, round(least(0.99, 0.45 + positive * 0.12), 6)::DOUBLE AS rule_confidence FROM candidates"
)


def cue06_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _annotated(spark, sf_dir).withColumn("strategy", cues.strategy()).withColumn("candidate", cues.is_candidate())
    return rows.groupBy("meeting_id", "strategy", "candidate").agg(F.count("*").alias("n"))


CUE06 = "WITH " + FLAGGED_SQL + " SELECT meeting_id, strategy, candidate, count(*) AS n FROM candidates GROUP BY ALL"


def jon02_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cues.windows(_annotated(spark, sf_dir))
    return rows.select("meeting_id", "window_id", "primary_clause_id", F.array_join("context_clause_ids", ",").alias("context"), "score", "strategy")


JON02 = (
    "WITH "
    + FLAGGED_SQL
    + """, near AS (SELECT *, array_to_string(list(clause_id) OVER (PARTITION BY meeting_id ORDER BY order_index ROWS BETWEEN 3 PRECEDING AND 5 FOLLOWING), ',') AS context FROM candidates)
SELECT meeting_id, printf('WINDOW-%06d', row_number() OVER (PARTITION BY meeting_id ORDER BY order_index)) AS window_id, clause_id AS primary_clause_id, context,
  CAST(score AS INTEGER) AS score, strategy FROM near WHERE candidate
"""
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate windows of each meeting, by how they are to be read."""
    return cues.windows(_annotated(spark, sf_dir)).groupBy("meeting_id", "strategy").agg(F.count("*").alias("n_windows"), F.sum(F.size("context_clause_ids")).alias("n_context"), F.max("score").alias("best_score"))


FLAGSHIP = (
    "WITH "
    + FLAGGED_SQL
    + """, near AS (SELECT *, count(*) OVER (PARTITION BY meeting_id ORDER BY order_index ROWS BETWEEN 3 PRECEDING AND 5 FOLLOWING) AS c FROM candidates)
SELECT meeting_id, strategy, count(*) AS n_windows, CAST(sum(c) AS BIGINT) AS n_context, CAST(max(score) AS INTEGER) AS best_score FROM near WHERE candidate GROUP BY ALL
"""
)


def dat01_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dates.mentions(clauses(spark, sf_dir))
    day = F.lit(MEETING_DATE).cast("date")
    return rows.select("meeting_id", "clause_id", "raw_text", "relation", "date_type", dates.resolved(day, day).cast("string").alias("due"))


DAT01 = (
    "WITH "
    + CLAUSES_SQL
    + """ SELECT meeting_id, clause_id,
  CASE event_type WHEN 'signup' THEN 'by 2024-02-13' WHEN 'purchase' THEN 'Tomorrow' WHEN 'click' THEN '2024-03-05' ELSE 'before Friday' END AS raw_text,
  CASE event_type WHEN 'signup' THEN 'ON_OR_BEFORE' WHEN 'view' THEN 'BEFORE_DAY' ELSE 'ON_DATE' END AS relation,
  CASE event_type WHEN 'purchase' THEN 'RELATIVE_DAY' WHEN 'view' THEN 'WEEKDAY' ELSE 'ABSOLUTE_DATE' END AS date_type,
  CASE event_type WHEN 'signup' THEN '2024-02-13' WHEN 'click' THEN '2024-03-05' WHEN 'purchase' THEN '2024-02-02' ELSE '2024-02-01' END AS due
FROM clauses WHERE event_type <> 'error'
"""
)


def dat10_working_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 12).alias("n"))
    return rows.select("o_orderkey", F.when(F.col("n") == 0, F.col("day")).otherwise(dates.after_working_days(F.col("day"), F.col("n"))).cast("string").alias("due"))


DAT10 = """
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 12 AS n FROM orders),
days AS (SELECT o_orderkey, n, day, x, row_number() OVER (PARTITION BY o_orderkey ORDER BY x) AS i FROM d, (SELECT unnest(range(1, 22)) AS step) s, LATERAL (SELECT day + CAST(step AS INTEGER) AS x) WHERE isodow(x) < 6)
SELECT o_orderkey, CAST(x AS VARCHAR) AS due FROM days WHERE i = n UNION ALL SELECT o_orderkey, CAST(day AS VARCHAR) FROM d WHERE n = 0
"""


def agg01_event_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.deduplicated(task_events(spark, sf_dir))
    return rows.select("meeting_id", "event_id", "event_type", "extraction_source", F.array_join("source_clause_ids", ",").alias("evidence"), "n_merged")


AGG01 = (
    "WITH "
    + EVENTS_SQL
    + """, keyed AS (SELECT *, CASE WHEN event_type IN ('TASK_CREATE', 'OWNER_ASSIGN') THEN concat_ws('|', event_type, action_text, anchor_clause_id)
    ELSE concat_ws('|', event_type, anchor_clause_id, action_text, assignee, deadline_mention_id) END AS key,
    CASE extraction_source WHEN 'RULE' THEN 2 ELSE 1 END AS prio FROM task_events)
SELECT meeting_id, first(event_id ORDER BY prio DESC, order_index) AS event_id, any_value(event_type) AS event_type, first(extraction_source ORDER BY prio DESC, order_index) AS extraction_source,
  string_agg(source_clause_id, ',' ORDER BY order_index) AS evidence, count(*) AS n_merged FROM keyed GROUP BY meeting_id, key
"""
)


def led01_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.folded(task_events(spark, sf_dir))


def led03_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of the tasks that a meeting shows, over events of many shapes."""
    return ledger.visible(ledger.folded(shaped_events(spark, sf_dir))).groupBy("meeting_id", "status").agg(F.count("*").alias("n"), F.max("last_index").alias("last_index"))


def led07_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.reduced(task_events(spark, sf_dir))


LED07 = (
    "WITH "
    + EVENTS_SQL
    + """, live AS (SELECT *, coalesce(max(CASE WHEN event_type = 'TASK_CANCEL' THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id, bound_task_id ORDER BY order_index
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM task_events)
SELECT meeting_id, bound_task_id AS task_id, max_by(CASE event_type WHEN 'TASK_CANCEL' THEN 'CANCELLED' WHEN 'OWNER_REASSIGN' THEN 'REASSIGNED' ELSE 'CONFIRMED' END, order_index)
    FILTER (event_type <> 'DEADLINE_REPLACE') AS status,
  coalesce(max_by(deadline_mention_id, order_index) FILTER (deadline_mention_id <> ''), '') AS deadline_mention_id, min(order_index) AS first_index, max(order_index) AS last_index, count(*) AS n_events
FROM live WHERE ended = 0 GROUP BY meeting_id, bound_task_id
"""
)


def jon04_previous_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join backwards: the last other speaker before each clause."""
    order = W.partitionBy("meeting_id").orderBy("order_index")
    rows = clauses(spark, sf_dir).withColumn("before", F.lag("speaker_name").over(order)).withColumn("changed", F.when(F.col("before") != F.col("speaker_name"), F.col("before")))
    return rows.select("meeting_id", "clause_id", F.last("changed", ignorenulls=True).over(order).alias("previous_other"))


JON04 = (
    "WITH "
    + CLAUSES_SQL
    + """, b AS (SELECT *, lag(speaker_name) OVER w AS before FROM clauses WINDOW w AS (PARTITION BY meeting_id ORDER BY order_index))
SELECT meeting_id, clause_id, last_value(CASE WHEN before <> speaker_name THEN before END IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY order_index) AS previous_other FROM b
"""
)


def win01_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("meeting_id").orderBy("order_index")
    rows = clauses(spark, sf_dir)
    return rows.select(
        "meeting_id", "clause_id", F.concat(F.lit("PREV "), F.coalesce(F.lag("text_normalized").over(order), F.lit("")), F.lit(" FOCUS "), "text_normalized", F.lit(" NEXT "), F.coalesce(F.lead("text_normalized").over(order), F.lit(""))).alias("features"),
        F.coalesce(F.lag("speaker_name").over(order) != F.col("speaker_name"), F.lit(False)).alias("speaker_change"),
    )


WIN01 = (
    "WITH "
    + CLAUSES_SQL
    + """ SELECT meeting_id, clause_id, 'PREV ' || coalesce(lag(lower(text_raw)) OVER w, '') || ' FOCUS ' || lower(text_raw) || ' NEXT ' || coalesce(lead(lower(text_raw)) OVER w, '') AS features,
  coalesce(lag(speaker_name) OVER w <> speaker_name, false) AS speaker_change FROM clauses WINDOW w AS (PARTITION BY meeting_id ORDER BY order_index)
"""
)


def scl04_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array_sort(F.collect_list(F.struct("order_index", F.concat_ws(": ", "speaker_name", "text_raw").alias("line"))))
    rows = clauses(spark, sf_dir).groupBy("meeting_id").agg(F.array_distinct(F.transform(said, lambda x: x["line"])).alias("lines"))
    return rows.select("meeting_id", F.size("lines").alias("n_lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("evidence_sha"))


SCL04 = (
    "WITH "
    + CLAUSES_SQL
    + """, f AS (SELECT meeting_id, speaker_name || ': ' || text_raw AS line, min(order_index) AS i FROM clauses GROUP BY ALL)
SELECT meeting_id, CAST(count(*) AS INTEGER) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY i)) AS evidence_sha FROM f GROUP BY meeting_id
"""
)


def str01_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = rows.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n", "total")


STR01 = """
WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS is_new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM m)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session
"""

QUERIES = {
    "flagship": (flagship, FLAGSHIP), "src01_plain_transcripts": (src01_plain_transcripts, SRC01), "src02_vtt_cues": (src02_vtt_cues, SRC02), "src06_page_text": (src06_page_text, SRC06),
    "seg01_normal_forms": (seg01_normal_forms, SEG01), "seg03_live_captions": (seg03_live_captions, None), "seg04_speakers": (seg04_speakers, SEG04), "seg04_named_speakers": (seg04_named_speakers, SEG04N), "seg05_capped_turns": (seg05_capped_turns, SEG05C), "seg06_protected": (seg06_protected, SEG06P), "src08_packages": (src08_packages, SRC08), "seg05_turns": (seg05_turns, SEG05),
    "seg06_sentences": (seg06_sentences, SEG06), "seg08_clauses": (seg08_clauses, None), "seg10_blocks": (seg10_blocks, SEG10), "cue04_annotations": (cue04_annotations, CUE04),
    "cue06_strategies": (cue06_strategies, CUE06), "jon02_windows": (jon02_windows, JON02), "jon04_previous_speaker": (jon04_previous_speaker, JON04),
    "dat01_mentions": (dat01_mentions, DAT01), "dat10_working_days": (dat10_working_days, DAT10), "agg01_event_dedupe": (agg01_event_dedupe, AGG01), "led01_ledger": (led01_ledger, None),
    "led03_visible": (led03_visible, None), "led07_reducer": (led07_reducer, LED07), "win01_neighbours": (win01_neighbours, WIN01), "scl04_evidence": (scl04_evidence, SCL04), "str01_sessions": (str01_sessions, STR01),
}
