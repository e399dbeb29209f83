"""Transcripts as caption rows: meeting_id, caption_id, speaker_raw, start_ms, end_ms, text_raw, order_index.

Input rows are whole files: meeting_id, transcript and, where known, file_name. Each reader stays in Catalyst: lines are
exploded with their positions, and what depends on earlier lines is a window within the meeting.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import let, sequence_id, speaker_and_text, stamp_ms

#: Patterns of the formats.
TIMING = "^((?:\\d{2}:)?\\d{2}:\\d{2}[.,]\\d{3})\\s+-->\\s+((?:\\d{2}:)?\\d{2}:\\d{2}[.,]\\d{3})"
STAMPED = "(?i)^(?:T\\d+\\s+)?\\[(\\d{2}:\\d{2}(?::\\d{2})?)\\]\\s*(.*)$"
HEADER = "(?i)^(?:MEETING_ID|PART|CASE_LABELS|MEETING_DATE|PRIMARY_FEATURE|TITLE):"
BOUNDARY = "(?i)^---\\s*(?:END|START)\\s+OF\\s+PART\\b"

CAPTION = ("meeting_id", "caption_id", "speaker_raw", "start_ms", "end_ms", "text_raw", "order_index")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file below path; its name without ending is the meeting's id."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return spark.read.text(path, wholetext=True).select(
        F.regexp_replace(name, "\\.[^.]*$", "").alias("meeting_id"), name.alias("file_name"), F.col("value").alias("transcript")
    )


def format_of(transcript: Column, file_name: Column) -> Column:
    """vtt, srt or plain, by the first characters, the file's ending and arrows in the text."""
    start = F.regexp_replace(transcript, "^[\\s\\ufeff]+", "")
    ending = F.lower(F.regexp_extract(F.coalesce(file_name, F.lit("")), "\\.([^.]+)$", 1))
    return (
        F.when(start.startswith("WEBVTT") | (ending == "vtt"), "vtt").when((ending == "srt") | F.contains(transcript, F.lit("-->")), "srt").otherwise("plain")
    )


def _lines(files: DataFrame) -> DataFrame:
    text = F.regexp_replace(F.col("transcript"), "\r\n", "\n")
    return files.select("meeting_id", F.posexplode(F.split(text, "\n")).alias("line_no", "raw")).withColumn("line", F.regexp_replace(F.trim("raw"), "^\ufeff+", ""))


def cues(files: DataFrame) -> DataFrame:
    """WebVTT and SRT: a line of two times, then text up to a blank line."""
    by_line = W.partitionBy("meeting_id").orderBy("line_no")
    lines = _lines(files).withColumn("timing", F.col("line").rlike(TIMING)).withColumn("blank", F.col("line") == "")
    lines = lines.withColumn("cue", F.last(F.when(F.col("timing"), F.col("line_no")), ignorenulls=True).over(by_line))
    within = W.partitionBy("meeting_id", "cue").orderBy("line_no")
    lines = lines.where("cue is not null").withColumn("closed", F.max(F.col("blank").cast("int")).over(within))
    parts = lines.groupBy("meeting_id", "cue").agg(
        F.max(F.when(F.col("timing"), F.col("line"))).alias("times"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("timing") & (F.col("closed") == 0), F.struct("line_no", "line")))), lambda x: x["line"]), " ").alias("said"),
    )
    speaker, text = speaker_and_text(F.col("said"))
    rows = parts.select(
        "meeting_id", F.col("cue").alias("line_no"), speaker.alias("speaker_raw"), stamp_ms(F.regexp_extract("times", TIMING, 1)).alias("start_ms"),
        stamp_ms(F.regexp_extract("times", TIMING, 2)).alias("end_ms"), text.alias("text_raw"),
    )
    return _numbered(rows)


def plain(files: DataFrame) -> DataFrame:
    """One caption per line; a line without name goes on with the speaker before."""
    lines = _lines(files).where((F.col("line") != "") & ~F.col("line").rlike(HEADER) & ~F.col("line").rlike(BOUNDARY))
    stamped = F.col("line").rlike(STAMPED)
    stamp = F.regexp_extract("line", STAMPED, 1)
    stamp = F.when(F.length(stamp) == 5, F.concat(F.lit("00:"), stamp)).otherwise(stamp)
    lines = lines.withColumn("start_ms", F.when(stamped, stamp_ms(F.when(stamped, stamp)))).withColumn("said", F.when(stamped, F.regexp_extract("line", STAMPED, 2)).otherwise(F.col("line")))
    speaker, text = speaker_and_text(F.col("said"))
    lines = lines.withColumn("named", speaker).withColumn("text_raw", text).where("text_raw <> ''")
    before = W.partitionBy("meeting_id").orderBy("line_no")
    carried = F.last(F.when(F.col("named") != "Unknown", F.col("named")), ignorenulls=True).over(before)
    return _numbered(lines.withColumn("speaker_raw", F.coalesce(carried, F.lit("Unknown"))).withColumn("end_ms", F.lit(None).cast("long")))


def _numbered(rows: DataFrame) -> DataFrame:
    order = F.row_number().over(W.partitionBy("meeting_id").orderBy("line_no"))
    return rows.where("text_raw <> ''").withColumn("order_index", order - 1).withColumn("caption_id", sequence_id("CAP", order)).select(*CAPTION)


def captions(files: DataFrame) -> DataFrame:
    """Captions of files in any of the formats."""
    name = F.col("file_name") if "file_name" in files.columns else F.lit(None).cast("string")
    kind = files.withColumn("kind", format_of(F.col("transcript"), name))
    return cues(kind.where("kind <> 'plain'")).unionByName(plain(kind.where("kind = 'plain'")))


# The marks around a package's sections.
METADATA = ("=== MEETING METADATA ===", "=== END MEETING METADATA ===")
NOTE = ("=== MEETING NOTE ===", "=== END MEETING NOTE ===")
TRANSCRIPT = "=== TRANSCRIPT ==="
FIELDS = ("meeting_id", "meeting_title", "meeting_date")


def package(meeting_id: Column, title: Column, date: Column, note: Column, transcript: Column) -> Column:
    """One text with the metadata (if there is any), the note (if there is one) and the transcript; the transcript alone if
    there is neither."""
    flat = lambda c: F.coalesce(F.trim(F.regexp_replace(c, "(?U)\\s+", " ")), F.lit(""))
    values = [flat(c) for c in (meeting_id, title, date)]
    known = (values[0] != "") | (values[1] != "") | (values[2] != "")
    own = F.coalesce(F.trim(F.regexp_replace(note, "^\\s+|\\s+$", "")), F.lit(""))
    head = F.when(known, F.concat_ws("\n", F.lit(METADATA[0]), *(F.concat(F.lit(f"{name}: "), v) for name, v in zip(FIELDS, values, strict=True)), F.lit(METADATA[1])))
    noted = F.when(own != "", F.concat_ws("\n", F.lit(NOTE[0]), own, F.lit(NOTE[1])))
    body = F.concat_ws("\n", F.lit(TRANSCRIPT), F.regexp_replace(transcript, "^\\s+", ""))
    return F.when(known | (own != ""), F.concat_ws("\n", head, noted, body)).otherwise(transcript)


def unpackaged(text: Column) -> Column:
    """transcript, note and the fields of the metadata of a package as a struct; a text without marks, or with some of them only,
    is a transcript as it stands."""
    cut = lambda c, marks, i: F.regexp_extract(c, f"(?s)^{re.escape(marks[0])}\\s*\\n(.*?)\\n{re.escape(marks[1])}\\s*\\n(.*)$", i)
    has = lambda c, marks: c.rlike(f"(?s)^{re.escape(marks[0])}\\s*\\n.*?\\n{re.escape(marks[1])}\\s*\\n.*$")
    start = F.regexp_replace(text, "^\\s+", "")
    final = f"(?s)^{re.escape(TRANSCRIPT)}\\s*\\n(.*)$"

    def parts(own: Column) -> Column:
        meta, rest = F.when(has(own, METADATA), cut(own, METADATA, 1)), F.when(has(own, METADATA), cut(own, METADATA, 2)).otherwise(own)
        return let(F.struct(meta.alias("meta"), rest.alias("rest")), lambda a: let(
            F.struct(a["meta"].alias("meta"), F.when(has(a["rest"], NOTE), cut(a["rest"], NOTE, 1)).alias("note"), F.when(has(a["rest"], NOTE), cut(a["rest"], NOTE, 2)).otherwise(a["rest"]).alias("rest")), finished
        ))

    def finished(b: Column) -> Column:
        whole, partial = b["rest"].rlike(final), b["meta"].isNotNull() | b["note"].isNotNull()
        field = lambda name: F.when(whole, F.trim(F.regexp_extract(F.coalesce(b["meta"], F.lit("")), f"(?im)^\\s*{name}\\s*:(.*)$", 1))).otherwise("").alias(name)
        note = F.when(whole, F.nullif(F.trim(F.regexp_replace(b["note"], "^\\s+|\\s+$", "")), F.lit("")))
        return F.struct(F.when(whole, F.regexp_extract(b["rest"], final, 1)).when(partial, text).otherwise(b["rest"]).alias("transcript"), note.alias("note"), *(field(n) for n in FIELDS))

    return let(start, parts)


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-16 with a byte order mark, else UTF-8 with or without one; null if they are empty or neither."""
    head = F.hex(F.substring(content, 1, 2))
    wide = F.when(head == "FFFE", F.decode(F.substring(content, 3, 1 << 30), "UTF-16LE")).when(head == "FEFF", F.decode(F.substring(content, 3, 1 << 30), "UTF-16BE"))
    bare = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, 4, 1 << 30)).otherwise(content)
    narrow = F.when(F.is_valid_utf8(bare.cast("string")), bare.cast("string"))
    return F.when(F.length(content) > 0, F.coalesce(wide, narrow))


def diarised(segments: Column) -> Column:
    """Segments (array of speaker, text) as lines of `speaker: text`; those without either are left out."""
    flat = lambda c: F.trim(F.regexp_replace(c, "[\\r\\n]", " "))
    kept = F.filter(segments, lambda s: (F.trim(F.coalesce(s["speaker"], F.lit(""))) != "") & (F.trim(F.coalesce(s["text"], F.lit(""))) != ""))
    return F.concat(F.array_join(F.transform(kept, lambda s: F.concat(flat(s["speaker"]), F.lit(": "), flat(s["text"]))), "\n"), F.lit("\n"))
