"""Tasks that a clause names, in quotes or plainly, whether or not the meeting has made them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import let, match_form
from tessera.operators.guards import DELIVERABLE
from tessera.operators.temporal import match_spans

# References, what ends a plain one, states that are active, words that refer to nothing, fillers, numbers in front.
QUOTED = "\\btask\\s*(?:c[oó]\\s+t[eê]n\\s+l[aà]\\s*)?[\"“]([^\"”]{2,160})[\"”]"
PLAIN = "\\btask\\s+([^,;.!?]{1,180})"
STOP = "\\s+(?:đang|đã|deadline|hạn(?:\\s+chót)?|owner|assignee|status|trạng\\s+thái|do|được|vẫn|sẽ|có\\s+cần|thế\\s+nào|không\\s+còn)\\b.*$"
ACTIVE = "\\b(?:đang\\s+(?:ở\\s+)?(?:trạng\\s+thái\\s+)?(?:open|active|in[ -]?progress)|(?:status|trạng\\s+thái)\\s*(?:là|:|-)?\\s*(?:open|active|in[ -]?progress))\\b"
VAGUE = "^(?:nay|do|kia|ay|cu|moi|con|rieng|chinh\\s+thuc|truoc|sau|tiep\\s+theo|a|b|c|x|y|z)(?:\\b|$)"
FILLER = "\\s+(?:của\\s+(?:em|anh|chị|tôi|mình)|này|đó|kia|ấy)\\s*$"
NUMBERED = "^TASK[-_ ]?\\d+\\s*[-:–—]\\s*"
EDGE = " \t\r\n\"“”'`:-–—"


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, "^[\\s\"“”'`:\\-–—]+|[\\s\"“”'`:\\-–—]+$", "")


def label_of(text: Column, quoted: bool) -> Column:
    """A reference's label, or an empty text if it means no task in particular."""
    out = _bare(F.regexp_replace(text, "(?U)\\s+", " "))
    out = out if quoted else F.regexp_replace(out, f"(?iU){STOP}", "")
    out = F.regexp_replace(_bare(F.regexp_replace(out, f"(?iU){FILLER}", "")), f"(?iU){NUMBERED}", "")

    def judged(label: Column, own: Column) -> Column:
        vague = (own == "") | own.rlike(f"(?iU){VAGUE}")
        few = F.size(F.filter(F.split(own, "\\s+"), lambda w: F.length(w) > 1)) < 2
        drop = vague if quoted else vague | (few & ~own.rlike(f"(?iU){DELIVERABLE}"))
        return F.when(drop, "").otherwise(F.concat(F.upper(F.substring(label, 1, 1)), F.substr(label, F.lit(2))))

    return let(out, lambda label: let(F.trim(match_form(label)), lambda own: judged(label, own)))


def references(clauses: DataFrame) -> DataFrame:
    """meeting_id, clause_id, label, confidence and source of each task that a clause names; one of a name per clause, the first."""
    raw = F.col("text_raw")

    def found(pattern: str, quoted: bool) -> Column:
        whole = lambda s: F.substr(raw, s["start"] + 1, s["end"] - s["start"])
        one = lambda s: F.struct(s["start"].alias("at"), label_of(F.call_function("regexp_extract", whole(s), F.lit(f"(?iU){pattern}"), F.lit(1)), quoted).alias("label"), F.lit(quoted).alias("quoted"))
        spans = match_spans(raw, pattern)
        return F.transform(spans if quoted else F.filter(spans, lambda s: ~whole(s).rlike("(?iU)^task\\s*(?:c[oó]\\s+t[eê]n\\s+l[aà]\\s*)?[\"“]")), one)

    rows = clauses.where(raw.rlike("(?iU)\\btask\\b")).select("meeting_id", "clause_id", raw.rlike(f"(?iU){ACTIVE}").alias("active"), F.explode(F.concat(found(QUOTED, True), found(PLAIN, False))).alias("x"))
    rows = rows.select("meeting_id", "clause_id", "active", "x.*").withColumn("name", F.explode(F.filter(F.array(match_form(F.col("label"))), lambda n: n != "")))
    first = F.row_number().over(W.partitionBy("meeting_id", "clause_id", "name").orderBy("at"))
    rows = rows.withColumn("nth", first).where("nth = 1")
    return rows.select(
        "meeting_id", "clause_id", "label", F.when(F.col("active"), 0.98).when(F.col("quoted"), 0.92).otherwise(0.88).alias("confidence"), F.when(F.col("active"), "RULE_REFERENCE_ACTIVE").otherwise("RULE_REFERENCE").alias("source"),
    )
