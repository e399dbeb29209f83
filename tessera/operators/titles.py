"""The title of a meeting: given, written in the transcript, or the topic of a sentence that opens it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import let
from tessera.operators.final import TECHNICAL

# A title line, sentences that name a topic (with what stands before it), and what a topic loses or becomes.
TITLE_LINE = "(?im)^TITLE:\\s*(.+?)\\s*$"
TOPICS = (
    ("\\b(?:điểm\\s+qua|review)\\s+(?:các\\s+)?(?:đầu\\s+việc|nội\\s+dung)\\s+chính\\s*:\\s*(.+)", ""),
    ("\\bhôm nay\\b.*?\\b(?:có\\s+)?cuộc\\s+họp\\s+(.+)", ""),
    ("\\bhôm nay\\b.*?\\bhọp(?:\\s+nhanh)?\\s+về\\s+(.+)", ""),
    ("\\bhôm nay\\b.*?\\bhọp(?:\\s+nhanh)?\\s+để\\s+(?:bàn(?:\\s+về)?\\s+)?(.+)", ""),
    ("\\bhôm nay\\b.*?\\bsẽ\\s+bàn(?:\\s+về)?\\s+(.+)", ""),
    ("\\bhôm nay\\b.*?\\bsẽ\\s+rà\\s+soát\\s+(.+)", "Rà soát "),
    ("\\bhôm nay\\b.*?\\bcần\\s+(?:thống nhất|trao đổi)\\s+(.+)", ""),
)
CUT = "\\b(?:nhé|nha|ạ|thôi)\\b.*$"
LEAD = "^(?:cùng\\s+nhau\\s+)?(?:nghĩ\\s+ra|thảo\\s+luận)\\s+(?:các\\s+)?(?:hướng|phương án)\\s+"
PROGRESS = "^(?:check|kiểm tra)\\s+tiến độ\\s+"
OPENING_LINES = 20


def embedded(transcript: Column) -> Column:
    return F.trim(F.regexp_extract(transcript, TITLE_LINE, 1))


def shown(title: Column) -> Column:
    """A title for people; ids count as none."""
    own = F.trim(F.coalesce(title, F.lit("")))
    return F.when(own.rlike(f"(?i){TECHNICAL}"), "").otherwise(own)


def _topic(line: Column) -> Column:
    def cleaned(found: Column, before: str) -> Column:
        out = F.regexp_replace(F.element_at(F.split(found, "[.!?]", 2), 1), f"(?iU){CUT}", "")
        out = F.regexp_replace(F.regexp_replace(out, f"(?iU){LEAD}", ""), "^[ ,:;.-]+|[ ,:;.-]+$", "")
        out = F.regexp_replace(out, f"(?iU){PROGRESS}", "tiến độ ")
        change = F.lower if before else F.upper
        return let(out, lambda t: F.when(t != "", F.trim(F.concat(F.lit(before), change(F.substring(t, 1, 1)), F.substr(t, F.lit(2))))))

    return F.coalesce(*(F.when(line.rlike(f"(?iU){p}"), cleaned(F.regexp_extract(line, f"(?iU){p}", 1), before)) for p, before in TOPICS))


def inferred(transcript: Column) -> Column:
    """The topic of the first of the opening lines that names one, or an empty text."""
    def bare(line: Column) -> Column:
        out = F.regexp_replace(line, "^\\s*(?:T\\d+\\s+)?\\[[^\\]]+\\]\\s*", "")
        return F.trim(F.regexp_replace(out, "^[^:]{1,80}:\\s*", ""))

    lines = F.filter(F.transform(F.slice(F.split(transcript, "\r\n|\r|\n"), 1, OPENING_LINES), bare), lambda x: (x != "") & ~F.contains(x, F.lit("-->")))
    topics = F.array_compact(F.transform(lines, _topic))
    return F.coalesce(F.try_element_at(topics, F.lit(1)), F.lit(""))


def title(given: Column, transcript: Column, fallback: Column) -> Column:
    """The first of: the title line, the given title unless it is an id, the topic, the fallback."""
    empty = lambda c: F.nullif(c, F.lit(""))
    text = F.coalesce(transcript, F.lit(""))
    return F.coalesce(empty(embedded(text)), empty(shown(given)), empty(inferred(text)), F.coalesce(fallback, F.lit("")))
