"""Meetings of many shapes of sentences, in Vietnamese and English, made from the `events` table, and the rules as SQL.

The shape of a clause is event_id modulo their number; {k} is the number in `props`, {p} a participant. The SQL side states
the same rules again for another engine: patterns are translated (`re2`), not their results.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import normalized, once, sequence_id
from tessera.operators import cues, dates
from tessera.plans.rendered import ORDERED_SQL, _ordered

SHAPES = (
    "I will prepare report {k} by 2024-02-13",
    "Tomorrow we will send invoice {k}",
    "Cancel task {k}",
    "Move to 2024-03-05 for task {k}",
    "Maybe we should review page {k} before Friday",
    "Em sẽ gửi báo cáo doanh thu {k} trước thứ sáu",
    "{p} hãy kiểm tra dashboard {k} nhé",
    "Hủy task {k}, không cần làm nữa",
    "Đổi thành ngày 5/3/2024 cho task {k}",
    "Có cần cập nhật tài liệu {k} không",
    "Dạ vâng, em nhận",
    "Đã hoàn thành migration {k} rồi",
    "Nếu rảnh thì mình sẽ viết spec {k}",
    "Tổng kết lại các đầu việc",
    "Tạm dừng phần tài liệu {k} ở đây",
    "ok",
    "Mất tiếng rồi, nghe rõ không",
    "Task Budget report {k} đang active",
    "Anh muốn hỏi tiến độ release {k}",
    "{p} phụ trách cấu hình sandbox {k} trong vòng 3 ngày làm việc",
    "Em đang xử lý pipeline {k}",
    "Gửi meeting notes {k} sau cuộc họp",
    "We could discuss later about board {k}",
    "Final recap: task {k} còn lại",
    "Xin trả lại task {k}",
    "Bắt đầu từ thứ hai tuần sau",
    "Deadline là ngày 20/02/2024",
    "{p}, please send the draft {k} within 2 working days",
    "Hoàn thành",
    "Cập nhật lại task {k}",
    "It",
    "Chuyển sang chủ đề ngân sách {k}",
    "Thứ hai hoặc thứ ba đều được",
    "Trực an ninh {k} từ thứ năm",
    "Giao cho {p} viết kịch bản kiểm thử {k} trước ngày 21/02/2024",
    "Tôi sẽ thiết kế wireframe {k} và cập nhật kết quả",
    "Mình xác nhận deadline ngày mai",
    "Em sẽ làm như vậy",
    "No new tasks in this meeting today",
    "Chốt danh sách cuối cùng",
    "Recap lại tổng thể",
)

NAMES = ("An", "Bình", "Chi", "Dũng")


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_id, clause_id, order_index, speaker_name, text_raw, text_normalized."""
    names, shapes = F.array(*map(F.lit, NAMES)), F.array(*map(F.lit, SHAPES))
    name = lambda n: F.element_at(names, (n % len(NAMES)).cast("int") + 1)
    text = F.element_at(shapes, (F.col("event_id") % len(SHAPES)).cast("int") + 1)
    text = F.replace(F.replace(text, F.lit("{k}"), F.col("k")), F.lit("{p}"), name(F.floor(F.col("event_id") / 7)))
    rows = _ordered(spark, sf_dir).withColumn("text_raw", text)
    return rows.select(
        "meeting_id", sequence_id("CLAUSE", F.col("order_index") + 1).alias("clause_id"), "order_index", name(F.col("event_id")).alias("speaker_name"), "text_raw",
        normalized(F.col("text_raw")).alias("text_normalized"),
    )


def has_date() -> F.Column:
    """Whether any of the rules for dates matches."""
    return F.col("text_normalized").rlike("(?iU)" + "|".join(f"(?:{p})" for _, _, p in dates.RULES))


def annotated(spark: SparkSession, sf_dir: str, more: Callable[[DataFrame], DataFrame] = lambda texts: texts) -> DataFrame:
    """Clauses with their flags and what `more` adds to texts; each distinct text is searched once."""
    texts = lambda t: more(cues.annotated(t.withColumn("text_normalized", normalized(F.col("text_raw"))), has_date()))
    return once(said(spark, sf_dir).drop("text_normalized"), ["text_raw"], texts)


# -- the same in SQL ---------------------------------------------------------------------------------------------------

_W = "[\\pL\\pN_]"
_NOT_W = "[^\\pL\\pN_]"


def re2(pattern: str) -> str:
    """A pattern of Java or Python in the syntax of RE2, whose \\b and \\w know ASCII only: a word's edge becomes a character
    that is no letter, or an end of the text."""
    out = re.sub(r"\(\?<[!=](?:[^()]|\([^()]*\))*\)", "", pattern)  # look-behinds: see the rules that use them
    out = out.replace("[\\wÀ-ỹ'-]", "[\\pL\\pN_'-]").replace("[\\w'-]", "[\\pL\\pN_'-]").replace("\\b.+\\b", f"{_NOT_W}(?:.*{_NOT_W})?").replace("\\b.*\\b", f"(?:{_NOT_W}.*{_NOT_W}|{_NOT_W})")
    pieces = out.split("\\b")
    for i in range(1, len(pieces)):
        before = pieces[i - 1]
        after_token = before != "" and not before.endswith(("(", "|", "(?:", "^", "\\s+", "\\s*"))
        pieces[i] = (f"(?:$|{_NOT_W})" if after_token else f"(?:^|{_NOT_W})") + pieces[i]
    return "".join(pieces).replace("\\w", _W)


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def matches(column: str, *patterns: str) -> str:
    """SQL that is true if any pattern is found, upper and lower case alike."""
    return "(" + " OR ".join(f"regexp_matches({column}, {sql_text('(?i)' + re2(p))})" for p in patterns) + ")"


def norm_sql(column: str) -> str:
    out = f"trim(regexp_replace(replace(lower({column}), 'ß', 'ss'), '\\s+', ' ', 'g'))"
    return out


def match_sql(column: str) -> str:
    return f"regexp_replace(strip_accents(replace({norm_sql(column)}, 'đ', 'd')), '[^\\pL\\pN_\\s:/.-]', '', 'g')"


SAID_SQL = (
    ORDERED_SQL
    + f""", said AS (
  SELECT meeting_id, printf('CLAUSE-%06d', order_index + 1) AS clause_id, order_index, [{', '.join(map(sql_text, NAMES))}][event_id % {len(NAMES)} + 1] AS speaker_name,
    replace(replace([{', '.join(map(sql_text, SHAPES))}][event_id % {len(SHAPES)} + 1], '{{k}}', k), '{{p}}', [{', '.join(map(sql_text, NAMES))}][event_id // 7 % {len(NAMES)} + 1]) AS text_raw
  FROM ordered
)"""
)

_NORMAL = "lower(text_raw)"
_GUARDED = next(p for p in cues.PATTERNS["DIRECT_ASSIGNMENT"] if "(?<!" in p)
_TENSED = "\\b(?:em|anh|chị|bạn)\\s+(?:đã|sẽ|đang|vừa|mới)\\s+(?:tạo|chuẩn bị|gửi|hoàn thành|cập nhật|viết|soạn|test|fix|build)\\b"


def _flag_sql(name: str, patterns: tuple[str, ...]) -> str:
    tests = [matches(_NORMAL, p) for p in patterns if p != _GUARDED]
    if _GUARDED in patterns:
        tests.append(f"({matches(_NORMAL, _GUARDED)} AND NOT {matches(_NORMAL, _TENSED)})")
    return f"CASE WHEN {' OR '.join(tests)} THEN '{name}' END"


_QUESTION_SQL = f"regexp_matches(trim(regexp_replace(text_raw, {sql_text('(?i)' + re2(cues.TRAILING.replace('(?iU)', '')))}, '')), {sql_text('(?i)' + re2(cues.QUESTION.replace('(?iU)', '')))})"

HAS_DATE_SQL = matches(_NORMAL, *(p for _, _, p in dates.RULES))

SAID_FLAGS_SQL = (
    SAID_SQL
    + f""", flagged AS (
  SELECT *, list_sort(list_filter([{', '.join(_flag_sql(n, p) for n, p in cues.PATTERNS.items())},
    CASE WHEN {_QUESTION_SQL} THEN 'ROOT_QUESTION' END,
    CASE WHEN {matches('text_raw', cues.LABEL.replace('(?iU)', ''))} THEN 'EXPLICIT_TASK_LABEL' END,
    CASE WHEN {matches(_NORMAL, '\\b(?:' + '|'.join(cues.VERBS) + ')\\b')} THEN 'ACTION_VERB' END,
    CASE WHEN {HAS_DATE_SQL} THEN 'DATE_MENTION' END], lambda x: x IS NOT NULL)) AS flags FROM said
)"""
)


def words_sql(column: str) -> str:
    return f"list_filter(regexp_split_to_array({column}, '[^\\pL\\pN_]+'), lambda w: w <> '')"


def keywords_sql(column: str, limit: int = 8) -> str:
    """The first distinct keywords of a text."""
    from tessera.functions.text import STOPWORDS

    kept = (
        f"list_filter({words_sql(match_sql(column))}, lambda w: length(w) >= 3 AND w NOT IN ({', '.join(map(sql_text, STOPWORDS))})"
        " AND NOT regexp_matches(w, '^(?:\\d+|dl|ddl|due|deadline|eta|han|thu|ngay|tuan|am|pm)$'))"
    )
    return f"list_filter({kept}, lambda w, i: list_position({kept}, w) = i)[1:{limit}]"
