"""Task events from the recaps of a meeting: which block of clauses is the recap, and what its rows say.

The last final recap counts if it yields two rows or more: as numbered rows, else as quoted tasks or labels with owners, else as
bullets, else as sections under an owner's name. Otherwise the best block after any recap marker, read by an ordered grammar
of owner and action; otherwise the clauses right after a marker, by the participants named in them. All forms of a row are
columns of one table of raw rows, so that actions and owners are put into form once; which form counts is decided by numbers
of rows per meeting.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import let, match_form, plain
from tessera.operators.cues import VERBS
from tessera.operators.dates import mentions
from tessera.operators.extraction import ROLES, VERBS_BY_LENGTH, WORD, clean_action, is_concrete, participants_of
from tessera.operators.temporal import match_spans, purpose

# What begins a recap, and a final one; short answers between its rows.
MARKER = (
    "\\b(?:tổng kết|chốt lại|recap|vậy thống nhất|thống nhất lại|thống nhất như sau|action items?|các đầu việc|danh sách công việc|final list|"
    "(?:tôi|anh|em|mình|i)\\s+điểm\\s+qua)\\b"
)
FINAL_MARKER = (
    "\\b(?:recap\\s+(?:lần\\s+)?cuối|recap\\s+lại\\s+tổng\\s+thể|recap\\s+lại\\s+các\\s+task\\s+đã\\s+giao|tổng\\s+kết\\s+(?:lần\\s+)?cuối|tổng\\s+kết\\s+toàn\\s+bộ|"
    "tổng\\s+cộng\\s+các\\s+task\\s+hiện\\s+tại|final\\s+list|final\\s+recap|trạng\\s+thái\\s+cuối|điểm\\s+(?:nhanh\\s+)?trạng\\s+thái\\s+từng\\s+task|"
    "(?:tôi|anh|em|mình|i)\\s+điểm\\s+qua)\\b"
)
ACKNOWLEDGED = "^(?:vâng|dạ|ok|okay|đồng ý|rõ|chính xác|anh nhắc đúng|em không thấy thiếu|không có duplicate)[.!]?$"
FOLLOWERS, BRIDGE, STRUCTURED_FOLLOWERS, NAMED_FOLLOWERS, LATE_PART = 34, 3, 6, 3, 0.45

# Rows of a recap.
NUMBERED = "^(?:và\\s+)?task\\s+([A-Z0-9]+)\\s*(?:-|–|:)\\s*(.+)$"
UNNUMBERED = f"^(?:và\\s+)?task\\s+(.+?)(?:\\s+mới)?\\s*,\\s*(?:owner|do)\\s+({WORD})(.*)$"
INLINE = '\\btask\\s+["“]([^"”]+)["”]\\s*(?:[:\\-–—])\\s*(.*?)(?=\\btask\\s+["“]|$)'
COMPACT = "(?<!\\w)([A-Z])\\s*\\(([^)]*)\\)"
BULLET = "(?s)(?:^|\\s)-\\s+(.*?)(?=(?:\\s-\\s+)|$)"
HEADING = f"^({WORD})\\s*:\\s*(.+)$"
MYSELF = "^(?:anh|tôi|em|i)\\s+sẽ\\s+(.+)$"
MYSELF_FOLLOWS = "^(?:anh|tôi|em|i)\\s+sẽ\\b"
ROW_CANCELLED = "\\b(?:đã\\s+)?(?:hủy|cancel(?:led)?)\\b"
INLINE_CANCELLED = "\\b(?:đã\\s+hủy|hủy|cancelled|rejected)\\b"
ROW_END = "\\s+(?:-|–)\\s+(?:đang|chờ|đã|deadline|hạn)\\b|,\\s*(?:đang|chờ|đã|deadline|hạn)\\b"
OWNED = f"\\b(?:owner|do)\\s+({WORD})\\b"
INLINE_OWNER = "\\bowner\\s+(.+?)(?=\\s*,\\s*(?:deadline|dl|reviewer)\\b|$)"
BULLET_END = "\\s*,\\s*(?:dl|deadline|hạn|không deadline|k dl|chưa có deadline)\\b"
NO_ROW = "\\b(?:chưa\\s+chốt|không\\s+(?:phải|có)\\s+task|distractor|bỏ\\s+qua|đã\\s+hủy)\\b"
SHIFT = "\\b(?:từ|from)\\b"
QUALIFIER = (
    "\\b((?:từ|from)\\s+(?:thứ\\s+[\\wÀ-ỹ]+|monday|tuesday|wednesday|thursday|friday|saturday|sunday)|"
    "(?:đến(?:\\s+hết)?|until|through)\\s+(?:thứ\\s+[\\wÀ-ỹ]+|monday|tuesday|wednesday|thursday|friday|saturday|sunday))\\b"
)
ANONYMOUS, TEST_DATA = "\\b(?:đang\\s+)?ẩn\\s+danh\\b", "\\b(?:dữ\\s+liệu|data)\\s+test\\b"
BARE_TIME = "(?:tu|den|truoc|sau|trong|khong|chua|deadline|han)\\b"
BARE_OBJECT_TIME = "\\b(?:deadline|han|khong|chua|tu|den|truoc|sau)\\b"

# Definitions and new names of lettered or numbered tasks, and who owns them.
DEFINITION = '\\btask\\s+([A-Z0-9]+)\\s*(?:[:\\-–])\\s*[“"]([^”"]+)[”"](.*?)(?=\\btask\\s+[A-Z0-9]+\\s*(?:[:\\-–])|$)'
RENAME = '\\btask\\s+([A-Z0-9]+)\\b.*?(?:chính\\s+thức\\s+là|đổi\\s+tên(?:\\s+thành)?|renamed?\\s+to)\\s*[“"]([^”"]+)[”"]'
DEFINITION_OWNERS = (
    f"\\b(?:chuyển|bàn\\s+giao)\\s+từ\\s+{WORD}\\s+sang\\s+({WORD})", f"\\b(?:do|owner(?:\\s+is)?|phụ\\s+trách\\s+bởi)\\s+({WORD})(?:\\s+phụ\\s+trách)?",
    f"\\b({WORD})\\s+(?:phụ\\s+trách|chịu\\s+trách\\s+nhiệm)\\b",
)

# How names of things become actions: on the action or its match form, which pattern, what stands before, and what of it stays.
NAMED_THINGS = (
    ("match", "^(?:release notes?|release note)\\b", "Viết ", "all"),
    ("action", "^(?:hướng dẫn|tai lieu|tài liệu)\\b", "Viết ", "lower"),
    ("action", "^(?:login|đăng nhập|dang nhap)\\b", "Fix lỗi login ", "rest"),
    ("action", "^(?:data|dữ liệu|du lieu)\\s+test\\b", "Chuẩn bị data test ", "rest"),
    ("action", "^(?:staging|môi trường|moi truong)\\b", "Chuẩn bị ", "all"),
    ("action", "^release\\s+plan\\b", "Lập ", "all"),
    ("action", "^dashboard\\b", "Cập nhật ", "all"),
    ("match", "^(?:sp365\\s+display|display\\s+sp365)\\b", "Hiển thị SP365", "none"),
    ("match", "^update\\s+documentation\\b", "Cập nhật tài liệu ", "rest"),
)
NO_OWNER = ("em", "anh", "chi", "toi", "ban", "task", "recap", "tong", "moi", "nguoi", "ticket", "cac")
OWNERS_APART = "\\s*(?:;|,|&|\\bvà\\b|\\band\\b)\\s*"
OWNER_TITLE = "^(?:anh|chị|chi|em|ms\\.?|mr\\.?|mrs\\.?)\\s+"

# Parts of a recap in one text, and its rows, in the order in which they are tried (action, owner, tail by group).
LEAD = (
    "^.*?\\b(?:chốt\\s+lại|recap(?:\\s+lại)?|tổng\\s+kết(?:\\s+lại)?|thống\\s+nhất(?:\\s+lại)?|các\\s+task\\s+chính|các\\s+đầu\\s+việc|"
    "toàn\\s+bộ\\s+công\\s+việc|action\\s+items?|(?:tôi|anh|em|mình|i)\\s+điểm\\s+qua)\\s*:\\s*"
)
DASH, ORDINAL = "(?:^|\\s)-\\s+(?=\\S)", "\\b(?:(?:đầu\\s+tiên|thứ\\s+(?:nhất|hai|ba|tư|năm|sáu|bảy|tám))\\s*[,.:]\\s*|(?:một|hai|ba|bốn|năm|sáu)\\s+là\\s+)"
OTHERS = "^(?:(?:các|những)\\s+(?:task|phần|việc)\\s+khác\\b|all\\s+other\\s+tasks?\\b)"
_PERSON = f"(?:(?:anh|chị|chi|ms\\.?|mr\\.?|mrs\\.?)\\s+)?{WORD}"
_PEOPLE = f"({_PERSON}(?:\\s+(?:và|and|&|;)\\s+{_PERSON})*)"
ROW_FORMS = (
    (f"^(?:task\\s+)?(.+?)\\s*:\\s*{_PEOPLE}(\\s*,?.*)$", 1, 2, 3),
    (f"^{_PEOPLE}\\s*(?:-|–|:)\\s*(.+?)(\\s*)$", 2, 1, 3),
    (f"^(.+?)\\s*(?:-|–)\\s*{_PEOPLE}\\s*(?:-|–)\\s*(.*)$", 1, 2, 3),
    (f"^(.+?)\\s*(?:-|–)\\s*{_PEOPLE}(\\s*,.*)$", 1, 2, 3),
    (f"^{_PEOPLE}\\s+(?:có\\s+\\w+\\s+task\\s*:\\s*)?(.+?)(\\s*)$", 2, 1, 3),
)
COUNTED = "^(?:một|hai|ba|bốn|năm|sáu)\\s+là\\s+"
NO_STRUCTURED_ACTION = "\\b(?:recap|tong ket|task chinh|dau viec)\\b"
PIECES = (
    "(?<=\\))\\s*(?:,|và|and)\\s*|,\\s*(?=(?:backup|update|cập nhật|tài liệu|documentation|fix|review|test|regression|monitoring|viết|soạn|chuẩn bị|báo\\s+tiến\\s+độ)\\b)"
)
PROGRESS = "^(?:báo|cập nhật)\\s+tiến\\s+độ\\b"

# What follows a participant whose action stands before, what ends an action, and what isn't to be done.
OWNS_BEFORE = "^\\s*(?:đang làm|phụ trách|đảm nhận|chịu trách nhiệm|đang xử lý|owns?|is responsible)"
SEGMENT_END = "[,;]\\s*(?:cố gắng|chưa|không có|báo|cập nhật tiến độ|kèm|thứ\\s+(?:hai|ba|tư|năm|sáu|bảy)|chủ nhật|\\d{1,2}[/-]\\d{1,2})\\b"
TOGETHER, JOINS_ACTIONS = "^\\s*(?:và|and|&)\\s*$", "\\b(?:và|and|đồng thời|ngoài ra)\\s*$"
NOT_TO_DO = "\\b(?:không còn|hủy|bỏ|dừng|cancel)\\b"
COMPANION = "\\bkèm\\s+(tài liệu(?:\\s+hướng dẫn)?[^,;.]*)"
SHORT_WEEKDAY = (
    "\\b(?:(?:hạn(?:\\s+chót)?|deadline)\\s+)?(?:thứ\\s+(?:hai|ba|tư|năm|sáu|bảy)|chủ\\s+nhật|monday|tuesday|wednesday|thursday|friday|saturday|sunday)"
    "(?:\\s+(?:tuần\\s+sau|tuần\\s+tới|next\\s+week))?\\b"
)

RAW = ("meeting_id", "clause_id", "order_index", "form", "place", "kind", "raw", "known", "owner_raw", "other_owner_raw", "known_owner", "segment")


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iU){pattern}")


def _part(text: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(text, f"(?iU){pattern}", n)


def _all(text: Column, pattern: str, *groups: int) -> Column:
    """Every match, as structs g0, g1, ..."""
    parts = [F.regexp_extract_all(text, F.lit(f"(?iU){pattern}"), F.lit(n)) for n in groups]
    return F.arrays_zip(*[p.alias(f"g{i}") for i, p in enumerate(parts)])


def _first_piece(text: Column, pattern: str) -> Column:
    return F.element_at(F.split(text, f"(?iU){pattern}", 2), 1)


def owners_of(value: Column, participants: Column) -> Column:
    """Participants, roles and capitalised names in a text, joined by `; `."""
    def one(raw: Column) -> Column:
        bare = F.trim(F.regexp_replace(raw, f"(?iU){OWNER_TITLE}", ""))
        named = F.substring(raw, 1, 1).rlike("(?U)^\\p{Lu}") & ~match_form(raw).isin(*NO_OWNER)
        known = F.coalesce(F.try_element_at(participants, match_form(raw)), F.try_element_at(participants, match_form(bare)))
        return F.when(match_form(raw) == "", None).otherwise(F.coalesce(known, F.when(match_form(raw).isin(*ROLES) | named, raw)))

    parts = F.transform(F.split(value, f"(?iU){OWNERS_APART}"), lambda x: F.trim(x))
    return F.array_join(F.array_distinct(F.array_compact(F.transform(parts, one))), "; ")


def recap_action(raw: Column) -> Column:
    """What is to be done by a recap's row: an action, or the name of a thing with what is done to it; empty for less than two words."""
    def named(action: Column, form: Column, concrete: Column) -> Column:
        out = F.when(_has(action, "^monitoring\\b"), F.concat(F.lit("Cấu hình "), action)).when(concrete, action)
        for on, pattern, before, kept in NAMED_THINGS:
            rest = F.regexp_replace(action, f"(?iU){pattern}", "")
            part = {"all": action, "rest": rest, "lower": F.concat(F.lower(F.substring(action, 1, 1)), F.substr(action, F.lit(2))), "none": F.lit("")}[kept]
            out = out.when(_has(action if on == "action" else form, pattern), F.concat(F.lit(before), part))
        return out.when(F.size(F.split(form, " ")) >= 2, action).otherwise("")

    def whole(action: Column) -> Column:
        return let(F.struct(match_form(action).alias("form"), is_concrete(action).alias("concrete")), lambda x: named(action, x["form"], x["concrete"]))

    cleaned = let(clean_action(raw), lambda a: let(whole(a), lambda out: F.when(out == a, a).otherwise(clean_action(out))))
    return F.when(F.coalesce(raw, F.lit("")) == "", "").otherwise(cleaned)


def definitions(clauses: DataFrame, participants: DataFrame) -> DataFrame:
    """meeting_id, label, action, owner: what `Task A: "..."` was last said to be, and its last owner."""
    text = F.col("text_raw")
    none = F.lit("").alias("g2")
    renamed = F.transform(_all(text, RENAME, 1, 2), lambda x: F.struct(x["g0"].alias("g0"), x["g1"].alias("g1"), none))
    rows = clauses.select("meeting_id", "order_index", F.posexplode(F.concat(_all(text, DEFINITION, 1, 2, 3), renamed)).alias("place", "x"))
    rows = rows.join(participants, "meeting_id")
    name = F.coalesce(*(F.nullif(_part(F.col("x.g2"), p, 1), F.lit("")) for p in DEFINITION_OWNERS))
    owner = F.coalesce(F.try_element_at("participants", match_form(name)), name)
    at = F.struct("order_index", "place")
    return rows.groupBy("meeting_id", F.upper("x.g0").alias("label")).agg(
        F.max_by(clean_action(F.col("x.g1")), at).alias("known"), F.coalesce(F.max_by(owner, F.when(owner.isNotNull(), at)), F.lit("")).alias("known_owner"),
    )


def final_block(clauses: DataFrame) -> DataFrame:
    """Clauses of the last final recap: of its speaker, up to where someone else takes up the talk. marks (the marker) and marker_speaker stand with each."""
    own = W.partitionBy("meeting_id")
    order = own.orderBy("order_index")
    text = F.trim("text_raw")
    rows = clauses.withColumn("at", F.row_number().over(order)).withColumn("marker_at", F.max(F.when(_has(F.col("text_raw"), FINAL_MARKER), F.col("at"))).over(own))
    rows = rows.where((F.col("at") >= F.col("marker_at")) & (F.col("at") <= F.col("marker_at") + FOLLOWERS)).withColumn("marks", F.col("at") == F.col("marker_at"))
    first = lambda c: F.first(c).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = rows.withColumn("marker_speaker", first("speaker_name")).withColumn("marker_order", first("order_index"))
    mine = F.col("speaker_name") == F.col("marker_speaker")
    row = mine & ~F.col("marks") & (_has(text, NUMBERED) | _has(text, f"^(?:{WORD})\\s*:") | _has(text, MYSELF_FOLLOWS))
    seen = F.coalesce(F.bool_or(row).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumn("mine", mine).withColumn("stops", ~mine & ~_has(text, ACKNOWLEDGED) & (seen | (F.col("order_index") - F.col("marker_order") > BRIDGE)))
    over = F.bool_or("stops").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("over", over).where("mine and not over").drop("at", "marker_at", "marker_order", "mine", "stops", "over")


def _raw(rows: DataFrame, form: str, **columns: Column) -> DataFrame:
    empty = {c: F.lit("") for c in RAW[5:]} | {"place": F.lit(0), "form": F.lit(form), "kind": F.lit("OWNER_ASSIGN")}
    return rows.select(*[(columns.get(c) if c in columns else empty.get(c, F.col(c))).alias(c) for c in RAW])


def _final_rows(clauses: DataFrame, participants: DataFrame) -> DataFrame:
    """Raw rows of the final recap in each of its forms."""
    block = final_block(clauses)
    known = definitions(clauses, participants)
    text = F.trim("text_raw")
    rows = block.where("not marks").withColumn("t", text)
    t = F.col("t")
    numbered = rows.where(_has(t, NUMBERED)).withColumn("label", F.upper(_part(t, NUMBERED, 1))).withColumn("body", F.trim(_part(t, NUMBERED, 2)))
    numbered = numbered.where(~_has(F.col("body"), ROW_CANCELLED)).join(known, ["meeting_id", "label"], "left")
    lead, body = f"^({WORD})\\s*,", F.col("body")
    led = _has(body, lead)
    source = let(_first_piece(body, ROW_END), lambda s: F.when(led, F.substr(s, F.length(_part(body, f"^{WORD}\\s*,", 0)) + 1)).otherwise(s))
    quiet = F.coalesce("known", F.lit(""))
    numbered = _raw(
        numbered, "NUMBERED", raw=F.when(quiet == "", source).otherwise(""), known=quiet, owner_raw=F.when(led, _part(body, lead, 1)).otherwise(""), other_owner_raw=_part(body, OWNED, 1),
        known_owner=F.coalesce("known_owner", F.lit("")), segment=body,
    )
    loose = rows.where(~_has(t, NUMBERED) & _has(t, UNNUMBERED))
    loose = _raw(loose, "NUMBERED", raw=_part(t, UNNUMBERED, 1), owner_raw=_part(t, UNNUMBERED, 2), segment=F.concat_ws(" ", _part(t, UNNUMBERED, 1), _part(t, UNNUMBERED, 3)))

    texts = block.groupBy("meeting_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "text_raw"))), lambda x: x["text_raw"]), " ").alias("text"),
        F.max(F.when(F.col("marks"), F.col("clause_id"))).alias("clause_id"), F.max("order_index").alias("order_index"),
    )
    exploded = lambda pattern, *groups: texts.select("meeting_id", "clause_id", "order_index", F.posexplode(_all(F.col("text"), pattern, *groups)).alias("place", "x"))
    inline = exploded(INLINE, 1, 2).withColumn("body", F.regexp_replace("x.g1", "^[ .;,]+|[ .;,]+$", ""))
    inline = _raw(
        inline, "INLINE", place=F.col("place"), kind=F.when(_has(F.col("body"), INLINE_CANCELLED), "TASK_CANCEL").otherwise("OWNER_ASSIGN"), raw=F.col("x.g0"), owner_raw=_part(F.col("body"), INLINE_OWNER, 1),
        segment=F.col("body"),
    )
    compact = exploded(COMPACT, 1, 2).withColumn("label", F.upper("x.g0")).join(known, ["meeting_id", "label"])
    compact = compact.where(F.size(F.split(match_form(F.col("known")), " ")) >= 2)
    compact = _raw(compact, "COMPACT", place=F.col("place") + 1000, known=F.col("known"), owner_raw=F.trim(F.element_at(F.split("x.g1", ","), 1)), segment=F.col("x.g1"))
    bullets = exploded(BULLET, 1).withColumn("body", F.regexp_replace("x.g0", "^[ .]+|[ .]+$", "")).where(_has(F.col("body"), HEADING)).join(participants, "meeting_id")
    bullet_owner = F.coalesce(F.try_element_at("participants", match_form(_part(F.col("body"), HEADING, 1))), F.lit(""))
    bullets = _raw(bullets, "BULLET", place=F.col("place"), raw=_first_piece(_part(F.col("body"), HEADING, 2), BULLET_END), known_owner=bullet_owner, segment=F.col("body"))
    return reduce(DataFrame.unionByName, [numbered, loose, inline, compact, bullets, _section_rows(block, clauses, participants)])


def _section_rows(block: DataFrame, clauses: DataFrame, participants: DataFrame) -> DataFrame:
    """Rows under the name of an owner; an action without object takes the one that was said with its verb."""
    order = W.partitionBy("meeting_id").orderBy("order_index")
    rows = block.where("not marks").withColumn("t", F.regexp_replace("text_raw", "^[ ;]+|[ ;]+$", "")).where("t <> '' and not endswith(t, '?')").join(participants, "meeting_id")
    t = F.col("t")
    heading, own = _has(t, HEADING), _has(t, MYSELF)
    owner = F.when(heading, owners_of(F.regexp_replace(_part(t, HEADING, 1), "^[ ,.:;]+|[ ,.:;]+$", ""), F.col("participants"))).when(own, F.col("marker_speaker"))
    raw = F.when(heading, _part(t, HEADING, 2)).when(own, _part(t, MYSELF, 1)).otherwise(t)
    rows = rows.withColumn("owner_here", owner).withColumn("raw", raw)
    rows = rows.withColumn("owner", F.last("owner_here", True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = rows.where(~_has(F.col("raw"), NO_ROW) & (F.coalesce("owner", F.lit("")) != "")).withColumn("cleaned", clean_action(F.col("raw"))).withColumn("concrete", is_concrete(F.col("cleaned")))
    rows = rows.select("meeting_id", "clause_id", "order_index", "raw", "owner", F.explode(F.array(F.struct("cleaned", "concrete"))).alias("c")).select("meeting_id", "clause_id", "order_index", "raw", "owner", "c.*")

    plain_verbs = sorted({plain(v) for v in VERBS}, key=lambda v: (-len(v), v))
    form = match_form(F.col("cleaned"))
    verb = F.coalesce(*(F.when((form == v) | form.startswith(v + " "), v) for v in plain_verbs), F.element_at(F.split(form, " "), 1))
    bare = rows.where(~F.col("concrete") & (form != "")).select("meeting_id", F.col("clause_id").alias("bare_id"), F.col("order_index").alias("bare_order"), "cleaned", verb.alias("verb"))
    said = clauses.select("meeting_id", "order_index", match_form(F.col("text_raw")).alias("said"))
    pattern = F.concat(F.lit("(?iU)\\b("), F.regexp_replace("verb", "([^\\p{L}\\p{N} ])", "\\\\$1"), F.lit(f"\\s+(?!{BARE_TIME})[^,.;!?]{{2,60}})"))
    near = bare.join(said, "meeting_id").where("order_index < bare_order").withColumn("phrase", F.call_function("regexp_extract", F.col("said"), pattern, F.lit(1))).where("phrase <> ''")
    thing = F.trim(F.substr("phrase", F.length("verb") + 1))
    near = near.withColumn("thing", thing).where(~F.col("thing").rlike(f"(?U){BARE_OBJECT_TIME}")).withColumn("whole", clean_action(F.concat_ws(" ", "cleaned", "thing"))).where(is_concrete(F.col("whole")))
    shortest = F.struct(F.size(F.split(match_form(F.col("whole")), " ")), -F.col("order_index"), "whole")
    near = near.groupBy("meeting_id", F.col("bare_id").alias("clause_id")).agg(F.min_by("whole", shortest).alias("whole"))
    rows = rows.join(near, ["meeting_id", "clause_id"], "left")
    action = F.when(F.col("concrete"), F.col("cleaned")).otherwise(F.coalesce("whole", F.lit("")))
    only_verb = match_form(F.col("cleaned")).isin(*plain_verbs)
    qualified = let(_part(F.col("raw"), QUALIFIER, 1), lambda q: F.when((q != "") & only_verb & (action != ""), F.concat_ws(" ", action, F.trim(q))).otherwise(action))
    return _raw(rows, "SECTION", known=qualified, known_owner=F.col("owner"), segment=F.when(_has(F.col("raw"), SHIFT), "").otherwise(F.col("raw")))


def _chosen(rows: DataFrame) -> DataFrame:
    """Of the rows of the final recap those of the form that counts."""
    rows = rows.withColumn("n", F.count("*").over(W.partitionBy("meeting_id", "form")))
    of = lambda *forms: F.coalesce(F.max(F.when(F.col("form").isin(*forms), F.col("n"))).over(W.partitionBy("meeting_id")), F.lit(0))
    rows = rows.withColumns({"numbered": of("NUMBERED"), "inline": of("INLINE"), "compact": of("COMPACT"), "bullet": of("BULLET")})
    form = (
        F.when(F.col("numbered") >= 2, F.array(F.lit("NUMBERED"))).when(F.col("inline") >= 2, F.array(F.lit("INLINE"))).when(F.col("inline") + F.col("compact") >= 1, F.array(F.lit("INLINE"), F.lit("COMPACT")))
        .when(F.col("bullet") >= 2, F.array(F.lit("BULLET"))).otherwise(F.array(F.lit("SECTION")))
    )
    return rows.where(F.array_contains(form, F.col("form"))).drop("n", "numbered", "inline", "compact", "bullet")


def _formed(raw: DataFrame, participants: DataFrame) -> DataFrame:
    """Raw rows with action_text and assignee; those that lack one are dropped (a cancelled task needs no owner)."""
    found = raw.join(participants, "meeting_id")
    people = F.col("participants")
    owner = F.coalesce(*(F.nullif(x, F.lit("")) for x in (owners_of(F.col("owner_raw"), people), owners_of(F.col("other_owner_raw"), people), F.col("known_owner"))), F.lit(""))
    action = F.when(F.col("known") != "", F.col("known")).otherwise(recap_action(F.col("raw")))
    action = F.when((F.col("form") == "NUMBERED") & _has(F.col("segment"), ANONYMOUS) & _has(action, TEST_DATA), "Ẩn danh dữ liệu test").otherwise(action)
    ready = found.withColumn("x", F.explode(F.array(F.struct(action.alias("action_text"), owner.alias("assignee")))))
    return ready.select("meeting_id", "clause_id", "order_index", "form", "place", F.col("kind").alias("event_type"), "x.*", "segment").where("action_text <> '' and (assignee <> '' or event_type = 'TASK_CANCEL')")


def structured(clauses: DataFrame, participants: DataFrame) -> DataFrame:
    """Rows of the best block after a recap marker in the last part of a meeting: the most rows, of these the latest block."""
    order = W.partitionBy("meeting_id").orderBy("order_index")
    size = F.count("*").over(W.partitionBy("meeting_id"))
    later = F.collect_list(F.struct("speaker_name", "text_raw", "order_index")).over(order.rowsBetween(1, STRUCTURED_FOLLOWERS))
    rows = clauses.withColumn("n", size).withColumn("later", later).where((F.col("order_index") >= F.floor(F.col("n") * LATE_PART)) & _has(F.col("text_raw"), MARKER))
    ends = F.array_position(F.transform("later", lambda x: x["speaker_name"] == F.col("speaker_name")), F.lit(False))
    block = F.when(ends > 0, F.slice("later", F.lit(1), F.greatest(ends - 1, F.lit(0)).cast("int"))).otherwise(F.col("later"))
    rows = rows.withColumn("block", block).withColumn("text", F.concat_ws(" ", "text_raw", F.transform("block", lambda x: x["text_raw"])))
    last = F.when(F.size("block") > 0, F.element_at("block", -1)["order_index"]).otherwise(F.col("order_index"))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", f"(?iU){LEAD}", ""), f"(?U){DASH}", " ||| "), f"(?iU){ORDINAL}", " ||| ")
    items = F.filter(F.transform(F.split(text, "\\|\\|\\||;"), lambda x: F.regexp_replace(x, "^[ .,:;-]+|[ .,:;-]+$", "")), lambda x: x != "")
    rows = rows.select("meeting_id", "clause_id", "order_index", "speaker_name", last.alias("last_order"), F.posexplode(items).alias("item_at", "item"))
    rows = rows.withColumn("item", F.regexp_replace("item", F.lit("(?iU)^(?:tôi|em|i)\\b"), F.regexp_replace("speaker_name", "([\\\\$])", "\\\\\\\\$1"))).where(~_has(F.col("item"), OTHERS))
    item = F.col("item")
    form = lambda p, a, o, t: F.when(_has(item, p), F.struct(_part(item, p, o).alias("who"), _part(item, p, a).alias("what"), _part(item, p, t).alias("tail")))
    rows = rows.withColumn("parsed", F.explode(F.array(F.array(*(form(*f) for f in ROW_FORMS))))).select("*", F.posexplode("parsed").alias("form_at", "p")).where("p is not null")
    what = F.regexp_replace(F.regexp_replace("p.what", "(?iU)^task\\s+", ""), f"(?iU){COUNTED}", "")
    rows = rows.join(participants, "meeting_id").withColumn("what", what).withColumn("x", F.explode(F.array(F.struct(recap_action(F.col("what")).alias("action"), owners_of(F.col("p.who"), F.col("participants")).alias("owner")))))
    good = (F.col("x.action") != "") & ~_has(match_form(F.col("x.action")), NO_STRUCTURED_ACTION) & (F.col("x.owner") != "")
    row = ["meeting_id", "clause_id", "order_index", "last_order", "item_at"]
    best = rows.where(good).groupBy(*row).agg(F.min_by(F.struct("what", "p.tail", "x.owner"), "form_at").alias("r"))
    pieces = F.filter(F.transform(F.split("r.what", f"(?iU){PIECES}"), lambda x: F.regexp_replace(x, "^[ ,]+|[ ,]+$", "")), lambda x: x != "")
    rows = best.select(*row, "r.owner", "r.tail", F.posexplode(pieces).alias("piece_at", "piece")).withColumn("action", F.explode(F.array(recap_action(F.col("piece")))))
    rows = rows.where((F.col("action") != "") & ~_has(F.col("action"), PROGRESS)).withColumn("n", F.count("*").over(W.partitionBy("meeting_id", "clause_id")))
    first = W.partitionBy("meeting_id").orderBy(F.col("n").desc(), F.col("last_order").desc(), "order_index")
    rows = rows.where("n >= 2").withColumn("best", F.first("clause_id").over(first)).where("clause_id = best")
    return rows.select(
        "meeting_id", "clause_id", F.col("last_order").alias("order_index"), F.lit("STRUCTURED").alias("form"), (F.col("item_at") * 100 + F.col("piece_at")).alias("place"), F.lit("OWNER_ASSIGN").alias("event_type"),
        F.col("action").alias("action_text"), F.col("owner").alias("assignee"), F.concat_ws(" ", "piece", "tail").alias("segment"),
    )


def occurrences(text: Column, participants: Column) -> Column:
    """Where participants are named: start, end (from 0, past it) and name, longer names first, none within another."""
    names = F.array_distinct(F.map_values(participants))
    quoted = lambda n: F.concat(F.lit("(?iU)(?<!\\w)"), F.regexp_replace(n, "([^\\p{L}\\p{N} ])", "\\\\$1"), F.lit("(?!\\w)"))

    def spans(name: Column) -> Column:
        gaps = F.transform(F.split(text, quoted(name), -1), lambda x: F.length(x))
        size = F.length(name)
        ends = F.transform(F.slice(gaps, 1, F.size(gaps) - 1), lambda g, i: F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda s, x: s + x) + i * size)
        return F.transform(ends, lambda at: F.struct(at.cast("int").alias("start"), (at + size).cast("int").alias("end"), name.alias("name")))

    found = F.array_sort(F.transform(F.flatten(F.transform(names, spans)), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["name"].alias("name"))))
    none = F.array().cast("array<struct<start:int,back:int,name:string>>")
    apart = F.aggregate(found, none, lambda out, x: F.when((F.size(out) > 0) & (x["start"] < -F.element_at(F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("back"), F.lit("").alias("name"))), out), -1)["back"]), out).otherwise(F.array_append(out, x)))
    return F.transform(apart, lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), x["name"].alias("name")))


def actions_of(segment: Column) -> Column:
    """Every action of a segment: it is cut at verbs that a conjunction joins."""
    verbs = match_spans(segment, f"\\b(?:{VERBS_BY_LENGTH})\\b")
    step = lambda s, m: F.when((F.size(s["starts"]) == 0) | _has(F.substr(segment, s["last"] + 1, m["start"] - s["last"]), JOINS_ACTIONS), F.struct(F.array_append(s["starts"], m["start"]).alias("starts"), m["end"].alias("last"))).otherwise(s)
    starts = F.aggregate(verbs, F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("last")), step)["starts"]
    cut = lambda xs: F.transform(xs, lambda at, i: F.substr(segment, at + 1, F.coalesce(F.try_element_at(xs, (i + 2).cast("int")), F.length(segment)) - at))
    raw = F.transform(let(starts, cut), lambda x: _first_piece(x, SEGMENT_END))
    return F.filter(F.transform(raw, clean_action), is_concrete)


def named_rows(clauses: DataFrame, participants: DataFrame) -> DataFrame:
    """Rows of clauses right after a marker (of its speaker), by the participants named in them."""
    order = W.partitionBy("meeting_id").orderBy("order_index")
    rows = clauses.withColumn("at", F.row_number().over(order)).withColumn("changed", (F.col("speaker_name") != F.coalesce(F.lag("speaker_name").over(order), F.lit(""))).cast("int"))
    rows = rows.withColumn("run", F.sum("changed").over(order)).withColumn("mark", F.last(F.when(_has(F.col("text_raw"), MARKER), F.struct("at", "run")), True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = rows.where((F.col("mark.run") == F.col("run")) & (F.col("at") - F.col("mark.at") <= NAMED_FOLLOWERS)).join(participants, "meeting_id")
    rows = rows.select("meeting_id", "clause_id", "order_index", "text_raw", F.explode(F.array(occurrences(F.col("text_raw"), F.col("participants")))).alias("found")).where(F.size("found") > 0)
    text = F.col("text_raw")
    rows = rows.select("*", F.posexplode("found").alias("i", "who"))
    owns = _has(F.substr(text, F.col("who.end") + 1), OWNS_BEFORE)
    before = F.regexp_replace(F.substr(text, F.lit(1), F.col("who.start")), "[ ,;:-]+$", "")
    before = F.trim(F.regexp_replace(before, "(?s)^.*[;:]", ""))
    verb = match_spans(before, f"\\b(?:{VERBS_BY_LENGTH})\\b")
    first = F.when(owns & (F.size(verb) > 0), clean_action(F.substr(before, F.element_at(verb, 1)["start"] + 1)))
    rows = rows.withColumn("first", F.explode(F.array(first))).withColumn("has_first", F.coalesce(is_concrete(F.col("first")), F.lit(False)))
    after = W.partitionBy("meeting_id", "clause_id").orderBy("i")
    following = F.lead("who.start").over(after)
    joined = F.coalesce(_has(F.substr(text, F.col("who.end") + 1, following - F.col("who.end")), TOGETHER), F.lit(False))
    rows = rows.withColumn("following", following).withColumn("joined", joined)
    rows = rows.withColumn("team", F.sum(F.when(F.coalesce(F.lag("joined").over(after), F.lit(False)), 0).otherwise(1)).over(after))
    team = W.partitionBy("meeting_id", "clause_id", "team").orderBy("i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumns({"owners": F.array_join(F.collect_list("who.name").over(team), "; "), "end": F.last("who.end").over(team), "until": F.last("following").over(team), "leads": F.min("i").over(team) == F.col("i")})
    ahead = rows.where("has_first").select("meeting_id", "clause_id", "order_index", F.col("i").alias("place"), F.lit("").alias("owners"), F.col("first").alias("action_text"), F.col("who.name").alias("assignee"))
    segment = F.substr(text, F.col("end") + 1, F.coalesce("until", F.length(text)) - F.col("end"))
    rest = rows.where("leads and not has_first").withColumn("segment", segment).where(~_has(F.col("segment"), NOT_TO_DO))
    companions = F.filter(F.transform(F.regexp_extract_all("segment", F.lit(f"(?iU){COMPANION}"), F.lit(1)), lambda x: clean_action(F.concat(F.lit("Soạn "), x))), is_concrete)
    rest = rest.select("meeting_id", "clause_id", "order_index", "i", "owners", F.posexplode(F.concat(actions_of(F.col("segment")), companions)).alias("k", "action_text"))
    rest = rest.select("meeting_id", "clause_id", "order_index", (F.col("i") * 100 + 1000 + F.col("k")).alias("place"), F.lit("").alias("x"), "action_text", F.col("owners").alias("assignee"))
    found = ahead.drop("owners").unionByName(rest.drop("x"))
    return found.select("meeting_id", "clause_id", "order_index", F.lit("NAMED").alias("form"), "place", F.lit("OWNER_ASSIGN").alias("event_type"), "action_text", "assignee", F.lit("").alias("segment"))


def events(clauses: DataFrame) -> DataFrame:
    """meeting_id, clause_id, order_index, form, place, event_type, action_text, assignee, segment (what its date is read from) and
    extraction_source of each meeting's recap. clauses: meeting_id, clause_id, order_index, speaker_name, text_raw."""
    people = participants_of(clauses)
    final = _chosen(_formed(_final_rows(clauses, people), people))
    parts = [final.withColumn("rank", F.lit(0)), structured(clauses, people).withColumn("rank", F.lit(1)), named_rows(clauses, people).withColumn("rank", F.lit(2))]
    rows = reduce(DataFrame.unionByName, parts).withColumn("n", F.count("*").over(W.partitionBy("meeting_id", "rank")))
    best = F.min(F.when((F.col("n") >= 2) | (F.col("rank") == 2), F.col("rank"))).over(W.partitionBy("meeting_id"))
    rows = rows.withColumn("best", best).where("rank = best")
    return rows.drop("n", "best").withColumn("extraction_source", F.when(F.col("rank") < 2, "RULE_FINAL_RECAP").otherwise("RULE_RECAP")).drop("rank")


def segment_deadlines(rows: DataFrame) -> DataFrame:
    """rows with deadline_text: the last date in their segment that is a deadline, else the first weekday in it."""
    keyed = rows.withColumn("row_id", F.xxhash64("meeting_id", "clause_id", "form", "place", "segment"))
    own = keyed.where("segment <> ''").select("meeting_id", F.col("row_id").cast("string").alias("clause_id"), F.lit(0).alias("order_index"), F.col("segment").alias("text_raw"), F.lower("segment").alias("text_normalized")).distinct()
    found = mentions(own).join(own.select("clause_id", "text_raw"), "clause_id").where(purpose(F.col("text_raw"), F.col("span_start"), F.col("span_end")) == "DEADLINE")
    last = found.groupBy("clause_id").agg(F.max_by("raw_text", F.struct("span_start", "span_end")).alias("last")).select(F.col("clause_id").cast("long").alias("row_id"), "last")
    short = F.nullif(_part(F.col("segment"), SHORT_WEEKDAY, 0), F.lit(""))
    return keyed.join(last, "row_id", "left").withColumn("deadline_text", F.coalesce("last", short, F.lit(""))).drop("row_id", "last")
