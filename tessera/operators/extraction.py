"""Task events from clauses by rules: what is to be done, by whom, or what becomes of a task.

Each clause yields candidates in a fixed order (an existing task, a promise, a promise with its object in front, and the
kinds of assignment); all are cleaned at once, and the first that is something to do counts. The order of the rules is one
CASE over the clause's flags, so nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import let, match_form, plain, words_of
from tessera.operators.cues import VERBS
from tessera.operators.guards import _guard, leading_verb

# Parts of the patterns below.
WORD = "[\\wÀ-ỹ'-]+"
VERBS_BY_LENGTH = "|".join(sorted(VERBS, key=lambda v: (-len(v), v)))
DAYS = "(?:thứ\\s+(?:hai|ba|tư|năm|sáu|bảy)|chủ\\s+nhật)"

# What an action loses, in this order (each with what stands instead).
TRAILING_DIALOGUE = "[,;]\\s*(?:em|anh|chị|bạn|ban|you)\\s+(?:làm thế nào|thấy sao|có nhận|được không|nhé|please).*$"
DATE_TRAILER = (
    "\\s+(?:dl|deadline|hạn(?:\\s+chót)?|xong\\s+trước|trước|vào|đến|chậm nhất|không muộn hơn|chưa\\s+(?:có\\s+)?deadline|không\\s+(?:có\\s+)?deadline|"
    "k\\s*dl|sau khi|trong vòng|trong tuần|cuối tuần|sáng mai|chiều nay|trong\\s+(?:hôm nay|ngày mai|ngày kia|today|tomorrow|day after tomorrow)|"
    "hôm nay|ngày mai|từ|before|on|by|after|from|within|this week|next week|today|tomorrow)\\b.*$"
)
CUTS: tuple[tuple[str, str], ...] = (
    (TRAILING_DIALOGUE, ""),
    ("[,;]\\s*(?:em|anh|chị|bạn|ban|you)\\s+(?:cứ|tạm|nhớ|hãy|cần|please)\\b.*$", ""),
    (f"\\s*,\\s*(?:cố gắng\\s+)?(?:trước\\s+)?{DAYS}(?:\\s+(?:hoặc|hay)\\s+{DAYS})?\\b.*$", ""),
    ("\\s*,\\s*(?:chưa|không)\\s+có\\s+deadline(?:\\s+cứng)?\\b.*$", ""),
    (f"\\s*\\((?:dl|deadline|hạn|không\\s+(?:có\\s+)?deadline|k\\s*dl|chưa\\s+(?:có\\s+)?deadline|{DAYS}|cuối\\s+ngày|sáng|chiều|tối)\\b[^)]*\\).*$", ""),
    (DATE_TRAILER, ""),
)
STARTS: tuple[tuple[str, str], ...] = (
    ("^(?:vậy\\s+)?còn\\s+(?:phần|việc|task)\\s+", ""),
    (f"^(?:việc|task|phần)\\s+({VERBS_BY_LENGTH})\\b", "$1"),
    ("^(?:cố gắng|tranh thủ|cam kết(?:\\s+sẽ)?|xác nhận(?:\\s+sẽ)?)\\s+", ""),
    ("^((?:gửi|send)\\s+(?:bổ sung|thêm))\\s+có điều\\s+(?:(?:mấy|vài)\\s+)?cái\\s+", "$1 "),
)
ENDS: tuple[tuple[str, str], ...] = (
    ("\\s+(?:và|and|đồng thời|nhé|ạ|please)$", ""),
    ("\\s*\\((?:unresolved|resolved|active|cancelled?|canceled?)\\)?\\s*$", ""),
)
COMPOUND = "\\b(?:và|rồi|sau đó|and then)\\s+((?:viết|soạn|gửi|hoàn thành|hoàn thiện|tạo|build|deploy|write|draft|send|complete)\\b.+)$"
PREPARING = "^(?:tập hợp|thu thập|kiểm tra|rà soát|phân tích|compile|collect|check|review)\\b"
EDGE = " .,:;?!-–—"

# Shapes of promises and assignments.
EXISTING = "^(?:dạ[,.\\s]+|vâng[,.\\s]+)?(?:(?:em|tôi|mình)\\s+)?(?:chỉ\\s+)?còn\\s+(?:mỗi\\s+)?việc\\s+(.+?)(?:,\\s*(?:dự\\s+kiến|chắc|deadline|hạn)\\b|$)"
DISCOURSE = "^(?:(?:ừm|ừ|uhm|vậy|thế|rồi|ok|okay|à)[,\\.\\s]+)+"
FIRST_PERSON = (
    f"^(?:dạ[,\\s]+|vâng[,\\s]+|ok[,\\s]+)?(?:em|tôi|mình|anh|chị|i|we)\\s+(?:xác nhận\\s+)?(?:sẽ|nhận(?:\\s+thay\\s+{WORD})?|phụ trách|will|shall|will own|can take)\\s+(.+)$"
)
FRONTED = "^(?:còn\\s+|riêng\\s+)?([^,;:.!?]{2,50}?)\\s+(?:thì\\s+)?(?:em|tôi|mình|anh|chị|i|we)\\s+(?:sẽ|will|shall)\\s+(.+)$"
ROLE = f"\\b([\\wÀ-ỹ'-]+)\\s+manager\\s+(?:là|is)\\s+({WORD}).*?\\b(?:deadline|hạn)\\s+(?:cho|for)\\s+(.+?)\\s+(?:là|is)\\s+\\d{{1,2}}[/-]\\d{{1,2}}"
EXPLICIT = f"\\b(?:giao|chốt|phân công|nhờ)\\s+(?:cho\\s+)?({WORD})(?:\\s+phụ trách|\\s+làm|\\s+xử lý)?\\s+(.+)$"
OWNER = f"^({WORD}),?\\s+(?:sẽ\\s+|phụ trách\\s+|chịu trách nhiệm\\s+|will\\s+|will own\\s+|owns?\\s+|is responsible for\\s+)(.+)$"
ADDRESS = "^\\s*(?:em|anh|chị|bạn)\\s+"
BODY_START = (
    "^[,\\s]*(?:em|anh|chị|bạn)?\\s*(?:cần xác nhận việc|cần xác nhận|cần|hãy|nhớ|giúp|sẽ là người|sẽ|phụ trách|chịu trách nhiệm|nhận|lo)?\\s*"
)
VOCATIVE = f"^({WORD}),\\s+(.+)$"
VOCATIVE_CUTS = ("^(?:anh|chị|tôi|mình)\\s+(?:giao|nhờ)\\s+(?:em|anh|chị|bạn)\\s+", "^(?:em|anh|chị|bạn)\\s+(?:hãy|cần|nhớ|giúp|phụ trách|lo)\\s+")
DIRECTIVE = "^(?:dạ[,\\s]+)?(?:em|anh|chị|bạn|ban|you)\\s+(?:hãy\\s+|cần\\s+|nhớ\\s+|giúp\\s+|cố gắng\\s+|please\\s+)?(.+)$"
HONORIFIC = "^(?:anh|chị|chi|em|bạn|ban|mr|ms|mrs)\\s+"
NAMED_DEADLINE = "\\btask\\s+([\\wÀ-ỹ'-]+(?:\\s+[\\wÀ-ỹ'-]+){0,8}?)\\s+(?:vẫn\\s+(?:giữ\\s+)?)?(?:có\\s+)?deadline\\b"
CANCELLED = (
    ".*?(?:hủy task|bỏ task|dừng (?:phần|task|việc)|không làm nữa|không cần làm nữa|loại khỏi scope|cancel(?:led)?|remove(?:d)? from scope)\\s*"
)

# Texts that are no promise, and follow-ups that only tell.
UNCERTAIN = (
    "\\?", "\\b(?:cố gắng|dự kiến|chắc|hy vọng|em nghĩ nên|có cần|có nên|muốn hỏi|xem có|chưa chốt|try to|might|maybe|could|should|would)\\b",
)
FOLLOW_UP = "^(?:gửi (?:email|mail|tin nhắn)|báo lại|cập nhật tiến độ|send (?:an )?email|report back)\\b"
ONCE_DONE = "\\b(?:sau khi|khi xong|after|once done)\\b"
ADMINISTRATIVE = (
    "^(?:gửi|send|cập nhật|update|ghi|write)\\b.*\\b(?:meeting notes?|minutes|recap|group chat|jira|board|sau meeting|sau cuộc họp|after (?:the )?meeting)\\b"
)
EVERYONE = "^(?:mọi người|mỗi người|cả nhóm|chúng ta|team|all|everyone)\\b"
NO_CREATION = ("BRAINSTORM", "HYPOTHETICAL", "PAST_COMPLETED", "FUTURE_DISCUSSION", "CANCELLATION", "REJECTION")

# Names that are none, roles that may own tasks.
NO_NAMES = (
    "em", "anh", "chi", "chị", "toi", "tôi", "minh", "mình", "ban", "bạn", "cho", "ben", "bên", "ca", "cả", "dien", "diện", "nguoi", "người", "it", "this", "that", "we",
    "i", "you", "team", "ai", "who", "someone", "mọi người", "chung ta", "chúng ta", "can", "hay", "nho", "nhớ", "khong", "không", "se", "sẽ", "deadline", "scope", "script",
)
ROLES = (
    "devops", "qa", "qc", "po", "pm", "ba", "infra", "security", "backend", "frontend", "design", "designer", "vendor", "team qa", "team devops",
)

# Actions that point back or say too little, objects that are none.
POINTING = ("việc đó", "phần này", "phần đó", "cả hai", "task này", "task đó", "it", "this", "that", "the task", "đúng như vậy", "như vậy")
SAYING_LITTLE = (
    "cố", "cố gắng", "ghi nhận", "đồng ý", "xác nhận", "hỗ trợ", "giúp", "xem xét", "tìm hiểu", "tìm hiểu thêm", "báo sau", "trao đổi sau", "recap", "recap nhanh",
    "đôn đốc", "theo dõi", "làm", "gửi", "kiểm tra", "làm đúng như vậy", "làm như vậy", "i accept", "i agree", "will do", "hoàn thành đúng hạn", "liên hệ sau cuộc họp",
    "can help", "noted", "viết chi tiết", "viết theo hướng dẫn", "làm theo hướng đó", "làm theo", "làm trong sáng nay", "làm hết sức", "gửi invite", "gửi invitation",
    "gửi changes sớm", "cập nhật trạng thái hàng ngày", "update tiến độ",
)
TASK_ITSELF = "^(?:cap nhat|update) (?:lai )?(?:task|ticket)\\b"
WEAK_STARTS = ("cap nhat lai task", "update the task", "tao task")
WEAK_OBJECTS = ("final", "draft", "ban nhap", "chi tiet", "theo huong dan", "theo huong do", "trong sang nay", "het suc", "changes som")
WEAK_OBJECT_SHAPES = (
    "^(?:(?:phan|viec|task) (?:nay|do)|it|this|that)$", "^(?:(?:giup|ho tro) (?:em|anh|chi|toi|minh|ban)|(?:may|vai) (?:loi|viec|task)(?: [\\w-]+){0,2} do)$",
)
NON_OBJECTS = (
    "anh", "chi", "em", "toi", "minh", "ban", "cho", "lai", "them", "luon", "dung", "nhu", "vay", "som", "ngay", "bay", "gio", "sau", "truoc", "trong", "hom", "nay", "mai",
    "thuong", "xuyen", "nhe", "a", "please", "it", "this", "that", "soon", "today", "tomorrow", "later", "again",
)

EVENT = ("event_type", "action_text", "assignee", "related_task_hint")


def has(*flags: str) -> Column:
    return F.arrays_overlap("flags", F.array(*map(F.lit, flags)))


def _sub(text: Column, pattern: str, instead: str = "") -> Column:
    return F.regexp_replace(text, f"(?iU){pattern}", instead)


def _group(text: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(text, f"(?iU){pattern}", n)


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def clean_action(text: Column) -> Column:
    """An action without dates, dialogue and talk around it, beginning with a capital."""
    out = text
    for pattern, instead in CUTS:
        out = _sub(out, pattern, instead)
    out = F.regexp_replace(out, "^[ .,:;?!\\-–—]+|[ .,:;?!\\-–—]+$", "")
    for pattern, instead in STARTS:
        out = _sub(out, pattern, instead)
    out = let(out, lambda v: F.when(v.rlike(f"(?iU){COMPOUND}") & v.rlike(f"(?iU){PREPARING}"), _group(v, COMPOUND, 1)).otherwise(v))
    for pattern, instead in ENDS:
        out = F.trim(_sub(out, pattern, instead))
    return let(out, capitalised)


def is_concrete(action: Column) -> Column:
    """Whether an action names something to do, more strictly than its guard."""
    return let(action, lambda raw: let(F.trim(match_form(raw)), lambda own: let(leading_verb(own), lambda verb: let(words_of(own), lambda words: _concrete(raw, own, verb, words)))))


def _concrete(action: Column, own: Column, verb: Column, words: Column) -> Column:
    count = F.when(verb == "", 1).otherwise(F.size(F.split(verb, " ")))
    weak = own.rlike(TASK_ITSELF) | (own == "update lich") | own.isin(*sorted({plain(x) for x in (*POINTING, *SAYING_LITTLE)}))
    for start in WEAK_STARTS:
        weak = weak | own.startswith(start)
    led = action.rlike(f"(?iU)^(?:{VERBS_BY_LENGTH})\\b")
    told = action.rlike(f"(?iU){ADMINISTRATIVE}")

    def real(objects: Column) -> Column:
        none = F.array_join(objects, " ").isin(*WEAK_OBJECTS) | F.array_join(objects, " ").rlike("(?U)" + "|".join(WEAK_OBJECT_SHAPES))
        return F.exists(objects, lambda w: ~w.isin(*NON_OBJECTS)) & ~none

    objects = F.slice(words, count + 1, F.greatest(F.size(words), F.lit(1)))
    return led & ~weak & ~told & (F.size(words) >= 2) & let(objects, real) & (_guard(own, verb) == "CONCRETE")


def assignee_of(name: Column, participants: Column) -> Column:
    """The participant or role that a name stands for, or an empty text."""
    raw = F.trim(_sub(F.regexp_replace(name, "^[ ,.:;]+|[ ,.:;]+$", ""), HONORIFIC))
    role = lambda x, key: F.when(key.isin(*ROLES) & ~key.isin(*sorted({plain(n) for n in NO_NAMES})), x)
    return let(raw, lambda x: let(match_form(x), lambda key: F.coalesce(F.try_element_at(participants, key), role(x, key), F.lit(""))))


def participants_of(clauses: DataFrame) -> DataFrame:
    """meeting_id and its speakers: a map from match form to the name that came first."""
    first = clauses.groupBy("meeting_id", match_form(F.col("speaker_name")).alias("key")).agg(F.min_by("speaker_name", "order_index").alias("name"))
    return first.groupBy("meeting_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "name"))).alias("participants"))


def _named(text: Column, participants: Column) -> Column:
    """Candidates of clauses that begin with a participant's name, longer names first."""
    bare, verb = F.ltrim(text), f"(?iU)\\b(?:{VERBS_BY_LENGTH})\\b"
    spoken = F.when(text.rlike(f"(?iU){ADDRESS}"), _sub(text, ADDRESS)).otherwise(F.lit(None))

    def of(name: Column, base: Column) -> Column:
        rest = F.substr(base, F.length(name) + 1)
        hit = F.lower(base).startswith(F.lower(name)) & ~rest.rlike("(?U)^\\w") & (rest != "")
        action = lambda body: let(F.regexp_instr(body, F.lit(verb)), lambda at: F.when(at > 0, F.substr(body, at)))
        found = F.when(hit, let(_sub(rest, BODY_START), action))
        return let(found, lambda x: F.when(x.isNotNull(), F.struct(F.lit("OWNER_ASSIGN").alias("event_type"), x.alias("raw"), name.alias("assignee"))))

    names = F.array_sort(F.array_distinct(F.map_values(participants)), lambda a, b: F.coalesce(F.nullif(F.length(b) - F.length(a), F.lit(0)), F.when(a < b, -1).when(a > b, 1).otherwise(0)))
    return F.array_compact(F.flatten(F.transform(names, lambda n: F.array(of(n, bare), of(n, spoken)))))


def events(rows: DataFrame) -> DataFrame:
    """Events of annotated clauses (meeting_id, clause_id, order_index, speaker_name, text_raw, flags, rule_confidence and
    deadline_mention_id, the clause's last deadline or null); the speakers of the meeting are its participants."""
    order = W.partitionBy("meeting_id").orderBy("order_index")
    before = F.collect_list("speaker_name").over(order.rowsBetween(-3, -1))
    rows = rows.join(participants_of(rows), "meeting_id").withColumn("text", F.trim("text_raw"))
    rows = rows.withColumn("other", F.element_at(F.concat(F.array(F.lit("")), F.filter(before, lambda x: x != F.col("speaker_name"))), -1))
    rows = rows.withColumn("bare", F.trim(_sub(F.col("text"), DISCOURSE)))
    text, bare, people = F.col("text"), F.col("bare"), F.col("participants")
    scope = _sub(text, TRAILING_DIALOGUE)
    rows = rows.withColumn("open", ~has(*NO_CREATION) & ~scope.rlike("(?iU)" + "|".join(UNCERTAIN)))
    rows = rows.withColumn("fronted", F.when(F.col("open") & bare.rlike(f"(?iU){FRONTED}"), clean_action(_group(bare, FRONTED, 2))))
    front = F.trim(F.regexp_replace(_group(bare, FRONTED, 1), "^[ ,]+|[ ,]+$", ""))
    front_ok = (
        F.col("fronted").isNotNull() & ~match_form(front).isin("da", "vang", "ok", "okay") & F.col("fronted").rlike(f"(?iU)^(?:{VERBS_BY_LENGTH})\\b")
        & ~match_form(F.col("fronted")).isin(*sorted({plain(x) for x in SAYING_LITTLE}))
    )
    of = lambda test, kind, raw, who: F.when(test, F.struct(F.lit(kind).alias("event_type"), raw.alias("raw"), who.alias("assignee")))
    found = lambda p: text.rlike(f"(?iU){p}")
    speaker, open_ = F.col("speaker_name"), F.col("open")
    vocative = _sub(_sub(_group(text, VOCATIVE, 2), VOCATIVE_CUTS[0]), VOCATIVE_CUTS[1])
    own = F.array_compact(F.array(
        of(open_ & bare.rlike(f"(?iU){FIRST_PERSON}"), "TASK_COMMITMENT", _group(bare, FIRST_PERSON, 1), speaker),
        of(front_ok, "TASK_COMMITMENT", F.concat_ws(" ", F.col("fronted"), front), speaker),
        of(open_ & found(ROLE), "OWNER_ASSIGN", F.concat(F.lit("Hoàn thiện "), F.regexp_replace(_group(text, ROLE, 3), "^[ ,.;:]+|[ ,.;:]+$", "")), assignee_of(_group(text, ROLE, 2), people)),
        of(open_ & found(EXPLICIT), "OWNER_ASSIGN", _group(text, EXPLICIT, 2), assignee_of(_group(text, EXPLICIT, 1), people)),
        of(open_ & ~found(EXPLICIT) & found(OWNER), "OWNER_ASSIGN", _group(text, OWNER, 2), assignee_of(_group(text, OWNER, 1), people)),
    ))
    rest = F.array_compact(F.array(
        of(open_ & found(VOCATIVE), "OWNER_ASSIGN", vocative, assignee_of(_group(text, VOCATIVE, 1), people)),
        of(open_ & found(DIRECTIVE), "OWNER_ASSIGN", _group(text, DIRECTIVE, 1), F.col("other")),
    ))
    existing = F.array_compact(F.array(of(found(EXISTING), "TASK_COMMITMENT", _group(text, EXISTING, 1), speaker)))
    named = F.when(open_, _named(text, people)).otherwise(F.array().cast("array<struct<event_type:string,raw:string,assignee:string>>"))
    clean = lambda cs: F.transform(cs, lambda c: F.struct(c["event_type"].alias("event_type"), clean_action(c["raw"]).alias("action"), c["assignee"].alias("assignee")))
    good = lambda cs: F.filter(cs, lambda c: (c["assignee"] != "") & is_concrete(c["action"]))
    rows = rows.withColumn("first", F.size(existing)).withColumn("candidates", clean(F.concat(existing, own, named, rest)))
    promise = F.col("candidates")[F.col("first")]["action"]
    tells = F.coalesce(open_ & bare.rlike(f"(?iU){FIRST_PERSON}") & promise.rlike(f"(?iU){FOLLOW_UP}") & found(ONCE_DONE), F.lit(False))
    rows = rows.withColumn("tells", tells).withColumn("known", good(F.slice("candidates", F.lit(1), F.col("first"))))
    later = F.slice("candidates", F.col("first") + F.when(F.col("tells"), 2).otherwise(1), F.greatest(F.size("candidates"), F.lit(1)))
    rows = rows.withColumn("new", good(later))

    due, none = F.col("deadline_mention_id").isNotNull(), F.lit("")
    event = lambda kind, action=none, who=none, hint=none: F.struct(F.lit(kind).alias("event_type") if isinstance(kind, str) else kind.alias("event_type"), action.alias("action_text"), who.alias("assignee"), hint.alias("related_task_hint"))
    ended = F.regexp_replace(_sub(F.col("text_raw"), CANCELLED), "^[ .]+|[ .]+$", "")
    take = lambda name: event(F.col(name)[0]["event_type"], F.col(name)[0]["action"], F.col(name)[0]["assignee"])
    deadline_only = (
        ~F.col("tells") & ~found("\\bchắc\\b") & ~F.contains(text, F.lit("?")) & ~bare.rlike(f"(?iU){EVERYONE}") & due & has("FIRST_PERSON_COMMITMENT", "CONFIRMATION")
    )
    chosen = (
        F.when(F.size("known") > 0, take("known"))
        .when(has("CANCELLATION"), event("TASK_CANCEL", hint=ended))
        .when(has("REJECTION"), event("TASK_REJECT", who=speaker, hint=F.col("text_raw")))
        .when(has("CORRECTION") & due, event("DEADLINE_REPLACE", hint=F.col("text_raw")))
        .when(found(NAMED_DEADLINE) & due & ~F.contains(text, F.lit("?")), event("DEADLINE_SET", hint=F.trim(_group(text, NAMED_DEADLINE, 1))))
        .when(has(*NO_CREATION), None)
        .when(F.size("new") > 0, take("new"))
        .when(deadline_only, event("DEADLINE_SET", who=speaker, hint=F.col("text_raw")))
    )
    # exploded, not filtered: a filter would be pushed down and compute the candidates a second time
    rows = rows.withColumn("event", F.explode(F.array_compact(F.array(chosen))))
    return rows.select(
        "meeting_id", "clause_id", "order_index", *(F.col(f"event.{c}").alias(c) for c in EVENT), F.coalesce("deadline_mention_id", F.lit("")).alias("deadline_mention_id"),
        F.col("rule_confidence").alias("confidence"), F.lit("RULE").alias("extraction_source"),
    )
