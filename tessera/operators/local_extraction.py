"""One decision for each clause, by strict rules: what changes a task comes before what makes one, and what is unclear stays open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import let, match_form, words_of
from tessera.operators.guards import relevance

# A word, words, and the shapes of sentences (groups in the order in which they are named).
W, WS = "[\\p{L}\\p{N}_'-]", "[\\p{L}\\p{N}_' -]"
VERBS = "create|prepare|send|complete|update|check|review|fix|confirm|upload|schedule|run|draft|implement|tạo|chuẩn bị|gửi|hoàn thiện|cập nhật|kiểm tra|rà soát|sửa|xác nhận|chạy|soạn|viết|triển khai|xử lý"
ASSIGNED_VERBS = "làm|xử lý|phụ trách|viết|soạn|kiểm tra|review|cập nhật"
LABELLED = f"\\btask\\s+([A-Za-z0-9-]+)\\s*[:：-]\\s*([^,.]+?)(?:,?\\s*(?:owner|người phụ trách)\\s+({W}+))?(?:$|[,.])"
NAMED = f"^({W}+)\\s+(?:sẽ|will)\\s+([^.?!,;]+)"
FIRST_PERSON = "^(?:dạ[, ]+|vâng[, ]+)?(?:em|tôi|mình|anh|chị|i)\\s+(?:sẽ|will|nhận|phụ trách)\\s+([^.?!,;]+)"
ASSIGNED = f"^(?:giao|phân công|assign)\\s+(?:cho\\s+)?({W}+)\\s+(?:{ASSIGNED_VERBS})\\s*([^.?!,;]+)"
VOCATIVE = f"^({W}+),.*?\\b(?:giao|assign)\\s+(?:cho\\s+)?(?:em|anh|chị|bạn)\\s+([^.?!,;]+)"
PLEASE = f"^([\\p{{L}}'-]+),?\\s+(?:please\\s+|hãy\\s+|giúp\\s+)?((?:{VERBS})\\b[^.?!,;]+)"
ENGLISH = "^assign\\s+([^.?!,;]+?)\\s+to\\s+([A-Za-z'-]+)"
CANCEL = f"(?:hủy|không làm|cancel)\\s+(?:task\\s+)?({WS}+)"
REASSIGN = f"(?:chuyển|bàn giao|reassign)\\s+(?:task\\s+)?({WS}+?)\\s+(?:cho|to)\\s+({W}+)"
RENAME = "(?:task\\s+)?([A-Za-z0-9-]+)\\s+(?:đổi tên thành|rename(?:d)? to)\\s+([^.?!,;]+)"
DEADLINE = "(?:deadline|hạn)\\s+(?:của\\s+)?(?:task\\s+)?([A-Za-z0-9-]+)\\s+(?:đổi sang|là|to)\\b"
VAGUE_CHANGE = "\\b(?:hủy|chuyển|đổi deadline|đổi tên|cancel|reassign)\\b"
QUESTION = "\\?|\\b(?:có thể|nên|liệu|hay là|could|should|would)\\b"
ROOT_QUESTION = "^(?:ai|gì|sao|khi nào|bao giờ|có cần|có nên|liệu|why|what|who|when|where|how|should|could|would|do we|can we)\\b"
PROGRESS = "\\b(?:đang|đã|xong|hoàn thành|progress|completed?)\\b"
ACTION = (
    "\\b(?:tao|chuan bi|gui|hoan thien|cap nhat|kiem tra|ra soat|sua|xac nhan|upload|dat lich|chay|soan|viet|trien khai|xu ly|cai dat|setup|test|review|fix|deploy|cau hinh|kiem thu|phan tich|tong hop|"
    "thu thap|lap|build|bo sung|tich hop|thuc hien|toi uu|migrate|thiet ke|create|prepare|send|complete|update|check|confirm|schedule|run|draft|implement|process|handle|write|add|install|configure|analyze|"
    "collect|integrate|execute|optimize|design)\\b"
)
VAGUE_ACTION = "^(?:lam|thuc hien|xu ly|hoan thanh|cap nhat|check|update|do|handle|complete)(?:\\s+(?:theo|lai|do|nay|viec nay|phan nay|it|this|that))?\\s*$"
NO_CONTENT = ("lai", "theo", "do", "nay", "phan", "viec", "it", "this", "that", "the", "a", "an")
NO_OWNERS = ("ai", "who", "someone", "anyone", "cung", "moi", "chung", "team", "em", "anh", "chi", "ban", "toi", "minh", "i", "we")
ADDRESS = "^(?:anh|chị|em|mr|ms)\\s+"
TRAILER = "\\b(?:trước|vào|đến|hạn|deadline)\\b.*$"
NO_EVENT = ("BRAINSTORM", "HYPOTHETICAL", "PAST_COMPLETED", "FUTURE_DISCUSSION", "REJECTION")


def action_of(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"(?iU){TRAILER}", ""), "^[ ,;:\\-]+|[ ,;:\\-]+$", "")


def concrete(text: Column) -> Column:
    def judged(n: Column) -> Column:
        rest = F.regexp_replace(n, f"(?iU)^.*?{ACTION}", "")
        return (n != "") & ~n.rlike(f"(?iU){VAGUE_ACTION}") & n.rlike(f"(?iU){ACTION}") & F.exists(words_of(rest), lambda w: ~w.isin(*NO_CONTENT))

    return let(match_form(action_of(text)), judged)


def person(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), f"(?iU){ADDRESS}", "")


def may_own(name: Column) -> Column:
    return let(match_form(person(name)), lambda n: (n != "") & ~n.isin(*NO_OWNERS) & (F.length(n) >= 2))


def decisions(rows: DataFrame) -> DataFrame:
    """meeting_id, clause_id, decision, reason, operation, label, hint, assignee, action and deadline of annotated clauses with
    deadline_id (the clause's only deadline, or empty)."""
    text = F.trim("text_raw")
    found = lambda p: text.rlike(f"(?iU){p}")
    g = lambda p, i: F.regexp_extract(text, f"(?iU){p}", i)
    kind, _, _ = relevance(F.lit(False), F.lit(False))
    due, none = F.col("deadline_id"), F.lit("")
    one = lambda d, r, op=none, label=none, hint=none, who=none, action=none, at=none: F.struct(F.lit(d).alias("decision"), (F.lit(r) if isinstance(r, str) else r).alias("reason"), (F.lit(op) if isinstance(op, str) else op).alias("operation"), label.alias("label"), hint.alias("hint"), who.alias("assignee"), action.alias("action"), at.alias("deadline"))
    target = lambda p: (F.when(F.trim(g(p, 1)).rlike("^[A-Za-z0-9-]+$"), F.trim(g(p, 1))).otherwise(""), F.when(F.trim(g(p, 1)).rlike("^[A-Za-z0-9-]+$"), "").otherwise(F.trim(g(p, 1))))
    create = lambda r, action, who, label=none: one("EVENTS", r, "CREATE", label=label, who=who, action=action_of(action), at=due)
    assigned = F.substr(text, F.regexp_instr(text, F.lit(f"(?iU)\\b(?:{ASSIGNED_VERBS})\\b")))
    speaker = F.col("speaker_name")
    plain = match_form(text)
    unclear = one("UNRESOLVED_REFERENCE", "VAGUE_REFERENCE")
    c_label, c_hint = target(CANCEL)
    r_label, r_hint = target(REASSIGN)
    decided = (
        F.when(found(CANCEL), one("EVENTS", "EXPLICIT_CANCELLATION", "CANCEL", label=c_label, hint=c_hint))
        .when(found(REASSIGN) & may_own(g(REASSIGN, 2)), one("EVENTS", "EXPLICIT_HANDOFF", "REASSIGN", label=r_label, hint=r_hint, who=person(g(REASSIGN, 2))))
        .when(found(RENAME) & concrete(g(RENAME, 2)), one("EVENTS", "EXPLICIT_HANDOFF", "RENAME", label=g(RENAME, 1), action=F.trim(g(RENAME, 2))))
        .when(found(DEADLINE) & (due != ""), one("EVENTS", "EXPLICIT_DEADLINE_CHANGE", "REPLACE_DEADLINE", label=g(DEADLINE, 1), at=due))
        .when(found(VAGUE_CHANGE), unclear)
        .when(kind == "NOISE", one("NO_EVENT", "INSUFFICIENT_CONTEXT"))
        .when(F.arrays_overlap("flags", F.array(*map(F.lit, NO_EVENT))), one("NO_EVENT", F.when(F.array_contains("flags", "PAST_COMPLETED"), "PAST_WORK").otherwise("SUGGESTION_ONLY")))
        .when(plain.rlike(f"(?iU){ROOT_QUESTION}"), one("NO_EVENT", "QUESTION_ONLY"))
        .when(found(LABELLED) & concrete(g(LABELLED, 2)), create("EXPLICIT_ASSIGNMENT", g(LABELLED, 2), F.trim(g(LABELLED, 3)), g(LABELLED, 1)))
        .when(found(FIRST_PERSON) & concrete(g(FIRST_PERSON, 1)) & may_own(speaker), create("EXPLICIT_COMMITMENT", g(FIRST_PERSON, 1), person(speaker)))
        .when(found(NAMED) & concrete(g(NAMED, 2)) & may_own(g(NAMED, 1)), create("EXPLICIT_COMMITMENT", g(NAMED, 2), person(g(NAMED, 1))))
        .when(found(ASSIGNED) & may_own(g(ASSIGNED, 1)), F.when(concrete(assigned), create("EXPLICIT_ASSIGNMENT", assigned, person(g(ASSIGNED, 1)))).otherwise(unclear))
        .when(found(VOCATIVE) & concrete(g(VOCATIVE, 2)) & may_own(g(VOCATIVE, 1)), create("EXPLICIT_ASSIGNMENT", g(VOCATIVE, 2), F.trim(g(VOCATIVE, 1))))
        .when(found(ENGLISH) & concrete(g(ENGLISH, 1)) & may_own(g(ENGLISH, 2)), create("EXPLICIT_ASSIGNMENT", g(ENGLISH, 1), g(ENGLISH, 2)))
        .when(found(PLEASE) & concrete(g(PLEASE, 2)) & may_own(g(PLEASE, 1)), create("EXPLICIT_ASSIGNMENT", g(PLEASE, 2), person(g(PLEASE, 1))))
        .when(found(LABELLED) | found(FIRST_PERSON) | found(NAMED) | found(ASSIGNED) | found(VOCATIVE) | found(PLEASE) | found(ENGLISH), unclear)
        .otherwise(one("NO_EVENT", F.when(found(QUESTION), "QUESTION_ONLY").when(found(PROGRESS), "PROGRESS_UPDATE").otherwise("INSUFFICIENT_CONTEXT")))
    )
    return rows.withColumn("x", F.explode(F.array(decided))).select("meeting_id", "clause_id", "x.*")


def response_errors(primary: DataFrame, answers: DataFrame) -> DataFrame:
    """Segments whose answers break the contract, with what they break. primary: segment_id, clause_id; answers: segment_id,
    clause_id, decision, operation (or null), anchor_clause_id (or null)."""
    got = answers.groupBy("segment_id", "clause_id").agg(
        F.count("*").alias("n"), F.bool_or(F.col("anchor_clause_id").isNotNull() & (F.col("anchor_clause_id") != F.col("clause_id"))).alias("elsewhere"),
        F.bool_or((F.col("decision") == "UNRESOLVED_REFERENCE") & F.col("operation").eqNullSafe("CREATE")).alias("creates"),
    )
    both = primary.select("segment_id", "clause_id", F.lit(True).alias("asked")).join(got, ["segment_id", "clause_id"], "full")
    return both.groupBy("segment_id").agg(F.array_compact(F.array(
        F.when(F.bool_or(F.coalesce(F.col("n") > 1, F.lit(False))), "REPEATED"), F.when(F.bool_or(F.col("asked").isNull() | F.col("n").isNull()), "NOT_ALL_AND_ONLY"),
        F.when(F.bool_or(F.coalesce("elsewhere", F.lit(False))), "ANCHORED_ELSEWHERE"), F.when(F.bool_or(F.coalesce("creates", F.lit(False))), "UNRESOLVED_CREATES"),
    )).alias("errors"))
