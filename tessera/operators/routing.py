"""Where candidates go: authority of action candidates, routes of merged evidence, preflight and validation of proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import match_form
from tessera.operators.proposals import AGAINST, CHANGING, has

# Replies that accept, recaps, conditions and follow-ups that give no authority.
ACCEPT = "^(?:dạ|vâng|ok(?:ay)?|được|em nhận|tôi nhận|mình nhận)\\b"
RECAP_ITEM = "\\b(?:tổng kết|chốt lại|recap|final list|final recap)\\b"
CONDITIONAL = (
    "\\b(?:nếu|khi\\s+nào|sau\\s+khi|trong\\s+lúc\\s+chờ|khi\\s+có|có\\s+.+?\\s+(?:thì\\s+)?(?:em|tôi|mình|anh|chị)\\s+sẽ)\\b"
)
FOLLOWING_UP = (
    "\\b(?:liên\\s+hệ|theo\\s+dõi|check(?:\\s+mail)?|confirm|mở\\s+meeting\\s+note|gửi\\s+(?:file|link|biên\\s+bản|checklist|meeting\\s+note|góp\\s+ý|request|sau\\s+buổi\\s+họp)|"
    "báo\\s+(?:sau|lại)|soạn\\s+sẵn\\s+test\\s+case|test\\s+offline|cập\\s+nhật\\s+mẫu\\s+chung\\s+rồi\\s+gửi\\s+lại|cập\\s+nhật\\s+(?:kết\\s+quả|danh\\s+sách\\s+task|priority|kết\\s+quả\\s+profiling)|"
    "update\\s+(?:priority|schema)|cấp\\s+(?:quyền|vpn))\\b"
)

# What becomes of each kind of authority, if it isn't among the active ones.
DROPPED = ("QUESTION_UNCONFIRMED", "HYPOTHETICAL", "PAST_COMPLETED", "REJECTION", "CANCELLATION")
CONTEXT_ONLY = ("SUGGESTION_ONLY", "CONDITIONAL", "PROGRESS_ONLY", "REFERENCE_ONLY", "ADMIN_FOLLOWUP", "FINAL_RECAP_CONFIRMATION")

# Flags by what they say of a candidate.
CREATING = ("FIRST_PERSON_COMMITMENT", "DIRECT_ASSIGNMENT", "CONFIRMATION")
STRONGLY_AGAINST = ("ADMIN_FOLLOWUP", "BRAINSTORM", "FUTURE_DISCUSSION", "HYPOTHETICAL", "PAST_COMPLETED", "PROGRESS_UPDATE", "ROOT_QUESTION", "SUGGESTION_ONLY")
GUARDS = (
    ("ROOT_QUESTION", "QUESTION"), ("SUGGESTION_ONLY", "SUGGESTION"), ("HYPOTHETICAL", "HYPOTHETICAL"), ("PAST_COMPLETED", "PAST_COMPLETED"), ("PROGRESS_UPDATE", "PROGRESS_ONLY"),
    ("REJECTION", "REJECTED_PROPOSAL"), ("FUTURE_DISCUSSION", "FUTURE_DISCUSSION"),
)
FIRST_PERSON = ("em", "tôi", "mình", "chúng tôi", "chúng em", "i", "me", "we", "us")
OWNER_TYPES, DEADLINE_TYPES, END_TYPES = ("OWNER_ASSIGN", "OWNER_REASSIGN"), ("DEADLINE_SET", "DEADLINE_REPLACE"), ("TASK_CANCEL", "TASK_REJECT")

CLEAR, POSSIBLE = 0.82, 0.45


def marked(texts: DataFrame) -> DataFrame:
    """Texts with `accepts` and `recap_item`."""
    return texts.withColumn("accepts", F.col("text_raw").rlike(f"(?iU){ACCEPT}")).withColumn("recap_item", F.col("text_raw").rlike(f"(?iU){RECAP_ITEM}"))


def action_candidates(rows: DataFrame) -> DataFrame:
    """Candidates of annotated clauses with `action` (their first span or null), `due` (whether a deadline is mentioned) and what
    `marked` adds.

    A question waits for the next clause that accepts or asks again; so what becomes of it is the next such clause, a window.
    Clauses with nothing but a deadline right after a candidate to create belong to it, one after the other."""
    order = W.partitionBy("meeting_id").orderBy("order_index")
    asks = has("ROOT_QUESTION") & F.col("action").isNotNull()
    mark = F.when(F.col("accepts"), "ACCEPT").when(asks, "ASK")
    rows = rows.withColumn("mark", mark)
    rows = rows.withColumn("last_mark", F.last("mark", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("next", F.first(F.when(F.col("mark").isNotNull(), F.struct("mark", "clause_id", "order_index")), ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)))
    taken = F.col("mark").eqNullSafe("ACCEPT") & F.col("last_mark").eqNullSafe("ASK")
    asking = F.col("mark").eqNullSafe("ASK") & ~taken
    accepted = asking & F.col("next.mark").eqNullSafe("ACCEPT")
    positive = F.array_sort(F.array_intersect("flags", F.array(*map(F.lit, CREATING))))
    negative = F.array_sort(F.array_intersect("flags", F.array(*map(F.lit, AGAINST))))
    plain_one = ~asking & ~F.coalesce(taken, F.lit(False)) & F.col("action").isNotNull() & ((F.size(positive) > 0) | has("ACTION_VERB"))
    kind = (
        F.when(accepted, "CREATE").when(asking, "UNKNOWN").when(has(*CHANGING), "MUTATION").when(F.col("recap_item"), "RECAP_ITEM")
        .when(F.size(negative) > 0, "UNKNOWN").otherwise("CREATE")
    )
    state = (
        F.when(accepted, "ACCEPTED").when(asking | kind.isin("MUTATION", "UNKNOWN"), "REFERENCE_ONLY").when(kind == "RECAP_ITEM", "CONFIRMED").when(has("CONFIRMATION"), "CONFIRMED").otherwise("PROPOSED")
    )
    signals = F.when(accepted, F.array(F.lit("EXPLICIT_ACCEPTANCE"), F.lit("QUESTION_THEN_ACCEPTANCE"))).when(asking, F.array(F.lit("QUESTION_UNCONFIRMED"))).otherwise(positive)
    against = F.when(accepted, F.array().cast("array<string>")).when(asking, F.array(F.lit("ROOT_QUESTION"))).otherwise(negative)
    made = asking | plain_one
    # deadlines right behind: of a plain candidate, or of the clause that accepted
    anchor = F.when(plain_one & (kind == "CREATE"), F.col("order_index")).when(F.coalesce(taken, F.lit(False)), F.col("order_index"))
    only_due = F.col("due") & ~made & ~F.coalesce(taken, F.lit(False))
    rows = rows.withColumn("made", made).withColumn("kind", kind).withColumn("state", state).withColumn("signals", signals).withColumn("against", against).withColumn("only_due", only_due)
    rows = rows.withColumn("start", F.last(F.when(~F.col("only_due"), F.struct(F.coalesce(anchor, F.lit(-1)).alias("at"))), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    behind = rows.where(F.col("only_due") & (F.col("start.at") >= 0)).groupBy("meeting_id", F.col("start.at").alias("last_at")).agg(F.array_sort(F.collect_list("clause_id")).alias("support"))
    out = rows.where("made").withColumn("last_at", F.when(F.col("state") == "ACCEPTED", F.col("next.order_index")).otherwise(F.col("order_index")))
    out = out.withColumn("primary", F.when(F.col("state") == "ACCEPTED", F.array("clause_id", "next.clause_id")).otherwise(F.array("clause_id")))
    out = out.join(behind, ["meeting_id", "last_at"], "left").withColumn("support", F.when(F.col("kind") == "CREATE", F.col("support")))
    return out.withColumn("support", F.coalesce("support", F.array().cast("array<string>"))).withColumn(
        "candidate_id", F.concat(F.lit("ACAND-"), F.substring(F.sha2(F.concat_ws("|", F.array_join("primary", "|"), F.lower(F.trim("action"))), 256), 1, 16))
    )


def authority() -> Column:
    """Kind of authority of an action candidate (kind, state, signals, against, said: the text of its clauses)."""
    against = lambda x: F.array_contains("against", x)
    signal = lambda x: F.array_contains("signals", x)
    asked = (F.col("state") == "REFERENCE_ONLY") & F.array_join("signals", " ").contains("QUESTION")
    return (
        F.when(F.col("state") == "ACCEPTED", "EXPLICIT_ACCEPTANCE").when(against("ROOT_QUESTION") | asked, "QUESTION_UNCONFIRMED").when(against("REJECTION"), "REJECTION")
        .when(against("CANCELLATION"), "CANCELLATION").when(against("PAST_COMPLETED"), "PAST_COMPLETED").when(against("HYPOTHETICAL"), "HYPOTHETICAL").when(against("SUGGESTION_ONLY"), "SUGGESTION_ONLY")
        .when(against("PROGRESS_UPDATE"), "PROGRESS_ONLY").when(against("ADMIN_FOLLOWUP"), "ADMIN_FOLLOWUP").when(F.col("said").rlike(f"(?iU){CONDITIONAL}"), "CONDITIONAL")
        .when(F.col("said").rlike(f"(?iU){FOLLOWING_UP}"), "ADMIN_FOLLOWUP").when(F.col("kind").isin("MUTATION", "REFERENCE", "UNKNOWN") | (F.col("state") == "REFERENCE_ONLY"), "REFERENCE_ONLY")
        .when(signal("DIRECT_ASSIGNMENT"), "DIRECT_ASSIGNMENT").when(signal("FIRST_PERSON_COMMITMENT"), "SELF_COMMITMENT").when(F.col("state") == "CONFIRMED", "CONFIRMED_ACTION").otherwise("REFERENCE_ONLY")
    )


def commitment_route(kind: Column, active: tuple[str, ...]) -> Column:
    return F.when(kind.isin(*DROPPED), "DROP").when(kind.isin(*CONTEXT_ONLY), "CONTEXT_ONLY").when(F.col("action").isNull(), "DROP").when(kind.isin(*active), "LOCAL_CREATE").otherwise("AI_CREATE_CHECK")


def evidence(rows: DataFrame) -> DataFrame:
    """The rule signals of annotated clauses, as a router takes them (scores of classifier and notes are columns of their own)."""
    return rows.select(
        *rows.columns, has(*CREATING).alias("creates"), has(*CHANGING).alias("changes"), has(*STRONGLY_AGAINST).alias("against_strongly"), has("ROOT_QUESTION").alias("asks"),
        has("HYPOTHETICAL").alias("supposes"), has("PAST_COMPLETED").alias("is_past"),
    )


def route() -> Column:
    """route, confidence and reasons of evidence rows with action_score, update_score, other_score, note_score, note_action,
    note_state and one_target."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    action, update, other, note = zero("action_score"), zero("update_score"), zero("other_score"), zero("note_score")
    one = lambda r, c, *why: F.struct(F.lit(r).alias("route"), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)).alias("confidence"), F.array_compact(F.array(*why)).alias("reasons"))
    say = lambda test, x: F.when(test, x)
    s = F.lit
    changes = F.col("changes") | F.col("note_state")
    return (
        F.when(changes & F.col("one_target"), one("LOCAL_MUTATION", F.greatest(update, note, F.when(F.col("changes"), 1.0).otherwise(0.0)), s("MUTATION_SIGNAL"), s("UNIQUE_RULE_TARGET")))
        .when(changes & (F.col("changes") | (update >= POSSIBLE)), one("AI_MUTATION_CHECK", F.greatest(update, note, s(0.5)), s("MUTATION_SIGNAL"), s("TARGET_REQUIRES_RESOLUTION")))
        .when(changes, one("CONTEXT_ONLY", F.greatest(note, other), s("NOTE_STATE_WITHOUT_MUTATION_EVIDENCE")))
        .when(F.col("against_strongly"), one("CONTEXT_ONLY", F.greatest(other, s(0.5)), s("STRONG_NEGATIVE_GUARD"), say(F.col("asks"), "QUESTION_GUARD"), say(F.col("supposes"), "HYPOTHETICAL_GUARD"), say(F.col("is_past"), "PAST_COMPLETED_GUARD")))
        .when(action >= CLEAR, one("LOCAL_CREATE", action, say(F.col("creates"), "RULE_CREATE_CORROBORATED"), s("CLASSIFIER_CLEAR_ACTION"), say(F.col("note_action"), "NOTE_ACTION_CORROBORATED")))
        .when(action >= POSSIBLE, one("AI_CREATE_CHECK", action, s("CLASSIFIER_POSSIBLE_ACTION"), say(F.col("creates"), "RULE_CREATE_SIGNAL"), say(F.col("note_action"), "NOTE_ACTION_SIGNAL")))
        .when(update >= POSSIBLE, one("AI_MUTATION_CHECK", update, s("CLASSIFIER_UPDATE_ONLY"), s("TARGET_REQUIRES_RESOLUTION")))
        .when(F.col("note_action") | F.col("note_state"), one("CONTEXT_ONLY", F.greatest(note, other), s("NOTE_SIGNAL_BELOW_ROUTING_THRESHOLD")))
        .otherwise(one("DROP", other, s("INSUFFICIENT_ACTION_OR_MUTATION_EVIDENCE")))
    )


def preflight(decisions: DataFrame, candidates: DataFrame, most: int) -> DataFrame:
    """Decisions to check a creation (meeting_id, clause_id, confidence, against_strongly), with the reason why each is eligible or
    not, and the `most` best eligible ones of a meeting selected. candidates: their clauses (meeting_id, clause_id), kind, state
    and commitment route."""
    held = candidates.groupBy("meeting_id", "clause_id").agg(
        F.bool_or(F.col("commitment").isin("DROP", "CONTEXT_ONLY")).alias("hard"), F.bool_or(~F.col("kind").isin("MUTATION", "REFERENCE", "UNKNOWN", "RECAP_ITEM") & (F.col("state") != "REFERENCE_ONLY")).alias("grounded"),
    )
    rows = decisions.join(held, ["meeting_id", "clause_id"], "left")
    reason = (
        F.when(F.col("against_strongly"), "EVIDENCE_HARD_NEGATIVE").when(F.coalesce("hard", F.lit(False)), "COMMITMENT_HARD_NEGATIVE").when(F.coalesce("grounded", F.lit(False)), "ELIGIBLE")
        .otherwise("NO_GROUNDED_CREATE_SPAN")
    )
    rows = rows.withColumn("reason", reason)
    place = F.row_number().over(W.partitionBy("meeting_id", F.col("reason") == "ELIGIBLE").orderBy(F.col("confidence").desc(), "clause_id"))
    return rows.withColumn("selected", (F.col("reason") == "ELIGIBLE") & (place <= most)).drop("hard", "grounded")


def _within(span: Column, text: Column) -> Column:
    return F.contains(match_form(text), match_form(span)) & (match_form(span) != "")


def owner_of(span: Column, text: Column, speaker: Column) -> Column:
    """Whom an owner's words in a text mean: the speaker for a first person, else the words; empty if they aren't there."""
    return F.when(~_within(span, text), "").when(F.lower(F.trim(span)).isin(*FIRST_PERSON), F.trim(speaker)).otherwise(F.trim(span))


def create_refusals() -> Column:
    """Why a proposal to create a task is refused, in the order of the checks (empty: it is accepted). Columns: text_raw (null: unknown
    clause), in_context, cites_primary, action_span, owner_span, deadline_id, deadline_clause_id, clause_id, flags, speaker_name."""
    first = lambda x: F.array(F.lit(x))
    raw = F.col("text_raw")
    owner = owner_of(F.col("owner_span"), raw, F.col("speaker_name"))
    guards = F.array_compact(F.array(*(F.when(has(flag), F.lit(reason)) for flag, reason in GUARDS), F.when(~has("ROOT_QUESTION") & F.rtrim(raw).endswith("?"), F.lit("QUESTION"))))
    deadline = F.coalesce("deadline_id", F.lit(""))
    return (
        F.when(raw.isNull(), first("UNKNOWN_SOURCE_CLAUSE")).when(~F.col("in_context"), first("SOURCE_OUTSIDE_BOUNDED_CONTEXT")).when(~F.col("cites_primary"), first("PRIMARY_SOURCE_NOT_CITED"))
        .when(~_within(F.col("action_span"), raw), first("UNGROUNDED_ACTION_SPAN")).when(F.col("owner_span").isNotNull() & (owner == ""), first("UNGROUNDED_OWNER_SPAN"))
        .when((deadline != "") & ~F.coalesce(F.col("deadline_clause_id") == F.col("clause_id"), F.lit(False)), first("INVALID_DEADLINE_MENTION")).otherwise(guards)
    )


def mutation_refusal(least: float) -> Column:
    """Why a resolved change of a task is refused, or ACCEPTED. Columns: route, decision, confidence, supplied, task_status (null:
    not there), in_context, cites_primary, anchor_primary, anchor_cited, event_type, flags, owner_span, text_raw, speaker_name,
    deadline_id, deadline_clause_id, clause_id."""
    kind = F.col("event_type")
    cued = F.when(kind == "TASK_CANCEL", has("CANCELLATION")).when(kind == "TASK_REJECT", has("REJECTION")).when(kind.isin(*OWNER_TYPES, *DEADLINE_TYPES), has(*CHANGING)).otherwise(F.lit(False))
    span, deadline = F.coalesce("owner_span", F.lit("")), F.coalesce("deadline_id", F.lit(""))
    owner = owner_of(span, F.col("text_raw"), F.col("speaker_name"))
    return (
        F.when(F.col("route") != "AI_MUTATION_CHECK", "INVALID_CANDIDATE_ROUTE").when(F.col("decision") == "UNRESOLVED", "UNRESOLVED").when(F.col("confidence") < least, "LOW_CONFIDENCE")
        .when(~F.col("supplied"), "UNKNOWN_TASK_ID").when(F.col("task_status").isNull(), "TASK_NOT_AVAILABLE_AT_ANCHOR").when(F.col("task_status").isin("CANCELLED", "REJECTED"), "TERMINAL_TASK")
        .when(~F.col("in_context"), "SOURCE_OUTSIDE_BOUNDED_CONTEXT").when(~F.col("cites_primary"), "PRIMARY_SOURCE_NOT_CITED").when(~F.col("anchor_primary"), "ANCHOR_OUTSIDE_PRIMARY")
        .when(~F.col("anchor_cited"), "ANCHOR_NOT_CITED").when(~cued, "EVENT_TYPE_NOT_GROUNDED").when(kind.isin(*OWNER_TYPES) & (span == ""), "MISSING_OWNER_SPAN")
        .when(kind.isin(*OWNER_TYPES) & (owner == ""), "UNGROUNDED_OWNER_SPAN").when(~kind.isin(*OWNER_TYPES) & (span != ""), "OWNER_NOT_ALLOWED_FOR_EVENT")
        .when(kind.isin(*DEADLINE_TYPES) & ~F.coalesce(F.col("deadline_clause_id") == F.col("clause_id"), F.lit(False)), "INVALID_DEADLINE_MENTION")
        .when(~kind.isin(*DEADLINE_TYPES) & (deadline != ""), "DEADLINE_NOT_ALLOWED_FOR_EVENT").otherwise("ACCEPTED")
    )


