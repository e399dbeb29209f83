"""Offline analyses: origins of events, routes of cases, proposals of several sources as one, consensus, folds and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import let, match_form, words_of

# What an event's source says of its origin, in this order, and the kinds that change a task.
ORIGINS = (
    (("AI",), "AI_AMBIGUOUS"), (("AI_CREATE_PROPOSAL",), "AI_GROUNDED_CREATE_PROPOSAL"), (("AI_MUTATION_ROUTER",), "AI_BOUNDED_MUTATION_ROUTER"), (("HUMAN_NOTE",), "TRUSTED_HUMAN_NOTE_POSITIVE"),
    (("RULE_CONTEXT",), "RULE_CONTEXT_REFERENCE"), (("RULE_REFERENCE", "RULE_REFERENCE_ACTIVE"), "RULE_EXISTING_TASK_REFERENCE"), (("RULE_FINAL_RECAP",), "RULE_RECAP_FINAL"), (("RULE_RECAP",), "RULE_RECAP_PARTIAL"),
)
MUTATIONS = ("TASK_CANCEL", "TASK_REJECT", "OWNER_REASSIGN", "DEADLINE_SET", "DEADLINE_REPLACE")
POSITIVE = ("TASK_CREATE", "TASK_COMMITMENT", "OWNER_ASSIGN")
RULE_ACTIONS = ("FIRST_PERSON_COMMITMENT", "DIRECT_ASSIGNMENT", "CONFIRMATION")
TASK_FIELDS = ("task_name", "assignee", "start_date", "due_date", "due_date_text", "status")

# Rules of talk after a recap, and of actions that only point back.
COMMUNICATION = "^(?:gửi|send|liên\\s+hệ|contact)\\b"
POINTING = "^(?:hoan thanh|gui|cap nhat|lam)(?: dung han| dung nhu vay| nhu vay)?$"

#: 17 features of a clause, in this order.
FEATURES = (
    "has_commitment", "has_assignment", "has_correction", "has_cancel", "has_rejection", "has_date", "has_owner_name", "is_question", "is_hypothetical", "is_suggestion", "is_past_completed", "is_progress_only",
    "speaker_changed", "first_person", "second_person", "note_supported", "rule_score",
)
_FLAG_FEATURES = {
    "has_commitment": "FIRST_PERSON_COMMITMENT", "has_assignment": "DIRECT_ASSIGNMENT", "has_correction": "CORRECTION", "has_cancel": "CANCELLATION", "has_rejection": "REJECTION", "has_date": "DATE_MENTION",
    "is_hypothetical": "HYPOTHETICAL", "is_suggestion": "SUGGESTION_ONLY", "is_past_completed": "PAST_COMPLETED", "is_progress_only": "PROGRESS_UPDATE",
}
FIRST_PERSON = "\\b(?:toi|mình|minh|em|anh|chi|chung toi|chung mình|chung minh|i|we)\\b"
SECOND_PERSON = "\\b(?:ban|cac ban|em|anh|chi|you|your)\\b"


def origin(source: Column, kind: Column) -> Column:
    out = F.when(kind.isin(*MUTATIONS), "RULE_MUTATION").when(kind == "OWNER_ASSIGN", "RULE_EXPLICIT_ASSIGNMENT").otherwise("RULE_EXPLICIT_COMMITMENT")
    for sources, name in reversed(ORIGINS):
        out = F.when(source.isin(*sources), name).otherwise(out)
    return out


def ai_route(windows: Column, calls: Column, enabled: Column, errors: Column, unresolved: Column) -> Column:
    """How far a case needed a model: six classes."""
    return (
        F.when(windows == 0, "rule_only").when((calls == 0) & enabled, "ai_fallback_skipped_no_candidate").when(calls == 0, "ai_fallback_not_configured").when(errors > 0, "ai_fallback_failed")
        .when(unresolved > 0, "ai_fallback_unresolved").otherwise("ai_fallback_resolved")
    )


def feedback_refusal() -> Column:
    """Why feedback is refused, or ACCEPTED. Columns: job_id, route_job_id, content_hash, job_content_hash, tasks (array of maps),
    reviewer, reviewed_at, approval."""
    fields = F.array(*map(F.lit, sorted(TASK_FIELDS)))
    bad = F.exists("tasks", lambda t: (F.array_sort(F.map_keys(t)) != fields) | F.exists(F.map_values(t), lambda v: v.isNull()) | ~F.coalesce(F.try_element_at(t, F.lit("status")) == "Proposed", F.lit(False)))
    zoned = F.col("reviewed_at").rlike("^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}(?::\\d{2}(?:\\.\\d+)?)?(?:Z|[+-]\\d{2}:\\d{2})$")
    return (
        F.when(F.col("job_id") != F.col("route_job_id"), "JOB_DIFFERS").when(F.col("content_hash") != F.col("job_content_hash"), "CONTENT_DIFFERS").when(F.size("tasks") > 1000, "TOO_MANY_TASKS").when(bad, "INVALID_TASK")
        .when((F.trim(F.coalesce("reviewer", F.lit(""))) == "") | (F.length("reviewer") > 256), "REVIEWER_REQUIRED").when((F.trim(F.coalesce("reviewed_at", F.lit(""))) == "") | (F.length("reviewed_at") > 128), "TIME_REQUIRED")
        .when(~zoned | ~F.coalesce("approval", F.lit(False)), "TIME_OR_APPROVAL_INVALID").otherwise("ACCEPTED")
    )


def merged_sources(rows: DataFrame, priority: dict[str, int], fields: tuple[str, ...]) -> DataFrame:
    """One row per case and task key, of its best source; fields that it lacks are filled from the next ones, and `provenance` lists
    all, in order. rows: case_id, task_key, source, ordinal, fields (texts)."""
    rank = F.coalesce(*(F.when(F.col("source") == k, v) for k, v in priority.items()), F.lit(99))
    order = F.struct(rank.alias("rank"), "ordinal", "source", F.struct(*fields).alias("f"))
    found = rows.where("task_key <> ''").groupBy("case_id", "task_key").agg(F.array_sort(F.collect_list(order)).alias("rs"))
    first = lambda name: F.coalesce(F.get(F.filter(F.transform("rs", lambda r: r["f"][name]), lambda x: F.coalesce(x, F.lit("")) != ""), 0), F.lit(""))
    return found.select("case_id", "task_key", F.get("rs", 0)["source"].alias("source"), *(first(n).alias(n) for n in fields), F.array_distinct(F.transform("rs", lambda r: r["source"])).alias("provenance"))


def consensus(decisions: DataFrame) -> DataFrame:
    """What two teachers agree on, or one is sure of. decisions: proposal_id, decision, span, confidence."""
    got = F.array_sort(F.collect_list(F.struct("confidence", "decision", "span")))
    rows = decisions.groupBy("proposal_id").agg(got.alias("x"), F.max("confidence").alias("most"), F.min("confidence").alias("least"))
    a, b = F.get("x", 0), F.get("x", 1)
    agree = (F.size("x") == 2) & (a["decision"] == b["decision"]) & a["span"].eqNullSafe(b["span"])
    sure = (F.size("x") == 1) & (a["confidence"] >= 0.90)
    return rows.select(
        "proposal_id", F.when(agree | sure, a["decision"]).otherwise("UNRESOLVED").alias("decision"), F.when(agree, "teacher_consensus").when(sure, "teacher_single").otherwise("unresolved").alias("source"),
        F.when(agree, F.col("least")).otherwise(F.col("most")).alias("confidence"),
    )


def family(case_id: Column) -> tuple[Column, Column]:
    """Template and family of a case: the sixth part of its id, and the fifth and sixth."""
    parts = F.split(case_id, "-")
    return F.when(F.size(parts) > 5, F.get(parts, 5)).otherwise("unknown"), F.when(F.size(parts) >= 6, F.concat_ws("-", F.get(parts, 4), F.get(parts, 5))).otherwise("unknown")


def longest_occurrences(spans: DataFrame) -> DataFrame:
    """One span per clause: the longest, of those the first, of those the last by text."""
    best = F.struct((F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("earlier"), "text")
    return spans.groupBy("meeting_id", "clause_id").agg(F.max_by(F.struct("start", "end", "text"), best).alias("x")).select("meeting_id", "clause_id", "x.*")


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Shared characters of two spans of a clause over what they span together."""
    both = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    whole = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return F.when(whole == 0, 0.0).otherwise(both / whole)


def training_labels(proposals: DataFrame, gold: DataFrame) -> DataFrame:
    """proposals (meeting_id, clause_id, proposal_id, kind, start, end) with `label`: 1 for a gold span, its overlap from 0.8 on, else 0."""
    g = gold.select("meeting_id", "clause_id", F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    best = proposals.join(g, ["meeting_id", "clause_id"]).groupBy("meeting_id", "proposal_id").agg(F.max(overlap(F.col("start"), F.col("end"), F.col("g_start"), F.col("g_end"))).alias("best"))
    out = proposals.join(best, ["meeting_id", "proposal_id"], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    return out.withColumn("label", F.when(F.col("kind").isin("UPDATE", "REFERENCE", "DROP") | (F.col("best") < 0.8), 0.0).otherwise(F.col("best"))).drop("best")


def nms(spans: Column, least: float = 0.8, most: int = 3) -> Column:
    """Spans (array of score, start, end) from the best down, without those that overlap a better one by `least`, `most` in all."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct((-s["score"]).alias("minus"), s["start"].alias("start"), s["end"].alias("end"))))
    none = F.array().cast("array<struct<minus:double,start:int,end:int>>")
    add = lambda kept, s: F.when((F.size(kept) >= most) | F.exists(kept, lambda k: overlap(k["start"], k["end"], s["start"], s["end"]) >= least), kept).otherwise(F.array_append(kept, s))
    return F.aggregate(ordered, none, add)


def phrased(texts: DataFrame) -> DataFrame:
    """Texts with their plain words, and whether these hold a first or second person."""
    texts = texts.withColumn("plain", F.array_join(words_of(match_form(F.col("text_raw"))), " "))
    return texts.withColumn("says_i", F.col("plain").rlike(f"(?iU){FIRST_PERSON}")).withColumn("says_you", F.col("plain").rlike(f"(?iU){SECOND_PERSON}"))


def action_features(rows: DataFrame) -> DataFrame:
    """meeting_id, clause_id and FEATURES of annotated clauses (with note_supported and what `phrased` adds)."""
    order = W.partitionBy("meeting_id").orderBy("order_index")
    speakers = rows.select("meeting_id", "speaker_name").distinct()
    names = speakers.groupBy("meeting_id").agg(F.collect_set(F.array_join(words_of(match_form(F.col("speaker_name"))), " ")).alias("names"))
    rows = rows.join(names, "meeting_id").withColumn("before", F.lag("speaker_name").over(order))
    named = F.exists("names", lambda n: (n != "") & F.contains(F.concat(F.lit(" "), F.col("plain"), F.lit(" ")), F.concat(F.lit(" "), n, F.lit(" "))))
    values = {k: F.array_contains("flags", v) for k, v in _FLAG_FEATURES.items()}
    values |= {
        "has_owner_name": named, "is_question": F.array_contains("flags", "ROOT_QUESTION") | F.rtrim("text_raw").endswith("?"), "speaker_changed": F.coalesce(F.col("before") != F.col("speaker_name"), F.lit(False)),
        "first_person": F.col("says_i"), "second_person": F.col("says_you"), "note_supported": F.col("note_supported"),
    }
    return rows.select("meeting_id", "clause_id", *((values[n].cast("double") if n in values else F.col("score").cast("double")).alias(n) for n in FEATURES))


def linear_probabilities(vector: Column, mean: list[float], scale: list[float], weights: list[list[float]], intercepts: list[float]) -> Column:
    """Probabilities of a frozen linear model over a vector, each part less its mean over its scale."""
    z = [(F.get(vector, i) - F.lit(float(m))) / F.lit(float(s)) for i, (m, s) in enumerate(zip(mean, scale, strict=True))]
    logits = F.array(*(sum((x * F.lit(float(y)) for x, y in zip(z, w, strict=True)), F.lit(float(b))) for w, b in zip(weights, intercepts, strict=True)))
    e = let(logits, lambda xs: let(F.array_max(xs), lambda most: F.transform(xs, lambda x: F.exp(x - most))))
    return let(e, lambda xs: let(F.aggregate(xs, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(xs, lambda x: x / total)))


def agreement(rows: DataFrame) -> DataFrame:
    """How a classifier's labels (`label`) agree with the rules' flags and scores, by meeting."""
    by_rule = F.arrays_overlap("flags", F.array(*map(F.lit, RULE_ACTIONS))) & (F.col("score") > 0)
    by_model = F.col("label").isin("CLEAR_ACTION", "POSSIBLE_ACTION")
    return rows.groupBy("meeting_id").agg(
        F.count("*").alias("clauses"), F.count_if(F.col("label") == "CLEAR_ACTION").alias("would_create"), F.count_if(F.col("label") == "POSSIBLE_ACTION").alias("would_review"),
        F.count_if(F.col("label") == "UPDATE_ONLY").alias("would_update"), F.count_if(by_rule).alias("rule_actions"), F.count_if(by_rule == by_model).alias("agree"), F.count_if(by_rule != by_model).alias("disagree"),
    )


def without_pointers(events: DataFrame) -> DataFrame:
    """Events without those of rules that only point back, of owners for whom the context gave the object (POL-01)."""
    owner = match_form(F.col("assignee"))
    known = events.where("extraction_source = 'RULE_CONTEXT' and assignee <> ''").select("meeting_id", owner.alias("owner_key"), F.lit(True).alias("restored")).distinct()
    points = (F.col("extraction_source") == "RULE") & F.col("event_type").isin(*POSITIVE) & match_form(F.col("action_text")).rlike(POINTING)
    joined = events.withColumn("owner_key", owner).join(known, ["meeting_id", "owner_key"], "left")
    return joined.where(~(F.coalesce(points, F.lit(False)) & F.col("restored").isNotNull())).drop("restored", "owner_key")


def long_context(events: DataFrame, meetings: DataFrame) -> DataFrame:
    """Events in which talk after a recap in a long meeting (meetings: meeting_id, clauses, scope) may only update a task (POL-02)."""
    tells = (F.col("extraction_source") == "RULE") & F.col("event_type").isin(*POSITIVE) & F.trim("action_text").rlike(f"(?iU){COMMUNICATION}")
    rows = events.join(meetings, "meeting_id", "left")
    long = (F.col("clauses") >= 80) & (F.col("scope") != "NONE")
    return rows.withColumn("extraction_source", F.when(F.coalesce(long & tells, F.lit(False)), "RULE_CONTEXT").otherwise(F.col("extraction_source"))).drop("clauses", "scope")


def identity_audit(requests: DataFrame) -> DataFrame:
    """Cases with their requests to a model that offer no candidates, or one twice. requests: case_id, request_id, task_ids."""
    n, distinct = F.size("task_ids"), F.size(F.array_distinct("task_ids"))
    return requests.groupBy("case_id").agg(F.count("*").alias("requests"), F.sum(n).alias("candidates"), F.count_if(n == 0).alias("empty"), F.count_if(n != distinct).alias("repeated"))
