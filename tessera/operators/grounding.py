"""What events and notes rest on: owners named in their clauses, deadlines attached to them, note claims found in the transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import jaccard, keywords, match_form, words_of

# How a speaker takes work on, and how a role is given.
SELF_COMMITMENT = "^(?:dạ|vâng|ok(?:ay)?)[,.\\s]+|\\b(?:em|tôi|mình|i|we)\\s+(?:sẽ|will|nhận|phụ\\s+trách)\\b"
ACCEPTANCE = "^(?:dạ|vâng|ok(?:ay)?|được)[,.\\s]*(?:em|tôi|mình|i|we)?\\s*(?:nhận|làm|take)\\b"
ROLE_ASSIGNMENT = "\\b(?:manager|lead|owner|phụ trách)\\b"
TASK_LABEL = "\\btask\\s+[a-z0-9-]+\\b"

# Words that stand for operations of claims; flags of clauses that take something back; thresholds.
OPERATION_WORDS = {"CANCEL": ("huy", "bo", "cancel"), "STATE": ("chuyen", "doi", "deadline", "han", "due")}
TAKEN_BACK = ("CANCELLATION", "REJECTION", "CORRECTION")
FOUND, APART, CONTRADICTS, MOST_CLAUSES = 0.72, 0.12, 0.25, 8


def owner_evidence(events: DataFrame, clauses: DataFrame) -> DataFrame:
    """meeting_id, event_id, owner, clause_id, span and evidence_type of each owner of an event: the first of its source clauses that names
    the owner, or in which the owner speaks and takes it on. events: meeting_id, event_id, event_type, assignee,
    source_clause_ids; clauses: meeting_id, clause_id, speaker_name, text_raw."""
    owners = F.filter(F.transform(F.split("assignee", ";"), lambda x: F.trim(x)), lambda x: x != "")
    rows = events.select("meeting_id", "event_id", "event_type", F.posexplode(owners).alias("owner_at", "owner"), "source_clause_ids")
    rows = rows.select("*", F.posexplode("source_clause_ids").alias("source_at", "clause_id")).drop("source_clause_ids").join(clauses.select("meeting_id", "clause_id", "speaker_name", "text_raw"), ["meeting_id", "clause_id"])
    text, has = F.col("text_raw"), lambda p: F.col("text_raw").rlike(f"(?iU){p}")
    quoted = F.concat(F.lit("(?iU)(?<!\\w)("), F.regexp_replace("owner", "([^\\p{L}\\p{N} ])", "\\\\$1"), F.lit(")(?!\\w)"))
    named = F.nullif(F.call_function("regexp_extract", text, quoted, F.lit(1)), F.lit(""))
    speaks = match_form(F.col("owner")) == match_form(F.col("speaker_name"))
    span = F.coalesce(named, F.when(speaks & (has(SELF_COMMITMENT) | has(ACCEPTANCE)), F.col("speaker_name")))
    kind = (
        F.when(F.col("event_type") == "OWNER_REASSIGN", "OWNER_REASSIGNMENT").when(speaks & has(ACCEPTANCE), "EXPLICIT_ACCEPTANCE").when(speaks & has(SELF_COMMITMENT), "SELF_COMMITMENT")
        .when(has(ROLE_ASSIGNMENT), "ROLE_ASSIGNMENT").otherwise("DIRECT_ASSIGNMENT")
    )
    found = rows.withColumn("span", span).where("span is not null").withColumn("evidence_type", kind)
    first = F.min_by(F.struct("clause_id", "span", "evidence_type"), "source_at")
    return found.groupBy("meeting_id", "event_id", "owner_at", "owner").agg(first.alias("x")).select("meeting_id", "event_id", "owner", "x.*")


def deadline_attachments(events: DataFrame, mentions: DataFrame, clauses: DataFrame) -> DataFrame:
    """meeting_id, event_id, mention_clause_id and attachment_type of events with a deadline: its mention stands in a source clause, in
    a clause that names the task, next to a source clause, or anywhere else (never taken for the nearest's).
    events: meeting_id, event_id, action_text, related_task_hint, deadline_mention_id, source_clause_ids; mentions:
    meeting_id, date_mention_id, clause_id."""
    own = events.where("deadline_mention_id <> ''").join(mentions.select("meeting_id", F.col("date_mention_id").alias("deadline_mention_id"), F.col("clause_id").alias("mention_clause_id")), ["meeting_id", "deadline_mention_id"], "left")
    said = clauses.select("meeting_id", F.col("clause_id").alias("mention_clause_id"), F.col("order_index").alias("mention_at"), match_form(F.col("text_raw")).alias("said"))
    places = events.select("meeting_id", "event_id", F.explode("source_clause_ids").alias("clause_id")).join(clauses.select("meeting_id", "clause_id", "order_index"), ["meeting_id", "clause_id"])
    places = places.groupBy("meeting_id", "event_id").agg(F.collect_list("order_index").alias("source_at"))
    rows = own.join(said, ["meeting_id", "mention_clause_id"], "left").join(places, ["meeting_id", "event_id"], "left")
    hint = match_form(F.coalesce(F.nullif("related_task_hint", F.lit("")), F.col("action_text")))
    labelled = (F.size(F.split(hint, " ")) >= 2) & (F.contains(F.col("said"), hint) | F.col("said").rlike(f"(?iU){TASK_LABEL}"))
    nearest = F.array_min(F.transform("source_at", lambda x: F.abs(x - F.col("mention_at"))))
    kind = (
        F.when(F.col("mention_clause_id").isNull(), "UNRESOLVED").when(F.array_contains("source_clause_ids", F.col("mention_clause_id")), "SAME_ACTION_SOURCE")
        .when(F.coalesce(labelled, F.lit(False)), "EXPLICIT_TASK_LABEL").when(F.coalesce(nearest == 1, F.lit(False)), "ADJACENT_SUPPORT").otherwise("UNRESOLVED")
    )
    return rows.select("meeting_id", "event_id", F.coalesce("mention_clause_id", F.lit("")).alias("mention_clause_id"), kind.alias("attachment_type"))


def _shared(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def grounded_claims(claims: DataFrame, clauses: DataFrame) -> DataFrame:
    """How far a transcript supports each claim of a note: level, scores, margin, and the clauses (the best MOST_CLAUSES).

    claims: meeting_id, claim_id, text, action_hint, owner_hint, date_hint, operation_hint (null for none); clauses: meeting_id, clause_id,
    order_index, text_raw, flags. A clause without a word of the claim scores nothing, so claims and clauses meet by word (an
    inverted index): only pairs that share one are scored, and none is missed."""
    reference = F.coalesce(F.nullif("action_hint", F.lit("")), F.col("text"))
    tokens = lambda c: F.array_distinct(words_of(F.lower(c)))
    own = claims.select("*", keywords(F.col("text")).alias("keys"), tokens(reference).alias("words"), reference.alias("reference"))
    said = clauses.select("meeting_id", "clause_id", "order_index", "text_raw", "flags", keywords(F.col("text_raw")).alias("c_keys"), tokens(F.col("text_raw")).alias("c_words"))
    marked = lambda keys, words: F.explode(F.array_union(F.transform(keys, lambda k: F.concat(F.lit("k:"), k)), F.transform(words, lambda w: F.concat(F.lit("w:"), w))))
    left = own.select("meeting_id", "claim_id", marked(F.col("keys"), F.col("words")).alias("term"))
    right = said.select("meeting_id", "clause_id", marked(F.col("c_keys"), F.col("c_words")).alias("term"))
    pairs = left.join(right, ["meeting_id", "term"]).select("meeting_id", "claim_id", "clause_id").distinct()
    scored = pairs.join(own.select("meeting_id", "claim_id", "keys", "words"), ["meeting_id", "claim_id"]).join(said, ["meeting_id", "clause_id"])
    lexical = _shared(F.col("keys"), F.col("c_keys"))
    scored = scored.withColumn("lexical", lexical).withColumn("semantic", F.greatest("lexical", jaccard(F.col("words"), F.col("c_words")))).where("semantic > 0")
    best = W.partitionBy("meeting_id", "claim_id").orderBy(F.desc("semantic"), F.desc("lexical"), "order_index", "clause_id")
    scored = scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= MOST_CLAUSES)
    listed = F.array_sort(F.collect_list(F.struct("place", "clause_id", "order_index", "text_raw", "flags", "c_words", "semantic", "lexical")))
    found = own.join(scored.groupBy("meeting_id", "claim_id").agg(listed.alias("found")), ["meeting_id", "claim_id"], "left")
    found = found.withColumn("found", F.coalesce("found", F.array().cast(scored.groupBy("meeting_id").agg(listed.alias("x")).schema["x"].dataType)))
    at = lambda n, c: F.coalesce(F.try_element_at("found", F.lit(n))[c], F.lit(0.0))
    margin = F.greatest(F.lit(0.0), at(1, "semantic") - at(2, "semantic"))
    joined = match_form(F.array_join(F.transform("found", lambda x: x["text_raw"]), " "))
    holds = lambda hint: F.col(hint).isNull() | ((F.col(hint) != "") & F.contains(F.col("joined"), match_form(F.col(hint))))
    one_of = lambda words: F.greatest(*(F.contains(F.col("joined"), F.lit(w)) for w in words))
    operation = F.col("operation_hint")
    acts = F.when(operation.isNull(), True)
    for name, words in OPERATION_WORDS.items():
        acts = acts.when(operation == name, one_of(words))
    acts = acts.otherwise(holds("operation_hint"))
    latest = F.array_max(F.transform("found", lambda x: x["order_index"]))
    against = F.filter("found", lambda x: (x["order_index"] >= latest) & F.arrays_overlap(x["flags"], F.array(*map(F.lit, TAKEN_BACK))) & (jaccard(F.col("words"), x["c_words"]) >= CONTRADICTS))
    out = found.withColumn("joined", joined).withColumn("margin", margin).withColumn("against", F.transform(against, lambda x: x["clause_id"]))
    supported = (F.size("found") > 0) & (at(1, "semantic") >= FOUND)
    level = (
        F.when(F.size("against") > 0, "CONTRADICTED").when(supported & (F.col("margin") >= APART) & holds("owner_hint") & holds("date_hint") & acts, "FULL_GROUNDED").when(supported, "PARTIAL_GROUNDED").otherwise("NOTE_ONLY")
    )
    return out.select(
        "meeting_id", "claim_id", level.alias("level"), F.transform("found", lambda x: x["clause_id"]).alias("clause_ids"), at(1, "semantic").alias("semantic"), at(1, "lexical").alias("lexical"), "margin", "against"
    )
