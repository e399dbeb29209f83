"""Events of the second kind: targets by id, label or name, and tasks after all their events, in strict transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.ratio import ratio_of
from tessera.functions.text import hash_id, match_form, words_of
from tessera.operators.ledger import rank_of

# Operations in the order in which those of one clause apply.
OPERATIONS = ("CREATE", "CONFIRM", "ASSIGN", "REASSIGN", "RENAME", "SET_DEADLINE", "REPLACE_DEADLINE", "CLEAR_DEADLINE", "CANCEL", "REJECT", "REOPEN")
MUTATIONS = ("OWNER_REASSIGN", "DEADLINE_SET", "DEADLINE_REPLACE", "TASK_CANCEL", "TASK_REJECT")
CREATING = ("TASK_CREATE", "TASK_COMMITMENT", "OWNER_ASSIGN")

#: From which ratio a hint means a name, and how far the next name must be.
ALIKE, APART = 0.80, 0.15

STATE = "struct<made:boolean,action:string,assignee:string,deadline:string,status:string,seen:array<string>,clauses:array<string>,unresolved:array<string>,first:bigint,last:bigint>"


def task_id_of(meeting: Column, label: Column, anchor: Column) -> Column:
    """The id of a task made at an anchor or under a label: the same for a repeated event."""
    return hash_id("TASK-", F.concat_ws("|", meeting.cast("string"), F.coalesce(F.nullif(label, F.lit("")), anchor)), 20)


def reduced(events: DataFrame) -> DataFrame:
    """Tasks after their events in order (place, operation, id); events: meeting_id, task_id, event_id, operation, place, action,
    assignee, deadline, clause_id. Only CREATE makes a task; an event that its state doesn't allow, or that comes before, stays
    unresolved; a repeated event changes nothing. Per task this is a fold over its events in the JVM."""
    rank = F.coalesce(*(F.when(F.col("operation") == o, i) for i, o in enumerate(OPERATIONS)))
    event = F.struct("place", rank.alias("rank"), "event_id", "operation", "action", "assignee", "deadline", "clause_id")
    rows = events.groupBy("meeting_id", "task_id").agg(F.array_sort(F.collect_list(event)).alias("events"))
    none = F.array().cast("array<string>")
    start = F.struct(
        F.lit(False).alias("made"), F.lit("").alias("action"), F.lit("").alias("assignee"), F.lit("").alias("deadline"), F.lit("ACTIVE").alias("status"), none.alias("seen"), none.alias("clauses"), none.alias("unresolved"),
        F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("last"),
    ).cast(STATE)

    def step(s: Column, e: Column) -> Column:
        op = e["operation"]
        is_ = lambda *o: op.isin(*o)
        again = F.array_contains(s["seen"], e["event_id"])
        allowed = (
            F.when(is_("ASSIGN"), s["assignee"] == "").when(is_("REASSIGN"), e["assignee"] != "").when(is_("RENAME"), e["action"] != "").when(is_("SET_DEADLINE"), (s["deadline"] == "") & (e["deadline"] != ""))
            .when(is_("REPLACE_DEADLINE"), e["deadline"] != "").when(is_("REOPEN"), s["status"].isin("CANCELLED", "REJECTED")).otherwise(op.isin(*OPERATIONS))
        )
        makes = is_("CREATE") & ~s["made"]
        works = s["made"] & ~again & (is_("CREATE") | allowed)
        fresh = makes | works
        keep = lambda name, changes, value: F.when(makes, e[name]).when(works & changes, value).otherwise(s[name]).alias(name)
        return F.struct(
            (s["made"] | is_("CREATE")).alias("made"), keep("action", is_("RENAME"), e["action"]), keep("assignee", is_("ASSIGN", "REASSIGN"), F.when(e["assignee"] != "", e["assignee"]).otherwise(s["assignee"])),
            keep("deadline", is_("SET_DEADLINE", "REPLACE_DEADLINE", "CLEAR_DEADLINE"), F.when(is_("CLEAR_DEADLINE"), "").otherwise(e["deadline"])),
            F.when(works & is_("CANCEL"), "CANCELLED").when(works & is_("REJECT"), "REJECTED").when(works & is_("REOPEN"), "ACTIVE").otherwise(s["status"]).alias("status"),
            F.when(fresh, F.array_append(s["seen"], e["event_id"])).otherwise(s["seen"]).alias("seen"), F.when(fresh, F.array_union(s["clauses"], F.array(e["clause_id"]))).otherwise(s["clauses"]).alias("clauses"),
            F.when(~fresh & ~again, F.array_append(s["unresolved"], e["event_id"])).otherwise(s["unresolved"]).alias("unresolved"),
            F.when(makes, e["place"]).otherwise(s["first"]).alias("first"), F.when(fresh, e["place"]).otherwise(s["last"]).alias("last"),
        ).cast(STATE)

    return rows.select("meeting_id", "task_id", F.aggregate("events", start, step).alias("s")).select("meeting_id", "task_id", "s.*")


def plain_form(text: Column) -> Column:
    return F.array_join(words_of(match_form(text)), " ")


def targets(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """events with the task they mean, or null: by id; else by a label that exactly one task has; else by a name that exactly one
    has; else by the ratio of the hint with the first name, if they share a word, it is ALIKE or more, and the second best is
    APART. events: meeting_id, event_id, target_task_id, label, hint; tasks: meeting_id, task_id, labels, names (arrays).
    Each distinct pair of a hint and a name that share a word is compared once; all of a meeting's tasks take part."""
    by_id = tasks.select("meeting_id", F.col("task_id").alias("target_task_id"), F.col("task_id").alias("by_id"))

    def only(names: str, key: str) -> DataFrame:
        keys = tasks.select("meeting_id", "task_id", F.explode(names).alias("x")).select("meeting_id", "task_id", plain_form(F.col("x")).alias(key)).where(F.col(key) != "").distinct()
        return keys.groupBy("meeting_id", key).agg(F.min("task_id").alias(f"by_{key}"), F.count("*").alias("n")).where("n = 1").drop("n")

    rows = events.withColumn("label_key", plain_form(F.col("label"))).withColumn("name_key", plain_form(F.col("hint")))
    rows = rows.join(by_id, ["meeting_id", "target_task_id"], "left").join(only("labels", "label_key"), ["meeting_id", "label_key"], "left").join(only("names", "name_key"), ["meeting_id", "name_key"], "left")
    open_ = F.col("by_id").isNull() & (F.col("label_key") == "") & (F.col("name_key") != "") & F.col("by_name_key").isNull()
    rows = rows.join(_nearly_named(rows.where(open_), tasks), ["meeting_id", "event_id"], "left")
    found = F.when(F.col("by_id").isNotNull(), F.col("by_id")).when(F.col("label_key") != "", F.col("by_label_key")).when(F.col("name_key") != "", F.coalesce("by_name_key", "nearly"))
    return rows.select("meeting_id", "event_id", found.alias("task_id"))


def _nearly_named(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """The task whose first name is most like an event's hint, if no other comes near."""
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    hints = events.select("meeting_id", "event_id", "name_key", F.explode(F.array_distinct(words(F.col("name_key")))).alias("word"))
    names = tasks.select("meeting_id", "task_id", plain_form(F.element_at("names", 1)).alias("first_name"))
    names = names.select("meeting_id", "task_id", "first_name", F.explode(F.array_distinct(words(F.col("first_name")))).alias("word"))
    pairs = hints.join(names, ["meeting_id", "word"]).select("meeting_id", "event_id", "task_id", "name_key", "first_name").distinct()
    texts = pairs.select("name_key", "first_name").distinct().withColumn("ratio", ratio_of(F.col("name_key"), F.col("first_name"), ALIKE - APART))
    best = W.partitionBy("meeting_id", "event_id").orderBy(F.col("ratio").desc(), F.col("task_id").desc())
    rows = pairs.join(texts, ["name_key", "first_name"]).withColumn("place", F.row_number().over(best)).withColumn("second", F.lead("ratio").over(best))
    sure = (F.col("place") == 1) & (F.col("ratio") >= ALIKE) & (F.col("second").isNull() | (F.col("ratio") - F.col("second") >= APART))
    return rows.where(sure).select("meeting_id", "event_id", F.col("task_id").alias("nearly"))


def after_recap(tasks: DataFrame, linked: DataFrame, scope: DataFrame) -> DataFrame:
    """tasks after their meeting's recap: rows of the recap (linked: meeting_id, task_id, assignee, deadline) set what they say; a
    COMPLETE one (scope: meeting_id, scope) cancels the active tasks that it doesn't name, a PARTIAL one none."""
    said = linked.groupBy("meeting_id", "task_id").agg(F.max("assignee").alias("new_assignee"), F.max("deadline").alias("new_deadline"), F.lit(True).alias("named"))
    rows = tasks.join(said, ["meeting_id", "task_id"], "left").join(scope, "meeting_id", "left")
    closes = (F.col("scope") == "COMPLETE") & F.col("named").isNull() & (F.col("status") == "ACTIVE")
    new = lambda c: F.coalesce(F.nullif(f"new_{c}", F.lit("")), F.col(c)).alias(c)
    return rows.select("meeting_id", "task_id", new("assignee"), new("deadline"), F.when(F.coalesce(closes, F.lit(False)), "CANCELLED").otherwise(F.col("status")).alias("status"))


def suppressed(events: DataFrame) -> DataFrame:
    """Deduplicated events (as of the ledger) without those that others make redundant: an AI deadline where a rule's creation at
    the same anchor has it, and a change without target where exactly one task is changed so at that anchor; the latter's event
    takes over the evidence, and is corroborated if a rule found the same deadline."""
    anchor = F.coalesce(F.nullif("anchor_clause_id", F.lit("")), F.element_at("source_clause_ids", -1))
    rows = events.withColumn("at", anchor)
    local = rows.where(F.col("event_type").isin(*CREATING) & (F.col("extraction_source") != "AI") & (F.col("deadline_mention_id") != "")).select("meeting_id", "at", "deadline_mention_id").distinct()
    twice = rows.where((F.col("extraction_source") == "AI") & F.col("event_type").isin("DEADLINE_SET", "DEADLINE_REPLACE") & (F.col("deadline_mention_id") != "")).join(local, ["meeting_id", "at", "deadline_mention_id"], "left_semi")
    rows = rows.join(twice.select("meeting_id", "event_id"), ["meeting_id", "event_id"], "left_anti")
    changes = rows.where(F.col("event_type").isin(*MUTATIONS))
    best = F.max_by("event_id", F.struct(rank_of(F.col("extraction_source")), "confidence", (-F.col("order_index")).alias("earlier")))
    bound = changes.where("related_task_id <> ''").groupBy("meeting_id", "event_type", "at").agg(F.count_distinct("related_task_id").alias("n"), best.alias("winner")).where("n = 1").drop("n")
    loose = changes.where("related_task_id = ''").join(bound, ["meeting_id", "event_type", "at"])
    taken = loose.groupBy("meeting_id", F.col("winner").alias("event_id")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "event_id", "source_clause_ids"))), lambda x: x["source_clause_ids"])).alias("more"),
        F.collect_set(F.when((F.col("extraction_source") != "AI") & F.col("event_type").isin("DEADLINE_SET", "DEADLINE_REPLACE"), F.col("deadline_mention_id"))).alias("rule_deadlines"),
    )
    rows = rows.join(loose.select("meeting_id", "event_id"), ["meeting_id", "event_id"], "left_anti").join(taken, ["meeting_id", "event_id"], "left")
    sure = (F.col("extraction_source") == "AI") & F.array_contains(F.coalesce("rule_deadlines", F.array().cast("array<string>")), F.col("deadline_mention_id"))
    evidence = F.array_distinct(F.concat("source_clause_ids", F.coalesce("more", F.array().cast("array<string>"))))
    return rows.withColumn("source_clause_ids", evidence).withColumn("corroborated_by_rule", sure).drop("at", "more", "rule_deadlines")
