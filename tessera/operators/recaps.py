"""How far a meeting's recap reaches, whether it closes without tasks, and which tasks a final one leaves active."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.ratio import ratio_of
from tessera.functions.text import jaccard, match_form, once, words_of

# Sentences that close a meeting without open tasks.
CLOSURES = (
    "\\b(?:không có|không còn)\\s+(?:task|công việc)\\s+(?:active|mới)[^.]{0,60}\\b(?:hôm nay|trong cuộc họp|in this meeting)\\b",
    "\\b(?:meeting|cuộc họp)\\b[^.]{0,80}\\bkhông có output\\b",
    "\\bonly cancellations?\\b",
    "\\bno (?:new|active) tasks?[^.]{0,60}\\b(?:today|in this meeting)\\b",
)

# Recaps of any, of complete and of authoritative reach, the last in two patterns.
ANY = (
    "\\b(?:tổng\\s+kết|chốt\\s+lại|recap|action\\s+items?|các\\s+đầu\\s+việc|danh\\s+sách\\s+công\\s+việc|final\\s+list|trạng\\s+thái\\s+cuối)\\b",
)
COMPLETE = (
    "\\b(?:recap\\s+(?:lần\\s+)?cuối|recap\\s+lại\\s+tổng\\s+thể|recap\\s+lại\\s+các\\s+task\\s+đã\\s+giao|tổng\\s+kết\\s+(?:lần\\s+)?cuối|tổng\\s+kết\\s+toàn\\s+bộ|"
    "tổng\\s+cộng\\s+các\\s+task\\s+hiện\\s+tại|(?:điểm|tổng\\s+kết|recap)[^.]{0,80}\\btoàn\\s+bộ\\b|toàn\\s+bộ[^.]{0,80}\\b(?:task|đầu\\s+việc|trạng\\s+thái)\\b|"
    "final\\s+(?:list|recap)|trạng\\s+thái\\s+cuối|điểm\\s+(?:nhanh\\s+)?trạng\\s+thái\\s+từng\\s+task)\\b",
)
AUTHORITATIVE = (
    "\\b(?:recap\\s+cuối|final\\s+recap)\\s*:",
    "\\b(?:final\\s+list\\s+(?:chỉ\\s+)?còn|chốt\\s+danh\\s+sách\\s+cuối\\s+cùng|các\\s+task\\s+active\\s+cuối\\s+cùng|tất\\s+cả\\s+task\\s+khác\\s+đã\\s+hủy|"
    "all\\s+other\\s+tasks?\\s+(?:are\\s+)?cancelled|các\\s+task\\s+khác\\s+(?:đã\\s+)?(?:hủy|huỷ|hoàn\\s+thành)(?:\\s+hoặc\\s+(?:hủy|huỷ|hoàn\\s+thành))?|"
    "(?:recap|tổng\\s+kết)\\s+(?:lần\\s+)?cuối(?:\\s+cùng)?|(?:recap|tổng\\s+kết|điểm(?:\\s+lại|\\s+qua|\\s+nhanh)?)[^.]{0,90}\\btoàn\\s+bộ\\s+(?:các\\s+)?"
    "(?:trạng\\s+thái|task|công\\s+việc|đầu\\s+việc)|thống\\s+nhất\\s+lại\\s+toàn\\s+bộ\\s+(?:các\\s+)?task|(?:điểm(?:\\s+lại|\\s+qua|\\s+nhanh)?|recap)[^.]{0,80}\\btrạng\\s+thái\\s+"
    "(?:cuối\\s+cùng\\s+)?(?:của\\s+)?(?:từng|các)\\s+task|trạng\\s+thái\\s+cuối(?:\\s+cùng)?\\s+của\\s+từng\\s+task|tổng\\s+cộng\\s+các\\s+task\\s+hiện\\s+tại|"
    "official\\s+final\\s+(?:task\\s+)?(?:list|recap))\\b",
)
LEVELS = ("NONE", "PARTIAL", "COMPLETE", "AUTHORITATIVE")

# Actions of talk rather than of work, and actions that only point back.
COMMUNICATION = "^(?:gửi|send|liên\\s+hệ|contact)\\b"
POINTING = "^(?:hoan thanh|gui|cap nhat|lam)(?: dung han| dung nhu vay| nhu vay)?$"


def scopes(clauses: DataFrame, text: str = "text_raw") -> DataFrame:
    """meeting_id, closes (without tasks) and scope (of LEVELS, the widest)."""
    said = lambda patterns: F.col(text).rlike("(?iU)" + "|".join(patterns))
    level = F.when(said(AUTHORITATIVE), 3).when(said(COMPLETE), 2).when(said(ANY), 1).otherwise(0)
    found = clauses.groupBy("meeting_id").agg(F.bool_or(said(CLOSURES)).alias("closes"), F.max(level).alias("level"))
    return found.select("meeting_id", "closes", F.element_at(F.array(*map(F.lit, LEVELS)), F.col("level") + 1).alias("scope"))


# How a recap tells the state of tasks, its rows of active ones and of others, and how alike a name must be.
STATUS_RECAP = "\\b(?:recap\\s+cuối|final\\s+recap)\\s*:"
ACTIVE_ROW = "^(?:các\\s+)?tasks?\\s+(?:đang\\s+)?(?:progress|active|in\\s+progress)\\s*:\\s*(.+)$"
OTHER_ROW = "^(?:hủy|cancel(?:led)?|unresolved|pending)\\s*:"
STATUS_ROWS, NAMED_BY_WORDS, NAMED_BY_RATIO = 10, 0.6, 0.7
NO_OWNERS = ("", "anh", "chi", "em", "toi", "minh")


def active_labels(clauses: DataFrame) -> DataFrame:
    """meeting_id and labels: the tasks that the last status recap calls active, if it also names others (clauses: meeting_id, order_index,
    speaker_name, text_raw). The recap ends with its speaker's turn, or after STATUS_ROWS clauses."""
    order = W.partitionBy("meeting_id").orderBy("order_index")
    has = lambda c, p: c.rlike(f"(?iU){p}")
    rows = clauses.withColumn("at", F.row_number().over(order)).withColumn("mark", F.max(F.when(has(F.col("text_raw"), STATUS_RECAP), F.col("at"))).over(W.partitionBy("meeting_id")))
    rows = rows.where((F.col("at") >= F.col("mark")) & (F.col("at") < F.col("mark") + STATUS_ROWS))
    rows = rows.withColumn("who", F.first("speaker_name").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    rows = rows.withColumn("over", F.bool_or(F.col("speaker_name") != F.col("who")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).where("not over")
    text = F.trim(F.regexp_replace(F.trim("text_raw"), f"(?iU){STATUS_RECAP}", ""))
    parts = F.split(F.regexp_extract(text, f"(?iU){ACTIVE_ROW}", 1), "(?iU)\\s*(?:,|;|\\bvà\\b|\\band\\b)\\s*")
    names = F.filter(F.transform(parts, lambda x: F.regexp_replace(x, "^[ .:;-]+|[ .:;-]+$", "")), lambda x: x != "")
    found = rows.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("order_index", names.alias("names")))).alias("rows"), F.bool_or(has(text, OTHER_ROW)).alias("others"))
    return found.select("meeting_id", F.flatten(F.transform("rows", lambda x: x["names"])).alias("labels"), "others").where("others and size(labels) > 0").drop("others")


def active_snapshot(tasks: DataFrame, labels: DataFrame, scope: DataFrame) -> DataFrame:
    """tasks (meeting_id, task_id, task_name, assignee, deadline_mention_id, last_index) of which an AUTHORITATIVE recap keeps those that its labels
    name, each label another one: the most alike, of equal ones the better known, then the later. If a label names none, or two
    name one, all stay. Each distinct pair of a label and a name is compared once."""
    asked = labels.join(scope.where("scope = 'AUTHORITATIVE'").select("meeting_id"), "meeting_id", "left_semi")
    said = asked.select("meeting_id", F.posexplode("labels").alias("place", "label")).withColumn("label", match_form(F.col("label")))
    forms = once(tasks.select("meeting_id", "task_id", "task_name", "assignee", "deadline_mention_id", "last_index"), ["task_name", "assignee"], lambda t: t.withColumn("name", match_form(F.col("task_name"))).withColumn("owner", match_form(F.col("assignee"))))
    known = forms.select("meeting_id", "task_id", "name", "last_index", ((F.col("deadline_mention_id") != "").cast("int") + (~F.col("owner").isin(*NO_OWNERS)).cast("int")).alias("quality"))
    pairs = said.join(known, "meeting_id")
    words = lambda c: F.array_distinct(words_of(F.col(c)))
    texts = pairs.select("label", "name").distinct().withColumn("overlap", jaccard(words("name"), words("label"))).withColumn("ratio", ratio_of(F.col("name"), F.col("label")))
    texts = texts.where((F.col("overlap") >= NAMED_BY_WORDS) | (F.col("ratio") >= NAMED_BY_RATIO)).withColumn("score", F.greatest("overlap", "ratio"))
    best = W.partitionBy("meeting_id", "place").orderBy(F.desc("score"), F.desc("quality"), F.desc("last_index"), "task_id")
    chosen = pairs.join(texts, ["label", "name"]).withColumn("n", F.row_number().over(best)).where("n = 1").select("meeting_id", "task_id").distinct()
    whole = chosen.groupBy("meeting_id").agg(F.count("*").alias("found")).join(asked.select("meeting_id", F.size("labels").alias("named")), "meeting_id").where("found = named").select("meeting_id")
    kept = chosen.join(whole, "meeting_id", "left_semi")
    return tasks.join(whole, "meeting_id", "left_anti").unionByName(tasks.join(kept, ["meeting_id", "task_id"], "left_semi").select(tasks.columns))
