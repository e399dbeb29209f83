"""From annotated clauses to proposals of tasks: seeds of evidence, relations, clusters, spans, scores and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import hash_id, let, words_of
from tessera.operators.cues import VERBS
from tessera.operators.guards import action_guard

# Flags that speak against a task or change one; words that give a seed its roles.
AGAINST = (
    "ROOT_QUESTION", "SUGGESTION_ONLY", "HYPOTHETICAL", "PAST_COMPLETED", "PROGRESS_UPDATE", "FUTURE_DISCUSSION", "ADMIN_FOLLOWUP", "REJECTION", "CANCELLATION",
)
CHANGING = ("CORRECTION", "CANCELLATION", "REJECTION")
RECAP = "\\b(?:tổng kết|chốt lại|recap|trạng thái cuối)\\b"
REFERENCE = "\\b(?:task|công việc|phần đó|việc đó|deadline|lỗi|ý em|integration spec)\\b"
ACTION = "\\b(?:tập trung|debug|khảo sát|thiết lập|cấu hình|triển khai)\\b"
ACCEPTANCE = "\\b(?:dạ|vâng|ok|được|đồng ý|ghi nhận|rõ|commit|ý hay)\\b"
COMMITMENT = "\\b(?:cam kết)\\b"
ASSIGNMENT = "\\b(?:ưu tiên|owner|handoff|wireframe)\\b"

# Verbs that begin an action's span, and what ends it.
SPAN_VERBS = (
    "hoàn thành", "chuẩn bị", "viết", "gửi", "review", "kiểm tra", "cập nhật", "phân tích", "triển khai", "fix", "sửa", "làm", "hỗ trợ", "setup", "soạn", "tạo", "cấp",
    "cài đặt", "xác định", "test", "chụp", "khảo sát", "debug", "thiết lập", "cấu hình", "xử lý", "ẩn danh", "update", "lập", "check", "yêu cầu", "seed",
)
SPAN_END = (
    "\\s*(?:,\\s*(?:vì|chứ|mà|để)\\b|[,;]\\s*(?:deadline|hạn)\\b|\\s+(?:trước|vào|đến|deadline|hạn(?:\\s+chót)?|trong|ngày|thứ)\\b|"
    "\\s+(?:nhé|nhá|ạ|đi)\\b|\\s+(?:được không|thế nào)\\b|\\s*[.?!;]|\\s*[\"”»]|\\s*(?:–|-)\\s*deadline\\b|"
    "\\s+và\\s+(?:hoàn thành|chuẩn bị|viết|gửi|review|kiểm tra|cập nhật|phân tích|triển khai|fix|sửa|làm|test)\\b)"
)

# What an action's frame loses in front and behind.
FRAME_START = (
    "^(?:(?:dạ|vâng|ừm?|ok(?:ay)?|được|vậy|thế|còn)\\s*[,;:.!?-]*\\s*)+",
    "^(?:(?:còn\\s+)?(?:việc|task|phần)\\s+|(?:text|cái\\s+đó)\\s+(?:thì\\s+)?)",
    "^(?:(?:em|tôi|mình|anh|chị|we|i)\\s+)?(?:sẽ|will|cam\\s+kết\\s+(?:sẽ\\s+)?|cố\\s+gắng\\s+(?:sẽ\\s+)?|tranh\\s+thủ\\s+(?:sẽ\\s+)?)\\s+",
)
FRAME_METHOD = "\\s*(?:,|;)?\\s+(?:và|rồi|sau\\s+đó|and\\s+then)\\s+((?:báo(?:\\s+lại|\\s+cáo)?|gửi(?:\\s+lại)?|update|cập\\s+nhật)\\b.*)$"
FRAME_TIME = "\\s*(?:,|;)?\\s*(?:trước|vào|đến|deadline|hạn(?:\\s+chót)?|by|on)\\b.*$"
FRAME_QUESTION = "\\s*(?:được\\s+không|nhé|nhỉ|không)\\s*\\?*$"
EDGE = " .,:;!?-–—"
GENERIC = ("việc", "phần", "task", "này", "đó", "it", "this", "that")
SPECULATIVE = "\\b(?:có thể|nên|dự kiến|cần)\\b"

RADIUS, FOLLOW_UP = 3, 24


def has(*flags: str) -> Column:
    return F.arrays_overlap("flags", F.array(*map(F.lit, flags)))


def seeds(rows: DataFrame, has_deadline: Column) -> DataFrame:
    """Annotated clauses with at least one role, and their roles in order."""
    raw = F.col("text_raw")
    found = lambda p: raw.rlike(f"(?iU){p}")
    owner = has("DIRECT_ASSIGNMENT", "FIRST_PERSON_COMMITMENT") | found(COMMITMENT) | found(ASSIGNMENT)
    roles = {
        "ACCEPTANCE": has("CONFIRMATION") | found(ACCEPTANCE), "ACTION": has("ACTION_VERB") | found(ACTION), "AUTHORITY": owner, "DEADLINE": has_deadline,
        "MUTATION": has(*CHANGING), "NEGATIVE": has(*AGAINST), "OWNER": owner, "RECAP": found(RECAP), "TASK_REFERENCE": found(REFERENCE),
    }
    found_roles = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in roles.items())))
    # exploded, not filtered: a filter would be pushed below the flags and compute them once for each role
    out = rows.withColumn("roles", F.explode(F.filter(F.array(found_roles), lambda r: F.size(r) > 0)))
    return out.withColumn("seed_id", F.concat(F.lit("SEED-"), "clause_id"))


def relations(seed_rows: DataFrame) -> DataFrame:
    """Which seeds support which: near ones by role, and later ones of the same speaker with no action or reference between.

    Seeds meet by meeting and stretch of FOLLOW_UP clauses, so a long meeting is many groups."""
    busy = F.arrays_overlap("roles", F.array(F.lit("ACTION"), F.lit("TASK_REFERENCE"))).cast("int")
    upto = F.sum(busy).over(W.partitionBy("meeting_id").orderBy("order_index"))
    rows = seed_rows.select("meeting_id", "seed_id", "speaker_name", F.col("order_index").alias("i"), "roles", busy.alias("busy"), upto.alias("upto"))
    stretch = F.floor(F.col("i") / FOLLOW_UP)
    left = rows.select("meeting_id", stretch.alias("stretch"), F.col("seed_id").alias("nucleus"), F.col("speaker_name").alias("by"), F.col("i").alias("n"), F.col("upto").alias("n_upto"))
    right = rows.withColumn("stretch", F.explode(F.array(stretch - 1, stretch, stretch + 1)))
    role = lambda x: F.array_contains("roles", x)
    pairs = left.join(right, ["meeting_id", "stretch"]).where("seed_id <> nucleus").withColumn("distance", F.abs(F.col("i") - F.col("n")))
    near, same, after = F.col("distance") <= RADIUS, F.col("speaker_name") == F.col("by"), F.col("i") > F.col("n")
    open_ = after & (F.col("distance") <= FOLLOW_UP) & same & (F.col("upto") - F.col("busy") - F.col("n_upto") == 0)
    later = F.when(role("AUTHORITY"), "AUTHORIZES").when(role("DEADLINE"), "HAS_DEADLINE").when(role("OWNER"), "OWNS")
    responds = near & role("ACCEPTANCE") & (F.col("i") >= F.col("n"))
    kind = (
        F.when(near & role("AUTHORITY"), "AUTHORIZES").when(near & role("DEADLINE"), "HAS_DEADLINE").when(responds, "ACCEPTS").when(near & role("OWNER"), "OWNS")
        .when(same & (F.col("distance") <= 1), "CONTINUES_ACTION").when(open_, later)
    )
    local = near & (role("AUTHORITY") | role("DEADLINE") | role("OWNER")) | (same & (F.col("distance") <= 1))
    scope = F.when(kind == "ACCEPTS", "RESPONSE").when(local, "LOCAL").otherwise("SAME_SPEAKER_FOLLOW_UP")
    pairs = pairs.withColumn("relation", kind).where("relation is not null").withColumn("scope", scope)
    reach = F.when(F.col("scope") == "SAME_SPEAKER_FOLLOW_UP", FOLLOW_UP).otherwise(RADIUS)
    score = F.round(1 - F.col("distance") / (reach + 1) * 0.25, 3)
    one = lambda k, s: F.struct(k.alias("relation"), s.alias("scope"))
    more = F.array_compact(F.array(
        one(F.col("relation"), F.col("scope")), F.when(role("DEADLINE") & (F.col("relation") != "HAS_DEADLINE"), one(F.lit("HAS_DEADLINE"), F.col("scope"))),
        F.when(responds & (F.col("relation") != "ACCEPTS"), one(F.lit("ACCEPTS"), F.lit("RESPONSE"))),
    ))
    out = pairs.withColumn("score", score).withColumn("x", F.explode(more))
    return out.select("meeting_id", "nucleus", F.col("seed_id").alias("support"), F.col("x.relation").alias("relation"), "distance", "score", F.col("x.scope").alias("scope"))


def clusters(seed_rows: DataFrame, relation_rows: DataFrame) -> DataFrame:
    """A cluster per seed: its kind, and what supports it by distance, seed and relation."""
    role = lambda x: F.array_contains("roles", x)
    kind = F.when(role("MUTATION"), "UPDATE").when(~role("ACTION") | role("NEGATIVE") | role("RECAP"), "REFERENCE").otherwise("CREATE")
    links = F.array_sort(F.collect_list(F.struct("distance", "support", "relation")))
    held = relation_rows.groupBy("meeting_id", F.col("nucleus").alias("seed_id")).agg(links.alias("links"))
    none = F.array().cast("array<struct<distance:bigint,support:string,relation:string>>")
    out = seed_rows.select("meeting_id", "clause_id", "seed_id", "roles", kind.alias("kind")).join(held, ["meeting_id", "seed_id"], "left")
    return out.withColumn("links", F.coalesce(F.col("links").cast(none_type()), none))


def none_type() -> str:
    return "array<struct<distance:bigint,support:string,relation:string>>"


def action_spans(text: Column) -> Column:
    """start (from 0) and text of every phrase that begins with one of SPAN_VERBS, up to what ends it."""
    starts = F.filter(
        F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))),
        lambda i: F.substr(text, i).rlike(f"(?iU)^(?:{'|'.join(SPAN_VERBS)})\\b") & ~F.substr(text, F.greatest(i - 1, F.lit(1)), F.when(i > 1, 1).otherwise(0)).rlike("(?U)\\w"),
    )

    def phrase(i: Column) -> Column:
        rest = F.substr(text, i)
        return F.when(rest.rlike(f"(?iU){SPAN_END}"), F.regexp_extract(rest, f"(?siU)^(.*?)(?:{SPAN_END})", 1)).otherwise(rest)

    spans = F.transform(starts, lambda i: F.struct((i - 1).alias("start"), F.regexp_replace(phrase(i), "[ ,.;:!?]+$", "").alias("text")))
    return F.filter(spans, lambda s: s["text"] != "")


def lattice(spans: Column, most: int = 7) -> Column:
    """Each span whole and as its first two to seven words, without punctuation at the end; a place counts once."""

    def prefixes(s: Column) -> Column:
        words = F.split(s["text"], "\\s+")
        head = lambda n: F.concat(F.lit("^((?:\\S+\\s+){"), (n - 1).cast("string"), F.lit("}\\S+)"))
        cut = lambda n: F.regexp_replace(F.call_function("regexp_extract", s["text"], head(n), F.lit(1)), "[ ,.;:!?]+$", "")
        short = F.transform(F.sequence(F.lit(2), F.least(F.size(words), F.lit(most))), lambda n: F.struct(s["start"].alias("start"), cut(n).alias("text"), F.lit("TOKEN_PREFIX").alias("variant")))
        short = F.filter(short, lambda x: (x["text"] != "") & (x["text"] != s["text"]))
        whole = F.array(F.struct(s["start"].alias("start"), s["text"].alias("text"), F.lit("FULL_BOUNDARY").alias("variant")))
        return F.when(F.size(words) >= 2, F.concat(whole, short)).otherwise(whole)

    return F.flatten(F.transform(spans, prefixes))


def identities(cluster_rows: DataFrame, clauses: DataFrame) -> DataFrame:
    """The spans of each cluster with their ids; a cluster without any has one without span."""
    rows = cluster_rows.join(clauses.select("meeting_id", "clause_id", "text_raw"), ["meeting_id", "clause_id"])
    spans = lattice(action_spans(F.col("text_raw")))
    rows = rows.withColumn("span", F.explode_outer(F.when(F.size(spans) > 0, spans)))
    plain = F.lower(F.regexp_replace(F.regexp_replace(F.col("span.text"), "\\s+", " "), "^[ ,.;:!?]+|[ ,.;:!?]+$", ""))
    kind = F.when(F.col("span").isNotNull() & (F.col("kind") == "CREATE"), "CREATE").otherwise("REFERENCE")
    out = rows.withColumn("kind", kind).withColumn("action", plain).withColumn("variant", F.coalesce("span.variant", F.lit("NO_SPAN")))
    key = F.concat_ws("|", "kind", F.coalesce(F.when(F.col("action") != "", F.col("action")), F.col("clause_id")))
    out = out.withColumn("identity", hash_id("PID-", key, 16)).withColumn("text", F.col("span.text")).withColumn("start", F.col("span.start"))
    first = F.row_number().over(W.partitionBy("meeting_id", "clause_id", "start", F.length("text")).orderBy(F.col("variant"), "text"))
    return out.withColumn("nth", first).where("nth = 1").drop("nth", "span", "text_raw")


def stripped(text: Column) -> Column:
    edge = "[ .,:;!?\\-–—]+"
    return F.regexp_replace(text, f"^{edge}|{edge}$", "")


def frame(span: Column) -> Column:
    """action, verb, object and guard of a span, without talk around it."""
    action = stripped(F.trim(F.regexp_replace(span, "(?U)\\s+", " ")))
    for pattern in FRAME_START:
        action = F.regexp_replace(action, f"(?iU){pattern}", "")
    for pattern in (FRAME_METHOD, FRAME_TIME, FRAME_QUESTION):
        action = F.trim(F.regexp_replace(action, f"(?iU){pattern}", ""))
    first_up = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))
    verbs = "|".join(sorted(VERBS, key=lambda v: (-len(v), v)))
    led = lambda x: F.coalesce(F.nullif(F.lower(F.regexp_extract(x, f"(?iU)^({verbs})\\b", 1)), F.lit("")), F.regexp_extract(x, "^([^ ]*)", 1))
    parts = let(let(stripped(action), first_up), lambda x: let(let(led(x), first_up), lambda v: F.struct(x.alias("action"), v.alias("verb"), F.trim(F.substr(x, F.length(v) + 1)).alias("object"), action_guard(x).alias("guard"))))
    return parts


def semantic_score(span: Column, objects: Column, guard: Column) -> Column:
    """How much a concrete span says by itself, 0 to 1."""
    concrete = F.size(F.filter(words_of(F.lower(objects)), lambda w: ~w.isin(*GENERIC)))
    score = (
        0.55 + F.when(concrete >= 2, 0.25).when(concrete >= 1, 0.10).otherwise(0.0) + F.when(concrete >= 4, 0.10).otherwise(0.0)
        + F.when(~span.rlike(f"(?iU){SPECULATIVE}"), 0.10).otherwise(0.0)
    )
    return F.when(span.isNull() | (guard != "CONCRETE"), 0.0).otherwise(F.round(F.least(score, F.lit(1.0)), 3))


def ranked(identity_rows: DataFrame, select_from: float = 0.90) -> DataFrame:
    """Score and decision of each identity, by its span, its links and its seed's roles."""
    rows = identity_rows.withColumn("frame", frame(F.col("text"))).withColumn("guard", F.when(F.col("text").isNotNull(), F.col("frame.guard")))
    rows = rows.withColumn("canonical", F.when(F.col("guard") == "CONCRETE", F.col("frame.action")).otherwise(""))
    rows = rows.withColumn("semantic", semantic_score(F.col("text"), F.col("frame.object"), F.col("guard")))
    role = lambda *x: F.arrays_overlap("roles", F.array(*map(F.lit, x)))
    linked = lambda *x: F.exists("links", lambda s: s["relation"].isin(*x))
    proposed = (F.col("kind") == "CREATE") & F.col("text").isNotNull()
    concrete = F.coalesce(F.col("guard") == "CONCRETE", F.lit(False))
    part = lambda test, points: F.when(test, points).otherwise(0.0)
    score = (
        part(proposed, 0.55) + part(concrete, 0.20) + part(F.col("semantic") >= 0.75, 0.05) + part(linked("AUTHORIZES", "ACCEPTS"), 0.15) + part(linked("OWNS"), 0.05)
        + part(linked("HAS_DEADLINE"), 0.05)
    )
    rows = rows.withColumn("score", F.when(role("NEGATIVE", "RECAP"), 0.0).otherwise(F.round(F.least(score, F.lit(1.0)), 3)))
    chosen = proposed & concrete & role("AUTHORITY") & (F.col("semantic") >= 0.75) & (F.col("score") >= select_from)
    return rows.withColumn("decision", F.when(chosen, "SELECTED").otherwise("HELD_OUT"))
