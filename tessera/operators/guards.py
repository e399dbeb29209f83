"""Whether a phrase is something to do, whether a stop ends a task, and how much a clause matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import let, match_form, plain, words_of
from tessera.operators.cues import VERBS

# Phrases (in match form) that name no object, or nothing in particular.
PRONOUN_ONLY = ("viec do", "phan nay", "phan do", "task nay", "task do", "it", "this", "that", "the task")
VAGUE = (
    "will do", "handle this", "send it", "cap nhat lai", "check lai", "hoan thanh", "lam theo", "viet chi tiet", "gui changes som",
    "gui loi moi", "cap quyen cho em", "tao trong qua trinh chuan bi du lieu", "an danh can than", "sua theo", "update gi khong",
)
VAGUE_START = (
    "cap nhat lai", "update again", "cap nhat tinh hinh", "update status", "theo doi tien do", "track progress", "gui build khi xong", "send build when done",
)
NON_OBJECT = (
    "em", "anh", "chi", "toi", "minh", "ban", "lai", "them", "som", "ngay", "mai", "nay", "nhe", "please", "it", "this", "that",
)

# The end of a section of the talk, objects that are tasks, words that end one.
SECTION_END = "\\b(?:tam\\s+dung|dung|ket\\s+thuc)\\s+(?:phan|noi\\s+dung|chu\\s+de|trao\\s+doi|thao\\s+luan)\\b"
TASK_OBJECT = "\\b(?:task|cong\\s+viec|dau\\s+viec|ticket|issue)\\b"
TERMINAL = "\\b(?:huy|cancel|bo\\s+(?:task|cong\\s+viec|dau\\s+viec)|khong\\s+(?:can|tiep\\s+tuc)\\s+lam)\\b"

# What a reference to a task must not be, and words for things that are made.
NOT_A_REFERENCE = (
    "^(?:cua\\s+(?:em|anh|chi|toi|minh)\\b|deu\\s+tracking\\b|phu\\s+thuoc\\b|ten\\s+giong\\s+nhau\\b|mot\\s+lan\\s+nua\\b|"
    "dang\\s+(?:progress|theo\\s+doi|tracking)\\b|(?:status|trang\\s+thai)\\b)",
    "\\bco\\b.*\\b(?:overlap|phu\\s+thuoc)\\b.*\\bkhong$",
    "^(?:\\w+\\s+){0,3}hoan\\s+thanh\\s+(?:truoc|sau|vao)\\b",
)
DELIVERABLE = (
    "\\b(?:api|board|config|dashboard|data|dataset|design|document|draft|log|metric|migration|monitoring|parser|pipeline|plan|release|report|runbook|"
    "sandbox|scenario|script|spec|tai\\s+lieu|test(?:\\s+case)?|ui|wireframe)\\b"
)

# Flags that keep a clause, short replies, talk about the room.
PRESERVED = ("FIRST_PERSON_COMMITMENT", "DIRECT_ASSIGNMENT", "CONFIRMATION", "CORRECTION", "CANCELLATION", "REJECTION", "DATE_MENTION")
BACKCHANNEL = "^(?:ok(?:ay)?|ro|vang|uh|um|cam on|thanks?|duoc)\\s*[.!]*$"
LOGISTICS = "\\b(?:mat tieng|nghe ro|cho .* vao|phong hop|audio check)\\b"

#: Verbs in match form, the longer first, so that an alternation finds the longest.
PLAIN_VERBS = tuple(sorted({plain(v) for v in VERBS}, key=lambda v: (-len(v), v)))


def leading_verb(action: Column) -> Column:
    """The longest verb that a phrase (in match form) begins with, or an empty text."""
    return F.regexp_extract(action, f"^({'|'.join(PLAIN_VERBS)})(?: |$)", 1)


def action_guard(phrase: Column) -> Column:
    """EMPTY, PRONOUN_ONLY, VAGUE_ADMIN, NO_ACTION_VERB, NO_OBJECT or CONCRETE."""
    return let(F.trim(match_form(phrase)), lambda action: let(leading_verb(action), lambda verb: _guard(action, verb)))


def _guard(action: Column, verb: Column) -> Column:
    objects = words_of(F.substring(action, F.length(verb) + 1, F.length(action)))
    vague = action.isin(*VAGUE)
    for start in VAGUE_START:
        vague = vague | action.startswith(start)
    return (
        F.when(F.coalesce(action, F.lit("")) == "", "EMPTY").when(action.isin(*PRONOUN_ONLY), "PRONOUN_ONLY").when(vague, "VAGUE_ADMIN").when(verb == "", "NO_ACTION_VERB")
        .when(~F.exists(objects, lambda w: ~w.isin(*NON_OBJECT)), "NO_OBJECT").otherwise("CONCRETE")
    )


def ends_section_only(text: Column) -> Column:
    """Whether what stops is a part of the talk, and no task."""
    return let(match_form(text), lambda own: own.rlike(f"(?iU){SECTION_END}") & ~own.rlike(f"(?iU){TASK_OBJECT}") & ~own.rlike(f"(?iU){TERMINAL}"))


def promotable(label: Column) -> Column:
    """Whether a plain reference may become a task: two words or more, no status or relation, and a verb or a thing made."""
    return let(F.trim(match_form(label)), _promotable)


def _promotable(own: Column) -> Column:
    verbs = "|".join(PLAIN_VERBS)
    led = own.rlike(f"^(?:{verbs})(?: |$)") | own.rlike(f"(?iU)(?:^|\\s[-:]\\s|\\btask\\s+\\d+\\s*[:-]\\s).*\\b(?:{verbs})\\b")
    named = own.rlike(f"(?iU){DELIVERABLE}")
    refused = own.rlike("(?iU)" + "|".join(NOT_A_REFERENCE))
    return (own != "") & ~refused & (F.size(F.split(own, "\\s+")) >= 2) & (led | named)


def relevance(grounded: Column, on_topic: Column) -> tuple[Column, Column, Column]:
    """Class, score and reasons of an annotated clause: MANDATORY, NOISE, LIKELY or CONTEXT."""
    own = match_form(F.col("text_raw"))
    kept = F.array_sort(F.array_intersect("flags", F.array(*map(F.lit, PRESERVED))))
    kept = F.concat(kept, F.when(F.col("text_raw").rlike("(?iU)\\btask\\s*[- ]?[a-z0-9]+\\b"), F.array(F.lit("TASK_LABEL"))).otherwise(F.array().cast("array<string>")))
    noise = own.rlike(f"(?iU){BACKCHANNEL}") | own.rlike(f"(?iU){LOGISTICS}")
    kind = F.when(F.size(kept) > 0, "MANDATORY").when(noise, "NOISE").when(grounded | on_topic, "LIKELY").otherwise("CONTEXT")
    score = F.when(kind == "MANDATORY", 100.0).when(kind == "NOISE", -30.0).when(kind == "LIKELY", F.when(grounded, 25.0).otherwise(10.0)).otherwise(0.0)
    reason = F.when(kind == "NOISE", "HARD_NOISE").when(kind == "LIKELY", F.when(grounded, "NOTE_GROUNDED").otherwise("TOPIC_MATCH"))
    return kind, score, F.array_compact(F.concat(kept, F.array(reason)))
