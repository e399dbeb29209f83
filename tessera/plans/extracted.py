"""Queries over task events by rules, on meetings of many shapes of sentences, against the rules as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import plain
from tessera.operators import extraction as E
from tessera.operators.guards import PLAIN_VERBS
from tessera.plans.guarding import guard_sql
from tessera.plans.said import HAS_DATE_SQL, SAID_FLAGS_SQL, SAID_SQL, annotated, has_date, match_sql, matches, re2, said, sql_text, words_sql

_list = lambda values: ", ".join(map(sql_text, values))
_i = lambda p: sql_text("(?i)" + re2(p))
_WORD_START = "^[\\pL\\pN_]"


def _sub(column: str, pattern: str, instead: str = "") -> str:
    return f"regexp_replace({column}, {_i(pattern)}, {sql_text(instead.replace('$1', chr(92) + '1'))})"


def _group(column: str, pattern: str, n: int) -> str:
    return f"regexp_extract({column}, {_i(pattern)}, {n})"


def clean_sql(column: str, source: str, name: str) -> str:
    """CTEs that add the cleaned action of `column` to the rows of `source`, as `action`."""
    out = column
    for p, instead in E.CUTS:
        out = _sub(out, p, instead)
    out = f"trim({out}, {sql_text(E.EDGE)})"
    for p, instead in E.STARTS:
        out = _sub(out, p, instead + (" " if instead == "$1" else ""))
    end = "half"
    for p, instead in E.ENDS:
        end = f"trim({_sub(end, p, instead)})"
    return f"""{name}_a AS (SELECT *, {out} AS began FROM {source}),
{name}_b AS (SELECT *, CASE WHEN {matches('began', E.COMPOUND)} AND {matches('began', E.PREPARING)} THEN {_group('began', E.COMPOUND, 1)} ELSE began END AS half FROM {name}_a),
{name}_c AS (SELECT *, {end} AS low_action FROM {name}_b), {name} AS (SELECT *, upper(substr(low_action, 1, 1)) || substr(low_action, 2) AS action FROM {name}_c)"""


def concrete_sql(column: str, source: str, name: str) -> str:
    """CTEs that add whether `column` is something to do, as `concrete`."""
    weak = sorted({plain(x) for x in (*E.POINTING, *E.SAYING_LITTLE)})
    return f"""{name}_a AS (SELECT *, trim({match_sql(column)}) AS own FROM {source}),
{name}_b AS (SELECT *, regexp_extract(own, '^({'|'.join(PLAIN_VERBS)})(?: |$)', 1) AS verb, {words_sql('own')} AS ws FROM {name}_a),
{name}_c AS (SELECT *, ws[CASE WHEN verb = '' THEN 1 ELSE len(string_split(verb, ' ')) END + 1:] AS objects FROM {name}_b),
{name} AS (SELECT *, {guard_sql(column)} = 'CONCRETE' AND NOT regexp_matches(own, {_i(E.TASK_ITSELF)}) AND own <> 'update lich' AND own NOT IN ({_list(weak)})
  AND NOT ({' OR '.join(f"starts_with(own, {sql_text(x)})" for x in E.WEAK_STARTS)}) AND array_to_string(objects, ' ') NOT IN ({_list(E.WEAK_OBJECTS)})
  AND NOT {matches("array_to_string(objects, ' ')", *E.WEAK_OBJECT_SHAPES)} AND NOT {matches(column, E.ADMINISTRATIVE)} AND {matches(column, '^(?:' + E.VERBS_BY_LENGTH + ')\\b')}
  AND len(ws) >= 2 AND len(list_filter(objects, lambda w: w NOT IN ({_list(E.NON_OBJECTS)}))) > 0 AS concrete FROM {name}_c)"""


def ext01_clean_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir).select("meeting_id", "clause_id", E.clean_action(F.col("text_raw")).alias("action"))


EXT01 = f"WITH {SAID_SQL}, {clean_sql('text_raw', 'said', 'cleaned')} SELECT meeting_id, clause_id, action FROM cleaned"


def cue08_concrete_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = E.clean_action(F.col("text_raw"))
    return said(spark, sf_dir).select("meeting_id", "clause_id", E.is_concrete(action).alias("concrete"))


CUE08 = f"WITH {SAID_SQL}, {clean_sql('text_raw', 'said', 'cleaned')}, {concrete_sql('action', 'cleaned', 'judged')} SELECT meeting_id, clause_id, concrete FROM judged"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotated(spark, sf_dir).withColumn("deadline_mention_id", F.when(has_date(), F.concat(F.lit("DATE-"), "clause_id")))


def ext13_rule_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.events(_rows(spark, sf_dir)).drop("order_index")


def assignee_sql(column: str) -> str:
    """The role a name stands for (participants are joined by `key`)."""
    return f"trim({_sub(f'trim({column}, {sql_text(chr(32) + chr(44) + chr(46) + chr(58) + chr(59))})', E.HONORIFIC)})"


_NONE = sorted({plain(x) for x in E.NO_NAMES})
_UNIT = "meeting_id, clause_id"
EVENTS_SQL = (
    SAID_FLAGS_SQL
    + f""", t AS (SELECT *, trim(text_raw) AS text, trim({_sub('trim(text_raw)', E.DISCOURSE)}) AS bare, CASE WHEN {HAS_DATE_SQL} THEN 'DATE-' || clause_id END AS due,
    list(speaker_name) OVER (PARTITION BY meeting_id ORDER BY order_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before,
    NOT list_has_any(flags, [{_list(E.NO_CREATION)}]) AND NOT {matches(_sub('trim(text_raw)', E.TRAILING_DIALOGUE), *E.UNCERTAIN)} AS may FROM flagged),
people AS (SELECT meeting_id, {match_sql('speaker_name')} AS key, arg_min(speaker_name, order_index) AS display FROM t GROUP BY ALL),
fronted_in AS (SELECT *, {_group('bare', E.FRONTED, 2)} AS part FROM t WHERE may AND {matches('bare', E.FRONTED)}), {clean_sql('part', 'fronted_in', 'fr')},
raw AS (
  SELECT {_UNIT}, 0 AS prio, 'TASK_COMMITMENT' AS kind, {_group('text', E.EXISTING, 1)} AS raw, speaker_name AS name, true AS speaks FROM t WHERE {matches('text', E.EXISTING)}
  UNION ALL SELECT {_UNIT}, 1, 'TASK_COMMITMENT', {_group('bare', E.FIRST_PERSON, 1)}, speaker_name, true FROM t WHERE may AND {matches('bare', E.FIRST_PERSON)}
  UNION ALL SELECT {_UNIT}, 2, 'TASK_COMMITMENT', action || ' ' || trim({_group('bare', E.FRONTED, 1)}, ' ,'), speaker_name, true FROM fr
    WHERE {match_sql(f"trim({_group('bare', E.FRONTED, 1)}, ' ,')")} NOT IN ('da', 'vang', 'ok', 'okay') AND {matches('action', '^(?:' + E.VERBS_BY_LENGTH + ')\\b')}
      AND {match_sql('action')} NOT IN ({_list(sorted({plain(x) for x in E.SAYING_LITTLE}))})
  UNION ALL SELECT {_UNIT}, 3, 'OWNER_ASSIGN', 'Hoàn thiện ' || trim({_group('text', E.ROLE, 3)}, ' ,.;:'), {_group('text', E.ROLE, 2)}, false FROM t WHERE may AND {matches('text', E.ROLE)}
  UNION ALL SELECT {_UNIT}, 4, 'OWNER_ASSIGN', {_group('text', E.EXPLICIT, 2)}, {_group('text', E.EXPLICIT, 1)}, false FROM t WHERE may AND {matches('text', E.EXPLICIT)}
  UNION ALL SELECT {_UNIT}, 4, 'OWNER_ASSIGN', {_group('text', E.OWNER, 2)}, {_group('text', E.OWNER, 1)}, false FROM t WHERE may AND NOT {matches('text', E.EXPLICIT)} AND {matches('text', E.OWNER)}
  UNION ALL SELECT {_UNIT}, 5000 - 100 * length(display) + form, 'OWNER_ASSIGN', substr(body, length(regexp_extract(body, {sql_text('(?is)^(.*?)(?:^|[^\\pL\\pN_])(?:' + E.VERBS_BY_LENGTH + ')(?:$|[^\\pL\\pN_])')}, 1)) + 1), display, true FROM (
      SELECT t.*, display, form, base, {_sub('substr(base, length(display) + 1)', E.BODY_START)} AS body FROM
        (SELECT *, 0 AS form, ltrim(text) AS base FROM t UNION ALL SELECT *, 1, {_sub('text', E.ADDRESS)} FROM t WHERE {matches('text', E.ADDRESS)}) t JOIN people p USING (meeting_id)) u
    WHERE may AND starts_with(lower(base), lower(display)) AND length(base) > length(display) AND NOT regexp_matches(substr(base, length(display) + 1), {sql_text(_WORD_START)})
      AND {matches('body', '\\b(?:' + E.VERBS_BY_LENGTH + ')\\b')}
  UNION ALL SELECT {_UNIT}, 9000, 'OWNER_ASSIGN', {_sub(_sub(_group('text', E.VOCATIVE, 2), E.VOCATIVE_CUTS[0]), E.VOCATIVE_CUTS[1])}, {_group('text', E.VOCATIVE, 1)}, false FROM t WHERE may AND {matches('text', E.VOCATIVE)}
  UNION ALL SELECT {_UNIT}, 9001, 'OWNER_ASSIGN', {_group('text', E.DIRECTIVE, 1)}, coalesce(list_filter(before, lambda x: x <> speaker_name)[-1], ''), true FROM t WHERE may AND {matches('text', E.DIRECTIVE)}),
led AS (SELECT * REPLACE (ltrim(regexp_replace(raw, '^[^\\pL\\pN_]+', '')) AS raw) FROM raw WHERE prio BETWEEN 3000 AND 8000 UNION ALL SELECT * FROM raw WHERE prio NOT BETWEEN 3000 AND 8000),
who AS (SELECT led.*, CASE WHEN speaks THEN name ELSE coalesce(display, CASE WHEN {match_sql(assignee_sql('name'))} IN ({_list(E.ROLES)}) AND {match_sql(assignee_sql('name'))} NOT IN ({_list(_NONE)}) THEN {assignee_sql('name')} END, '') END AS assignee
  FROM led LEFT JOIN people ON people.meeting_id = led.meeting_id AND NOT speaks AND people.key = {match_sql(assignee_sql('led.name'))}),
{clean_sql('raw', 'who', 'cl')}, {concrete_sql('action', 'cl', 'cc')},
tells AS (SELECT DISTINCT {_UNIT} FROM cc JOIN t USING (meeting_id, clause_id) WHERE prio = 1 AND {matches('action', E.FOLLOW_UP)} AND {matches('text', E.ONCE_DONE)}),
good AS (SELECT cc.* FROM cc LEFT JOIN tells USING (meeting_id, clause_id) WHERE concrete AND assignee <> '' AND NOT (prio = 1 AND tells.clause_id IS NOT NULL)),
known AS (SELECT * FROM good WHERE prio = 0), fresh AS (SELECT * FROM good WHERE prio > 0 QUALIFY row_number() OVER (PARTITION BY {_UNIT} ORDER BY prio) = 1),
decided AS (SELECT t.*, CASE WHEN known.kind IS NOT NULL THEN 0 WHEN list_contains(flags, 'CANCELLATION') THEN 1 WHEN list_contains(flags, 'REJECTION') THEN 2 WHEN list_contains(flags, 'CORRECTION') AND due IS NOT NULL THEN 3
    WHEN {matches('text', E.NAMED_DEADLINE)} AND due IS NOT NULL AND NOT contains(text, '?') THEN 4 WHEN list_has_any(flags, [{_list(E.NO_CREATION)}]) THEN 9 WHEN fresh.kind IS NOT NULL THEN 5
    WHEN tells.clause_id IS NULL AND NOT {matches('text', '\\bchắc\\b')} AND NOT contains(text, '?') AND NOT {matches('bare', E.EVERYONE)} AND due IS NOT NULL AND list_has_any(flags, ['FIRST_PERSON_COMMITMENT', 'CONFIRMATION']) THEN 6
    ELSE 9 END AS way, known.action AS known_action, known.assignee AS known_assignee, fresh.kind AS fresh_kind, fresh.action AS fresh_action, fresh.assignee AS fresh_assignee
  FROM t LEFT JOIN known USING (meeting_id, clause_id) LEFT JOIN fresh USING (meeting_id, clause_id) LEFT JOIN tells USING (meeting_id, clause_id)),
rule_events AS (SELECT meeting_id, clause_id, order_index, CASE way WHEN 0 THEN 'TASK_COMMITMENT' WHEN 1 THEN 'TASK_CANCEL' WHEN 2 THEN 'TASK_REJECT' WHEN 3 THEN 'DEADLINE_REPLACE' WHEN 5 THEN fresh_kind ELSE 'DEADLINE_SET' END AS event_type,
    CASE way WHEN 0 THEN known_action WHEN 5 THEN fresh_action ELSE '' END AS action_text, CASE way WHEN 0 THEN known_assignee WHEN 5 THEN fresh_assignee WHEN 2 THEN speaker_name WHEN 6 THEN speaker_name ELSE '' END AS assignee,
    CASE way WHEN 1 THEN trim(regexp_replace(text_raw, {_i(E.CANCELLED)}, '', 'g'), ' .') WHEN 4 THEN trim({_group('text', E.NAMED_DEADLINE, 1)}) WHEN 0 THEN '' WHEN 5 THEN '' ELSE text_raw END AS related_task_hint,
    coalesce(due, '') AS deadline_mention_id, round(least(0.99, 0.45 + len(list_filter(flags, lambda f: f IN ('FIRST_PERSON_COMMITMENT', 'DIRECT_ASSIGNMENT', 'CONFIRMATION', 'DATE_MENTION', 'CORRECTION', 'CANCELLATION', 'REJECTION', 'ACTION_VERB', 'EXPLICIT_TASK_LABEL'))) * 0.12), 6)::DOUBLE AS confidence,
    'RULE' AS extraction_source FROM decided WHERE way < 9)"""
)

EXT13 = f"WITH {EVENTS_SQL} SELECT * EXCLUDE (order_index) FROM rule_events"


def ext11_assignees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names in clauses stand for: the speaker's name with a form of address, a role, or no name at all."""
    rows = said(spark, sf_dir)
    spoken = F.element_at(F.array(*map(F.lit, ("anh {}", "{},", "QA", "mọi người", "bạn Khách", "chị {}."))), (F.col("order_index") % 6).cast("int") + 1)
    rows = rows.join(E.participants_of(rows), "meeting_id").withColumn("name", F.replace(spoken, F.lit("{}"), F.col("speaker_name")))
    return rows.select("meeting_id", "clause_id", "name", E.assignee_of(F.col("name"), F.col("participants")).alias("assignee"))


EXT11 = f"""WITH {SAID_SQL}, n AS (SELECT *, replace(['anh {{}}', '{{}},', 'QA', 'mọi người', 'bạn Khách', 'chị {{}}.'][order_index % 6 + 1], '{{}}', speaker_name) AS name FROM said),
people AS (SELECT meeting_id, {match_sql('speaker_name')} AS key, arg_min(speaker_name, order_index) AS display FROM said GROUP BY ALL)
SELECT n.meeting_id, clause_id, name, coalesce(display, CASE WHEN {match_sql(assignee_sql('name'))} IN ({_list(E.ROLES)}) THEN {assignee_sql('name')} END, '') AS assignee
FROM n LEFT JOIN people ON people.meeting_id = n.meeting_id AND people.key = {match_sql(assignee_sql('n.name'))}"""

QUERIES = {
    "ext01_clean_actions": (ext01_clean_actions, EXT01), "cue08_concrete_actions": (cue08_concrete_actions, CUE08), "ext11_assignees": (ext11_assignees, EXT11),
    "ext13_rule_events": (ext13_rule_events, EXT13),
}
