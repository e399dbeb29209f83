"""The ledger as it stood before a clause: candidates for a question, and a replay of retrieval that only sees earlier states.

A meeting's events are applied once, in order; where a question stands, a copy of the state is taken (the version that is valid
there), settled and merged, and ranked. Questions are joined to versions by place, so nothing later is seen.
"""

from __future__ import annotations

import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import match_form
from tessera.operators.linking import MUTATE, STRONG, Ledger, as_table, merges, overlap, plain_event, prepared, same_work

#: Candidates for a question, at most.
MOST = 10

CANDIDATE = (
    "meeting_id long, window_id string, place int, task_id string, task_name string, aliases array<string>, assignee string, status string, last_index long, last_clause string, clauses array<string>"
)
VERSION = (
    "meeting_id long, event_id string, order_index long, task_id string, aliases array<string>, forms array<string>, owners array<string>, owner_forms array<string>, clauses array<string>, last_index long, bound string"
)


def safe_aliases(task: dict) -> list[str]:
    """The name and the aliases that can name the same work."""
    own = task["name"]["match"]
    more = [x["text"] for x in (*task["aliases"].values(), *task["identity"].values()) if own and x["match"] and same_work(own, x["match"])]
    return sorted({x for x in (task["name"]["text"], *more) if x})


def _copied(ledger: Ledger) -> Ledger:
    return Ledger(json.loads(json.dumps(ledger.state())))


def _words(text: str) -> str:
    return " ".join(re.findall(r"\w+", text.casefold()))


def candidates(events: DataFrame, windows: DataFrame, most: int = MOST) -> DataFrame:
    """Of each window (meeting_id, window_id, order_index of its first primary clause, context: its text) the tasks that the meeting's
    events (deduplicated) before it left, without those whose labels contradict each other or that only a weak reference
    names, by likeness with the context."""
    asked = windows.select("meeting_id", F.struct("window_id", F.col("order_index").cast("long").alias("at"), "context", match_form(F.col("context")).alias("form")).alias("window"))
    names = [x.split(" ")[0] for x in CANDIDATE.split(", ")]

    def remember(own: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        ledger, out = Ledger(), []
        rows = sorted((plain_event(e) for e in own["event"]), key=lambda e: (e["at"], e["event_id"])) if len(own) else []
        at = 0
        for q in sorted((x.asDict() if hasattr(x, "asDict") else dict(x) for x in questions["window"]), key=lambda x: (x["at"], x["window_id"])):
            while at < len(rows) and rows[at]["at"] < q["at"]:
                ledger.apply(rows[at])
                at += 1
            out += _ranked(_copied(ledger), q, int(questions["meeting_id"].iloc[0]), most)
        return pd.DataFrame(out, columns=names)

    return prepared(events).groupBy("meeting_id").cogroup(asked.groupBy("meeting_id")).applyInPandas(remember, CANDIDATE)


def _ranked(ledger: Ledger, question: dict, meeting: int, most: int) -> list[tuple]:
    operations = merges(ledger)
    ledger.settle()
    for first, others in operations:
        ledger.merge(first, others)
    text, form, ranked = _words(question["context"] or ""), question["form"] or "", []
    for name in ledger.live():
        task = ledger.tasks[name]
        weak = task["status"] == "PROVISIONAL" and task["confidence"] < STRONG and not any(x["strong"] for x in (task["name"], *task["aliases"].values()))
        if weak or ledger.contradictory(task):
            continue
        alike = max(overlap(_words(x), text) for x in (task["name"]["text"], *safe_aliases(task)))
        named = 1.0 if any(x in form for x in task["owner_forms"].values()) else 0.0
        ranked.append((alike * 3.0 + named, task["last"], name))
    ranked.sort(reverse=True)
    return [
        (
            meeting, question["window_id"], i + 1, name, t["name"]["text"], safe_aliases(t), "; ".join(sorted(set(t["owners"]))), t["status"], t["last"], max(t["clauses"], default=""), sorted(t["clauses"]),
        ) for i, (_, _, name) in enumerate(ranked[:most]) for t in (ledger.tasks[name],)
    ]


def versions(events: DataFrame) -> DataFrame:
    """For each change among the events the tasks that were there before it (VERSION), and the task that the ledger bound it to
    (`bound`, null for none); a change without earlier tasks has one row without task."""
    def replay(own: pa.Table) -> pa.Table:
        ledger, out, meeting, known = Ledger(), [], own.column("meeting_id")[0].as_py(), {}

        def named(name: str, task: dict) -> tuple[list[str], list[str]]:
            """A task's safe aliases and their forms, computed again only if it has got another label."""
            stamp = (task["name"]["text"], len(task["aliases"]), len(task["identity"]))
            if known.get(name, (None,))[0] != stamp:
                forms, texts = {x["text"]: x["match"] for x in (task["name"], *task["aliases"].values(), *task["identity"].values())}, safe_aliases(task)
                known[name] = stamp, (texts, [forms[x] for x in texts])
            return known[name][1]

        for event in sorted((plain_event(e) for e in own.column("event").to_pylist()), key=lambda e: (e["at"], e["event_id"])):
            before = []
            for name, t in sorted(ledger.tasks.items()) if event["kind"] in MUTATE else ():
                if not ledger.ended(name) and t["name"]["text"]:
                    owners = sorted(set(t["owners"]))
                    before.append((name, *named(name, t), owners, [t["owner_forms"][x] for x in owners], sorted(t["clauses"]), t["last"]))
            link = ledger.apply(event)
            if event["kind"] in MUTATE:
                out += [(meeting, event["event_id"], event["at"], *task, link.task) for task in before] or [(meeting, event["event_id"], event["at"], None, [], [], [], [], [], None, link.task)]
        return as_table(out, VERSION)

    return prepared(events).groupBy("meeting_id").applyInArrow(replay, VERSION)
