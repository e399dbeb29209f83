"""The ratio of texts against the standard library, and the ledger with linking against a plain one that compares everything."""

from __future__ import annotations

import difflib
import random
import re

import pytest
from conftest import SF
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import ratio as R
from tessera.functions.text import plain
from tessera.operators import linking
from tessera.plans import linked

SCHEMA = (
    "meeting_id long, event_id string, event_type string, related_task_id string, related_task_hint string, action_text string, assignee string, deadline_mention_id string, "
    "extraction_source string, confidence double, source_clause_ids array<string>, corroborated_by_rule boolean, order_index long"
)
NAMES = [x.split(":")[0].split(" ")[0] for x in SCHEMA.split(", ")]


def reference_ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


@settings(max_examples=300, deadline=None)
@given(st.text("abc đê", max_size=60), st.text("abc đê", max_size=60))
def test_ratio_equals_the_standard_library(a, b):
    assert R.ratio(a, b) == reference_ratio(a, b)
    assert R.most(a, b) >= R.ratio(a, b)


def test_ratio_of_many_pairs_and_of_long_texts(monkeypatch):
    rng = random.Random(4)
    pairs = []
    for n in range(20_000):
        alphabet = rng.choice(("ab", "abcdefgh ", "xyz đêà"))
        size = rng.choice((0, 3, 12, 30)) if n % 100 else rng.choice((199, 200, 260, 420))
        a = "".join(rng.choice(alphabet) for _ in range(size))
        b = a[: size // 2] + "".join(rng.choice(alphabet) for _ in range(size // 2 + (n % 100 == 0) * 60))
        pairs.append((a, b))
    assert all(R.ratio(a, b) == reference_ratio(a, b) for a, b in pairs)
    monkeypatch.setattr(R, "CELLS", 4)  # row by row
    for a, b in pairs[::37]:
        assert 2.0 * R.common(a, b) == pytest.approx(reference_ratio(a, b) * (len(a) + len(b)) if a or b else 0.0)


def test_join_by_likeness_equals_all_pairs(spark):
    rng = random.Random(8)
    words = ("report", "budget", "release", "plan", "for", "the", "api")
    rows = [(i, i % 3, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))) for i in range(60)] + [(60, 0, None), (61, 1, "")]
    left = spark.createDataFrame(rows, "i long, k int, a string")
    right = spark.createDataFrame(rows, "j long, k int, b string")
    found = {(r.i, r.j): r.ratio for r in R.alike(left, right, ["k"], "a", "b", 0.8).collect()}
    every = {(i, j): reference_ratio(a, b) for i, k, a in rows for j, m, b in rows if k == m and a is not None and b is not None}
    assert found == {p: x for p, x in every.items() if x >= 0.8}


class Plain:
    """A ledger that looks at every task for every event, with sets and the standard library only."""

    def __init__(self):
        self.tasks, self.left, self.blocked = {}, [], []

    @staticmethod
    def meaning(text):
        out = plain(text)
        for a, b in ((r"\bdata\s*set\b", "du lieu"), (r"\bbo du lieu\b", "du lieu"), (r"\bmodule\b", "")):
            out = re.sub(a, b, out)
        return " ".join(out.split())

    @staticmethod
    def row(text):
        found = re.match(r"(?:task\s*)?(\d{1,3}|[a-z])\s*[:–—-]\s*", plain(text))
        return found.group(1) if found else ""

    @staticmethod
    def tokens(a, b):
        x, y = set(re.findall(r"\w+", a)), set(re.findall(r"\w+", b))
        return len(x & y) / len(x | y) if x and y else 0.0

    def score(self, e, t, veto=True):
        text = e["action_text"] or e["related_task_hint"]
        forms = {plain(o) for o in t["owners"]}
        if veto and e["assignee"] and forms and e["event_type"] not in ("OWNER_ASSIGN", "OWNER_REASSIGN") and plain(e["assignee"]) not in forms:
            return 0.0
        rows = {self.row(a) for a in t["aliases"]} - {""}
        if e["event_type"] in linking.IDENTITY and self.row(text) and rows and self.row(text) not in rows:
            return 0.0
        own, best = self.meaning(text), 0.0
        for other in filter(None, map(self.meaning, t["aliases"])):
            if own:
                best = max(best, 0.85 if own in other or other in own else 0.0, reference_ratio(own, other), self.tokens(own, other))
        return min(1.0, best + 0.3) if e["event_type"] == "OWNER_ASSIGN" and e["assignee"] and plain(e["assignee"]) in forms and best >= 0.45 else best

    def find(self, e):
        kind, ended = e["event_type"], lambda t: t["status"] in ("CANCELLED", "REJECTED")
        identity = kind in linking.IDENTITY
        if e["related_task_id"]:
            t = self.tasks.get(e["related_task_id"])
            return (None, ()) if t is None else ("blocked", ()) if identity and ended(t) else (e["related_task_id"], ())
        form = plain(e["action_text"] or e["related_task_hint"])
        same = [i for i, t in self.tasks.items() if form and form in {plain(a) for a in t["aliases"]}]
        if len(same) > 1:
            return None, tuple(same)
        if same and not ended(self.tasks[same[0]]):
            return same[0], ()
        if same and identity:
            return "blocked", ()
        if identity and e["extraction_source"] == "RULE_FINAL_RECAP":
            return None, ()
        live = {i: t for i, t in self.tasks.items() if not ended(t)}
        mine = [i for i, t in live.items() if e["assignee"] and plain(e["assignee"]) in {plain(o) for o in t["owners"]}]
        if kind in linking.CREATE and e["deadline_mention_id"] and len(mine) == 1 and self.score(e, live[mine[0]]) >= 0.45:
            return mine[0], ()
        least, margin = linking.LINK[kind]
        ranked = sorted(((self.score(e, t), t["last"], i) for i, t in live.items()), reverse=True)
        near = tuple(i for s, _, i in ranked if s >= least - margin)
        if ranked and ranked[0][0] >= least and ranked[0][0] - (ranked[1][0] if len(ranked) > 1 else 0) >= margin:
            return ranked[0][2], near
        if near:
            return None, near
        recent = [i for i in mine if 0 <= e["order_index"] - live[i]["last"] <= 20]
        if kind == "DEADLINE_SET" and len(recent) == 1:
            return recent[0], ()
        if kind == "DEADLINE_REPLACE" and len(live) == 1 and 0 <= e["order_index"] - next(iter(live.values()))["last"] <= 5:
            return next(iter(live)), ()
        gone = sorted(((self.score(e, t, False), i) for i, t in self.tasks.items() if ended(t)), reverse=True)
        if identity and gone and gone[0][0] >= 0.8 and gone[0][0] - (gone[1][0] if len(gone) > 1 else 0) >= 0.15:
            return "blocked", ()
        return None, ()

    def apply(self, e, strong):
        found, _ = self.find(e)
        kind, source = e["event_type"], e["extraction_source"]
        owners = [x.strip() for x in e["assignee"].split(";") if x.strip()]
        if found == "blocked":
            self.blocked.append(e["event_id"])
            return
        if found is None:
            known = e["related_task_id"] and (source == "AI" or e["related_task_id"].upper().startswith("TASK-"))
            reference = kind == "TASK_REFERENCE" and e["action_text"].strip() and source.startswith("RULE_REFERENCE")
            if known or (not reference and (source in ("AI", "RULE_CONTEXT") or kind in linking.MUTATE)):
                self.left.append(e)
                return
            if not reference and (kind not in linking.CREATE or not e["action_text"].strip() or source not in linking.MAY_CREATE):
                return
            found = f"TASK-{len(self.tasks) + 1:06d}"
            status = "UNKNOWN" if not reference else "CONFIRMED" if source == "RULE_REFERENCE_ACTIVE" else "PROVISIONAL"
            text = e["action_text"].strip()
            self.tasks[found] = {"name": text, "aliases": {text}, "identity": {text}, "owners": list(owners), "mention": e["deadline_mention_id"], "status": status, "created": e["order_index"],
                                 "last": e["order_index"], "clauses": set(), "refs": set(), "events": [], "sources": set(), "confidence": 0.0}
        t = self.tasks[found]
        if source == "AI" and kind in linking.DEADLINE:
            labels = [plain(x) for x in t["identity"] if strong(x) and len(plain(x).split()) >= 3]
            fits = lambda a, b: a in b or b in a or self.tokens(a, b) >= 0.5 or reference_ratio(a, b) >= 0.8 or reference_ratio(b, a) >= 0.8
            if any(not fits(a, b) for a in labels for b in labels):
                self.left.append(e)
                return
        text = e["action_text"].strip()
        if kind == "TASK_CREATE" and text:
            t["identity"].add(text)
        if kind == "TASK_REFERENCE":
            t["refs"] |= set(e["source_clause_ids"])
        if kind in linking.CREATE and text and (source in linking.RECAP or (source != "HUMAN_NOTE" and "HUMAN_NOTE" in t["sources"])):
            now, new = plain(t["name"]), plain(text)
            if now and now in new and len(new.split()) > len(now.split()) and not re.search(linking.NO_NAME, e["action_text"], re.I):
                t["name"] = text
        if plain(text):
            t["aliases"].add(text)

        def confirmed():
            if t["status"] != "PROVISIONAL":
                return True
            if source == "AI" and kind in linking.DEADLINE and (not e["corroborated_by_rule"] or len(t["refs"]) < 2):
                return False
            if t["confidence"] >= 0.92 or any(strong(x) for x in t["aliases"] | {t["name"]}):
                t["status"] = "CONFIRMED"
                return True
            return False

        if kind in linking.ENDED:
            t["status"] = linking.ENDED[kind]
        elif kind == "OWNER_REASSIGN":
            if owners:
                t["status"] = "REASSIGNED" if confirmed() else t["status"]
                t["owners"] = owners
        elif kind in linking.DEADLINE:
            confirmed()
            t["mention"] = e["deadline_mention_id"] or t["mention"]
        elif kind in linking.CREATE and (owners or kind != "OWNER_ASSIGN"):
            t["status"] = "CONFIRMED" if confirmed() else t["status"]
            t["owners"] += [o for o in owners if o not in t["owners"]]
            t["mention"] = e["deadline_mention_id"] or t["mention"]
        t["clauses"] |= set(e["source_clause_ids"])
        t["events"].append(e["event_id"])
        t["last"], t["confidence"] = max(t["last"], e["order_index"]), max(t["confidence"], e["confidence"])
        t["sources"].add(source)

    def settle(self, strong):
        for e in [e for e in self.left if e["event_type"] == "DEADLINE_SET" and e["assignee"]]:
            mine = [i for i, t in self.tasks.items() if t["status"] not in ("PROVISIONAL", "CANCELLED", "REJECTED") and plain(e["assignee"]) in {plain(o) for o in t["owners"]} and abs(t["created"] - e["order_index"]) <= 20]
            if len(mine) == 1:
                self.left.remove(e)
                self.apply(e | {"related_task_id": mine[0]}, strong)

    def rows(self, meeting):
        return [(meeting, i, t["name"], "; ".join(t["owners"]), t["mention"], t["status"], t["created"], t["last"], t["events"], sorted(t["clauses"]), sorted(t["sources"])) for i, t in sorted(self.tasks.items())]


def as_rows(df):
    return sorted((r.meeting_id, r.task_id, r.task_name, r.assignee, r.deadline_mention_id, r.status, r.first_index, r.last_index, r.events, r.clauses, r.sources) for r in df.collect())


def by_plain_ledger(events, settle=True):
    """The plain ledger over collected events; which labels may name a task is asked of the guard, label by label."""
    from tessera.operators.guards import promotable

    rows = [r.asDict() for r in events.collect()]
    session = events.sparkSession
    texts = {r["action_text"] or "" for r in rows} | {(r["action_text"] or "").strip() for r in rows}
    may = {r.t: r.p for r in session.createDataFrame([(t,) for t in texts], "t string").select("t", promotable("t").alias("p")).collect()}
    out = []
    for meeting in {r["meeting_id"] for r in rows}:
        book = Plain()
        for e in sorted((r for r in rows if r["meeting_id"] == meeting), key=lambda r: (r["order_index"], r["event_id"])):
            book.apply({n: e.get(n) if e.get(n) is not None else d for n, d in DEFAULTS.items()}, may.__getitem__)
        if settle:
            book.settle(may.__getitem__)
        out += book.rows(meeting)
    return sorted(out)


DEFAULTS = {"event_id": "", "event_type": "", "related_task_id": "", "related_task_hint": "", "action_text": "", "assignee": "", "deadline_mention_id": "", "extraction_source": "", "confidence": 0.0,
            "source_clause_ids": [], "corroborated_by_rule": False, "order_index": 0}


def test_ledger_equals_the_plain_one_over_the_given_table(spark):
    events = linked.shaped_events(spark, SF)
    assert events.select("shape").distinct().count() >= 30
    found = as_rows(linking.folded(events))
    assert found == by_plain_ledger(events)
    assert {r[5] for r in found} == {"UNKNOWN", "PROVISIONAL", "CONFIRMED", "REASSIGNED", "CANCELLED", "REJECTED"}


@pytest.mark.parametrize("seed", range(3))
def test_ledger_equals_the_plain_one_on_random_events(spark, seed):
    rng = random.Random(seed)
    nouns, verbs = ("báo cáo doanh thu", "budget report", "data set", "bộ dữ liệu", "API module", "release plan", "tài liệu"), ("viết", "gửi", "review", "update", "")
    rows = []
    for i in range(400):
        kind = rng.choice((*linking.IDENTITY, *linking.MUTATE))
        action = rng.choice(("", "Task 3: ", "B - ", "", "", "")) + f"{rng.choice(verbs)} {rng.choice(nouns)} {rng.choice(('', '', 'Q1', 'tháng 3'))}".strip()
        rows.append((
            i % 12, f"E{i:04d}", kind, rng.choice(("", "", "", "", "TASK-000001", "TASK-000009", "X1")), rng.choice((None, "", "budget report")), rng.choice((action, action, action, "", None)),
            rng.choice(("", "", "An", "Bình", "An; Chi", None)), rng.choice(("", f"D{i}", None)), rng.choice((*linking.MAY_CREATE, *linking.UPDATE_ONLY, "RULE_REFERENCE", "RULE_REFERENCE_ACTIVE")),
            rng.choice((0.5, 0.88, 0.95)), [f"C{i}"], rng.choice((True, False, None)), rng.randrange(60),
        ))
    events = spark.createDataFrame(rows, SCHEMA)
    assert as_rows(linking.folded(events)) == by_plain_ledger(events)


def event(n, kind, action="", owner="", due="", source="RULE", target="", confidence=0.9):
    return (1, f"E{n:02d}", kind, target, "", action, owner, due, source, confidence, [f"C{n}"], False, n)


def one(spark, *rows, **more):
    return {r.task_id: r for r in linking.folded(spark.createDataFrame(list(rows), SCHEMA), **more).collect()}


def test_a_shortened_name_cancels_its_task_and_a_sibling_stays(spark):
    got = one(spark, event(1, "TASK_CREATE", "Viết báo cáo doanh thu quý một", "An"), event(2, "TASK_CREATE", "Viết báo cáo nhân sự", "Chi"), event(3, "TASK_CANCEL", "báo cáo doanh thu quý một"))
    assert [got[x].status for x in sorted(got)] == ["CANCELLED", "CONFIRMED"]


def test_an_ambiguous_change_binds_to_nothing(spark):
    got = one(spark, event(1, "TASK_CREATE", "Review budget alpha"), event(2, "TASK_CREATE", "Review budget omega"), event(3, "DEADLINE_REPLACE", "review budget", due="D1"))
    assert {r.deadline_mention_id for r in got.values()} == {""}


def test_what_was_cancelled_is_not_begun_again(spark):
    got = one(spark, event(1, "TASK_CREATE", "Send weekly report", "An"), event(2, "TASK_CANCEL", "Send weekly report"), event(3, "TASK_CREATE", "Send the weekly report", "An"))
    assert [(r.status, r.n_events) for r in got.values()] == [("CANCELLED", 2)]


def test_a_deadline_before_its_task_is_bound_late(spark):
    rows = [event(1, "DEADLINE_SET", "", "An", due="D1"), event(9, "TASK_CREATE", "Write spec", "An"), event(40, "DEADLINE_SET", "", "Chi", due="D2")]
    assert one(spark, *rows)["TASK-000001"].deadline_mention_id == "D1"
    assert one(spark, *rows, settle=False)["TASK-000001"].deadline_mention_id == ""


def test_a_reference_becomes_a_task_only_if_it_names_work(spark):
    rows = [event(1, "TASK_REFERENCE", "migration plan", source="RULE_REFERENCE", confidence=0.8), event(2, "OWNER_ASSIGN", "migration plan", "An"), event(3, "TASK_REFERENCE", "chuyện kia", source="RULE_REFERENCE", confidence=0.8),
            event(4, "OWNER_ASSIGN", "chuyện kia", "Chi")]
    assert [r.status for _, r in sorted(one(spark, *rows).items())] == ["CONFIRMED", "PROVISIONAL"]


def test_merging_what_is_one_task(spark):
    rows = [event(1, "TASK_CREATE", "Write the release plan", "An", "D1", "RULE_FINAL_RECAP"), event(2, "TASK_CREATE", "Write the release plans now", "An", "D1", "RULE_FINAL_RECAP"),
            event(3, "TASK_CREATE", "prepare budget of the team", "Chi"), event(4, "TASK_CREATE", "Prepare the budget of team", "", "", "RULE_FINAL_RECAP"), event(5, "TASK_CREATE", "Prepare budget for team X", "Bob")]
    got = one(spark, *rows, merge=True)
    assert sorted(got) == ["TASK-000001", "TASK-000002", "TASK-000003", "TASK-000005"]
    assert got["TASK-000003"].events == ["E03", "E04"] and got["TASK-000003"].sources == ["RULE", "RULE_FINAL_RECAP"]


def test_merge_candidates_equal_all_pairs(spark):
    owners = lambda r: {x for x in r.assignee.split("; ") if x}
    tasks = [r for r in linking.folded(linked.shaped_events(spark, SF)).collect() if r.status not in ("PROVISIONAL", "CANCELLED", "REJECTED")]
    scores = {}
    for x in tasks:
        for y in tasks:
            if x.meeting_id != y.meeting_id or x.task_id >= y.task_id or ("RULE_FINAL_RECAP" in x.sources and "RULE_FINAL_RECAP" in y.sources):
                continue
            if (owners(x) and owners(y) and not owners(x) & owners(y)) or (x.deadline_mention_id and y.deadline_mention_id and x.deadline_mention_id != y.deadline_mention_id):
                continue
            a, b = ({Plain.meaning(t) for t in (*r.aliases, r.task_name)} - {""} for r in (x, y))
            of = lambda p, q: 1.0 if p == q else max(0.9 if p in q or q in p else 0.0, reference_ratio(p, q), Plain.tokens(p, q))
            best = max((of(p, q) for p in a for q in b), default=0.0)
            if best >= 0.84:
                scores.setdefault((x.meeting_id, x.task_id), []).append((best, y.task_id))
                scores.setdefault((x.meeting_id, y.task_id), []).append((best, x.task_id))
    sure = {}
    for key, own in scores.items():
        own.sort(reverse=True)
        if own[0][0] - (own[1][0] if len(own) > 1 else 0.0) >= 0.08:
            sure[key] = own[0]
    expected = sorted((m, a, b, round(s, 6)) for (m, a), (s, b) in sure.items() if a < b and sure.get((m, b), (0, ""))[1] == a)
    found = sorted((r.meeting_id, r.a, r.b, r.score) for r in linked.led04_mutual_merges(spark, SF).collect())
    assert found == expected and found


def test_best_pairs_by_name_equal_every_assignment(spark):
    from itertools import permutations

    from tessera.functions.text import plain as form
    from tessera.operators import evaluation as E

    rng = random.Random(2)
    words = ("viết", "báo cáo", "doanh thu", "release", "plans", "plan", "review", "contract")
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))
    schema = "case_id long, task_id long, task_key string, task_name string"
    e, a = ([(c, 100 * c + i, "", name()) for c in range(25) for i in range(rng.randrange(1, 5))] for _ in range(2))
    found = E.paired(spark.createDataFrame(e, schema), spark.createDataFrame(a, schema)).collect()

    def score(x, y):
        p, q = form(x), form(y)
        if p == q:
            return 1.0
        (s, t), both = [set(re.findall(r"\w+", z)) - SAID_NOTHING for z in (p, q)], 0
        if s and t:
            both = len(s & t)
            both = 0.9 * both / min(len(s), len(t)) + 0.1 * both / len(s | t)
        best = max(both, reference_ratio(p, q))
        return best if best >= 0.72 else 0.0

    SAID_NOTHING = set()
    for case in range(25):
        left, right = [r for r in e if r[0] == case], [r for r in a if r[0] == case]
        if len(left) > len(right):
            options = ([(i, j) for j, i in enumerate(p)] for p in permutations(range(len(left)), len(right)))
        else:
            options = ([(i, j) for i, j in enumerate(p)] for p in permutations(range(len(right)), len(left)))
        best = (0, 0.0)
        for option in options:
            values = [v for v in (score(left[i][3], right[j][3]) for i, j in option) if v > 0]
            best = max(best, (len(values), round(sum(values), 6)))
        own = [r.score for r in found if r.case_id == case]
        assert (len(own), round(sum(own), 6)) == best


def test_operations_are_checked(spark):
    book = linking.applied(linking.Ledger(), [r.event for r in linking.prepared(spark.createDataFrame([
        event(1, "TASK_CREATE", "Write spec", "An"), event(2, "TASK_CREATE", "Send letter to bank", "Chi"), event(3, "TASK_CANCEL", "Send letter to bank"), event(4, "DEADLINE_SET", "something else", due="D1"),
    ], SCHEMA)).collect()])
    assert not book.merge("TASK-000001", ["TASK-000002"]) and not book.merge("TASK-000001", []) and not book.merge("", ["TASK-000001"])
    assert not book.bind("E04", "TASK-000002") and not book.bind("E99", "TASK-000001") and book.bind("E04", "TASK-000001")
    assert book.tasks["TASK-000001"]["mention"] == "D1" and not book.unresolved
    again = linking.Ledger(book.state())
    assert again.rows(1) == book.rows(1)


def test_a_final_recap_leaves_what_it_names(spark):
    from tessera.operators import recaps

    tasks, clauses, scope = linked._snapshot_inputs(spark, SF)
    labels = {r.meeting_id: list(r.labels) for r in recaps.active_labels(clauses).collect()}
    scopes = {r.meeting_id: r.scope for r in scope.collect()}
    own, expected, left = {}, set(), {}
    for r in tasks.collect():
        own.setdefault(r.meeting_id, []).append(r)
    for meeting, rows in own.items():
        rows.sort(key=lambda r: r.task_id)
        kept, said = [], labels.get(meeting, [])
        for label in said:
            ranked = []
            for r in rows:
                a, b = plain(r.task_name), plain(label)
                overlap, alike = Plain.tokens(a, b), reference_ratio(a, b)
                if overlap >= 0.6 or alike >= 0.7:
                    ranked.append((max(overlap, alike), int(bool(r.deadline_mention_id)) + int(plain(r.assignee) not in recaps.NO_OWNERS), r.last_index, r))
            if ranked:
                best = max(ranked, key=lambda x: x[:3])[3]
                if best.task_id not in [k.task_id for k in kept]:
                    kept.append(best)
        whole = scopes[meeting] == "AUTHORITATIVE" and said and len(kept) == len(said)
        left[meeting] = bool(whole)
        expected |= {(meeting, r.task_id) for r in (kept if whole else rows)}
    assert {(r.meeting_id, r.task_id) for r in linked.pol04_active_snapshot(spark, SF).collect()} == expected
    assert any(left.values()) and not all(left.values()) and all(3 != m % 5 or m not in labels for m in own)


def test_a_snapshot_folds_its_events_once(spark):
    plan = linked.pol04_active_snapshot(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsIn") <= 1


def test_what_is_computed_once_for_a_text_equals_that_of_each_row(spark):
    from tessera.functions.text import match_form, once

    rows = spark.createDataFrame([(1, "Gửi  Báo cáo"), (2, None), (3, "Gửi  Báo cáo"), (4, ""), (5, None)], "n int, t string")
    found = once(rows, ["t"], lambda t: t.withColumn("form", match_form(F.col("t"))))
    assert found.columns == ["n", "t", "form"]
    assert sorted(map(tuple, found.collect())) == [(1, "Gửi  Báo cáo", "gui bao cao"), (2, None, None), (3, "Gửi  Báo cáo", "gui bao cao"), (4, "", ""), (5, None, None)]


def test_pairs_of_parts_equal_those_of_the_whole():
    import numpy as np

    from tessera.operators import evaluation as E

    rng = random.Random(1)
    for _ in range(400):
        r, c = rng.randrange(1, 5), rng.randrange(1, 5)
        m = np.array([[rng.choice([0, 0, 0.72, 0.8, 1.0, round(rng.random(), 3)]) for _ in range(c)] for _ in range(r)])
        assert E.few_pairs(m.tolist()) == E.best_pairs(m)
        found = E.linked_pairs({(i, j): m[i, j] for i in range(r) for j in range(c) if m[i, j] > 0})
        assert abs(sum(1e6 + s for _, _, s in found) - E.brute_pairs(m)) < 1e-6
        assert len({e for e, _, _ in found}) == len({a for _, a, _ in found}) == len(found)


def test_pairing_makes_no_rows_of_pairs(spark):
    from tessera.plans import evaluated

    plan = evaluated.jon10_fuzzy_pairs(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_names_meet_by_their_words_without_scoring_all_pairs(spark, monkeypatch):
    from tessera.operators import evaluation as E

    asked, score = [], E.name_score
    monkeypatch.setattr(E, "name_score", lambda *x: asked.append(x) or score(*x))
    tasks = [(i, "", f"order{i}") for i in range(3000)]
    assert E.linked_pairs(E.case_scores(tasks, tasks, by_characters=False)) == [(i, i, 1.0) for i in range(3000)]
    assert len(asked) == 3000
    assert E.case_scores([(1, "", "the task")], [(2, "", "the task"), (3, "", "task")], False) == {(1, 2): 1.0}  # without a word that tells
