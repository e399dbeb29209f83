"""Contexts in tiers, memory as of a clause and the replay of retrieval against plain loops."""

from __future__ import annotations

import math

from conftest import SF
from pyspark.sql import functions as F

from tessera.operators import linking, memory, topics
from tessera.plans import linked, recalled


def cosine(a, b):
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return max(0.0, min(1.0, sum(x * y for x, y in zip(a, b, strict=True)) / norm)) if norm else 0.0


def test_contexts_equal_plain_packing(spark, monkeypatch):
    monkeypatch.setattr(topics, "MOST_CHARACTERS", 900)  # so that both budgets are hit
    rows = topics.segmented(recalled.spoken(spark, SF)).where("meeting_id < 4").cache()
    asked = rows.where("order_index % 5 = 1").select("meeting_id", F.concat_ws("/", "meeting_id", "clause_id").alias("query_id"), "order_index", "vector").cache()
    ids = lambda step: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: F.format_string("CLAUSE-%06d", (F.col("order_index") * step + j * 9 + F.col("task_at") * 5) % 90 + 1))
    evidence = asked.select("query_id", F.col("order_index").cast("long").alias("order_index"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("task_at")).select("query_id", "task_at", ids(3).alias("source_ids"), ids(5).alias("history_ids")).cache()
    found = {r.query_id: r for r in topics.contexts(asked, rows, evidence).collect()}
    meetings, tasks = {}, {}
    for r in rows.collect():
        meetings.setdefault(r.meeting_id, []).append(r)
    for r in evidence.collect():
        tasks.setdefault(r.query_id, {})[r.task_at] = r
    assert len(found) == asked.count()
    hit = set()
    for q in asked.collect():
        own = sorted(meetings[q.meeting_id], key=lambda r: r.order_index)
        size = {r.clause_id: len(r.text_raw) for r in own}
        chosen, caps, total = [], set(), 0

        def add(clause, tier, chosen=chosen, caps=caps, size=size):
            if clause in [c for c, _ in chosen] or clause not in size:
                return
            used = sum(size[c] for c, _ in chosen)
            if len(chosen) >= 30:
                caps.add("clauses")
            elif used + size[clause] > 900:
                caps.add("characters")
            else:
                chosen.append((clause, tier))

        at = next(i for i, r in enumerate(own) if r.order_index == q.order_index)
        add(own[at].clause_id, "local")
        for r in own[max(0, at - 3) : at + 6]:
            add(r.clause_id, "local")
        mine = [tasks[q.query_id][i] for i in range(5)]
        for t in mine:
            for c in t.source_ids:
                add(c, "task_source")
        by_topic = {}
        for r in own:
            by_topic.setdefault(r.topic_id, []).append(r)
        mean = lambda rs: [sum(x) / len(rs) for x in zip(*(r.vector for r in rs), strict=True)]
        ranked = sorted(by_topic.values(), key=lambda rs: (-round(cosine(q.vector, mean(rs)), 6), rs[0].order_index))[:3]
        taken = {c for c, _ in chosen}
        near = [r.clause_id for rs in ranked for r in sorted(rs, key=lambda r: (-round(cosine(q.vector, r.vector), 6), r.order_index)) if r.clause_id not in taken][:12]
        for c in near:
            add(c, "topic")
        for t in mine:
            for c in t.history_ids[-3:]:
                add(c, "history")
        r = found[q.query_id]
        assert list(zip(r.ids, r.tiers, strict=True)) == chosen
        assert (r.clause_cap, r.character_cap, r.characters) == ("clauses" in caps, "characters" in caps, sum(size[c] for c, _ in chosen))
        assert len(r.ids) <= 30 and r.characters <= 900
        hit |= caps | set(r.tiers)
        total += 1
    assert hit >= {"characters", "local", "task_source", "topic"}


def test_memory_is_what_earlier_events_left(spark):
    events = linked.shaped_events(spark, SF).where("meeting_id < 3").cache()
    rows = recalled.spoken(spark, SF).where("meeting_id < 3 and order_index % 20 = 19")
    windows = rows.select("meeting_id", F.col("clause_id").alias("window_id"), "order_index", F.col("text_raw").alias("context"))
    found = {}
    for r in memory.candidates(events, windows).collect():
        found.setdefault((r.meeting_id, r.window_id), []).append((r.place, r.task_id, r.task_name, r.status, r.last_index))
    prepared = linking.prepared(events).collect()
    assert len(found) >= 6
    for w in windows.collect():
        before = [r.event for r in prepared if r.meeting_id == w.meeting_id and r.event.at < w.order_index]
        book = linking.applied(linking.Ledger(), before)
        expected = memory._ranked(book, {"window_id": w.window_id, "context": w.context, "form": linking_form(spark, w.context)}, w.meeting_id, memory.MOST)
        assert sorted(found.get((w.meeting_id, w.window_id), [])) == [(x[2], x[3], x[4], x[7], x[8]) for x in expected]
        assert len(expected) <= 10 and all(x[8] < w.order_index for x in expected)


def linking_form(spark, text):
    from tessera.functions.text import match_form

    return spark.createDataFrame([(text,)], "t string").select(match_form(F.col("t"))).first()[0]


def test_replay_sees_earlier_states_only(spark):
    events = linked.shaped_events(spark, SF).where("meeting_id < 3").cache()
    seen = {}
    for r in memory.versions(events).collect():
        seen.setdefault((r.meeting_id, r.event_id), []).append(r)
    prepared = {(r.meeting_id, r.event.event_id): r.event for r in linking.prepared(events).collect()}
    changes = {k for k, e in prepared.items() if e.kind in memory.MUTATE}
    assert set(seen) == changes
    for (meeting, ident), own in seen.items():
        this = prepared[meeting, ident]
        before = [e for (m, _), e in prepared.items() if m == meeting and (e.at, e.event_id) < (this.at, this.event_id)]
        book = linking.applied(linking.Ledger(), before)
        assert sorted(r.task_id for r in own if r.task_id) == sorted(book.live())
        assert all(r.last_index <= this.at for r in own if r.task_id)
        assert {r.bound for r in own} == {book.apply(linking.plain_event(this)).task}
    found = recalled.ret09_replay(spark, SF).where("split(query_id, '/')[0] < 3").collect()
    assert {(int(r.query_id.split("/")[0]), r.query_id.split("/")[1]) for r in found} == changes
    assert {r.status for r in found} >= {"DIRECT_LINK", "UNRESOLVED"}


def test_links_make_no_rows_of_pairs(spark):
    from tessera.plans import reduced

    plan = reduced.ret06_task_links(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_scores_are_rounded_as_by_spark(spark):
    import random

    import numpy as np

    from tessera.operators import retrieval

    rng = random.Random(4)
    values = [0.0, 1.0, 0.1234565, 0.5000005, 0.6000015, 0.9999995, 0.78, *(rng.randrange(10**7) / 10**7 for _ in range(500)), *(rng.random() for _ in range(500))]
    exact = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").orderBy("i").select(F.round("x", 6)).collect()]
    assert retrieval.rounded(np.array(values)).tolist() == exact


def test_replay_folds_its_events_once(spark):
    plan = recalled.ret09_replay(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsIn") == 0


def searched_once(plan):
    """Whether each pattern of cues stands above a grouping by text, not on each clause."""
    lines = plan.split("\n")
    at = [i for i, x in enumerate(lines) if "xin trả lại task" in x and "Project" in x]
    return bool(at) and all(any("Aggregate [text_raw" in y for y in lines[i : i + 4]) for i in at)


def test_flags_of_features_are_searched_once_for_a_text(spark):
    from tessera.plans import offlined

    assert searched_once(offlined.ml02_probabilities(spark, SF)._jdf.queryExecution().optimizedPlan().toString())


def test_flags_of_candidates_are_searched_once_for_a_text(spark):
    from tessera.plans import routed

    assert searched_once(routed.win05_candidates(spark, SF)._jdf.queryExecution().optimizedPlan().toString())


def test_topics_are_searched_without_rows_of_pairs(spark):
    from tessera.plans import reduced

    plan = reduced.ret08_topic_search(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert " Join " not in plan and "Generate posexplode" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_contexts_make_no_row_for_a_part_or_an_id(spark):
    plan = recalled.win13_contexts(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" not in plan and "LeftAnti" not in plan and "FlatMapCoGroupsInArrow" in plan
