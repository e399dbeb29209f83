"""Claims of notes against a search through all clauses."""

from __future__ import annotations

import re

from conftest import SF
from pyspark.sql import functions as F

from tessera.functions.text import STOPWORDS, plain
from tessera.operators import grounding as G
from tessera.plans import grounded


def keys(text):
    out = []
    for w in re.findall(r"\w+", plain(text)):
        if len(w) >= 3 and w not in STOPWORDS and not re.match(r"^(?:\d+|dl|ddl|due|deadline|eta|han|thu|ngay|tuan|am|pm)$", w) and w not in out:
            out.append(w)
    return set(out[:8])


def tokens(text):
    return set(re.findall(r"\w+", text.lower()))


def test_claims_equal_a_search_through_all_clauses(spark):
    found = {(r.meeting_id, r.claim_id): r for r in grounded.jon08_note_claims(spark, SF).collect()}
    meetings = {}
    for r in grounded.clauses(spark, SF).collect():
        meetings.setdefault(r.meeting_id, []).append(r)
    levels = set()
    for meeting, rows in meetings.items():
        for i, (text, action, owner, date, operation) in enumerate(grounded.CLAIMS):
            reference = action or text
            ranked = []
            for c in rows:
                a, b = keys(text), keys(c.text_raw)
                lexical = len(a & b) / min(len(a), len(b)) if a and b else 0.0
                s, t = tokens(reference), tokens(c.text_raw)
                semantic = max(lexical, len(s & t) / len(s | t) if s and t else 0.0)
                if semantic:
                    ranked.append((-semantic, -lexical, c.order_index, c.clause_id, c))
            ranked.sort(key=lambda x: x[:4])
            chosen = [x[4] for x in ranked[:8]]
            joined = plain(" ".join(c.text_raw for c in chosen))
            top, second = (-ranked[0][0] if ranked else 0.0), (-ranked[1][0] if len(ranked) > 1 else 0.0)
            holds = lambda hint, joined=joined: hint is None or bool(hint and plain(hint) in joined)
            acts = operation is None or (any(w in joined for w in G.OPERATION_WORDS[operation]) if operation in G.OPERATION_WORDS else holds(operation))
            last = max((c.order_index for c in chosen), default=0)
            against = [c.clause_id for c in chosen if c.order_index >= last and set(c.flags) & set(G.TAKEN_BACK) and len(tokens(reference) & tokens(c.text_raw)) / len(tokens(reference) | tokens(c.text_raw)) >= 0.25]
            supported = bool(chosen) and top >= 0.72
            level = "CONTRADICTED" if against else "FULL_GROUNDED" if supported and top - second >= 0.12 and holds(owner) and holds(date) and acts else "PARTIAL_GROUNDED" if supported else "NOTE_ONLY"
            r = found[meeting, i]
            assert (r.level, r.clause_ids, r.against) == (level, ",".join(c.clause_id for c in chosen), ",".join(against))
            assert abs(r.semantic - top) < 1e-6 and abs(r.margin - max(0.0, top - second)) < 1e-6
            levels.add(level)
    assert len(found) == len(meetings) * len(grounded.CLAIMS) and levels >= {"CONTRADICTED", "PARTIAL_GROUNDED", "NOTE_ONLY"}


def test_a_claim_with_one_clear_clause_is_grounded(spark):
    clauses = spark.createDataFrame([(1, "C1", 0, "Em sẽ gửi báo cáo doanh thu trước thứ sáu", []), (1, "C2", 1, "ok", []), (2, "C1", 0, None, [])], "meeting_id int, clause_id string, order_index int, text_raw string, flags array<string>")
    claims = spark.createDataFrame([(1, 1, "gửi báo cáo doanh thu", None, None, "thứ sáu", None), (2, 1, "gửi báo cáo doanh thu", None, None, None, None), (3, 1, "", None, None, None, None)],
                                   "meeting_id int, claim_id int, text string, action_hint string, owner_hint string, date_hint string, operation_hint string")
    assert {(r.meeting_id, r.level) for r in G.grounded_claims(claims, clauses).collect()} == {(1, "FULL_GROUNDED"), (2, "NOTE_ONLY"), (3, "NOTE_ONLY")}
    assert G.grounded_claims(claims, clauses.where(F.lit(False))).where("level <> 'NOTE_ONLY'").count() == 0
