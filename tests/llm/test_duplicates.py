"""Operators 7, 8 and 9 against brute force."""

from __future__ import annotations

import hashlib
import re

import pytest

from tessera.llm import jaccard, substrings, suffixes
from tessera.llm.components import components
from tests.llm import fixtures as X

WORD = r"[^\x20\x09-\x0D]+"


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_linked_equals_all_pairs(spark, n, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in X.by_id():
        w = re.findall(WORD, text.translate(lower))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    found = jaccard.linked(X.documents(spark), n, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == {i: (len(s), find(i)) for i, s in sets.items()}
    assert sum(r.doc_id is None and r.component_id is None for r in found) == 2


def test_large_cells_take_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 0)
    monkeypatch.setattr(jaccard, "TRIES", 1)
    found = X.answers(jaccard.linked(X.documents(spark), 3, 90))
    assert len({found[i][1] for i in range(100, 125)}) == 1


def test_removed_words_equal_all_windows(spark):
    seen, expected = {}, {}
    for i, text in X.by_id():
        w = re.findall(WORD, text)
        windows = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        gone = [False] * len(w)
        for k, x in enumerate(windows):
            if seen.get(x, i) < i:
                gone[k : k + 50] = [True] * 50
        for x in windows:
            seen.setdefault(x, i)
        expected[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    found = substrings.remove_repeats(X.documents(spark))
    assert X.answers(found) == expected
    assert sum(r.doc_id is None for r in found.collect()) == 2


def test_removed_bytes_equal_all_strings(spark):
    seen, expected = set(), {}
    for i, text in X.by_id():
        raw = text.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            x = raw[k : k + 100]
            if x in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(x)
        runs = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        expected[i] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    found = suffixes.remove_repeats(X.documents(spark))
    assert X.answers(found) == expected


def test_loser_tree_merges_without_losing_order():
    runs = [sorted([b"abc", b"abd", b"b"]), [b"abc", b"abca"], [], [b"a"]]

    def shares(run):
        return [0] + [next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(run, run[1:], strict=False)]

    order, shared = suffixes.merged([(r, shares(r)) for r in runs])
    out = [runs[r][i] for r, i in order]
    assert out == sorted(x for r in runs for x in r)
    assert shared[1:] == shares(out)[1:]


def test_empty_tables(spark):
    assert jaccard.linked(X.empty(spark)).collect() == []
    assert substrings.remove_repeats(X.empty(spark)).collect() == []
    assert suffixes.remove_repeats(X.empty(spark)).collect() == []


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}
