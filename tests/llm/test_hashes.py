"""Hashes of words and passages: equal ones meet, words of a regular pattern don't collide."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import jaccard, substrings
from tessera.llm.blocks import LOWER, byte_grams, byte_hashes, in_a_row, words
from tests.llm import fixtures as X


def regular(n, a="a", b="b"):
    """The order of Thue and Morse: hashes that are sums of powers of an odd base can't tell it from its complement."""
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@settings(max_examples=200, deadline=None)
@given(data=st.binary(max_size=200), n=st.sampled_from((1, 3, 5, 8, 16, 32)))
def test_byte_grams_depend_on_their_bytes_only(data, n):
    raw = np.frombuffer(data, np.uint8)
    found = byte_grams(raw, n)
    assert len(found) == max(0, len(data) - n + 1)
    seen = {}
    for i, h in enumerate(found.tolist()):
        assert seen.setdefault(data[i : i + n], h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=200, deadline=None)
@given(values=st.lists(st.integers(0, 3), max_size=80), n=st.integers(1, 60))
def test_values_in_a_row(values, n):
    found = in_a_row(np.array(values, np.uint64), n).tolist()
    assert len(found) == max(0, len(values) - n + 1)
    seen = {}
    for i, h in enumerate(found):
        assert seen.setdefault(tuple(values[i : i + n]), h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_pieces_and_empty_ones():
    data = np.frombuffer(b"x" * 300 + b"y" * 300, np.uint8)
    start, end = np.array([0, 0, 1, 300, 5, 5, 0]), np.array([300, 64, 65, 600, 5, 6, 65])
    h = byte_hashes(data, start, end).tolist()
    assert h[1] == h[2] and len({h[0], h[1], h[3], h[4], h[5], h[6]}) == 6


def test_regular_words_are_told_apart(spark):
    one, other = regular(1024), regular(1024, "b", "a")
    raw = np.frombuffer(f"{one} {other}".encode(), np.uint8)
    assert len(set(words(raw, np.array([0, len(raw)])).hash.tolist())) == 2
    fill = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join([*fill, one, *fill])), (2, " ".join([*fill, other, *fill])), (3, one), (4, other), (5, regular(1024, "a ", "b ")), (6, regular(1024, "b ", "a "))]
    docs = X.documents(spark, rows)
    removed = {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs).collect()}
    assert removed[2] == 0 and removed[4] == 0
    found = {r.doc_id: r.component_id for r in jaccard.linked(docs, 3, 90).collect()}
    assert found[3] == 3 and found[4] == 4 and found[2] == 2


def test_chunks_of_a_large_cell_meet_in_pairs(spark):
    base = X.words(1, 130).split(" ")
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(40)]
    found = jaccard.linked(X.documents(spark, rows), 3, 90, rounds=1, few=0, tries=1, chunk=7).collect()
    assert {r.component_id for r in found} == {0}


def test_words_of_one_first_hash_are_told_apart(spark):
    """Two words of 16 bytes whose first 64-bit hashes were solved to be equal."""
    one, other, third = "identityprovider", "LFD9VBv8RtV2hkO3", "usf2lset6}3?db(a"
    raw = np.frombuffer(f"{one} {other}".encode(), np.uint8)
    w = words(raw, np.array([0, len(raw)]), twin=True)
    assert w.hash[0] == w.hash[1] and w.twin[0] != w.twin[1]
    fill = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join([*fill, one, *fill])), (2, " ".join([*fill, other, *fill])), (3, one), (4, third), (5, other), (6, f"{one} {other} x"), (7, f"{other} {one} x")]
    docs = X.documents(spark, rows)
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs).collect()} == dict.fromkeys(range(1, 8), 0)
    found = {r.doc_id: r.component_id for r in jaccard.linked(docs, 3, 90).collect()}
    assert found == {i: i for i in range(1, 8)}


def test_grams_of_one_first_hash_count_twice():
    data = np.frombuffer(b"identityprovider LFD9VBv8RtV2hkO3 identityprovider", np.uint8)
    sets = jaccard.sets_of(LOWER[data], np.array([0, len(data)]), 1)
    same_case = jaccard.sets_of(np.frombuffer(b"identityprovider usf2lset6}3?db(a", np.uint8), np.array([0, 33]), 1)
    assert len(sets.value) == 2 and len(same_case.value) == 2
    assert not jaccard.alike(same_case.of(0), (same_case.value[:1], same_case.twin[1:]), 90)
