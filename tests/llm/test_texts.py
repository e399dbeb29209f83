"""Operators 1 to 5 and 10."""

from __future__ import annotations

import base64
import hashlib
import re
import textwrap
from functools import cache
from time import thread_time
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, decontamination, licences, pii, quality, queries, toxicity
from tests.llm import fixtures as X

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tiktoken_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}  # noqa: SIM115
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark, tiktoken_encoding):
    odd = [(500, "don't  stop'll 's\n\n x' re　日本 '"), (501, "ab" * 9000), (502, "<|endoftext|>"), (503, " " * 999 + "x"), (504, "it's'S 123٣Ⅷ _-")]
    rows = X.texts() + odd
    found = bpe.encode(X.documents(spark, rows), PATH, public_tokenizers.PATTERN, with_ids=True).collect()
    expected = sorted((i or 0, tuple(tiktoken_encoding.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((r.doc_id or 0, tuple(r.ids), r.decoded_sha256) for r in found) == expected
    assert all(r.round_trip and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() for r in found)
    assert bpe.encode(X.empty(spark), PATH, public_tokenizers.PATTERN).collect() == []


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=60))
def test_bpe_of_any_text(tiktoken_encoding, text):
    own = bpe.tokenizer(PATH, public_tokenizers.PATTERN)
    ids = own.encode(text)
    assert ids.tolist() == tiktoken_encoding.encode_ordinary(text)
    assert own.decode(ids).decode() == text
    assert own.encode_alone(text).tolist() == ids.tolist()


def test_large_buckets_give_the_same_ids(tiktoken_encoding, monkeypatch):
    monkeypatch.setattr(bpe, "MANY", 1)
    own = bpe.ByteBpe(PATH, public_tokenizers.PATTERN, public_tokenizers.PATTERN)
    for text in ("aaaa" * 50 + "the there" * 40, X.words(9, 400), "eeeé" * 100):
        assert own.encode(text).tolist() == tiktoken_encoding.encode_ordinary(text)


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}
            if ok[kind]:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(text=st.text(alphabet="ab1279.@+- ()é:/", max_size=60))
def test_pii_equals_regular_expressions(text):
    assert [s for s in pii.spans_of(text) if s[0] in pii.BASE] == base_spans(text)


def test_pii_columns_and_redaction(spark):
    text = 'é mail a.b@c.de or http://x.org/p, ip 1.2.3.4 (+1 (223) 555-0100) card 4111 1111 1111 1111, token = "abc123def0"'
    rows = [(1, text), (2, None), (3, ""), (1, text), (None, "x@y.zz")]
    found = pii.find(X.documents(spark, rows)).collect()
    kinds = [s.kind for s in found[0].spans]
    assert kinds == ["email", "ip", "card", "phone", "address", "account"] and found[1].spans == [] and found[3].spans == found[0].spans
    red = pii.redact(X.documents(spark, rows)).collect()
    assert red[0].text == 'é mail [EMAIL] or [ADDRESS], ip [IP] ([PHONE]) card [CARD], token = "[ACCOUNT]"' and red[0].n_chars == len(red[0].text)
    assert red[1].text is None and red[4].text == "[EMAIL]" and red[0].payload == "p"
    digest = queries.op4_pii(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in digest:
        spans = base_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in spans) for x in pii.BASE)


def labelled_rows(n=240):
    """Plain texts; those of odd halves carry an insult or are shouted."""
    rows, labels = [], []
    for i in range(n):
        bad, junk = i % 3 == 0, i % 5 == 0
        text = X.words(1000 + i, 40 + i % 50)
        if bad:
            parts = text.split(" ")
            parts[i % 30] = ("scoundrel", "blockhead", "dimwitted")[i % 3 if i % 2 else 0]
            text = " ".join(parts)
        rows.append((i, " ".join(w.upper() + "!!" for w in text.split(" ")) if junk else text))
        labels.append((i, 0 if junk else 1, int(bad)))
    return rows, labels


def test_classifiers_on_held_out_rows(spark):
    rows, labels = labelled_rows()
    docs, marks = X.documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    voters = quality.fit(docs, marks.where("doc_id % 4 <> 0"))
    good = X.answers(quality.score(docs, voters))
    texts, y = toxicity.labelled(docs, marks.where("doc_id % 4 <> 0"), "toxic", {1: 500, 0: 500})
    bad = X.answers(toxicity.score(docs, toxicity.fit(texts, y)))
    held = [(i, q, t) for i, q, t in labels if i % 4 == 0]
    assert np.mean([(good[i][0] >= 0.3) == q for i, q, _ in held]) > 0.95
    shown = [(i, t) for i, q, t in held if q]
    assert np.mean([(bad[i][0] >= 0.5) == t for i, t in shown]) > 0.85
    assert quality.kept(docs, voters).columns == docs.columns


def test_classifiers_without_labels_or_texts(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = X.documents(spark)
    assert {r.score for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    texts, y = toxicity.labelled(docs, none, "toxic", {1: 5, 0: 5})
    scores = [r.score for r in toxicity.score(docs, toxicity.fit(texts, y)).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert quality.score(X.empty(spark), quality.fit(X.empty(spark), none)).collect() == []


def test_votes_equal_plain_loops_and_dont_depend_on_the_block(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    voters = quality.fit(docs, labels)
    texts = [r.text or "" for r in docs.collect()][:60] * 2 + [""]
    raw = [t.encode() for t in texts]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    together = voters.scores(data, bounds)
    vectors = [[int(x) for x in v] for v in voters.vectors]
    for i, t in enumerate(raw):
        one = np.frombuffer(t, np.uint8)
        assert voters.scores(one, np.array([0, len(one)]))[0] == together[i]
        own = [int(x) for x in voters.latent(one, np.array([0, len(one)]))[0]]
        similar = sorted(((-sum(a * b for a, b in zip(own, v, strict=True)), j) for j, v in enumerate(vectors)))[: quality.NEIGHBOURS]
        weights = [(max(-s, 0) / quality.FINE**2) ** quality.POWER for s, _ in similar]
        expected = sum(w * voters.labels[j] for w, (_, j) in zip(weights, similar, strict=True)) / sum(weights) if sum(weights) > 1e-9 else voters.labels.mean()
        assert abs(together[i] - expected) < 1e-9


def test_folds_are_crc32(spark):
    found = queries.op1_quality(spark, SF).collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)


def test_benchmark_items_are_found_and_others_not(spark):
    items = [(i, X.words(2000 + i, 18 + 4 * i)) for i in range(8)]
    changed = items[5][1].split(" ")
    changed[3:5] = ["filler", "filler"]
    rows = [(i, X.words(3000 + i, 200)) for i in range(60)]
    rows += [(200 + i, X.words(4000 + i, 60) + "\n" + t.capitalize() + ". " + X.words(5000 + i, 60)) for i, t in items]
    rows += [(300, X.words(1, 30) + " " + " ".join(changed) + " " + X.words(2, 30)), (301, None), (302, ""), (None, items[2][1])]
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, " .,"), (93, items[0][1])], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(X.documents(spark, rows), bench).collect()}
    assert found == {(200 + i, i) for i, _ in items} | {(300, 5), (None, 2), (200, 93)}
    assert decontamination.contaminated(X.documents(spark, rows), bench.where("item_id is null")).collect() == []
    assert decontamination.contaminated(X.empty(spark), bench).collect() == []


def test_licence_notices(spark):
    classifier = licences.fit(["the committee met and the minutes were read", "der Vertrag ist nicht gültig"])
    rows = [
        (1, "intro\nReleased under the MIT license, see file.\nend"), (2, "my driving license expired\nLicensed under the Apache License, Version 2.0 (the License)"), (3, None), (4, ""),
        (5, "license"), (6, "This work is licensed under the GNU General Public License, version 2."), (6, "This work is licensed under the GNU General Public License, version 2."), (None, "Licensed under CC BY-NC 4.0."),
    ]
    df = licences.notices(X.documents(spark, rows), classifier)
    got = sorted((r.doc_id or 0, r.paragraph, r.family) for r in df.collect())
    assert got == [(0, 0, "CC-BY-NC-4.0"), (1, 1, "MIT"), (2, 0, "unknown"), (2, 1, "Apache-2.0"), (5, 0, "unknown"), (6, 0, "GPL-2.0")]
    assert licences.notices(X.empty(spark), classifier).collect() == []
    assert all(any(c in t.lower() for c in licences.CUES) for v in licences.TEMPLATES.values() for t in v)
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def brute_common(item, text, idf):
    """The longest common subsequence of item and text, weighted, as a share of the item."""
    best = [0.0] * (len(text) + 1)
    for x in item:
        last = 0.0
        for j, y in enumerate(text):
            last, best[j + 1] = best[j + 1], max(best[j + 1], best[j], last + idf(x) if x == y else 0.0)
    return best[-1] / sum(map(idf, item))


def weights_of(docs):
    """The operator's idf of a word."""
    idf = decontamination.idf_of(docs)

    def weight(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        return float(idf[decontamination.slot(decontamination.words(raw, np.array([0, len(raw)])).hash)][0])

    return cache(weight)


def fresh(prefix, n):
    return [f"{prefix}x{i}" for i in range(n)]


def test_paraphrases_with_fresh_words_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    common = X.words(50, 300).replace("é", "e").split(" ")
    items = [(i, [f"i{i}w{k}" if k % 2 else str(rng.choice(common)) for k in range((20, 30, 44, 59)[i % 4])]) for i in range(40)]
    rows, pairs = [(10_000 + i, " ".join(rng.choice(common, 150))) for i in range(60)], []
    for i, own in items:
        for share in (0.55, 0.6, 0.65, 0.7):
            doc = 4 * i + len(pairs) % 4
            kept = set(rng.choice(len(own), round(share * len(own)), replace=False).tolist())
            said = fresh(f"a{doc}", int(rng.integers(30, 60))) + [x if k in kept else f"d{doc}s{k}" for k, x in enumerate(own)] + fresh(f"b{doc}", 40)
            rows.append((doc, " ".join(said)))
            pairs.append((doc, i, own, said))
    docs = X.documents(spark, rows)
    idf = weights_of(docs)
    expected = set()
    for doc, i, own, said in pairs:
        whole, answer = brute_common(own, said, idf), brute_common(own[-(len(own) // 4) :], said, idf)
        if whole >= 0.55 and answer >= 0.5:
            expected.add((doc, i))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    assert len(expected) > 60 and found == expected


def test_long_items_are_found_by_their_passages(spark):
    items = [(i, [f"i{i}w{k}" for k in range(n)]) for i, n in enumerate((59, 200, 300, 500, 800))]
    rows = [(1000 + i, X.words(6000 + i, 120)) for i in range(40)]
    for i, own in items:
        rows.append((i, " ".join(fresh(f"a{i}", 37) + own + fresh(f"b{i}", 50))))
        rows.append((100 + i, " ".join(fresh(f"c{i}", 21) + [x if k % 5 in (0, 2, 4) else f"d{i}s{k}" for k, x in enumerate(own)] + fresh(f"e{i}", 50))))
        rows.append((200 + i, " ".join(fresh(f"f{i}", 21) + own[: len(own) // 3] + fresh(f"g{i}", 50))))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.common for r in decontamination.contaminated(X.documents(spark, rows), bench).collect()}
    assert set(found) == {(k + i, i) for i, _ in items for k in (0, 100)}
    assert all(found[i, i] == 1 and 0.55 < found[100 + i, i] < 0.65 for i, _ in items)


def segment_sums(terms, x, out):
    """Adds A'A x to out, the sums by reduceat."""
    y = np.zeros((len(terms.inside), x.shape[1]), np.float32)
    head = np.flatnonzero(np.append(True, terms.row[1:] != terms.row[:-1]))
    y[terms.row[head]] = np.add.reduceat(x[terms.word] * terms.weight[:, None], head)
    order = np.argsort(terms.word, kind="stable")
    word = terms.word[order]
    head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    out[word[head]] += np.add.reduceat(y[terms.row[order]] * terms.weight[order, None], head)


def cpu_seconds(f, rounds=5):
    """Of this thread (Spark gives its tasks one for BLAS), the least of some rounds."""
    took = []
    for _ in range(rounds):
        start = thread_time()
        f()
        took.append(thread_time() - start)
    return min(took)


def test_products_of_passages_are_exact_and_cheap():
    """A x and A'y are those of the dense matrix, and take less than half of the CPU time of sums by reduceat. Some rows are empty,
    some words stand nowhere, and some rows and words have more terms than are added up one after the other."""
    rng = np.random.default_rng(5)
    size, rank, often = 4000, 128, np.arange(1, 4001) ** -1.1
    own = [np.sort(rng.choice(size, n, replace=False, p=often / often.sum())) for n in (*rng.integers(0, 15, 2046), 300, 64)]
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    word, weight = np.concatenate(own), rng.random(len(row)).astype(np.float32)
    terms = decontamination.Terms(row, word, weight, np.ones(len(own)), np.ones(len(own)))
    dense = np.zeros((len(own), size))
    dense[row, word] = weight
    assert (dense != 0).sum(0).max() > 64 and (dense != 0).sum(0).min() == (dense != 0).sum(1).min() == 0
    x = rng.normal(size=(size, rank)).astype(np.float32)
    y = terms.times(x)
    out = np.ones((size, rank), np.float32)
    terms.onto(y, out)
    assert np.allclose(y, dense @ x, atol=1e-4) and np.allclose(out, 1 + dense.T @ (dense @ x), atol=1e-3)
    nothing = decontamination.Terms(row[:0], word[:0], weight[:0], np.ones(3), np.ones(3))
    nothing.onto(nothing.times(x), out)
    assert not nothing.times(x).any() and nothing.times(x).shape == (3, rank)
    assert cpu_seconds(lambda: terms.onto(terms.times(x), out)) < 0.5 * cpu_seconds(lambda: segment_sums(terms, x, out))


def test_words_are_known_by_their_slots():
    """Also where a slot holds several words of the vocabulary, at both ends, and where none is known."""
    items = decontamination.Items([1], [" ".join(fresh("v", 3000))], np.ones(decontamination.SLOTS, np.float32))
    near = np.concatenate([items.vocabulary - np.uint64(1), items.vocabulary + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)])
    hashes = np.random.default_rng(6).permutation(np.concatenate([items.vocabulary, near]))
    assert np.bincount(decontamination.slot(items.vocabulary)).max() > 1
    hit, at = items.known(hashes)
    assert np.array_equal(hit, np.isin(hashes, items.vocabulary)) and np.array_equal(items.vocabulary[at[hit]], hashes[hit])
    assert not items.known(near)[0].any() and len(items.known(near[:0])[0]) == 0
    for x in (np.zeros(0, np.int64), np.array([3, 0, 3, 1, 0])):
        assert decontamination.distinct(x).tolist() == sorted(set(x.tolist()))


def test_wrapped_licence_notices(spark):
    classifier = licences.fit(["the committee met and the minutes were read", "der Vertrag ist nicht gültig"])
    bodies = [(k, v[-1]) for k, v in licences.TEMPLATES.items() if k in ("MIT", "BSD", "GPL-3.0", "ISC")]
    rows, expected = [], []
    for width in (30, 50, 72):
        for k, body in bodies:
            i, lines = len(rows), textwrap.wrap(body, width)
            rows.append((i, "\n".join(["first line", "", *[("# " if i % 2 else "") + x for x in lines], "", "the end"])))
            expected.append((i, 2, k))
    rows.append((50, "\n\n".join(textwrap.wrap(bodies[0][1], 50))))
    rows.append((51, "intro\n" + "\n".join(textwrap.wrap(bodies[0][1], 60)) + "\nReleased under the BSD License."))
    got = sorted((r.doc_id, r.paragraph, r.family) for r in licences.notices(X.documents(spark, rows), classifier).collect())
    assert [x for x in got if x[0] < 50] == sorted(expected)
    assert {x[2] for x in got if x[0] == 50} == {"unknown"}
    assert [x for x in got if x[0] == 51] == [(51, 1, "MIT"), (51, 1 + len(textwrap.wrap(bodies[0][1], 60)), "BSD")]


def test_decorated_and_repeated_notices(spark):
    """Any number of signs before the lines, repeated notices, and a notice far down a very long text."""
    classifier = licences.fit(["the committee met and the minutes were read", "der Vertrag ist nicht gültig"])
    body = textwrap.wrap(licences.TEMPLATES["MIT"][-1], 22)
    boxed = ["*" * 600 + " " + x for x in body]
    rows = [(1, "\n".join(boxed)), (2, "\n".join([*body, "", *body])), (3, "\n".join(["plain words here"] * 4000 + body)), (4, "\n".join(body)), (4, "\n".join(body))]
    got = sorted((r.doc_id, r.paragraph, r.family) for r in licences.notices(X.documents(spark, rows), classifier).collect())
    assert got == [(1, 0, "MIT"), (2, 0, "MIT"), (2, len(body) + 1, "MIT"), (3, 4000, "MIT"), (4, 0, "MIT")]


def test_lines_score_as_the_model_says(spark):
    """Every line with a cue of the given documents against the same model in plain loops."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    c = licences.fit(licences.sample(docs))
    weights = dict(zip(c.grams, c.weights, strict=True))
    expected = {}
    for r in docs.collect():
        for i, line in enumerate((r.text or "").split("\n")):
            if any(cue in line.lower() for cue in licences.CUES):
                own = licences.tokens(line)
                grams = set(own) | {f"{a} {b}" for a, b in zip(own, own[1:], strict=False)}
                z = (c.bias + sum((weights[g] for g in grams if g in weights), np.zeros(len(c.names)))) / c.temperature
                p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
                known = max((len(set(licences.tokens(t)) & set(own)) / len(set(licences.tokens(t))) for t in licences.TEMPLATES.get(c.names[int(z.argmax())], [])), default=0.0)
                sure = p.max() >= licences.PROBABLE and known >= licences.CONFIRMED and c.names[int(z.argmax())] != licences.UNKNOWN
                expected[r.doc_id, i] = (c.names[int(z.argmax())] if sure else licences.UNKNOWN, bool(any(g in weights for g in grams)), round(float(p.max()), 4))
    found = {(r.doc_id, r.paragraph): r for r in licences.notices(docs, c).collect()}
    assert expected and set(expected) <= set(found)
    for key, (family, has_terms, probability) in expected.items():
        assert found[key].family == family
        assert not has_terms or abs(found[key].probability - probability) < 1e-3
