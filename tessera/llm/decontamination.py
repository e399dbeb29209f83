"""Benchmark passages in documents, verbatim or paraphrased (operator 2).

Method: latent semantic retrieval. Words are lower-cased and freed of punctuation; document frequencies (hashed into
SLOTS) come from all documents. A passage is WINDOW words of a document or an item.

A first pass over all documents does two things. It adds up each task's share of A'(A X) for a randomised SVD, A being the
TF-IDF vectors of all passages of all documents and of the items (the items' share weighs as much as all documents', or
the corpus's frequent words would fill the space): vocabulary x rank numbers, whatever the number of passages. And it keeps
the stretches of words that can hold an item at all: an item is looked for among the words around a passage (as many as the
item has, REACH at least), so in a stretch of a few times as many; where the item's words there, in any order and however
often, weigh less than PARAPHRASE of it, no subsequence of them can weigh more. This bound is exact: it drops only what the
last check would refuse.

Passages of these stretches (every STRIDE words) are searched in the latent space: of at most RANK dimensions and half as many
as there are items, so that words that stand together in the corpus lie together. A cosine of LATENT with a passage of an
item makes a candidate; both are normalised there, so words outside the benchmark's vocabulary, the words around a paraphrase
and the item's length don't lower it. The space is an approximation, so an exact search stands beside it: a cosine of COSINE
of the TF-IDF vectors over the vocabulary, by postings, makes a candidate as well. Candidates are checked by
their longest common subsequence with the words around the passage, weighted by idf. Verbatim ones (VERBATIM) count at
once, paraphrases (PARAPHRASE) only if the item's answer, its last quarter, is there too.

The items are held by every task, ITEM_BLOCK of them at a time; larger benchmarks are searched block by block.

Edge cases: null and empty texts match nothing; items without words are ignored; an item that stands several times in a
document gives one row; items of equal text all match; equal cosines need no order, as every candidate is checked; rows of
one doc_id give the best match of any; rows without doc_id are searched and reported under null; very long texts are
searched whole, some passages at a time; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import LOWER, Words, blocks, narrowed, words, written
from tessera.llm.lsa import range_finder
from tessera.llm.packed import PACKED, array_rows, tree_sum

WINDOW, STRIDE, REACH, SLOTS, OVER, ITEM_BLOCK = 16, 8, 64, 1 << 18, 32, 512

#: Dimensions of the latent space at most (it has half as many as there are items, if that is less).
RANK = 96

#: Least cosine of a candidate in the latent space and by postings, least weighted common subsequence of a verbatim and of a paraphrased item, and of a
#: paraphrase's answer.
LATENT, COSINE, VERBATIM, PARAPHRASE, ANSWER = 0.6, 0.3, 0.85, 0.55, 0.5

#: Cells (passages x items) that a task fills at a time, and passages whose vectors it multiplies at a time.
CELLS, AT_ONCE = 1 << 20, 1 << 11

#: Terms of a passage or word up to which they are added up one after the other, and how many of those with more are multiplied at a time.
DEEP = 64

#: Pieces that sums over all tasks are sent in.
PIECES = 16

_MATCH = "doc_id long, item_id long, cosine double, common double, answer double"


def plain(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for two-byte Latin letters; ASCII punctuation as blanks."""
    out = LOWER[data]
    code = np.arange(128)
    keep = ((code >= 48) & (code <= 57)) | ((code >= 97) & (code <= 122))
    blank = np.zeros(256, bool)
    blank[:128] = ~keep
    out[blank[out]] = 0x20
    if len(out) > 1:
        second = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)) + 1
        out[second] += 0x20
    return out


def slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def distinct(x: np.ndarray) -> np.ndarray:
    """The values once each, in order (`np.unique` hashes integers first, which takes several times as long)."""
    x = np.sort(x)
    return x[np.diff(x, prepend=x[:1] - 1) != 0]


def idf_of(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each slot, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SLOTS, np.int64), 0
        for block in blocks(batches):
            w = words(plain(block.data), block.bounds)
            total += np.bincount(distinct(w.row * SLOTS + slot(w.hash)) % SLOTS, minlength=SLOTS)
            n += block.batch.num_rows
        yield array_rows([*np.split(total, PIECES), np.array([n])])

    sums = tree_sum(narrowed(docs, "text").mapInArrow(run, PACKED))
    seen = np.concatenate([sums[i] for i in range(PIECES)]) if sums else np.zeros(SLOTS)
    n = int(sums[PIECES][0]) if sums else 0
    return np.log((1 + n) / (1 + seen)).astype(np.float32) + np.float32(0.05)


class Terms(NamedTuple):
    """TF-IDF terms of passages within the vocabulary, by passage: `word` is a place in the vocabulary."""

    row: np.ndarray
    word: np.ndarray
    weight: np.ndarray
    inside: np.ndarray  # each passage's length over the vocabulary
    whole: np.ndarray  # and over all words

    def times(self, x: np.ndarray) -> np.ndarray:
        """A x, for A the passages as rows."""
        out = np.zeros((len(self.inside), x.shape[1]), np.float32)
        _gathered(x, self.word, self.weight, self.row, out)
        return out

    def onto(self, y: np.ndarray, out: np.ndarray) -> None:
        """Adds A'y to out."""
        order = np.argsort(self.word, kind="stable")
        _gathered(y, self.row[order], self.weight[order], self.word[order], out)


def _gathered(values: np.ndarray, source: np.ndarray, weight: np.ndarray, target: np.ndarray, out: np.ndarray) -> None:
    """Adds weight x values[source] to out[target] for terms sorted by target, a whole row of values at a time. (The same by
    `np.add.reduceat` takes several times as long, as it adds up number by number.) The first terms of all targets go at
    once, then the second ones, and so on; targets of more than DEEP terms are multiplied as a dense matrix."""
    if not len(target):
        return
    head = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
    count = np.diff(np.append(head, len(target)))
    deep = np.flatnonzero(count > DEEP)
    for low in range(0, len(deep), DEEP):
        own = deep[low : low + DEEP]
        n = count[own]
        line = np.repeat(np.arange(len(own)), n)
        at = np.arange(len(line)) + np.repeat(head[own] - (np.cumsum(n) - n), n)
        dense = np.zeros((len(own), len(values)), np.float32)
        np.add.at(dense, (line, source[at]), weight[at])
        out[target[head[own]]] += dense @ values
    flat = np.flatnonzero(count <= DEEP)
    flat = flat[np.argsort(-count[flat], kind="stable")]
    if not len(flat):
        return
    head, count = head[flat], count[flat]
    longer = len(flat) - np.cumsum(np.bincount(count))  # targets with more than k terms
    total = np.zeros((len(flat), values.shape[1]), np.float32)
    for k in range(int(count[0])):
        at = head[: longer[k]] + k
        part = values[source[at]]
        part *= weight[at, None]
        total[: longer[k]] += part
    out[target[head]] += total


class Items:
    """Word hashes of some items, their vocabulary (sorted), their TF-IDF vectors over it, and postings of
    their passages (owner: the item of each)."""

    def __init__(self, ids: list[int], texts: list[str], idf: np.ndarray) -> None:
        raw = [x.encode("utf-8") for x in texts]
        w = words(plain(np.frombuffer(b"".join(raw), np.uint8)), np.cumsum([0, *map(len, raw)]))
        self.words = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.ids, self.idf = ids, idf
        self.vocabulary = np.unique(w.hash)
        #: The first word of the vocabulary in each slot, or after it.
        self.slots = np.minimum(np.searchsorted(slot(self.vocabulary), np.arange(SLOTS)), len(self.vocabulary) - 1)
        self.places = [np.searchsorted(self.vocabulary, x) for x in self.words]
        self.weights = [idf[slot(x)].astype(np.float64) for x in self.words]
        whole = self.terms(w.hash, w.first[:-1], w.first[1:])
        self.whole = whole._replace(weight=whole.weight / whole.whole[whole.row].astype(np.float32))
        self.owner, a, b = starts_in(w.first)
        self.passages = keys = self.terms(w.hash, a, b)
        order = np.argsort(keys.word, kind="stable")
        self.post_key, self.post_weight = keys.row[order], (keys.weight / keys.inside[keys.row])[order]
        self.post_first = np.append(0, np.cumsum(np.bincount(keys.word, minlength=len(self.vocabulary))))

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether and where hashes stand in the vocabulary, or would: a slot rarely holds two of its words."""
        at = self.slots[slot(hashes)]
        later = np.flatnonzero(self.vocabulary[at] < hashes)
        at[later] = np.minimum(np.searchsorted(self.vocabulary, hashes[later]), len(self.vocabulary) - 1)
        return self.vocabulary[at] == hashes, at

    def terms(self, hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> Terms:
        """Of the passages hashes[a:b]."""
        return self.cut(*self.known(hashes), self.idf[slot(hashes)].astype(np.float64), a, b)

    def cut(self, hit: np.ndarray, at: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray) -> Terms:
        """Of the passages a:b of words whether and where they stand in the vocabulary, and of what weight."""
        row = np.repeat(np.arange(len(a)), b - a)
        word = np.arange(len(row)) + np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a)
        own = hit[word]
        other = np.bincount(row[~own], weight[word[~own]] ** 2, len(a))
        key, back = np.unique(row[own] * len(self.vocabulary) + at[word[own]], return_inverse=True)
        total = np.bincount(back, weight[word[own]], len(key))
        row, word = key // len(self.vocabulary), key % len(self.vocabulary)
        inside = np.bincount(row, total * total, len(a))
        return Terms(row, word, total.astype(np.float32), np.sqrt(inside + 1e-12), np.sqrt(inside + other + 1e-12))

    def cosines(self, x: Terms) -> np.ndarray:
        """With the passages of the items, over the vocabulary."""
        n = self.post_first[x.word + 1] - self.post_first[x.word]
        term = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(term)) + np.repeat(self.post_first[x.word] - (np.cumsum(n) - n), n)
        cell = x.row[term] * len(self.owner) + self.post_key[at]
        out = np.bincount(cell, x.weight[term] * self.post_weight[at], len(x.inside) * len(self.owner)).reshape(-1, len(self.owner))
        return out / x.inside[:, None]

    def enough(self, item: int, present: np.ndarray) -> bool:
        """Whether the words that stand in a region (by their place in the vocabulary) can make up a paraphrase."""
        return self.weights[item][present[self.places[item]]].sum() >= PARAPHRASE * self.weights[item].sum() - 1e-9

    def common(self, item: int, region: np.ndarray) -> tuple[float, float]:
        """The longest common subsequence of item and region, weighted by idf, as a share of the item; and the same of the
        item's last quarter."""
        own = self.words[item]
        weight = self.weights[item]
        return _common(own, weight, region), _common(own[-max(1, len(own) // 4) :], weight[-max(1, len(own) // 4) :], region)


class Bound:
    """Stretches of words that can hold one of some items of about equal length, by the weight of the items' words in them."""

    def __init__(self, items: Items, which: list[int], reach: int) -> None:
        #: Words around a passage, and the passage: any such region lies within two neighbouring units of this size.
        self.unit = WINDOW + 2 * reach
        place = np.concatenate([items.places[i] for i in which])
        owner = np.repeat(np.arange(len(which)), [len(items.places[i]) for i in which])
        order = np.argsort(place, kind="stable")
        self.owner, self.weight = owner[order], np.concatenate([items.weights[i] for i in which])[order]
        self.size, self.items = len(items.vocabulary), len(which)
        self.first = np.append(0, np.cumsum(np.bincount(place, minlength=self.size)))
        self.least = PARAPHRASE * np.array([items.weights[i].sum() for i in which]) - 1e-9

    def stretches(self, w: Words, hit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, first and last word (past it) of stretches that can hold an item."""
        count = np.diff(w.first)
        units = -(-count // self.unit)
        begin = np.append(0, np.cumsum(units))
        known = np.flatnonzero(hit)
        unit = begin[w.row[known]] + (known - w.first[w.row[known]]) // self.unit
        keys = distinct(unit * self.size + at[known])
        opens = np.zeros(begin[-1] + 1, bool)
        opens[begin[:-1]] = True  # the first unit of a row has none before it
        back = keys[~opens[keys // self.size]] - self.size
        keys = distinct(np.concatenate([keys, back]))
        good = []
        step = max(1, CELLS // self.items)
        for low in range(0, int(begin[-1]), step):
            high = min(low + step, int(begin[-1]))
            own = keys[np.searchsorted(keys, low * self.size) : np.searchsorted(keys, high * self.size)]
            word = own % self.size
            n = self.first[word + 1] - self.first[word]
            term = np.repeat(np.arange(len(n)), n)
            post = np.arange(len(term)) + np.repeat(self.first[word] - (np.cumsum(n) - n), n)
            cell = (own // self.size - low)[term] * self.items + self.owner[post]
            weight = np.bincount(cell, self.weight[post], (high - low) * self.items).reshape(-1, self.items)
            good.append(np.flatnonzero((weight >= self.least).any(1)) + low)
        good = np.concatenate(good) if good else np.zeros(0, np.int64)
        row = np.searchsorted(begin, good, "right") - 1
        low = w.first[row] + (good - begin[row]) * self.unit
        return row, low, np.minimum(low + 2 * self.unit, w.first[row + 1])


def bounds_of(items: Items) -> list[Bound]:
    """One for each class of lengths: REACH words, twice as many, and so on."""
    classes: dict[int, list[int]] = {}
    for i, own in enumerate(items.words):
        reach = REACH
        while reach < len(own):
            reach *= 2
        classes.setdefault(reach, []).append(i)
    return [Bound(items, which, reach) for reach, which in sorted(classes.items())]


def _common(own: np.ndarray, weight: np.ndarray, region: np.ndarray) -> float:
    best = np.zeros(len(region) + 1)
    for x, w in zip(own, weight, strict=True):
        step = np.maximum(best[1:], np.where(region == x, best[:-1] + w, 0))
        best[1:] = np.maximum.accumulate(step)
    return float(best[-1] / weight.sum())


def starts_in(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last word of the passages of rows first[i]:first[i + 1]: every STRIDE words, and one that ends with the
    last word."""
    count = np.diff(first)
    n = np.where(count > 0, np.maximum(0, -(-(count - WINDOW) // STRIDE)) + 1, 0)
    row = np.repeat(np.arange(len(count)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    a = first[row] + np.minimum(nth * STRIDE, np.maximum(0, count[row] - WINDOW))
    return row, a, np.minimum(a + WINDOW, first[row + 1])


class Passages(NamedTuple):
    """Some passages of a block: their terms, rows and words, and their cosines with the items' passages."""

    terms: Terms
    row: np.ndarray
    a: np.ndarray
    b: np.ndarray
    cosine: np.ndarray


def _passages(hashes: np.ndarray, first: np.ndarray, items: Items) -> Iterator[Passages]:
    """The passages of rows of words, some at a time."""
    hit, at = items.known(hashes)
    weight = items.idf[slot(hashes)].astype(np.float64)
    row, a, b = starts_in(first)
    step = max(16, CELLS // len(items.owner))
    for i in range(0, len(row), step):
        own = slice(i, i + step)
        terms = items.cut(hit, at, weight, a[own], b[own])
        yield Passages(terms, row[own], a[own], b[own], items.cosines(terms))


_SURVEY = "doc_id long, text string, part int, payload binary"


def survey(docs: DataFrame, items: Items) -> DataFrame:
    """Over all documents: the stretches that can hold an item (doc_id, text), and each task's share of A'(A X)
    (part, payload)."""
    size, rank = len(items.vocabulary), sketched(items)
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, x = sent.value, range_finder(size, rank)
        bounds, total = bounds_of(own), np.zeros((size, rank), np.float32)
        for block in blocks(batches):
            w = words(plain(block.data), block.bounds)
            if not len(w.hash):
                continue
            hit, at = own.known(w.hash)
            weight = own.idf[slot(w.hash)].astype(np.float64)
            count = np.diff(w.first)
            n = -(-count // WINDOW)
            row = np.repeat(np.arange(len(n)), n)
            a = w.first[row] + WINDOW * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
            b = np.minimum(a + WINDOW, w.first[row + 1])
            for i in range(0, len(a), AT_ONCE):
                terms = own.cut(hit, at, weight, a[i : i + AT_ONCE], b[i : i + AT_ONCE])
                terms = terms._replace(weight=terms.weight / terms.whole[terms.row].astype(np.float32))
                terms.onto(terms.times(x), total)
            found = np.concatenate([np.stack(bound.stretches(w, hit, at)) for bound in bounds], 1)
            ids, pieces = block.column("doc_id"), list(_united(found))
            raw = [block.data[w.start[low] : w.end[high - 1]].tobytes() for _, low, high in pieces]
            if raw:
                rows = pa.array([i for i, _, _ in pieces], pa.int64())
                nothing = [pa.nulls(len(raw), pa.int32()), pa.nulls(len(raw), pa.binary())]
                yield pa.RecordBatch.from_arrays([ids.take(rows), pa.array(raw, pa.binary()).cast(pa.string()), *nothing], ["doc_id", "text", "part", "payload"])
        sums = array_rows(np.array_split(total, PIECES))
        yield pa.RecordBatch.from_arrays([pa.nulls(PIECES, pa.int64()), pa.nulls(PIECES, pa.string()), *sums.columns], ["doc_id", "text", "part", "payload"])

    return written(narrowed(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "text").mapInArrow(run, _SURVEY), "survey")


def _united(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Row, first and last word, with overlapping stretches of a row as one."""
    x = x[:, np.lexsort((x[1], x[0]))]
    row = low = high = -1
    for i, a, b in x.T.tolist():
        if i == row and a <= high:
            high = max(high, b)
            continue
        if row >= 0:
            yield row, low, high
        row, low, high = i, a, b
    if row >= 0:
        yield row, low, high


def rank_of(items: Items) -> int:
    """Dimensions of the latent space: well under the items, so that words that stand together lie together."""
    return max(1, min(RANK, len(items.ids) // 2, len(items.vocabulary)))


def sketched(items: Items) -> int:
    """Columns of the random matrix: the rank and some more."""
    return min(rank_of(items) + OVER, len(items.vocabulary))


def latent_space(sums: DataFrame, items: Items) -> np.ndarray:
    """The first `rank_of` right singular vectors of A (vocabulary x rank), from C X alone, for C = A'A: C is about
    Y (X'Y)^-1 Y' with Y = C X, so its eigenvectors of the largest eigenvalues are the left singular vectors of Y L^-T, L the
    Cholesky factor of X'Y. No second pass over the corpus is needed, and the weak directions of a sketch are cut off."""
    size, n = len(items.vocabulary), sketched(items)
    found = tree_sum(sums, "<f4")
    x = range_finder(size, n)
    out = np.zeros((size, n), np.float32)
    items.whole.onto(items.whole.times(x), out)
    if found:
        corpus = np.concatenate([found[i] for i in range(PIECES)]).reshape(size, n)
        out = corpus + out * max(1.0, np.linalg.norm(corpus) / max(np.linalg.norm(out), 1e-12))
    y = out.astype(np.float64)
    shift = 1e-7 * max(np.linalg.norm(y), 1e-12)
    y += shift * x
    core = x.T.astype(np.float64) @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > values.max(initial=0) * 1e-9
    factor = y @ (vectors[:, keep] / np.sqrt(values[keep]))
    basis, _, _ = np.linalg.svd(factor, full_matrices=False)
    return np.ascontiguousarray(basis[:, : rank_of(items)], np.float32)


def placed(terms: Terms, basis: np.ndarray) -> np.ndarray:
    """Passages in the latent space, each of length 1."""
    z = terms.times(basis)
    return z / np.maximum(np.sqrt((z * z).sum(1)), 1e-12)[:, None]


def _matches(docs: DataFrame, items: Items) -> DataFrame:
    surveyed = survey(docs, items)
    basis = latent_space(surveyed.where("part is not null").select("part", "payload"), items)
    sent = docs.sparkSession.sparkContext.broadcast((items, basis, placed(items.passages, basis)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, space, latent = sent.value
        lengths = np.array([len(x) for x in own.words])
        present = np.zeros(len(own.vocabulary), bool)
        for block in blocks(batches):
            ids, out = block.column("doc_id").to_pylist(), []
            w = words(plain(block.data), block.bounds)
            hit, place = own.known(w.hash)
            found: list[np.ndarray] = []
            for p in _passages(w.hash, w.first, own):
                near = placed(p.terms, space) @ latent.T
                at, key = np.nonzero(near >= LATENT)
                more, other = np.nonzero((p.cosine >= COSINE) & (near < LATENT))  # what the latent search alone would miss
                at, key = np.append(at, more), np.append(key, other)
                item = own.owner[key]
                reach = np.maximum(lengths[item], REACH)
                low, high = np.maximum(w.first[p.row[at]], p.a[at] - reach), np.minimum(w.first[p.row[at] + 1], p.b[at] + reach)
                found.append(np.stack([p.row[at], item, low, high, near[at, key]]))
            for i, j, low, high, c in _merged(np.concatenate(found, 1)) if found else ():
                words_in = place[low:high][hit[low:high]]
                present[words_in] = True
                if own.enough(j, present):
                    common, answer = own.common(j, w.hash[low:high])
                    if common >= VERBATIM or (common >= PARAPHRASE and answer >= ANSWER):
                        out.append((ids[i], own.ids[j], c, common, answer))
                present[words_in] = False
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "cosine", "common", "answer"])

    return surveyed.where("part is null").select("doc_id", "text").mapInArrow(run, _MATCH)


def _merged(x: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
    """Row, item, first and last word and best cosine, with the overlapping regions of a row and item as one."""
    x = x[:, np.lexsort((x[2], x[1], x[0]))]
    if not x.shape[1]:
        return
    group = np.append(True, (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1]))
    nth = np.cumsum(group)
    far = x[3].max() + 1
    reach = np.maximum.accumulate(x[3] + nth * far) - nth * far
    head = np.flatnonzero(np.append(True, group[1:] | (x[2, 1:] > reach[:-1])))
    high, cosine = np.maximum.reduceat(x[3], head), np.maximum.reduceat(x[4], head)
    yield from zip(x[0, head].astype(int).tolist(), x[1, head].astype(int).tolist(), x[2, head].astype(int).tolist(), high.astype(int).tolist(), cosine.tolist(), strict=True)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, and the best cosine, common subsequence and answer share of each item found in a document."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text")
    idf, out = idf_of(docs), None
    n = max(1, -(-items.count() // ITEM_BLOCK))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        rows = [r for r in rows if len(words(plain(np.frombuffer(r[1].encode("utf-8"), np.uint8)), np.array([0, len(r[1].encode("utf-8"))])).hash)]
        if rows:
            found = _matches(docs, Items([r[0] for r in rows], [r[1] for r in rows], idf))
            out = found if out is None else out.unionAll(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], _MATCH)
    return out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("cosine", "common", "answer")))
