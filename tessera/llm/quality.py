"""Quality of texts (operator 1).

Method: nearest-neighbour voting. TF-IDF over hashed 3-grams of bytes and a term for repeated words (document frequencies counted over all documents),
a latent-semantic basis from a randomised SVD of a bounded sample of labelled rows, and those rows' vectors broadcast
(MOST_PER_CLASS of each class, a fixed size). Every document's vector meets all of them in exact cosine products, block by
block; the NEIGHBOURS nearest vote with their labels, weighted by a power of their similarity.

Edge cases: null and empty texts have no neighbours and get the mean label of the sample; without labels every score is
0.5; several labels of one doc_id count as their maximum; repeated rows get equal scores, up to the last bits of a
matrix product; of equally near neighbours at the edge of NEIGHBOURS those that a partition by similarity leaves first vote
(equal vectors of the sample bring equal similarities); very long texts are scored whole; extra columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import blocks, narrowed, words
from tessera.llm.lsa import gram_counts, svd_basis, tf_idf, unit
from tessera.llm.toxicity import labelled

#: Labelled rows whose vectors are broadcast, at most, of each class.
MOST_PER_CLASS = 1500

GRAM, SLOTS, RANK, NEIGHBOURS, POWER = 3, 4096, 48, 15, 4

#: Rows whose SLOTS terms a task holds at a time, at most.
AT_ONCE = 256

#: Weight of the term for repeated words.
REPEATS = 2.0


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents, and in how many of them each slot occurs: SLOTS + 1 numbers, whatever the size of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS + 1, np.int64)
        for block in blocks(batches, rows=AT_ONCE):
            total[:SLOTS] += (gram_counts(block.data, block.bounds, GRAM, SLOTS) > 0).sum(0)
            total[SLOTS] += block.batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLOTS + 1)), pa.array(total)], ["slot", "n"])

    counted = narrowed(docs, "text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros(SLOTS + 1, np.int64)
    for slot, n in counted.collect():
        out[slot] = n
    return int(out[SLOTS]), out[:SLOTS]


def terms(data: np.ndarray, bounds: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A row's terms: TF-IDF of its 3-grams, of length 1, and as one more term the share of words that only repeat the word
    before (n-grams alone don't tell a text from the same words said over and over)."""
    w = words(data, bounds)
    again = np.zeros(len(w.hash), bool)
    if len(again):
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    share = np.bincount(w.row, again, len(bounds) - 1) / np.maximum(1, np.diff(w.first) - 1)
    return np.column_stack([tf_idf(gram_counts(data, bounds, GRAM, SLOTS), idf), (REPEATS * share).astype(np.float32)])


#: Terms and the basis are rounded to this part of 1, latent vectors to that: sums of their products are whole numbers below
#: 2^53, which no order of adding changes, so a text has one score, whatever stands beside it.
COARSE, FINE = 1 << 14, 1 << 20


def fixed(x: np.ndarray, part: int) -> np.ndarray:
    return np.rint(np.asarray(x, np.float64) * part)


def latent(own: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Rows of terms in the latent space, of length 1, as whole numbers; basis is `fixed`."""
    return fixed(unit(fixed(own, COARSE) @ basis), FINE)


class Voters:
    """Labelled latent vectors; of equal cosines the voter of the smaller number votes."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray) -> None:
        self.idf, self.basis, self.vectors, self.labels = idf, basis, vectors, labels

    def latent(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return latent(terms(data, bounds, self.idf), self.basis)

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(bounds) - 1, prior)
        n, k = len(self.labels), min(NEIGHBOURS, len(self.labels))
        similar = (self.latent(data, bounds) @ self.vectors.T).astype(np.int64)
        order = similar * n + (n - 1 - np.arange(n))
        near = -np.partition(-order, k - 1, axis=1)[:, :k]
        near.sort(axis=1)
        voter = n - 1 - near % n
        weight = np.maximum(near // n, 0).astype(np.float64) / FINE**2
        weight **= POWER
        total = weight.sum(1)
        vote = (weight * self.labels[voter]).sum(1) / np.maximum(total, 1e-12)
        return np.where(total > 1e-9, np.clip(vote, 0, 1), prior)


def fit(docs: DataFrame, labels: DataFrame) -> Voters:
    """docs: all documents (their counts give the idf); labels: rows of doc_id and quality that may be learnt from."""
    n, seen = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + np.float32(0.1)
    texts, y = labelled(docs, labels, "quality", {0: MOST_PER_CLASS, 1: MOST_PER_CLASS})
    if not texts:
        none = np.zeros((0, 1), np.float32)
        return Voters(idf, np.zeros((SLOTS + 1, 1), np.float32), none, y)
    raw = [x.encode("utf-8") for x in texts]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    parts = []
    for i in range(0, len(raw), 200):
        to = min(i + 200, len(raw))
        parts.append(terms(data[bounds[i] : bounds[to]], bounds[i : to + 1] - bounds[i], idf))
    x = np.concatenate(parts)
    basis = fixed(svd_basis(x, RANK), COARSE)
    return Voters(idf, basis, latent(x, basis), y)


def score(docs: DataFrame, voters: Voters) -> DataFrame:
    """doc_id and `score`, 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, rows=AT_ONCE):
            scores = sent.value.scores(block.data, block.bounds)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return narrowed(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def kept(docs: DataFrame, voters: Voters, least: float = 0.3) -> DataFrame:
    """The rows of docs, with all columns, whose score is at least `least`."""
    sent = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, rows=AT_ONCE):
            yield block.batch.filter(pa.array(sent.value.scores(block.data, block.bounds) >= least))

    return docs.mapInArrow(run, docs.schema)
