"""Toxicity of texts (operator 3).

Method: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy. A word is the mean of the vectors
of its character n-grams (3 to 5 bytes, with word ends) and of itself, all hashed into one table; a passage of a few words
is the mean of its words; a softmax layer on top gives the class. Misspelt words share n-grams with those seen, so they
land near them. A document is as toxic as its most toxic passage: in training, a toxic document teaches with the passages
that look worst so far and a clean one with its hardest passages and with random ones. PASSAGE is one word here: a longer
one hides a single insult among clean words.

The driver fits the model on a bounded sample of labelled rows (MOST_TOXIC and MOST_CLEAN, the smallest hashes of
doc_id); each task then scores whole texts. Since the layers above the table are linear, a table of one number per n-gram
is all that a task needs (TABLE floats, a fixed size).

Edge cases: null and empty texts get the score of an empty passage; very long texts are scored whole, as their worst passage;
documents whose worst passages are equal get equal scores; an empty table gives an empty table; without labels of both classes every score is the
share of toxic labels (0.0 without labels); several labels of one doc_id count as their maximum; repeated rows get equal
scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import LOWER, SEPARATOR, blocks, byte_grams, mixed, narrowed, words

#: Labelled documents that a model is fitted on, at most.
MOST_TOXIC, MOST_CLEAN = 1000, 1500

#: Characters of a text that is learnt from, at most (longer ones are scored like all others).
MOST_CHARACTERS = 1 << 16

#: Slots of the n-gram table, numbers in a vector, lengths of n-grams in bytes, words in a passage.
TABLE, WIDTH, SIZES, PASSAGE = 1 << 18, 8, (3, 4, 5), 1

EPOCHS = 16


def passages(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """The hashes of the block's distinct words, their n-gram slots (slots, first slot of each word), each passage's words
    (padded with -1) and each passage's row. A row without words has one empty passage."""
    n_rows = len(bounds) - 1
    data = np.insert(LOWER[data], bounds[:-1], 0x20)  # a blank before each row, so that its first word has a start
    data = np.append(np.where(SEPARATOR[data], 0x20, data).astype(np.uint8), np.uint8(0x20))
    bounds = bounds + np.arange(n_rows + 1)
    w = words(data[:-1], bounds)
    keys, one, which = np.unique(w.hash, return_index=True, return_inverse=True)
    start, size = w.start[one] - 1, w.end[one] - w.start[one] + 2
    owner, slot = [np.arange(len(keys))], [mixed(keys)]
    for n in SIZES:
        count = np.maximum(size - n + 1, 0)
        own = np.repeat(np.arange(len(keys)), count)
        at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(len(own))
        owner.append(own)
        slot.append(byte_grams(data, n)[at])
    owner, slot = np.concatenate(owner), (np.concatenate(slot) >> np.uint64(64 - TABLE.bit_length() + 1)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[order], np.arange(len(keys) + 1))
    n_words = np.diff(w.first)
    per_row = np.maximum(1, -(-n_words // PASSAGE))
    row = np.repeat(np.arange(n_rows), per_row)
    start_of = np.cumsum(per_row) - per_row
    inside = np.full((len(row), PASSAGE), -1)
    place = np.arange(len(which)) - w.first[w.row]
    inside[start_of[w.row] + place // PASSAGE, place % PASSAGE] = which
    return keys, slot[order].astype(np.int32), first, inside, row


def _means(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of values[first[i]:first[i + 1]] for each i, along the first axis; none is empty."""
    if len(first) < 2:
        return np.zeros((0, *values.shape[1:]), values.dtype)
    count = np.diff(first).astype(values.dtype)
    return np.add.reduceat(values, first[:-1]) / (count[:, None] if values.ndim > 1 else count)


def spans_of_rows(inside: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each passage's words."""
    out = np.zeros(len(inside), np.uint64)
    for k in range(inside.shape[1]):
        out = mixed(out + (inside[:, k] + 2).astype(np.uint64))
    return out


class Model:
    """`slots`: what an n-gram adds to the logit of a passage; `scale`, `shift`: from a document's logit to its score."""

    def __init__(self, slots: np.ndarray, bias: float, scale: float, shift: float) -> None:
        self.slots, self.bias, self.scale, self.shift = slots, bias, scale, shift

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        _, slot, first, inside, row = passages(data, bounds)
        per_word = np.append(_means(self.slots[slot].astype(np.float64), first), 0.0)
        logit = per_word[inside].sum(1) / np.maximum(1, (inside >= 0).sum(1)) + self.bias
        worst = np.maximum.reduceat(logit, np.searchsorted(row, np.arange(len(bounds) - 1)))
        return 1 / (1 + np.exp(-np.clip(self.scale * worst + self.shift, -30, 30)))


def _all_passages(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """`passages` over many documents, a few at a time; a passage that a document repeats is there once."""
    n, pieces = 0, []
    for i in range(0, len(raw), 100):
        own = raw[i : i + 100]
        keys, slot, first, inside, row = passages(np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)]))
        _, one = np.unique(mixed((row.astype(np.uint64) << np.uint64(32)) ^ spans_of_rows(inside)), return_index=True)
        one.sort()
        pieces.append((keys, slot, np.diff(first), np.where(inside[one] < 0, -1, inside[one] + n), row[one] + i))
        n += len(keys)
    keys, slot, size, inside, row = (np.concatenate(x) for x in zip(*pieces, strict=True))
    del pieces
    _, one, which = np.unique(keys, return_index=True, return_inverse=True)
    start, size_of = (np.cumsum(size) - size)[one], size[one]
    first = np.append(0, np.cumsum(size_of))
    slot = slot[np.repeat(start - first[:-1], size_of) + np.arange(first[-1])]
    return slot, first, np.where(inside < 0, -1, which[inside]), row


def fit(texts: list[str], toxic: np.ndarray, seed: int = 11) -> Model:
    """Trains table and softmax jointly (Adam, a batch being this epoch's passages of all documents)."""
    if not len(texts) or toxic.all() or not toxic.any():
        share = float(toxic.mean()) if len(toxic) else 0.0
        return Model(np.zeros(TABLE, np.float32), 0.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    n_docs, rng = len(texts), np.random.default_rng(seed)
    slot, first, inside, row = _all_passages([x.encode("utf-8") for x in texts])
    begin = np.searchsorted(row, np.arange(n_docs + 1))
    # to begin with, a passage looks as bad as the n-grams that toxic documents hold more often than clean ones
    seen, n_slots = inside.ravel(), np.diff(first)
    of_word = [np.bincount(seen[(seen >= 0) & (np.repeat(toxic[row], PASSAGE) == c)], minlength=len(n_slots)) for c in (0, 1)]
    odds = np.stack([np.bincount(slot, np.repeat(of_word[c], n_slots), TABLE) + 0.5 for c in (0, 1)])
    odds /= odds.sum(1, keepdims=True)
    per_word = np.append(_means(np.log(odds[1] / odds[0])[slot], first), -9.0)
    look = np.sort(per_word[inside], 1)[:, -1]

    table = rng.normal(0, 0.1, (TABLE, WIDTH)).astype(np.float32)
    top, bias = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (table, top, bias)]
    for epoch in range(EPOCHS):
        chosen, label = [], []
        order = np.lexsort((-look, row))
        for d in range(n_docs):
            own = order[begin[d] : begin[d + 1]]
            if toxic[d]:
                chosen.append(own[:2] if epoch < EPOCHS // 2 else own[:1])
            else:
                chosen.append(np.concatenate([own[:3], own[rng.integers(0, len(own), 3)]]))
            label.append(np.full(len(chosen[-1]), toxic[d], np.int64))
        batch, y = np.concatenate(chosen), np.concatenate(label)
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
        used, at = np.unique(inside[batch], return_inverse=True)
        at = at.reshape(len(batch), PASSAGE)
        real = used >= 0
        n_slots = np.diff(first)[used[real]]
        edge = np.append(0, np.cumsum(n_slots))
        own_slots = slot[np.repeat(first[used[real]] - edge[:-1], n_slots) + np.arange(edge[-1])]
        for _ in range(2):
            vectors = np.zeros((len(used), WIDTH), np.float32)
            vectors[real] = _means(table[own_slots], edge)
            count = np.maximum(1, real[at].sum(1)).astype(np.float32)[:, None]
            x = vectors[at].sum(1) / count
            z = x @ top + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            g = p * weight[:, None]
            grad_x = (g @ top.T) / count
            grad_words = np.stack([np.bincount(at.ravel(), np.repeat(grad_x[:, k], PASSAGE), len(used)) for k in range(WIDTH)], 1)[real]
            per_slot = np.repeat(grad_words / n_slots[:, None], n_slots, 0)
            grad_table = np.stack([np.bincount(own_slots, per_slot[:, k], TABLE) for k in range(WIDTH)], 1).astype(np.float32)
            for param, grad, (m, v) in zip((table, top, bias), (grad_table, x.T @ g, g.sum(0)), state, strict=True):
                m += 0.1 * (grad - m)
                v += 0.05 * (grad * grad - v)
                param -= 0.05 * m / (np.sqrt(v) + 1e-7)
        slots_now = (table @ (top[:, 1] - top[:, 0])).astype(np.float64)
        per_word = np.append(_means(slots_now[slot], first), 0.0)
        look = per_word[inside].sum(1) / np.maximum(1, (inside >= 0).sum(1)) + (bias[1] - bias[0])
    worst = np.maximum.reduceat(look, begin[:-1])
    a, b = _logistic(worst, toxic)
    return Model((table @ (top[:, 1] - top[:, 0])).astype(np.float32), float(bias[1] - bias[0]), a, b)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through (x, y), by gradient steps on a standardised x, slightly shrunk."""
    mean, dev = x.mean(), x.std() + 1e-9
    s, a, b = (x - mean) / dev, 1.0, 0.0
    for _ in range(3000):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        a -= 0.3 * (((p - y) * s).mean() + 1e-3 * a)
        b -= 0.3 * (p - y).mean()
    return float(a / dev), float(b - a * mean / dev)


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int]) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of at most most[c] documents of each class: those whose doc_id has the smallest hashes. Of the
    texts of one doc_id the one with the smallest hash counts; texts of more than MOST_CHARACTERS are not learnt from."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    ids = None
    for c, n in most.items():
        own = known.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        ids = own if ids is None else ids.unionAll(own)
    rows = narrowed(docs, "doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= MOST_CHARACTERS).join(F.broadcast(ids), "doc_id")
    text = F.coalesce("text", F.lit(""))
    one = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), text.alias("text"))).alias("x"), F.max("y").alias("y"))
    found = one.select("doc_id", "x.text", "y").toPandas().sort_values("doc_id")
    return found["text"].tolist(), found["y"].to_numpy(np.int64)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and `score`, 0 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(model.scores(block.data, block.bounds))], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return narrowed(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
