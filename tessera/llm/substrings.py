"""Removal of word passages that stand in an earlier document (operator 9).

Method: level-wise doubling. The lengths are 13, 25 and 50 words for a window of 50 (halves, rounded up, down to about
LEAST). At the first level a window shows one of its passages of 13 words, that with the smallest hash; where another
document shows the same one, the window is a candidate and is extended: at 25 words it shows again its passage with the
smallest hash, and so on until the whole window is compared or no candidate is left. Equal windows show equal passages at
every level, so none is missed. Longer repeats are unions of windows of the last level.

Hashes of passages are made of two hashes of half the length, level by level, from hashes of words. Those of whole windows
have 128 bits, from two hashes of each word that differ from its first byte on; the others have 64 (they only choose candidates). What a document shows is gathered where the texts are dealt by
doc_id: a passage that stands in a third of all documents is sent once per packed block of texts, not once per document, and
comes back once to each part.

Edge cases: null and empty texts have no words; documents of fewer than `window` words lose nothing; rows without doc_id
keep all their words and remove none elsewhere; rows of one doc_id, equal or not, are one document's: none removes from
another; very long texts are windows like any others; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import TWIN, Words, in_a_row, words
from tessera.llm.packed import PACKED, gathered, hash_part, met, packed, packed_texts, parts_of, runs, texts_of, unpacked, with_texts
from tessera.llm.windows import smallest

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"

#: Words of the shortest passages, about.
LEAST = 12


def lengths(window: int) -> list[int]:
    """Of the levels: window, its half (rounded up), and so on."""
    out = [window]
    while out[0] >= 2 * LEAST:
        out.insert(0, -(-out[0] // 2))
    return out


def shown(w: Words, size: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows start, and the smallest hash of a passage of `size` words in each."""
    return smallest(in_a_row(w.hash, size), w.row, size, window)


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n items lie in a span of that size from one of the starts."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + size, -1)
    return np.cumsum(step[:-1]) > 0


class Known:
    """Keys (of 64 or 128 bits) that came back to a part, with the smallest doc_id of each."""

    def __init__(self, keys: np.ndarray, twins: np.ndarray, first: np.ndarray) -> None:
        order = np.lexsort((twins, keys))
        self.keys, self.twins, self.first = keys[order], twins[order], first[order]

    def find(self, keys: np.ndarray, twins: np.ndarray | None = None) -> np.ndarray:
        """Each key's place, or -1."""
        out = np.full(len(keys), -1)
        at = np.searchsorted(self.keys, keys)
        open_ = np.flatnonzero(at < len(self.keys))
        while len(open_):
            open_ = open_[self.keys[at[open_]] == keys[open_]]
            same = np.ones(len(open_), bool) if twins is None else self.twins[at[open_]] == twins[open_]
            out[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1  # two keys with the same first half
            open_ = open_[at[open_] < len(self.keys)]
        return out


def summed_up(keys: np.ndarray, twins: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each distinct key with the smallest and the largest of its ids."""
    order = np.lexsort((ids, twins, keys))
    keys, twins, ids = keys[order], twins[order], ids[order]
    head = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (twins[1:] != twins[:-1])))
    last = np.append(head[1:], len(keys)) - 1
    return keys[head], twins[head], ids[head], ids[last]


def sent(parts: int, part: int, keys: np.ndarray, twins: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """A block's keys, by key: what `repeated` takes."""
    keys, twins, low, high = summed_up(keys, twins, ids)
    return hash_part(keys, parts), keys, twins, low, high - low, np.full(len(keys), part, np.int32)


def repeated(df: DataFrame, later_only: bool) -> DataFrame:
    """Of packed keys by key: those of two documents, by the parts that sent them, with the smallest doc_id; with
    later_only a part hears only of keys that one of its documents has after that."""

    def meet(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        keys, twins, low, more, part = unpacked(payloads, np.uint64, np.uint64, np.int64, np.int64, np.int32)
        if not len(keys):
            return
        high = low + more
        order = np.lexsort((twins, keys))
        keys, twins, low, high, part = keys[order], twins[order], low[order], high[order], part[order]
        head = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (twins[1:] != twins[:-1])))
        size = np.diff(np.append(head, len(keys)))
        first = np.repeat(np.minimum.reduceat(low, head), size)
        keep = np.repeat(np.maximum.reduceat(high, head), size) > first
        if later_only:
            keep &= high > first
        if keep.any():
            yield packed(part[keep], keys[keep], twins[keep], first[keep])

    return met(df, meet, PACKED)


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """Per document: its words, how many of them a window that an earlier document has covers, and SHA-256 of the rest."""
    parts, sizes = parts_of(docs), lengths(window)

    def level(texts: Iterator, payloads: list[bytes] | None, nth: int) -> Iterator[tuple[np.ndarray, ...]]:
        """What windows show at a level; with payloads, only those whose passage of the level before came back."""
        known = None if payloads is None else Known(*unpacked(payloads, np.uint64, np.uint64, np.int64))
        if known is not None and not len(known.keys):
            return
        for ids, data, bounds in texts:
            w = words(data, bounds, twin=sizes[nth] == window)
            starts, keys = shown(w, sizes[nth if known is None else nth - 1], window)
            if known is not None:
                live = known.find(keys) >= 0
                starts = starts[live]
                if sizes[nth] < window:
                    keys = shown(w, sizes[nth], window)[1][live]
            if not len(starts):
                continue
            twins = np.zeros(len(starts), np.uint64)
            if sizes[nth] == window:
                keys, twins = in_a_row(w.hash, window)[starts], in_a_row(w.twin, window, seed=TWIN)[starts]
            yield sent(parts, int(np.mod(ids[0], parts)), keys, twins, ids[w.row[starts]])

    def digests(texts: Iterator, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        known = Known(*unpacked(payloads, np.uint64, np.uint64, np.int64))
        for ids, data, bounds in texts:
            w = words(data, bounds, twin=len(known.keys) > 0)
            starts = np.flatnonzero(w.row[: len(w.row) - window + 1] == w.row[window - 1 :]) if len(w.row) >= window and len(known.keys) else np.zeros(0, np.int64)
            if len(starts):
                at = known.find(in_a_row(w.hash, window)[starts], in_a_row(w.twin, window, seed=TWIN)[starts])
                starts = starts[(at >= 0) & (known.first[at] < ids[w.row[starts]])]
            yield _digest(pa.array(ids), data, w, covered(len(w.start), starts, window))

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _ in runs(batches):
            w = words(block.data, block.bounds)
            yield _digest(pa.nulls(block.batch.num_rows, pa.int64()), block.data, w, np.zeros(len(w.start), bool))

    texts = packed_texts(docs, parts)
    found = met(texts, lambda p: gathered(level(texts_of(p), None, 0)), PACKED)
    for nth in range(1, len(sizes)):
        back = repeated(found, later_only=False)
        found = with_texts(texts, back, lambda t, p, nth=nth: gathered(level(t, p, nth)), PACKED)
    nameless = docs.where(F.col("doc_id").isNull()).select(F.lit(0).cast("long").alias("doc_id"), "text")
    return with_texts(texts, repeated(found, later_only=True), digests, RESULT).unionAll(nameless.mapInArrow(untouched, RESULT))


def _digest(ids: pa.Array, data: np.ndarray, w, gone: np.ndarray) -> pa.RecordBatch:
    """Rows of RESULT; the words that stay are joined by one blank."""
    n_words = np.diff(w.first)
    total = np.append(0, np.cumsum(gone))
    n_removed = total[w.first[1:]] - total[w.first[:-1]]
    raw, shas = data.tobytes(), []
    start, end = w.start.tolist(), w.end.tolist()
    for i in range(len(n_words)):
        kept = np.flatnonzero(~gone[w.first[i] : w.first[i + 1]]) + w.first[i]
        shas.append(hashlib.sha256(b" ".join([raw[start[k] : end[k]] for k in kept.tolist()])).hexdigest())
    return pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string())], RESULT.replace(" long", "").replace(" string", "").split(", "))
