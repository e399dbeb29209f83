"""Removal of byte strings that start earlier too (operator 8).

Method: a distributed merge sort of suffixes that never compares a known prefix again. Sorting every suffix of every text
is not needed: a string of `size` bytes that repeats holds, wherever it stands, the same anchor (of its GRAM-byte strings
the one with the smallest hash). Anchors whose gram occurs once are dropped; the suffixes at the others, `size` bytes of
each, are sorted where their texts are, sent front-coded (what a suffix shares with the one before is not sent again) to
the part of their gram, and merged there with a loser tree of the runs that keeps for each run how much it shares with the
last winner. Suffixes that share less than a gram can't share a string of `size` bytes, so parts need no common order.

In the merged order the strings that hold an anchor at offset o are equal for suffixes that share size - o bytes and whose
o bytes to the left are equal; the first of them, by doc_id and then by position, stays and the others are covered.
Before the exchange, a task settles anchors with equal bytes on both sides among its own texts: only the first is sent.

Edge cases: null and empty texts have no bytes; texts of fewer than `size` bytes lose nothing; very long texts are
searched whole; extra columns are ignored; rows without doc_id lose nothing and remove nothing; identical rows of one doc_id get the same result; different texts of one doc_id count as
documents in the order of their 64-bit fingerprints; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import TWIN, byte_grams, byte_hashes, mixed
from tessera.llm.packed import PACKED, gathered, hash_part, loosened, met, packed, packed_texts, parts_of, runs, squeezed, texts_of, unpacked, with_texts
from tessera.llm.windows import sliding

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

#: Bytes of an anchor's gram.
GRAM = 32

#: Buckets, by gram, that a part's runs are merged in one after the other.
BUCKETS = 8

#: A random 64-bit value for each byte (fixed seed).
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def anchors_of(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of anchors, their grams' hashes, the row of each, and a fingerprint of each row."""
    prints = byte_hashes(data, bounds[:-1], bounds[1:])
    none = np.zeros(0, np.int64)
    n = len(data) - size + 1
    if n <= 0:
        return none, none.astype(np.uint64), none, prints
    gram = byte_grams(data, GRAM)
    least = sliding(gram, size - GRAM + 1, np.minimum)[:n]
    for end in bounds[1:-1]:  # windows across two rows choose nothing
        least[max(0, end - size + 1) : end] = 0
    reach = size - GRAM
    padded = np.concatenate([np.zeros(reach, np.uint64), least, np.zeros(reach, np.uint64)])
    chosen = sliding(padded, reach + 1, np.maximum)  # the largest minimum of the windows that hold this gram
    at = np.flatnonzero(chosen[: len(gram)] == gram)
    return at, gram[at], np.searchsorted(bounds, at, "right") - 1, prints


def matrix(data: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """data[at:at + width] of each, cut at `high` (and below `low` for a negative width, from right to left), and lengths."""
    step = np.arange(abs(width))
    place = at[:, None] + step if width > 0 else at[:, None] - 1 - step
    length = np.minimum(high - at, width) if width > 0 else np.minimum(at - low, -width)
    out = data[np.clip(place, 0, max(0, len(data) - 1))]
    out[step >= length[:, None]] = 0
    return out, length


def shared(a: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """How many bytes rows of a and b share at their start."""
    differ = a != b
    first = np.where(differ.any(1), differ.argmax(1), a.shape[1])
    return np.minimum(np.minimum(a_len, b_len), first)


def front_coded(right: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, bytes]:
    """For sorted rows: how many bytes each shares with the row before, and all bytes that it doesn't."""
    same = np.zeros(len(right), np.int64)
    same[1:] = shared(right[1:], length[1:], right[:-1], length[:-1])
    step = np.arange(right.shape[1])
    return same, right[(step >= same[:, None]) & (step < length[:, None])].tobytes()


def suffix_list(same: list[int], length: list[int], rest: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for s, n in zip(same, length, strict=True):
        last = last[:s] + rest[at : at + n - s]
        at += n - s
        out.append(last)
    return out


def merged(sequences: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merges sorted runs of (suffixes, bytes each shares with the one before) with a loser tree.

    Returns (run, place) in order and how much each suffix shares with the one before it. Between two runs, the one that
    shares more with the last winner is smaller; only if both share equally much are bytes compared, from there on.
    """
    k = len(sequences)
    place, share = [0] * k, [0] * k
    heads: list[bytes | None] = [s[0] if s else None for s, _ in sequences]

    def beats(a: int, b: int) -> bool:
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None
        p, q = share[a], share[b]
        if p != q:
            return p > q
        n = min(len(x), len(y))
        while p < n and x[p] == y[p]:
            p += 1
        first = (x[p] < y[p]) if p < n else (len(x), a) <= (len(y), b)
        share[b if first else a] = p
        return first

    tree = [-1] * max(1, k)
    winners = [0] * (2 * k)
    for i in range(k):
        winners[k + i] = i
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        if beats(a, b):
            winners[node], tree[node] = a, b
        else:
            winners[node], tree[node] = b, a
    top = winners[1] if k > 1 else 0
    order, shares = [], []
    while k and heads[top] is not None:
        order.append((top, place[top]))
        shares.append(share[top])
        own, same = sequences[top]
        place[top] += 1
        i = place[top]
        if i < len(own):
            heads[top], share[top] = own[i], same[i]
        else:
            heads[top] = None
        node = (top + k) // 2
        while node:
            other = tree[node]
            if other >= 0 and not beats(top, other):
                tree[node], top = top, other
            node //= 2
    return order, shares


def repeats(share: np.ndarray, length: np.ndarray, left: np.ndarray, left_len: np.ndarray, rank: np.ndarray, size: int) -> np.ndarray:
    """For suffixes in order, which offsets o of an anchor in a string of `size` bytes have an earlier equal string, as
    rows x (size - GRAM + 1). rank: the order of documents and positions."""
    n, offsets = len(share), size - GRAM + 1
    out = np.zeros((n, offsets), bool)
    key, twin = np.zeros(n, np.uint64), np.full(n, TWIN)
    for o in range(offsets):
        if o:
            key = mixed(key + BYTE_VALUES[left[:, o - 1]] + np.uint64(o))
            twin = mixed(twin ^ mixed(left[:, o - 1].astype(np.uint64) + np.uint64(o)))
        group = np.cumsum(share < size - o)
        fit = np.flatnonzero((length >= size - o) & (left_len >= o))
        if len(fit) < 2:
            continue
        of, other = (mixed(k[fit] + mixed(group[fit].astype(np.uint64))) for k in (key, twin))
        order = np.lexsort((rank[fit], of))
        same, agree = of[order][1:] == of[order][:-1], other[order][1:] == other[order][:-1]
        if (same & ~agree).any():  # different bytes of one first hash
            order = np.lexsort((rank[fit], other, of))
            same, agree = of[order][1:] == of[order][:-1], other[order][1:] == other[order][:-1]
        same &= agree
        head = np.zeros(len(fit), np.int64)
        head[1:] = np.where(same, 0, np.arange(1, len(fit)))
        head = np.maximum.accumulate(head)
        ranks = rank[fit][order]
        out[fit[order], o] = ranks > ranks[head]
    return out


def stretches(hit: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, starts and ends of the bytes that the strings at marked offsets cover."""
    edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    _, past = np.nonzero(edge == -1)
    return row, at[row] - past + 1, at[row] - first + size


def remove_repeats(docs: DataFrame, size: int = 100) -> DataFrame:
    """Per document: its bytes, how many of them a string that starts earlier covers, in how many runs, and SHA-256 of the
    rest."""
    parts = parts_of(docs)
    reach = size - GRAM

    def found(texts: Iterator) -> Iterator[tuple[np.ndarray, ...]]:
        """The grams of each block's anchors, once, and whether they stand there twice."""
        for ids, data, bounds in texts:
            _, gram, _, _ = anchors_of(data, bounds, size)
            if len(gram):
                keys, n = np.unique(gram, return_counts=True)
                yield hash_part(keys, parts), keys, np.full(len(keys), np.mod(ids[0], parts), np.int32), n > 1

    def several(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Grams that stand twice, to the parts that have them."""
        keys, part, twice = unpacked(payloads, np.uint64, np.int32, np.bool_)
        if not len(keys):
            return
        order = np.lexsort((part, keys))
        keys, part, twice = keys[order], part[order], twice[order]
        head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        n = np.diff(np.append(head, len(keys)))
        keep = np.repeat((n > 1) | np.logical_or.reduceat(twice, head), n)
        keep[1:] &= (keys[1:] != keys[:-1]) | (part[1:] != part[:-1])
        if keep.any():
            yield packed(part[keep], keys[keep])

    def sorted_runs(texts: Iterator, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        (keys,) = unpacked(payloads, np.uint64)
        if not len(keys):
            return
        keys.sort()
        pieces = []
        for ids, data, bounds in texts:
            at, gram, row, prints = anchors_of(data, bounds, size)
            hit = keys[np.minimum(np.searchsorted(keys, gram), len(keys) - 1)] == gram
            at, gram, row = at[hit], gram[hit], row[hit]
            if len(at):
                right = matrix(data, at, bounds[row], bounds[row + 1], size)
                left = matrix(data, at, bounds[row], bounds[row + 1], -reach)
                pieces.append((gram, ids[row], prints[row], at - bounds[row], *right, *left))
        if not pieces:
            return
        gram, ids, prints, at, right, right_len, left, left_len = (np.concatenate(x) for x in zip(*pieces, strict=True))
        # anchors with equal bytes on both sides: the first stands for all, the others are covered by it
        both, twin = (_hashed(left, left_len, _hashed(right, right_len, np.full(len(at), k, np.uint64))) for k in (1, 2))
        order = np.lexsort((at, prints, ids, twin, both))
        first = np.ones(len(order), bool)
        first[1:] = (both[order][1:] != both[order][:-1]) | (twin[order][1:] != twin[order][:-1])
        head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        earlier = np.zeros(len(order), bool)
        later = (ids[order] != ids[head]) | (prints[order] != prints[head]) | (at[order] != at[head])
        earlier[order] = later
        if earlier.any():
            o = np.arange(reach + 1)
            hit = (right_len[earlier][:, None] >= size - o) & (left_len[earlier][:, None] >= o)
            row, start, end = stretches(hit, at[earlier], size)
            of, fp = ids[earlier][row], prints[earlier][row]
            if len(of):
                out = packed(np.mod(of, parts), of, fp, start, end)
                yield _tagged(out, 0)
        rest = np.flatnonzero(~earlier)
        part = hash_part(gram[rest], parts)
        for p in np.unique(part):
            blocks = [_run_block(rest[(part == p) & (_bucket(gram[rest]) == k)], ids, prints, at, right, right_len, left, left_len) for k in range(BUCKETS)]
            payload = np.array([len(x) for x in blocks], "<i8").tobytes() + b"".join(blocks)
            yield _tagged(pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([payload], pa.binary())], ["part", "payload"]), 1)

    def settled(payloads: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        for k in range(BUCKETS):
            yield from bucket_settled(payloads, k)

    def bucket_settled(payloads: list[bytes], k: int) -> Iterator[tuple[np.ndarray, ...]]:
        sequences, columns = [], []
        for own in payloads:
            own = _run_of(own, k)
            if not own:
                continue
            n, size_of_rest = np.frombuffer(own, "<i8", 2)
            head = np.frombuffer(own, "<i8", 6 * n, 16).reshape(6, n)
            left = np.frombuffer(own, np.uint8, n * reach, 16 + 48 * n).reshape(n, reach)
            rest = own[len(own) - size_of_rest :]
            same = head[5].tolist()
            sequences.append((suffix_list(same, head[3].tolist(), rest), same))
            columns.append((*head[:5], left))
        order, shares = merged(sequences)
        if len(order) < 2:
            return
        begin = np.cumsum([0, *(len(s) for s, _ in sequences)])
        pick = np.array([begin[r] + i for r, i in order])
        ids, prints, at, length, left_len = (np.concatenate(x)[pick] for x in list(zip(*columns, strict=True))[:5])
        left = np.concatenate([c[5] for c in columns])[pick]
        share = np.array(shares)
        alone = np.maximum(share, np.append(share[1:], 0)) < GRAM
        keep = ~alone
        if not keep.any():
            return
        by_place = np.lexsort((at, prints.view(np.uint64), ids))
        rank = np.zeros(len(ids), np.int64)
        new = np.ones(len(ids), bool)
        o = by_place
        new[1:] = (ids[o][1:] != ids[o][:-1]) | (prints[o][1:] != prints[o][:-1]) | (at[o][1:] != at[o][:-1])
        rank[o] = np.cumsum(new)
        hit = repeats(share, length, left, left_len, rank, size)
        row, start, end = stretches(hit, at, size)
        if len(row):
            yield np.mod(ids[row], parts), ids[row], prints[row].view(np.uint64), start, end

    def digests(texts: Iterator, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        own_ids, prints, start, end = unpacked(payloads, np.int64, np.uint64, np.int64, np.int64)
        order = np.lexsort((prints, own_ids))
        own_ids, prints, start, end = own_ids[order], prints[order], start[order], end[order]
        for ids, data, bounds in texts:
            marks = byte_hashes(data, bounds[:-1], bounds[1:])
            rows: list[tuple] = []
            for i, mark in zip(range(len(ids)), marks, strict=True):
                a, b = np.searchsorted(own_ids, [ids[i], ids[i] + 1])
                mine = slice(a, b) if a == b else a + np.flatnonzero(prints[a:b] == mark)
                own = data[bounds[i] : bounds[i + 1]]
                step = np.zeros(len(own) + 1, np.int64)
                np.add.at(step, start[mine], 1)
                np.add.at(step, end[mine], -1)
                gone = np.cumsum(step[:-1]) > 0
                rows.append(_row(own, gone))
            yield _table(pa.array(ids), rows)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _ in runs(batches):
            cut = [block.data[a:b] for a, b in zip(block.bounds[:-1], block.bounds[1:], strict=True)]
            yield _table(pa.nulls(len(cut), pa.int64()), [_row(x, np.zeros(len(x), bool)) for x in cut])

    texts = packed_texts(docs, parts)
    candidates = met(met(texts, lambda p: gathered(found(texts_of(p))), PACKED), several, PACKED)
    sent = with_texts(texts, candidates, sorted_runs, PACKED + ", kind int")

    def settle(own: pa.Table) -> pa.Table:
        """Spans that are known already go on as they are; runs are merged."""
        known = own.filter(pc.equal(own["kind"], 0)).select(["part", "payload"])
        runs_here = own.filter(pc.equal(own["kind"], 1))["payload"].to_pylist()
        found = list(gathered(settled(runs_here)))
        return pa.concat_tables([known, pa.Table.from_batches(found)]) if found else known

    spans_found = sent.groupBy("part").applyInArrow(settle, PACKED)
    nameless = docs.where(F.col("doc_id").isNull()).select(F.lit(0).cast("long").alias("doc_id"), "text")
    return with_texts(texts, spans_found, digests, RESULT).unionAll(nameless.mapInArrow(untouched, RESULT))


def _bucket(gram: np.ndarray) -> np.ndarray:
    return ((gram >> np.uint64(8)) % np.uint64(BUCKETS)).astype(np.int64)


def _run_block(own: np.ndarray, ids: np.ndarray, prints: np.ndarray, at: np.ndarray, right: np.ndarray, right_len: np.ndarray, left: np.ndarray, left_len: np.ndarray) -> bytes:
    """A sorted, front-coded run of the chosen suffixes, compressed."""
    if not len(own):
        return b""
    suffix = {i: right[i, : right_len[i]].tobytes() for i in own.tolist()}
    own = np.array(sorted(own.tolist(), key=suffix.__getitem__))
    same, new = front_coded(right[own], right_len[own])
    head = np.concatenate([[len(own), len(new)], ids[own], prints[own].view(np.int64), at[own], right_len[own], left_len[own], same])
    raw = head.astype("<i8").tobytes() + left[own].tobytes() + new
    return len(raw).to_bytes(8, "little") + squeezed(raw)


def _run_of(payload: bytes, k: int) -> bytes:
    """The k-th run of a payload."""
    sizes = np.frombuffer(payload, "<i8", BUCKETS)
    at = 8 * BUCKETS + int(sizes[:k].sum())
    own = payload[at : at + int(sizes[k])]
    return loosened(own[8:], int.from_bytes(own[:8], "little")) if own else b""


def _hashed(rows: np.ndarray, length: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's bytes and length (zeros stand behind a row's bytes)."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    out = mixed(seed ^ length.astype(np.uint64))
    for column in wide.view("<u8").T:
        out = mixed(out ^ mixed(column))
    return out


def _tagged(batch: pa.RecordBatch, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array([kind] * batch.num_rows, pa.int32())], ["part", "payload", "kind"])


def _row(own: np.ndarray, gone: np.ndarray) -> tuple[int, int, int, str]:
    spans_removed = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)) if len(own) else 0
    return len(own), int(gone.sum()), spans_removed, hashlib.sha256(own[~gone].tobytes()).hexdigest()


def _table(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
