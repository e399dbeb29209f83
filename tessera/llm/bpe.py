"""Byte-level BPE encoding and decoding (operator 5).

Method: a rank queue over hierarchical bitmaps. Each merge rank has a bucket of positions in a linked list of tokens; a
bitmap over the ranks with two summary levels finds the lowest rank in use with three find-first-set steps; entries whose
pair has changed meanwhile are skipped. A pre-token of n bytes takes O(n) queue steps, whatever its length.

Edge cases: a null text is empty and has no ids; pre-tokens of any length are encoded whole; rows with equal ids or texts
are independent; an empty table gives an empty table; other columns are ignored (`encode` keeps none of them).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.blocks import blocks, byte_hashes, narrowed

#: Bytes that the ids which a worker remembers may take; it forgets all of them when there are more.
MEMO_BYTES = 64 << 20

#: Bytes of pre-tokens from which numpy takes the queue's large buckets.
MANY = 20_000

#: Bytes of text whose pre-tokens are gathered before the queue runs (a longer document is taken whole).
TEXT_BYTES = 1 << 20

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, round_trip boolean"

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4


class RankQueue:
    """Buckets of positions by rank; a bit at each level says that something below is in use."""

    def __init__(self, ranks: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * (ranks // 64 + 1)
        self.middle = [0] * (len(self.low) // 64 + 1)
        self.top = 0

    def open(self, rank: int, ats: list[int]) -> None:
        """Starts the bucket of a rank that has none."""
        self.buckets[rank] = ats
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.middle[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def lowest(self) -> int:
        """The lowest rank in use, or -1."""
        if not self.top:
            return -1
        block = (self.top & -self.top).bit_length() - 1
        bits = self.middle[block]
        word = (block << 6) + (bits & -bits).bit_length() - 1
        bits = self.low[word]
        return (word << 6) + (bits & -bits).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """The whole bucket of a rank in use, from left to right."""
        word = rank >> 6
        self.low[word] &= ~(1 << (rank & 63))
        if not self.low[word]:
            self.middle[word >> 6] &= ~(1 << (word & 63))
            if not self.middle[word >> 6]:
                self.top &= ~(1 << (word >> 6))
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return bucket


class Memo:
    """Ids by the 64-bit hash of a pre-token: a large sorted table and a small newer one. `encode` decodes each row again
    and so notices two pre-tokens of one hash."""

    def __init__(self) -> None:
        none = np.zeros(0, np.int64)
        self.tables = [(np.zeros(0, np.uint64), none, none)] * 2
        self.ids = np.zeros(0, np.uint32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key's ids begin in `ids` (-1: not there), and how many there are."""
        at, size = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        for known, start, count in self.tables:
            if len(known):
                i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[i] == keys
                at[hit], size[hit] = start[i[hit]], count[i[hit]]
        return at, size

    def add(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        start = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.array([x for own in ids for x in own], np.uint32)])
        self.tables[1] = self._joined(self.tables[1], (keys, start, size))
        if 4 * len(self.tables[1][0]) > len(self.tables[0][0]):
            self.tables = [self._joined(*self.tables), tuple(x[:0] for x in self.tables[0])]

    @staticmethod
    def _joined(*tables: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        columns = [np.concatenate(x) for x in zip(*tables, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        return tuple(x[order] for x in columns)

    def size(self) -> int:
        """In bytes."""
        return self.ids.nbytes + sum(x.nbytes for columns in self.tables for x in columns)


class ByteBpe:
    """Encoder and decoder for a file of `base64(token) rank` lines and a pre-token pattern."""

    def __init__(self, path: str, pattern: str, known_pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.pattern = regex.compile(pattern)
        self.by_class = pattern == known_pattern
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_length = np.fromiter(map(len, tokens), np.int64, size)
        self.token_end = np.cumsum(self.token_length)
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.shift = size.bit_length()
        self.pairs = {
            self.ranks[token[:i]] << self.shift | self.ranks[token[i:]]: rank
            for token, rank in self.ranks.items() for i in range(1, len(token)) if token[:i] in self.ranks and token[i:] in self.ranks
        }
        self.pair_keys = np.array(sorted(self.pairs), np.int64)
        self.pair_values = np.array([self.pairs[x] for x in self.pair_keys.tolist()], np.int64)
        self.byte_rank = [self.ranks[bytes([i])] for i in range(256)]
        self.queue = RankQueue(size)
        self.memo = Memo()
        self.classes = np.zeros(0x110000, np.uint8)  # filled as code points appear

    # -- pre-tokens ---------------------------------------------------------------------------------------------

    def _classes(self, points: np.ndarray) -> np.ndarray:
        found = self.classes[points]
        if not found.all():
            for p in np.unique(points[found == 0]).tolist():
                c = chr(p)
                self.classes[p] = next(k for k, x in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s"), (_OTHER, r"(?s).")) if regex.match(x, c))
            found = self.classes[points]
        return found

    def starts(self, text: str, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where the pattern's matches begin in rows that stand one after the other; bounds are the rows' first characters.

        Runs of one class of characters are found with numpy, for the one pattern whose rules these are: a run takes one
        blank before it; the last white space before a run stays alone or joins it; an apostrophe at the start of a token,
        right before s, t, re, ve, m, ll or d, makes one token with it. Any other pattern is matched as it is.
        """
        n = len(points)
        change = np.zeros(n + 1, bool)
        if not self.by_class:
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                change[[a + m.start() for m in self.pattern.finditer(text[a:b])]] = True
            return np.flatnonzero(change[:n])
        kind = self._classes(points)
        np.not_equal(kind[1:], kind[:-1], out=change[1:n])
        change[bounds] = True
        row_end = np.zeros(n + 1, bool)
        row_end[bounds[1:]] = True
        begins = np.flatnonzero(change)
        ends = begins[1:]
        begins = begins[:-1]
        split = (kind[begins] == _SPACE) & ~row_end[ends]
        last = ends[split] - 1
        change[ends[split][points[last] == 0x20]] = False
        change[last] = True
        for at in np.flatnonzero((points == 0x27) & change[:n]).tolist():
            to = bounds[np.searchsorted(bounds, at, "right")]
            two = text[at + 1 : min(at + 3, to)]
            size = 1 if two[:1] in ("s", "t", "m", "d") and two else 2 if two in ("re", "ve", "ll") else 0
            if size:
                change[at + 1] = False
                if at + 1 + size < to and kind[at + 1 + size] != _SPACE:
                    change[at + 1 + size] = True
        return np.flatnonzero(change[:n])

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << self.shift | b
        i = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[i] == keys, self.pair_values[i], -1)

    def _push(self, ranks: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-2))
        for rank, own in zip(ranks[cuts].tolist(), np.split(at, cuts[1:]), strict=True):
            if rank >= 0:
                if rank in self.queue.buckets:
                    self.queue.buckets[rank] += own.tolist()
                else:
                    self.queue.open(rank, own.tolist())

    def _large_buckets(self, tokens: list[int]) -> tuple[list[int], ...]:
        """The queue's first ranks, each bucket at once with numpy, until buckets get small. A rank that brings up a
        lower one, which must go first, ends this early."""
        n = len(tokens)
        token, after, before = np.array(tokens), np.arange(1, n + 1), np.arange(-1, n - 1)
        due = np.append(self._pair_ranks(token[:-1], token[1:]), -1)
        self._push(due, np.arange(n))
        small = 0
        while small < 24 and (rank := self.queue.lowest()) >= 0:
            bucket = self.queue.take(rank)
            at = np.unique(np.array(bucket))
            at = at[due[at] == rank]
            if not len(at):
                continue
            mate = after[at]
            if np.isin(mate, at).any():  # of overlapping pairs of equal tokens, the leftmost counts
                kept, taken = [], -1
                for i, (x, m) in enumerate(zip(at.tolist(), mate.tolist(), strict=True)):
                    if x != taken:
                        kept.append(i)
                        taken = m
                at, mate = at[kept], mate[kept]
            small = small + 1 if len(at) < 32 else max(0, small - 1)
            far = after[mate]
            was = token[at], token[mate], after[at], before[far], due[mate]
            between = far[np.isin(far, at)]
            between_due = self._pair_ranks(np.full(len(between), rank), token[between])
            token[at], token[mate], after[at], before[far], due[mate] = rank, -1, far, at, -1
            left = before[at]
            right_due, left_due = self._pair_ranks(token[at], token[far]), self._pair_ranks(token[left], token[at])
            if any(((x >= 0) & (x < rank)).any() for x in (between_due, right_due, left_due)):
                token[at], token[mate], after[at], before[far], due[mate] = was
                self.queue.open(rank, bucket)
                break
            due[at], due[left] = right_due, left_due
            self._push(np.concatenate([right_due, left_due]), np.concatenate([at, left]))
        return token.tolist(), after.tolist(), before.tolist(), due.tolist()

    # -- merges -------------------------------------------------------------------------------------------------

    def merged(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token. All share one queue: always the pair of the lowest rank, of equal ones the leftmost,
        becomes one token; no pair crosses two pieces, as a mark without partner stands between them."""
        mark, shift, get, queue = (1 << self.shift) - 1, self.shift, self.pairs.get, self.queue
        byte_rank, buckets = self.byte_rank, queue.buckets
        token = [mark]
        for piece in pieces:
            token += [byte_rank[x] for x in piece]
            token.append(mark)
        n = len(token)
        token, after, before, due = self._large_buckets(token) if n >= MANY else (token, list(range(1, n + 1)), list(range(-1, n - 1)), None)
        if due is None:
            due = [get(a << shift | b, -1) for a, b in zip(token, token[1:], strict=False)]  # the rank of the pair that begins here
            due.append(-1)
            for i, rank in enumerate(due):
                if rank >= 0:
                    if rank in buckets:
                        buckets[rank].append(i)
                    else:
                        queue.open(rank, [i])
        while (rank := queue.lowest()) >= 0:
            bucket = queue.take(rank)
            for done, i in enumerate(bucket):
                if due[i] != rank:
                    continue  # stale: one of the two tokens has been merged since
                j = after[i]
                k = after[j]
                h = before[i]
                token[i] = rank
                token[j] = -1
                after[i] = k
                before[k] = i
                due[j] = -1
                right = due[i] = get(rank << shift | token[k], -1)
                left = due[h] = get(token[h] << shift | rank, -1)
                if right >= 0:
                    if right in buckets:
                        buckets[right].append(i)
                    else:
                        queue.open(right, [i])
                if left >= 0:
                    if left in buckets:
                        buckets[left].append(h)
                    else:
                        queue.open(left, [h])
                if -1 < right < rank or -1 < left < rank:  # a lower rank has come up: it goes first
                    if bucket[done + 1 :]:
                        queue.open(rank, bucket[done + 1 :])
                    break
        out: list[list[int]] = []
        at = 1
        for piece in pieces:
            out.append([x for x in token[at : at + len(piece)] if x >= 0])
            at += len(piece) + 1
        return out

    def encode_rows(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of rows, and where each row's begin and end."""
        text = data.tobytes().decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        heads = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
        rows = heads[bounds]
        start = self.starts(text, points, rows)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        end = np.append(start[1:], len(points))
        of_char = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        keys, first, which = np.unique(byte_hashes(data, of_char[start], of_char[end]), return_index=True, return_inverse=True)
        at, size = self.memo.find(keys)
        if len(new := np.flatnonzero(at < 0)):
            tokens = [text[a:b].encode("utf-8") for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
            whole = [self.ranks.get(x) for x in tokens]
            found = iter(self.merged([x for x, rank in zip(tokens, whole, strict=True) if rank is None]))
            self.memo.add(keys[new], [next(found) if rank is None else [rank] for rank in whole])
            at, size = self.memo.find(keys)
        length = size[which]
        total = np.zeros(len(which) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        take = np.repeat(at[which] - total[:-1], length)
        take += np.arange(len(take))
        return self.memo.ids[take], total[np.searchsorted(start, rows)]

    def encode(self, text: str) -> np.ndarray:
        own = np.frombuffer(text.encode("utf-8"), np.uint8)
        return self.encode_rows(own, np.array([0, len(own)]))[0]

    def encode_alone(self, text: str) -> np.ndarray:
        """As `encode`, with no hashing of pre-tokens."""
        pieces = [m.group().encode("utf-8") for m in self.pattern.finditer(text)]
        return np.array([x for ids in self.merged([p for p in pieces]) for x in ids], "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, gathered from one array of all tokens."""
        if not len(ids):
            return b""
        length = self.token_length[ids]
        stop = np.cumsum(length)
        at = np.repeat(self.token_end[ids] - stop, length)
        at += np.arange(len(at))
        return self.token_bytes[at].tobytes()


@lru_cache(maxsize=1)
def tokenizer(path: str, pattern: str) -> ByteBpe:
    import public_tokenizers

    return ByteBpe(path, pattern, public_tokenizers.PATTERN)


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per row: the number of ids, SHA-256 of the ids (little-endian, 32 bits) and of the decoded bytes, and whether
    decoding gave the text back. with_ids adds `ids array<int>`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for block in blocks(batches, most=TEXT_BYTES):
            rows: list[tuple] = []
            raw = block.data.tobytes()
            if bpe.memo.size() > MEMO_BYTES:
                bpe.memo = Memo()
            all_ids, cuts = bpe.encode_rows(block.data, block.bounds)
            ids_of = []
            for i in range(block.batch.num_rows):
                own, ids = raw[block.bounds[i] : block.bounds[i + 1]], all_ids[cuts[i] : cuts[i + 1]]
                back = bpe.decode(ids)
                if back != own:  # two pre-tokens of the block had one 64-bit hash: this row by itself, token by token
                    ids = bpe.encode_alone(own.decode("utf-8"))
                    back = bpe.decode(ids)
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), len(own), back == own))
                if with_ids:
                    ids_of.append(ids.astype(np.int32))
            n_tokens, ids_sha, decoded_sha, n_bytes, same = zip(*rows, strict=True)
            columns = [
                block.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()),
                pa.array(decoded_sha, pa.string()), pa.array(n_bytes, pa.int64()), pa.array(same, pa.bool_()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "round_trip"]
            if with_ids:
                columns.append(pa.array(ids_of, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return narrowed(docs, "doc_id", "text").mapInArrow(run, schema)
