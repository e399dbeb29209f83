"""Documents whose sets of word n-grams are alike (operator 7).

Method: grouped prefix join. Each document's distinct n-grams stand in one order for all documents, frequent ones last
(by a table of counts over all documents, of a fixed size, and then by hash). Sets of Jaccard similarity t share an n-gram
among the first n - ceil(t n) + 1. Documents of equal sets are one node; nodes with the same prefix and size are one group.
An n-gram that stands in the prefixes of several groups makes these a cell; cells of the same groups are one. A cell is
expanded to the nodes of its groups, pairs of nodes in different components are filtered by size and by a bitmap of each
set (bits of hashes, flipped per n-gram: the number of bits that differ bounds the number of n-grams that do). What is left
meets again as larger bitmaps, as long as the sets, and then as texts, which verify. Links so found join components.

A cell of many nodes that are still apart first tries a few pairs per node; as these join, fewer pairs remain to be tried,
and only cells not yet done are expanded again. After ROUNDS rounds every remaining pair is verified, so no link between
components is missed, and none is capped; a cell of more than CHUNK nodes is then dealt as pairs of chunks, so no task
holds it.

N-grams are told apart by two 64-bit hashes, which are made of two hashes of each word that differ from its first byte on;
sets are equal if a hash of the first ones and a hash of the second ones are. Copies by the thousand share such a hash: rows of sets
with more than a share of all documents (at most 10,000 of them) get their node by a broadcast join, the others by a
shuffle.

Edge cases: null and empty texts, or texts without words, have the empty set and link with nothing; a text of fewer than n
words has its whole sequence as its only n-gram; one row is returned per doc_id (of several texts of one doc_id the one
of the smallest xxhash64 counts); rows without doc_id are returned as their own, without component; very long texts are sets like any
others; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import LOWER, TWIN, bucketed, forgotten, in_a_row, mixed, narrowed, words, written
from tessera.llm.components import components
from tessera.llm.packed import (
    PACKED, array_rows, gathered, hash_part, met, packed, packed_texts, parts_of, runs, squeezed, texts_of, together, tree_sum, unpacked, with_texts,
)

#: Slots of the count table (a fixed size), and of the bitmap, in 64-bit words.
COUNTS, BITMAP = 1 << 22, 8

#: Rounds in which a large cell tries some of its pairs only; pairs per node in such a round; what counts as few pairs.
ROUNDS, TRIES, FEW = 2, 3, 8

#: Nodes of a chunk of a large cell in the last round, about.
CHUNK = 4096

_NODE = "doc_id long, source long, n long, mark long, twin long, group long, prefix binary, bitmap binary"


def distinct_pairs(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, id), by key and then by id."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    return keys[new], ids[new]


class Sets(NamedTuple):
    """Distinct n-grams of rows, one row after the other, each row's by hash: two 64-bit hashes of each, and where rows begin and end."""

    value: np.ndarray
    twin: np.ndarray
    cut: np.ndarray

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.value[self.cut[i] : self.cut[i + 1]], self.twin[self.cut[i] : self.cut[i + 1]]


def sets_of(data: np.ndarray, bounds: np.ndarray, n: int) -> Sets:
    """The sets of rows. N-grams are told apart by both hashes, which are made of two hashes of each word."""
    w = words(LOWER[data], bounds, twin=True)
    rows = len(bounds) - 1
    count = np.diff(w.first)
    grams = in_a_row(w.hash, n), in_a_row(w.twin, n, seed=TWIN)
    last = np.arange(len(grams[0])) + n - 1
    fit = np.flatnonzero(w.row[: len(last)] == w.row[last]) if len(last) else np.zeros(0, np.int64)
    values, twins, owners = [grams[0][fit]], [grams[1][fit]], [w.row[fit]]
    for k in range(1, n):  # all words of a row of fewer than n
        short = np.flatnonzero(count == k)
        if len(short):
            at = w.first[short]
            values.append(mixed(in_a_row(w.hash, k)[at] + np.uint64(k)))
            twins.append(mixed(in_a_row(w.twin, k, seed=TWIN)[at] + np.uint64(k)))
            owners.append(short)
    value, twin, row = np.concatenate(values), np.concatenate(twins), np.concatenate(owners)
    order = np.lexsort((value, row))
    value, twin, row = value[order], twin[order], row[order]
    same = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
    if (same & (twin[1:] != twin[:-1])).any():  # different n-grams of one first hash
        order = np.lexsort((twin, value, row))
        value, twin, row = value[order], twin[order], row[order]
        same = (value[1:] == value[:-1]) & (row[1:] == row[:-1]) & (twin[1:] == twin[:-1])
    new = np.ones(len(value), bool)
    new[1:] = ~same
    value, twin, row = value[new], twin[new], row[new]
    return Sets(value, twin, np.searchsorted(row, np.arange(rows + 1)))


def marks_of(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit hash of each row's set, as two columns: one of its n-grams' first hashes, one of their second."""
    out = []
    for values, seed in ((sets.value, 1), (sets.twin, 2)):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mixed(mixed(values) + np.uint64(seed)), out=total[1:])
        out.append(mixed(total[sets.cut[1:]] - total[sets.cut[:-1]] + np.diff(sets.cut).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def bitmaps_of(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """rows x BITMAP words: bit h(x) is flipped for each x of the set."""
    rows, bits = len(bounds) - 1, 64 * BITMAP
    row = np.repeat(np.arange(rows), np.diff(bounds))
    bit = (mixed(value) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    odd = np.bincount(row * bits + bit, minlength=rows * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(rows, bits), axis=1).view(np.uint64)


def long_bitmap(value: np.ndarray) -> np.ndarray:
    """As `bitmaps_of` for one set, with a power of two of at least 512 bits and of more bits than n-grams, as bytes."""
    bits = max(512, 1 << len(value).bit_length())
    bit = (mixed(value) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(bit, minlength=bits).astype(np.uint8) & 1, bitorder="little")


def differing(a: np.ndarray, b: np.ndarray) -> int:
    """How many bits of two long bitmaps differ, the longer one folded to the length of the other."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def count_table(docs: DataFrame, n: int) -> np.ndarray:
    """How far each slot's count is above the mean slot's, in powers of two of four standard deviations (0: within that).

    So n-grams of more than about 4 sqrt(mean) documents are known to be frequent, and leave the prefixes to rarer ones."""
    pieces = 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTS, np.int64)
        for block, _ in runs(batches):
            value = sets_of(block.data, block.bounds, n).value
            np.add.at(total, (value >> np.uint64(42)).astype(np.int64), 1)
        if total.any():
            yield array_rows(np.split(total, pieces))

    sums = tree_sum(narrowed(docs, "doc_id", "text").where("doc_id is not null").mapInArrow(run, PACKED))
    table = np.concatenate([sums[i] for i in range(pieces)]) if sums else np.zeros(COUNTS, np.int64)
    mean = table.mean()
    above = (table - mean) / (4 * np.sqrt(max(mean, 1.0)))
    return np.where(above > 1, 1 + np.floor(np.log2(np.maximum(above, 1))), 0).astype(np.uint8)


def ceil_share(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


def alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], percent: int) -> bool:
    """Whether two sets, as their n-grams' two hashes, are."""
    n, m = len(a[0]), len(b[0])
    if (a[0][1:] == a[0][:-1]).any() or (b[0][1:] == b[0][:-1]).any():
        both = len(set(zip(*(x.tolist() for x in a), strict=True)) & set(zip(*(x.tolist() for x in b), strict=True)))
    else:
        _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
        both = int((a[1][i] == b[1][j]).sum())
    return 100 * both >= percent * (n + m - both) and both > 0


def cell_pairs(
    node: np.ndarray, size: np.ndarray, component: np.ndarray, bitmap: np.ndarray, side: np.ndarray, percent: int, turn: int, last: bool, tries: int, few: int
) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of places to verify, and whether these are all of the cell's. Nodes of sides 1 and 2 only meet the other's."""
    n = len(node)
    order = np.argsort(mixed(node.astype(np.uint64) + np.uint64(turn) * np.uint64(0x9E3779B97F4A7C15)))
    node, size, component, bitmap, side = node[order], size[order], component[order], bitmap[order], side[order]
    first, second = [], []
    chunk = n if last else min(n, 4096)
    whole = chunk == n
    for low in range(0, n, chunk):
        high = min(n, low + chunk)
        own_first, own_second = [], []
        for i in range(low, high - 1):
            j = slice(i + 1, high)
            small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            ok = (component[j] != component[i]) & (100 * small >= percent * large)
            if side[i]:
                ok &= side[j] != side[i]
            at = np.flatnonzero(ok) + i + 1
            if len(at):
                differ = np.bitwise_count(bitmap[at] ^ bitmap[i]).sum(1, dtype=np.int64)
                at = at[differ * (100 + percent) <= (size[at] + size[i]) * (100 - percent)]
                own_first.append(np.full(len(at), i))
                own_second.append(at)
        if own_first:
            a, b = np.concatenate(own_first), np.concatenate(own_second)
            if len(a) > few * (high - low) and not last:
                whole = False
                nth = np.arange(len(a)) - np.searchsorted(a, a)  # the nth partner of a (a is sorted)
                a, b = a[nth < tries], b[nth < tries]
            first.append(a)
            second.append(b)
    none = np.zeros(0, np.int64)
    a, b = (np.concatenate(x) if x else none for x in (first, second))
    return order[a], order[b], whole


def chunked(name: np.ndarray, node: np.ndarray, n_chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of cells dealt as pairs of chunks: the place of the row, the name of the pair, and the row's side in it (0: the
    pair is one chunk with itself)."""
    own = (mixed(node.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) % n_chunks
    place = np.repeat(np.arange(len(name)), n_chunks)
    other = np.arange(len(place)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
    own = own[place]
    low, high, k = np.minimum(own, other), np.maximum(own, other), n_chunks[place]
    pair_name = mixed(name.astype(np.uint64)[place] + mixed((low * k + high).astype(np.uint64) + np.uint64(1))).view(np.int64)
    return place, np.where(k > 1, pair_name, name[place]), np.where(own == other, 0, np.where(own < other, 1, 2))


def linked(docs: DataFrame, n: int = 5, percent: int = 80, rounds: int = ROUNDS, tries: int = TRIES, few: int = FEW, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles and component_id: the smallest doc_id that links lead to."""
    spark, parts = docs.sparkSession, parts_of(docs)
    sent = spark.sparkContext.broadcast(count_table(docs, n))

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = sent.value
        for block, ids in runs(batches):
            sets = sets_of(block.data, block.bounds, n)
            value, cut = sets.value, sets.cut
            size = np.diff(cut)
            rank = (frequent[(value >> np.uint64(42)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (mixed(value) >> np.uint64(6))
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((rank, row))
            ordered = value[order]
            length = np.where(size > 0, size - ceil_share(size, percent) + 1, 0)
            (mark, twin), bitmap = marks_of(sets), bitmaps_of(value, cut)
            prefix = [ordered[a : a + k] for a, k in zip(cut[:-1].tolist(), length.tolist(), strict=True)]
            group = [int(mixed(np.add.reduce(mixed(p)) + np.array([s], np.uint64))[0]) if s else 0 for p, s in zip(prefix, size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids), block.column("source"), pa.array(size, pa.int64()), pa.array(mark), pa.array(twin), pa.array(np.array(group, np.uint64).view(np.int64)),
                pa.array([p.tobytes() for p in prefix], pa.binary()), pa.array([b.tobytes() for b in bitmap], pa.binary()),
            ], ["doc_id", "source", "n", "mark", "twin", "group", "prefix", "bitmap"])

    texted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("source"))
    rows = written(texted.where("doc_id is not null").mapInArrow(nodes, _NODE), "sets")
    # one set per doc_id; one node, its smallest doc_id, per set
    own = rows.groupBy("doc_id").agg(F.min(F.struct("source", "mark", "twin", "n")).alias("x")).select("doc_id", "x.mark", "x.twin", "x.n")
    members = written(own, "members")
    of_mark = written(members.where("n > 0").groupBy("mark", "twin").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "marks")
    distinct = rows.where("n > 0").groupBy("mark", "twin").agg(F.first("n").alias("n"), F.first("group").alias("group"), F.first("bitmap").alias("bitmap"))
    node = written(of_mark.join(distinct, ["mark", "twin"]).select("node", "mark", "n", "group", "bitmap"), "nodes")
    groups = rows.where("n > 0").groupBy("group").agg(F.first("prefix").alias("prefix"))

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            prefix = [np.frombuffer(p, np.uint64) for p in batch.column(1).to_pylist()]
            if prefix:
                group = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(p) for p in prefix])
                token = np.concatenate(prefix)
                yield hash_part(mixed(token), parts), token, group

    def cells(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        token, group = distinct_pairs(*unpacked(payloads, np.uint64, np.int64))
        head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(token)))
        if not (size > 1).any():
            return
        name = mixed(np.add.reduceat(mixed(group.astype(np.uint64)), head) + size.astype(np.uint64))
        _, one = np.unique(np.where(size > 1, name, np.uint64(0)), return_index=True)
        one = one[size[one] > 1]
        lists = [group[a : a + k].tobytes() for a, k in zip(head[one].tolist(), size[one].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(name[one].view(np.int64)), pa.array(lists, pa.binary())], ["cell", "groups"])

    found = met(groups.mapInArrow(lambda b: gathered(postings(b)), PACKED), cells, "cell long, groups binary").groupBy("cell").agg(F.first("groups").alias("groups"))

    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            lists = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            if lists:
                cell = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in lists])
                group = np.concatenate(lists)
                yield hash_part(mixed(group.astype(np.uint64)), parts), group, cell, np.ones(len(cell), np.int64)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            group = batch.column(0).to_numpy(zero_copy_only=False)
            if len(group):
                yield hash_part(mixed(group.astype(np.uint64)), parts), group, group, np.ones(len(group), np.int64)

    crowded = node.groupBy("group").count().where("count > 1").select("group")
    cell_groups = written(found.mapInArrow(lambda b: gathered(by_group(b)), PACKED).unionAll(crowded.mapInArrow(lambda b: gathered(alone(b)), PACKED)), "cells")

    def node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            if batch.num_rows:
                group, ids, size, mark, component = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
                bitmap = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(-1, BITMAP)
                yield hash_part(mixed(group.astype(np.uint64)), parts), group, ids, size, mark, component, *np.ascontiguousarray(bitmap.T)

    def expanded(left: list[bytes], right: list[bytes]) -> Iterator[pa.RecordBatch]:
        group, cell, n_chunks = unpacked(left, *[np.int64] * 3)
        of, *columns = unpacked(right, *[np.int64] * 5, *[np.uint64] * BITMAP)
        order = np.argsort(of, kind="stable")
        of, columns = of[order], [c[order] for c in columns]
        a, b = np.searchsorted(of, group), np.searchsorted(of, group, "right")
        count = b - a
        pick = np.repeat(a - (np.cumsum(count) - count), count) + np.arange(count.sum())
        if len(pick):
            place, name, side = chunked(np.repeat(cell, count), columns[0][pick], np.repeat(n_chunks, count))
            pick, of_cell = pick[place], np.repeat(cell, count)[place]
            yield packed(hash_part(mixed(name.astype(np.uint64)), parts), name, of_cell, side, *(c[pick] for c in columns))

    #: texts of nodes that stand in cells, once
    wanted = written(together(cell_groups, node.select("group", "node", "n", "mark", F.col("node").alias("c"), "bitmap").mapInArrow(lambda b: gathered(node_rows(b)), PACKED), lambda x, y: _named(x, y, parts), PACKED), "wanted")
    forgotten(rows)
    texts = bucketed(with_texts(packed_texts(docs, parts), wanted, lambda t, p: _chosen(t, p, parts, n), PACKED), "texts")
    forgotten(wanted)

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts_here, payload = batch.column(0).to_pylist(), []
            for own in batch.column(1).to_pylist():
                for ids, data, bounds in texts_of([own]):
                    value, _, cut = sets_of(data, bounds, n)
                    payload.append(_sketch_block(ids, np.diff(cut), [long_bitmap(value[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]))
            if payload:
                yield pa.RecordBatch.from_arrays([pa.array(parts_here, pa.int32()), pa.array(payload, pa.binary())], ["part", "payload"])

    known_sets = bucketed(texts.mapInArrow(sketches, PACKED), "sketches")
    state, links, turn, open_cells, last_tried = None, None, 0, cell_groups, cell_groups
    while True:
        if state is None:
            current = node.withColumn("component", F.col("node"))
        else:
            current = node.join(state, "node", "left").withColumn("component", F.coalesce("component", F.col("node")))
        columns = current.select("group", "node", "n", F.col("group").alias("g"), "component", "bitmap")

        def pairs(payloads: list[bytes], turn: int = turn) -> Iterator[pa.RecordBatch]:
            name, of_cell, side, ids, size, group, component, *bits = unpacked(payloads, *[np.int64] * 7, *[np.uint64] * BITMAP)
            order = np.lexsort((ids, name))
            name, of_cell, side, ids, size, group, component = (x[order] for x in (name, of_cell, side, ids, size, group, component))
            bitmap = np.column_stack(bits)[order]
            head = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else []
            out, unfinished = [], []
            for a, b in zip(head, [*head[1:], len(name)], strict=True):
                if (component[a:b] != component[a]).any():
                    x, y, whole = cell_pairs(ids[a:b], size[a:b], component[a:b], bitmap[a:b], side[a:b], percent, turn, turn >= rounds, tries, few)
                    if not whole:
                        own = np.unique(group[a:b])
                        chunks = -(-(b - a) // chunk) if turn + 1 >= rounds else 1
                        unfinished.append(np.stack([own, np.full(len(own), of_cell[a]), np.full(len(own), chunks)]))
                    if len(x):
                        x, y = ids[a:b][x], ids[a:b][y]
                        out.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
            if out:
                both = np.unique(np.concatenate(out, axis=1), axis=1)
                yield _flagged(packed(np.mod(both[1], parts), both[0], both[1]), False)
            if unfinished:
                group, cell, chunks = np.concatenate(unfinished, axis=1)
                yield _flagged(packed(hash_part(mixed(group.astype(np.uint64)), parts), group, cell, chunks), True)

        cells_now = together(open_cells, columns.mapInArrow(lambda b: gathered(node_rows(b)), PACKED), expanded, PACKED)
        tried = written(met(cells_now, pairs, PACKED + ", more boolean"), "pairs")
        forgotten(last_tried)
        last_tried = tried
        if tried.isEmpty():
            break
        open_cells = tried.where("more").drop("more")
        more = not open_cells.isEmpty()
        asked = together(known_sets, tried.where("not more").drop("more"), lambda a, b: _sketches_sent(a, b, parts), PACKED)
        likely = together(known_sets, asked, lambda a, b: _likely(a, b, parts, percent), PACKED)
        moved = with_texts(texts, likely, lambda t, p: _sent(t, p, parts), PACKED)
        new = written(with_texts(texts, moved, lambda t, p: _verified(t, p, n, percent), "u long, v long"), "new-links")
        links = new if links is None else links.unionAll(new)
        if not more:
            state = components(links)
            break
        state = written(components(links), "components")
        turn += 1
    forgotten(node, texts, known_sets, last_tried)
    many = F.col("copies") > max(100, members.count() // 10_000)
    hot, cold = of_mark.where(many).select("mark", "twin", "node"), of_mark.where(~many & (F.col("copies") > 1)).select("mark", "twin", "node")
    out = members.join(F.broadcast(hot), ["mark", "twin"]).unionByName(
        members.join(F.broadcast(hot), ["mark", "twin"], "left_anti").join(cold, ["mark", "twin"], "left").withColumn("node", F.coalesce("node", "doc_id"))
    )
    if state is not None:
        out = out.join(state, "node", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("long"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", F.when(F.col("n") > 0, F.col("node")).otherwise(F.col("doc_id"))).alias("component_id"))
    nameless = texted.where("doc_id is null").withColumn("doc_id", F.lit(0).cast("long")).mapInArrow(nodes, _NODE)
    return out.unionAll(nameless.select(F.lit(None).cast("long"), "n", F.lit(None).cast("long")))


def _sketch_block(ids: np.ndarray, size: np.ndarray, bitmaps: list[np.ndarray]) -> bytes:
    head = np.concatenate([[len(ids)], ids, size, [len(b) for b in bitmaps]]).astype("<i8").tobytes()
    return head + b"".join(b.tobytes() for b in bitmaps)


def _sketches(payloads: list[bytes]) -> dict[int, tuple[int, np.ndarray]]:
    """doc_id to size and long bitmap."""
    out = {}
    for own in payloads:
        k = int(np.frombuffer(own, "<i8", 1)[0])
        ids, size, length = np.frombuffer(own, "<i8", 3 * k, 8).reshape(3, k).tolist()
        at = 8 + 24 * k
        for i, n, b in zip(ids, size, length, strict=True):
            out[i] = (n, np.frombuffer(own, np.uint8, b, at))
            at += b
    return out


def _sketches_sent(sketches: list[bytes], pairs: list[bytes], parts: int) -> Iterator[pa.RecordBatch]:
    """For distinct pairs (u, v) by v: the pairs and the long bitmaps of v, by u."""
    u, v = unpacked(pairs, np.int64, np.int64)
    if not len(u):
        return
    u, v = np.unique(np.stack([u, v]), axis=1)
    have, part = _sketches(sketches), np.mod(u, parts)
    for p in np.unique(part):
        own = np.flatnonzero(part == p)
        need = np.unique(v[own])
        block = _sketch_block(need, np.array([have[x][0] for x in need.tolist()]), [have[x][1] for x in need.tolist()])
        head = np.concatenate([[len(own)], u[own], v[own]]).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([head + block], pa.binary())], ["part", "payload"])


def _likely(sketches: list[bytes], asked: list[bytes], parts: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs, by v, that the long bitmaps allow to be alike."""
    if not asked:
        return
    have, found = _sketches(sketches), []
    for own in asked:
        k = int(np.frombuffer(own, "<i8", 1)[0])
        u, v = np.frombuffer(own, "<i8", 2 * k, 8).reshape(2, k).tolist()
        theirs = _sketches([own[8 + 16 * k :]])
        for a, b in zip(u, v, strict=True):
            (n, x), (m, y) = have[a], theirs[b]
            if differing(x, y) * (100 + percent) <= (n + m) * (100 - percent):
                found.append((a, b))
    if found:
        both = np.array(found, np.int64).T
        yield packed(np.mod(both[1], parts), both[0], both[1])


def _flagged(batch: pa.RecordBatch, more: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array([more] * batch.num_rows)], ["part", "payload", "more"])


def _named(left: list[bytes], right: list[bytes], parts: int) -> Iterator[pa.RecordBatch]:
    """(node, mark) of the groups that stand in cells, by document."""
    group, _, _ = unpacked(left, *[np.int64] * 3)
    of, ids, _, mark, *_ = unpacked(right, *[np.int64] * 5, *[np.uint64] * BITMAP)
    own = np.isin(of, group)
    if own.any():
        yield packed(np.mod(ids[own], parts), ids[own], mark[own])


def _chosen(texts: Iterator, payloads: list[bytes], parts: int, n: int) -> Iterator[pa.RecordBatch]:
    """The texts of the named nodes (those with the named set), packed again; each once."""
    ids, mark = unpacked(payloads, np.int64, np.int64)
    marks = dict(zip(ids.tolist(), mark.tolist(), strict=True))
    for own, data, bounds in texts:
        at = [i for i, x in enumerate(own.tolist()) if x in marks]
        if not at:
            continue
        raw = [data[bounds[i] : bounds[i + 1]] for i in at]
        flat, cut = np.concatenate(raw), np.append(0, np.cumsum([len(x) for x in raw]))
        have, _ = marks_of(sets_of(flat, cut, n))
        keep = []
        for k, i in enumerate(at):
            if marks.get(int(own[i])) == have[k]:
                keep.append(k)
                del marks[int(own[i])]
        if keep:
            body = np.concatenate([raw[k] for k in keep]).tobytes()
            yield _text_row(int(own[at[0]]) % parts, own[[at[k] for k in keep]], [len(raw[k]) for k in keep], body)


def _text_block(ids: np.ndarray, lengths: list[int], body: bytes) -> bytes:
    return np.concatenate([[len(ids), len(body)], ids, lengths]).astype("<i8").tobytes() + squeezed(body)


def _text_row(part: int, ids: np.ndarray, lengths: list[int], body: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_text_block(ids, lengths, body)], pa.binary())], ["part", "payload"])


def _sent(texts: Iterator, payloads: list[bytes], parts: int) -> Iterator[pa.RecordBatch]:
    """For pairs (u, v) by v: the texts of v and the pairs, by u."""
    u, v = unpacked(payloads, np.int64, np.int64)
    if not len(u):
        return
    have = {}
    for ids, data, bounds in texts:
        for i, x in enumerate(ids.tolist()):
            have[x] = data[bounds[i] : bounds[i + 1]]
    part = np.mod(u, parts)
    for p in np.unique(part):
        own = np.flatnonzero(part == p)
        need = np.unique(v[own])
        raw = [have[x] for x in need.tolist()]
        block = _text_block(need, [len(x) for x in raw], np.concatenate(raw).tobytes())
        head = np.concatenate([[len(own)], u[own], v[own]]).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([head + block], pa.binary())], ["part", "payload"])


def _verified(texts: Iterator, payloads: list[bytes], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets are alike indeed."""
    if not payloads:
        return
    need: set[int] = set()
    for own in payloads:
        k = int(np.frombuffer(own, "<i8", 1)[0])
        need.update(np.frombuffer(own, "<i8", k, 8).tolist())
    have: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for ids, data, bounds in texts:
        if any(x in need for x in ids.tolist()):
            sets = sets_of(data, bounds, n)
            have |= {x: sets.of(i) for i, x in enumerate(ids.tolist()) if x in need}
    out = []
    for own in payloads:
        k = int(np.frombuffer(own, "<i8", 1)[0])
        u, v = np.frombuffer(own, "<i8", 2 * k, 8).reshape(2, k)
        for ids, data, bounds in texts_of([own[8 + 16 * k :]]):
            sets = sets_of(data, bounds, n)
            theirs = {x: sets.of(i) for i, x in enumerate(ids.tolist())}
            out += [(a, b) for a, b in zip(u.tolist(), v.tolist(), strict=True) if alike(have[a], theirs[b], percent)]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["u", "v"])
