"""Hard negatives of anchor vectors (operator 11).

Method: a Voronoi-partitioned distributed kNN join. Whole vectors x get one more part, sqrt(M - |x|^2) (M bounds all squared
norms), anchors a get 0: then |a - x|^2 = |a|^2 + M - 2 a.x, so higher inner products are smaller distances. PIVOTS vectors cut
the space into cells; a cell knows the radius of its anchors. Neighbouring cells form anchor groups of about GROUP anchors
(a cell of more is dealt by hash to several). A candidate is copied only to groups with a cell that it might serve, by
the triangle inequality over the cell's pivot:
- for positives (same label), if its distance to the pivot is within the cell's radius of a distance that holds enough rows of
  the label: the radius and the k-th smallest distance of the cell's own rows of that label (from a histogram per cell and label);
- for negatives (other labels), if the ring between the cell's nearest and farthest wanted score can reach it. The wanted scores
  of an anchor follow from its positives.
A group's candidates are dealt by hash to slices of about SLICE rows; a group and a slice meet in one exact matrix product, and
the best of the slices are ranked (Spark keeps the first few of a partition before it shuffles). Nothing is approximate: bounds
only spare copies, and where they spare none this is a block matrix join.

Edge cases: rows without id, with a null label, a null vector, or null or non-finite parts take no part; rows of one id count
once (the smallest label, then vector); vectors of different lengths don't meet; an anchor without other rows of its label has
no positives, and a positive with a negative score no negatives; equal scores go by smaller id; an empty table gives an empty
table; products that don't fit 64 bits are an arithmetic error; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.blocks import forgotten, written
from tessera.llm.vectors import Range, exact_type, fit, matrix, of_bytes, packed_type, range_of, scaled

#: Pivots; anchors of a group and candidates of a slice, about; bins of the distances to a pivot; cells of a label that are
#: bounded each on its own (with more of them, the bound of a cell is that of its widest label).
PIVOTS, GROUP, SLICE, BINS, BOUNDS = 64, 4096, 16384, 256, 50_000

#: Of a scale, far above the rounding errors of distances.
MARGIN = 1e-6

_PLACED = "id long, label long, dim int, anchor boolean, cell int, near double, home int, away double, v binary"
_POSITIVES = "anchor_id long, positive_id long, score long"
_NEGATIVES = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"


class Pivots(NamedTuple):
    """Pivots as rows, with the additional part last (shorter vectors are filled up with zeros), and the bound of squared norms."""

    rows: np.ndarray
    bound: float

    def distances(self, v: np.ndarray, anchors: bool) -> np.ndarray:
        """Of whole vectors of one length, as anchors or as candidates, to all pivots."""
        x = v.astype(np.float64)
        norm = (x * x).sum(1)
        last = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.bound - norm, 0))
        inner = x @ self.rows[:, : x.shape[1]].T + last[:, None] * self.rows[:, -1]
        return np.sqrt(np.maximum(norm[:, None] + last[:, None] ** 2 + (self.rows**2).sum(1) - 2 * inner, 0))

    @property
    def margin(self) -> float:
        return MARGIN * max(1.0, np.sqrt(self.bound))


def pivots_of(rows: DataFrame, found: Range, n: int) -> Pivots:
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(n).select("v").collect()
    out = np.zeros((len(chosen), found.dims + 1))
    for i, r in enumerate(chosen):
        x = np.array(r["v"], np.float64)
        out[i, : len(x)] = x
        out[i, -1] = np.sqrt(max(found.norm - float((x * x).sum()), 0))
    return Pivots(out, found.norm)


def _by_length(batch: pa.RecordBatch | pa.Table, column: str = "dim") -> Iterator[tuple[np.ndarray, pa.Table]]:
    dims = np.asarray(batch[column].to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch[column].to_numpy())
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield at, batch.take(pa.array(at))


def placed(rows: DataFrame, pivots: Pivots, dtype: str) -> DataFrame:
    """Of each row its cell as a candidate with the distance to the pivot, and of anchors the cell and distance as an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, own in _by_length(batch):
                v = matrix(own["v"])
                as_candidate, as_anchor = pivots.distances(v, anchors=False), pivots.distances(v, anchors=True)
                cell, home, at = as_candidate.argmin(1), as_anchor.argmin(1), np.arange(len(v))
                packed = v.astype(dtype)
                yield pa.RecordBatch.from_arrays([
                    *(own[c] for c in ("id", "label", "dim", "anchor")), pa.array(cell, pa.int32()), pa.array(as_candidate[at, cell]),
                    pa.array(home, pa.int32()), pa.array(as_anchor[at, home]), pa.array([x.tobytes() for x in packed], pa.binary()),
                ], ["id", "label", "dim", "anchor", "cell", "near", "home", "away", "v"])

    return rows.select("id", "label", F.size("v").alias("dim"), "anchor", "v").mapInArrow(run, _PLACED)


class Groups(NamedTuple):
    """For each cell the first of its groups, and how many the cell's anchors are dealt to."""

    first: np.ndarray
    dealt: np.ndarray

    def column(self) -> Column:
        """An anchor's group."""
        first, dealt = (F.array(*[F.lit(int(x)) for x in y]) for y in self)
        cell = F.col("home") + 1
        return (F.element_at(first, cell) + F.pmod(F.xxhash64("id"), F.element_at(dealt, cell).cast("long")).cast("int")).alias("group")


def groups_of(anchors: dict[int, int], pivots: Pivots, size: int) -> Groups:
    """Puts cells with anchors together, nearest ones first, up to `size` anchors."""
    first, dealt, n = np.full(len(pivots.rows), -1), np.ones(len(pivots.rows), np.int64), 0
    left = dict(anchors)
    while left:
        seed = max(left, key=lambda c: (left[c], -c))
        if left[seed] > size:
            first[seed], dealt[seed] = n, -(-left[seed] // size)
            n += int(dealt.item(seed))
            del left[seed]
            continue
        gap = ((pivots.rows - pivots.rows[seed]) ** 2).sum(1)
        held = 0
        for c in sorted(left, key=lambda c: (gap[c], c)):
            if held + left[c] <= size:
                held += left.pop(c)
                first[c] = n
        n += 1
    return Groups(first, dealt)


def reached(rows: DataFrame, pivots: Pivots, groups: Groups, slices: int, dtype: str, may_serve: Callable[[np.ndarray, pa.Table], np.ndarray]) -> DataFrame:
    """Candidates with each group that they may serve: may_serve(distances to pivots, rows) says which cells."""
    cells = np.flatnonzero(groups.first >= 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, own in _by_length(batch):
                row, cell = np.nonzero(may_serve(pivots.distances(of_bytes(own["v"], dtype), anchors=False), own)[:, cells])
                first, dealt = groups.first[cells[cell]], groups.dealt[cells[cell]]
                row = np.repeat(row, dealt)
                group = np.repeat(first, dealt) + np.arange(len(row)) - np.repeat(np.cumsum(dealt) - dealt, dealt)
                pairs = np.unique(row * (int(groups.first.max()) + int(groups.dealt.max()) + 1) + group)
                row, group = np.divmod(pairs, int(groups.first.max()) + int(groups.dealt.max()) + 1)
                out = own.select(["id", "label", "dim", "v"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), *(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out.columns)], ["group", "id", "label", "dim", "v"])

    found = rows.select("id", "label", "dim", "v").mapInArrow(run, "group int, id long, label long, dim int, v binary")
    return found.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int"))


def _scores(anchors: pa.Table, candidates: pa.Table, dtype: str, wide: type) -> np.ndarray:
    return of_bytes(anchors["v"], dtype).astype(wide) @ of_bytes(candidates["v"], dtype).astype(wide).T


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k times: rows that have one left, and where it stands; of equal scores the first."""
    low = np.where(allowed, scores.astype(np.float64) if scores.dtype != np.int64 else scores, -np.inf if scores.dtype != np.int64 else np.iinfo(np.int64).min)
    left = allowed.sum(1)
    for nth in range(k):
        rows = np.flatnonzero(left > nth)
        if not len(rows):
            return
        at = low[rows].argmax(1)
        yield rows, at
        low[rows, at] = -np.inf if scores.dtype != np.int64 else np.iinfo(np.int64).min


def _sorted_parts(left: pa.Table, right: pa.Table) -> Iterator[tuple[pa.Table, pa.Table]]:
    """Anchors and candidates of one length at a time, candidates by id; at most CELLS pairs."""
    right = right.sort_by("id")
    for dim in np.unique(left["dim"].to_numpy()).tolist():
        own = left.filter(pa.compute.equal(left["dim"], dim))
        others = right.filter(pa.compute.equal(right["dim"], dim))
        step = max(1, CELLS // max(1, others.num_rows))
        if others.num_rows:
            for i in range(0, own.num_rows, step):
                yield own.slice(i, step), others


#: Pairs that are multiplied at a time.
CELLS = 1 << 21


def _limits(rows: DataFrame, pivots: Pivots, k: int) -> dict:
    """By (cell, label, length) of anchors, or by (cell, None, None): how far from the pivot a row may be that serves them."""
    width = 2 * np.sqrt(pivots.bound) / BINS or 1.0
    bins = rows.groupBy("cell", "label", "dim", F.floor(F.col("near") / width).alias("bin")).count()
    so_far = F.sum("count").over(Window.partitionBy("cell", "label", "dim").orderBy("bin"))
    enough = bins.withColumn("so_far", so_far).where(F.col("so_far") > k).groupBy("cell", "label", "dim").agg(((F.min("bin") + 1) * width).alias("edge"))
    radius = rows.where("anchor").groupBy(F.col("home").alias("cell"), "label", "dim").agg(F.max("away").alias("radius"))
    limit = (2 * F.col("radius") + F.coalesce("edge", F.lit(float("inf")))).alias("limit")
    bounds = radius.join(enough, ["cell", "label", "dim"], "left").select("cell", "label", "dim", limit)
    own = bounds.limit(BOUNDS + 1).collect()
    if len(own) <= BOUNDS:
        return {(r["cell"], r["label"], r["dim"]): r["limit"] for r in own}
    return {(r["cell"], None, None): r["limit"] for r in bounds.groupBy("cell").agg(F.max("limit").alias("limit")).collect()}


def nearest_of_label(rows: DataFrame, anchors: DataFrame, pivots: Pivots, groups: Groups, found: Range, slices: int, k: int) -> DataFrame:
    """anchor_id, positive_id, score and rank of each anchor's k nearest other rows of its label."""
    dtype, wide, limits = packed_type(found), exact_type(found.dims * found.part**2), _limits(rows, pivots, k)
    margin, n_cells = pivots.margin, len(pivots.rows)

    def may_serve(distances: np.ndarray, own: pa.Table) -> np.ndarray:
        labels, dim = own["label"].to_pylist(), own["dim"][0].as_py()
        by_label = {x: np.array([limits.get((c, x, dim), limits.get((c, None, None), -np.inf)) for c in range(n_cells)]) for x in set(labels)}
        return distances <= np.stack([by_label[x] for x in labels]) + margin

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        for own, others in _sorted_parts(left, right):
            ids, other_ids, labels, other_labels = (t[c].to_numpy() for c in ("id", "label") for t in (own, others))
            for label in np.unique(labels).tolist():  # no products of different labels
                a, b = np.flatnonzero(labels == label), np.flatnonzero(other_labels == label)
                if not len(b):
                    continue
                scores = _scores(own.take(pa.array(a)), others.take(pa.array(b)), dtype, wide)
                for row, at in _best(scores, ids[a][:, None] != other_ids[b], k):
                    out.append((ids[a][row], other_ids[b][at], scores[row, at].astype(np.int64)))
        return _table(out, _POSITIVES)

    asked = anchors.select(groups.column(), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "id", "label", "dim", "v")
    met = asked.groupBy("group", "slice").cogroup(reached(rows, pivots, groups, slices, dtype, may_serve).groupBy("group", "slice")).applyInArrow(meet, _POSITIVES)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _table(out: list[tuple[np.ndarray, ...]], schema: str) -> pa.Table:
    names = [x.split(" ")[0] for x in schema.split(", ")]
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})


def rings(asked: DataFrame, pivots: Pivots) -> dict[int, tuple[float, float]]:
    """Of each cell: between which distances from its pivot a row stands that has a wanted score for one of its anchors."""
    norm = F.aggregate("whole", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    reach = lambda score: F.sqrt(F.greatest(norm + pivots.bound - 2.0 * score.cast("double"), F.lit(0.0)))
    inner, outer = reach(F.array_max("wanted.high")) - F.col("away"), reach(F.array_min("wanted.low")) + F.col("away")
    own = asked.groupBy("home").agg(F.min(inner).alias("inner"), F.max(outer).alias("outer")).collect()
    return {r["home"]: (r["inner"] - pivots.margin, r["outer"] + pivots.margin) for r in own}


def of_other_labels(rows: DataFrame, asked: DataFrame, pivots: Pivots, groups: Groups, found: Range, slices: int, k: int) -> DataFrame:
    """The k best rows of other labels for each anchor and positive of `asked` (wanted: positive_id, score, low, high)."""
    dtype, wide, margins = packed_type(found), exact_type(found.dims * found.part**2), rings(asked, pivots)
    inner = np.array([margins.get(c, (np.inf, -np.inf))[0] for c in range(len(pivots.rows))])
    outer = np.array([margins.get(c, (np.inf, -np.inf))[1] for c in range(len(pivots.rows))])

    def may_serve(distances: np.ndarray, own: pa.Table) -> np.ndarray:
        return (distances >= inner) & (distances <= outer)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        for own, others in _sorted_parts(left, right):
            ids, other_ids, labels, other_labels = (t[c].to_numpy() for c in ("id", "label") for t in (own, others))
            scores, other = _scores(own, others, dtype, wide), labels[:, None] != other_labels
            wanted = own["wanted"].to_pylist()
            for nth in range(max(map(len, wanted))):
                at = np.array([i for i, w in enumerate(wanted) if len(w) > nth])
                positive, score, low, high = np.array([[wanted[i][nth][c] for c in ("positive_id", "score", "low", "high")] for i in at.tolist()], np.int64).T
                part = scores[at]
                for row, j in _best(part, other[at] & (part >= low[:, None]) & (part <= high[:, None]), k):
                    out.append((ids[at[row]], positive[row], other_ids[j], score[row], part[row, j].astype(np.int64)))
        return _table(out, _NEGATIVES)

    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    left = asked.select(groups.column(), every, "id", "label", "dim", "v", "wanted")
    met = left.groupBy("group", "slice").cogroup(reached(rows, pivots, groups, slices, dtype, may_serve).groupBy("group", "slice")).applyInArrow(meet, _NEGATIVES)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mined(
    df: DataFrame, is_anchor: Column, ident: str = "vec_id", label: Column | str = "label", vector: str = "embedding", scale: int = 256,
    positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each anchor and each of its first
    `positives` rows of the same label, the first `negatives` rows of other labels with `least` to `most` % of its score."""
    label = F.col(label) if isinstance(label, str) else label
    own = df.where(F.col(ident).isNotNull() & label.isNotNull()).where(fit(vector))
    whole = own.select(F.col(ident).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), scaled(vector, scale).alias("v"))
    rows = written(whole.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x"), F.max("anchor").alias("anchor")).select("id", "x.label", "anchor", "x.v"), "whole")
    found = range_of(rows)
    pivots = pivots_of(rows, found, PIVOTS)
    dtype, slices = packed_type(found), max(1, -(-found.rows // SLICE))
    near = written(placed(rows, pivots, dtype), "placed")
    counts = {r["home"]: r["count"] for r in near.where("anchor").groupBy("home").count().collect()}
    if not counts:
        forgotten(rows, near)
        return df.sparkSession.createDataFrame([], _RESULT)
    groups = groups_of(counts, pivots, GROUP)
    anchors = near.where("anchor")
    same = written(nearest_of_label(near, anchors, pivots, groups, found, slices, positives), "positives")
    # whole numbers n with least * score <= 100 * n <= most * score; a negative score leaves none
    band = [F.expr(f"cast(({least} * score + 99) div 100 as long)").alias("low"), F.expr(f"cast(({most} * score) div 100 as long)").alias("high")]
    wanted = same.where("score >= 0").select(F.col("anchor_id").alias("id"), F.struct("positive_id", "score", *band).alias("w")).groupBy("id").agg(F.collect_list("w").alias("wanted"))
    asked = written(anchors.join(wanted, "id").join(rows.select("id", F.col("v").alias("whole")), "id"), "asked")
    out = of_other_labels(near, asked, pivots, groups, found, slices, negatives)
    mined_rows = written(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "negatives")
    forgotten(rows, near, same, asked)
    return mined_rows


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
