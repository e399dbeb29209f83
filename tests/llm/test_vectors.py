"""Operators 11 and 12 against plain loops over all pairs, and mixing (13) against its contract."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import clusters, mixing, negatives

VECTORS = "vec_id long, embedding array<float>, label int, id string, group int, cell int, v long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2, 3) for i, v, label in rows], VECTORS)


def usable(rows):
    fit = [(i, label, v) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in fit]


def mined(rows, positives=5, negatives_=3):
    known = {}
    for i, label, v in usable(rows):
        if i is not None and label is not None:
            known[i] = min(known.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in known.items():
        if a % 50:
            continue
        scores = {i: (lb, sum(x * y for x, y in zip(v, w, strict=True))) for i, (lb, w) in known.items() if i != a and len(w) == len(v)}
        for p, (_, s) in sorted(((i, x) for i, x in scores.items() if x[0] == label), key=lambda x: (-x[1][1], x[0]))[:positives]:
            fit = sorted((-t, i) for i, (lb, t) in scores.items() if lb != label and 50 * s <= 100 * t <= 95 * s)
            out += [(a, p, n + 1, i, s, -t) for n, (t, i) in enumerate(fit[:negatives_])]
    return sorted(out)


def gathered(seed, n=420, parts=6, spread=0.3):
    """Vectors around a few centres, with ties."""
    rng = random.Random(seed)
    centres = [[rng.choice((-1.0, 0.0, 1.0)) for _ in range(parts)] for _ in range(5)]
    return [(i, [round(x + rng.choice((0, 0, spread, -spread)), 3) for x in centres[rng.randrange(5)]], rng.randrange(4)) for i in range(n)]


ODD = [(500, None, 1), (550, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (551, [float("nan")] * 6, 1), (552, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (553, [1.0] * 6, None),
       (600, [3.0, 4.0], 1), (601, [3.0, 5.0], 1), (602, [1.5, 2.0], 2), (650, [0.0] * 6, 1), (700, [7.0], 9), (750, [], 3)]


@pytest.mark.parametrize("sizes", [(64, 4096, 16384, 50_000), (8, 3, 100, 0), (3, 1, 40, 50_000)])
def test_negatives_equal_all_pairs(spark, monkeypatch, sizes):
    for name, value in zip(("PIVOTS", "GROUP", "SLICE", "BOUNDS"), sizes, strict=True):
        monkeypatch.setattr(negatives, name, value)
    rows = gathered(3) + ODD
    rows += [rows[50], (51, rows[50][1], 0), (100, rows[100][1], 3)]
    found = negatives.mined(vectors(spark, rows), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, found.collect())) == mined(rows)
    assert found.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]


def test_negatives_of_one_label_and_of_nothing(spark):
    rows = [(i, [1.0, float(i % 3)], 1) for i in range(120)]
    assert negatives.mined(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect() == []
    assert negatives.mined(vectors(spark, []), F.col("vec_id") % 50 == 0).collect() == []
    assert negatives.mined(vectors(spark, [(1, [1.0], 1), (2, [2.0], 2)]), F.col("vec_id") % 50 == 0).collect() == []


def test_bounds_spare_copies(spark):
    """Candidates far from every anchor's cell aren't sent to it."""
    rng = random.Random(1)
    rows = [(i, [10.0 * (i % 4 == 0) + rng.random(), 10.0 * (i % 4 == 1) + rng.random(), 10.0 * (i % 4 == 2) + rng.random()], i % 4) for i in range(400)]
    df = vectors(spark, rows).select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), (F.col("vec_id") % 50 == 0).alias("anchor"), negatives.scaled("embedding", 256).alias("v"))
    found = negatives.range_of(df)
    pivots = negatives.pivots_of(df, found, 16)
    near = negatives.placed(df, pivots, "<i4").cache()
    counts = {r["home"]: r["count"] for r in near.where("anchor").groupBy("home").count().collect()}
    groups, limits = negatives.groups_of(counts, pivots, 2), negatives._limits(near, pivots, 5)
    sent = negatives.reached(near, pivots, groups, 1, "<i4", lambda d, own: d <= np.array([[limits.get((c, x, 3), -np.inf) for c in range(16)] for x in own["label"].to_pylist()]))
    assert len(set(groups.first.tolist()) - {-1}) > 1
    assert sent.count() < 400 * len(set(groups.first.tolist()) - {-1}) / 2


def lloyd(rows, dims, k, rounds, scale=1024, seed="3"):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v in kept:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    order = sorted(first, key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())[:k]
    centroids = [first[i] for i in order]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i, n, d) for i, (d, n) in ((i, nearest(v)) for i, v in kept)), key=str), centroids


@pytest.mark.parametrize(("k", "rounds", "block"), [(8, 10, 4096), (20, 6, 37), (3, 3, 50), (1, 2, 4096)])
def test_clusters_equal_comparing_all(spark, monkeypatch, k, rounds, block):
    monkeypatch.setattr(clusters, "BLOCK", block)
    rows = gathered(5, 300) + ODD + [(7, gathered(5, 300)[7][1], 1), (None, [0.5] * 6, 1)]
    found = clusters.clustered(vectors(spark, rows), dims=6, k=k, rounds=rounds)
    expected, centroids = lloyd(rows, 6, k, rounds)
    assert sorted(map(tuple, found.rows.collect()), key=str) == expected
    assert found.centroids.tolist() == centroids
    if k == 20:
        assert sum(found.compared[1:]) < rounds * 20 * len(expected)  # bounds spare most distances


def test_clusters_describe_themselves(spark):
    rows = gathered(6, 60)
    found = clusters.described(spark, clusters.clustered(vectors(spark, rows), dims=6, k=4, rounds=3)).collect()
    expected, centroids = lloyd(rows, 6, 4, 3)
    assert {r.inertia for r in found} == {sum(d for _, _, d in expected)}
    for r in found:
        assert r.cluster_inertia == sum(d for _, n, d in expected if n == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()
    assert clusters.described(spark, clusters.clustered(vectors(spark, []), dims=6)).collect() == []
    few = clusters.described(spark, clusters.clustered(vectors(spark, rows[:3]), dims=6, k=8)).collect()
    assert sorted(r.distance for r in few) == [0, 0, 0]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 12), st.integers(0, 5))
def test_bounds_certify_only_what_holds(seed, k, kept):
    rng = np.random.default_rng(seed)
    kept = min(kept, k - 1)
    x, centroids = rng.integers(-20, 20, (200, 3)), rng.integers(-20, 20, (k, 3))
    state = clusters.compared(x, centroids, kept)
    for _ in range(4):
        after = centroids + rng.integers(-3, 4, (k, 3))
        drift = np.sqrt(((after - centroids).astype(float) ** 2).sum(1)) * (1 + 1e-12)
        centroids = after
        state, _, _ = clusters.moved(x, clusters.unpacked_state(state.packed()), centroids, drift, kept, 1e-6)
        d = ((x[:, None] - centroids[None]) ** 2).sum(2)
        assert (state.own == d.argmin(1)).all()
        root = np.sqrt(d)
        assert (state.upper + 1e-6 >= root[np.arange(len(x)), state.own]).all()
        assert (state.lower <= np.take_along_axis(root, state.near, 1) + 1e-6).all()


def test_parts_too_large_are_an_error(spark):
    with pytest.raises(Exception, match="64 bits|ARITHMETIC_OVERFLOW|CAST_OVERFLOW"):
        clusters.clustered(vectors(spark, [(i, [1e12] * 6, 1) for i in range(9)]), dims=6)


MIXED = [
    (1, "a b c", "x"), (1, "a b c", "x"), (1, "a", "x"), (2, None, "x"), (3, "", "y"), (4, " \t\n", "y"), (None, "a b", "y"), (None, "a b", None), (5, "w " * 5000, None), (6, "é ü z", "Z"),
    (7, "one", ""), (8, "a\x0bb\x0cc\rd", "z"), *((100 + i, "w " * (i % 7), f"s{i % 5}") for i in range(200)), *((1000 + i, "hot word", "hot") for i in range(300)),
]


def filled(sizes, weights, percent, most):
    """Targets by resharing the excess round after round."""
    left, open_, out = percent * sum(sizes) / 100, set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        above = [i for i in open_ if share[i] >= most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = share[i]
            break
        for i in above:
            out[i] = float(most * sizes[i])
            left -= out[i]
            open_.discard(i)
    return out


def check_mix(rows, found, percent=150):
    by_source = {}
    for _, text, source in rows:
        by_source[source] = by_source.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in by_source if s is not None), key=lambda s: s.encode()) + [None] * (None in by_source)
    expected = dict(zip(order, filled([by_source[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], percent, 2), strict=True))
    assert len(found) == len(rows)
    for s in order:
        own = [r for r in found if r.source == s]
        assert {r.source_size for r in own} == {by_source[s]}
        assert all(math.isclose(r.target, expected[s], abs_tol=1e-6) for r in own)
        assert sum(r.taken for r in own) == math.floor(own[0].target + 1e-9)
        assert sum(0 < r.taken % max(1, r.size) for r in own) <= 1  # one document is cut
    assert all(r.taken <= 2 * r.size for r in found)
    assert sorted(r.size for r in found) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows)


def mix_docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], "doc_id long, text string, source string, size int, piece int")


def test_mix_keeps_its_contract_and_repeats_itself(spark):
    found = mixing.mix(mix_docs(spark, MIXED)).collect()
    check_mix(MIXED, found)
    again = mixing.mix(mix_docs(spark, MIXED[::-1]).repartition(7)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


@pytest.mark.parametrize("rows", [[], [(1, None, "x"), (2, "", None)], [(1, "a b c", None)], [(1, "a", "s1"), (2, "b c", "s2")], [(i, "w " * (i * i % 50), f"s{i % 11:02d}") for i in range(60)]])
def test_mix_of_few_rows(spark, rows):
    check_mix(rows, mixing.mix(mix_docs(spark, rows)).collect())


def test_mix_has_no_python_workers(spark):
    plan = mixing.mix(mix_docs(spark, MIXED))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


def test_mix_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    check_mix(rows, mixing.mix(docs).collect())
