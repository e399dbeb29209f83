"""Operator 6 against all pairs."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from tessera.llm import neighbours


def brute(rows, k):
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable[i] = min(usable.get(i, v), v)
    out = []
    for q, a in usable.items():
        if q % 100 == 0:
            near = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))), i) for i, b in usable.items() if i != q and len(a) == len(b))
            out += [(q, n + 1, i) for n, (_, i) in enumerate(near[:k])]
    return sorted(out)


def test_nearest_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 64)
    rng = random.Random(5)
    rows = [(i, [float(rng.choice((-1, 0, 1, 2))) * 1.5 for _ in range(6)]) for i in range(420)]
    rows += [(500, None), (600, [0.0] * 6), (700, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (800, [float("nan")] * 6), (900, [float("inf")] * 6), (None, [1.0] * 6), (1000, [3.0, 4.0]), (1001, [3.0, 5.0]), (1100, [7.0]), (3, rows[3][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, tile int")
    found = neighbours.nearest(df, F.col("vec_id") % 100 == 0)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found.collect()) == brute(rows, 10)
    scores = {(r.query_id, r["rank"]): r.score for r in found.collect()}
    assert scores[1000, 1] == 1.0 and (1100, 1) not in scores
    assert neighbours.nearest(df.where("vec_id < 0"), F.col("vec_id") % 100 == 0).collect() == []
