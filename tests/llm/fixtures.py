"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, part int, payload string, id string, v string, score double, component string, node string, words string, kind string"


def words(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(("ba", "ko", "mi", "tu", "re", "éo", "sal")) for _ in range(1 + rng.randrange(3))) + str(rng.randrange(vocabulary)) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    base, passage, long = words(1, 130), words(2, 70), words(3, 6000)
    near = base.split(" ")
    rows: list[tuple[int | None, str | None]] = [
        (10, base), (3, base), (7, " ".join([*near[:60], "changed", *near[61:]])), (8, "  " + base.upper() + "\n"), (20, words(4, 40) + " " + passage), (21, passage + "\n" + words(5, 30)),
        (22, words(6, 90)), (23, long), (24, long + " end"), (25, ""), (26, None), (27, " \n\t"), (28, "one"), (29, "one two"), (30, "ONE two"), (31, "a" * 700), (32, "日本 " * 150), (33, passage + " " + passage),
        (None, base), (None, None), (40, base), (40, base), (-5, passage),
    ]
    rows += [(100 + i, " ".join([*near[:i], f"x{i}", *near[i + 1 :]])) for i in range(25)]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "p", "i", "v", 0.5, "c", "n", "w", "k") for i, t in rows], DOCUMENT)


def empty(spark):
    return spark.createDataFrame([], DOCUMENT)


def answers(df) -> dict:
    return {r[0]: tuple(r)[1:] for r in df.collect() if r[0] is not None}


def by_id() -> list[tuple[int, str]]:
    """One (doc_id, text) of each id."""
    return sorted({i: t or "" for i, t in texts() if i is not None}.items())
