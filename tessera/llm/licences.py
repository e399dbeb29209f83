"""Licence notices in texts (operator 10), with DataFrame functions only.

Method: trained paragraph classifier. A softmax regression over binary word 1- and 2-grams tells licence families and an
unknown class apart; numpy fits it on the driver, sparsely, on variants of TEMPLATES and on a bounded sample of paragraphs
(MOST_PARAGRAPHS), and sets a temperature on held-out variants. Scoring is native: paragraphs (lines) that hold a cue that
every template has are exploded into their n-grams, joined to the broadcast weights (a few thousand rows, fixed by the
templates) and summed. A prediction counts only if the paragraph has most words of one of the family's templates.
Notices that are wrapped over several lines are scored as windows: from each line, the words of it and the lines below, as
many as half as many again as the longest template has (MOST_WORDS), up to a line without words. A window counts if it is
confirmed and none of its lines is by itself; of those of a family that overlap, the one with most of the template's words
counts, of equal ones the last. It stands at the place of its first line, instead of its unconfirmed lines.

Edge cases: null and empty texts have no paragraphs; a text without line breaks is one paragraph, however long; identical
paragraphs at the same place of one doc_id are reported once; rows without doc_id are reported under null; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import narrowed

#: Paragraphs of the corpus that the unknown class is fitted on, at most, documents that they come from, and their length.
MOST_PARAGRAPHS, MOST_DOCUMENTS, MOST_CHARACTERS = 1500, 200, 2000

#: Least probability, and least share of a template's words, of a confirmed family.
PROBABLE, CONFIRMED = 0.5, 0.6

#: What a window must have more of a template than its confirmed lines.
GAIN = 0.2

UNKNOWN = "unknown"

#: Notices by which the families are known.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["Released under CC0 1.0 Universal, public domain dedication."],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
}

#: A paragraph without any of these is no notice (each template has one).
CUES = ("licen", "permission", "redistribut", "public domain", "copyright", "warrant")

#: Words too common to be terms of their own.
COMMON = ("the", "of", "to", "and", "or", "a", "in", "is", "this", "any", "with", "for", "at", "are", "that", "you", "not", "by", "be", "as", "it")

#: Sentences with the words of notices that are none.
LOOKALIKES = (
    "the driver must hold a valid license and show it on request",
    "permission was granted by the head of the school",
    "the warranty covers parts and labour for two years",
    "copyright is a form of intellectual property",
    "all rights reserved no part of this publication may be copied",
    "the public domain is where works go when terms end",
    "they redistribute food under the terms of the general agreement",
    "mit is a university and apache is a helicopter",
    "version 2 of the work was released in may",
)


def tokens(text: str) -> list[str]:
    return [x for x in re.sub(r"[^a-z0-9.+-]+", " ", text.lower()).replace(". ", " ").strip(" .").split(" ") if x]


def terms(words: list[str]) -> set[str]:
    return {w for w in words if w not in COMMON} | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def word_list(text: Column) -> Column:
    """`tokens` as an expression."""
    flat = F.regexp_replace(F.lower(text), "[^a-z0-9.+-]+", " ")
    return F.filter(F.split(F.regexp_replace(F.regexp_replace(flat, "\\. ", " "), "^[ .]+|[ .]+$", ""), " "), lambda x: x != "")


#: Words of a window of lines, at most.
MOST_WORDS = 3 * max(len(tokens(t)) for v in TEMPLATES.values() for t in v) // 2


class Classifier:
    """terms, weights (terms x families and unknown), bias and temperature."""

    def __init__(self, names: list[str], grams: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float) -> None:
        self.names, self.grams, self.weights, self.bias, self.temperature = names, grams, weights, bias, temperature


def variants(rng: np.random.Generator, sentence: list[str], n: int) -> list[list[str]]:
    """The sentence, and n times with words left out or put around it."""
    out = [sentence]
    for _ in range(n):
        keep = [w for w in sentence if rng.random() > 0.08]
        before = list(rng.choice(COMMON, rng.integers(0, 5)))
        after = list(rng.choice(COMMON, rng.integers(0, 5)))
        out.append(before + keep + after)
    return out


def fit(paragraphs: list[str], seed: int = 5) -> Classifier:
    """paragraphs: of the corpus, for the unknown class; those that are notices themselves are left out."""
    rng = np.random.default_rng(seed)
    names = [UNKNOWN, *TEMPLATES]
    sentences = {k: [tokens(t) for t in v] for k, v in TEMPLATES.items()}
    vocabulary = sorted(set().union(*(terms(s) for v in sentences.values() for s in v)))
    place = {g: i for i, g in enumerate(vocabulary)}
    rows: list[tuple[int, list[str]]] = []
    for k, own in sentences.items():
        for s in own:
            rows += [(names.index(k), x) for x in variants(rng, s, 60 // len(own))]
    templates = [set(s) for v in sentences.values() for s in v]
    for p in [*LOOKALIKES, *paragraphs]:
        words = tokens(p)
        if p in LOOKALIKES or max(len(t & set(words)) / len(t) for t in templates) < CONFIRMED:
            rows.append((0, words))
    common = [w for t in templates for w in t]
    rows += [(0, list(rng.choice(common, rng.integers(2, 12)))) for _ in range(300)]
    x, y = np.zeros((len(rows), len(vocabulary)), np.float32), np.array([k for k, _ in rows])
    for i, (_, words) in enumerate(rows):
        for g in terms(words):
            if g in place:
                x[i, place[g]] = 1
    held = rng.random(len(rows)) < 0.2
    weights, bias = np.zeros((len(vocabulary), len(names))), np.zeros(len(names))
    share = np.array([1 / max(1, (y == k).sum()) for k in range(len(names))])[y][~held]
    share[y[~held] == 0] *= 4
    share /= share.sum()
    learnt = x[~held].astype(np.float64)
    for _ in range(400):
        p = _softmax(learnt @ weights + bias)
        p[np.arange(len(p)), y[~held]] -= 1
        p *= share[:, None]
        weights -= 4.0 * (learnt.T @ p)
        weights = np.sign(weights) * np.maximum(np.abs(weights) - 4.0 * 1e-5, 0)  # the lasso's step: few terms stay
        bias -= 4.0 * p.sum(0)
    z = x[held] @ weights + bias
    losses = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), y[held]], 1e-9)).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0)}
    kept = np.abs(weights).sum(1) > 0
    return Classifier(names, [g for g, k in zip(vocabulary, kept, strict=True) if k], weights[kept], bias, min(losses, key=losses.__getitem__))


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def sample(docs: DataFrame) -> list[str]:
    """Paragraphs for `fit`: of the documents with the smallest hashes of doc_id the lines with the smallest hashes, none
    longer than MOST_CHARACTERS."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_DOCUMENTS)
    few = narrowed(docs, "doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")
    lines = few.select(F.explode(F.split("text", "\n")).alias("line")).where(F.length("line").between(1, MOST_CHARACTERS)).distinct()
    return [r["line"] for r in lines.orderBy(F.xxhash64("line"), "line").limit(MOST_PARAGRAPHS).collect()]


def _rows(docs: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """A small fixed table as a literal."""
    return docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _cue_lines() -> Column:
    """The lines with a cue and their places, of a text's `lines`: others are not sent on."""
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("paragraph"), x.alias("line")))
    return F.filter(numbered, lambda s: _has_cue(s["line"]))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _share(own: Column) -> Column:
    """The largest share of a template's words that some words hold."""
    known = [sorted(set(tokens(x))) for v in TEMPLATES.values() for x in v]
    some = F.array(*map(F.lit, sorted(set().union(*known))))
    literal = [(F.array(*map(F.lit, t)), len(t)) for t in known]
    return _let(F.array_intersect(own, some), lambda w: F.greatest(*(F.size(F.array_intersect(t, w)) / n for t, n in literal)))


def _windows(texts: DataFrame) -> DataFrame:
    """Windows of several lines that have enough words of a template, of texts with their lines.

    Windows are looked for around lines with a cue, where all words of the lines that a window with it can have could confirm
    a family or better what the line itself confirms. A text's lines are cut into words once, and what several cues have in
    common is looked at once."""
    texts = texts.withColumn("each", F.explode(F.array(F.transform("lines", word_list)))).withColumn("worded", F.transform("lines", lambda x: x.rlike("[A-Za-z0-9]")))
    lines, each, worded = F.col("lines"), F.col("each"), F.col("worded")

    def reach(cue: Column) -> Column:
        """From which line on a window may begin that holds the cue: the one after the last without words."""
        low = F.greatest(cue - MOST_WORDS, F.lit(0))
        back = F.array_position(F.reverse(F.slice(worded, low + 1, cue - low)), F.lit(False)).cast("int")
        return F.when(back > 0, cue - back + 1).otherwise(low)

    def promising(cue: Column) -> Column:
        words = lambda low: F.flatten(F.slice(each, low + 1, cue - low + 1 + MOST_WORDS))
        return _let(F.struct(_share(each[cue]).alias("own"), _share(words(reach(cue))).alias("bound")), lambda x: (x["bound"] >= CONFIRMED) & ((x["own"] < CONFIRMED) | (x["bound"] >= x["own"] + GAIN)))

    cues = F.filter(F.transform(lines, lambda x, i: F.when(_has_cue(x), i)), lambda i: i.isNotNull())
    texts = texts.withColumn("cues", F.filter(cues, promising)).where("size(cues) > 0")
    starts = F.array_distinct(F.flatten(F.transform("cues", lambda c: F.sequence(reach(c), c))))
    begun = lambda own, n: F.slice(F.flatten(F.slice(own, F.lit(1), n)), 1, MOST_WORDS)

    def lines_taken(at: Column) -> Column:
        """Lines from one on, until MOST_WORDS words are there or one has none."""
        sizes = F.transform(F.slice(each, at + 1, MOST_WORDS), F.size)
        full = F.aggregate(sizes, F.struct(F.lit(0).alias("n"), F.lit(0).alias("words")), lambda s, n: F.struct(
            (s["n"] + F.when(s["words"] < MOST_WORDS, 1).otherwise(0)).alias("n"), (s["words"] + n).alias("words"),
        ))["n"]
        blank = F.array_position(F.slice(worded, at + 1, MOST_WORDS), F.lit(False)).cast("int")
        return F.when(blank > 0, F.least(full, blank - 1)).otherwise(full)

    def window(at: Column) -> Column:
        def ended(n: Column, own: Column) -> Column:
            """The window ends where nothing is gained any more."""
            shares = F.transform(F.sequence(F.lit(1), n), lambda k: _share(begun(own, k)))
            best = _let(shares, lambda x: F.array_position(x, F.array_max(x)).cast("int"))
            return _let(best, lambda k: F.when(k > 1, F.struct(
                at.alias("paragraph"), (at + k - 1).alias("last"), F.array_join(F.slice(lines, at + 1, k), " ").alias("line"), begun(own, k).alias("words"),
            )))

        def tried(n: Column) -> Column:
            own = F.slice(each, at + 1, F.greatest(n, F.lit(1)))
            hopeful = (n > 1) & F.exists(F.slice(lines, at + 1, F.greatest(n, F.lit(1))), _has_cue) & (_share(begun(own, n)) >= CONFIRMED)
            return F.when(hopeful, ended(n, own))

        return _let(lines_taken(at), tried)

    found = F.filter(F.transform(starts, window), lambda x: x.isNotNull())
    return texts.select("doc_id", "source", F.explode(found).alias("x")).select("doc_id", "source", "x.*")


def _chosen(found: DataFrame) -> DataFrame:
    """Lines and windows of each text, without windows that a line or a better window stands for, and without the lines of
    the others."""
    rows = F.array_agg(F.struct("paragraph", "last", "key", "guess", "probability", "similarity", "confirmed"))
    texts = found.groupBy("doc_id", "source").agg(rows.alias("rows"))
    joined = lambda x: x["last"] > x["paragraph"]
    meets = lambda x, y: (x["paragraph"] <= y["last"]) & (y["paragraph"] <= x["last"])
    better = lambda x, y: (x["similarity"] > y["similarity"]) | ((x["similarity"] == y["similarity"]) & (x["paragraph"] > y["paragraph"]))
    texts = texts.withColumn("alone", F.filter("rows", lambda x: ~joined(x)))
    texts = texts.withColumn("sure", F.filter("alone", lambda x: x["confirmed"]))
    texts = texts.withColumn("wide", F.filter("rows", lambda x: joined(x) & x["confirmed"] & ~F.exists("sure", lambda y: meets(x, y) & (x["similarity"] < y["similarity"] + GAIN))))
    texts = texts.withColumn("wide", F.filter("wide", lambda x: ~F.exists("wide", lambda y: meets(x, y) & (x["guess"] == y["guess"]) & better(y, x))))
    texts = texts.withColumn("alone", F.filter("alone", lambda x: ~F.exists("wide", lambda y: meets(x, y))))
    return texts.select("doc_id", F.explode(F.concat("alone", "wide")).alias("x")).select("doc_id", "x.*").dropDuplicates(["doc_id", "paragraph", "key"])


def notices(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, paragraph (the line, from 0), family, probability, similarity (share of the nearest template's words) and
    confirmed, of every line with a cue and every wrapped notice; what isn't confirmed has the family unknown."""
    c, names = classifier, classifier.names
    texts = narrowed(docs, "doc_id", "text").where(_has_cue(F.col("text"))).select("doc_id", F.xxhash64("text").alias("source"), F.split("text", "\n").alias("lines"))
    lines = texts.select("doc_id", "source", F.explode(_cue_lines()).alias("x")).select("doc_id", "source", "x.*")
    lines = lines.select("doc_id", "source", "paragraph", F.col("paragraph").alias("last"), "line", word_list(F.col("line")).alias("words"))
    lines = lines.unionAll(_windows(texts)).withColumn("key", F.xxhash64("line", F.col("last") - F.col("paragraph"))).drop("line")
    place = ["doc_id", "source", "paragraph", "key"]
    lines = lines.dropDuplicates(place)
    pairs = F.expr("transform(sequence(2, greatest(size(words), 2)), i -> concat_ws(' ', element_at(words, greatest(1, i - 1)), try_element_at(words, i)))")
    grams = lines.select(*place, F.explode(F.array_distinct(F.concat("words", pairs))).alias("gram"))
    table = _rows(docs, [{"gram": g, **{f"w{k}": round(float(v), 6) for k, v in enumerate(row)}} for g, row in zip(c.grams, c.weights, strict=True)],
                  "gram:string," + ",".join(f"w{k}:double" for k in range(len(names))))
    logits = grams.join(F.broadcast(table), "gram").groupBy(*place).agg(*(F.sum(f"w{k}").alias(f"w{k}") for k in range(len(names))))
    z = F.array(*((F.round(F.col(f"w{k}") + float(c.bias[k]), 9) / c.temperature) for k in range(len(names))))
    scored = logits.select(*place, z.alias("z")).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    scored = scored.select(
        F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("paragraph").alias("p"), F.col("key").alias("k"), (1 / total).alias("probability"),
        F.element_at(F.array(*map(F.lit, names)), F.array_position("z", F.col("top")).cast("int")).alias("guess"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("source") == F.col("s")) & (F.col("paragraph") == F.col("p")) & (F.col("key") == F.col("k"))
    known = lines.join(scored, same, "left")
    templates = _rows(docs, [{"guess": k, "templates": [sorted(set(tokens(t))) for t in v]} for k, v in TEMPLATES.items()], "guess:string,templates:array<array<string>>")
    near = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("words"))) / F.size(t)))
    out = known.join(F.broadcast(templates), "guess", "left").withColumn("similarity", F.coalesce(near, F.lit(0.0)))
    out = out.withColumn("confirmed", F.coalesce((F.col("probability") >= PROBABLE) & (F.col("similarity") >= CONFIRMED) & (F.col("guess") != UNKNOWN), F.lit(False)))
    return _chosen(out).select(
        "doc_id", "paragraph", F.when(F.col("confirmed"), F.col("guess")).otherwise(F.lit(UNKNOWN)).alias("family"),
        F.coalesce("probability", F.lit(1.0)).alias("probability"), "similarity", "confirmed",
    )


def _has_cue(text: Column) -> Column:
    lower, out = F.lower(text), F.lit(False)
    for cue in CUES:
        out = out | F.contains(lower, F.lit(cue))
    return out
