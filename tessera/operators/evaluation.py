"""Expected tasks against actual ones: pairing, case results, metrics, their spread, and where errors come from."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.ratio import bounded_ratio
from tessera.functions.text import match_form, words_of

#: Least score of two names of one task.
SAME_NAME = 0.72

# Words that tell nothing about a task's name, and those of attribution.
NAME_STOPWORDS = ("anh", "chi", "em", "task", "viec", "phan", "va", "cho", "cac", "the", "a", "an", "to", "for")
SOURCE_STOPWORDS = (*NAME_STOPWORDS, "toi", "minh", "voi", "and", "duoc", "nhung")


@lru_cache(1 << 16)
def name_tokens(plain: str) -> frozenset[str]:
    """The words of a plain name (words of its match form, a blank between) that tell something."""
    return frozenset(w for w in plain.split(" ") if w and w not in NAME_STOPWORDS)


@lru_cache(1 << 16)
def name_score(a: str, b: str, by_characters: bool) -> float:
    """Of two plain names: 1 for equal ones, else nine parts containment and one part Jaccard of their words, or the ratio of
    characters if that is more; below SAME_NAME 0 may stand instead."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y, score = name_tokens(a), name_tokens(b), 0.0
    if x and y:
        both = len(x & y)
        score = 0.9 * both / min(len(x), len(y)) + 0.1 * both / len(x | y)
    return max(score, bounded_ratio(a, b, max(score, SAME_NAME))) if by_characters else score


def best_pairs(score: np.ndarray) -> list[tuple[int, int]]:
    """The most pairs (row, column) of positive score, and of those sets the one of the largest sum.

    Rows are taken one after the other; each opens the shortest of all alternating paths (by reduced costs, over a matrix
    padded with dummy columns), which keeps the pairing of the rows so far optimal."""
    rows, columns = score.shape
    cost = np.zeros((rows, columns + rows))
    cost[:, :columns] = np.where(score > 0, -(1e6 + score), 0.0)
    row_of, row_price, column_price = np.full(columns + rows, -1), np.zeros(rows), np.zeros(columns + rows)
    for start in range(rows):
        far, came, done = np.full(columns + rows, np.inf), np.full(columns + rows, -1), np.zeros(columns + rows, bool)
        row, base, last = start, 0.0, -1
        while True:
            reach = base + cost[row] - row_price[row] - column_price
            closer = ~done & (reach < far - 1e-9)
            far[closer], came[closer] = reach[closer], last
            last = int(np.argmin(np.where(done, np.inf, far)))
            base, done[last] = far[last], True
            if row_of[last] < 0:
                break
            row = int(row_of[last])
        row_price[start] += base
        touched = np.flatnonzero(done & (row_of >= 0))
        row_price[row_of[touched]] += base - far[touched]
        column_price[done] -= base - far[done]
        while last >= 0:
            before = int(came[last])
            row_of[last] = start if before < 0 else row_of[before]
            last = before
    return sorted((int(r), c) for c, r in enumerate(row_of[:columns]) if r >= 0 and score[r, c] > 0)


def few_pairs(score: list[list[float]]) -> list[tuple[int, int]]:
    """`best_pairs` of a few rows and columns, in plain numbers."""
    rows, columns = len(score), len(score[0])
    width = columns + rows
    cost = [[-(1e6 + x) if x > 0 else 0.0 for x in line] + [0.0] * rows for line in score]
    row_of, row_price, column_price = [-1] * width, [0.0] * rows, [0.0] * width
    for start in range(rows):
        far, came, done = [float("inf")] * width, [-1] * width, [False] * width
        row, base, last = start, 0.0, -1
        while True:
            line, price, nearest = cost[row], row_price[row], -1
            for j in range(width):
                if not done[j]:
                    reach = base + line[j] - price - column_price[j]
                    if reach < far[j] - 1e-9:
                        far[j], came[j] = reach, last
                    if nearest < 0 or far[j] < far[nearest]:
                        nearest = j
            last = nearest
            base, done[last] = far[last], True
            if row_of[last] < 0:
                break
            row = row_of[last]
        row_price[start] += base
        for j in range(width):
            if done[j]:
                if row_of[j] >= 0:
                    row_price[row_of[j]] += base - far[j]
                column_price[j] -= base - far[j]
        while last >= 0:
            before = came[last]
            row_of[last] = start if before < 0 else row_of[before]
            last = before
    return sorted((r, c) for c, r in enumerate(row_of[:columns]) if r >= 0 and score[r][c] > 0)


#: Cells up to which a part is paired in plain numbers.
FEW = 400


def linked_pairs(scores: dict[tuple[int, int], float]) -> list[tuple[int, int, float]]:
    """The most pairs of the largest sum among those scored (expected, actual): each connected part by itself, of which most are small."""
    of_left, of_right = {}, {}
    for e, a in scores:
        of_left.setdefault(e, []).append(a)
        of_right.setdefault(a, []).append(e)
    out, seen = [], set()
    for first in sorted(of_left):
        if first in seen:
            continue
        left, right, todo = {first}, set(), [first]
        while todo:
            for a in of_left[todo.pop()]:
                if a not in right:
                    right.add(a)
                    new = [e for e in of_right[a] if e not in left]
                    left.update(new)
                    todo += new
        seen |= left
        es, cs = sorted(left), sorted(right)
        own = [scores[e, a] for e in es for a in of_left[e]]
        if len(es) == 1 or len(cs) == 1:
            e, a = max(((e, a) for e in es for a in cs), key=lambda x: scores[x])
            found = [(e, a)]
        elif len(own) == len(es) * len(cs) and min(own) == max(own):
            found = list(zip(es, cs, strict=False))
        else:
            matrix = [[scores.get((e, a), 0.0) for a in cs] for e in es]
            found = [(es[i], cs[j]) for i, j in (few_pairs(matrix) if len(es) * len(cs) <= FEW else best_pairs(np.array(matrix)))]
        out += [(e, a, scores[e, a]) for e, a in found]
    return out


def case_scores(expected: list[tuple[int, str, str]], actual: list[tuple[int, str, str]], by_characters: bool) -> dict[tuple[int, int], float]:
    """Scores of SAME_NAME or more among a case's tasks (id, key, plain name). Without characters names meet by a common word."""
    def listed(tasks: list[tuple[int, str, str]], at: int) -> dict[str, list[int]]:
        of: dict[str, list[int]] = {}
        for task in tasks:
            if task[at] and (at == 1 or not task[1]):
                of.setdefault(task[at], []).append(task[0])
        return of

    out: dict[tuple[int, int], float] = {}
    keys = listed(actual, 1)
    for key, es in listed(expected, 1).items():
        out.update(((e, a), 1.0) for e in es for a in keys.get(key, ()))
    names, others = listed(expected, 2), listed(actual, 2)
    of_word: dict[str, list[str]] = {}
    if not by_characters:
        for name in others:
            for word in name_tokens(name):
                of_word.setdefault(word, []).append(name)
    for name, es in names.items():
        near = others if by_characters else {x for word in name_tokens(name) for x in of_word.get(word, ())} | ({name} & others.keys())
        for other in near:
            score = name_score(name, other, by_characters)
            if score >= SAME_NAME:
                out.update(((e, a), score) for e in es for a in others[other])
    return out


PAIR = "case_id long, expected_id long, actual_id long, score double"


def paired(expected: DataFrame, actual: DataFrame, by_characters: bool = True) -> DataFrame:
    """case_id, expected_id, actual_id and score of the tasks of a case that are one: tasks (case_id, task_id, task_key,
    task_name) with a key pair by it, the others by name: its words, or its characters if that is more. A case's tasks are one row (plain
    names are computed in the JVM); names are scored once for each distinct pair of a case, and pairs of tasks are never rows."""
    plain = F.coalesce(F.array_join(words_of(match_form(F.col("task_name"))), " "), F.lit(""))
    side = lambda df, mine: df.where("case_id is not null and task_id is not null").select("case_id", F.struct(F.lit(mine).alias("mine"), F.col("task_id").cast("long").alias("id"), F.coalesce("task_key", F.lit("")).alias("key"), plain.alias("name")).alias("task"))
    cases = side(expected, True).unionAll(side(actual, False)).groupBy("case_id").agg(F.collect_list("task").alias("tasks"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tasks, out = batch.column("tasks"), []
            flat, at = tasks.flatten(), np.concatenate([[0], np.cumsum(tasks.value_lengths().to_numpy())]).tolist()
            rows = list(zip(*(flat.field(name).to_pylist() for name in ("id", "key", "name")), flat.field("mine").to_pylist(), strict=True))
            for i, case in enumerate(batch.column("case_id").to_pylist()):
                own = rows[at[i] : at[i + 1]]
                scores = case_scores([x[:3] for x in own if x[3]], [x[:3] for x in own if not x[3]], by_characters)
                out += [(case, *found) for found in linked_pairs(scores)]
            columns = zip(*out, strict=True) if out else ((),) * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["case_id", "expected_id", "actual_id", "score"])

    return cases.mapInArrow(pair, PAIR)


FIELDS = ("assignee", "due_date", "status")


def case_results(expected: DataFrame, actual: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per case: tasks expected, actual and matched, fields checked and correct (in all and by field), and passed."""
    n_expected = expected.groupBy("case_id").agg(F.count("*").alias("expected"))
    n_actual = actual.groupBy("case_id").agg(F.count("*").alias("actual"))
    x = expected.select("case_id", F.col("task_id").alias("expected_id"), *(F.col(f).alias(f"e_{f}") for f in FIELDS))
    y = actual.select("case_id", F.col("task_id").alias("actual_id"), *(F.col(f).alias(f"a_{f}") for f in FIELDS))
    same = {f: (F.lower(f"e_{f}") == F.lower(f"a_{f}")) if f != "due_date" else (F.col(f"e_{f}") == F.col(f"a_{f}")) for f in FIELDS}
    matched = pairs.join(x, ["case_id", "expected_id"]).join(y, ["case_id", "actual_id"])
    of_case = matched.groupBy("case_id").agg(F.count("*").alias("matched"), *(F.count_if(same[f]).alias(f"correct_{f}") for f in FIELDS))
    out = n_expected.join(n_actual, "case_id", "full").join(of_case, "case_id", "left").fillna(0)
    out = out.withColumn("checked", F.col("matched") * len(FIELDS)).withColumn("correct", sum((F.col(f"correct_{f}") for f in FIELDS), F.lit(0)))
    return out.withColumn("passed", (F.col("matched") == F.col("expected")) & (F.col("matched") == F.col("actual")) & (F.col("correct") == F.col("checked")))


def f1(expected: Column, actual: Column, matched: Column, empty: float = 1.0) -> Column:
    """Twice the matched ones over all; `empty` where there are none on either side."""
    return F.when(expected + actual == 0, empty).otherwise(2 * matched / (expected + actual))


def totals(results: DataFrame, *by: str) -> DataFrame:
    """Metrics over case results, by `by` if given."""
    s = lambda c: F.sum(c)
    rate = lambda a, b, none: F.when(b == 0, none).otherwise(a / b)
    expected, actual, matched = s("expected"), s("actual"), s("matched")
    return results.groupBy(*by).agg(
        F.count("*").alias("cases"), F.count_if("passed").alias("passed"), (F.count_if("passed") / F.count("*")).alias("pass_rate"),
        F.when(actual == 0, F.when(expected == 0, 1.0).otherwise(0.0)).otherwise(matched / actual).alias("precision"),
        F.when(expected == 0, F.when(actual == 0, 1.0).otherwise(0.0)).otherwise(matched / expected).alias("recall"), f1(expected, actual, matched).alias("f1"),
        rate(s("correct"), s("checked"), 1.0).alias("field_accuracy"), *(rate(s(f"correct_{f}"), matched, None).alias(f"{f}_accuracy") for f in FIELDS),
    )


def stability(folds: DataFrame, metric: str) -> DataFrame:
    """Least, mean and spread (population) of a metric over folds, in one row."""
    return folds.agg(F.count("*").alias("folds"), F.min(metric).alias("least"), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("spread"))


def ranking_metrics(rows: DataFrame, case: str, item: str, probability: str, label: str, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Average precision, area under the ROC curve, Brier score, calibration error and recall at k, in one row.

    Rows are ranked over all: equal probabilities form one step, so counts by probability are summed first (as many rows as
    there are probabilities), and only these are in one window."""
    p, y = F.col(probability), F.col(label)
    steps = rows.groupBy(p.alias("p")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    down = W.orderBy(F.col("p").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    curve = steps.withColumn("tp", F.sum("pos").over(down)).withColumn("fp", F.sum("neg").over(down))
    area = curve.agg(
        (F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("pos")).alias("average_precision"),
        (F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"), F.sum("pos").alias("positives"),
    )
    bins = rows.groupBy(F.least(F.floor(p * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg(y).alias("share"), F.sum((p - y) * (p - y)).alias("squares"))
    error = bins.agg((F.sum("squares") / F.sum("n")).alias("brier"), (F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("share"))) / F.sum("n")).alias("calibration_error"))
    place = F.row_number().over(W.partitionBy(case).orderBy(p.desc(), item))
    found = rows.withColumn("place", place).agg(*(F.sum(F.when(F.col("place") <= k, y).otherwise(0)).alias(f"hits_{k}") for k in ks))
    one = area.crossJoin(error).crossJoin(found)  # a row each
    return one.select("average_precision", "roc_auc", "brier", "calibration_error", *((F.col(f"hits_{k}") / F.col("positives")).alias(f"recall_at_{k}") for k in ks))


def bootstrap(cases: DataFrame, samples: int = 200, seed: str = "1729") -> DataFrame:
    """Quantiles (0.025, 0.975) of the difference of two F1 over resampled cases (case_no from 0, expected, base_actual,
    base_matched, new_actual, new_matched): draw j of sample s is the case that a hash of (seed, s, j) names.

    Draws are joined to the cases by number, so no sample is ever in one place."""
    n = cases.count()
    draws = cases.sparkSession.range(samples * n).select(F.floor(F.col("id") / n).alias("sample"), F.pmod(F.col("id"), F.lit(n)).alias("draw"))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("sample").cast("string"), F.col("draw").cast("string")))
    draws = draws.withColumn("case_no", F.pmod(F.conv(F.substring(key, 1, 12), 16, 10).cast("long"), F.lit(n)))
    sums = draws.join(cases, "case_no").groupBy("sample").agg(*(F.sum(c).alias(c) for c in ("expected", "base_actual", "base_matched", "new_actual", "new_matched")))
    score = lambda actual, matched: F.when(F.col(matched) == 0, 0.0).otherwise(2 * F.col(matched) / (F.col("expected") + F.col(actual)))
    deltas = sums.withColumn("delta", score("new_actual", "new_matched") - score("base_actual", "base_matched")).agg(F.array_sort(F.collect_list("delta")).alias("d"))  # `samples` numbers
    return deltas.select(F.element_at("d", int(0.025 * samples) + 1).alias("low"), F.element_at("d", int(0.975 * samples)).alias("high"))


def ceilings(expected: Column, actual: Column, matched: Column, recovered: dict[str, Column], removed: dict[str, Column]) -> Column:
    """stage, recovered, removed and F1 as an array: what each stage would give if only its errors were mended."""
    none = F.lit(0).cast("long")
    stages = [(s, recovered.get(s, none), removed.get(s, none)) for s in ("candidate", "authority", "identity", "lifecycle")] + [("full_oracle", expected - matched, actual - matched)]
    of = lambda s, r, x: F.struct(F.lit(s).alias("stage"), r.cast("long").alias("recovered"), x.cast("long").alias("removed"), F.round(f1(expected, actual + r - x, matched + r), 6).alias("f1"))
    return F.array(*(of(*s) for s in stages))


def source_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(words_of(match_form(text)), lambda w: (F.length(w) > 1) & ~w.isin(*SOURCE_STOPWORDS)))


def suggested_sources(tasks: DataFrame, clauses: DataFrame, least: float = 0.12, most: int = 3) -> DataFrame:
    """The clauses that share most words with a task of their meeting. Tasks and clauses meet by (meeting, word)."""
    t = tasks.select("meeting_id", "task_id", source_tokens(F.col("task_name")).alias("words"))
    c = clauses.select("meeting_id", "clause_id", source_tokens(F.col("text_raw")).alias("words"))
    left = t.select("meeting_id", "task_id", F.size("words").alias("n"), F.explode("words").alias("word"))
    right = c.select("meeting_id", "clause_id", F.size("words").alias("m"), F.explode("words").alias("word"))
    shared = left.join(right, ["meeting_id", "word"]).groupBy("meeting_id", "task_id", "clause_id").agg(F.count("*").alias("both"), F.first("n").alias("n"), F.first("m").alias("m"))
    scored = shared.withColumn("score", F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).where(F.col("score") >= least).withColumn("score", F.round("score", 4))
    place = F.row_number().over(W.partitionBy("meeting_id", "task_id").orderBy(F.col("score").desc(), "clause_id"))
    return scored.withColumn("place", place).where(F.col("place") <= most).select("meeting_id", "task_id", "clause_id", "score", "place")


def brute_pairs(score: np.ndarray) -> float:
    """The best sum of `best_pairs`, by trying everything (for tests)."""
    rows, columns = score.shape
    best = 0.0
    for chosen in product(range(columns + 1), repeat=rows):
        used = [c for c in chosen if c < columns]
        if len(set(used)) == len(used) and all(score[r, c] > 0 for r, c in enumerate(chosen) if c < columns):
            best = max(best, sum(1e6 + score[r, c] for r, c in enumerate(chosen) if c < columns))
    return best


def evidence_errors(rows: DataFrame, clauses: DataFrame) -> DataFrame:
    """rows (meeting_id, item, clause_id, start, end, text, authority, owner_clause_id) with `errors`: action evidence that is not
    grounded or whose span differs from the clause, and authority or owner of unknown clauses."""
    known = clauses.select("meeting_id", "clause_id", "text_raw")
    owners = known.select("meeting_id", F.col("clause_id").alias("owner_clause_id"), F.lit(True).alias("owner_known"))
    joined = rows.join(known, ["meeting_id", "clause_id"], "left").join(owners, ["meeting_id", "owner_clause_id"], "left")
    raw, start, end = F.col("text_raw"), F.col("start"), F.col("end")
    grounded = raw.isNotNull() & start.isNotNull() & end.isNotNull()
    inside = (start >= 0) & (end > start) & (end <= F.length(raw)) & (F.substr(raw, start + 1, F.greatest(end - start, F.lit(0))) == F.col("text"))
    errors = F.array_compact(F.array(
        F.when(~grounded, "NOT_GROUNDED").when(~F.coalesce(inside, F.lit(False)), "SPAN_DIFFERS"), F.when((F.coalesce("authority", F.lit("")) == "") | raw.isNull(), "AUTHORITY_INVALID"),
        F.when(F.col("owner_clause_id").isNotNull() & F.col("owner_known").isNull(), "OWNER_INVALID"),
    ))
    return joined.withColumn("errors", errors)
