"""Queries over evaluation: orders as tasks of their customer's case, with tasks left out, added and changed by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import evaluation as E
from tessera.plans.rendered import table
from tessera.plans.said import SAID_SQL, match_sql, said, sql_text, words_sql


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where(k % 11 != 0).select(
        F.col("o_custkey").alias("case_id"), k.alias("task_id"), k.cast("string").alias("task_key"), F.concat(F.lit("Order "), k).alias("task_name"), F.concat(F.lit("P"), k % 4).alias("assignee"),
        F.to_date("o_orderdate").cast("string").alias("due_date"), F.lower("o_orderstatus").alias("status"),
    )


def _actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where(k % 7 != 0).select(
        F.col("o_custkey").alias("case_id"), k.alias("task_id"), k.cast("string").alias("task_key"), F.concat(F.lit("Order "), k).alias("task_name"),
        F.concat(F.when(k % 5 == 0, "Q").otherwise("p"), k % 4).alias("assignee"), F.date_add(F.to_date("o_orderdate"), F.when(k % 9 == 0, 1).otherwise(0)).cast("string").alias("due_date"), F.col("o_orderstatus").alias("status"),
    )


def _key_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tasks have keys here, and keys are unique: their pairing is an equi-join."""
    e, a = _expected(spark, sf_dir), _actual(spark, sf_dir)
    return e.select("case_id", "task_key", F.col("task_id").alias("expected_id")).join(a.select("case_id", "task_key", F.col("task_id").alias("actual_id")), ["case_id", "task_key"]).drop("task_key")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.case_results(_expected(spark, sf_dir), _actual(spark, sf_dir), _key_pairs(spark, sf_dir))


RESULTS_SQL = """o AS (SELECT o_custkey AS case_id, o_orderkey AS k, o_orderkey % 11 <> 0 AS e, o_orderkey % 7 <> 0 AS a FROM orders),
results AS (SELECT case_id, count(*) FILTER (e) AS expected, count(*) FILTER (a) AS actual, count(*) FILTER (e AND a) AS matched, count(*) FILTER (e AND a AND k % 5 <> 0) AS correct_assignee,
    count(*) FILTER (e AND a AND k % 9 <> 0) AS correct_due_date, count(*) FILTER (e AND a) AS correct_status FROM o GROUP BY case_id HAVING bool_or(e OR a)),
r AS (SELECT *, matched * 3 AS checked, correct_assignee + correct_due_date + correct_status AS correct FROM results), cases AS (SELECT *, matched = expected AND matched = actual AND correct = checked AS passed FROM r)"""


def agg05_case_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir)


AGG05 = f"WITH {RESULTS_SQL} SELECT * FROM cases"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def agg05_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.totals(_results(spark, sf_dir)))


_TOTALS = """count(*) AS cases, count(*) FILTER (passed) AS passed, round(count(*) FILTER (passed) / count(*), 6) AS pass_rate, round(sum(matched) / sum(actual), 6) AS precision, round(sum(matched) / sum(expected), 6) AS recall,
  round(2 * sum(matched) / (sum(expected) + sum(actual)), 6) AS f1, round(sum(correct) / sum(checked), 6) AS field_accuracy, round(sum(correct_assignee) / sum(matched), 6) AS assignee_accuracy,
  round(sum(correct_due_date) / sum(matched), 6) AS due_date_accuracy, round(sum(correct_status) / sum(matched), 6) AS status_accuracy"""
AGG05T = f"WITH {RESULTS_SQL} SELECT {_TOTALS} FROM cases"


def agg15_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by family of cases (the case's number modulo 8)."""
    return _rounded(E.totals(_results(spark, sf_dir).withColumn("family", F.col("case_id") % 8), "family"))


AGG15 = f"WITH {RESULTS_SQL} SELECT case_id % 8 AS family, {_TOTALS} FROM cases GROUP BY family"


def agg15_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.stability(E.totals(_results(spark, sf_dir).withColumn("fold", F.col("case_id") % 5), "fold"), "f1"))


AGG15S = f"""WITH {RESULTS_SQL}, f AS (SELECT case_id % 5 AS fold, 2 * sum(matched) / (sum(expected) + sum(actual)) AS f1 FROM cases GROUP BY fold)
SELECT count(*) AS folds, round(min(f1), 6) AS least, round(avg(f1), 6) AS mean, round(stddev_pop(f1), 6) AS spread FROM f"""


def jon10_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks without keys paired by name: names differ in their numbers only, so the best pairs are those of equal names."""
    e = _expected(spark, sf_dir).withColumn("task_key", F.lit("")).withColumn("task_name", F.concat(F.lit("order"), F.col("task_id")))
    a = _actual(spark, sf_dir).withColumn("task_key", F.lit("")).withColumn("task_name", F.concat(F.lit("order"), F.col("task_id")))
    return E.paired(e, a, by_characters=False)


JON10 = f"WITH {RESULTS_SQL} SELECT case_id, k AS expected_id, k AS actual_id, 1.0::DOUBLE AS score FROM o WHERE e AND a"


#: Names of tasks, and how others write them.
JON_NAMES = ("Viết báo cáo doanh thu", "Prepare release plan", "Review the contract with the bank", "Kiểm tra dashboard", "Send the weekly newsletter")
JON_SAID = ("viet bao cao doanh so", "prepare releases plan", "review contracts with banks", "kiem tra lai dashboards", "weekly newsletters", "release planning prepared", "bao cao doanh thu va chi phi")


def jon10_fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of a customer paired by names that others write in their own way: the most pairs of the largest sum."""
    of = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("task_id"), F.lit("").alias("task_key"))
    named = lambda values, every: rows.where(F.col("task_id") % every != 0).withColumn("task_name", of(values, F.floor(F.col("task_id") / 3)))
    found = E.paired(named(JON_NAMES, 5), named(JON_SAID, 7))
    return found.groupBy("case_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"))


def agg07_weighted_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of meetings (rates with their counts) as weighted means, and counts by kind as one map's rows."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg((F.col("event_type") == "error").cast("double")).alias("error_rate"), F.avg("value").alias("mean_value"))
    weighted = lambda c: F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n"), 6).alias(c)
    return rows.agg(F.count("*").alias("meetings"), F.sum("n").alias("n"), weighted("error_rate"), weighted("mean_value"))


AGG07 = """WITH m AS (SELECT user_id, count(*) AS n, avg(CASE event_type WHEN 'error' THEN 1.0 ELSE 0.0 END) AS error_rate, avg(value) AS mean_value FROM events GROUP BY user_id)
SELECT count(*) AS meetings, CAST(sum(n) AS BIGINT) AS n, round(sum(error_rate * n) / sum(n), 6) AS error_rate, round(sum(mean_value * n) / sum(n), 6) AS mean_value FROM m"""

#: Prices of a million tokens in and out, by model (made up); a kind without price makes a total incomplete.
PRICES = (("click", 0.5, 1.5), ("purchase", 1.0, 4.0), ("signup", 0.25, 1.0), ("view", 0.1, 0.4))


def agg10_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, tokens and cost by user; complete if every call has a price. The price list is a literal of a few rows."""
    prices = F.map_from_entries(F.array(*(F.struct(F.lit(m), F.struct(F.lit(i).alias("i"), F.lit(o).alias("o"))) for m, i, o in PRICES)))
    rows = table(spark, sf_dir, "events").withColumn("price", F.try_element_at(prices, "event_type")).withColumn("tokens_in", F.col("event_id") % 5000).withColumn("tokens_out", F.col("event_id") % 700)
    cost = (F.col("tokens_in") * F.col("price.i") + F.col("tokens_out") * F.col("price.o")) / 1_000_000
    return rows.groupBy("user_id").agg(
        F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum(cost), 6).alias("cost"), F.bool_and(F.col("price").isNotNull()).alias("complete"),
    )


AGG10 = f"""WITH p(model, i, o) AS (VALUES {', '.join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in PRICES)})
SELECT user_id, count(*) AS calls, CAST(sum(event_id % 5000) AS BIGINT) AS tokens_in, CAST(sum(event_id % 700) AS BIGINT) AS tokens_out,
  round(sum((event_id % 5000 * i + event_id % 700 * o) / 1000000), 6) AS cost, bool_and(model IS NOT NULL) AS complete FROM events LEFT JOIN p ON model = event_type GROUP BY user_id"""


def agg11_ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ceilings by case family, with missing and unexpected tasks put down to stages by rule."""
    r = _results(spark, sf_dir).withColumn("family", F.col("case_id") % 8).groupBy("family").agg(*(F.sum(c).alias(c) for c in ("expected", "actual", "matched")))
    missing, extra = F.col("expected") - F.col("matched"), F.col("actual") - F.col("matched")
    share = lambda c, n: F.floor(c / n)
    stages = E.ceilings(F.col("expected"), F.col("actual"), F.col("matched"), {"candidate": share(missing, 2), "identity": share(missing, 4), "lifecycle": share(missing, 8)}, {"authority": share(extra, 2), "lifecycle": share(extra, 4)})
    return r.select("family", F.explode(stages).alias("x")).select("family", "x.*")


AGG11 = f"""WITH {RESULTS_SQL}, f AS (SELECT case_id % 8 AS family, CAST(sum(expected) AS BIGINT) AS e, CAST(sum(actual) AS BIGINT) AS a, CAST(sum(matched) AS BIGINT) AS m FROM cases GROUP BY family),
s AS (SELECT f.*, stage, CASE stage WHEN 'candidate' THEN (e - m) // 2 WHEN 'identity' THEN (e - m) // 4 WHEN 'lifecycle' THEN (e - m) // 8 WHEN 'full_oracle' THEN e - m ELSE 0 END AS recovered,
    CASE stage WHEN 'authority' THEN (a - m) // 2 WHEN 'lifecycle' THEN (a - m) // 4 WHEN 'full_oracle' THEN a - m ELSE 0 END AS removed FROM f, (SELECT unnest(['candidate', 'authority', 'identity', 'lifecycle', 'full_oracle']) AS stage))
SELECT family, stage, recovered, removed, round(2 * (m + recovered) / (e + a + recovered - removed), 6) AS f1 FROM s"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("event_id") * 7919 % 1000 / 1000
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), "event_id", p.alias("p"), ((F.col("event_type") == "purchase") | (F.col("event_id") % 10 < F.floor(p * 5))).cast("int").alias("y"))


def agg12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.ranking_metrics(_scored(spark, sf_dir), "case_id", "event_id", "p", "y")).withColumn("brier", F.round("brier", 4))


AGG12 = """WITH s AS (SELECT user_id AS case_id, event_id, event_id * 7919 % 1000 / 1000 AS p, CASE WHEN event_type = 'purchase' OR event_id % 10 < floor(event_id * 7919 % 1000 / 1000 * 5) THEN 1 ELSE 0 END AS y FROM events),
c AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY p), d AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM c),
auc AS (SELECT sum(CASE WHEN a.p > b.p THEN a.pos * b.neg WHEN a.p = b.p THEN a.pos * b.neg / 2 ELSE 0 END) / (SELECT sum(pos) * sum(neg) FROM c) AS roc_auc FROM c a, c b),
b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS conf, avg(y) AS share FROM s GROUP BY bin), k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY p DESC, event_id) AS place FROM s)
SELECT (SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 6) FROM d) AS average_precision, (SELECT round(roc_auc, 6) FROM auc) AS roc_auc, (SELECT round(avg((p - y) * (p - y)), 4) FROM s) AS brier,
  (SELECT round(sum(n * abs(conf - share)) / sum(n), 6) FROM b) AS calibration_error, (SELECT round(sum(y) FILTER (place <= 1) / sum(y), 6) FROM k) AS recall_at_1, (SELECT round(sum(y) FILTER (place <= 3) / sum(y), 6) FROM k) AS recall_at_3,
  (SELECT round(sum(y) FILTER (place <= 5) / sum(y), 6) FROM k) AS recall_at_5, (SELECT round(sum(y) FILTER (place <= 10) / sum(y), 6) FROM k) AS recall_at_10"""


def agg14_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of the gain in F1 when tasks added by mistake are left out, over resampled families of cases."""
    r = _results(spark, sf_dir).groupBy((F.col("case_id") % 40).alias("case_no")).agg(F.sum("expected").alias("expected"), F.sum("actual").alias("base_actual"), F.sum("matched").alias("base_matched"))
    r = r.withColumn("new_actual", F.col("base_matched")).withColumn("new_matched", F.col("base_matched"))
    place = F.row_number().over(W.orderBy("case_no")) - 1  # forty rows
    return _rounded(E.bootstrap(r.withColumn("case_no", place), samples=100))


AGG14 = f"""WITH {RESULTS_SQL}, g AS (SELECT case_id % 40 AS g, sum(expected) AS e, sum(actual) AS a, sum(matched) AS m FROM cases GROUP BY g), c AS (SELECT row_number() OVER (ORDER BY g) - 1 AS case_no, e, a, m FROM g),
n AS (SELECT count(*) AS n FROM c), d AS (SELECT sample, ('0x' || substr(md5('1729|' || sample || '|' || draw), 1, 12))::BIGINT % n AS case_no FROM (SELECT unnest(range(0, 100)) AS sample), n, LATERAL (SELECT unnest(range(0, n)) AS draw)),
s AS (SELECT sample, sum(e) AS e, sum(a) AS a, sum(m) AS m FROM d JOIN c USING (case_no) GROUP BY sample), x AS (SELECT list_sort(list(2 * m / (e + m) - 2 * m / (e + a))) AS d FROM s)
SELECT round(d[3], 6) AS low, round(d[97], 6) AS high FROM x"""


def agg17_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files (events, with their value as size) older than a cutoff, by kind: counts and bytes; nothing is deleted."""
    rows = table(spark, sf_dir, "events").withColumn("size", F.floor(F.abs("value") * 1000))
    old = rows.where(F.to_date("ts") < F.lit("2024-01-15").cast("date"))
    return old.groupBy("event_type").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.min("event_id").alias("first"))


AGG17 = "SELECT event_type, count(*) AS files, CAST(sum(CAST(floor(abs(value) * 1000) AS BIGINT)) AS BIGINT) AS bytes, min(event_id) AS first FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-15' GROUP BY event_type"


def jon11_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For tasks named after a shape of sentence, the three clauses of the meeting that share most words."""
    rows = said(spark, sf_dir)
    names = F.array(*map(F.lit, ("Gửi báo cáo doanh thu", "Kiểm tra dashboard", "Thiết kế wireframe")))
    tasks = rows.select("meeting_id").distinct().select("meeting_id", F.posexplode(names).alias("task_id", "task_name"))
    return E.suggested_sources(tasks, rows)


_tokens = lambda c: f"list_distinct(list_filter({words_sql(match_sql(c))}, lambda w: length(w) > 1 AND w NOT IN ({', '.join(map(sql_text, E.SOURCE_STOPWORDS))})))"
JON11 = f"""WITH {SAID_SQL}, t AS (SELECT meeting_id, CAST(i AS INTEGER) AS task_id, {_tokens("['Gửi báo cáo doanh thu', 'Kiểm tra dashboard', 'Thiết kế wireframe'][i + 1]")} AS x FROM (SELECT DISTINCT meeting_id FROM said), (SELECT unnest(range(0, 3)) AS i)),
c AS (SELECT meeting_id, clause_id, {_tokens('text_raw')} AS y FROM said),
s AS (SELECT meeting_id, task_id, clause_id, len(list_intersect(x, y)) / len(list_distinct(x || y)) AS score FROM t JOIN c USING (meeting_id)),
r AS (SELECT meeting_id, task_id, clause_id, round(score, 4) AS score FROM s WHERE score >= 0.12)
SELECT *, CAST(row_number() OVER (PARTITION BY meeting_id, task_id ORDER BY score DESC, clause_id) AS INTEGER) AS place FROM r QUALIFY row_number() OVER (PARTITION BY meeting_id, task_id ORDER BY score DESC, clause_id) <= 3"""


def qa02_grounded_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of the second word of each clause: every fifth is shifted, some are out of range, of unknown clauses or owners,
    or without authority."""
    rows = said(spark, sf_dir)
    i = F.col("order_index")
    start = F.instr("text_raw", " ")
    word = F.element_at(F.split("text_raw", " "), F.least(F.size(F.split("text_raw", " ")), F.lit(2)))
    own = rows.where(start > 0).select(
        "meeting_id", i.alias("item"), F.when(i % 7 == 3, "CLAUSE-999999").otherwise(F.col("clause_id")).alias("clause_id"), (start + F.when(i % 5 == 0, 1).otherwise(0)).alias("start"),
        (start + F.length(word) + F.when(i % 11 == 0, 1000).otherwise(0)).alias("end"), word.alias("text"), F.when(i % 13 == 0, "").otherwise("COMMITMENT").alias("authority"),
        F.when(i % 3 == 0, F.when(i % 2 == 0, "CLAUSE-000001").otherwise("CLAUSE-888888")).alias("owner_clause_id"),
    )
    return E.evidence_errors(own, rows).select("meeting_id", "item", F.array_join("errors", ",").alias("errors"))


QA02 = f"""WITH {SAID_SQL}, e AS (SELECT meeting_id, order_index AS item, CASE WHEN order_index % 7 = 3 THEN 'CLAUSE-999999' ELSE clause_id END AS clause_id, instr(text_raw, ' ') + CASE WHEN order_index % 5 = 0 THEN 1 ELSE 0 END AS a,
    split_part(text_raw, ' ', 2) AS word, instr(text_raw, ' ') + length(split_part(text_raw, ' ', 2)) + CASE WHEN order_index % 11 = 0 THEN 1000 ELSE 0 END AS b, order_index % 13 = 0 AS bare,
    CASE WHEN order_index % 3 = 0 THEN CASE WHEN order_index % 2 = 0 THEN 'CLAUSE-000001' ELSE 'CLAUSE-888888' END END AS owner FROM said WHERE contains(text_raw, ' '))
SELECT e.meeting_id, item, array_to_string(list_filter([CASE WHEN s.clause_id IS NULL THEN 'NOT_GROUNDED' WHEN NOT (b > a AND b <= length(s.text_raw) AND substr(s.text_raw, a + 1, b - a) = word) THEN 'SPAN_DIFFERS' END,
  CASE WHEN bare OR s.clause_id IS NULL THEN 'AUTHORITY_INVALID' END, CASE WHEN owner IS NOT NULL AND o.clause_id IS NULL THEN 'OWNER_INVALID' END], lambda x: x IS NOT NULL), ',') AS errors
FROM e LEFT JOIN said s ON s.meeting_id = e.meeting_id AND s.clause_id = e.clause_id LEFT JOIN said o ON o.meeting_id = e.meeting_id AND o.clause_id = owner"""


def qa01_split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a manifest of their digests: unchanged, changed, missing from it or from the corpus."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    manifest = docs.where("doc_id % 10 <> 0").select(F.when(F.col("doc_id") % 17 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"), F.when(F.col("doc_id") % 13 == 0, "stale").otherwise(F.col("digest")).alias("listed"))
    both = docs.join(manifest, "doc_id", "full")
    state = F.when(F.col("listed").isNull(), "NOT_LISTED").when(F.col("digest").isNull(), "NOT_FOUND").when(F.col("digest") != F.col("listed"), "CHANGED").otherwise("SAME")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


QA01 = """WITH d AS (SELECT doc_id, sha256(text) AS digest FROM documents), m AS (SELECT CASE WHEN doc_id % 17 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 13 = 0 THEN 'stale' ELSE digest END AS listed FROM d WHERE doc_id % 10 <> 0)
SELECT CASE WHEN listed IS NULL THEN 'NOT_LISTED' WHEN digest IS NULL THEN 'NOT_FOUND' WHEN digest <> listed THEN 'CHANGED' ELSE 'SAME' END AS state, count(*) AS n FROM d FULL JOIN m USING (doc_id) GROUP BY state"""

#: Gates in the order in which a run is refused: name, decision and least value.
GATES = (("integrity", "INVALID_RUN", 0.95), ("span_recall", "SPAN_GATE_FAILED", 0.4), ("recall_at_30", "CANDIDATE_GATE_FAILED", 0.5), ("f1", "RANKER_GATE_FAILED", 0.6), ("safety", "SAFETY_GATE_FAILED", 0.3))


def qa04_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision over each run (an order, its measures made of its key): the first gate that it doesn't hold."""
    k = F.col("o_orderkey")
    value = lambda i: F.pmod(k * (7 + 2 * i), F.lit(100)) / 100
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *((F.lit(1.0) if i == 0 else F.greatest(value(i), F.lit(0.2))).alias(n) for i, (n, _, _) in enumerate(GATES)))
    decision = F.lit("PROMISING")
    for name, failed, least in reversed(GATES):
        decision = F.when(F.col(name) < least, failed).otherwise(decision)
    return rows.groupBy(decision.alias("decision")).agg(F.count("*").alias("n"))


QA04 = f"""WITH r AS (SELECT {', '.join('1.0 AS integrity' if i == 0 else f'greatest(o_orderkey * {7 + 2 * i} % 100 / 100, 0.2) AS {n}' for i, (n, _, _) in enumerate(GATES))} FROM orders)
SELECT CASE {' '.join(f"WHEN {n} < {v} THEN '{d}'" for n, d, v in GATES)} ELSE 'PROMISING' END AS decision, count(*) AS n FROM r GROUP BY decision"""

QUERIES = {
    "agg05_case_results": (agg05_case_results, AGG05), "agg05_totals": (agg05_totals, AGG05T), "agg15_families": (agg15_families, AGG15), "agg15_stability": (agg15_stability, AGG15S), "jon10_pairing": (jon10_pairing, JON10), "jon10_fuzzy_pairs": (jon10_fuzzy_pairs, None),
    "agg07_weighted_rates": (agg07_weighted_rates, AGG07), "agg10_usage": (agg10_usage, AGG10), "agg11_ceilings": (agg11_ceilings, AGG11), "agg12_ranking": (agg12_ranking, AGG12), "agg14_bootstrap": (agg14_bootstrap, AGG14),
    "agg17_retention": (agg17_retention, AGG17), "jon11_sources": (jon11_sources, JON11), "qa02_grounded_spans": (qa02_grounded_spans, QA02), "qa01_split_manifest": (qa01_split_manifest, QA01), "qa04_gates": (qa04_gates, QA04),
}
