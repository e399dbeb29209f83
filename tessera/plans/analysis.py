"""Queries over scored rows, sets, vectors and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import cues, ranking, vectors
from tessera.plans.meetings import _annotated
from tessera.plans.rendered import CLAUSES_SQL, FLAGGED_SQL, clauses, table


def agg03_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.keywords(F.col("text")), ",").alias("keywords"))


_KEYWORDS = (
    r"""
m AS (SELECT conv_id, turn, regexp_replace(strip_accents(replace(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')), 'đ', 'd')), '[^\p{L}\p{N}_\s:/.-]', '', 'g') AS t FROM conversations),
w AS (SELECT conv_id, turn, unnest(range(0, len(parts))) AS i, unnest(parts) AS word FROM (SELECT conv_id, turn, regexp_split_to_array(t, '[^\p{L}\p{N}_]+') AS parts FROM m)),
k AS (SELECT conv_id, turn, word, min(i) AS i FROM w WHERE length(word) >= 3 AND NOT regexp_matches(word, '^(\d+|dl|ddl|due|deadline|eta|han|thu|ngay|tuan|am|pm)$') AND word NOT IN ("""
    + ", ".join(f"'{x}'" for x in T.STOPWORDS)
    + """) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM k)"""
)

AGG03 = (
    "WITH"
    + _KEYWORDS
    + " SELECT c.conv_id, c.turn, coalesce(string_agg(word, ',' ORDER BY n) FILTER (n <= 8), '') AS keywords FROM conversations c LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn GROUP BY ALL"
)


def agg04_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords that a conversation repeats, the twelve most frequent."""
    words = table(spark, sf_dir, "conversations").select("conv_id", F.explode(T.keywords(F.col("text"))).alias("keyword"))
    counted = words.groupBy("conv_id", "keyword").agg(F.count("*").alias("n")).where("n >= 2")
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("n").desc(), "keyword"))
    return counted.withColumn("place", place).where("place <= 12").withColumn("confidence", F.round(F.least(F.lit(0.8), 0.35 + 0.08 * F.col("n")), 4))


AGG04 = (
    "WITH"
    + _KEYWORDS
    + """, c AS (SELECT conv_id, word AS keyword, count(*) AS n FROM r WHERE n <= 8 GROUP BY ALL HAVING count(*) >= 2)
SELECT conv_id, keyword, n, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, keyword) AS INTEGER) AS place, round(least(0.8, 0.35 + 0.08 * n), 4)::DOUBLE AS confidence
FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, keyword) <= 12"""
)

_SCORED_SQL = """
scored AS (SELECT d.doc_id, d.source, d.lang, least(1.0, d.n_chars / 4000.0)::DOUBLE AS score, l.quality AS label FROM documents d JOIN labels l USING (doc_id))"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of labelled documents (their length), with quality as the label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("score"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


def agg05_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = (F.col("score") >= 0.5).cast("int")
    sums = _scored(spark, sf_dir).groupBy("source").agg(F.sum(hit * F.col("label")).alias("matched"), F.sum("label").alias("expected"), F.sum(hit).alias("actual"))
    metrics = ranking.precision_recall(F.col("matched"), F.col("expected"), F.col("actual"))
    return sums.select("source", "matched", "expected", "actual", *(F.round(c, 6).alias(n) for n, c in metrics.items()))


AGG05 = (
    "WITH"
    + _SCORED_SQL
    + """, s AS (SELECT source, CAST(sum(CASE WHEN score >= 0.5 THEN label ELSE 0 END) AS BIGINT) AS matched, CAST(sum(label) AS BIGINT) AS expected, count(*) FILTER (score >= 0.5) AS actual FROM scored GROUP BY source)
SELECT *, round(CASE WHEN expected + actual = 0 THEN 1.0 WHEN actual = 0 THEN 0.0 ELSE matched::DOUBLE / actual END, 6) AS precision,
  round(CASE WHEN expected + actual = 0 THEN 1.0 WHEN expected = 0 THEN 0.0 ELSE matched::DOUBLE / expected END, 6) AS recall,
  round(CASE WHEN expected + actual = 0 THEN 1.0 ELSE 2.0 * matched / (expected + actual) END, 6) AS f1 FROM s"""
)


def agg08_counts_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("tessera_documents")
    return spark.sql("SELECT lang, source, count(*) AS n, sum(n_chars) AS n_chars FROM tessera_documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")


AGG08 = "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())"


def agg09_route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _annotated(spark, sf_dir).withColumn("strategy", cues.strategy())
    return rows.groupBy("meeting_id").pivot("strategy", ["RULE", "AI", "CONTEXT"]).count().na.fill(0)


AGG09 = (
    "WITH "
    + FLAGGED_SQL
    + """ SELECT meeting_id, count(*) FILTER (strategy = 'RULE') AS "RULE", count(*) FILTER (strategy = 'AI') AS "AI", count(*) FILTER (strategy = 'CONTEXT') AS "CONTEXT" FROM candidates GROUP BY meeting_id"""
)


def agg12_ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision and recall at 10 of each language's ranking."""
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), "doc_id")
    rows = _scored(spark, sf_dir).withColumn("place", F.row_number().over(order)).withColumn("found", F.sum("label").over(order))
    precision = F.when(F.col("label") == 1, F.col("found") / F.col("place"))
    return rows.groupBy("lang").agg(F.round(F.avg(precision), 6).alias("average_precision"), F.round(F.sum(F.when(F.col("place") <= 10, F.col("label"))) / F.sum("label"), 6).alias("recall_at_10"))


AGG12 = (
    "WITH"
    + _SCORED_SQL
    + """, r AS (SELECT *, row_number() OVER w AS place, sum(label) OVER w AS found FROM scored WINDOW w AS (PARTITION BY lang ORDER BY score DESC, doc_id))
SELECT lang, round(avg(CASE WHEN label = 1 THEN found::DOUBLE / place END), 6) AS average_precision, round((sum(label) FILTER (place <= 10))::DOUBLE / sum(label), 6) AS recall_at_10 FROM r GROUP BY lang"""
)


def agg13_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.calibration(_scored(spark, sf_dir))
    return rows.select("bin", "n", F.round("mean_score", 6).alias("mean_score"), F.round("positive", 6).alias("positive"))


AGG13 = (
    "WITH"
    + _SCORED_SQL
    + " SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label::DOUBLE), 6) AS positive FROM scored GROUP BY 1"
)


def agg16_policy_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean"), F.round(F.stddev_pop("o_totalprice"), 6).alias("deviation"), F.collect_list("o_totalprice").alias("v"))
    down = F.sort_array("v", asc=False)
    gap = F.when(F.col("n") > 1, F.element_at(down, 1) - F.element_at(down, 2)).otherwise(F.element_at(down, 1))
    return rows.select("o_custkey", "n", "mean", "deviation", ranking.quantile_by_place(F.col("v"), 0.5).alias("p50"), ranking.quantile_by_place(F.col("v"), 0.9).alias("p90"), F.round(gap, 4).alias("top_gap"))


AGG16 = """
WITH v AS (SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(stddev_pop(o_totalprice), 6) AS deviation, list_sort(list(o_totalprice)) AS s FROM orders GROUP BY o_custkey)
SELECT o_custkey, n, mean, deviation, s[CAST(floor(0.5 * (n - 1)) AS INTEGER) + 1] AS p50, s[CAST(floor(0.9 * (n - 1)) AS INTEGER) + 1] AS p90, round(CASE WHEN n > 1 THEN s[n] - s[n - 1] ELSE s[1] END, 4) AS top_gap FROM v
"""


def agg18_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return rows.select("label", "n", F.posexplode("centroid").alias("i", "x")).select("label", "n", "i", F.round("x", 6).alias("x"))


AGG18 = """
WITH p AS (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings)
SELECT label, count(*) AS n, CAST(i AS INTEGER) AS i, round(avg(x::DOUBLE), 6) AS x FROM p GROUP BY label, i
"""


#: Centroids of a block, about, blocks that are sent to every task, and parts that vectors are dealt in where there are more.
BLOCK, SENT_BLOCKS, DEALT = 1024, 4, 64


def ret06_nearest_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's nearest centroid, linked if it is near enough and far enough from the second. Vectors meet the centroids block
    by block: few blocks go to every task, more of them meet the vectors by (block, part), of which there are many."""
    rows = table(spark, sf_dir, "embeddings")
    topics = vectors.centroids(rows, "label", "embedding").select(F.col("label").alias("topic"), "centroid")
    blocks = max(1, -(-rows.select("label").distinct().count() // BLOCK))
    topics = topics.groupBy(F.pmod(F.xxhash64("topic"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("topic", "centroid")).alias("topics"))
    rows = rows.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(DEALT)).alias("part"))
    if blocks <= SENT_BLOCKS:
        met = rows.join(F.broadcast(topics), "block")
    else:
        met = rows.join(topics.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))), ["block", "part"])
    scored = met.select("vec_id", "embedding", F.explode("topics").alias("t")).select("vec_id", F.col("t.topic").alias("topic"), F.round(T.cosine(F.col("embedding"), F.col("t.centroid")), 6).alias("score"))
    return ranking.top_with_margin(scored, "vec_id", "topic", 0.3, 0.05).select("vec_id", "topic", "score", F.round("margin", 6).alias("margin"), "status")


RET06 = """
WITH p AS (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings),
m AS (SELECT label, i, avg(x::DOUBLE) AS x FROM p GROUP BY label, i), c AS (SELECT label AS topic, list(x ORDER BY i) AS v FROM m GROUP BY label),
s AS (SELECT vec_id, topic, round(greatest(0.0, least(1.0, list_cosine_similarity(embedding::DOUBLE[], v))), 6) AS score FROM embeddings, c),
r AS (SELECT *, row_number() OVER w AS place, score - coalesce(lead(score) OVER w, 0.0) AS margin FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, topic))
SELECT vec_id, topic, score, round(margin, 6) AS margin, CASE WHEN score >= 0.3 AND margin >= 0.05 THEN 'DIRECT' ELSE 'UNRESOLVED' END AS status FROM r WHERE place = 1
"""


def ret01_hashed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return vectors.hashed_terms(rows, ["conv_id", "turn"], F.expr("split(trim(regexp_replace(lower(text), '[^a-z]+', ' ')), ' ')")).select("conv_id", "turn", "slot", F.round("value", 6).alias("value"))


RET01 = r"""
WITH w AS (SELECT conv_id, turn, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ')) AS word FROM conversations),
h AS (SELECT conv_id, turn, CAST(('0x' || substr(sha256(word), 1, 16))::UBIGINT % 384 AS INTEGER) AS slot, CASE WHEN ('0x' || substr(sha256(word), 17, 2))::INTEGER % 2 = 1 THEN 1.0 ELSE -1.0 END AS value FROM w),
s AS (SELECT conv_id, turn, slot, sum(value)::DOUBLE AS value FROM h GROUP BY ALL HAVING sum(value) <> 0)
SELECT conv_id, turn, slot, round(value / sqrt(sum(value * value) OVER (PARTITION BY conv_id, turn)), 6) AS value FROM s
"""


def win07_top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("score"))
    return ranking.top_k(rows, "o_custkey", "o_orderkey", 3, 50_000.0)


WIN07 = """
SELECT o_custkey, o_orderkey, o_totalprice AS score, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders WHERE o_totalprice >= 50000
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3
"""


def win10_threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of each threshold, and the best of those whose precision holds the floor: one pass, no join."""
    grid = F.array(*(F.lit(x / 10) for x in range(1, 10)))
    rows = _scored(spark, sf_dir).select(F.explode(grid).alias("threshold"), "score", "label").withColumn("hit", (F.col("score") >= F.col("threshold")).cast("int"))
    sums = rows.groupBy("threshold").agg(F.sum(F.col("hit") * F.col("label")).alias("matched"), F.sum("label").alias("expected"), F.sum("hit").alias("actual"))
    m = ranking.precision_recall(F.col("matched"), F.col("expected"), F.col("actual"))
    scored = sums.select("threshold", F.round(m["precision"], 6).alias("precision"), F.round(m["f1"], 6).alias("f1"))
    # nine rows, one per threshold
    return scored.withColumn("best", F.row_number().over(W.partitionBy(F.lit(1)).orderBy((F.col("precision") < 0.48).cast("int"), F.col("f1").desc(), "threshold")) == 1)


WIN10 = (
    "WITH"
    + _SCORED_SQL
    + """, g AS (SELECT unnest(range(1, 10)) / 10.0 AS threshold), s AS (SELECT threshold::DOUBLE AS threshold, sum(label) FILTER (score >= threshold) AS matched, sum(label) AS expected, count(*) FILTER (score >= threshold) AS actual FROM scored, g GROUP BY threshold),
m AS (SELECT threshold, round(CASE WHEN actual = 0 THEN 0.0 ELSE matched::DOUBLE / actual END, 6) AS precision, round(2.0 * matched / (expected + actual), 6) AS f1 FROM s)
SELECT *, row_number() OVER (ORDER BY precision < 0.48, f1 DESC, threshold) = 1 AS best FROM m"""
)


def set02_note_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a conversation's first turn each later one repeats."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.keywords(F.col("text"), 100).alias("words"))
    first = rows.groupBy("conv_id").agg(F.min_by("words", "turn").alias("note"), F.min("turn").alias("first"))
    pairs = rows.join(first, "conv_id").where("turn > first")
    return pairs.select("conv_id", "turn", F.round(T.jaccard(F.col("note"), F.col("words")), 6).alias("jaccard"), F.round(T.containment(F.col("note"), F.col("words")), 6).alias("containment"))


SET02 = (
    "WITH"
    + _KEYWORDS
    + """, s AS (SELECT c.conv_id, c.turn, list_filter(list(r.word), lambda x: x IS NOT NULL) AS words FROM conversations c LEFT JOIN (SELECT * FROM r WHERE n <= 100) r ON r.conv_id = c.conv_id AND r.turn = c.turn GROUP BY ALL),
f AS (SELECT conv_id, arg_min(words, turn) AS note, min(turn) AS first FROM s GROUP BY conv_id)
SELECT s.conv_id, s.turn, round(CASE WHEN len(list_distinct(list_concat(note, words))) = 0 THEN 0.0 ELSE len(list_intersect(note, words))::DOUBLE / len(list_distinct(list_concat(note, words))) END, 6) AS jaccard,
  round(CASE WHEN least(len(note), len(words)) = 0 THEN 0.0 ELSE len(list_intersect(note, words))::DOUBLE / least(len(note), len(words)) END, 6) AS containment
FROM s JOIN f USING (conv_id) WHERE turn > first"""
)


def set03_multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "events").where("event_id % 2 = 0").select("user_id", "event_type")
    b = table(spark, sf_dir, "events").where("event_id % 2 = 1").select("user_id", "event_type")
    return a.exceptAll(b).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


SET03 = "SELECT user_id, event_type, count(*) AS n FROM (SELECT user_id, event_type FROM events WHERE event_id % 2 = 0 EXCEPT ALL SELECT user_id, event_type FROM events WHERE event_id % 2 = 1) GROUP BY ALL"


def set04_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return docs.exceptAll(labels).withColumn("side", F.lit("UNLABELLED")).unionByName(labels.subtract(docs).withColumn("side", F.lit("UNKNOWN"))).distinct()


SET04 = "SELECT doc_id, 'UNLABELLED' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'UNKNOWN' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)"


def set06_fold_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that stand in more than one fold."""
    rows = table(spark, sf_dir, "documents").select((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).alias("fold"), F.sha2("text", 256).alias("sha"))
    return rows.groupBy("sha").agg(F.count_distinct("fold").cast("long").alias("folds"), F.count("*").alias("n")).where("folds > 1")


def jon05_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = table(spark, sf_dir, "lineitem").where("l_discount >= 0.09").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(late, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


JON05 = "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.09) GROUP BY 1"


def jon06_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


JON06 = "SELECT source, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1"


def jon07_note_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's first turn as a note: the turn that it rests on, if one stands out."""
    pairs = set02_note_overlap(spark, sf_dir).select("conv_id", "turn", F.round(0.72 * F.col("containment") + 0.28 * F.col("jaccard"), 6).alias("score"))
    return ranking.top_with_margin(pairs, "conv_id", "turn", 0.2, 0.02).select("conv_id", "turn", "score", F.round("margin", 6).alias("margin"), "status")


JON07 = (
    "WITH g AS ("
    + SET02
    + """), s AS (SELECT conv_id, turn, round(0.72 * containment + 0.28 * jaccard, 6) AS score FROM g),
q AS (SELECT *, row_number() OVER w AS place, score - coalesce(lead(score) OVER w, 0.0) AS margin FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY score DESC, turn))
SELECT conv_id, turn, score, round(margin, 6) AS margin, CASE WHEN score >= 0.2 AND margin >= 0.02 THEN 'DIRECT' ELSE 'UNRESOLVED' END AS status FROM q WHERE place = 1"""
)


def jon14_union_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals of two sources in one: the better source's value, both sources' names."""
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_acctbal").alias("value"), F.lit("A").alias("origin"), F.lit(2).alias("rank"), F.col("c_custkey").alias("id"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_acctbal").alias("value"), F.lit("B").alias("origin"), F.lit(1).alias("rank"), F.col("s_suppkey").alias("id"))
    rows = a.unionByName(b).groupBy("key").agg(F.max_by("value", F.struct("rank", F.negative("id"))).alias("value"), F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("origins"), F.count("*").alias("n"))
    return rows


JON14 = """
WITH u AS (SELECT c_nationkey AS key, c_acctbal AS value, 'A' AS origin, 2 AS rank, c_custkey AS id FROM customer UNION ALL SELECT s_nationkey, s_acctbal, 'B', 1, s_suppkey FROM supplier)
SELECT key, first(value ORDER BY rank DESC, id) AS value, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins, count(*) AS n FROM u GROUP BY key
"""


def snk02_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only log of jobs as its latest state by key."""
    order = W.partitionBy("user_id", "event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return table(spark, sf_dir, "events").withColumn("n", F.row_number().over(order)).where("n = 1").select("user_id", "event_type", "event_id", "value")


SNK02 = "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"


def scl02_stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("|", F.lit("v1"), "source", "lang", F.sha2("text", 256))
    return table(spark, sf_dir, "documents").select("doc_id", T.sequence_id("DOC", F.col("doc_id")).alias("id"), T.hash_id("KEY-", key, 16).alias("idempotency_key"))


SCL02 = "SELECT doc_id, printf('DOC-%06d', doc_id) AS id, 'KEY-' || substr(sha256(concat_ws('|', 'v1', source, lang, sha256(text))), 1, 16) AS idempotency_key FROM documents"


def scl11_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A meeting's calls in order, until their number or their characters exceed the budget."""
    run = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n_chars"))
    rows = rows.withColumn("calls", F.count("*").over(run)).withColumn("spent", F.sum("n_chars").over(run))
    reason = F.when(F.col("calls") > 4, "MAX_CALLS").when(F.col("spent") > 3000, "MAX_CHARS").otherwise("ALLOWED")
    return rows.select("conv_id", "turn", "calls", "spent", reason.alias("decision"))


SCL11 = """
WITH r AS (SELECT conv_id, turn, count(*) OVER w AS calls, CAST(sum(length(text)) OVER w AS BIGINT) AS spent FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT *, CASE WHEN calls > 4 THEN 'MAX_CALLS' WHEN spent > 3000 THEN 'MAX_CHARS' ELSE 'ALLOWED' END AS decision FROM r
"""

#: Weights of the example model of ml02: four classes over three features.
ML_WEIGHTS, ML_BIAS = [[0.9, -0.4, 0.2], [0.1, 0.6, -0.3], [-0.5, 0.2, 0.4], [0.0, 0.0, 0.1]], [0.1, 0.0, -0.2, 0.3]


def ml02_linear_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause features, standardised logits and the probabilities of four classes."""
    has = lambda flag: F.array_contains("flags", flag).cast("double")
    rows = _annotated(spark, sf_dir)
    features = [has("FIRST_PERSON_COMMITMENT"), has("CANCELLATION"), F.col("score").cast("double")]
    p = vectors.softmax(vectors.linear(features, ML_WEIGHTS, ML_BIAS))
    return rows.select("meeting_id", "clause_id", p.alias("p")).select("meeting_id", "clause_id", *(F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(4)))


ML02 = (
    "WITH "
    + FLAGGED_SQL
    + """, f AS (SELECT meeting_id, clause_id, commitment::INTEGER AS a, list_contains(flags, 'CANCELLATION')::INTEGER AS b, score::DOUBLE AS c FROM candidates),
z AS (SELECT meeting_id, clause_id, """
    + ", ".join(f"exp({b} + a * {w[0]} + b * {w[1]} + c * {w[2]}) AS e{i}" for i, (w, b) in enumerate(zip(ML_WEIGHTS, ML_BIAS, strict=True)))
    + " FROM f) SELECT meeting_id, clause_id, "
    + ", ".join(f"round(e{i} / (e0 + e1 + e2 + e3), 6)::DOUBLE AS p{i}" for i in range(4))
    + " FROM z"
)


QUERIES = {
    "agg03_keywords": (agg03_keywords, AGG03), "agg04_overview": (agg04_overview, AGG04), "agg05_metrics": (agg05_metrics, AGG05), "agg08_counts_by_level": (agg08_counts_by_level, AGG08),
    "agg09_route_counts": (agg09_route_counts, AGG09), "agg12_ranking_metrics": (agg12_ranking_metrics, AGG12), "agg13_calibration": (agg13_calibration, AGG13), "agg16_policy_context": (agg16_policy_context, AGG16),
    "agg18_centroids": (agg18_centroids, AGG18), "ret01_hashed_terms": (ret01_hashed_terms, RET01), "ret06_nearest_topic": (ret06_nearest_topic, RET06), "win07_top_orders": (win07_top_orders, WIN07),
    "win10_threshold_grid": (win10_threshold_grid, WIN10), "set02_note_overlap": (set02_note_overlap, SET02), "set03_multiset_difference": (set03_multiset_difference, SET03), "set04_coverage": (set04_coverage, SET04),
    "set06_fold_leakage": (set06_fold_leakage, None), "jon05_semi": (jon05_semi, JON05), "jon06_anti": (jon06_anti, JON06), "jon07_note_grounding": (jon07_note_grounding, JON07), "jon14_union_by_priority": (jon14_union_by_priority, JON14),
    "snk02_latest_wins": (snk02_latest_wins, SNK02), "scl02_stable_ids": (scl02_stable_ids, SCL02), "scl11_budget": (scl11_budget, SCL11), "ml02_linear_classes": (ml02_linear_classes, ML02),
}
