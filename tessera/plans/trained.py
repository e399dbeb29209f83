"""Queries over training: hashed features, the span scorer with its threshold, temperatures, classifier folds and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import words_of
from tessera.operators import training as T
from tessera.plans.rendered import table
from tessera.plans.said import said

VARIANTS, ROLES = ("FULL_BOUNDARY", "PREFIX_2", "PREFIX_3", "PREFIX_5"), ("OWNER", "ACTION", "DEADLINE")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span per clause with its features, a label that depends on some of them, and its part (train, calibration, test by meeting)."""
    rows = said(spark, sf_dir).withColumn("h", F.pmod(F.xxhash64("meeting_id", "clause_id"), F.lit(1000)))
    h, of = F.col("h"), lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)
    variant, score = of(VARIANTS, h), (h % 37) / 37.0
    roles = F.slice(F.array(*map(F.lit, ROLES)), F.lit(1), (h % 3 + 1).cast("int"))
    features = T.span_features(F.col("text_raw"), variant, score, (h % 11) / 11.0, roles, F.when(h % 2 == 0, F.array(F.lit("COMMITMENT"))).otherwise(F.array().cast("array<string>")))
    right = ((variant == "FULL_BOUNDARY") & (score > 0.3)).cast("int")
    part = F.when(F.col("meeting_id") % 5 < 3, "train").when(F.col("meeting_id") % 5 == 3, "calibration").otherwise("test")
    return rows.select("meeting_id", "clause_id", features.alias("features"), F.when(h % 13 == 0, 1 - right).otherwise(right).alias("label"), part.alias("part"))


def ml06_hashed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of the n-grams of each conversation turn."""
    rows = table(spark, sf_dir, "conversations")
    slots = T.hashed_ngrams(words_of(F.lower("text")), 1 << 16)
    return rows.select("conv_id", "turn", slots.alias("slots")).select("conv_id", "turn", F.size("slots").alias("n"), F.array_join(F.transform("slots", lambda x: x.cast("string")), ",").alias("slots"))


def ml07_span_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorer's metrics on each part, at the threshold that is best on calibration rows."""
    rows = spans(spark, sf_dir)
    scorer = T.fit_scorer(rows.where("part = 'train'"), epochs=60)
    scored = rows.withColumn("score", scorer.score(F.col("features")))
    threshold = T.best_threshold(scored.where("part = 'calibration'"), "score", "label")
    return T.precision_recall(scored, "score", "label", [threshold], by=["part"])


def ml08_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of events as logits of a label that they overstate: the temperature, and the mean probability after it."""
    noise = F.pmod(F.xxhash64("event_id"), F.lit(1000)) / 1000.0
    rows = table(spark, sf_dir, "events").where("value is not null").select(((F.col("value") % 10 - 5) * 2).alias("z"), F.lit(0).alias("x"), noise.alias("noise"))
    rows = rows.withColumn("y", (1 / (1 + F.exp(-F.col("z") / 4)) > F.col("noise")).cast("double"))
    t = T.temperature(rows, "z", "y")
    return rows.agg(F.count("*").alias("n"), F.round(F.lit(t), 3).alias("temperature"), F.round(F.avg(1 / (1 + F.exp(-F.col("z") / t))), 4).alias("mean_probability"))


def ml03_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each class out of fold, over all vectors with four classes; groups never stand on both sides."""
    rows = table(spark, sf_dir, "embeddings").where("label is not null and embedding is not null")
    shifted = F.transform("embedding", lambda x, i: x.cast("double") + F.when(i == F.col("label") % 4, 0.3).otherwise(0.0))
    ready = rows.select((F.col("vec_id") % 23).alias("group"), (F.col("label") % 4).cast("int").alias("label"), shifted.alias("features"))
    return T.class_metrics(T.out_of_fold(ready, "group"))


def ml05_dealt_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of documents' sources and languages, from the largest group to the smallest."""
    return T.group_folds(table(spark, sf_dir, "documents").withColumn("g", F.concat_ws("|", "source", "lang")), "g")


ML05D = """WITH g AS (SELECT concat_ws('|', source, lang) AS grp, count(*) AS n FROM documents GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY n DESC, sha256(grp)) - 1 AS place FROM g)
SELECT grp AS "group", n, CAST(CASE WHEN place % 10 < 5 THEN place % 10 ELSE 9 - place % 10 END AS INTEGER) AS fold FROM p"""

QUERIES = {
    "ml06_hashed_features": (ml06_hashed_features, None), "ml07_span_scorer": (ml07_span_scorer, None), "ml08_temperature": (ml08_temperature, None), "ml03_classifier": (ml03_classifier, None),
    "ml05_dealt_folds": (ml05_dealt_folds, ML05D),
}
