"""From raw documents to token ids: quality, near duplicates, decontamination, personal data, tokens.

STAGES are functions (spark, docs, sf_dir) -> DataFrame. Each works on all that its predecessor kept, written as Parquet
and read again; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import bpe, decontamination, jaccard, pii, quality
from tessera.llm.blocks import table, written
from tessera.llm.queries import BPE_FILE, fold

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null and empty texts score as the sample's mean label, rows of
    equal text alike; every row of a doc_id, or without one, is judged by its own text; very long texts are scored whole."""
    voters = quality.fit(docs, table(spark, sf_dir, "labels").where(fold(5) != 0))
    return quality.kept(docs, voters, least=0.3)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similar texts connect (five words, 0.8), the one with the smallest doc_id. Of the rows of
    a doc_id one stays: that with the smallest hash of the text, by which the join judges it, and of equal ones with the
    smallest hash of all columns. Null and empty texts link with nothing and stay, as do rows without doc_id."""
    found = jaccard.linked(docs, n=5, percent=80)
    first = found.where("doc_id = component_id").select("doc_id")
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64(*docs.columns))
    kept = docs.join(first, "doc_id", "left_semi").withColumn("nth_of_id", F.row_number().over(one)).where("nth_of_id = 1")
    return kept.select(docs.columns).unionAll(docs.where("doc_id is null"))


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands, verbatim or paraphrased. All rows of a contaminated doc_id go; rows without
    doc_id are judged by their text; null and empty texts stay."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    found = decontamination.contaminated(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    seen = found.select(F.col("doc_id").alias("seen_id")).distinct()
    return docs.join(seen, key == F.col("seen_id"), "left_anti").select(docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their personal data replaced by its kind; null and empty texts, and all rows, stay."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's text, and whether they decode to it; null and empty texts have none."""
    return bpe.encode(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", unseen),
    ("PII", redacted),
    ("byte-level BPE", tokens),
]

#: SQL can't express the trained stages; `tests/llm` hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
