"""The queries of this folder: one for each operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, clusters, decontamination, jaccard, licences, mixing, negatives, neighbours, pii, quality, substrings, suffixes, toxicity
from tessera.llm.blocks import table
from tessera.llm.oracles import OP6_SQL, OP11_SQL, OP13_SQL, op12_sql

Query = Callable[[SparkSession, str], DataFrame]

BPE_FILE = "byte_bpe_50k.tiktoken"


def fold(parts: int) -> F.Column:
    """crc32 of doc_id as text, modulo parts."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    voters = quality.fit(docs, table(spark, sf_dir, "labels").where(fold(5) != 0))
    scored = quality.score(docs, voters)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    texts, toxic = toxicity.labelled(
        docs, table(spark, sf_dir, "labels").where(fold(3) != 1), "toxic", {1: toxicity.MOST_TOXIC, 0: toxicity.MOST_CLEAN}
    )
    scored = toxicity.score(docs, toxicity.fit(texts, toxic))
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    count = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *count, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"), n=3, percent=90)


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.notices(docs, licences.fit(licences.sample(docs)))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    return negatives.mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.described(spark, clusters.clustered(table(spark, sf_dir, "embeddings")))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (
        op1_quality, op2_decontamination, op3_toxicity, op4_pii, op5_bpe, op6_neighbours, op7_jaccard, op8_suffixes, op9_substrings, op10_licences,
        op11_negatives, op12_clusters, op13_mixing,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_neighbours": OP6_SQL, "op11_negatives": OP11_SQL, "op12_clusters": op12_sql(), "op13_mixing": OP13_SQL}

