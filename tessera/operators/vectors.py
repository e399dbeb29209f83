"""Vectors as arrays: centroids, hashed embeddings, linear scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def centroids(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """The mean vector of each key: parts are averaged apart, so a key of any size is summed in partial aggregates."""
    parts = rows.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return parts.groupBy(key).agg(F.transform(ordered, lambda p: p["x"]).alias("centroid"), F.max("n").alias("n"))


def hashed_terms(rows: DataFrame, key: list[str], words: Column, dimension: int = 384) -> DataFrame:
    """Signed feature hashing in sparse form: key, slot and value of unit length. The slot is the first eight bytes of a
    word's SHA-256 modulo dimension, the sign the lowest bit of the ninth."""
    digest = F.sha2("word", 256)
    first = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    sign = F.when(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)
    terms = rows.select(*key, F.explode(words).alias("word")).select(*key, (first % dimension).cast("int").alias("slot"), sign.alias("value"))
    summed = terms.groupBy(*key, "slot").agg(F.sum("value").alias("value")).where("value <> 0")
    norms = summed.groupBy(*key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return summed.join(norms, key).select(*key, "slot", (F.col("value") / F.col("norm")).alias("value"))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    return F.transform(logits, lambda x: F.exp(x - top) / F.aggregate(logits, F.lit(0.0), lambda s, y: s + F.exp(y - top)))


def linear(features: list[Column], weights: list[list[float]], bias: list[float]) -> Column:
    """Logits of each class, in the order of weights."""
    out = []
    for row, b in zip(weights, bias, strict=True):
        total = F.lit(float(b))
        for x, w in zip(features, row, strict=True):
            total = total + x * float(w)
        out.append(total)
    return F.array(*out)
