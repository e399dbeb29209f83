"""Best rows of a group, with margins, budgets and grids; and metrics over ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_with_margin(scored: DataFrame, key: str, item: str, least: float, margin: float) -> DataFrame:
    """The best item of each key, and whether it is good enough and far enough from the second (none counts as 0)."""
    order = W.partitionBy(key).orderBy(F.col("score").desc(), F.col(item))
    ranked = scored.withColumn("place", F.row_number().over(order)).withColumn("second", F.coalesce(F.lead("score").over(order), F.lit(0.0)))
    best = ranked.where("place = 1").withColumn("margin", F.col("score") - F.col("second"))
    return best.withColumn("status", F.when((F.col("score") >= least) & (F.col("margin") >= margin), "DIRECT").otherwise("UNRESOLVED")).drop("place")


def top_k(scored: DataFrame, key: str, item: str, k: int, least: float) -> DataFrame:
    order = W.partitionBy(key).orderBy(F.col("score").desc(), F.col(item))
    return scored.where(F.col("score") >= least).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def ratio(part: Column, whole: Column, empty: float) -> Column:
    """part / whole, or `empty` if there is nothing to divide by."""
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def precision_recall(matched: Column, expected: Column, actual: Column) -> dict[str, Column]:
    """With the conventions of empty sides: nothing expected and nothing found is right."""
    both = (expected == 0) & (actual == 0)
    precision = F.when(both, 1.0).otherwise(ratio(matched, actual, 0.0))
    recall = F.when(both, 1.0).otherwise(ratio(matched, expected, 0.0))
    f1 = F.when(both, 1.0).otherwise(ratio(2 * matched, expected + actual, 0.0))
    return {"precision": precision, "recall": recall, "f1": f1}


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Rows, mean score and share of positives of each of `bins` equal bins; the last bin holds 1 too."""
    place = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("label").cast("double")).alias("positive"))


def quantile_by_place(values: Column, q: float) -> Column:
    """The value at place floor(q (n - 1)) of the sorted values."""
    return F.element_at(F.array_sort(values), (F.floor(q * (F.size(values) - 1)) + 1).cast("int"))
