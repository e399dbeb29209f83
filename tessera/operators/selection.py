"""Which windows, clauses and proposals are looked at: merged windows, batches, bounded contexts, pools and policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What makes a negative example hard, the hardest first.
HARDNESS = (
    ("SIBLING_AMBIGUITY", 1), ("SUGGESTION_ONLY", 2), ("QUESTION_UNACCEPTED", 3), ("PAST_COMPLETED", 4), ("PROGRESS_ONLY", 4), ("RECAP_DUPLICATE", 5), ("MUTATION_ONLY", 6), ("REFERENCE_ONLY", 6),
    ("OWNER_FRAGMENT", 7), ("DEADLINE_FRAGMENT", 7), ("LEXICAL_NEAR", 9),
)
#: The weight of a clause's class in a bounded context.
CLASS_SCORE = {"MANDATORY": 100, "LIKELY": 60, "CONTEXT": 10, "NOISE": -100}

_WINDOW = "array<struct<first:int,last:int,n:int,primary:array<int>,context:array<int>,score:int,strategy:string,members:int>>"


def _folded(windows: DataFrame, joins, strategy: bool) -> DataFrame:
    """Windows of a meeting (order_index of the clause, context: order indexes, score, strategy) in order, each put to the one
    before where `joins(previous, window, union)` says so. What a window is compared with has itself grown: a fold."""
    one = F.struct(
        F.element_at("context", 1).cast("int").alias("first"), F.element_at("context", -1).cast("int").alias("last"), F.size("context").alias("n"), F.array(F.col("order_index").cast("int")).alias("primary"),
        F.transform("context", lambda x: x.cast("int")).alias("context"), F.col("score").cast("int").alias("score"), F.col("strategy").alias("strategy"), F.lit(1).alias("members"),
    )
    rows = windows.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("order_index", one.alias("w")))).alias("ws"))

    def step(kept: Column, x: Column) -> Column:
        last, w = F.element_at(kept, -1), x["w"]
        union = F.array_union(last["context"], w["context"])
        both = F.struct(
            last["first"].alias("first"), F.element_at(union, -1).alias("last"), F.size(union).alias("n"), F.array_union(last["primary"], w["primary"]).alias("primary"), union.alias("context"),
            F.greatest(last["score"], w["score"]).alias("score"), (F.when((last["strategy"] == "AI") | (w["strategy"] == "AI"), "AI").otherwise(last["strategy"]) if strategy else last["strategy"]).alias("strategy"),
            (last["members"] + 1).alias("members"),
        )
        grown = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(both)).cast(_WINDOW)
        added = F.concat(kept, F.array(w)).cast(_WINDOW)
        return F.when(F.size(kept) == 0, added).when(joins(last, w, union), grown).otherwise(added)

    out = rows.select("meeting_id", F.posexplode(F.aggregate("ws", F.array().cast(_WINDOW), step)).alias("place", "w"))
    return out.select("meeting_id", F.col("place") + 1, "w.*").toDF("meeting_id", "number", "first", "last", "n", "primary", "context", "score", "strategy", "members")


def merged_windows(windows: DataFrame, most: int = 80, gap: int = 3) -> DataFrame:
    """Windows that share 0.6 of the smaller one, or both for AI, near each other and not too long together, as one."""

    def joins(last: Column, w: Column, union: Column) -> Column:
        shared = last["n"] + w["n"] - F.size(union)
        near = (last["strategy"] == "AI") & (w["strategy"] == "AI") & (F.size(union) <= most) & (w["first"] - last["last"] <= gap)
        return (shared / F.least(last["n"], w["n"]) >= 0.60) | near

    return _folded(windows, joins, strategy=True)


def batches(windows: DataFrame, most: int = 48, gap: int = 3) -> DataFrame:
    """AI windows in order, as long as they stay near each other and within `most` clauses; a longer window is one by itself."""
    return _folded(windows.where("strategy = 'AI'"), lambda last, w, union: (F.size(union) <= most) & (w["first"] - last["last"] <= gap), strategy=False)


def compacted(context: DataFrame, most: int = 56, radius: int = 2) -> DataFrame:
    """Of each window's clauses (meeting_id, window_id, order_index, focus, relevance, on_topic, grounded) all of the focus and all
    mandatory ones, then the best by class, nearness, topic and grounding, `most` in all (more, if those to be kept are more)."""
    of_window = W.partitionBy("meeting_id", "window_id")
    needed = F.col("focus") | (F.col("relevance") == "MANDATORY")
    rows = context.withColumn("needed", needed).withColumn("focuses", F.collect_list(F.when(F.col("focus"), F.col("order_index"))).over(of_window)).withColumn("n_needed", F.sum(F.col("needed").cast("int")).over(of_window))
    distance = F.coalesce(F.array_min(F.transform("focuses", lambda x: F.abs(x - F.col("order_index")))), F.lit(999))
    weights = F.create_map(*(F.lit(x) for pair in CLASS_SCORE.items() for x in pair))
    priority = (
        F.coalesce(weights[F.col("relevance")], F.lit(0)) + F.when(distance <= radius, 35).otherwise(F.greatest(F.lit(0), 20 - distance * 2)) + F.when(F.col("on_topic"), 25).otherwise(0)
        + F.when(F.col("grounded"), 20).otherwise(0)
    )
    place = F.row_number().over(W.partitionBy("meeting_id", "window_id", "needed").orderBy(F.col("priority").desc(), "order_index"))
    rows = rows.withColumn("priority", priority).withColumn("place", place)
    return rows.where(F.col("needed") | (F.col("place") <= most - F.col("n_needed"))).select("meeting_id", "window_id", "order_index", "priority")


def bounded_context(rows: DataFrame, before: int = 3, after: int = 5, most: int = 12_000) -> DataFrame:
    """Around each clause the clauses from `before` earlier to `after` later ones, the nearest first until `most` characters are
    there (of equally near ones the earlier), in order; where the focus begins in their text."""
    near = W.partitionBy("meeting_id").orderBy("order_index").rowsBetween(-before, after)
    around = rows.withColumn("around", F.collect_list(F.struct("order_index", F.length("text_raw").alias("size"))).over(near))
    by_distance = F.array_sort(F.transform("around", lambda x: F.struct(F.abs(x["order_index"] - F.col("order_index")).alias("d"), x["order_index"].alias("i"), x["size"].alias("size"))))
    step = lambda s, x: F.when(s["open"] & (s["total"] + x["size"] <= most), F.struct((s["total"] + x["size"]).alias("total"), F.lit(True).alias("open"), F.concat(s["kept"], F.array(F.struct(x["i"].alias("i"), x["size"].alias("size")))).alias("kept"))).otherwise(F.struct(s["total"].alias("total"), F.lit(False).alias("open"), s["kept"].alias("kept")))
    none = F.struct(F.lit(0).alias("total"), F.lit(True).alias("open"), F.array().cast("array<struct<i:bigint,size:int>>").alias("kept"))
    kept = F.array_sort(F.aggregate(F.transform(by_distance, lambda x: F.struct(x["i"].cast("bigint").alias("i"), x["size"].alias("size"))), none, step)["kept"])
    out = around.withColumn("kept", kept)
    offset = F.aggregate(F.filter("kept", lambda x: x["i"] < F.col("order_index")), F.lit(0), lambda s, x: s + x["size"] + 1)
    return out.select("meeting_id", "clause_id", "order_index", F.transform("kept", lambda x: x["i"]).alias("context"), offset.alias("focus_start"))


def ranks(rows: DataFrame, case: str, ident: str, confidence: str) -> DataFrame:
    """rows with source_rank (by id) and confidence_rank (by confidence, then id)."""
    own = W.partitionBy(case)
    return rows.withColumn("source_rank", F.row_number().over(own.orderBy(ident))).withColumn("confidence_rank", F.row_number().over(own.orderBy(F.col(confidence).desc(), ident)))


def pool(proposals: DataFrame, most: int = 60) -> DataFrame:
    """The first `most` proposals of each case by source, support, scores and place."""
    source = F.when(F.col("source") == "BOTH", 0).when(F.col("source") == "NEURAL", 1).otherwise(2)
    order = W.partitionBy("case_id").orderBy(source, ~F.col("supported"), F.col("neural").desc(), F.col("rule").desc(), "order_index", "start", "end", "proposal_id")
    return proposals.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def hard_negatives(proposals: DataFrame, most: int = 8) -> DataFrame:
    """The hardest proposals of each case besides the right one (`positive`): reasons (array), kind, ambiguous, has_text, owned, dated."""
    why = lambda x: F.array_contains("reasons", x)
    reason = (
        F.when(F.col("ambiguous"), "SIBLING_AMBIGUITY").when(why("SUGGESTION"), "SUGGESTION_ONLY").when(why("QUESTION"), "QUESTION_UNACCEPTED").when(why("PAST_COMPLETED"), "PAST_COMPLETED")
        .when(why("PROGRESS_ONLY"), "PROGRESS_ONLY").when(why("RECAP_ITEM"), "RECAP_DUPLICATE").when(F.col("kind") == "UPDATE", "MUTATION_ONLY").when(F.col("kind") == "REFERENCE", "REFERENCE_ONLY")
        .when(~F.col("has_text") & F.col("owned"), "OWNER_FRAGMENT").when(~F.col("has_text") & F.col("dated"), "DEADLINE_FRAGMENT").otherwise("LEXICAL_NEAR")
    )
    hardness = F.create_map(*(F.lit(x) for pair in HARDNESS for x in pair))
    rows = proposals.where(~F.col("positive")).withColumn("reason", reason)
    place = F.row_number().over(W.partitionBy("case_id").orderBy(hardness[F.col("reason")], "order_index", "proposal_id"))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def policy_grid(rows: DataFrame, thresholds: tuple[float, ...], budgets: tuple[int, ...], floor: float = 0.48) -> DataFrame:
    """Precision, recall and F1 of each threshold and budget of best proposals a case, and which one is best: of those that hold
    the floor the one of the highest F1, recall, threshold and the smallest budget; else by precision. rows: case_id, item, p, y.

    A row counts for every pair that it passes, so one pass over the rows suffices: they are counted by place first."""
    place = F.row_number().over(W.partitionBy("case_id").orderBy(F.col("p").desc(), "item"))
    counted = rows.withColumn("place", F.least(place, F.lit(max(budgets) + 1))).groupBy("place", "p").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    grid = F.array(*(F.struct(F.lit(t).alias("threshold"), F.lit(b).alias("budget")) for t in thresholds for b in budgets))
    each = counted.withColumn("g", F.explode(grid)).withColumn("in", (F.col("place") <= F.col("g.budget")) & (F.col("p") >= F.col("g.threshold")))
    sums = each.groupBy("g.threshold", "g.budget").agg(F.sum(F.when(F.col("in"), F.col("n")).otherwise(0)).alias("actual"), F.sum(F.when(F.col("in"), F.col("hits")).otherwise(0)).alias("matched"), F.sum("hits").alias("expected"))
    precision = F.when(F.col("actual") == 0, 0.0).otherwise(F.col("matched") / F.col("actual"))
    recall = F.when(F.col("expected") == 0, 0.0).otherwise(F.col("matched") / F.col("expected"))
    out = sums.withColumn("precision", precision).withColumn("recall", recall)
    out = out.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))
    holds = F.col("precision") >= floor
    order = W.orderBy(holds.desc(), F.when(holds, F.col("f1")).otherwise(F.col("precision")).desc(), F.col("recall").desc(), F.col("threshold").desc(), "budget")  # a row per pair
    return out.withColumn("best", F.row_number().over(order) == 1)
