"""Mixing sources to target weights (operator 13), with DataFrame functions only.

Method: every document gets a hash-random key; documents are range-sorted by source and key, so that a source of any size
lies in as many pieces as it needs; the pieces' totals give each piece its offset within its source, and a window within the
piece the rest: distributed prefix sums of the words before each document. A source's budget of words, the floor of its
target, is cut there exactly: whole epochs first, then every document that ends within the rest of the budget, and of the
document that the cut goes through its first words up to the cut.

Targets: the sources, by code point and null last, weigh `weights` in turn and share `percent` % of all words. A source takes
`most` times its own words at most; what it leaves is shared by weight among the others, until none is above. That level is
found by the same prefix sums, over the sources in order of the level at which each is full; so neither the documents nor
the sources of any table have to fit one task. All of it is integer arithmetic, only `target` is a division.

Edge cases: null texts and texts without words have size 0 and take 0; a null source is a source of its own (an empty one
too); rows of one doc_id each count and are cut in order of their size; rows without doc_id get their key from their text;
ties of keys go by size, so reruns agree whatever the order of the rows; an empty table gives an empty table; a corpus without
words has targets 0; extra columns are ignored; very long texts are counted whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.blocks import forgotten, narrowed, written

#: A word, as a pattern.
WORD = r"[^\x20\x09-\x0D]+"

_EXACT = "decimal(38,0)"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, `place` (orders sources by code point, null last), `key` (random by hash) and `size` (words)."""
    place = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return narrowed(docs, "doc_id", "text", "source").select("doc_id", "source", place.alias("place"), key.alias("key"), size.alias("size"))


class Pieces(NamedTuple):
    """A range-sorted table: rows with their `piece`, and what each piece of a group holds (`own_*`) and has before it (`before_*`)."""

    rows: DataFrame
    totals: DataFrame
    keys: list[str]
    order: list[str]
    sums: dict[str, Column]


def pieces(df: DataFrame, order: Sequence[str], sums: dict[str, Column], group: Sequence[str] = ()) -> Pieces:
    """Sorts df by group and order into pieces and writes these; a group's pieces (a row for each) are added up to offsets."""
    rows = written(df.repartitionByRange(*group, *order).withColumn("piece", F.spark_partition_id()), "pieces")
    keys = ["piece", *group]
    own = rows.groupBy(*keys).agg(*[F.sum(c).cast(_EXACT).alias(f"own_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = {f"before_{n}": F.coalesce(F.sum(f"own_{n}").over(earlier), F.lit(0)) for n in sums}
    return Pieces(rows, own.withColumns(before), keys, list(order), sums)


def running(found: Pieces, totals: DataFrame | None = None) -> DataFrame:
    """The rows with, for each name of the sums, the sum over the rows before (of its group, in order). `totals` may carry
    more columns of the group. Rows are joined by piece and group: no task gets more of a group than one piece."""
    before = Window.partitionBy(*found.keys).orderBy(*found.order).rowsBetween(Window.unboundedPreceding, -1)
    local = found.rows.withColumns({n: F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in found.sums.items()})
    joined = local.join(found.totals if totals is None else totals, found.keys)
    names = [f"{kind}_{n}" for n in found.sums for kind in ("own", "before")]
    return joined.withColumns({n: (F.col(n) + F.col(f"before_{n}")).cast(_EXACT) for n in found.sums}).drop("piece", *names)


def targets(totals: DataFrame, weights: Sequence[int], percent: int, most: int) -> DataFrame:
    """place, source_size, `target` (double) and `budget` (its floor) of each source of (place, source_size)."""
    by_place = pieces(totals, ["place"], {"nth": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    ranked = running(by_place).select("place", "source_size", weight.alias("weight"), (F.col("source_size") * most).cast(_EXACT).alias("full"))
    whole = ranked.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    share, all_weights = int(whole["words"] or 0) * percent, int(whole["weight"] or 0)  # share is in hundredths of words
    level = F.col("full") * F.element_at(F.array(*[F.lit(math.lcm(*weights) // w) for w in range(1, max(weights) + 1)]), F.col("weight"))
    by_level = pieces(ranked.withColumn("level", level), ["level", "place"], {"below": F.col("full"), "weight_below": F.col("weight")})
    is_full = F.col("full") * 100 * (F.lit(all_weights) - F.col("weight_below")) <= F.col("weight") * (F.lit(share).cast(_EXACT) - F.col("below") * 100)
    ordered = running(by_level).withColumn("is_full", is_full)
    full = ordered.where("is_full").agg(F.sum("full").alias("full"), F.sum("weight").alias("weight")).first()
    rest, parts = share - 100 * int(full["full"] or 0), 100 * max(1, all_weights - int(full["weight"] or 0))
    part = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(parts))
    part_floor = F.expr(f"(weight * cast({rest} as decimal(27,0))) div cast({parts} as decimal(18,0))")
    found = written(ordered.select(
        "place", "source_size", F.when(F.col("is_full"), F.col("full").cast("double")).otherwise(part).alias("target"),
        F.when(F.col("is_full"), F.col("full").cast("long")).otherwise(part_floor).alias("budget"),
    ), "targets")
    forgotten(by_place.rows, by_level.rows)
    return found


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target (of the source), taken (words the mix takes, repeats counted) and epochs
    (how often the document starts) of each row."""
    found = pieces(sized(docs), ["key", "size"], {"before": F.col("size")}, group=["place"])
    totals = found.totals.groupBy("place").agg(F.sum("own_before").cast("long").alias("source_size"))
    rows = running(found, found.totals.join(targets(totals, weights, percent, most), "place"))
    rounds = F.expr("if(source_size > 0, budget div source_size, 0L)")
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - rounds * F.col("source_size") - F.col("before"))).cast("long")
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", (rounds * F.col("size") + last).alias("taken"), (rounds + (last > 0).cast("long")).alias("epochs")
    )
