"""From captions to turns, sentences, clauses and blocks of clauses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType

from tessera.functions.ratio import bounded_ratio
from tessera.functions.text import hash_id, match_form, normalized, sequence_id

#: Phrases that begin a sentence of their own; verbs after a name that begin a clause.
MARKERS = (
    "khoan", "chốt lại", "sửa lại", "không phải", "đổi thành", "chuyển sang", "dời sang", "lùi sang", "tiếp theo", "còn phần",
    "về deadline", "riêng phần", "hold on", "to clarify", "correction", "change it to", "move it to",
)
NAMED_VERBS = (
    "sẽ", "phụ trách", "kiểm tra", "chuẩn bị", "gửi", "cập nhật", "will", "owns?", "checks?", "prepares?", "sends?", "updates?",
)

_BREAK = "\u0001"


#: Forms of address before a name, and web addresses.
ADDRESS = "(?iU)^(?:mr|ms|mrs|anh|chị|chi|em|bạn|ban|speaker)\\s+"
URL = "https?://\\S+"
_JOINER = "\u2060"


def display_name(name: Column) -> Column:
    flat = F.trim(F.regexp_replace(name, "(?U)\\s+", " "))
    bare = F.trim(F.regexp_replace(flat, ADDRESS, ""))
    return F.coalesce(F.nullif(bare, F.lit("")), F.nullif(flat, F.lit("")), F.lit("Unknown"))


def speaker_id(name: Column) -> Column:
    """A stable id of the speaker's name, without forms of address and marks on letters."""
    return hash_id("SPK-", F.coalesce(F.nullif(F.trim(match_form(display_name(name))), F.lit("")), F.lit("unknown")))


def turns(captions: DataFrame, max_gap_ms: int = 2000, max_characters: int = 1000) -> DataFrame:
    """Captions of one speaker with gaps of at most max_gap_ms (an unknown gap is none) as one turn, as long as its text has at
    most max_characters. The gaps are a window; the length is added up within what they leave together."""
    order = W.partitionBy("meeting_id").orderBy("order_index")
    ended = F.last("end_ms", ignorenulls=False).over(order.rowsBetween(-1, -1))
    gap = F.coalesce(F.col("start_ms") - ended, F.lit(0))
    marked = captions.withColumn("speaker_id", speaker_id(F.col("speaker_raw")))
    new = (F.lag("speaker_id").over(order).isNull() | (F.lag("speaker_id").over(order) != F.col("speaker_id")) | (gap > max_gap_ms)).cast("int")
    marked = marked.withColumn("new", new).withColumn("island", F.sum("new").over(order))
    said = F.array_sort(F.collect_list(F.struct("order_index", F.length("text_raw").alias("size"))))
    step = lambda s, x: F.when(s["size"] + x["size"] + 1 <= max_characters, F.struct((s["size"] + x["size"] + 1).alias("size"), F.array_append(s["nth"], F.element_at(s["nth"], -1)).alias("nth"))).otherwise(F.struct(x["size"].alias("size"), F.array_append(s["nth"], F.element_at(s["nth"], -1) + 1).alias("nth")))
    start = lambda xs: F.struct(F.get(xs, 0)["size"].alias("size"), F.array(F.lit(0)).alias("nth"))
    rows = marked.groupBy("meeting_id", "island").agg(said.alias("said"))
    rows = rows.withColumn("nth", F.aggregate(F.slice("said", F.lit(2), F.size("said")), start(F.col("said")), step)["nth"])
    dealt = rows.select("meeting_id", F.explode(F.arrays_zip(F.transform("said", lambda x: x["order_index"]).alias("i"), "nth")).alias("x"))
    dealt = dealt.select("meeting_id", F.col("x.i").alias("order_index"), F.col("x.nth").alias("nth"))
    marked = marked.join(dealt, ["meeting_id", "order_index"])
    changed = (F.col("new") == 1) | (F.coalesce(F.lag("nth").over(order), F.lit(-1)) != F.col("nth"))
    marked = marked.withColumn("turn_no", F.sum(changed.cast("int")).over(order))
    lines = F.array_sort(F.collect_list(F.struct("order_index", "text_raw", "caption_id")))
    return marked.groupBy("meeting_id", "turn_no", "speaker_id").agg(
        F.min_by(display_name(F.col("speaker_raw")), "order_index").alias("speaker_name"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.array_join(F.transform(lines, lambda x: x["text_raw"]), " ").alias("text_raw"), F.transform(lines, lambda x: x["caption_id"]).alias("source_caption_ids"),
    ).withColumn("turn_id", sequence_id("TURN", F.col("turn_no")))


def sentence_list(text: Column) -> Column:
    """Sentences of a text: after !, ? or ; and white space, after a point before a capital, at line breaks and markers. Web
    addresses are left whole: no marker is looked for in them, and what they end with ends no sentence."""
    markers = "|".join(MARKERS)
    between, urls = F.split(text, URL, -1), F.regexp_extract_all(text, F.lit(f"({URL})"), F.lit(1))
    marked = F.transform(between, lambda x, i: F.regexp_replace(F.concat(F.when(i > 0, _JOINER).otherwise(""), x), f"(?iU)(?<!^)\\b(?=(?:{markers})\\b)", "\n"))
    out = F.array_join(F.flatten(F.zip_with(marked, urls, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    out = F.regexp_replace(out, "(?<=[!?;])\\s+", "\n")
    out = F.regexp_replace(out, "(?<=\\.)\\s+(?=[A-ZÀ-Ỹ])", "\n")
    return F.filter(F.transform(F.split(out, "\n+"), lambda x: F.trim(F.replace(x, F.lit(_JOINER), F.lit("")))), lambda x: x != "")


def shortened(value: str, most: int = 60) -> list[str]:
    """A long sentence in parts of at most `most` words. A part ends before the last joint (a comma, or but, and and their like,
    between two words) in the second half of its first `most` words, or after all of them."""
    words, parts, at = value.split(), [], 0
    while len(words) - at > most:
        offset, joints, length = 0, [], len(" ".join(words[at : at + most]))
        for k in range(at, at + most - 1):
            offset += len(words[k]) + 1
            if words[k].endswith(",") and 2 * (offset - 2) >= length - 1:
                joints.append(k + 1)
            elif words[k + 1] in ("but", "nhưng", "and", "và") and k + 2 < at + most and 2 * (offset - 1) >= length - 1:
                joints.append(k + 1)
        to = joints[-1] if joints else at + most
        parts.append(" ".join(words[at:to]).strip(" ,"))
        at = to
    rest = " ".join(words[at:]).strip(" ,")
    return [*parts, rest] if rest else parts


def _shortened(text: Column) -> Column:
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for value in values:
            yield value.map(shortened)

    return F.pandas_udf(run, "array<string>", PandasUDFType.SCALAR_ITER)(text)


def clause_list(sentence: Column) -> Column:
    """Clauses of a sentence: before còn, trong khi or riêng, and before a conjunction, a name and a verb."""
    out = F.regexp_replace(sentence, "(?iU)\\b(?=(?:còn|trong khi|riêng)\\s+[\\w'-]+\\s+)", _BREAK)
    out = F.regexp_replace(out, f"(?U)\\b(?=(?:và|nhưng|and|but)\\s+[A-ZÀ-Ỹ][\\wÀ-ỹ'-]+\\s+(?:{'|'.join(NAMED_VERBS)})\\b)", _BREAK)
    return F.filter(F.transform(F.split(out, _BREAK), lambda x: F.regexp_replace(x, "^[ ,;]+|[ ,;]+$", "")), lambda x: x != "")


def sentences(turn_rows: DataFrame, most: int = 60) -> DataFrame:
    """meeting_id, turn_no, sentence_no, text_raw. Only sentences of more than `most` words leave the JVM."""
    base = turn_rows.select("meeting_id", "turn_no", F.posexplode(sentence_list(F.col("text_raw"))).alias("part_no", "text_raw"))
    long = F.size(F.split("text_raw", "\\s+")) > most
    short_rows = base.where(~long).withColumn("cut_no", F.lit(0))
    cut = base.where(long).select("meeting_id", "turn_no", "part_no", F.posexplode(_shortened(F.col("text_raw"))).alias("cut_no", "text_raw"))
    rows = short_rows.unionByName(cut)
    order = W.partitionBy("meeting_id", "turn_no").orderBy("part_no", "cut_no")
    return rows.select("meeting_id", "turn_no", (F.row_number().over(order) - 1).alias("sentence_no"), "text_raw")


def clauses(sentence_rows: DataFrame) -> DataFrame:
    """The central table: clauses in the meeting's order, with ids and normal forms."""
    rows = sentence_rows.select("meeting_id", "turn_no", "sentence_no", F.posexplode(clause_list(F.col("text_raw"))).alias("clause_no", "text_raw"))
    order = F.row_number().over(W.partitionBy("meeting_id").orderBy("turn_no", "sentence_no", "clause_no"))
    return rows.select(
        "meeting_id", sequence_id("CLAUSE", order).alias("clause_id"), (order - 1).alias("order_index"), "turn_no", "sentence_no", "text_raw",
        normalized(F.col("text_raw")).alias("text_normalized"),
    )


def blocks(clause_rows: DataFrame, size: int = 50, overlap: int = 7, hard_maximum: int = 80) -> DataFrame:
    """Blocks of `size` clauses, each with up to `overlap` clauses of context on either side. A clause is primary once. Raises
    ValueError if size isn't within 1 and hard_maximum, or overlap is negative."""
    if not 1 <= size <= hard_maximum or overlap < 0:
        raise ValueError(f"blocks of {size} clauses must be within 1..{hard_maximum}, with an overlap of 0 or more")
    block = F.floor(F.col("order_index") / size)
    place = F.col("order_index") % size
    near = F.array_compact(F.array(block, F.when((place < overlap) & (block > 0), block - 1), F.when(place >= size - overlap, block + 1)))
    last = F.floor(F.max("order_index").over(W.partitionBy("meeting_id")) / size)
    rows = clause_rows.withColumn("own", block).withColumn("last", last).withColumn("block", F.explode(near)).where("block <= last")
    return rows.groupBy("meeting_id", F.col("block").cast("long").alias("block")).agg(
        F.count(F.when(F.col("own") == F.col("block"), 1)).alias("n_primary"), F.count(F.when(F.col("own") != F.col("block"), 1)).alias("n_context"),
        F.min("order_index").alias("first_index"), F.max("order_index").alias("last_index"),
    )


#: Fixed value: from which ratio on a caption is the one before, said again.
SAME_CAPTION = 0.85


def same_caption(previous: str, current: str) -> bool:
    """Whether one text (in match form) holds the other or is nearly it."""
    return bool(previous and current) and (previous in current or current in previous or bounded_ratio(previous, current, SAME_CAPTION) >= SAME_CAPTION)


def merged_captions(captions: DataFrame, max_gap_ms: int = 1500) -> DataFrame:
    """Live captions that only extend the one before are merged into it. What a caption is compared with has itself grown,
    so this is a fold over a meeting's rows in order."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for row in rows.sort_values("order_index").to_dict("records"):
            last = kept[-1] if kept else None
            near = last is not None and (pd.isna(last["end_ms"]) or pd.isna(row["start_ms"]) or row["start_ms"] - last["end_ms"] <= max_gap_ms)
            if near and last["speaker_match"] == row["speaker_match"] and same_caption(last["text_match"], row["text_match"]):
                if len(row["text_raw"]) >= len(last["text_raw"]):
                    last |= {"text_raw": row["text_raw"], "text_match": row["text_match"]}
                last["start_ms"] = min((x for x in (last["start_ms"], row["start_ms"]) if not pd.isna(x)), default=None)
                last["end_ms"] = max((x for x in (last["end_ms"], row["end_ms"]) if not pd.isna(x)), default=None)
                last["merged"] += 1
                last["source_caption_ids"] = [*last["source_caption_ids"], row["caption_id"]]
            else:
                kept.append(row | {"merged": 1, "source_caption_ids": [row["caption_id"]]})
        return pd.DataFrame(kept)[["meeting_id", "caption_id", "speaker_raw", "start_ms", "end_ms", "text_raw", "order_index", "merged", "source_caption_ids"]]

    forms = captions.withColumn("speaker_match", match_form(F.col("speaker_raw"))).withColumn("text_match", match_form(F.col("text_raw")))
    kind = dict(captions.dtypes)["meeting_id"]
    return forms.groupBy("meeting_id").applyInPandas(
        fold, f"meeting_id {kind}, caption_id string, speaker_raw string, start_ms long, end_ms long, text_raw string, order_index long, merged int, source_caption_ids array<string>"
    )


def preprocessed(captions: DataFrame) -> DataFrame:
    """The whole chain from captions to clauses with speaker, times and the captions they come from."""
    merged = merged_captions(captions)
    spoken = turns(merged.select("meeting_id", "caption_id", "speaker_raw", "start_ms", "end_ms", "text_raw", "order_index"))
    rows = clauses(sentences(spoken))
    lineage = merged.select("meeting_id", "caption_id", "source_caption_ids")
    of_turn = spoken.select("meeting_id", "turn_no", F.posexplode("source_caption_ids").alias("at", "caption_id")).join(lineage, ["meeting_id", "caption_id"])
    sources = of_turn.groupBy("meeting_id", "turn_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "source_caption_ids"))), lambda x: x["source_caption_ids"])).alias("source_caption_ids"))
    about = spoken.select("meeting_id", "turn_no", "turn_id", "speaker_id", "speaker_name", "start_ms", "end_ms")
    return rows.join(about, ["meeting_id", "turn_no"]).join(sources, ["meeting_id", "turn_no"])
