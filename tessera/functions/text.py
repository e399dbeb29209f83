"""Text functions as Column expressions: normal forms, similarities, keywords, stable ids."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numeric weekday spellings and their words.
WEEKDAY_WORDS = {"2": "thứ hai", "3": "thứ ba", "4": "thứ tư", "5": "thứ năm", "6": "thứ sáu", "7": "thứ bảy"}

#: Words that are no keywords (in match form).
STOPWORDS = (
    "anh", "chi", "em", "toi", "minh", "ban", "va", "la", "cho", "voi", "cua", "task", "viec", "phan", "team", "meeting", "hom", "nay",
    "mai", "lam", "gui", "cap nhat", "kiem tra", "duoc", "vay", "thi", "mot", "nhung", "the", "this", "that", "with", "from", "into",
    "and", "for", "will", "todo", "action",
)

_PLAIN = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x1F00) if len(unicodedata.normalize("NFD", chr(c))) > 1}


#: Without one of these a text names no weekday by number.
WEEKDAY_SIGNS = ("thứ", "cn")


def normalized(text: Column) -> Column:
    """Lower case, one blank between words, weekdays in words. Texts are expected in NFC."""
    low = F.lower(text)
    out = F.trim(F.regexp_replace(F.replace(low, F.lit("ß"), F.lit("ss")), "(?U)\\s+", " "))
    worded = out
    for digit, words in WEEKDAY_WORDS.items():
        worded = F.regexp_replace(worded, f"(?U)\\bthứ\\s*{digit}\\b", words)
    worded = F.regexp_replace(worded, "(?U)\\bcn\\b", "chủ nhật")
    return F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(x)) for x in WEEKDAY_SIGNS)), worded).otherwise(out)


def match_form(text: Column) -> Column:
    """Normal form without marks on letters and without punctuation but :/.-"""
    plain = F.translate(normalized(text), "đ" + "".join(_PLAIN), "d" + "".join(_PLAIN.values()))
    return F.regexp_replace(plain, "(?U)[^\\w\\s:/.-]", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: an expression that is used in several places is evaluated at each of them."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(rows: DataFrame, inputs: list[str], more: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with the columns that `more` adds to its table, which holds each distinct combination of `inputs` once: what is said is said again,
    and a costly expression of a text is computed for no text twice. Rows of a stream are computed one by one."""
    if rows.isStreaming:
        return more(rows)
    keys = {c: f"{c}__once" for c in inputs}
    known = more(rows.select(*inputs).distinct()).withColumnsRenamed(keys)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()))
    return rows.join(known, same).drop(*keys.values())


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "(?U)\\W+"), lambda w: w != "")


def keywords(text: Column, limit: int = 8) -> Column:
    """The first distinct words of at least three letters that are neither stopwords nor dates or times."""
    keep = F.filter(
        words_of(match_form(text)),
        lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS) & ~w.rlike("^(?:\\d+|dl|ddl|due|deadline|eta|han|thu|ngay|tuan|am|pm)$"),
    )
    return F.slice(F.array_distinct(keep), 1, limit)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """The shared part of the smaller set; 0 if either is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def hash_id(prefix: str, text: Column, digits: int = 8) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, digits))


def sequence_id(prefix: str, number: Column) -> Column:
    return F.format_string(prefix + "-%06d", number)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, cut to 0..1; 0 if either has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / norm)))


def caption_text(raw: Column) -> Column:
    """Without tags and character entities, one blank between words."""
    out = raw
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), ("\u00a0", " ")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(F.regexp_replace(out, "<[^>]+>", ""), "(?U)\\s+", " "))


def stamp_ms(stamp: Column) -> Column:
    """MM:SS or HH:MM:SS with up to three decimals (comma or point) as milliseconds."""
    parts = F.split(F.replace(F.trim(stamp), F.lit(","), F.lit(".")), ":")
    n = F.size(parts)
    seconds = F.split(F.element_at(parts, -1), "\\.")
    whole = F.element_at(seconds, 1).cast("long")
    hours = F.when(n == 3, F.element_at(parts, 1).cast("long")).otherwise(0)
    millis = F.substring(F.rpad(F.coalesce(F.try_element_at(seconds, F.lit(2)), F.lit("0")), 3, "0"), 1, 3).cast("long")
    return ((hours * 60 + F.element_at(parts, -2).cast("long")) * 60 + whole) * 1000 + millis


def speaker_and_text(raw: Column) -> tuple[Column, Column]:
    """`<v Name>text`, else `Name: text` with a name of at most 80 characters, else Unknown."""
    voice = F.trim(raw).rlike("(?is)^<v\\s+[^>]+>")
    clean = caption_text(raw)
    named = clean.rlike("^[^:]{1,80}:\\s*.+$")
    speaker = (
        F.when(voice, caption_text(F.regexp_extract(F.trim(raw), "(?is)^<v\\s+([^>]+)>(.*)$", 1)))
        .when(named, F.trim(F.regexp_extract(clean, "^([^:]{1,80}):\\s*(.+)$", 1)))
        .otherwise("Unknown")
    )
    text = (
        F.when(voice, caption_text(F.regexp_extract(F.trim(raw), "(?is)^<v\\s+([^>]+)>(.*)$", 2)))
        .when(named, F.trim(F.regexp_extract(clean, "^([^:]{1,80}):\\s*(.+)$", 2)))
        .otherwise(clean)
    )
    return speaker, text


def plain(value: str) -> str:
    """`match_form` of a fixed value, without Spark."""
    out = " ".join(value.lower().split()).replace("đ", "d")
    out = "".join(c for c in unicodedata.normalize("NFD", out) if not unicodedata.combining(c))
    return "".join(c for c in out if c.isalnum() or c in "_ :/.-")
