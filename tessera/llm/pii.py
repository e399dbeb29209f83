"""Personal data in texts (operator 4).

Method: anchor expansion. One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, "://" and cue
words of identifiers. A deterministic parser for each kind then walks left and right of an anchor, over the characters
that the kind allows, and validates what it has found. Texts without anchors cost one pass and nothing else.

Kinds and rules (all matching is leftmost and non-overlapping within a kind; what fails a check is dropped, not retried):
email, ip (four numbers of at most 255), card (16 to 19 digits that pass Luhn), phone (8 to 15 digits after a plus); and
beyond these base kinds address (scheme://host...) and account (a cue, a separator, then an identifier with a digit).

Edge cases: a null text is empty and has no spans; positions are code points, the end is exclusive; repeated rows give the
same spans; a very long text is scanned whole; an empty table gives an empty table; other columns are carried along by
`redact` and dropped by `find`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import narrowed

#: The kinds in their order, the first four being the base ones.
KINDS = ("email", "ip", "card", "phone", "address", "account")
BASE = KINDS[:4]
CUES = ("iban", "ssn", "passport", "account", "token", "secret", "password", "api_key", "apikey")
SCHEMES = ("http", "https", "ftp", "ssh", "mailto")

SPANS = "array<struct<kind:string,start:int,end:int>>"

_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LABEL = _ALNUM | {"-"}
_LOCAL = _ALNUM | set("._%+-")
_PHONE = _DIGITS | set(" ().-")
_IDENTIFIER = _ALNUM | set("-_")
_ADDRESS_END = frozenset(" \t\n\v\f\r\"'<>|")


@cache
def anchors() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for x in _DIGITS:
        out.add_word(x, ("digit", 1))
    out.add_word("@", ("at", 1))
    out.add_word("+", ("plus", 1))
    out.add_word("://", ("scheme", 3))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            out.add_word(form, ("cue", len(form)))
    out.make_automaton()
    return out


def run_end(text: str, at: int, allowed: frozenset[str]) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign, its local part not reaching below floor."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = run_end(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    labels = 1
    while text[end : end + 1] == "." and (more := run_end(text, end + 1, _LABEL)) > end + 1:
        end, labels = more, labels + 1
    return (start, end) if labels > 1 else None


def dotted_at(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """Groups of four numbers joined by single dots, in the chain of numbers that begins here, and the chain's end."""
    numbers = []
    while True:
        end = run_end(text, at, _DIGITS)
        numbers.append((at, end))
        if text[end : end + 1] != "." or text[end + 1 : end + 2] not in _DIGITS or end + 1 >= len(text):
            break
        at = end + 1
    found = []
    for i in range(0, len(numbers) - 3, 4):
        four = numbers[i : i + 4]
        if all(len(x := text[a:b].lstrip("0")) <= 3 and int(x or 0) <= 255 for a, b in four):
            found.append((four[0][0], four[3][1]))
    return found, end


def digits_end(text: str, at: int) -> int:
    """The end of digits with at most one blank or dash between two of them."""
    n = len(text)
    while at < n:
        if text[at] in _DIGITS:
            at += 1
        elif text[at] in " -" and at + 1 < n and text[at + 1] in _DIGITS:
            at += 2
        else:
            break
    return at


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        d = ord(x) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def phone_at(text: str, at: int) -> int:
    """The end of the number after the plus sign, or -1."""
    if text[at + 1 : at + 2] not in _DIGITS or at + 1 >= len(text):
        return -1
    end = run_end(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    return end if end > at + 3 else -1


def address_at(text: str, colon: int, floor: int) -> tuple[int, int] | None:
    start = colon
    while start > floor and text[start - 1] in _ALNUM:
        start -= 1
    end = colon + 3
    while end < len(text) and text[end] not in _ADDRESS_END:
        end += 1
    while end > colon + 3 and text[end - 1] in ".,;:!?)":
        end -= 1
    return (start, end) if text[start:colon].lower() in SCHEMES and end > colon + 3 else None


def account_after(text: str, at: int) -> tuple[int, int] | None:
    """The identifier that a cue, ending here, and up to four separators announce."""
    start = at
    while start < len(text) and start - at < 4 and text[start] in " :=#\"'":
        start += 1
    end = run_end(text, start, _IDENTIFIER)
    return (start, end) if start > at and end - start >= 6 and any(x in _DIGITS for x in text[start:end]) else None


def spans_of(text: str) -> list[tuple[str, int, int]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    dotted_next = card_next = phone_next = email_next = address_next = account_next = 0
    for last, (anchor, size) in anchors().iter(text):
        if anchor == "digit":
            if last >= dotted_next:
                own, dotted_next = dotted_at(text, last)
                found["ip"] += own
            if last >= card_next:
                card_next = digits_end(text, last)
                digits = text[last:card_next].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append((last, card_next))
        elif anchor == "at":
            if (span := email_at(text, last, email_next)) and last >= email_next:
                found["email"].append(span)
                email_next = span[1]
        elif anchor == "plus":
            if last >= phone_next and (end := phone_at(text, last)) > 0:
                phone_next = end
                if 8 <= sum(x in _DIGITS for x in text[last:end]) <= 15:
                    found["phone"].append((last, end))
        elif anchor == "scheme":
            if last - 2 >= address_next and (span := address_at(text, last - 2, address_next)):
                found["address"].append(span)
                address_next = span[1]
        elif last >= account_next and text[last - size : last - size + 1].isalnum() is False and (span := account_after(text, last + 1)):
            found["account"].append(span)
            account_next = span[1]
    return [(kind, a, b) for kind in KINDS for a, b in sorted(found[kind])]


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with [KIND] in place of each span; overlapping spans become one, named after the first."""
    out, at, n = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            n = len(out)
        at = max(at, b)
    return "".join(out) + text[at:] if n >= 0 else text


def _spans_array(rows: list[list[tuple[str, int, int]]]) -> pa.Array:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in row] for row in rows], pa.list_(kind))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and `spans`, by kind in the order of KINDS and then by start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [spans_of(x) if x else [] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _spans_array(rows)], ["doc_id", "spans"])

    kind = dict(docs.dtypes)["doc_id"]
    return narrowed(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans {SPANS}")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in `text` replaced by its kind in brackets, and n_chars (if there) recounted. A null text stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [x and redacted(x, spans_of(x)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 :]], batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
