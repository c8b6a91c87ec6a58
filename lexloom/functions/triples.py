"""Byte triples of words, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.base import let

#: the 29 code points that stripping removes
STRIPPED = "\\u0009-\\u000D\\u001C-\\u0020\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{STRIPPED}]+|[{STRIPPED}]+$", "")


def prepared(text: Column, lowercase: bool, stripped: bool) -> Column:
    text = F.lower(text) if lowercase else text
    return strip(text) if stripped else text


def triples(word: Column) -> Column:
    """Distinct windows of 3 bytes of the word with a blank on each side."""
    b = F.encode(F.concat(F.lit(" "), word, F.lit(" ")), "UTF-8")
    return let(b, lambda x: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(x) - 2, F.lit(1))), lambda i: F.substr(x, i, F.lit(3)))))


def triple_to_id(triple: Column) -> Column:
    """Little-endian number of 3 bytes."""
    h = F.hex(triple)
    part = lambda i: F.substring(h, 2 * i + 1, 2)
    return F.conv(F.concat(part(2), part(1), part(0)), 16, 10).cast("int")


def id_to_triple(number: Column) -> Column:
    byte = lambda shift: F.lpad(F.hex(F.shiftright(number, shift).bitwiseAND(F.lit(255))), 2, "0")
    return F.unhex(F.concat(byte(0), byte(8), byte(16)))


def touches_edge(triple: Column) -> Column:
    h = F.hex(triple)
    return h.startswith("20") | h.endswith("20")
