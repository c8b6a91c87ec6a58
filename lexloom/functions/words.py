"""Reversible splitting of text into words.

A text is cut at special tokens (``<|...|>``); the segments between them become words, single digits and single other
characters. A blank is dropped where one is expected, marked where it is not, and a missing one is marked as well, so that
joining restores the text. Runs of blanks and of newlines become run tokens. Splitting and joining are Arrow functions over
whole batches (`word_arrays`): as column expressions, every piece of a text would be interpreted.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lexloom.functions import word_arrays
from lexloom.functions.base import strings
from lexloom.functions.word_arrays import LINE, NO_BLANK_AFTER, NO_BLANK_BEFORE, NO_WS, RUN_OF, WS  # noqa: F401

RUN = word_arrays.RUN


def is_special(word: Column) -> Column:
    return word.startswith("<|") & word.endswith("|>")


def run_tokens(token: str, count: Column) -> Column:
    """count tokens merged: fours, then at most one pair or four, then at most one single."""
    pairs = F.floor(count / 2).cast("int")
    fours = F.greatest(F.ceil(pairs / 2).cast("int") - 1, F.lit(0))
    rest = pairs - 2 * fours
    name = lambda n: f"<|{n}{RUN_OF[token]}|>"
    middle = F.when(rest == 2, strings(name(4))).when(rest == 1, strings(name(2))).otherwise(strings())
    last = F.when(count % 2 == 1, strings(token)).otherwise(strings())
    return F.concat(F.array_repeat(F.lit(name(4)), fours), middle, last)


@F.arrow_udf(returnType=ArrayType(StringType()))
def _split(texts: pa.Array) -> pa.Array:
    return word_arrays.split(texts)


@F.arrow_udf(returnType=StringType())
def _join(words: pa.Array) -> pa.Array:
    return word_arrays.join(words)


def text_to_words(text: Column) -> Column:
    """array<string>; null for null."""
    return _split(text)


def expand_runs(words: Column) -> Column:
    """Run tokens back to single ones, any decimal count."""

    def one(w: Column) -> Column:
        kind = F.regexp_extract(w, RUN, 2)
        token = F.when(kind == "ws", F.lit(WS)).otherwise(F.lit(LINE))
        return F.when(w.rlike(RUN), F.array_repeat(token, F.regexp_extract(w, RUN, 1).cast("int"))).otherwise(F.array(w))

    return F.flatten(F.transform(words, one))


def words_to_text(words: Column) -> Column:
    """The text that text_to_words came from; null for null."""
    return _join(words)
