"""Deterministic slots of words and triples in a vocabulary, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.config import SplitConfig
from lexloom.functions.base import let
from lexloom.functions.triples import id_to_triple, triple_to_id

#: the first attempts at a slot that are made together, and by how much each later lot of them is larger
LOT, GROWTH = 8, 8
#: attempts for each slot of the vocabulary: with 64 the last free slot of a row is missed with a probability of e**-64
SURE = 64


def md5_mod(text: Column, modulus: int) -> Column:
    """The md5 digest as a 128-bit number, modulo a number below 2**31."""

    def horner(h: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for i in range(4):
            out = (out * (1 << 32) + F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint")) % modulus
        return out.cast("int")

    return let(F.md5(text.cast("binary")), horner)


def word_slots(word: Column, config: SplitConfig) -> Column:
    """Slots of a word hashed as a whole: unsorted, possibly repeated."""
    own, shared = config.slots - config.shared_slots, config.shared_slots
    parts = [md5_mod(F.concat(word, F.lit(f"_{i}")), config.vocab_size) for i in range(own)]
    parts += [md5_mod(F.concat(F.lower(word), F.lit(f"_lower_{i}")), config.vocab_size) for i in range(shared)]
    return F.array(*parts)


def attempt_lots(vocab_size: int) -> list[tuple[int, int]]:
    """First and last attempt of each lot after attempt 0, in growing lots up to SURE for each slot of the vocabulary."""
    lots, at = [], 1
    while at <= SURE * vocab_size:
        size = LOT * GROWTH ** len(lots)
        lots.append((at, at + size - 1))
        at += size
    return lots


def triple_row(triple_id: Column, config: SplitConfig) -> Column:
    """`slots` distinct slots in ascending order: for each, the first of a series of hashes that is not taken yet. Later lots of the
    series are computed only for a slot that the earlier ones do not find."""
    if config.slots > config.vocab_size:
        raise ValueError("a row has more slots than the vocabulary")
    name = F.concat(triple_id.cast("string"), F.lit("_"))

    def hashed(k: Column, j: Column) -> Column:
        return md5_mod(F.concat(name, k.cast("string"), F.lit("_"), j.cast("string")), config.vocab_size)

    def add(taken: Column, k: Column) -> Column:
        return let(hashed(k, F.lit(0)), lambda h: F.when(~F.array_contains(taken, h), F.array_append(taken, h)).otherwise(F.array_append(taken, later(taken, k))))

    def later(taken: Column, k: Column) -> Column:
        def lot(first: int, last: int) -> Column:
            tries = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda j: hashed(k, j))
            return F.get(F.filter(tries, lambda h: ~F.array_contains(taken, h)), 0)

        return F.coalesce(*[lot(*x) for x in attempt_lots(config.vocab_size)], F.raise_error(F.lit("no free slot")).cast("int"))

    return F.array_sort(F.aggregate(F.sequence(F.lit(0), F.lit(config.slots - 1)), F.array().cast("array<int>"), add))


def triple_slots(triple_id: Column, config: SplitConfig) -> Column:
    """The row, its last `shared_slots` replaced by those of the lower-case triple where letters and blanks have an upper-case one."""
    row = triple_row(triple_id, config)
    if not config.shared_slots:
        return row
    keep = config.slots - config.shared_slots

    def overlaid(h: Column) -> Column:
        low = triple_to_id(F.encode(F.lower(F.decode(id_to_triple(triple_id), "ISO-8859-1")), "ISO-8859-1"))
        return F.concat(F.slice(h, 1, keep), F.slice(triple_row(low, config), keep + 1, config.shared_slots))

    text = F.decode(id_to_triple(triple_id), "ISO-8859-1")
    return let(row, lambda h: F.when(text.rlike("^[A-Za-z ]{3}$") & text.rlike("[A-Z]"), overlaid(h)).otherwise(h))


def is_hashed_whole(word: Column, config: SplitConfig) -> Column:
    """Special words, or all words where the configuration says so, have slots of their own and a single pseudo-triple."""
    return F.lit(True) if config.entire_words else F.contains(word, F.lit("<|"))
