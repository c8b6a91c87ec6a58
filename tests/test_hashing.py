import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lexloom.config import SplitConfig
from lexloom.functions import hashing, triples

WORDS = ["Hello", "world", "!", "é", "日本", "<|endoftext|>", "A", "x" * 40]


def h(text, v):
    return int(hashlib.md5(text.encode()).hexdigest(), 16) % v


def row(i, c):
    out = []
    for k in range(c.slots):
        j = 0
        while (x := h(f"{i}_{k}_{j}", c.vocab_size)) in out:
            j += 1
        out.append(x)
    return sorted(out)


def test_triples(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", triples.triples(F.col("w")).alias("t"))
    df = df.withColumn("ids", F.transform("t", triples.triple_to_id)).withColumn("back", F.transform("ids", triples.id_to_triple))
    for r in df.collect():
        b = f" {r.w} ".encode()
        want = {b[i : i + 3] for i in range(len(b) - 2)}
        assert {bytes(x) for x in r.t} == want and len(r.t) == len(want)
        assert r.ids == [int.from_bytes(bytes(x), "little") for x in r.t]
        assert [bytes(x) for x in r.back] == [bytes(x) for x in r.t]


def test_strip(spark):
    spaces = "".join(chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
    df = spark.createDataFrame([(spaces + "a b" + spaces,), ("",), (None,)], "t string").select(triples.strip(F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == ["a b", "", None]


@pytest.mark.parametrize("config", [SplitConfig(slots=4), SplitConfig(vocab_size=23, slots=8), SplitConfig(slots=10, shared_slots=2), SplitConfig(vocab_size=16, slots=16), SplitConfig(vocab_size=40, slots=40, shared_slots=3)])
def test_slots(spark, config):
    ids = [0, 1, 12345, (1 << 24) - 1] + [int.from_bytes(b, "little") for b in (b" He", b"ABc", b"abc", b"A1b")]

    def slots(i):
        b, own = i.to_bytes(3, "little"), row(i, config)
        if config.shared_slots and re.fullmatch(rb"[A-Za-z ]{3}", b) and b != b.lower():
            own = own[: -config.shared_slots] + row(int.from_bytes(b.lower(), "little"), config)[-config.shared_slots :]
        return own

    df = spark.createDataFrame([(i,) for i in ids], "i int").select("i", hashing.triple_slots(F.col("i"), config).alias("s"))
    assert {r.i: r.s for r in df.collect()} == {i: slots(i) for i in ids}
    df = spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", hashing.word_slots(F.col("w"), config).alias("s"))
    own, shared = config.slots - config.shared_slots, config.shared_slots
    for r in df.collect():
        assert r.s == [h(f"{r.w}_{i}", config.vocab_size) for i in range(own)] + [h(f"{r.w.lower()}_lower_{i}", config.vocab_size) for i in range(shared)]


def test_series_has_no_early_end(spark):
    assert hashing.attempt_lots(16)[-1][1] >= 64 * 16 and hashing.attempt_lots(32_000)[-1][1] >= 64 * 32_000
    df = spark.range(300).select(hashing.triple_row(F.col("id"), SplitConfig(vocab_size=16, slots=16)).alias("s"))
    assert {tuple(r.s) for r in df.collect()} == {tuple(range(16))}
    with pytest.raises(ValueError, match="more slots"):
        hashing.triple_row(F.lit(1), SplitConfig(vocab_size=3, slots=4))
