import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexloom.config import SplitConfig
from lexloom.operators import classic, encode, tokenizer

C = SplitConfig(sequence_length=64)


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "s int, text string")


def test_shift_and_mask(spark):
    rows = encode.training_rows(texts(spark, "tea or milk<|endoftext|>7<|endoftext|>no"), ["s"], "text", C)
    got = rows.orderBy("pos").collect()
    assert [r.target for r in got] == ["or", "milk", "<|endoftext|>", "7", "<|endoftext|>", "no"]
    assert [r.is_eot for r in got] == [False, False, True, False, True, False]
    seg = [r.segment for r in encode.segments(rows, ["s"]).orderBy("pos").collect()]
    assert seg == [0, 0, 0, 1, 1, 2]
    spans = encode.segment_spans(rows, ["s"]).orderBy("segment").collect()
    assert [(r.seg_start, r.seg_end) for r in spans] == [(0, 3), (3, 5), (5, 6)]
    starts = encode.segment_starts(encode.segment_spans(rows, ["s"]), F.col("s"), 6, samples=1)
    assert sorted(r.start for r in starts.collect()) == [0, 3, 5, 6]


def test_collate(spark):
    rows = encode.padded(encode.training_rows(texts(spark, "a b<|endoftext|>c", "d e", "f g"), ["s"], "text", C), ["s"], 4)
    placed, ranges, starts = encode.collated(rows, "s", 2, 4, True)
    assert {(r.batch, r.place) for r in placed.collect()} == {(0, 0), (0, 1), (1, 0)}
    assert sorted((r.batch, r.place, r.coo_start, r.coo_end) for r in ranges.collect()) == [(0, 0, 0, 4), (0, 1, 4, 8), (1, 0, 0, 4)]
    eots = {s: [r.is_eot for r in rows.where(f"s = {s}").orderBy("pos").collect()] for s in range(3)}
    want = sorted([(s // 2, s % 2 * 4 + p) for s in range(3) for p in range(4) if p == 0 or eots[s][p - 1]] + [(0, 8), (1, 4)])
    assert sorted((r.batch, r.start) for r in starts.collect()) == want
    plain = encode.collated(rows, "s", 2, 4, False)[2]
    assert sorted((r.batch, r.start) for r in plain.collect()) == [(0, 0), (0, 4), (0, 8), (1, 0), (1, 4)]


def test_inference(spark):
    df = spark.createDataFrame([(1, 0, "a b "), (1, 1, "c"), (2, 0, "d")], "s int, p int, text string")
    rows = encode.word_rows(df, ["s", "p"], "text", C, False)
    got = encode.inference_rows(rows, ["s"], "p", 4).orderBy("s", "pos").collect()
    assert [(r.s, r.pos, r.word, r.position_id) for r in got] == [(1, 0, "a", 0), (1, 1, "b", 1), (1, 2, "<|ws|>", 2), (1, 3, "c", 3), (2, 0, "d", 0), (2, 1, "", 1), (2, 2, "", 2), (2, 3, "", 3)]
    assert encode.inference_rows(rows, ["s"], "p", None).count() == 5
    mask = encode.causal_spans(encode.inference_rows(rows, ["s"], "p", None), ["s"], 5).orderBy("s", "pos").collect()
    assert [(r.key_start, r.key_end) for r in mask] == [(0, 1), (0, 2), (0, 3), (0, 4), (0, 0), (0, 1), *[(0, 0)] * 4]
    one = tokenizer.encode_inference(texts(spark, "ab c"), ["s"], "text", SplitConfig(slots=2)).orderBy("pos").collect()
    assert [(r.word, [len(x) for x in r.slots]) for r in one] == [("ab", [2, 2]), ("c", [2])]


def test_plain_vocabulary(spark):
    plain = SplitConfig(classic=True, sequence_length=3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = texts(spark, "some words of text", "", None, "one")
    ids = {i: Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for i, t in enumerate(["some words of text", "", "", "one"])}
    got = tokenizer.encode_training(df, ["s"], "text", plain, path).orderBy("s", "pos").collect()
    assert [(r.s, r.pos, r.token, r.target) for r in got] == [(s, p, a, b) for s, x in ids.items() for p, (a, b) in enumerate(zip(x, x[1:])) if p < 3]
    every = tokenizer.encode_inference(df, ["s"], "text", plain, path).orderBy("s", "pos").collect()
    assert [(r.s, r.token) for r in every] == [(s, a) for s, x in ids.items() for a in x]
    back = df.select("s", classic.token_texts(classic.token_ids(F.col("text"), path), path).alias("t")).orderBy("s").collect()
    assert [r.t for r in back] == ["some words of text", "", None, "one"]
    logits = spark.createDataFrame([(1, [0.0, 2.0, 2.0, -1.0])], "seq int, logits array<double>")
    assert [r.vocab_id for r in tokenizer.decode_rows(logits, plain, 2).orderBy("rank").collect()] == [1, 2]


def test_edge_weight(spark):
    rows = encode.training_rows(texts(spark, "a bcd ef<|endoftext|>"), ["s"], "text", C)
    assert tokenizer.edge_weighted(rows, C) is rows
    heavy = SplitConfig(word_edge_weight=3.0)
    got = {r.target: r.loss_weight for r in tokenizer.edge_weighted(rows, heavy).collect()}
    last = {w: max((f" {w} ".encode()[i : i + 3] for i in range(len(w))), key=lambda b: int.from_bytes(b, "little")) for w in ("bcd", "ef")}
    assert got == {**{w: 3.0 if b" " in (t[:1], t[2:]) else 1.0 for w, t in last.items()}, "<|endoftext|>": 1.0}


def test_concat_slice_pad(spark):
    rows = encode.training_rows(texts(spark, "Hello World!", "one two three four", "a b", "", None), ["s"], "text", C).withColumn("g", F.lit(1))
    assert rows.count() == 2 + 3 + 1
    whole = encode.concatenated(rows, ["g"], "s", None, False).orderBy("pos").collect()
    assert [r.pos for r in whole] == list(range(6)) == [r.position_id for r in whole]
    again = encode.concatenated(rows, ["g"], "s", 4, True).orderBy("pos").collect()
    assert [r.position_id for r in again] == [0, 1, 0, 1]
    one = encode.concatenated(rows, ["g"], "s", None, False).select("g", "pos", "target")
    parts = encode.sliced(one, 0, 2).union(encode.sliced(one, 2, 99).withColumn("pos", F.col("pos") + 2))
    assert encode.same_rows(one, parts)
    assert not encode.same_rows(one, encode.sliced(one, 0, 2))
    full = encode.padded(rows.where("s = 0").drop("g"), ["s"], 5).orderBy("pos").collect()
    assert [r.is_padding for r in full] == [False, False, True, True, True]
    assert [r.is_eot for r in full] == [False, False, True, True, True] and [r.loss_weight for r in full] == [1, 1, 0, 0, 0]


def test_part_weights(spark):
    df = spark.createDataFrame([(1, 0, "Say hi", 0.0), (1, 1, "hi there", 1.0)], "s int, p int, text string, w double")
    got = encode.weighted_training_rows(df, ["s"], "p", "text", "w", C).orderBy("pos").collect()
    assert [(r.word, r.target, r.loss_weight) for r in got] == [("Say", "hi", 0.0), ("hi", "hi", 1.0), ("hi", "there", 1.0)]


def test_hits(spark):
    c = SplitConfig(vocab_size=11, slots=3)
    rows = encode.training_rows(texts(spark, "ab abc ab<|endoftext|>"), ["s"], "text", c)
    hits = encode.sparse_hits(rows, ["s"], c)
    of = {r.word: [] for r in encode.slots_of_words(rows, c, "target").collect()}
    for r in encode.slots_of_words(rows, c, "target").collect():
        of[r.word].append(set(r.slots))
    want = {(r.pos, v): sum(v in s for s in of[r.target]) for r in rows.collect() for v in set().union(*of[r.target])}
    assert {(r.pos, r.vocab_id): r.hits for r in hits.collect()} == want
    assert {r.hits for r in encode.binarised(hits).collect()} == {1}


def test_batch_ranges(spark):
    df = spark.createDataFrame([(0, 0, 3), (0, 1, 2), (1, 2, 5)], "b int, s int, n int")
    assert [(r.coo_start, r.coo_end) for r in encode.coo_ranges(df, "b", "s", "n").orderBy("s").collect()] == [(0, 3), (3, 5), (0, 5)]
