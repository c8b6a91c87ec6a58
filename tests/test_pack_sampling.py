import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.config import PackConfig, SampleConfig, SplitConfig
from lexloom.operators import pack, sampling
from lexloom.sources import corpus


def packed(spark, texts):
    docs = spark.createDataFrame([("s", i, t.encode() if isinstance(t, str) else t) for i, t in enumerate(texts)], "shard string, doc_id bigint, payload binary")
    docs = corpus.with_offsets(docs, "doc_id", F.octet_length("payload"))
    chunks = pack.packed_records(docs)
    return chunks, docs


def test_record_sizes(spark):
    c = PackConfig()
    texts = [f"w{i} " * (9_000 - 1_500 * (i % 4)) for i in range(7)]
    chunks, docs = packed(spark, texts)
    sizes = {r.record_id: r.bytes for r in pack.record_bytes(chunks).collect()}
    assert len(sizes) > 5 and all(c.max_bytes - 2 * c.tolerance_bytes <= b <= c.max_bytes for b in sizes.values())
    rows = pack.record_texts(chunks, docs).orderBy("record_id", "chunk_no").collect()
    names = [set(r.text.split()) for r in rows]
    assert all(len(x) == 1 for x in names)  # a chunk is of one document
    order = [r.doc_id for r in rows]
    assert order == sorted(order) and [f"w{i}" for i in order] == [next(iter(x)) for x in names]
    assert pack.visible_records(chunks).select("record_id").distinct().count() == len(sizes) - 1
    assert pack.record_counts(chunks).first().records == len(sizes) - 1
    first = pack.record_texts(pack.records(chunks, "s", 0), docs).orderBy("chunk_no").collect()
    assert [r.text for r in first] == [r.text for r in rows if r.record_id == 0]


def test_shards_are_cut_by_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([40, 70, 30, 200, 10])], "doc_id bigint, text string")
    cut = pack.cut_shards(corpus.with_offsets(docs, "doc_id", F.octet_length("text")), 100).orderBy("doc_id").collect()
    assert [int(r.shard) for r in cut] == [0, 0, 1, 1, 3]


def test_losses():
    c = PackConfig()
    word = b"a" * 150  # no separator: the document is given up
    assert pack.pack_shard([word, b"x " * 60], [0, 150], c) == []  # the only record is the last, which goes
    small = [b"y" * 99, b"ab " * 40, b"\xff\xfe " * 60, b"ab " * 40]
    records = pack.pack_shard([*small, b"z " * 12_000], [0] * 5, PackConfig(max_bytes=200, tolerance_bytes=100))
    used = {n for r in records for n, _, _ in r}
    assert 0 not in used and 2 not in used and {1, 4} <= used


def test_small_documents_share_records():
    c = PackConfig(max_bytes=1000, tolerance_bytes=50)
    texts = [b"word " * random.Random(i).randint(5, 300) for i in range(40)]
    records = pack.pack_shard(texts, [0] * 40, c)
    assert all(sum(x[2] for x in r) <= 1000 for r in records)
    seen = [(n, o) for r in records for n, o, _ in r]
    assert seen == sorted(seen)
    assert all(texts[n][o : o + length].strip().startswith(b"word") for r in records for n, o, length in r)


def test_samples_top_up(spark):
    texts = spark.createDataFrame([("r0", 0, "a b c"), ("r0", 1, "d e"), ("r1", 0, "f g h i j"), ("r2", 0, "k")], "record string, chunk_no int, text string")
    order = spark.createDataFrame([(0, "r0"), (1, "r1"), (2, "r2")], "slot bigint, record string")
    got = pack.sample_chunks(texts, order, SplitConfig(sequence_length=7))
    rows = {}
    for r in got.orderBy("sample", "part").collect():
        rows.setdefault(r.sample, []).append(r.text.replace("<|endoftext|>", ""))
    # r0 has 3 + 2 positions, so slot (0 + 2 chunks) % 3 follows, then slot (0 + 3) % 3
    assert rows[0] == ["a b c", "d e", "k", "a b c", "d e"]
    assert rows[1] == ["f g h i j", "k", "a b c", "d e"][: len(rows[1])] and len(rows[1]) >= 2


def test_long_walks_take_few_rounds(spark):
    """Samples of hundreds of steps, over records of no position as well, against a walk step by step."""
    rng = random.Random(3)
    n, length = 97, 700
    chunks, positions = [rng.randint(1, 5) for _ in range(n)], [rng.choice([0, 0, 1, 2, 9, 800]) if i % 9 else 3 for i in range(n)]
    records = spark.createDataFrame(list(zip(range(n), chunks, positions)), "slot bigint, chunks bigint, positions bigint")
    got = pack.visits(records, n, length, records.select(F.col("slot").alias("sample")))
    want = []
    for sample in range(n):
        at, part, done = sample, 0, 0
        while True:
            want.append((sample, at, part))
            done, part = done + positions[at], part + chunks[at]
            if done >= length:
                break
            at = (sample + part) % n
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 8 * n
    with pytest.raises(ValueError, match="circle"):
        pack.visits(records.withColumn("positions", F.lit(0)), n, length, records.select(F.col("slot").alias("sample")))


def test_permutations(spark):
    assert [r.idx for r in sampling.legacy_permutation(spark, 10, 42).orderBy("slot").collect()] == [8, 1, 5, 0, 7, 2, 9, 4, 3, 6]
    got = sampling.hashed_permutation(spark.range(500), "id", 7).orderBy("slot").collect()
    want = sorted(range(500), key=lambda i: hashlib.md5(f"7_{i}".encode()).hexdigest())
    assert [r.slot for r in got] == list(range(500)) and [r.idx for r in got] == want
    with pytest.raises(ValueError):
        sampling.legacy_permutation(spark, sampling.LEGACY_LIMIT + 1, 1)


@pytest.mark.parametrize("world,micro,consumed", [(1, 1, 0), (2, 3, 0), (3, 2, 12), (3, 4, 500)])
def test_dealt(spark, world, micro, consumed):
    total, c = 53, SampleConfig(micro_batch=micro, world=world, consumed=consumed)
    usable = total // world // micro * micro * world
    done = consumed % usable
    want = set()
    for rank in range(world):
        idx = [j * world + rank + done for j in range((usable - done) // world)]
        idx = idx[: len(idx) // micro * micro]
        want |= {(x, rank, i // micro, i % micro) for i, x in enumerate(idx)}
    got = {(r.slot, r.rank, r.batch, r.place) for r in sampling.dealt(spark.range(total).withColumnRenamed("id", "slot"), total, c).collect()}
    assert got == want and sampling.epoch_of(total, c) == consumed // usable


def test_locate(spark):
    sizes = spark.createDataFrame([("a", 3), ("b", 2)], "shard string, n bigint")
    got = sampling.locate(spark.range(7).withColumnRenamed("id", "idx"), sampling.shard_ranges(sizes))
    assert sorted((r.idx, r.shard, r.local_idx) for r in got.collect()) == [(0, "a", 0), (1, "a", 1), (2, "a", 2), (3, "b", 0), (4, "b", 1)]


def test_offsets_match_a_running_sum(spark):
    sizes = np.random.RandomState(3).randint(0, 50, 300)
    docs = spark.createDataFrame([(int(i * i), "x" * int(n)) for i, n in enumerate(sizes)], "doc_id bigint, text string")
    got = corpus.with_offsets(docs, "doc_id", F.octet_length("text")).orderBy("doc_id").collect()
    assert [r.start for r in got] == (np.cumsum(sizes) - sizes).tolist()


def test_offsets_keep_null_ids_and_outliers(spark):
    docs = spark.createDataFrame([(None, "ab"), (5, "c"), (None, "d"), (2**60, "efg"), (5, "h"), (6, None)], "doc_id bigint, text string")
    got = corpus.with_offsets(docs, "doc_id", F.octet_length("text")).collect()
    assert len(got) == 6
    spans = sorted((r.start, r.start + (r.size or 0)) for r in got)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] == 8
    assert {r.start for r in got if r.doc_id is None} <= {0, 1, 2} and next(r.start for r in got if r.text == "efg") == 5


def test_union_of_shards(spark):
    shards = [spark.range(2), spark.range(3)]
    got = sampling.union_of_shards(shards)
    assert sorted((r.shard, r.id) for r in got.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)]


def test_as_of_join_over_many_shards(spark):
    rng = random.Random(8)
    sizes = [(f"s{i:05d}", rng.choice([0, 0, 1, 2, 30])) for i in range(2000)]
    ranges = sampling.shard_ranges(spark.createDataFrame(sizes, "shard string, n bigint"))
    total = sum(n for _, n in sizes)
    idx = [*range(-2, total + 3), 5, 5]
    got = sampling.locate(spark.createDataFrame([(i, f"x{i}") for i in idx], "idx bigint, tag string"), ranges)
    want, at = [], 0
    for s, n in sizes:
        want += [(at + k, f"x{at + k}", s, k) for k in range(n)]
        at += n
    want += [w for w in want if w[0] == 5] * 2
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sampling.locate(spark.range(4).toDF("idx"), ranges.where("false")).count() == 0
    assert sampling.locate(spark.range(4).toDF("idx"), ranges).columns == ["idx", "shard", "local_idx"]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 12, 97, 1000, 1023])
def test_keyed_permutation(spark, n):
    order = sampling.Permutation(n, 5)
    df = spark.range(n).select("id", order.slot(F.col("id")).alias("s")).withColumn("back", order.index(F.col("s")))
    rows = df.collect()
    assert sorted(r.s for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    if n >= 97:
        other = spark.range(n).select(sampling.Permutation(n, 5, epoch=1).slot(F.col("id")).alias("s")).collect()
        same = sum(a.s == b.s for a, b in zip(rows, other))
        assert same < 10 and sum(r.s == r.id for r in rows) < 10
        assert abs(sum(abs(r.s - r.id) for r in rows) / n - n / 3) < n / 8  # as far as chance would move them
