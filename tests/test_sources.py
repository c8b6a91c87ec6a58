import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom import config
from lexloom.operators import chat, vocabulary
from lexloom.sources import binary_files, corpus, dictionary_store
from lexloom.streaming import word_stream

DOCS = [(0, "Hello World"), (1, "é 日本"), (2, ""), (3, "x" * 50)]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, text string")


def test_corpus_round_trip(spark, docs, tmp_path):
    path = str(tmp_path / "c")
    corpus.write_corpus(docs, path)
    with pytest.raises(Exception):
        corpus.write_corpus(docs, path)
    c = corpus.open_corpus(spark, path)
    assert bytes(corpus.lookup(c, 1).first().payload).decode() == "é 日本"
    assert tuple(corpus.index_of(c, 1).first()) == (11, 9)
    assert corpus.lookup(c, 9).count() == 0
    with pytest.raises(NotImplementedError):
        corpus.lookup(c, "1")
    assert [r.size for r in corpus.sizes(corpus.scan(c)).collect()] == [11, 9, 0, 50]
    assert bytes(corpus.lookup(c, 0).select(corpus.read_range(F.col("payload"), 6, 5).alias("p")).first().p) == b"World"
    corpus.validate(c, docs, every=1)
    with pytest.raises(ValueError):
        corpus.validate(c.where("doc_id <> 3"), docs)


def test_binary_triple(spark, docs, tmp_path):
    done = binary_files.write_documents(docs.withColumn("shard", F.lit("s0")), str(tmp_path)).collect()
    assert (done[0].documents, done[0].bytes) == (4, 70)
    prefix = str(tmp_path / "s0")
    assert binary_files.describe(prefix) == {"dtype": "uint8", "index_dtype": "uint64", "document_count": 4}
    got = binary_files.read_documents(spark, prefix, slices=3).orderBy("doc_id").collect()
    assert [bytes(r.payload).decode() for r in got] == [t for _, t in DOCS]
    with pytest.raises(Exception):
        binary_files.write_documents(docs.withColumn("shard", F.lit("s0")), str(tmp_path)).collect()


def test_integer_table(spark, tmp_path):
    rows, prefix = [[9, 8, 70_001], [0], [], [-7, 2**31 - 1, -(2**31)]], str(tmp_path / "n")
    np.concatenate(rows).astype("<i4").tofile(f"{prefix}.bin")
    size = np.array([len(r) for r in rows])
    np.stack([np.cumsum(size) - size, size], 1).astype("<i8").tofile(f"{prefix}.idx")
    (tmp_path / "n.meta.json").write_text(json.dumps({"dtype": "int32", "index_dtype": "int64", "document_count": 4}))
    read = lambda p: [r.n for r in binary_files.read_documents(spark, p).select("doc_id", binary_files.as_numbers("payload", "int32").alias("n")).orderBy("doc_id").collect()]
    assert read(prefix) == rows
    df = spark.createDataFrame([("w", i, r) for i, r in enumerate(rows)], "shard string, doc_id bigint, n array<int>")
    assert binary_files.write_documents(df, str(tmp_path), text_col="n").first().bytes == 28
    assert binary_files.describe(str(tmp_path / "w"))["dtype"] == "int32" and read(str(tmp_path / "w")) == rows


def test_packed_index(spark, tmp_path):
    prefix = str(tmp_path / "p")
    np.array([0, 0, 1], "<u4").tofile(f"{prefix}.indices.bin")
    np.array([5, 60000, 7], "<u2").tofile(f"{prefix}.lengths.bin")
    np.array([0, 5, 1 << 40], "<u8").tofile(f"{prefix}.offsets.bin")
    got = binary_files.read_packed_index(spark, prefix).orderBy("chunk").collect()
    assert [(r.record_id, r.length, r.offset) for r in got] == [(0, 5, 0), (0, 60000, 5), (1, 7, 1 << 40)]


def test_packed_index_is_written(spark, tmp_path):
    chunks = spark.createDataFrame([("s", 1, 0, 9, 4), ("s", 0, 1, 5, 2), ("s", 0, 0, 1 << 33, 65535)], "shard string, record_id int, chunk_no int, offset bigint, length int")
    assert [tuple(r) for r in binary_files.write_packed_index(chunks, str(tmp_path)).collect()] == [("s", 3)]
    got = binary_files.read_packed_index(spark, str(tmp_path / "s")).orderBy("chunk").collect()
    assert [(r.record_id, r.length, r.offset) for r in got] == [(0, 65535, 1 << 33), (0, 2, 5), (1, 4, 9)]
    with pytest.raises(Exception):
        binary_files.write_packed_index(chunks, str(tmp_path)).collect()
    with pytest.raises(Exception, match="does not fit"):
        binary_files.write_packed_index(chunks.withColumns({"shard": F.lit("t"), "length": F.lit(65536)}), str(tmp_path)).collect()


def test_jsonl(spark, tmp_path):
    line = json.dumps([{"type": "text", "content": "q", "has_loss": False}, {"type": "text", "content": "a", "has_loss": True}])
    (tmp_path / "f.jsonl").write_text(f"  {line}\n\n   \n")
    lines = corpus.jsonl_lines(spark, str(tmp_path / "f.jsonl")).withColumn("k", F.lit(1))
    got = chat.parsed_records(lines, "k").orderBy("part").collect()
    assert [(r.text, r.loss_weight) for r in got] == [("q", 0.0), ("a", 1.0)]
    bad = spark.createDataFrame([(1, '[{"type": "image", "content": "x", "has_loss": true}]')], "k int, line string")
    with pytest.raises(Exception, match="not a text part"):
        chat.parsed_records(bad, "k").collect()


def test_status_and_cache(spark, tmp_path):
    events = spark.createDataFrame([("a", 1, "INCOMPLETE"), ("a", 2, "COMPLETE"), ("b", 1, "FAILED")], "name string, at int, state string")
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    assert sorted(r.name for r in corpus.pending(names, corpus.latest_status(events)).collect()) == ["b", "c"]
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert corpus.materialised(spark, str(tmp_path), {"a": 1}, build).count() == 3
    assert len(calls) == 1


def test_dictionary_store(spark, tmp_path):
    c = config.SplitConfig(slots=3)
    words = spark.createDataFrame([("ab",), ("cd",)], "word string")
    dictionary_store.save_dictionary(str(tmp_path / "d"), c, vocabulary.dictionary_words(words, c), vocabulary.dictionary_slots(words, c))
    got, w, s = dictionary_store.load_dictionary(spark, str(tmp_path / "d"))
    assert got == c and w.count() == 2 and s.exceptAll(vocabulary.dictionary_slots(words, c)).isEmpty()
    spark.createDataFrame([("a", 2), ("b", -1)], "word string, count bigint").write.parquet(str(tmp_path / "k1"))
    spark.createDataFrame([("a", 1)], "word string, count bigint").write.parquet(str(tmp_path / "k2"))
    assert [tuple(r) for r in dictionary_store.load_counts(spark, str(tmp_path / "k1"), str(tmp_path / "k2")).collect()] == [("a", 3)]
    rows = dictionary_store.metric_rows(spark.createDataFrame([(1, 0.5, 2.0)], "step int, loss double, rate double"), "step", ["loss", "rate"])
    dictionary_store.write_metrics(rows, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    ids = spark.createDataFrame([(5,), (5,), (9,)], "triple_id int")
    assert dictionary_store.triple_table(ids, c, str(tmp_path / "t")).count() == 2
    # ids asked for later are added
    more = spark.createDataFrame([(70,), (80,), (9,)], "triple_id int")
    got = dictionary_store.triple_table(more, c, str(tmp_path / "t"))
    made = dictionary_store.triple_table(more, c)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, made.collect())) and [r.triple_id for r in got.orderBy("triple_id").collect()] == [9, 70, 80]


def test_new_dictionary(spark, tmp_path):
    counts = spark.createDataFrame([("b", 3), ("a", 3), ("zz", 9), ("q", 1)], "word string, count bigint")
    c, words, slots = dictionary_store.from_words(counts, config.SplitConfig(slots=3), str(tmp_path / "d"), limit=3)
    assert [r.word for r in words.orderBy("word_idx").collect()] == ["zz", "a", "b"] and slots.select("word").distinct().count() == 3
    again, words, _ = dictionary_store.from_dict({"path": str(tmp_path / "d"), "lowercase": True}, spark)
    assert again == config.SplitConfig(slots=3, lowercase=True) and words.count() == 3
    assert dictionary_store.from_dict({"slots": 9}, spark) == (config.SplitConfig(slots=9), None, None)


def test_config(tmp_path):
    c = config.load(config.CorpusConfig, {"split": {"slots": 7}}, {"split": {"lowercase": True}})
    assert c.split.slots == 7 and c.split.lowercase
    config.save(c, tmp_path / "c.json")
    assert config.load(config.CorpusConfig, tmp_path / "c.json") == c
    with pytest.raises(ValueError):
        config.load(config.CorpusConfig, {"split": {"nope": 1}})
    assert "slots: 4" in config.template(config.CorpusConfig)


def test_stream(spark, docs, tmp_path):
    docs.withColumn("at", F.current_timestamp()).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id bigint, text string, at timestamp").parquet(str(tmp_path / "in"))
    q = word_stream.streaming_word_counts(stream).writeStream.outputMode("complete").format("memory").queryName("words").start()
    q.processAllAvailable()
    q.stop()
    assert {r.word: r["count"] for r in spark.table("words").collect()}["Hello"] == 1
    assert word_stream.windowed_word_counts(stream, "at", "1 minute", "1 minute").isStreaming
    q = word_stream.start_corpus_ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_shared_folder_has_to_be_named():
    """Only a local session may fall back to a folder of this machine."""
    from lexloom.sources.scratch import scratch_dir

    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        def __init__(self, master):
            self.conf = Conf()
            self.sparkContext = type("Context", (), {"applicationId": "a", "getConf": lambda _: {"spark.master": master}})()

    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="share"):
            scratch_dir(Session(master))
    for master in ("local", "local[4]", "local[*]"):
        session = Session(master)
        assert scratch_dir(session) == f"{session.conf['spark.checkpoint.dir']}/lexloom-a"
