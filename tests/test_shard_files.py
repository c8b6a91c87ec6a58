import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.sources import corpus, shard_files
from lexloom.streaming import ingest


@pytest.fixture()
def docs(spark):
    rng = random.Random(4)
    return spark.createDataFrame([(i, "é" * rng.randint(0, 40)) for i in range(200)], "doc_id bigint, text string").repartition(5)


def written(docs, path, **kw):
    shard_files.write(docs, path, ["doc_id"], **kw)
    return path


def slices(df):
    return df.rdd.getNumPartitions()


def test_round_trip_over_shards_and_slices(spark, docs, tmp_path):
    path = written(docs.withColumn("s", F.format_string("s%03d", F.expr("doc_id div 30"))), str(tmp_path), shard_col="s")
    assert sorted({f.split(".")[0] for f in os.listdir(path)}) == [f"s{k:03d}" for k in range(7)]
    got = shard_files.read(spark, path, slice_bytes=300)
    assert slices(got) > 20
    assert [(r.doc_id, bytes(r.payload).decode()) for r in got.orderBy("doc_id").collect()] == [tuple(r) for r in docs.orderBy("doc_id").collect()]
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[65].shard == "s002" and rows[65].local_id == 5 and rows[65].shard_documents == 30 and rows[60].start == 0
    assert rows[64].start + rows[64].size == rows[65].start
    one = shard_files.read(spark, f"{path}/s002")
    assert one.count() == 30 and one.agg(F.min("doc_id")).first()[0] == 0


def test_filters_open_the_slices_they_need(spark, docs, tmp_path):
    path = written(docs.withColumn("s", F.format_string("s%03d", F.expr("doc_id div 30"))), str(tmp_path), shard_col="s")
    os.rename(f"{path}/s001.bin", f"{path}/s001.away")  # a lookup elsewhere does not open it
    got = shard_files.read(spark, path, slice_bytes=300)
    point = got.where("doc_id = 77")
    assert slices(point) == 1 and [r.doc_id for r in point.collect()] == [77]
    assert "doc_id = 77" not in point._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    several = got.where("doc_id in (3, 9, 77, 500)")
    assert slices(several) == 2 and sorted(r.doc_id for r in several.collect()) == [3, 9, 77]
    assert sorted(r.doc_id for r in got.where("doc_id > 88 and doc_id <= 91").collect()) == [89, 90, 91]
    assert got.where("shard = 's006' and size >= 0").count() == 20
    assert got.where("doc_id = 7 and doc_id = 8").count() == 0 and got.where("doc_id = -1").count() == 0
    index = shard_files.read(spark, path, payload=False).where("shard = 's001'")
    assert index.count() == 30 and "payload" not in index.columns


def test_larger_than_a_batch(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(shard_files, "BATCH_BYTES", 50)
    monkeypatch.setattr(shard_files, "ENTRIES", 7)
    path = written(docs.coalesce(1), str(tmp_path))
    part = shard_files.planned(path, shard_files.document_shards(path), shard_files.Bounds(), 1 << 30)
    batches = [b for p in part for b in shard_files.read_documents(p, ["doc_id", "size", "payload"])]
    assert len(batches) > 40 and all(b.num_rows == 1 or sum(b.column(1).to_pylist()) <= 50 for b in batches)
    texts = [bytes(x).decode() for b in batches for x in b.column(2).to_pylist()]
    assert texts == [r.text for r in docs.orderBy("doc_id").collect()]


def test_entries_in_any_order(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abcdefgh")
    np.array([[4, 2], [0, 3], [0, 0], [3, 5]], "<i4").tofile(tmp_path / "x.idx")
    (tmp_path / "x.meta.json").write_text('{"dtype": "uint8", "index_dtype": "int32", "document_count": 4}')
    assert [bytes(r.payload) for r in shard_files.read(spark, str(tmp_path)).orderBy("doc_id").collect()] == [b"ef", b"abc", b"", b"defgh"]
    (tmp_path / "x.meta.json").write_text('{"dtype": "uint8", "index_dtype": "int32", "document_count": 5}')
    with pytest.raises(Exception, match="does not hold"):
        shard_files.read(spark, str(tmp_path)).count()


def test_nothing_is_overwritten(spark, docs, tmp_path):
    path = written(docs, str(tmp_path / "a"))
    before = {f: os.path.getmtime(f"{path}/{f}") for f in os.listdir(path)}
    with pytest.raises(Exception, match="exists"):
        written(docs, path)
    with pytest.raises(Exception, match="never overwritten"):
        docs.select(F.col("text").alias("payload")).write.format(shard_files.DOCUMENTS).mode("overwrite").save(path)
    assert {f: os.path.getmtime(f"{path}/{f}") for f in os.listdir(path)} == before


def test_failed_tasks_leave_nothing(spark, docs, tmp_path):
    path = str(tmp_path / "a")
    bad = docs.select(F.when(F.col("doc_id") == 150, F.raise_error(F.lit("stop"))).otherwise(F.col("text")).alias("payload"))
    with pytest.raises(Exception, match="stop"):
        bad.repartition(6).write.format(shard_files.DOCUMENTS).mode("append").save(path)
    assert not os.path.isdir(path) or os.listdir(path) == []
    with pytest.raises(Exception, match="two places"):
        docs.repartition(4).select(F.lit("s").alias("shard"), F.col("text").alias("payload")).write.format(shard_files.DOCUMENTS).mode("append").save(path)
    assert os.listdir(path) == []


def test_attempts_have_files_of_their_own(spark, docs, tmp_path):
    """A first attempt that died half-way and its retry: only what the retry reports is put into place."""
    import pyarrow as pa

    writer = shard_files.DocumentWriter({"path": str(tmp_path)}, docs.select(F.lit("s").alias("shard"), F.col("text").alias("payload")).schema, False)
    batch = lambda *xs: pa.RecordBatch.from_pydict({"shard": ["s"] * len(xs), "payload": list(xs)})

    def dying():
        yield batch("half")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(dying())
    made = writer.write(iter([batch("half"), batch("", "whole")]))
    assert [f for f in os.listdir(tmp_path) if not f.startswith("_")] == []  # nothing is visible before the commit
    writer.commit([made, None])
    assert sorted(os.listdir(tmp_path)) == ["s.bin", "s.idx", "s.meta.json"]
    assert [bytes(r.payload) for r in shard_files.read(spark, str(tmp_path)).orderBy("doc_id").collect()] == [b"half", b"", b"whole"]


def test_records(spark, tmp_path, monkeypatch):
    rows = [(f"s{k % 2}", i // 4, i, (1 << 33) + i, i % 60_000) for k in range(2) for i in range(300)]
    chunks = spark.createDataFrame(rows, "shard string, record_id int, chunk_no int, offset bigint, length int")
    shard_files.write_records(chunks, str(tmp_path))
    got = shard_files.read_records(spark, str(tmp_path))
    assert sorted(map(tuple, got.select("shard", "record_id", "offset", "length").collect())) == sorted((s, r, o, n) for s, r, _, o, n in rows)
    part = got.where("record_id > 9 and record_id <= 11 and shard = 's1'")
    assert sorted(r.chunk for r in part.collect()) == list(range(40, 48)) and slices(part) == 1
    assert got.where("record_id = 74").count() == 8 and got.where("record_id = 75").count() == 0 and got.where("record_id in (1, 74)").count() == 16
    big = chunks.withColumns({"shard": F.lit("t"), "length": F.lit(65536)})
    with pytest.raises(Exception, match="does not fit"):
        shard_files.write_records(big, str(tmp_path))
    assert not [f for f in os.listdir(tmp_path) if f.startswith(("t", "_"))]


def test_ingest_goes_on_after_a_stop(spark, tmp_path):
    shards, out, name = str(tmp_path / "shards"), str(tmp_path / "out"), F.regexp_extract("shard", "^[0-9]+-(.*)$", 1)
    expected = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2), ("d", 1)], "name string, documents bigint")

    def add(generation, rows):
        df = spark.createDataFrame([(f"{generation}-{n}", i, x) for i, (n, x) in enumerate(rows)], "shard string, doc_id bigint, text binary")
        shard_files.write(df, shards, ["doc_id"], shard_col="shard")

    def states():
        table, status = ingest.ingest(spark, shards, out, name, expected)
        return table.count(), {r.name: r.state for r in corpus.latest_status(status).collect()}, status.count()

    os.makedirs(shards)
    assert states() == (0, {}, 0)
    add(0, [("a", b"1"), ("a", b"2"), ("b", b"1"), ("c", b"1"), ("c", b"2"), ("x", b"1")])
    assert states() == (6, {"a": "INCOMPLETE", "b": "INCOMPLETE", "c": "COMPLETE", "x": "INCOMPLETE"}, 4)
    assert states()[::2] == (6, 4)  # nothing new, nothing twice
    add(1, [("a", b"3"), ("a", b"4"), ("a", b"5"), ("b", b"\xff\xfe"), ("d", b"1"), ("c", b"3")])
    assert states() == (12, {"a": "COMPLETE", "b": "FAILED", "c": "FAILED", "d": "COMPLETE", "x": "INCOMPLETE"}, 8)
    names = expected.select("name")
    status = spark.read.parquet(f"{out}/status")
    assert sorted(r.name for r in corpus.pending(names, corpus.latest_status(status)).collect()) == ["b", "c"]
    # a batch that was planned but not committed is read again, and the sink's log keeps its rows single
    commits = f"{out}/corpus-log/commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):
        os.remove(f"{commits}/{f}")
    assert states()[0] == 12
    add(0, [("z", b"late")])
    with pytest.raises(Exception, match="are not the"):
        add(2, [("z", b"later")])
        states()
