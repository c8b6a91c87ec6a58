"""Byte-budget packing of texts into records, and assembly of training samples from records."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.config import PackConfig, SplitConfig
from lexloom.functions.words import text_to_words
from lexloom.functions.triples import prepared
from lexloom.sources.scratch import written

CHUNKS = "shard string, record_id int, chunk_no int, doc_id bigint, offset bigint, length int"


def pack_shard(payloads: list[bytes], starts: list[int], config: PackConfig) -> list[list[tuple[int, int, int]]]:
    """Records of (document number, offset, length). A chunk ends before the last separator that fits; the separator opens the
    next chunk, and what follows a document's last separator is lost, as are chunks that are no UTF-8. The last record goes."""
    seps = [c.encode() for c in config.separators]
    records: list[list[tuple[int, int, int]]] = []
    room = 0  # bytes that the open record can take, 0 if none is open
    for number, (payload, start) in enumerate(zip(payloads, starts)):
        at = 0
        while len(payload) >= config.tolerance_bytes and len(payload) - at > config.tolerance_bytes:
            if room <= config.tolerance_bytes:
                room = 0
            limit = min(room or config.max_bytes, len(payload) - at)
            length = max(payload.rfind(s, at, at + limit) for s in seps) - at
            if length <= 0:
                if not room:
                    break
                room = 0
                continue
            chunk = payload[at : at + length]
            try:
                chunk.decode()
            except UnicodeDecodeError:
                at += length
                continue
            full = limit == room  # the record's end was the limit
            if not room:
                records.append([])
            records[-1].append((number, start + at, length))
            used = sum(x[2] for x in records[-1])
            room = 0 if full or used >= config.max_bytes - config.tolerance_bytes else config.max_bytes - used
            at += length
    return records[:-1]


def packed_records(docs: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """docs(shard, doc_id, start, payload): shard, record_id, chunk_no, doc_id, offset, length. Sequential within a shard and
    parallel over shards; a shard is what one task holds, so its size is the caller's bound."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        ids = table.column("doc_id").to_pylist()
        records = pack_shard(table.column("payload").to_pylist(), table.column("start").to_pylist(), config)
        rows = [(r, c, ids[n], offset, length) for r, chunks in enumerate(records) for c, (n, offset, length) in enumerate(chunks)]
        shard = table.column("shard")[0].as_py()
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        return pa.table([pa.array([shard] * len(rows), pa.string()), *[pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)]], ["shard", "record_id", "chunk_no", "doc_id", "offset", "length"])

    return docs.select("shard", "doc_id", "start", "payload").groupBy("shard").applyInArrow(run, CHUNKS)


def cut_shards(docs: DataFrame, shard_bytes: int = 1 << 28) -> DataFrame:
    """docs(start, ...) with shard, named by the part of `shard_bytes` of the corpus in which a document starts: a bound on what
    one task of `packed_records` holds, beyond one document."""
    return docs.withColumn("shard", F.format_string("%012d", F.expr(f"start div {shard_bytes}")))


def records(chunks: DataFrame, shard: str, record_id: int) -> DataFrame:
    """The chunks of one record; the filter reaches a table's scan."""
    return chunks.where((F.col("shard") == shard) & (F.col("record_id") == record_id))


def record_counts(chunks: DataFrame) -> DataFrame:
    """shard, records: as a reader counts that goes by the largest index, one less than there are."""
    return chunks.groupBy("shard").agg(F.max("record_id").cast("bigint").alias("records"))


def record_texts(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """The text of each chunk, cut from its document's payload."""
    joined = chunks.join(docs.select("shard", "doc_id", "start", "payload"), ["shard", "doc_id"])
    part = F.substr(F.col("payload"), (F.col("offset") - F.col("start") + 1).cast("int"), F.col("length"))
    return joined.select("shard", "record_id", "chunk_no", "doc_id", "offset", "length", F.decode(part, "UTF-8").alias("text"))


def visible_records(chunks: DataFrame) -> DataFrame:
    """Without each shard's last record, which a reader that counts by the largest index does not reach."""
    last = chunks.groupBy("shard").agg(F.max("record_id").alias("last"))
    return chunks.join(last, "shard").where("record_id < last").drop("last")


def record_bytes(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("shard", "record_id").agg(F.sum("length").alias("bytes"))


def _doubled(step: DataFrame, length: int, tag: str) -> DataFrame:
    """step(slot, to, chunks, positions) taken twice."""
    second = step.select(F.col("slot").alias("to"), F.col("to").alias("then"), F.col("chunks").alias("c2"), F.col("positions").alias("p2"))
    both = step.join(second, "to").select("slot", F.col("then").alias("to"), (F.col("chunks") + F.col("c2")).alias("chunks"), F.least(F.col("positions") + F.col("p2"), F.lit(length).cast("bigint")).alias("positions"))
    return written(both, tag)


def visits(records: DataFrame, count: int, length: int, samples: DataFrame) -> DataFrame:
    """sample, slot, part for every record that a sample takes: records(slot, chunks, positions) at slots 0 to count - 1, samples(sample).

    A sample takes the record at its slot, then the one `chunks` slots on, around the end, until it has `length` positions. Where
    2**k steps lead, and how many chunks and positions they take, is a table for each k, made from the one before by one
    join; a sample's steps are the largest such stretches that leave it short, and one more. Stretches are halved, all at
    once, down to single steps. Rounds are the logarithm of the longest sample's steps."""
    tables = [written(records.select("slot", ((F.col("slot") + F.col("chunks")) % count).alias("to"), F.col("chunks").cast("bigint").alias("chunks"), F.col("positions").cast("bigint").alias("positions")), "steps")]
    while (least := tables[-1].agg(F.min("positions")).first()[0]) is not None and least < length:
        if least == 0 and 1 << len(tables) - 1 >= count:
            raise ValueError("some records lead in a circle without any position")
        tables.append(_doubled(tables[-1], length, "steps"))
    short = samples.select("sample", F.col("sample").alias("slot"), F.lit(0).cast("bigint").alias("done"), F.lit(0).cast("bigint").alias("part"))
    single = lambda rows: rows.select("sample", "slot", "part")
    whole = short.join(tables[0].select("slot", F.col("positions").alias("own")), "slot")
    found = single(whole.where(F.col("own") >= length))
    at = whole.where(F.col("own") < length).select("sample", "slot", "done", "part")
    stretches: list[tuple[int, DataFrame]] = []
    for k in reversed(range(len(tables) - 1)):  # the last table's stretches are enough for any sample
        taken = F.col("done") + F.col("positions") < length
        moved = written(at.join(tables[k], "slot").withColumn("taken", taken), "moved")
        stretches.append((k, single(moved.where("taken"))))
        go = lambda a, b: F.when(F.col("taken"), a).otherwise(b)
        at = moved.select("sample", go(F.col("to"), F.col("slot")).alias("slot"), go(F.col("done") + F.col("positions"), F.col("done")).alias("done"), go(F.col("part") + F.col("chunks"), F.col("part")).alias("part"))
    found = found.unionByName(single(at))
    halves = None
    for k, rows in stretches:
        rows = rows if halves is None else rows.unionByName(halves)
        if k == 0:
            found = found.unionByName(rows)
            break
        step = tables[k - 1].select("slot", "to", "chunks")
        second = rows.join(step, "slot").select("sample", F.col("to").alias("slot"), (F.col("part") + F.col("chunks")).alias("part"))
        halves = written(rows.unionByName(second), "halves")
    return found


def sample_chunks(texts: DataFrame, order: DataFrame, config: SplitConfig, samples: DataFrame | None = None) -> DataFrame:
    """Pretraining samples: sample, part, text with its end of text, and the texts' other columns. texts(record, chunk_no, text), order(slot, record).

    A sample takes the record at its slot; while it has fewer positions than the sequence length it takes the record at slot +
    chunks so far, around the end."""
    n = order.count()
    sized = texts.withColumn("text", F.concat("text", F.lit("<|endoftext|>")))
    sized = sized.withColumn("n", F.size(text_to_words(prepared(F.col("text"), config.lowercase, True))) - 1)
    records = written(sized.groupBy("record").agg(F.count("*").alias("chunks"), F.sum("n").alias("positions")).join(order, "record"), "records")
    every = samples if samples is not None else order.select(F.col("slot").alias("sample"))
    taken = visits(records, n, config.sequence_length, every).join(records.select("slot", "record"), "slot")
    more = [c for c in texts.columns if c not in ("record", "chunk_no", "text")]
    return taken.join(sized, "record").select("sample", (F.col("part") + F.col("chunk_no")).alias("part"), "text", *more)
