"""Resumable ingest of shards: documents go to a corpus table exactly once, and every name has a state that is kept across restarts.

The stream's offsets are positions in the shards (`shard_files.DocumentStream`); the corpus is written by the file sink, whose log
makes a repeated batch harmless. The state of a name is COMPLETE when all documents that are expected of it have come,
FAILED when one of them is no valid UTF-8 or more have come than expected, and INCOMPLETE before. Each task sums up its own rows first,
so a name that holds most of the documents sends one row for each batch of each task to its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from lexloom.sources import shard_files

COMPLETE, INCOMPLETE, FAILED = "COMPLETE", "INCOMPLETE", "FAILED"
STATUS = "name string, at bigint, state string, documents bigint, bytes bigint"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name, documents, bytes, broken: one row for each name of a batch."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by("name").aggregate([("size", "count"), ("size", "sum"), ("broken", "sum")])
        table = table.select(["name", "size_count", "size_sum", "broken_sum"]).rename_columns(["name", "documents", "bytes", "broken"])
        yield from table.cast(pa.schema([("name", pa.string()), *[(n, pa.int64()) for n in ("documents", "bytes", "broken")]])).combine_chunks().to_batches()


class NameStatus(StatefulProcessor):
    """State of a name: updates so far, documents, bytes, broken documents. One status row for each batch that brings something."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "at bigint, documents bigint, bytes bigint, broken bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, documents, size, broken = self.seen.get() if self.seen.exists() else (0, 0, 0, 0)
        expected = None
        for part in rows:
            documents, size, broken = documents + int(part["documents"].sum()), size + int(part["bytes"].sum()), broken + int(part["broken"].sum())
            expected = part["expected"].iloc[0]
        self.seen.update((at + 1, documents, size, broken))
        known = expected is not None and not pd.isna(expected)
        failed = broken or known and documents > expected
        state = FAILED if failed else COMPLETE if known and documents == expected else INCOMPLETE
        yield pd.DataFrame({"name": [key[0]], "at": [at + 1], "state": [state], "documents": [documents], "bytes": [size]})

    def close(self) -> None:
        pass


def status_rows(docs: DataFrame, name: Column, expected: DataFrame) -> DataFrame:
    """Status rows of a stream of documents (payload, ...); expected(name, documents): a name that it lacks stays INCOMPLETE."""
    slim = docs.select(name.alias("name"), F.octet_length("payload").cast("bigint").alias("size"), (~F.is_valid_utf8(F.col("payload").cast("string"))).cast("int").alias("broken"))
    sums = slim.mapInArrow(_sums, "name string, documents bigint, bytes bigint, broken bigint")
    sums = sums.join(expected.select("name", F.col("documents").alias("expected")), "name", "left")
    return sums.groupBy("name").transformWithStateInPandas(NameStatus(), outputStructType=STATUS, outputMode="Append", timeMode="None")


def start_status(docs: DataFrame, name: Column, expected: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    docs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    rows = status_rows(docs, name, expected)
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def start_corpus(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return docs.select("doc_id", "shard", "size", "payload").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(spark: SparkSession, shards: str, base: str, name: Column, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Takes in what has come to the folder of shards since the last call with this base, and returns the corpus and all status
    rows. A call after a stop in the middle goes on where the last finished batch ended."""
    docs = shard_files.follow(spark, shards)
    running = [start_corpus(docs, f"{base}/corpus", f"{base}/corpus-log"), start_status(docs, name, expected, f"{base}/status", f"{base}/status-log")]
    for q in running:
        q.awaitTermination()
    return spark.read.schema("doc_id bigint, shard string, size bigint, payload binary").parquet(f"{base}/corpus"), spark.read.schema(STATUS).parquet(f"{base}/status")
