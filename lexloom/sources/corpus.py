"""Document tables: write once with offsets, look up, range reads, validation, ingest status, packed-index cache."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.sources.scratch import in_order


def with_offsets(docs: DataFrame, id_col: str, size: Column) -> DataFrame:
    """docs with size and start, the sum of all sizes before in id order: null ids first, rows with equal ids in any order."""
    return in_order(docs.withColumn("size", size.cast("bigint")), [F.col(id_col)], "start", F.col("size"))


def write_corpus(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """doc_id, payload, start, size as Parquet; an existing table is never overwritten."""
    payload = docs.select(F.col(id_col).alias("doc_id"), F.encode(text_col, "UTF-8").alias("payload"))
    with_offsets(payload, "doc_id", F.octet_length("payload")).write.mode("error").parquet(path)


def open_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lookup(corpus: DataFrame, idx: int) -> DataFrame:
    """One document; the filter reaches the Parquet scan."""
    if isinstance(idx, bool) or not isinstance(idx, int):
        raise NotImplementedError("an index is an integer")
    return corpus.where(F.col("doc_id") == idx)


def index_of(corpus: DataFrame, idx: int) -> DataFrame:
    return lookup(corpus, idx).select("start", "size")


def read_range(payload: Column, start: int, size: int) -> Column:
    """Bytes [start, start + size) of a payload."""
    return F.substr(payload, F.lit(start + 1), F.lit(size))


def sizes(corpus: DataFrame) -> DataFrame:
    return corpus.select("doc_id", "size")


def scan(corpus: DataFrame) -> DataFrame:
    return corpus.orderBy("doc_id")


def mismatches(written: DataFrame, source: DataFrame, every: int = 10_000) -> DataFrame:
    """Ids of every `every`-th and of the last document whose written payload differs from the source's text or is missing."""
    last = source.agg(F.max("doc_id").alias("last"))
    want = source.crossJoin(F.broadcast(last)).where((F.col("doc_id") % every == 0) | (F.col("doc_id") == F.col("last"))).select("doc_id", F.encode("text", "UTF-8").alias("want"))
    return want.join(written.select("doc_id", "payload"), "doc_id", "left").where(~F.col("want").eqNullSafe(F.col("payload"))).select("doc_id")


def validate(written: DataFrame, source: DataFrame, every: int = 10_000) -> None:
    if not (bad := mismatches(written, source, every)).isEmpty():
        raise ValueError(f"written documents differ: {[r[0] for r in bad.limit(5).collect()]}")


def pending(names: DataFrame, status: DataFrame, key: str = "name") -> DataFrame:
    """Names that are not complete yet; status(name, state)."""
    return names.join(status.where("state = 'COMPLETE'").select(key), key, "left_anti")


def latest_status(events: DataFrame, key: str = "name") -> DataFrame:
    """The last state of each name; events(name, at, state)."""
    return events.groupBy(key).agg(F.max_by("state", "at").alias("state"))


def materialised(spark: SparkSession, base: str, params: dict, build) -> DataFrame:
    """build() written under a name made of its parameters, or what is there already."""
    name = hashlib.md5(json.dumps(params, sort_keys=True).encode()).hexdigest()
    path = f"{base.rstrip('/')}/{name}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def jsonl_lines(spark: SparkSession, path: str) -> DataFrame:
    """line: stripped lines of text files, without blank ones."""
    return kept_lines(spark.read.text(path).select(F.col("value").alias("line")))


def kept_lines(lines: DataFrame) -> DataFrame:
    return lines.select(F.regexp_replace("line", r"^\s+|\s+$", "").alias("line")).where("line <> ''")
