"""The three-file document format: payload (.bin), index of start and size (.idx) and description (.meta.json)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: fixed types of the packed index's files
PACKED = {"indices": "<u4", "lengths": "<u2", "offsets": "<u8"}


def _open(path: str):
    fs, local = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(local)


def _write(path: str, data: bytes) -> None:
    fs, local = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    with fs.open_output_stream(local) as f:
        f.write(data)


def describe(prefix: str) -> dict:
    with _open(f"{prefix}.meta.json") as f:
        return json.loads(f.read())


def read_documents(spark: SparkSession, prefix: str, slices: int = 64) -> DataFrame:
    """doc_id, start, size, payload. Only the description is read on the driver; each task reads its part of the index and then
    its part of the payload. Starts and sizes count elements of the payload's type."""
    meta = describe(prefix)
    count, item, kind = int(meta["document_count"]), np.dtype(meta["dtype"]).itemsize, np.dtype(meta["index_dtype"])
    slices = max(1, min(slices, count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                lo, hi = k * count // slices, (k + 1) * count // slices
                with _open(f"{prefix}.idx") as f:
                    f.seek(lo * 2 * kind.itemsize)
                    index = np.frombuffer(f.read((hi - lo) * 2 * kind.itemsize), kind).reshape(-1, 2).astype(np.int64)
                with _open(f"{prefix}.bin") as f:
                    for at in range(0, len(index), 1000):
                        part = index[at : at + 1000]
                        data = []
                        for start, size in part:
                            f.seek(int(start) * item)
                            data.append(f.read(int(size) * item))
                        ids = np.arange(lo + at, lo + at + len(part))
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(part[:, 0]), pa.array(part[:, 1]), pa.array(data, pa.binary())], ["doc_id", "start", "size", "payload"])

    return spark.range(0, slices, 1, slices).mapInArrow(run, "doc_id bigint, start bigint, size bigint, payload binary")


def as_numbers(payload_col: str, dtype: str) -> F.Column:
    """Payload bytes of a signed 32-bit table as array<int>."""
    if np.dtype(dtype) != np.dtype("int32"):
        raise ValueError("only int32 payloads have a number form; uint8 payloads are texts")
    count = F.floor(F.octet_length(payload_col) / 4).cast("int")
    word = lambda i: F.conv(F.hex(F.concat(*[F.substr(F.col(payload_col), i * 4 + 4 - b, F.lit(1)) for b in range(4)])), 16, 10).cast("bigint")
    signed = lambda i: F.when(word(i) >= 1 << 31, word(i) - (1 << 32)).otherwise(word(i)).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), signed)).otherwise(F.array().cast("array<int>"))


def write_documents(docs: DataFrame, base: str, shard_col: str = "shard", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Three files `<base>/<shard>` for each shard, in id order; existing files are not overwritten. Texts are written as bytes,
    arrays of numbers as signed 32-bit ones. Returns shard, documents, bytes."""
    numbers = docs.schema[text_col].dataType.simpleString().startswith("array")
    dtype, item = ("int32", 4) if numbers else ("uint8", 1)
    payload = F.col(text_col).cast("array<int>") if numbers else F.encode(text_col, "UTF-8")
    slim = docs.select(F.col(shard_col).cast("string").alias("shard"), F.col(id_col).alias("doc_id"), payload.alias("payload"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        shard, payloads = table.column("shard")[0].as_py(), [p if p is not None else b"" for p in table.column("payload").to_pylist()]
        if numbers:
            payloads = [np.asarray(list(p), "<i4").tobytes() for p in payloads]
        prefix = f"{base.rstrip('/')}/{shard}"
        fs, local = pafs.FileSystem.from_uri(prefix) if "://" in prefix else (pafs.LocalFileSystem(), prefix)
        if fs.get_file_info(f"{local}.meta.json").type != pafs.FileType.NotFound:
            raise FileExistsError(prefix)
        size = np.array([len(p) // item for p in payloads], np.uint64)
        index = np.stack([np.cumsum(size) - size, size], axis=1).astype(np.uint64)
        _write(f"{prefix}.bin", b"".join(payloads))
        _write(f"{prefix}.idx", index.tobytes())
        _write(f"{prefix}.meta.json", json.dumps({"dtype": dtype, "index_dtype": "uint64", "document_count": len(payloads)}).encode())
        return pa.table({"shard": [shard], "documents": pa.array([len(payloads)], pa.int64()), "bytes": pa.array([int(size.sum()) * item], pa.int64())})

    return slim.groupBy("shard").applyInArrow(run, "shard string, documents bigint, bytes bigint")


def write_packed_index(chunks: DataFrame, base: str) -> DataFrame:
    """chunks(shard, record_id, chunk_no, offset, length): the packed index `<base>/<shard>` of each shard; existing files are not
    overwritten. Returns shard, chunks."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("record_id", "ascending"), ("chunk_no", "ascending")])
        prefix = f"{base.rstrip('/')}/{table.column('shard')[0].as_py()}"
        fs, local = pafs.FileSystem.from_uri(prefix) if "://" in prefix else (pafs.LocalFileSystem(), prefix)
        if fs.get_file_info(f"{local}.indices.bin").type != pafs.FileType.NotFound:
            raise FileExistsError(prefix)
        for name, column in (("lengths", "length"), ("offsets", "offset"), ("indices", "record_id")):
            values = table.column(column).to_numpy()
            if len(values) and values.max() > np.iinfo(PACKED[name]).max:
                raise ValueError(f"{column} {values.max()} does not fit into {PACKED[name]}")
            _write(f"{prefix}.{name}.bin", values.astype(PACKED[name]).tobytes())
        return pa.table({"shard": table.column("shard").slice(0, 1), "chunks": pa.array([table.num_rows], pa.int64())})

    return chunks.select("shard", "record_id", "chunk_no", "offset", "length").groupBy("shard").applyInArrow(run, "shard string, chunks bigint")


def read_packed_index(spark: SparkSession, prefix: str) -> DataFrame:
    """chunk, record_id, length, offset of a packed index (.indices.bin, .lengths.bin, .offsets.bin)."""
    kinds = PACKED
    with _open(f"{prefix}.indices.bin") as f:
        count = f.size() // 4
    slices = max(1, min(64, count // 10_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                lo, hi = k * count // slices, (k + 1) * count // slices
                cols = [pa.array(np.arange(lo, hi))]
                for name, kind in kinds.items():
                    with _open(f"{prefix}.{name}.bin") as f:
                        f.seek(lo * np.dtype(kind).itemsize)
                        cols.append(pa.array(np.frombuffer(f.read((hi - lo) * np.dtype(kind).itemsize), kind).astype(np.int64)))
                yield pa.RecordBatch.from_arrays(cols, ["chunk", "record_id", "length", "offset"])

    return spark.range(0, slices, 1, slices).mapInArrow(run, "chunk bigint, record_id bigint, length bigint, offset bigint")
