"""Spark data sources over shards of the binary formats: documents (.bin, .idx, .meta.json) and packed records (.indices.bin,
.lengths.bin, .offsets.bin), to read, to follow as a stream, and to write under a commit protocol.

Reading plans slices on the driver from the folder's listing and the shards' descriptions, never from their data; a task
reads its part of the index and the bytes that it points to, a bounded number at a time. Documents are numbered through all
shards in the order of the shards' names; filters on that number and on the shard are pushed down to the slices, so a lookup
opens one slice of one shard.

Writing streams each task's rows, in their order, into files in a hidden folder of the job; the driver's commit moves them into place,
the file that makes a shard visible last. A failed or killed attempt leaves nothing that a reader sees, a retried one
starts files of its own, and a shard that is there already is never overwritten.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

#: bytes of payload in a slice, and those that a task holds at once
SLICE_BYTES, BATCH_BYTES = 128 << 20, 4 << 20
#: index entries that a task holds at once
ENTRIES = 1 << 16
#: fixed types of the packed index's files
PACKED = {"indices": "<u4", "lengths": "<u2", "offsets": "<u8"}
DOCUMENTS, RECORDS = "lexloom-documents", "lexloom-records"
_END = 1 << 62


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    fs, local = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs, local.rstrip("/")


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentFiles)
    spark.dataSource.register(RecordFiles)


# ---- planning


@dataclass(frozen=True)
class Shard:
    """A shard's entries are numbered from `first` on; item: bytes of an element of the payload."""

    prefix: str
    name: str
    first: int
    count: int
    bytes: int
    item: int = 1
    index: str = "<u8"


def _visible(path: str, suffix: str) -> tuple[pafs.FileSystem, list[tuple[str, dict[str, int]]]]:
    """Prefixes of the shards in a folder in the order of their names, with the sizes of their files, or the one shard with the path as prefix."""
    fs, base = file_system(path)
    one = fs.get_file_info(base).type != pafs.FileType.Directory
    infos = fs.get_file_info(pafs.FileSelector(base.rpartition("/")[0] if one else base, allow_not_found=True))
    sizes = {i.path: i.size for i in infos if i.type == pafs.FileType.File}
    prefixes = sorted(p.removesuffix(suffix) for p in sizes if p.endswith(suffix))
    found = [p for p in prefixes if p == base] if one else prefixes
    if not found:
        raise FileNotFoundError(f"no shard at {path}")
    return fs, [(p, {q[len(p):]: n for q, n in ((p + s, sizes.get(p + s, 0)) for s in (".bin", ".idx", suffix))}) for p in found]


def document_shards(path: str) -> list[Shard]:
    fs, found = _visible(path, ".meta.json")

    def described(prefix: str) -> dict:
        with fs.open_input_stream(f"{prefix}.meta.json") as f:
            return json.loads(f.read())

    with ThreadPoolExecutor(32) as pool:
        metas = list(pool.map(described, [p for p, _ in found]))
    out, first = [], 0
    for (prefix, sizes), meta in zip(found, metas):
        kind = np.dtype(meta["index_dtype"])
        count = int(meta["document_count"])
        if sizes[".idx"] != count * 2 * kind.itemsize:
            raise ValueError(f"{prefix}.idx does not hold {count} entries")
        out.append(Shard(prefix, prefix.rpartition("/")[2], first, count, sizes[".bin"], np.dtype(meta["dtype"]).itemsize, kind.str))
        first += count
    return out


def record_shards(path: str) -> list[Shard]:
    _, found = _visible(path, ".indices.bin")
    out, first = [], 0
    for prefix, sizes in found:
        count = sizes[".indices.bin"] // 4
        out.append(Shard(prefix, prefix.rpartition("/")[2], first, count, 14 * count))
        first += count
    return out


@dataclass
class Bounds:
    """What the pushed filters leave: entries from lo to hi - 1, of these only `ids` if given; shards of these names only."""

    lo: int = 0
    hi: int = _END
    ids: set[int] | None = None
    names: set[str] | None = None

    def push(self, filters: list[Filter], number: str, name: str) -> Iterator[Filter]:
        """Takes in what it can and yields the rest."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            of_number = column == (number,)
            if isinstance(f, IsNotNull) and column in ((number,), (name,)):
                continue
            if isinstance(f, (EqualTo, In)) and column in ((number,), (name,)):
                values = set(value) if isinstance(f, In) else {value}
                old = self.ids if of_number else self.names
                values = values if old is None else values & old
                if of_number:
                    self.ids = values
                else:
                    self.names = values
            elif of_number and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.lo = max(self.lo, value + isinstance(f, GreaterThan))
            elif of_number and isinstance(f, (LessThan, LessThanOrEqual)):
                self.hi = min(self.hi, value + isinstance(f, LessThanOrEqual))
            else:
                yield f


@dataclass
class Slice(InputPartition):
    """Entries lo to hi - 1 of a shard, numbered in it from 0; of these only `ids` if given."""

    path: str
    shard: Shard
    lo: int
    hi: int
    ids: list[int] | None = None


def planned(path: str, shards: list[Shard], bounds: Bounds, slice_bytes: int) -> list[Slice]:
    out = []
    for s in shards:
        if bounds.names is not None and s.name not in bounds.names:
            continue
        lo, hi = max(0, bounds.lo - s.first), min(s.count, bounds.hi - s.first)
        if lo >= hi:
            continue
        if bounds.ids is not None:
            ids = sorted(i - s.first for i in bounds.ids if lo <= i - s.first < hi)
            out += [Slice(path, s, ids[0], ids[-1] + 1, ids)] if ids else []
            continue
        parts = max(1, min(hi - lo, -(-(s.bytes * (hi - lo)) // (max(1, s.count) * slice_bytes))))
        cuts = [lo + (hi - lo) * k // parts for k in range(parts + 1)]
        out += [Slice(path, s, a, b) for a, b in zip(cuts, cuts[1:])]
    return out


# ---- reading


def _entries(fs: pafs.FileSystem, part: Slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers in the shard, and (start, size) rows, ENTRIES at a time."""
    kind = np.dtype(part.shard.index)
    with fs.open_input_file(f"{part.shard.prefix}.idx") as f:

        def read(lo: int, hi: int) -> np.ndarray:
            f.seek(lo * 2 * kind.itemsize)
            return np.frombuffer(f.read((hi - lo) * 2 * kind.itemsize), kind).reshape(-1, 2).astype(np.int64)

        if part.ids is not None:
            for at in range(0, len(part.ids), ENTRIES):
                ids = part.ids[at : at + ENTRIES]
                yield np.array(ids, np.int64), np.concatenate([read(i, i + 1) for i in ids])
            return
        for lo in range(part.lo, part.hi, ENTRIES):
            hi = min(part.hi, lo + ENTRIES)
            yield np.arange(lo, hi, dtype=np.int64), read(lo, hi)


def _payloads(f: pa.NativeFile, index: np.ndarray, item: int) -> pa.Array:
    """The bytes that the entries point to, in one read if they follow each other."""
    starts, sizes = index[:, 0] * item, index[:, 1] * item
    if (starts[1:] == starts[:-1] + sizes[:-1]).all():
        f.seek(int(starts[0]))
        data = f.read_buffer(int(sizes.sum()))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), data])
    parts = []
    for start, size in zip(starts.tolist(), sizes.tolist()):
        f.seek(start)
        parts.append(f.read(size))
    return pa.array(parts, pa.binary())


def read_documents(part: Slice, columns: list[str]) -> Iterator[pa.RecordBatch]:
    fs, _ = file_system(part.path)
    shard, data = part.shard, None
    try:
        for ids, index in _entries(fs, part):
            cuts = [0]
            if "payload" in columns:
                data = data or fs.open_input_file(f"{shard.prefix}.bin")
                upto = np.cumsum(index[:, 1]) * shard.item
                while cuts[-1] < len(ids):  # at most BATCH_BYTES, a larger document alone
                    before = int(upto[cuts[-1] - 1]) if cuts[-1] else 0
                    cuts.append(max(cuts[-1] + 1, int(np.searchsorted(upto, before + BATCH_BYTES, side="right"))))
            else:
                cuts.append(len(ids))
            for a, b in zip(cuts, cuts[1:]):
                made = {
                    "doc_id": pa.array(ids[a:b] + shard.first), "shard": pa.array([shard.name] * (b - a)), "local_id": pa.array(ids[a:b]), "shard_documents": pa.array(np.full(b - a, shard.count)),
                    "start": pa.array(index[a:b, 0]), "size": pa.array(index[a:b, 1]),
                }
                if "payload" in columns:
                    made["payload"] = _payloads(data, index[a:b], shard.item)
                yield pa.RecordBatch.from_arrays([made[c] for c in columns], columns)
    finally:
        if data is not None:
            data.close()


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.slice_bytes, self.columns, self.bounds = options["path"], int(options.get("sliceBytes", SLICE_BYTES)), schema.names, Bounds()

    def pushFilters(self, filters):
        return self.bounds.push(filters, "doc_id", "shard")

    def partitions(self):
        return planned(self.path, document_shards(self.path), self.bounds, self.slice_bytes)

    def read(self, partition):  # none where no slice was planned
        return iter(()) if partition is None else read_documents(partition, self.columns)


class DocumentStream(DataSourceStreamReader):
    """Follows a folder to which shards are added. An offset counts documents in the order of the shards' names and names the last shard,
    so names have to ascend; a shard is read once, whatever stops the query in between."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.slice_bytes, self.columns = options["path"], int(options.get("sliceBytes", SLICE_BYTES)), schema.names

    def shards(self) -> list[Shard]:
        try:
            return document_shards(self.path)
        except FileNotFoundError:  # none has come yet
            return []

    def initialOffset(self):
        return {"documents": 0, "last": ""}

    def latestOffset(self):
        shards = self.shards()
        return {"documents": shards[-1].first + shards[-1].count, "last": shards[-1].name} if shards else self.initialOffset()

    def partitions(self, start, end):
        shards = self.shards()
        for offset in (start, end):
            upto = [s for s in shards if s.name <= offset["last"]]
            if sum(s.count for s in upto) != offset["documents"]:
                raise ValueError(f"shards up to {offset['last']} are not the {offset['documents']} documents that were read")
        return planned(self.path, shards, Bounds(start["documents"], end["documents"]), self.slice_bytes) or [None]

    def read(self, partition):
        return iter(()) if partition is None else read_documents(partition, self.columns)


class RecordReader(DataSourceReader):
    """Entries of packed indices. A shard's record numbers ascend, so a filter on record_id becomes a range found by a few reads."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.slice_bytes, self.columns, self.bounds = options["path"], int(options.get("sliceBytes", SLICE_BYTES)), schema.names, Bounds()

    def pushFilters(self, filters):
        for f in self.bounds.push([f for f in filters if not isinstance(f, In)], "record_id", "shard"):
            yield f
        yield from (f for f in filters if isinstance(f, In))

    def partitions(self):
        fs, _ = file_system(self.path)
        ids = self.bounds.ids
        lo, hi = max([self.bounds.lo, *(ids or [])]), min([self.bounds.hi, *(i + 1 for i in ids or [])])
        if ids is not None and not ids:
            return []
        out = []
        for s in record_shards(self.path):
            if self.bounds.names is not None and s.name not in self.bounds.names:
                continue
            a, b = 0, s.count
            if lo > 0 or hi < _END:
                with fs.open_input_file(f"{s.prefix}.indices.bin") as f:
                    a, b = _first_at_least(f, s.count, lo), _first_at_least(f, s.count, hi)
            out += planned(self.path, [s], Bounds(s.first + a, s.first + b), self.slice_bytes)
        return out

    def read(self, partition):
        if partition is None:
            return
        fs, _ = file_system(partition.path)
        for lo in range(partition.lo, partition.hi, ENTRIES):
            hi = min(partition.hi, lo + ENTRIES)
            made = {"shard": pa.array([partition.shard.name] * (hi - lo)), "chunk": pa.array(np.arange(lo, hi, dtype=np.int64))}
            for name, kind in PACKED.items():
                with fs.open_input_file(f"{partition.shard.prefix}.{name}.bin") as f:
                    f.seek(lo * np.dtype(kind).itemsize)
                    values = np.frombuffer(f.read((hi - lo) * np.dtype(kind).itemsize), kind)
                made[{"indices": "record_id", "lengths": "length", "offsets": "offset"}[name]] = pa.array(values.astype(np.int64))
            yield pa.RecordBatch.from_arrays([made[c] for c in self.columns], self.columns)


def _first_at_least(f: pa.NativeFile, count: int, record: int) -> int:
    lo, hi = 0, count
    while lo < hi:
        mid = (lo + hi) // 2
        f.seek(mid * 4)
        if int(np.frombuffer(f.read(4), "<u4")[0]) < record:
            lo = mid + 1
        else:
            hi = mid
    return lo


# ---- writing


@dataclass
class Made(WriterCommitMessage):
    """The shards of one task: name, number of entries."""

    folder: str = ""
    shards: list[tuple[str, int]] = field(default_factory=list)


class ShardWriter(DataSourceArrowWriter):
    """Streams rows into the files of the shard that their `shard` column names, or of one shard for each task. Rows of a shard have to
    come together; a shard that comes twice, in a task or in two, fails the job at its commit."""

    #: suffixes of a shard's files in the order in which they are put into place
    suffixes: tuple[str, ...] = ()

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        if overwrite:
            raise ValueError("shards are never overwritten: use mode append")
        self.path, self.columns, self.job = options["path"], schema.names, uuid.uuid4().hex
        self.types = dict(zip(schema.names, (f.dataType.simpleString() for f in schema.fields)))

    def hidden(self) -> str:
        return f"{self.path.rstrip('/')}/_job-{self.job}"

    def encoded(self, batch: pa.RecordBatch, state: dict) -> dict[str, bytes]:
        """The bytes to append to each file for the next rows of a shard."""
        raise NotImplementedError

    def description(self, entries: int) -> dict[str, bytes]:
        """Files that are written when a shard is whole."""
        return {}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Made:
        from pyspark import TaskContext

        folder = f"{self.hidden()}/{uuid.uuid4().hex}"
        fs, local = file_system(folder)
        made, name, files, state = Made(folder), None, {}, {}

        def close() -> None:
            for f in files.values():
                f.close()
            files.clear()
            for suffix, data in self.description(state.get("entries", 0)).items():
                with fs.open_output_stream(f"{local}/{name}{suffix}") as f:
                    f.write(data)
            made.shards.append((name, state.get("entries", 0)))

        for batch in iterator:
            if not batch.num_rows:
                continue
            shards = batch.column(self.columns.index("shard")).to_pylist() if "shard" in self.columns else [f"part-{TaskContext.get().partitionId():06d}"] * batch.num_rows
            if any(not s or "/" in s or s[0] in "._" for s in shards):
                raise ValueError("a shard's name is null, hidden or has a slash")
            cuts = [0, *(i for i in range(1, len(shards)) if shards[i] != shards[i - 1]), len(shards)]
            for a, b in zip(cuts, cuts[1:]):
                if shards[a] != name:
                    if name is not None:
                        close()
                    name, state = shards[a], {}
                    fs.create_dir(local)
                part = batch.slice(a, b - a)
                for suffix, data in self.encoded(part, state).items():
                    if suffix not in files:
                        files[suffix] = fs.open_output_stream(f"{local}/{name}{suffix}")
                    files[suffix].write(data)
                state["entries"] = state.get("entries", 0) + part.num_rows
        if name is not None:
            close()
        return made

    def commit(self, messages: list[Made | None]) -> None:
        fs, base = file_system(self.path)
        made = [(m.folder, name) for m in messages if m is not None for name, _ in m.shards]
        names = [name for _, name in made]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of a shard came from two places: sort and partition by shard")
        there = [i.path for i in fs.get_file_info([f"{base}/{n}{self.suffixes[-1]}" for n in names]) if i.type != pafs.FileType.NotFound] if names else []
        if there:
            self.abort(messages)
            raise FileExistsError(f"{there[0]} exists")
        fs.create_dir(base)
        for suffix in self.suffixes:  # all shards' data first, then what makes them visible
            for folder, name in made:
                fs.move(f"{file_system(folder)[1]}/{name}{suffix}", f"{base}/{name}{suffix}")
        self.abort(messages)

    def abort(self, messages: list[Made | None]) -> None:
        """Removes the job's hidden folder, with what lost attempts left there."""
        fs, local = file_system(self.hidden())
        if fs.get_file_info(local).type == pafs.FileType.Directory:
            fs.delete_dir(local)


class DocumentWriter(ShardWriter):
    """payload: bytes, text, or an array of numbers, which are stored as signed 32-bit ones; null is empty."""

    suffixes = (".bin", ".idx", ".meta.json")

    @property
    def numbers(self) -> bool:
        return self.types["payload"].startswith("array")

    def encoded(self, batch: pa.RecordBatch, state: dict) -> dict[str, bytes]:
        column = batch.column(self.columns.index("payload"))
        if self.numbers:
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.uint64)
            values = column.flatten().to_numpy(zero_copy_only=False)
            if len(values) and (values.dtype.kind == "f" or values.min() < -(1 << 31) or values.max() >= 1 << 31):
                raise ValueError("a number is null or does not fit into 32 bits")
            data = values.astype("<i4").tobytes()
        else:
            column = column.cast(pa.large_binary())
            size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.uint64)
            data = b"".join(x for x in column.to_pylist() if x)
        ends = np.cumsum(size, dtype=np.uint64) + np.uint64(state.get("at", 0))
        state["at"] = int(ends[-1])
        return {".bin": data, ".idx": np.stack([ends - size, size], axis=1).astype("<u8").tobytes()}

    def description(self, entries: int) -> dict[str, bytes]:
        return {".meta.json": json.dumps({"dtype": "int32" if self.numbers else "uint8", "index_dtype": "uint64", "document_count": entries}).encode()}


class RecordWriter(ShardWriter):
    suffixes = (".lengths.bin", ".offsets.bin", ".indices.bin")

    def encoded(self, batch: pa.RecordBatch, state: dict) -> dict[str, bytes]:
        out = {}
        for name, column in (("lengths", "length"), ("offsets", "offset"), ("indices", "record_id")):
            values = batch.column(self.columns.index(column)).to_numpy(zero_copy_only=False)
            if values.dtype.kind == "f" or values.min() < 0 or values.max() > np.iinfo(PACKED[name]).max:
                raise ValueError(f"{column}: a value does not fit into {PACKED[name]}")
            out[f".{name}.bin"] = values.astype(PACKED[name]).tobytes()
        ids = np.frombuffer(out[".indices.bin"], "<u4")
        if (np.diff(ids.astype(np.int64)) < 0).any() or ids[0] < state.get("last", 0):
            raise ValueError("record numbers have to ascend")
        state["last"] = ids[-1]
        return out


class DocumentFiles(DataSource):
    """Options: path, of a folder or of one shard without suffix; sliceBytes; payload, "false" to read indices only."""

    @classmethod
    def name(cls):
        return DOCUMENTS

    def schema(self):
        return "doc_id bigint, shard string, local_id bigint, shard_documents bigint, start bigint, size bigint" + ("" if self.options.get("payload", "true") == "false" else ", payload binary")

    def reader(self, schema):
        return DocumentReader(self.options, schema)

    def streamReader(self, schema):
        return DocumentStream(self.options, schema)

    def writer(self, schema, overwrite):
        return DocumentWriter(self.options, schema, overwrite)


class RecordFiles(DataSource):
    @classmethod
    def name(cls):
        return RECORDS

    def schema(self):
        return "shard string, chunk bigint, record_id bigint, length bigint, offset bigint"

    def reader(self, schema):
        return RecordReader(self.options, schema)

    def writer(self, schema, overwrite):
        return RecordWriter(self.options, schema, overwrite)


# ---- the formats as functions


def read(spark: SparkSession, path: str, payload: bool = True, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    register(spark)
    return spark.read.format(DOCUMENTS).option("sliceBytes", slice_bytes).option("payload", str(payload).lower()).load(path)


def follow(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.readStream.format(DOCUMENTS).load(path)


def write(docs: DataFrame, path: str, order: list[str], payload_col: str = "text", shard_col: str | None = None) -> None:
    """Documents in order: a shard for each value of shard_col, or for each range of the order."""
    register(docs.sparkSession)
    payload = F.col(payload_col).alias("payload")
    if shard_col is None:
        ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order).select(payload)
    else:
        ranged = docs.repartition(shard_col).sortWithinPartitions(shard_col, *order).select(F.col(shard_col).cast("string").alias("shard"), payload)
    ranged.write.format(DOCUMENTS).mode("append").save(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format(RECORDS).load(path)


def write_records(chunks: DataFrame, path: str) -> None:
    """chunks(shard, record_id, chunk_no, offset, length): one packed index for each shard."""
    register(chunks.sparkSession)
    ordered = chunks.repartition("shard").sortWithinPartitions("shard", "record_id", "chunk_no")
    ordered.select("shard", "record_id", "length", "offset").write.format(RECORDS).mode("append").save(path)
