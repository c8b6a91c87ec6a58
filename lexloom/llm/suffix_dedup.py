"""Repeated passages by sparse suffix arrays.

Of all suffixes of all texts, those that start at a minimiser (see winnow) are kept: a passage of `window` words that
occurs twice has a minimiser at the same place in both. A suffix is held as its minimiser's number, the words that follow it
and, reversed, the words before it, as far as a window can reach.

1. Spark counts minimisers; suffixes with one that occurs once have no neighbour and go, with the texts that hold no other.
2. The rest are sorted by minimiser, following words and preceding words: the suffix array, dealt by minimiser. A frequent
   minimiser's suffixes are dealt to several parts.
3. Each suffix is compared with its neighbours, and the match is extended left and right; if it spans `window` words or more,
   its words are repeated. Where a minimiser has three suffixes or more, a partner need not be next to it: all windows around
   them are numbered and those that occur twice are repeated. Windows of minimisers in several parts are counted over all
   parts, after each part has counted its own. Texts with equal digests count as one text that repeats as a whole.

Defined results: words are maximal runs of characters other than blank and U+0009 to U+000D, unchanged. A null text has no
words; texts of fewer words than a window have no spans. Repeated rows are copies of each other. An empty table gives no
rows; other columns are neither read nor returned. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import words
from lexloom.llm.common import written
from lexloom.llm.winnow import Winnow, outline, places

#: suffixes compared at once; the suffixes of one minimiser in a part stay together
BLOCK = 30_000
#: suffixes of one minimiser in a part, about
PART = 10_000


@dataclass(frozen=True)
class SuffixDedupConfig:
    """gram: words of a minimiser."""

    window: int = 50
    gram: int = 20

    @property
    def reach(self) -> int:
        return self.window - self.gram


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of the given sizes in words of 4 bytes, one after another in data."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * 4
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of the given sizes one after another: each entry's row and place in it."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _suffixes(winnow: Winnow, reach: int):
    """(digest, pos, anchor, parts, part, after, before) for each minimiser of a text that recurs; a word is 4 bytes. The suffixes
    of a frequent minimiser are dealt to several parts by text and position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            of = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
            w = words.words_of(of("text"))
            x = w.numbers()
            grams = winnow.grams(x)
            p = winnow.selected(grams, winnow.anchors(grams, w.bounds))
            wanted = of("anchors")
            flat = wanted.flatten()
            at = places(w.text_of[p], grams[p], wanted, flat.field("anchor"))
            p, at = p[at >= 0], at[at >= 0]
            text = w.text_of[p]
            narrow = (x >> np.uint64(32)).astype(">u4")
            after = np.minimum(reach, w.bounds[text + 1] - p - winnow.gram)
            before = np.minimum(reach, p - w.bounds[text])
            row, place = _spread(after)
            right = _binary(narrow[p[row] + winnow.gram + place], after)
            row, place = _spread(before)
            left = _binary(narrow[p[row] - 1 - place], before)
            pos = p - w.bounds[text]
            name = np.frombuffer(b"".join(d[:8] for d in of("digest").to_pylist()), np.uint64)
            parts = flat.field("parts").to_numpy()[at]
            part = words.mixed(name[text] + pos.astype(np.uint64)) % parts.astype(np.uint64)
            arrays = [of("digest").take(pa.array(text)), pa.array(pos), pa.array(grams[p].view(np.int64)), pa.array(parts), pa.array(part.astype(np.int32)), right, left]
            yield pa.RecordBatch.from_arrays(arrays, ["digest", "pos", "anchor", "parts", "part", "after", "before"])

    return run


def _matrix(column: pa.Array, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, sizes): the rows' words, filled up with zeros."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 4
    data = np.frombuffer(column.buffers()[2] or b"", ">u4")[offsets[0] : offsets[-1]].astype(np.uint64)
    sizes = np.diff(offsets)
    out = np.zeros((len(column), reach), np.uint64)
    row, place = _spread(sizes)
    out[row, place] = data
    return out, sizes


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal entries at the start of each row, `most` of them at most."""
    same = np.ones((len(a), a.shape[1] + 1), bool)
    same[:, :-1] = a == b
    same[:, -1] = False
    return np.minimum(same.argmin(axis=1), most)


def _prefixes(m: np.ndarray) -> np.ndarray:
    """A number for each prefix of each row, the empty one first."""
    out = np.zeros((len(m), m.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(m.shape[1]):
            out[:, k + 1] = words.mixed(out[:, k] + m[:, k] + np.uint64(1))
    return out


FOUND = "digest binary, low bigint, high bigint, number bigint, n int"


def _found(digests: pa.Array, row: np.ndarray, low: np.ndarray, high: np.ndarray | None, number: np.ndarray | None, n: int) -> pa.RecordBatch:
    size = len(low)
    none = pa.nulls(size, pa.int64())
    return pa.RecordBatch.from_arrays(
        [digests.take(pa.array(row)), pa.array(low), none if high is None else pa.array(high), none if number is None else pa.array(number.view(np.int64)), pa.array(np.full(size, n, np.int32))],
        ["digest", "low", "high", "number", "n"],
    )


def _compared(table: pa.Table, config: SuffixDedupConfig) -> Iterator[pa.RecordBatch]:
    """Matches among sorted suffixes; those of a minimiser with several parts may have their match in another."""
    anchor, open_ = table.column("anchor").to_numpy(), table.column("parts").to_numpy() > 1
    starts = np.flatnonzero(_changes(table))
    sizes = np.diff(np.append(starts, len(anchor)))
    group, _ = _spread(sizes)
    used = np.flatnonzero((sizes[group] > 1) | open_)
    if not len(used):
        return
    table = table.take(pa.array(used)).combine_chunks()
    anchor, group, sizes, border = anchor[used], group[used], sizes[group[used]], open_[used]
    digests, pos = table.column("digest").chunk(0), table.column("pos").to_numpy()
    (after, n_after), (before, n_before) = (_matrix(table.column(c).chunk(0), config.reach) for c in ("after", "before"))
    # two suffixes are neighbours: how far the words agree on both sides
    j = np.flatnonzero((group[1:] == group[:-1]) & (sizes[1:] == 2) & ~border[1:]) + 1
    right = _common(after[j], after[j - 1], np.minimum(n_after[j], n_after[j - 1]))
    left = _common(before[j], before[j - 1], np.minimum(n_before[j], n_before[j - 1]))
    hit = left + config.gram + right >= config.window
    j, left, right = j[hit], left[hit], right[hit]
    for row in (j, j - 1):
        yield _found(digests, row, pos[row] - left, pos[row] + config.gram + right, None, 0)
    # among three or more, a window's partner need not be the neighbour: all windows around them, by words after the minimiser
    many = np.flatnonzero((sizes > 2) | border)
    if not len(many):
        return
    ahead, behind = _prefixes(after[many]), _prefixes(before[many])
    shown, edge = np.zeros((len(many), config.reach + 1), bool), border[many]
    for r in range(config.reach + 1):
        rows = np.flatnonzero((n_after[many] >= r) & (n_before[many] >= config.reach - r))
        with np.errstate(over="ignore"):
            numbers = words.mixed(words.mixed(words.mixed(ahead[rows, r] + np.uint64(r)) ^ behind[rows, config.reach - r]) ^ anchor[many[rows]].view(np.uint64))
        order = np.argsort(numbers)
        same = numbers[order][1:] == numbers[order][:-1]
        twice = np.zeros(len(rows), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        shown[rows[twice], r] = True
        # windows that may have a partner in another part
        open_ = rows[edge[rows] & ~twice]
        if len(open_):
            yield _found(digests, many[open_], pos[many[open_]] - config.reach + r, None, numbers[edge[rows] & ~twice], 1)
        if (known := np.unique(numbers[edge[rows] & twice])).size:
            zero = np.zeros(len(known), np.int64)
            yield _found(digests, zero, zero, None, known, 2)
    steps = np.diff(np.pad(shown.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(steps == 1)
    last = np.nonzero(steps == -1)[1] - 1
    at = pos[many[row]] - config.reach
    yield _found(digests, many[row], at + first, at + last + config.window, None, 0)


def _changes(table: pa.Table) -> np.ndarray:
    """Whether each row begins another minimiser or part."""
    out = np.ones(table.num_rows, bool)
    anchor, part = table.column("anchor").to_numpy(), table.column("part").to_numpy()
    out[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])
    return out


def _neighbours(config: SuffixDedupConfig):
    """Over sorted suffixes: spans (digest, low, high), and open windows (digest, low, number) of minimisers with several parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, limit = [], 0, BLOCK
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < limit:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.flatnonzero(_changes(table))[-1])
            if not cut:
                held, limit = table.to_batches(), 2 * rows
                continue
            yield from _compared(table.slice(0, cut), config)
            held, rows, limit = table.slice(cut).to_batches(), rows - cut, BLOCK
        if rows:
            yield from _compared(pa.Table.from_batches(held).combine_chunks(), config)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each text, merged where they touch."""
    for batch in batches:
        lists = batch.column(1)
        flat = lists.flatten()
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        low, high = flat.field("low").to_numpy(), flat.field("high").to_numpy()
        order = np.lexsort((low, row))
        row, low, high = row[order], low[order], high[order]
        wide = int(high.max(initial=0)) + 1  # texts apart, so that one running maximum serves all
        reach = np.maximum.accumulate(high + row * wide) - row * wide
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (low[1:] > reach[:-1])
        begin = np.flatnonzero(first)
        last = np.append(begin[1:], len(row)) - 1 if len(row) else begin
        spans = pa.StructArray.from_arrays([pa.array(low[begin]), pa.array(reach[last])], ["start", "end"])
        offsets = np.searchsorted(row[begin], np.arange(len(lists) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), spans)], ["digest", "spans"])


def repeated_spans(docs: DataFrame, config: SuffixDedupConfig = SuffixDedupConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_repeated, spans (start and end in words, the end exclusive): one row for each row of docs."""
    winnow = Winnow(config.window, config.gram)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    outlined = written(slim.mapInArrow(outline(winnow), f"doc_id {id_type}, digest binary, n_words bigint, anchors array<bigint>"), "outline")

    # both joins below read the same copies: said here that digests are not null, for else one of them is read with that filter
    some = outlined.where((F.size("anchors") > 0) & F.col("digest").isNotNull())
    copies = some.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    # a text that occurs twice is no neighbour of its own copy, repeats in a text are: one copy's anchors, shuffled as a list
    each = some.groupBy("digest").agg(F.first("anchors").alias("anchors")).select("digest", F.explode("anchors").alias("anchor"))
    inside = each.groupBy("digest", "anchor").agg(F.count("*").alias("n"))
    recurring = inside.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    of_text = inside.select("digest", "anchor").join(recurring, "anchor").groupBy("digest").agg(F.collect_list(F.struct("anchor", "parts")).alias("anchors"))
    wanted = of_text.join(copies, "digest")
    keyed = slim.where("text is not null").withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    # always by a shuffle, so that the plan is the same at every size
    texts = keyed.join(wanted.hint("merge"), (keyed["digest"] == wanted["digest"]) & keyed["doc_id"].eqNullSafe(wanted["first_id"])).drop(wanted["digest"])
    texts = texts.dropDuplicates(["digest", "first_id"]).select("digest", "text", "anchors")
    suffixes = texts.mapInArrow(_suffixes(winnow, config.reach), "digest binary, pos bigint, anchor bigint, parts int, part int, after binary, before binary")
    sorted_ = suffixes.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "after", "before")
    found = written(sorted_.mapInArrow(_neighbours(config), FOUND), "found")
    open_ = found.where("number is not null")
    twice = open_.groupBy("number").agg(F.sum("n").alias("total")).where("total > 1").select("number")
    across = open_.where("n = 1").join(twice.hint("merge"), "number").select("digest", "low", (F.col("low") + config.window).alias("high"))
    matches = found.where("number is null").select("digest", "low", "high").union(across)
    gathered = matches.groupBy("digest").agg(F.collect_set(F.struct("low", "high")).alias("s"))
    spans = gathered.mapInArrow(_merged, "digest binary, spans array<struct<start:bigint,end:bigint>>")
    out = outlined.drop("anchors").join(spans, "digest", "left").join(copies.select("digest", "copies"), "digest", "left")
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    out = out.withColumn("spans", F.when((F.col("copies") > 1) & (F.col("n_words") >= config.window), whole).otherwise(F.coalesce("spans", none)))
    total = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", total.alias("n_repeated"), "spans")
