"""Packing documents into fixed-length token sequences with few sequences.

Tokens are counted and hashed once and written as a table of pieces. The pieces are dealt evenly to shards; each shard
packs its own by best fit (longest first) and then improves the result by local search: moves, one-for-one and
two-for-one exchanges between underfull bins, which raise squared fills until bins empty and nothing improves. The least
filled bins of each shard are gathered, those of 64 shards together, and packed once more where that takes fewer bins.

Defined results: a null text is empty; an empty text is the end token alone. Only documents longer than a sequence are
cut, into full pieces and a last one that may be shorter. Null or repeated ids are carried along and never used as keys.
An empty table gives no rows; other columns are neither read nor returned. A text of any length is read whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import written
from lexloom.llm.words import slices, words_of

#: bytes of text cut into words at once
BATCH_BYTES = 2 << 20
#: pieces that a task packs; shards whose least filled bins are packed again together
SHARD_PIECES = 30_000
FAN_IN = 64


def _classes() -> tuple[str, str]:
    """Letters and numbers below U+0180, as parts of a character class."""
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)
    return of("L"), of("N")


_L, _N = _classes()
#: texts without these characters take the fast path: there, splitting is the same as the tokenizer's own
UNUSUAL = r"[^\x00-\x1b\x20-\x{84}\x{86}-\x{12f}\x{131}-\x{17f}]|<\|"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\t\n\v\f\r \xa0{_L}{_N}]+")


class _KnownWords:
    """Ids of words met so far, by the words' numbers, in three arrays; emptied beyond LIMIT words, which changes no result."""

    LIMIT = 1_000_000

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.numbers, self.starts, self.sizes = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def places(self, numbers: np.ndarray) -> np.ndarray:
        """Index of each number, -1 where it is not known."""
        if not len(self.numbers):
            return np.full(len(numbers), -1)
        at = np.minimum(np.searchsorted(self.numbers, numbers), len(self.numbers) - 1)
        return np.where(self.numbers[at] == numbers, at, -1)

    def add(self, numbers: np.ndarray, made: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(made), np.uint32, int(sizes.sum()))])
        numbers = np.concatenate([self.numbers, numbers])
        order = np.argsort(numbers)
        self.numbers, self.starts, self.sizes = numbers[order], np.concatenate([self.starts, starts])[order], np.concatenate([self.sizes, sizes])[order]


#: each byte as the character that stands for it in the vocabulary: printable ones as they are, the rest from U+0100 on
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}


class WordTokenizer:
    """Token ids of whole texts by the tokenizers library.

    The vocabulary file drops white space, splits lower-case text into pieces and encodes each piece alone, so that the ids of a
    word are asked for once and kept while a task lasts. Texts with unusual characters go through the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _KnownWords()

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        cut, pieces, out = self.tokenizer.model.tokenize, {}, []
        for word in words:
            if not word.isascii():
                split = [p.encode().decode("latin-1").translate(_BYTE_CHARS) for p in PIECES.findall(word)]
            elif word.isalpha():
                split = (word,)
            else:
                split = [p if p.isprintable() else p.translate(_BYTE_CHARS) for p in PIECES.findall(word)]
            ids: list[int] = []
            for piece in split:
                got = pieces.get(piece)
                if got is None:
                    got = pieces[piece] = [t.id for t in cut(piece)]
                ids += got
            out.append(ids)
        return out

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        w = words_of(pc.replace_substring(pc.utf8_lower(texts), "\u00a0", " "))
        codes, distinct = pd.factorize(w.numbers())
        places = self.known.places(distinct)
        if (missing := np.flatnonzero(places < 0)).size:
            if len(self.known.numbers) + missing.size > _KnownWords.LIMIT:
                self.known.clear()
                missing = np.arange(len(distinct))
            first = np.empty(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            data = w.data.tobytes()
            spans = zip(w.starts[first[missing]].tolist(), w.ends[first[missing]].tolist())
            self.known.add(distinct[missing], self._encode_words([data[a:b].decode("utf-8", "surrogatepass") for a, b in spans]))
            places = self.known.places(distinct)
        at = places[codes]
        sizes = self.known.sizes[at]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.known.ids[np.repeat(self.known.starts[at] - upto[:-1], sizes) + np.arange(upto[-1])]
        return ids, upto[w.bounds]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin; null texts have none."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, UNUSUAL)
        ids, bounds = self._plain(pc.if_else(odd, "", texts))
        if not (rows := np.flatnonzero(odd.to_numpy(zero_copy_only=False))).size:
            return ids, bounds
        whole = self.tokenizer.encode_batch_fast([texts[int(i)].as_py() for i in rows], add_special_tokens=False)
        parts, done = [], 0
        sizes = np.diff(bounds)
        for i, e in zip(rows.tolist(), whole):
            parts += [ids[done : bounds[i]], np.asarray(e.ids, np.uint32)]
            done, sizes[i] = bounds[i], len(e.ids)
        return np.concatenate([*parts, ids[done:]]), np.concatenate([[0], np.cumsum(sizes)])


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and deal, an evenly spread number; one pass, no shuffle."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, made = WordTokenizer(tokenizer_path), 0
        for batch in slices(batches, 1, BATCH_BYTES):
            ids, bounds = tok.encode(batch.column(1))
            sizes = np.diff(bounds) + 1
            count = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, sizes[row] - start)
            # every text's ids with the end token behind them
            data = np.insert(ids.astype("<u4"), bounds[1:], end_id)
            at = bounds[:-1][row] + row + start
            flat = memoryview(data).cast("B")
            crc = np.fromiter((zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())), np.int64, len(row))
            deal = (crc * 2654435761 + (made + np.arange(len(row))) * 40503) % (1 << 31)
            made += len(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(deal)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "deal"],
            )

    return slim.mapInArrow(run, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, deal bigint")


class _Bins:
    """Bins by free room, and the sizes that underfull bins hold. Sets of room are bits of an integer: bit f of ``open`` is set
    where a bin has f free tokens, bit f of ``rooms[z]`` where one of these holds an item of size z."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.fill = capacity, [], []
        self.at: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.open = 0

    def place(self, b: int) -> None:
        free = self.capacity - self.fill[b]
        self.at[free].add(b)
        self.open |= 1 << free

    def lift(self, b: int) -> None:
        free = self.capacity - self.fill[b]
        self.at[free].discard(b)
        if not self.at[free]:
            self.open &= ~(1 << free)

    def best(self, need: int) -> int:
        """The bin with the least room of at least need, or -1."""
        rest = self.open >> need
        return next(iter(self.at[need + (rest & -rest).bit_length() - 1])) if rest else -1

    def new(self) -> int:
        self.items.append([])
        self.fill.append(0)
        self.place(len(self.fill) - 1)
        return len(self.fill) - 1

    def index(self) -> None:
        """Starts to keep account of sizes; from here on bins are changed by show and hide around what changes them."""
        self.rooms = [0] * (self.capacity + 1)
        self.most = np.full(self.capacity + 1, -1, np.int64)  # greatest room beside each size
        self.holders: dict[tuple[int, int], set[int]] = {}
        for b in range(len(self.fill)):
            self.lift(b)
            self.show(b)

    def show(self, b: int) -> None:
        free = self.capacity - self.fill[b]
        if not self.items[b] or not free:
            return
        self.place(b)
        for z in {size for size, _ in self.items[b]}:
            self.holders.setdefault((z, free), set()).add(b)
            self.rooms[z] |= 1 << free
            self.most[z] = self.rooms[z].bit_length() - 1

    def hide(self, b: int) -> None:
        free = self.capacity - self.fill[b]
        if not self.items[b] or not free:
            return
        self.lift(b)
        for z in {size for size, _ in self.items[b]}:
            held = self.holders[z, free]
            held.discard(b)
            if not held:
                del self.holders[z, free]
                self.rooms[z] &= ~(1 << free)
                self.most[z] = self.rooms[z].bit_length() - 1

    def holder(self, size: int, need: int) -> int:
        """Of the bins that hold an item of the size and have room of at least need, the fullest."""
        rest = self.rooms[size] >> need
        return next(iter(self.holders[size, need + (rest & -rest).bit_length() - 1]))

    def item(self, b: int, size: int) -> tuple[int, int]:
        return next(x for x in self.items[b] if x[0] == size)

    def exchange(self, a: int, b: int, out: list[tuple[int, int]], back: list[tuple[int, int]]) -> None:
        """out goes from a, which is hidden, to b; back the other way."""
        self.hide(b)
        for x in out:
            self.items[a].remove(x)
        for x in back:
            self.items[b].remove(x)
        self.items[a] += back
        self.items[b] += out
        gain = sum(x[0] for x in out) - sum(x[0] for x in back)
        self.fill[a] -= gain
        self.fill[b] += gain
        self.show(b)


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices by bin; no bin's lengths sum to over capacity. Best fit, then local search, which ends at the least possible
    number of bins or when no move and no exchange raises the sum of squared fills."""
    bins = _Bins(capacity)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        b = bins.best(lengths[i])
        if b < 0:
            b = bins.new()
        bins.lift(b)
        bins.items[b].append((lengths[i], i))
        bins.fill[b] += lengths[i]
        bins.place(b)
    count, least = len(bins.fill), -(-sum(lengths) // capacity)
    if count > least:
        bins.index()
        emptying = changed = True
        while count > least and (emptying or changed):
            before, changed = count, False
            for a in sorted((b for b in range(len(bins.fill)) if bins.items[b] and bins.fill[b] < capacity), key=lambda b: (bins.fill[b], b)):
                if count > least and bins.items[a] and bins.fill[a] < capacity:
                    changed |= _give(bins, a, emptying)
                    count -= not bins.items[a]
            emptying = emptying and count < before
    return [[i for _, i in x] for x in bins.items if x]


def _give(bins: _Bins, a: int, emptying: bool) -> bool:
    """Hands tokens of a on to other bins while a step allows it; whether any did. A gain of g tokens for b raises the sum of
    squared fills where fill(b) + g > fill(a). While bins are being emptied, what is left in a counts in its place, so that it
    is enough that b ends fuller than a."""
    bins.hide(a)
    done = False
    while bins.items[a] and (found := _step(bins, a, emptying)):
        bins.exchange(a, *found)
        done = True
    bins.show(a)
    return done


def _step(bins: _Bins, a: int, emptying: bool) -> tuple[int, list, list] | None:
    """A bin, what goes to it, and what comes back: a move, else one for one, else two for one, with the greatest gain for
    what goes."""
    fill = bins.fill
    own = sorted(bins.items[a], reverse=True)
    for x in own:
        b = bins.best(x[0])
        if b >= 0 and fill[b] + x[0] > fill[a]:
            return b, [x], []
    widest = bins.open.bit_length() - 1
    for sets in ({x[0]: [x] for x in own}, {x[0] + y[0]: [x, y] for i, x in enumerate(own) for y in own[i + 1 :]}):
        for size, out in sorted(sets.items(), reverse=True):
            low = max(1, size - widest)
            most = bins.most[low:size]
            for z in (np.flatnonzero(most + np.arange(low, low + len(most)) >= size) + low).tolist():
                gain, b = size - z, bins.holder(z, size - z)
                if fill[b] + gain > fill[a] - (gain if emptying else 0):
                    return b, out, [bins.item(b, z)]
    return None


COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "shard", "sequence_id", "offset", "open"]


def _placed(table: pa.Table, bins: list[list[int]], group: int, open_: set[int]) -> pa.Table:
    lengths = table.column("length").to_pylist()
    sequence, offset, loose = [0] * len(lengths), [0] * len(lengths), [False] * len(lengths)
    for k, members in enumerate(bins):
        at = 0
        for i in members:
            sequence[i], offset[i], loose[i] = (group << 36) + k, at, k in open_
            at += lengths[i]
    return pa.table([*[table.column(c) for c in COLUMNS[:6]], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(loose, pa.bool_())], COLUMNS)


def _pack_shard(capacity: int):
    """Packs a shard; open are its least filled bins, with a FAN_IN-th of a shard's pieces at most."""

    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_pylist()
        bins = pack(lengths, capacity)
        fill = [sum(lengths[i] for i in b) for b in bins]
        open_, pieces = set(), 0
        for k in sorted((k for k, f in enumerate(fill) if f < capacity), key=lambda k: (fill[k], k)):
            pieces += len(bins[k])
            if pieces > SHARD_PIECES // FAN_IN:
                break
            open_.add(k)
        return _placed(table, bins, table.column("shard")[0].as_py(), open_)

    return run


def _pack_open(capacity: int, shift: int):
    """Packs open bins of several shards again, where that takes fewer."""

    def run(table: pa.Table) -> pa.Table:
        bins = pack(table.column("length").to_pylist(), capacity)
        if len(bins) >= pc.count_distinct(table.column("sequence_id")).as_py():
            return table.select(COLUMNS)
        return _placed(table, bins, shift + table.column("wide")[0].as_py(), set())

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece."""
    pieces = written(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    shards = max(1, -(-pieces.count() // SHARD_PIECES))
    id_type = pieces.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, shard bigint, sequence_id bigint, offset bigint, open boolean"
    dealt = pieces.withColumn("shard", F.col("deal") % shards).drop("deal")
    first = written(dealt.groupBy("shard").applyInArrow(_pack_shard(capacity), schema), "packed")
    if shards == 1:
        return first.drop("shard", "open")
    open_ = first.where("open").withColumn("wide", F.expr(f"shard div {FAN_IN}"))
    again = open_.groupBy("wide").applyInArrow(_pack_open(capacity, shards), schema)
    return first.where("not open").union(again).drop("shard", "open")
