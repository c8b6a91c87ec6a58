"""Benchmark decontamination by latent semantic retrieval.

Documents are read as blocks of `block` terms; passages are blocks and pairs of neighbouring blocks.

1. A pass over the corpus makes the randomised singular value decomposition of its TF-IDF matrix: terms are hashed to
   `features` columns, every block is added, with a random sign, to one of `sketch` rows, and the blocks that hold a feature
   are counted. Sums over tasks are small tables of fixed size, whatever the corpus and the benchmark. The driver weighs the
   sketch's columns by the counts and decomposes it; its right singular vectors are the latent axes.
2. A second pass brings passages and items to the latent space and searches by cosine. The axes are scaled by their singular
   values, those far above the usual ones less, so that neither a language's common words nor a passage that much of the
   corpus holds drowns the rest. Candidates are verified inside the document: longest common subsequence with all the
   item's terms and, for partial ones, the weight of the item's terms that are there and the share of the answer's. Before
   that, an upper bound of the subsequence (the item's terms that occur near the passage at all) sorts out most; it drops
   nothing that could be confirmed.

A term weighs less the more blocks hold it, and none is left out. The search is approximate (what is confirmed has a passage
of at least `cosine`); the verification is exact.

Defined results: terms are maximal runs of letters and numbers in lower case. Null or empty texts and items match nothing, nor
do items without terms. The answer is the item's last sentence where no answer column is named or the answer is null.
Repeated rows each give their rows; an empty corpus or benchmark gives none; other columns are neither read nor returned.
Texts of any length are read whole. The benchmark is held by the driver and by each task, the corpus never.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import words

#: columns of the sketch in one row of a task's sums
SLICE = 128
#: items verified at once
ITEMS = 256


@dataclass(frozen=True)
class DecontaminateConfig:
    """Items near a passage by `cosine` are verified. A subsequence of `copy` of an item's terms is a copy; one of `part` is a
    paraphrase if terms of `weight` of the item's weight and `answer` of the answer's terms are there as well."""

    block: int = 32
    features: int = 4096
    sketch: int = 256
    rank: int = 128
    cosine: float = 0.35
    copy: float = 0.75
    part: float = 0.5
    weight: float = 0.6
    answer: float = 0.6
    seed: int = 5


class Blocks:
    """The blocks and passages of some texts. features: distinct features of each block, filled up with config.features."""

    def __init__(self, texts: pa.Array | list[str | None], config: DecontaminateConfig):
        self.words = w = words.terms_of(texts)
        self.numbers = x = w.numbers()
        self.counts = -(-w.counts // config.block)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        text = w.text_of
        place = np.arange(len(x)) - w.bounds[text]
        self.block = self.first[text] + place // config.block
        self.features = np.full((int(self.first[-1]), config.block), config.features, np.int32)
        self.features[self.block, place % config.block] = x % np.uint64(config.features)
        self.features.sort(axis=1)
        again = self.features[:, 1:] == self.features[:, :-1]
        self.features[:, 1:][again] = config.features

    def passages(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Blocks, then pairs of neighbouring blocks of a text: their text, their first block, and whether it is a pair."""
        text = np.repeat(np.arange(len(self.counts)), self.counts)
        pairs = np.flatnonzero(text[1:] == text[:-1])
        every = np.arange(len(text))
        return np.concatenate([text, text[pairs]]), np.concatenate([every, pairs]), np.repeat([False, True], [len(every), len(pairs)])


# ---- decomposition


def _sketch(config: DecontaminateConfig):
    """A task's sums: rows of the sketch by slices of columns, and at -1 the number of blocks and of those with each feature."""
    size = config.features + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        total, found = np.zeros(config.sketch * size, np.float32), np.zeros(size)
        for batch in words.slices(batches, 0):
            blocks = Blocks(batch.column(0), config).features
            n = len(blocks)
            draw = words.mixed(words.mixed(np.arange(made, made + n, dtype=np.uint64)) ^ words.mixed(np.full(n, part * 1000 + config.seed, np.uint64)))
            sign = np.where(draw >> np.uint64(63), 1, -1).astype(np.float32)
            np.add.at(total, ((draw % np.uint64(config.sketch)).astype(np.int64)[:, None] * size + blocks).ravel(), np.repeat(sign, config.block))
            found += np.bincount(blocks.ravel(), minlength=size)
            made += n
        if made:
            found[-1] = made
            total = total.reshape(config.sketch, size)
            at = np.arange(0, config.features, SLICE)
            sums = [found.tobytes(), *[np.ascontiguousarray(total[:, i : i + SLICE]).astype(np.float64).tobytes() for i in at]]
            yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array(sums, pa.binary())], ["at", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the same place, one row at a time."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = np.frombuffer(data.as_buffer(), np.float64)
            if at in total:
                total[at] += part
            else:
                total[at] = part.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["at", "sums"])


def fit(docs: DataFrame, text_col: str = "text", config: DecontaminateConfig = DecontaminateConfig()) -> tuple[np.ndarray, np.ndarray]:
    """The latent axes, a row for each feature, scaled by its weight, and a last one of zeros; and the weights."""
    schema = "at int, sums binary"
    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(_sketch(config), schema).repartition("at").mapInArrow(_added, schema)
    parts = {r["at"]: np.frombuffer(r["sums"], np.float64) for r in sums.collect()}
    if not parts:
        return np.zeros((config.features + 1, 1), np.float32), np.ones(config.features)
    found = parts.pop(-1)
    sketch = np.hstack([parts[at].reshape(config.sketch, -1)[:, :SLICE] for at in sorted(parts)])[:, : config.features]
    weight = np.log((1 + found[-1]) / (1 + found[:-1])) + 0.5
    sketch = sketch * weight
    values, left = np.linalg.eigh(sketch @ sketch.T)
    values, left = np.sqrt(np.maximum(values[::-1], 0))[: config.rank], left[:, ::-1][:, : config.rank]
    kept = values > 1e-5 * values[0]
    values, axes = values[kept], sketch.T @ (left[:, kept] / values[kept])
    scale = np.minimum(values, 2 * np.median(values)) if len(values) else values
    return np.ascontiguousarray(np.vstack([axes * weight[:, None] / scale, np.zeros((1, len(scale)))]), np.float32), weight


def projected(features: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Sum of the axes' rows over each row of features."""
    out = np.zeros((len(features), axes.shape[1]), np.float32)
    row = np.empty((512, axes.shape[1]), np.float32)
    for i in range(0, len(features), 512):
        part, to = features[i : i + 512], out[i : i + 512]
        for k in range(features.shape[1]):
            np.take(axes, part[:, k], axis=0, out=row[: len(part)], mode="clip")
            to += row[: len(part)]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


# ---- search


@dataclass(frozen=True)
class Item:
    """terms: numbers of the item's words in order; answer: those of the answer."""

    id: object
    terms: np.ndarray
    answer: frozenset


class Group:
    """Some items with what a search needs: the vocabulary, each item's distinct terms and how often it has them, and the latent
    vectors of its passages."""

    def __init__(self, items: list[Item], axes: np.ndarray, weight: np.ndarray, config: DecontaminateConfig):
        self.items = items
        self.vocabulary = np.unique(np.concatenate([i.terms for i in items]))
        self.ids = [np.searchsorted(self.vocabulary, i.terms) for i in items]
        distinct = [np.unique(x, return_counts=True) for x in self.ids]
        most = max(len(d) for d, _ in distinct)
        self.terms = np.full((len(items), most), len(self.vocabulary))
        self.share, self.weight = np.zeros((2, len(items), most), np.float32)
        for k, (d, n) in enumerate(distinct):
            heavy = n * weight[(self.vocabulary[d] % np.uint64(config.features)).astype(np.int64)]
            self.terms[k, : len(d)], self.share[k, : len(d)], self.weight[k, : len(d)] = d, n / n.sum(), heavy / heavy.sum()
        # blocks on both sides of a pair within which an item lies that the pair holds for the most part
        self.reach = np.array([max(1, -(-len(i.terms) // config.block) - 1) for i in items])
        vectors, self.owner = [], []
        for k, i in enumerate(items):
            for at in range(0, max(1, len(i.terms) - config.block), config.block):
                part = np.unique(i.terms[at : at + 2 * config.block] % np.uint64(config.features)).astype(np.int64)
                vectors.append(axes[part].sum(axis=0))
                self.owner.append(k)
        self.owner = np.array(self.owner)
        self.latent = _unit(np.array(vectors, np.float32))


@dataclass
class Index:
    axes: np.ndarray
    groups: list[Group]
    config: DecontaminateConfig

    def matches(self, texts: pa.Array | list[str | None]) -> list[tuple[int, object, float, float, float]]:
        """(text, item id, cosine, subsequence share, answer share) of what is confirmed, the best passage of each pair."""
        blocks = Blocks(texts, self.config)
        text, a, pair = blocks.passages()
        if not len(text):
            return []
        vectors = projected(blocks.features, self.axes)
        vectors = _unit(np.concatenate([vectors, vectors[a[pair]] + vectors[a[pair] + 1]]))
        return [m for group in self.groups for m in self._in_group(group, blocks, text, a, vectors)]

    def _in_group(self, group: Group, blocks: Blocks, text: np.ndarray, a: np.ndarray, vectors: np.ndarray) -> list[tuple]:
        c, size = self.config, len(group.vocabulary)
        at = np.minimum(np.searchsorted(group.vocabulary, blocks.numbers), size - 1)
        ids = np.where(group.vocabulary[at] == blocks.numbers, at, size)
        near = vectors @ group.latent.T
        passage, vector = np.nonzero(near >= c.cosine)
        cosine = near[passage, vector]
        item = group.owner[vector]
        here = np.zeros((int(blocks.first[-1]), size + 1), bool)
        here[blocks.block, ids] = True
        here[:, size] = False
        here = np.packbits(here, axis=1, bitorder="little")
        byte, bit = group.terms >> 3, (group.terms & 7).astype(np.uint8)
        kept, weight = [], np.zeros(len(item), np.float32)
        for reach in np.unique(group.reach):
            chosen = np.flatnonzero(group.reach[item] == reach)
            around = here.copy()  # the terms of a passage's blocks and of `reach` more on both sides, whatever texts they are of
            for d in range(1, reach + 2):
                around[:-d] |= here[d:]
            for d in range(1, reach + 1):
                around[d:] |= here[:-d]
            for i in range(0, len(chosen), 1 << 14):
                rows = chosen[i : i + (1 << 14)]
                k = item[rows]
                held = (around[a[passage[rows]][:, None], byte[k]] >> bit[k] & 1).astype(np.float32)
                share, heavy = (np.einsum("ij,ij->i", held, of[k]) for of in (group.share, group.weight))
                weight[rows] = heavy
                kept.append(rows[(share >= c.copy - 1e-4) | (share >= c.part - 1e-4) & (heavy >= c.weight)])
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        for row in np.sort(np.concatenate(kept)).tolist() if kept else ():
            k, p = int(item[row]), int(passage[row])
            doc = int(text[p])
            if found.get((doc, k), (0, 0, 0))[1] >= 1:
                continue
            begin, reach = blocks.words.bounds[doc], int(group.reach[k])
            first = int(a[p] - blocks.first[doc])
            part = ids[begin + max(0, first - reach) * c.block : min(begin + (first + 2 + reach) * c.block, blocks.words.bounds[doc + 1])]
            part = part[part < size].tolist()
            share = subsequence(group.ids[k].tolist(), part) / len(group.ids[k])
            if share < c.part or share < c.copy and weight[row] < c.weight:
                continue
            seen, answer = set(part), group.items[k].answer
            answered = sum(int(np.searchsorted(group.vocabulary, t)) in seen for t in answer) / len(answer) if answer else 0.0
            if share >= c.copy or answered >= c.answer:
                new = (float(cosine[row]), share, answered)
                found[doc, k] = max(found.get((doc, k), new), new, key=lambda x: (x[1], x[0]))
        return [(doc, group.items[k].id, *v) for (doc, k), v in sorted(found.items())]


def subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if m := at.get(x):
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _items(items: DataFrame, id_col: str, text_col: str, answer_col: str | None) -> list[Item]:
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), answer.alias("answer")).where("text is not null").collect()
    last = lambda t: ([x for x in re.split(r"[.!?]+", t) if x.strip()] or [""])[-1]
    texts = words.terms_of([r["text"] for r in rows])
    answers = words.terms_of([r["answer"] if r["answer"] is not None else last(r["text"]) for r in rows])
    terms, wanted = texts.numbers(), answers.numbers()
    out = []
    for k, r in enumerate(rows):
        own = terms[texts.bounds[k] : texts.bounds[k + 1]]
        if len(own):
            out.append(Item(r["id"], own, frozenset(wanted[answers.bounds[k] : answers.bounds[k + 1]].tolist()) & frozenset(own.tolist())))
    return out


def build_index(docs: DataFrame, items: list[Item], text_col: str, config: DecontaminateConfig) -> Index:
    axes, weight = fit(docs, text_col, config)
    return Index(axes, [Group(items[i : i + ITEMS], axes, weight, config) for i in range(0, len(items), ITEMS)], config)


def find(docs: DataFrame, items: DataFrame, config: DecontaminateConfig = DecontaminateConfig(), id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share, kind (copy or paraphrase): a row for each document and item it holds."""
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_id_col].dataType
    schema = f"doc_id {id_type}, item_id {item_type.simpleString()}, cosine double, lcs_share double, answer_share double"
    wanted = _items(items, item_id_col, item_text_col, answer_col)
    if wanted:
        found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_found(build_index(docs, wanted, text_col, config)), schema)
    else:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.withColumn("kind", F.when(F.col("lcs_share") >= config.copy, F.lit("copy")).otherwise(F.lit("paraphrase")))


def _found(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, 1):
            if hits := index.matches(batch.column(1)):
                ids = pa.array([h[1] for h in hits])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([h[0] for h in hits], pa.int64())), ids, *[pa.array([h[k] for h in hits], pa.float64()) for k in (2, 3, 4)]], ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

    return run


def keep_clean(docs: DataFrame, items: DataFrame, config: DecontaminateConfig = DecontaminateConfig(), text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item."""
    wanted = _items(items, item_id_col, item_text_col, answer_col)
    if not wanted:
        return docs
    return docs.mapInArrow(_without(build_index(docs, wanted, text_col, config), docs.columns.index(text_col)), docs.schema)


def _without(index: Index, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, text_at):
            clean = np.ones(batch.num_rows, bool)
            clean[[h[0] for h in index.matches(batch.column(text_at))]] = False
            yield batch.filter(pa.array(clean))

    return run
