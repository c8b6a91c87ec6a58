"""A quality score by a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its lower-case words, hashed to ``buckets`` and weighted by the logarithm of their counts (scaled to
length 1), and for each statistic an indicator of the range that its value lies in and the range's place among the others: sizes, shares of kinds of characters, of
repeated words, of words that end in signs, each over the whole text and as its largest value in any block of the
text, so that a bad stretch of a long text shows; and the metadata n_chars. The score is the logistic function of

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,  the last term as  1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

so a text costs time linear in its features. The model is fitted on the driver over a bounded sample of labelled rows, as many of
either label as there are up to half of ``sample_rows`` each, weighted back to their true shares, so scores are probabilities.

Defined results: a null text is scored as an empty one, and an empty one by its statistics; a null n_chars has an indicator of its
own. Labels that are null are left out, repeated ones averaged; copies of a text in the sample count once, with the mean
of their labels. Without any label of one kind the score is the share of label 1 (0.5 without labels). Repeated rows each
give a row, an empty table none, and other columns of the input are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.words import slices, words_of


@dataclass(frozen=True)
class QualityConfig:
    """sample_rows and sample_features bound what the driver fits on: labelled rows, and features of all of them. A small sample is
    gone through more often, for `steps` batches at least."""

    sample_rows: int = 12_000
    sample_features: int = 12_000_000
    buckets: int = 1 << 15
    factors: int = 4
    epochs: int = 6
    steps: int = 500
    batch: int = 64
    rate: float = 0.05
    penalty: float = 1e-5
    seed: int = 17


#: bytes and words of a block, over which a statistic's largest value is taken
BLOCK_BYTES, BLOCK_WORDS = 512, 48
#: upper ends of the ranges of shares, of sizes (powers of two) and of word lengths
SHARES = np.array([0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8])
SIZES = np.array([0.0, *(2.0**k for k in range(2, 32, 2))])
LENGTHS = np.array([0, 1, 2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 15, 30])
RANGES = 16
#: weight of a statistic's indicator
STATISTIC = 0.5
UPPER, LOWER, DIGIT, BLANK, STOP, SIGN, OTHER, INSIDE = range(8)


def _kinds() -> np.ndarray:
    """The kind of each byte of UTF-8: a character's later bytes count for nothing, other letters than ASCII's are OTHER."""
    kinds = np.full(256, SIGN, np.uint8)
    for chars, kind in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), ("abcdefghijklmnopqrstuvwxyz", LOWER), ("0123456789", DIGIT), (" \t\n\v\f\r", BLANK), (".,;:?'\"-()", STOP)):
        kinds[list(chars.encode())] = kind
    kinds[128:192], kinds[192:] = INSIDE, OTHER
    return kinds


KINDS = _kinds()
#: statistics in order, with the ends of their ranges
STATISTICS: list[tuple[str, np.ndarray]] = [
    ("chars", SIZES), ("words", SIZES), ("upper", SHARES), ("digit", SHARES), ("blank", SHARES), ("stop", SHARES), ("sign", SHARES), ("other", SHARES),
    ("upper_block", SHARES), ("digit_block", SHARES), ("blank_block", SHARES), ("stop_block", SHARES), ("sign_block", SHARES), ("other_block", SHARES),
    ("lines", SHARES), ("word_length", LENGTHS), ("longest_word", LENGTHS), ("again", SHARES), ("again_block", SHARES), ("distinct", SHARES), ("signed", SHARES), ("signed_block", SHARES),
    ("n_chars", SIZES),
]


def _blocks(starts: np.ndarray, sizes: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of blocks of step to 2 * step - 1 elements (a shorter stretch is one block), and the number of them in each stretch."""
    counts = np.maximum(sizes // step, (sizes > 0).astype(np.int64))
    upto = np.cumsum(counts) - counts
    return np.repeat(starts, counts) + (np.arange(counts.sum()) - np.repeat(upto, counts)) * step, counts


def _per(values: np.ndarray, bounds: np.ndarray, how=np.add) -> np.ndarray:
    """values between neighbouring bounds, added up or their largest; 0 for nothing."""
    out = np.zeros(len(bounds) - 1, values.dtype)
    some = bounds[1:] > bounds[:-1]
    if some.any():
        out[some] = how.reduceat(values, bounds[:-1][some])
    return out


def statistics(texts: pa.Array, n_chars: np.ndarray) -> np.ndarray:
    """One row for each text, one column for each of STATISTICS; NaN for a null n_chars."""
    words = words_of(texts)
    data, bounds = words.data, words.offsets
    kinds = KINDS[data]
    chars = _per((kinds != INSIDE).astype(np.int64), bounds)
    at, counts = _blocks(bounds[:-1], np.diff(bounds), BLOCK_BYTES)
    block_bounds, edges = np.concatenate([[0], np.cumsum(counts)]), np.append(at, len(data))
    block_chars = np.maximum(_per((kinds != INSIDE).astype(np.int64), edges), 1)
    whole, worst = [], []
    for kind in (UPPER, DIGIT, BLANK, STOP, SIGN, OTHER):
        in_block = _per((kinds == kind).astype(np.int64), edges)
        whole.append(_per(in_block, block_bounds) / np.maximum(chars, 1))
        worst.append(_per(in_block / block_chars, block_bounds, np.maximum))
    lines = _per((data == 10).astype(np.int64), bounds) / np.maximum(chars, 1)

    n, numbers, text_of = words.counts, words.numbers(), words.text_of
    lengths = (words.ends - words.starts).astype(np.float64)
    again = np.zeros(len(numbers))
    again[1:] = (numbers[1:] == numbers[:-1]) & (text_of[1:] == text_of[:-1])
    last = KINDS[data[words.ends - 1]] if len(numbers) else np.zeros(0, np.uint8)
    signed = (last == SIGN).astype(np.float64)
    at, counts = _blocks(words.bounds[:-1], n, BLOCK_WORDS)
    block_bounds, edges = np.concatenate([[0], np.cumsum(counts)]), np.append(at, len(numbers))
    block_words = np.maximum(np.diff(edges), 1)
    share = lambda x: _per(x, words.bounds) / np.maximum(n, 1)
    most = lambda x: _per(_per(x, edges) / block_words, block_bounds, np.maximum)
    order = np.lexsort((numbers, text_of))
    fresh = np.ones(len(order))
    fresh[1:] = (numbers[order][1:] != numbers[order][:-1]) | (text_of[order][1:] != text_of[order][:-1])
    columns = [chars, n, *whole, *worst, lines, share(lengths), _per(lengths, words.bounds, np.maximum), share(again), most(again), share(fresh), share(signed), most(signed), n_chars]
    return np.stack([np.asarray(c, float) for c in columns], axis=1)


@dataclass(frozen=True)
class Features:
    """Row k has the features ids[bounds[k]:bounds[k + 1]] with these values."""

    ids: np.ndarray
    values: np.ndarray
    bounds: np.ndarray

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def features(texts: pa.Array, n_chars: pa.Array, config: QualityConfig) -> Features:
    texts = pc.fill_null(texts, "")
    rows = len(texts)
    words = words_of(pc.utf8_lower(texts))
    keys, counts = np.unique(words.text_of.astype(np.int64) * config.buckets + (words.numbers() % np.uint64(config.buckets)).astype(np.int64), return_counts=True)
    row, ids, values = keys // config.buckets, keys % config.buckets, 1 + np.log(counts)
    norms = np.sqrt(np.bincount(row, values**2, rows))
    values = values / norms[row]
    stats = statistics(texts, pc.cast(n_chars, pa.float64(), safe=False).to_numpy(zero_copy_only=False))
    ranges = np.stack([np.where(np.isnan(x), RANGES - 1, np.minimum(np.searchsorted(ends, x, side="left"), RANGES - 2)) for x, (_, ends) in zip(stats.T, STATISTICS)], axis=1)
    first = config.buckets + np.arange(len(STATISTICS)) * (RANGES + 1)
    place = np.where(ranges < RANGES - 1, ranges / (RANGES - 2), 0.0)  # how far up: what a range that no training row has goes by
    row = np.concatenate([row, np.repeat(np.arange(rows), 2 * len(STATISTICS))])
    ids = np.concatenate([ids, np.stack([first + ranges, np.broadcast_to(first + RANGES, ranges.shape)], axis=2).ravel()])
    values = np.concatenate([values, np.stack([np.full(ranges.shape, STATISTIC), place], axis=2).ravel()])
    order = np.argsort(row, kind="stable")
    return Features(ids[order].astype(np.int32), values[order].astype(np.float32), np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]))


@dataclass(frozen=True)
class QualityModel:
    """bias, a weight and `factors` numbers for each feature."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    config: QualityConfig

    def scores(self, f: Features) -> np.ndarray:
        """The sum-of-squares identity: time and memory linear in the features."""
        x = f.values.astype(np.float64)
        total = self.bias + _per(self.weights[f.ids] * x, f.bounds)
        for k in range(self.factors.shape[1]):
            vx = self.factors[f.ids, k] * x
            total += 0.5 * (_per(vx, f.bounds) ** 2 - _per(vx * vx, f.bounds))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(f: Features, labels: np.ndarray, weights: np.ndarray, config: QualityConfig = QualityConfig()) -> QualityModel:
    """Logistic loss by adaptive gradient steps over shuffled batches; labels from 0 to 1."""
    size = config.buckets + len(STATISTICS) * (RANGES + 1)
    share = float((labels * weights).sum() / weights.sum()) if len(labels) and weights.sum() else 0.5
    w, v = np.zeros(size), np.random.default_rng(config.seed).normal(0, 0.05, (size, config.factors))
    if not len(labels) or not 0 < share < 1:
        share = min(max(share, 0.01), 0.99)
        return QualityModel(float(np.log(share / (1 - share))), w, v * 0, config)
    bias, bias_grown, w_grown, v_grown = float(np.log(share / (1 - share))), 1e-8, np.full(size, 1e-8), np.full((size, config.factors), 1e-8)
    weights = weights / weights.mean()
    rng = np.random.default_rng(config.seed)
    for _ in range(max(config.epochs, -(-config.steps * config.batch // len(labels)))):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), config.batch):
            rows = order[lo : lo + config.batch]
            sizes = np.diff(f.bounds)[rows]
            at = np.repeat(f.bounds[:-1][rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            ids, x, row = f.ids[at], f.values[at].astype(np.float64), np.repeat(np.arange(len(rows)), sizes)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            vx = v[ids] * x[:, None]
            sums = np.add.reduceat(vx, bounds[:-1], axis=0)  # every row has its statistics
            margin = bias + np.add.reduceat(w[ids] * x, bounds[:-1]) + 0.5 * (sums**2 - np.add.reduceat(vx**2, bounds[:-1], axis=0)).sum(axis=1)
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]) * weights[rows] / len(rows)
            bias_step = slope.sum()
            bias_grown += bias_step**2
            bias -= config.rate * bias_step / np.sqrt(bias_grown)
            used, place = np.unique(ids, return_inverse=True)
            push = slope[row] * x
            step = np.bincount(place, push, len(used)) + config.penalty * w[used]
            w_grown[used] += step**2
            w[used] -= config.rate * step / np.sqrt(w_grown[used])
            for k in range(config.factors):
                step = np.bincount(place, push * (sums[row, k] - vx[:, k]), len(used)) + config.penalty * v[used, k]
                v_grown[used, k] += step**2
                v[used, k] -= config.rate * step / np.sqrt(v_grown[used, k])
    return QualityModel(bias, w, v, config)


def _sampled_labels(labels: DataFrame, config: QualityConfig, id_col: str, label_col: str) -> tuple[DataFrame, dict[bool, float]]:
    """At most sample_rows of (id, y), drawn by the ids' hashes, about half of either label, and the weight of a row of each."""
    clean = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null")
    clean = clean.groupBy("id").agg(F.least(F.greatest(F.avg("y"), F.lit(0.0)), F.lit(1.0)).alias("y"))
    good = F.col("y") >= 0.5
    counts = {r["good"]: r["n"] for r in clean.groupBy(good.alias("good")).agg(F.count("*").alias("n")).collect()}
    scale, half = 1_000_000, config.sample_rows // 2
    spare = {g: max(0, half - counts.get(g, 0)) for g in (True, False)}  # what one label leaves goes to the other
    shares = {g: min(1.0, 0.98 * (half + spare[not g]) / n) for g, n in counts.items()}
    taken = F.pmod(F.xxhash64("id"), F.lit(scale)) < F.when(good, int(shares.get(True, 0) * scale)).otherwise(int(shares.get(False, 0) * scale))
    return clean.where(taken).limit(config.sample_rows), {g: 1 / s for g, s in shares.items() if s}


def fit(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig(), id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", label_col: str = "quality") -> QualityModel:
    """Learns from rows of docs that have a label. The sampled labels, bounded by sample_rows, are broadcast to one scan of docs;
    the features of the sampled texts, bounded by sample_features, come to the driver."""
    taken, weights = _sampled_labels(labels, config, id_col, label_col)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(chars_col).cast("bigint").alias("n_chars"))
    rows = slim.join(F.broadcast(taken), "id").select(F.xxhash64("text", "n_chars").alias("h"), "text", "n_chars", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            f = features(batch.column(1), batch.column(2), config)
            lists = [pa.ListArray.from_arrays(pa.array(f.bounds, pa.int32()), pa.array(x)) for x in (f.ids, f.values)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), *lists], ["h", "y", "ids", "values"])

    made = rows.mapInArrow(run, "h bigint, y double, ids array<int>, values array<float>")
    made = made.groupBy("h").agg(F.avg("y").alias("y"), F.any_value("ids").alias("ids"), F.any_value("values").alias("values"))
    table = made.limit(config.sample_rows).toArrow().combine_chunks().sort_by("h")
    column = lambda n: table.column(n).combine_chunks() if table.num_rows else pa.array([], table.schema.field(n).type)
    y, ids, values = column("y").to_numpy(zero_copy_only=False), column("ids"), column("values")
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int64)
    kept = int(np.searchsorted(bounds, config.sample_features, side="right")) - 1
    f = Features(ids.flatten().to_numpy()[: bounds[kept]], values.flatten().to_numpy()[: bounds[kept]], bounds[: kept + 1])
    return train(f, y[:kept], np.where(y[:kept] >= 0.5, weights.get(True, 1.0), weights.get(False, 1.0)), config)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """doc_id and score for each row: one pass over the whole texts, no shuffle."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(chars_col).cast("bigint").alias("n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = model.scores(features(batch.column(1), batch.column(2), model.config))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double")
