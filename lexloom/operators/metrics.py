"""Embedding sums, losses, statistics of activations, metric means and schedules."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lexloom.config import ScheduleConfig


#: slots whose vectors a task holds, and words whose sums it holds
SLOT_BLOCK, WORD_BLOCK = 4096, 50_000
#: rows of vectors that are added up at once
ROWS_AT_ONCE = 8192


def _summed(columns: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Adds up the rows of each word, array by array."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("word")
        words = table.column("word").combine_chunks()
        vectors = np.array(table.column("embedding").to_pylist(), float).reshape(len(words), -1)
        firsts = np.flatnonzero(np.append([True], pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)))
        sums = np.add.reduceat(vectors, firsts, axis=0)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32)), pa.array(sums.ravel()))
        return pa.table({"word": words.take(pa.array(firsts)), "embedding": rows}).select(columns)

    return run


def embedding_arrays(slots: DataFrame, vectors: DataFrame, aggregation: str = "sum", by_triples: bool = False) -> DataFrame:
    """slots(word, triple_id, slots), vectors(vocab_id, embedding): word, embedding. Sum over a word's triples of the sum or mean over
    their slots; optionally over the number of triples.

    A sparse product by blocks: slots and words are dealt to a grid, a cell holds the vectors of its slots once and sends one
    array for each of its words, and these are added up by word."""
    weight = F.lit(1.0) if aggregation == "sum" else 1.0 / F.size("slots")
    each = slots.select("word", weight.alias("weight"), F.explode("slots").alias("vocab_id")).groupBy("word", "vocab_id").agg(F.sum("weight").alias("weight"))
    words = slots.agg(F.approx_count_distinct("word")).first()[0]
    grid = max(1, -(-words // WORD_BLOCK))
    block = F.expr(f"vocab_id div {SLOT_BLOCK}").alias("block")
    each = each.select(block, F.pmod(F.xxhash64("word"), F.lit(grid)).cast("int").alias("part"), "word", "vocab_id", "weight")
    held = vectors.select(block, F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("part"), "vocab_id", F.col("embedding").cast("array<double>").alias("embedding"))

    def cell(own: pa.Table, table: pa.Table) -> pa.Table:
        known = table.column("vocab_id").to_numpy()
        order = np.argsort(known)
        matrix = np.array(table.column("embedding").to_pylist(), float).reshape(len(known), -1)[order]
        own = own.sort_by("word")
        wanted = own.column("vocab_id").to_numpy()
        place = np.minimum(np.searchsorted(known[order], wanted), max(len(known) - 1, 0))
        there = known[order][place] == wanted if len(known) else np.zeros(len(wanted), bool)
        own, place = own.filter(pa.array(there)), place[there]
        if not own.num_rows:
            return pa.table({"word": pa.array([], pa.string()), "embedding": pa.array([], pa.list_(pa.float64()))})
        names = own.column("word").combine_chunks()
        firsts = np.flatnonzero(np.append([True], pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)))
        weights, ends = own.column("weight").to_numpy(), np.append(firsts[1:], len(place))
        sums = np.empty((len(firsts), matrix.shape[1]))
        at = 0
        while at < len(firsts):  # some thousand rows of vectors at once
            stop = max(at + 1, int(np.searchsorted(ends, firsts[at] + ROWS_AT_ONCE, side="right")))
            part = slice(firsts[at], ends[stop - 1])
            sums[at:stop] = np.add.reduceat(matrix[place[part]] * weights[part, None], firsts[at:stop] - firsts[at], axis=0)
            at = stop
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32)), pa.array(sums.ravel()))
        return pa.table({"word": names.take(pa.array(firsts)), "embedding": rows})

    parts = each.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInArrow(cell, "word string, embedding array<double>")
    out = parts.groupBy("word").applyInArrow(_summed(["word", "embedding"]), "word string, embedding array<double>")
    if by_triples:
        n = slots.groupBy("word").agg(F.count("*").alias("n"))
        out = out.join(n, "word").select("word", F.transform("embedding", lambda x: x / F.col("n")).alias("embedding"))
    return out


def word_embeddings(slots: DataFrame, vectors: DataFrame, aggregation: str = "sum", by_triples: bool = False) -> DataFrame:
    """word, dim, value of embedding_arrays."""
    return embedding_arrays(slots, vectors, aggregation, by_triples).select("word", F.posexplode("embedding").alias("dim", "value"))


def _rows_of(logits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the lists, and where each list begins; null lists are empty."""
    sizes = pc.fill_null(pc.list_value_length(logits), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return logits.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def _softplus(x: np.ndarray) -> np.ndarray:
    """log(1 + exp(-x)), stable for large values of either sign."""
    return np.log1p(np.exp(-np.abs(x))) + np.maximum(-x, 0)


def _totals(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0.0], np.cumsum(values)])
    return upto[bounds[1:]] - upto[bounds[:-1]]


def row_loss(logits: Column, hits: Column, positive_weight: float) -> Column:
    """Sum over a row's slots of the binary cross entropy: that of a row without hits, corrected at the few hits. logits: all slots in
    order, hits: the different slots that are hit."""

    @F.arrow_udf(returnType=DoubleType())
    def run(x: pa.Array, h: pa.Array) -> pa.Array:
        values, bounds = _rows_of(x)
        slots, of = _rows_of(h)
        none = _totals(values + _softplus(values), bounds)
        at = values[(np.repeat(bounds[:-1], np.diff(of)) + slots).astype(np.int64)]
        return pa.array(none + _totals(positive_weight * _softplus(at) - at - _softplus(at), of))

    return run(logits, hits)


def loss(rows: DataFrame, hits: DataFrame, positive_weight: float = 1.0, scale: float = 1.0) -> DataFrame:
    """One row, loss: the mean over all (position, slot) pairs; slots without a hit count as 0, with no dense target made.
    rows(seq, logits, loss_weight), hits(seq, vocab_id[, ...]): the logits stay in their rows, and only the slots that a row hits move."""
    hit = hits.groupBy("seq").agg(F.collect_set(F.col("vocab_id").cast("int")).alias("hit"))
    each = rows.join(hit, "seq", "left").select(F.coalesce("hit", F.array().cast("array<int>")).alias("hit"), "logits", "loss_weight")
    sums = each.select((row_loss(F.col("logits"), F.col("hit"), positive_weight) * F.col("loss_weight")).alias("l"), F.size("logits").alias("n"))
    return sums.agg((F.sum("l") / F.sum("n") * scale).alias("loss"))


@F.arrow_udf(returnType=ArrayType(DoubleType()))
def _activations(logits: pa.Array) -> pa.Array:
    """For each row: sum of the activations, and how many exceed i / 10."""
    values, bounds = _rows_of(logits)
    a = 1 / (1 + np.exp(-values))
    columns = [_totals(a, bounds), *[_totals((a > i / 10).astype(float), bounds) for i in range(11)]]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, 12 * len(logits) + 1, 12, dtype=np.int32)), pa.array(np.stack(columns, axis=1).ravel()))


def activation_statistics(rows: DataFrame) -> DataFrame:
    """rows(seq, logits, loss_weight): mean activation of weighted positions, and for i = 0..10 how many activations exceed i / 10,
    over the sum of all weights."""
    shown = F.when(F.col("loss_weight") > 0, F.col("logits").cast("array<double>")).otherwise(F.array().cast("array<double>"))
    each = rows.select(shown.alias("x"), "loss_weight").select("loss_weight", F.size("x").alias("n"), _activations(F.col("x")).alias("s"))
    sums = each.agg(F.sum("loss_weight").alias("w"), F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(12)])
    return sums.select((F.col("s0") / F.col("n")).alias("mean_activation"), *[(F.col(f"s{i + 1}") / F.col("w")).alias(f"over_{i}") for i in range(11)])


def metric_means(rows: DataFrame) -> DataFrame:
    """rows(name, step, rank, value): the mean over ranks of each rank's mean; 0 where any value is null."""
    each = rows.groupBy("name", "step", "rank").agg(F.avg("value").alias("v"), F.max(F.col("value").isNull()).alias("missing"))
    return each.groupBy("name", "step").agg(F.when(F.max("missing"), F.lit(0.0)).otherwise(F.avg("v")).alias("value"))


def learning_rate(step: Column, config: ScheduleConfig) -> Column:
    """Linear warm-up to the rate, then constant, or decay to the minimum over decay_steps."""
    c = config
    warm = F.lit(c.rate) * step / float(max(c.warmup_steps, 1))
    share = F.least((step - c.warmup_steps) / float(max(c.decay_steps - c.warmup_steps, 1)), F.lit(1.0))
    if c.style == "constant":
        after = F.lit(c.rate)
    elif c.style == "linear":
        after = F.lit(c.minimum) + (c.rate - c.minimum) * (1.0 - share)
    elif c.style == "cosine":
        after = F.lit(c.minimum) + (c.rate - c.minimum) * 0.5 * (F.cos(math.pi * share) + 1.0)
    else:
        raise ValueError(f"no such style: {c.style}")
    late = F.when(step > c.decay_steps, F.lit(c.minimum)).otherwise(after) if c.style != "constant" else after
    return F.when((c.warmup_steps > 0) & (step <= c.warmup_steps), warm).otherwise(late)


def loss_scales(steps: DataFrame, initial: float = 2.0**16, factor: float = 2.0, window: int = 1000, hysteresis: int = 2, minimum: float = 1.0, consecutive: bool = False) -> DataFrame:
    """steps(run, step, overflow): run, step and scale, the loss scale after the step. An overflow (null is none) uses up patience,
    at the last it divides; a step without one multiplies when a positive multiple of `window` such steps came before it.
    Runs are dealt to tasks and read in order of steps; a task carries the state of one run at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, scale, patience, good = object(), initial, hysteresis, 0
        for batch in batches:
            out = []
            for name, overflow in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if name != current:
                    current, scale, patience, good = name, initial, hysteresis, 0
                if overflow:
                    if patience == 1:
                        scale = max(scale / factor, minimum)
                    else:
                        patience -= 1
                    good = 0
                else:
                    if grows := good > 0 and good % window == 0:
                        scale *= factor
                    if grows or consecutive:
                        patience = hysteresis
                    good += 1
                out.append(scale)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["run", "step", "scale"])

    kinds = dict(steps.dtypes)
    dealt = steps.select("run", "step", "overflow").repartition("run").sortWithinPartitions("run", "step")
    return dealt.mapInArrow(run, f"run {kinds['run']}, step {kinds['step']}, scale double")


def rotary_table(positions: DataFrame, dims: int, base: float = 10_000.0) -> DataFrame:
    """pos, i, cos, sin for i < dims / 2."""
    angle = F.col("pos") / F.pow(F.lit(base), 2.0 * F.col("i") / dims)
    return positions.select("pos", F.explode(F.sequence(F.lit(0), F.lit(dims // 2 - 1))).alias("i")).select("pos", "i", F.cos(angle).alias("cos"), F.sin(angle).alias("sin"))
