"""Scoring of dictionary words against logits, greedy and top-k picks, and what follows them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.config import SplitConfig
from lexloom.functions.words import words_to_text
from lexloom.operators.encode import slots_of_words
from lexloom.sources.scratch import written


def logits_of(df: DataFrame, seq_col: str, array_col: str) -> DataFrame:
    """seq, vocab_id, value from dense rows."""
    return df.select(F.col(seq_col).alias("seq"), F.posexplode(array_col).alias("vocab_id", "value")).withColumn("value", F.col("value").cast("double"))


#: words of a block of the dictionary, and rows of a block of logits: what a task holds of either
WORD_BLOCK, ROW_BLOCK = 50_000, 512


@dataclass(frozen=True)
class _Range:
    """Part of a dictionary: its words in order of word_idx, the triples of each, and its slots, those of triples at an edge
    apart, one word after another from starts on."""

    idx: np.ndarray
    words: list[str]
    triples: np.ndarray
    shown: np.ndarray
    slots: np.ndarray
    weights: np.ndarray
    starts: np.ndarray

    def scores(self, active: np.ndarray, config: SplitConfig, digits: int | None) -> np.ndarray:
        """rows x words, NaN where there is no score: with S the word's activations (edge slots weighted), A all activations of
        the row, T its triples: S / (K T) + (S - A) / (V - T K)."""
        across, out = np.ascontiguousarray(active.T), np.empty((len(active), len(self.idx)))
        ends = np.append(self.starts[1:], len(self.slots))
        step = max(1, 4_000_000 // max(1, len(active)))  # slots at once
        lo = 0
        while lo < len(self.idx):
            hi = max(lo + 1, int(np.searchsorted(ends, self.starts[lo] + step, side="right")))
            part = slice(self.starts[lo], ends[hi - 1])
            hit = across[self.slots[part]] * self.weights[part, None]
            out[:, lo:hi] = np.add.reduceat(hit, self.starts[lo:hi] - self.starts[lo], axis=0).T
            lo = hi
        k = self.triples * config.slots
        rest = (out - active.sum(axis=1)[:, None]) / np.where(config.vocab_size == k, np.nan, config.vocab_size - k)
        out = out / k + rest
        return out if digits is None else np.round(out, digits)


def _blocks(dictionary: DataFrame, config: SplitConfig, blacklist: DataFrame | None) -> DataFrame:
    """The dictionary (word_idx, word) with its slots, one row for each WORD_BLOCK numbers: wb, list in order of word_idx."""
    words = dictionary.select("word_idx", "word")
    hidden = blacklist.select("word").distinct().withColumn("hidden", F.lit(True)) if blacklist is not None else None
    marked = words.join(hidden, "word", "left") if hidden is not None else words.withColumn("hidden", F.lit(None).cast("boolean"))
    triples = slots_of_words(words, config)
    each = triples.select("word", F.explode("slots").alias("vocab_id"), "is_edge").groupBy("word").agg(F.sort_array(F.collect_set(F.struct("is_edge", "vocab_id"))).alias("s"))
    sized = triples.groupBy("word").agg(F.count("*").alias("t")).join(each, "word")
    whole = marked.join(sized, "word").select("word_idx", "word", "t", F.col("hidden").isNull().alias("shown"), F.col("s.vocab_id").alias("slots"), F.col("s.is_edge").alias("edges"))
    return whole.groupBy(F.expr(f"word_idx div {WORD_BLOCK}").alias("wb")).agg(F.sort_array(F.collect_list(F.struct("word_idx", "word", "t", "shown", "slots", "edges"))).alias("list"))


def _range_of(block: pa.ListArray, config: SplitConfig) -> _Range:
    part = dict(zip(("idx", "word", "t", "shown", "slots", "edges"), block.flatten().flatten()))
    edges, slots = part["edges"].flatten().to_numpy(zero_copy_only=False), part["slots"]
    return _Range(
        part["idx"].to_numpy(), part["word"].to_pylist(), part["t"].to_numpy().astype(float), part["shown"].to_numpy(zero_copy_only=False).astype(bool),
        slots.flatten().to_numpy(), np.where(edges, config.word_edge_weight, 1.0), np.concatenate([[0], np.cumsum(pc.list_value_length(slots).to_numpy())[:-1]]).astype(np.int64),
    )


KIND = pa.list_(pa.struct([("score", pa.float64()), ("word_idx", pa.int32()), ("word", pa.string())]))
TOP = "top array<struct<score:double,word_idx:int,word:string>>"


def _cell(config: SplitConfig, k: int, digits: int | None):
    """Of each row (seq, logits, target_idx) of a block: its k best words of a block of the dictionary, the greatest score with the sum of
    exp(score - greatest), and the target's score if it is of the block."""

    def run(rows: pa.Table, block: pa.Table) -> pa.Table:
        made = {"seq": [], "top": [], "best": [], "total": [], "target": []}
        part = _range_of(block.column("list").combine_chunks(), config) if block.num_rows and rows.num_rows else None
        shown = np.flatnonzero(part.shown) if part else None
        for at in range(0, rows.num_rows if part else 0, 64):
            batch = rows.slice(at, 64)
            logits = np.array(batch.column("logits").to_pylist(), float).reshape(batch.num_rows, -1)
            score = part.scores(1 / (1 + np.exp(-logits)), config, digits)
            there = ~np.isnan(score)
            lowest = np.where(there, score, -np.inf)
            best = lowest.max(axis=1)
            total = np.where(there, np.exp(np.where(there, score, 0) - np.where(np.isfinite(best), best, 0)[:, None]), 0).sum(axis=1)
            for row in lowest[:, shown]:
                chosen = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))  # all that tie with the k-th
                chosen = chosen[np.lexsort((chosen, -row[chosen]))][:k]
                made["top"].append([{"score": float(row[c]) if np.isfinite(row[c]) else None, "word_idx": int(part.idx[i]), "word": part.words[i]} for c, i in zip(chosen, shown[chosen])])
            wanted = batch.column("target_idx").combine_chunks().fill_null(-1).to_numpy()
            place = np.minimum(np.searchsorted(part.idx, wanted), len(part.idx) - 1)
            target = np.where(part.idx[place] == wanted, score[np.arange(len(score)), place], np.nan)
            made["seq"] += batch.column("seq").to_pylist()
            made["best"] += best.tolist()
            made["total"] += total.tolist()
            made["target"] += [None if np.isnan(t) else float(t) for t in target]
        kinds = {"seq": rows.schema.field("seq").type, "top": KIND, "best": pa.float64(), "total": pa.float64(), "target": pa.float64()}
        return pa.table({n: pa.array(made[n], kind) for n, kind in kinds.items()})

    return run


def decoded(rows: DataFrame, dictionary: DataFrame, config: SplitConfig, k: int, blacklist: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """rows(seq, logits[, target_idx]): seq, top (the k best words with score and word_idx, ties by word_idx), log_total (the
    logarithm of the sum of exp(score) over all words) and target (the score of target_idx). Words of blacklist(word) are
    passed over in the top. Rows and dictionary are dealt to a grid of blocks; a task holds one block of either, and what a cell
    finds is a few numbers for each row, which are merged by row. Scores are rounded to `digits` before anything else, if given."""
    target = F.col("target_idx").cast("int") if "target_idx" in rows.columns else F.lit(None).cast("int")
    across = max(1, -(-rows.count() // ROW_BLOCK))
    words = written(dictionary.select("word_idx", "word"), "dictionary")
    down = (words.agg(F.max("word_idx")).first()[0] or 0) // WORD_BLOCK + 1
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    slim = rows.select("seq", F.col("logits").cast("array<double>").alias("logits"), target.alias("target_idx"), F.pmod(F.xxhash64("seq"), F.lit(across)).cast("int").alias("rb"), all_of(down).alias("wb"))
    blocks = _blocks(words, config, blacklist).select(F.col("wb").cast("int").alias("wb"), "list", all_of(across).alias("rb"))
    schema = f"seq {slim.schema['seq'].dataType.simpleString()}, {TOP}, best double, total double, target double"
    parts = slim.groupBy("rb", "wb").cogroup(blocks.groupBy("rb", "wb")).applyInArrow(_cell(config, k, digits), schema)
    together = parts.groupBy("seq").agg(F.flatten(F.collect_list("top")).alias("all"), F.max("best").alias("m"), F.collect_list(F.struct("best", "total")).alias("e"), F.max("target").alias("target"))
    ordered = F.array_sort("all", lambda a, b: F.when(a["score"].eqNullSafe(b["score"]), a["word_idx"] - b["word_idx"]).when(a["score"].isNull() | (a["score"] < b["score"]), 1).otherwise(-1))
    total = F.aggregate("e", F.lit(0.0), lambda s, x: s + x["total"] * F.exp(x["best"] - F.col("m")))
    return together.select("seq", F.slice(ordered, 1, k).alias("top"), (F.col("m") + F.log(total)).alias("log_total"), "target")


def top_words(found: DataFrame) -> DataFrame:
    """seq, rank from 1, word_idx, word, score, log_prob of what `decoded` found."""
    each = found.select("seq", "log_total", F.posexplode("top").alias("i", "t"))
    return each.select("seq", (F.col("i") + 1).alias("rank"), "t.word_idx", "t.word", "t.score", (F.col("t.score") - F.col("log_total")).alias("log_prob"))


def log_prob_map(found: DataFrame) -> DataFrame:
    """seq, log_probs: word to log probability, of the words that `decoded` found."""
    return found.select("seq", F.map_from_entries(F.transform("top", lambda t: F.struct(t["word"], t["score"] - F.col("log_total")))).alias("log_probs"))


def target_log_probs(found: DataFrame) -> DataFrame:
    """seq, log_prob of each row's target."""
    return found.select("seq", (F.col("target") - F.col("log_total")).alias("log_prob"))


def with_training_counts(picked: DataFrame, counts: DataFrame) -> DataFrame:
    return picked.join(counts.select("word", F.col("count").alias("n_trained")), "word", "left").withColumn("n_trained", F.coalesce("n_trained", F.lit(0).cast("bigint")))


def finished(picked: DataFrame, keys: list[str], step_col: str, end_of_text: str, stop_word: str | None = None) -> DataFrame:
    """The generated words of each sample up to its first end of text or stop word (both left out)."""
    ends = F.col("word").isin(*[w for w in (end_of_text, stop_word) if w is not None])
    first = picked.where(ends).groupBy(*keys).agg(F.min(step_col).alias("__end"))
    return picked.join(first, keys, "left").where(F.col("__end").isNull() | (F.col(step_col) < F.col("__end"))).drop("__end")


def generated_texts(picked: DataFrame, keys: list[str], step_col: str, end_of_text: str, stop_word: str | None = None) -> DataFrame:
    """keys, text, n_words: what `finished` leaves of each sample, joined to a text."""
    kept = finished(picked, keys, step_col, end_of_text, stop_word)
    words = F.transform(F.array_sort(F.collect_list(F.struct(F.col(step_col).alias("s"), F.col("word").alias("w")))), lambda x: x["w"])
    return kept.groupBy(*keys).agg(words.alias("w")).select(*keys, words_to_text(F.col("w")).alias("text"), F.size("w").cast("bigint").alias("n_words"))


def echoed(prompt: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """The prompt's words with the log probability that the row before each gave it, null for the first: keys, pos, word, log_prob.
    prompt(keys, pos, word), scored(keys, pos, log_prob of the next word)."""
    before = scored.select(*keys, (F.col("pos") + 1).alias("pos"), "log_prob")
    return prompt.select(*keys, "pos", "word").join(before, [*keys, "pos"], "left")


def classic_decode(rows: DataFrame, k: int) -> DataFrame:
    """Arg-max and top-k of a plain vocabulary, from rows(seq, logits): seq, rank, vocab_id, log_prob. Inside each row's array."""
    numbered = F.transform(F.col("logits"), lambda v, i: F.struct((-v.cast("double")).alias("v"), i.alias("i")))
    most = F.array_max("logits").cast("double")
    total = F.aggregate("logits", F.lit(0.0), lambda s, v: s + F.exp(v.cast("double") - F.col("m")))
    best = rows.select("seq", "logits", most.alias("m"), F.slice(F.array_sort(numbered), 1, k).alias("t"))
    each = best.select("seq", (F.col("m") + F.log(total)).alias("z"), F.posexplode("t").alias("r", "x"))
    return each.select("seq", (F.col("r") + 1).alias("rank"), F.col("x.i").alias("vocab_id"), (-F.col("x.v") - F.col("z")).alias("log_prob"))
