"""Next-word training rows, sparse targets, concatenation, slicing and batch layout.

Rows are one per position: keys of a sample, `pos`, and the position's values. Targets and inputs stay sparse (a row for
each vocabulary slot hit), never sequence x vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.config import SplitConfig
from lexloom.functions import hashing, triples
from lexloom.functions.words import text_to_words


def word_rows(df: DataFrame, keys: list[str], text_col: str, config: SplitConfig, stripped: bool, carry: list[str] = ()) -> DataFrame:
    """keys, carry, pos, word for every word of the prepared text."""
    words = text_to_words(triples.prepared(F.col(text_col), config.lowercase, stripped))
    return df.select(*keys, *carry, F.posexplode(words).alias("pos", "word"))


def training_rows(df: DataFrame, keys: list[str], text_col: str, config: SplitConfig) -> DataFrame:
    """keys, pos, word, target, is_eot, loss_weight: each word with the next as its target. The shift is made inside each
    row's word array, so that nothing is shuffled."""
    words = text_to_words(triples.prepared(F.col(text_col), config.lowercase, True))
    pairs = df.select(*keys, words.alias("__w")).select(*keys, "__w", F.posexplode(F.slice("__w", F.lit(1), F.greatest(F.size("__w") - 1, F.lit(0)))).alias("pos", "word"))
    target = F.get(F.col("__w"), F.col("pos") + 1)
    return pairs.where(F.col("pos") < config.sequence_length).select(*keys, "pos", "word", target.alias("target"), (target == config.end_of_text).alias("is_eot"), F.lit(1.0).alias("loss_weight"))


def weighted_training_rows(parts: DataFrame, keys: list[str], part_col: str, text_col: str, weight_col: str, config: SplitConfig) -> DataFrame:
    """training_rows over parts that follow each other: a target has its own part's weight. All parts of a sample meet in one array."""
    words = text_to_words(triples.prepared(F.col(text_col), config.lowercase, True))
    weighted = F.transform(words, lambda w: F.struct(w.alias("word"), F.col(weight_col).cast("double").alias("weight")))
    each = parts.select(*keys, F.struct(F.col(part_col).alias("p"), weighted.alias("w")).alias("__s"))
    whole = each.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list("__s")), lambda s: s["w"])).alias("__w"))
    pairs = whole.select(*keys, "__w", F.posexplode(F.slice("__w", F.lit(1), F.greatest(F.size("__w") - 1, F.lit(0)))).alias("pos", "__now"))
    target = F.get(F.col("__w"), F.col("pos") + 1)
    return pairs.where(F.col("pos") < config.sequence_length).select(*keys, "pos", F.col("__now.word").alias("word"), target["word"].alias("target"), (target["word"] == config.end_of_text).alias("is_eot"), target["weight"].alias("loss_weight"))


def padded(rows: DataFrame, keys: list[str], length: int) -> DataFrame:
    """Cut or filled up to `length` positions. Filled ones have no words, weight 0 and count as end of text; a sample that is
    filled up gets the plain position ids 0, 1, 2, ..."""
    kept = rows.where(F.col("pos") < length).withColumn("is_padding", F.lit(False))
    sizes = kept.groupBy(*keys).agg((F.max("pos") + 1).alias("n"))
    more = sizes.where(F.col("n") < length).select(*keys, F.explode(F.sequence(F.col("n"), F.lit(length - 1))).alias("pos"))
    more = more.select(*keys, "pos", F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("target"), F.lit(True).alias("is_eot"), F.lit(0.0).alias("loss_weight"), F.lit(True).alias("is_padding"))
    return kept.select(*more.columns).unionByName(more).withColumn("position_id", F.col("pos"))


def slots_of_words(words: DataFrame, config: SplitConfig, word_col: str = "word") -> DataFrame:
    """word, triple_id, slots, is_edge for distinct words. Rows of slots are made once for each distinct triple."""
    distinct = words.select(F.col(word_col).alias("word")).where("word is not null").distinct()
    whole = hashing.is_hashed_whole(F.col("word"), config)
    special = distinct.where(whole).select("word", F.lit(-1).alias("triple_id"), hashing.word_slots(F.col("word"), config).alias("slots"), F.lit(False).alias("is_edge"))
    grams = distinct.where(~whole).select("word", F.explode(triples.triples(F.col("word"))).alias("triple"))
    grams = grams.select("word", triples.triple_to_id(F.col("triple")).alias("triple_id"), triples.touches_edge(F.col("triple")).alias("is_edge"))
    table = grams.select("triple_id").distinct().select("triple_id", hashing.triple_slots(F.col("triple_id"), config).alias("slots"))
    return special.unionByName(grams.join(table, "triple_id").select("word", "triple_id", "slots", "is_edge"))


def sparse_hits(rows: DataFrame, keys: list[str], config: SplitConfig, word_col: str = "target") -> DataFrame:
    """keys, pos, vocab_id, hits: for each slot, how many triples of the position's word map to it. Hits are counted once for
    each distinct word, then joined."""
    of_word = slots_of_words(rows, config, word_col)
    hits = of_word.select("word", F.explode(F.array_distinct("slots")).alias("vocab_id")).groupBy("word", "vocab_id").agg(F.count("*").alias("hits"))
    return rows.select(*keys, "pos", F.col(word_col).alias("word")).join(hits, "word").select(*keys, "pos", "vocab_id", "hits")


def binarised(hits: DataFrame) -> DataFrame:
    return hits.withColumn("hits", F.least("hits", F.lit(1).cast("bigint")))


def sliced(rows: DataFrame, start: int, stop: int) -> DataFrame:
    return rows.where((F.col("pos") >= start) & (F.col("pos") < stop)).withColumn("pos", F.col("pos") - start)


def concatenated(rows: DataFrame, keys: list[str], part_col: str, length: int | None, reset_position_ids: bool) -> DataFrame:
    """Parts of each sample one after another; position ids restart with each part if asked for. Offsets come from the parts' sizes."""
    sizes = rows.groupBy(*keys, part_col).agg((F.max("pos") + 1).alias("n"))
    before = Window.partitionBy(*keys).orderBy(part_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, part_col, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    out = rows.join(offsets, [*keys, part_col])
    out = out.withColumn("position_id", F.col("pos") if reset_position_ids else F.col("pos") + F.col("offset")).withColumn("pos", F.col("pos") + F.col("offset")).drop("offset")
    return out if length is None else out.where(F.col("pos") < length)


def segments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """segment: end-of-text flags strictly before the position. A key is visible to a query of its segment at or after it."""
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("segment", F.coalesce(F.sum(F.col("is_eot").cast("bigint")).over(before), F.lit(0).cast("bigint")))


def segment_spans(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The attention mask as spans: keys, segment, seg_start, seg_end (exclusive)."""
    return segments(rows, keys).groupBy(*keys, "segment").agg(F.min("pos").alias("seg_start"), (F.max("pos") + 1).alias("seg_end"))


def segment_starts(spans: DataFrame, sample_no: Column, length: int, samples: int | None = None) -> DataFrame:
    """Starts of all segments in the flat batch; with `samples`, the batch's end as well."""
    out = spans.select((sample_no.cast("bigint") * length + F.col("seg_start")).alias("start"))
    return out if samples is None else out.unionByName(spans.sparkSession.range(1).select(F.lit(samples * length).cast("bigint").alias("start")))


def coo_ranges(counts: DataFrame, batch_key: str, sample_key: str, count_col: str) -> DataFrame:
    """[coo_start, coo_end) of each sample of a batch."""
    upto = Window.partitionBy(batch_key).orderBy(sample_key).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(count_col).over(upto)
    return counts.select(batch_key, sample_key, (end - F.col(count_col)).alias("coo_start"), end.alias("coo_end"))


def collated(rows: DataFrame, sample_col: str, batch_size: int, length: int, reset_attention_mask: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples numbered from 0 in sample_col, batch_size of them to a batch: the batch's rows (batch, place, pos and the rest),
    the ranges of their rows (batch, place, coo_start, coo_end), and the starts of attention segments in the flat batch (batch,
    start) with the batch's end; one segment to a sample where the mask is not reset at ends of text."""
    batch, place = F.expr(f"{sample_col} div {batch_size}").cast("bigint"), (F.col(sample_col) % batch_size).cast("int")
    placed = rows.withColumn("batch", batch).withColumn("place", place)
    counts = placed.groupBy("batch", "place").agg(F.count("*").alias("n"))
    ranges = coo_ranges(counts, "batch", "place", "n")
    if reset_attention_mask:
        spans = segment_spans(placed, ["batch", "place"])
    else:
        spans = placed.select("batch", "place").distinct().withColumn("seg_start", F.lit(0))
    starts = spans.select("batch", (F.col("place").cast("bigint") * length + F.col("seg_start")).alias("start"))
    ends = counts.groupBy("batch").agg(F.max("place").alias("p")).select("batch", ((F.col("p") + 1).cast("bigint") * length).alias("start"))
    return placed, ranges, starts.unionByName(ends)


def inference_rows(rows: DataFrame, keys: list[str], part_col: str, length: int | None) -> DataFrame:
    """Parts of each sample one after another; position ids go on over parts. With a length, cut or filled up with empty words."""
    out = concatenated(rows, keys, part_col, length, False)
    if length is None:
        return out
    sizes = out.groupBy(*keys).agg((F.max("pos") + 1).alias("n"))
    more = sizes.where(F.col("n") < length).select(*keys, F.explode(F.sequence(F.col("n"), F.lit(length - 1))).alias("pos"))
    return out.select(*keys, "pos", "word", "position_id").unionByName(more.select(*keys, "pos", F.lit("").alias("word"), F.col("pos").alias("position_id")))


def causal_spans(rows: DataFrame, keys: list[str], pad_to: int | None = None) -> DataFrame:
    """The plain causal mask of each sample as spans: keys, pos, key_start, key_end: a position sees keys from key_start up to
    itself. With pad_to, the positions up to it see nothing."""
    seen = rows.select(*keys, "pos", F.lit(0).alias("key_start"), (F.col("pos") + 1).alias("key_end"))
    if pad_to is None:
        return seen
    sizes = rows.groupBy(*keys).agg((F.max("pos") + 1).alias("n"))
    more = sizes.where(F.col("n") < pad_to).select(*keys, F.explode(F.sequence(F.col("n"), F.lit(pad_to - 1))).alias("pos"))
    return seen.unionByName(more.select(*keys, "pos", F.lit(0).alias("key_start"), F.lit(0).alias("key_end")))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
