"""One entry for texts and logits, whichever tokenization the configuration names: words with slots, or a plain vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.config import SplitConfig
from lexloom.operators import classic, decode, encode


def encode_training(df: DataFrame, keys: list[str], text_col: str, config: SplitConfig, vocabulary_path: str | None = None) -> DataFrame:
    """keys, pos, word, target, is_eot, loss_weight; in the plain form keys, pos, token, target."""
    if config.classic:
        return classic.token_training_rows(df, keys, text_col, vocabulary_path).where(F.col("pos") < config.sequence_length)
    return encode.training_rows(df, keys, text_col, config)


def encode_inference(df: DataFrame, keys: list[str], text_col: str, config: SplitConfig, vocabulary_path: str | None = None, stripped: bool = False) -> DataFrame:
    """keys, pos, word, slots (one array for each of its triples, by id); in the plain form keys, pos, token. No targets, no shift."""
    if config.classic:
        return df.select(*keys, F.posexplode(classic.token_ids(F.col(text_col), vocabulary_path)).alias("pos", "token"))
    rows = encode.word_rows(df, keys, text_col, config, stripped)
    of_word = encode.slots_of_words(rows, config).groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("triple_id", "slots"))), lambda s: s["slots"]).alias("slots"))
    return rows.join(of_word, "word").select(*keys, "pos", "word", "slots")


def decode_rows(rows: DataFrame, config: SplitConfig, k: int, dictionary: DataFrame | None = None, blacklist: DataFrame | None = None) -> DataFrame:
    """The k best of each row (seq, logits): seq, rank, word_idx, word, score, log_prob; in the plain form seq, rank, vocab_id, log_prob."""
    if config.classic:
        return decode.classic_decode(rows, k)
    return decode.top_words(decode.decoded(rows, dictionary, config, k, blacklist))


def edge_weighted(rows: DataFrame, config: SplitConfig) -> DataFrame:
    """Training rows whose loss weight is multiplied by word_edge_weight where the target's triple with the highest id touches a
    blank."""
    if config.word_edge_weight == 1.0:
        return rows
    last = encode.slots_of_words(rows, config, "target").groupBy(F.col("word").alias("target")).agg(F.max_by("is_edge", "triple_id").alias("__edge"))
    factor = F.when(F.coalesce("__edge", F.lit(False)), F.lit(config.word_edge_weight)).otherwise(F.lit(1.0))
    return rows.join(last, "target", "left").withColumn("loss_weight", F.col("loss_weight") * factor).select(*rows.columns)
