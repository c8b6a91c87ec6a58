"""Tokenizer and metric stores: a directory with the configuration as JSON and Parquet tables."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.config import SplitConfig
from lexloom.config import from_dict as config_from_dict
from lexloom.functions.hashing import triple_slots
from lexloom.operators.vocabulary import DICTIONARY_LIMIT, dictionary_slots, ranked


def _text(df: DataFrame) -> str:
    return "\n".join(r[0] for r in df.collect())


def save_dictionary(path: str, config: SplitConfig, words: DataFrame, slots: DataFrame) -> None:
    spark = words.sparkSession
    spark.createDataFrame([(json.dumps(dataclasses.asdict(config)),)], "value string").coalesce(1).write.mode("error").text(f"{path}/config")
    words.write.mode("error").parquet(f"{path}/words")
    slots.write.mode("error").parquet(f"{path}/slots")


def load_dictionary(spark: SparkSession, path: str) -> tuple[SplitConfig, DataFrame, DataFrame]:
    config = config_from_dict(SplitConfig, json.loads(_text(spark.read.text(f"{path}/config"))))
    return config, spark.read.parquet(f"{path}/words"), spark.read.parquet(f"{path}/slots")


def load_counts(spark: SparkSession, *paths: str) -> DataFrame:
    """Counter tables (word, count), summed; what is not over 0 goes."""
    return spark.read.parquet(*sorted(paths)).groupBy("word").agg(F.sum("count").alias("count")).where("count > 0")


def triple_table(triple_ids: DataFrame, config: SplitConfig, path: str | None = None) -> DataFrame:
    """triple_id, slots for the distinct ids asked for. With a path, rows are kept under a name made of the sizes; ids that are
    not there yet are made and added."""
    ids = triple_ids.select("triple_id").where("triple_id is not null").distinct()
    made = lambda rows: rows.select("triple_id", triple_slots(F.col("triple_id"), config).alias("slots"))
    if path is None:
        return made(ids)
    spark = triple_ids.sparkSession
    kept = f"{path.rstrip('/')}/{config.vocab_size}-{config.slots}-{config.shared_slots}"
    made(ids.where("false")).write.mode("append").parquet(kept)
    missing = ids.join(spark.read.parquet(kept), "triple_id", "left_anti")
    made(missing).write.mode("append").parquet(kept)
    return spark.read.parquet(kept).dropDuplicates(["triple_id"]).join(ids, "triple_id", "left_semi")


def from_words(counts: DataFrame, config: SplitConfig, path: str, limit: int = DICTIONARY_LIMIT) -> tuple[SplitConfig, DataFrame, DataFrame]:
    """A new dictionary of the most frequent words of counts(word, count), saved and loaded again."""
    words = ranked(counts, limit).select("word_idx", "word")
    save_dictionary(path, config, words, dictionary_slots(words, config))
    return load_dictionary(counts.sparkSession, path)


def from_dict(values: dict, spark: SparkSession) -> tuple[SplitConfig, DataFrame | None, DataFrame | None]:
    """From a dict with the configuration and, if it has one, the path of a saved dictionary."""
    values = dict(values)
    path = values.pop("path", None)
    if path is None:
        return config_from_dict(SplitConfig, values), None, None
    config, words, slots = load_dictionary(spark, path)
    return config_from_dict(SplitConfig, {**dataclasses.asdict(config), **values}), words, slots


def metric_rows(steps: DataFrame, step_col: str, names: list[str]) -> DataFrame:
    """step, name, value from a wide table."""
    return steps.select(F.col(step_col).alias("step"), F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])).alias("name", "value"))


def write_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
