"""Word counts over a stream of documents; state grows with distinct words, not with documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lexloom.functions.words import text_to_words


def streaming_word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.select(F.explode(text_to_words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


def windowed_word_counts(docs: DataFrame, time_col: str, window: str, late: str, text_col: str = "text") -> DataFrame:
    """Counts in time windows; rows later than `late` are dropped and closed windows leave the state."""
    rows = docs.withWatermark(time_col, late).select(time_col, F.explode(text_to_words(F.col(text_col))).alias("word"))
    return rows.groupBy(F.window(time_col, window), "word").agg(F.count("*").alias("count"))


def start_corpus_ingest(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends documents to a Parquet corpus, exactly once, as far as the stream has come; then stops."""
    slim = docs.select("doc_id", F.encode("text", "UTF-8").alias("payload")).withColumn("size", F.octet_length("payload").cast("bigint"))
    return slim.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
