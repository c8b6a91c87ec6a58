"""Plain subword tokenization with a vocabulary file, in Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tokenizer(path: str):
    """Read from the path, or as a file sent along with the job."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))


def token_ids(text: Column, vocabulary_path: str) -> Column:
    """array<int>; the file is read once in each task."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _tokenizer(vocabulary_path)
        for texts in batches:
            found = tokenizer.encode_batch(texts.fillna("").tolist(), add_special_tokens=False)
            yield pd.Series([e.ids if t is not None else None for e, t in zip(found, texts)])

    return encode(text)


def token_texts(ids: Column, vocabulary_path: str) -> Column:
    """string: the text of an array of ids, special tokens included."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _tokenizer(vocabulary_path)
        for rows in batches:
            yield pd.Series([None if r is None else t for r, t in zip(rows, tokenizer.decode_batch([[] if r is None else [int(i) for i in r] for r in rows], skip_special_tokens=False))])

    return decode(ids)


def token_training_rows(df: DataFrame, keys: list[str], text_col: str, vocabulary_path: str) -> DataFrame:
    """keys, pos, token, target."""
    coded = df.select(*keys, token_ids(F.col(text_col), vocabulary_path).alias("t"))
    pairs = coded.select(*keys, "t", F.posexplode(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0)))).alias("pos", "token"))
    return pairs.select(*keys, "pos", "token", F.get("t", F.col("pos") + 1).alias("target"))
