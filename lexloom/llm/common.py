"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.sources.scratch import written

__all__ = ["numbered", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame, columns: dict[str, str], tag: str) -> DataFrame:
    """A written table with a unique ``rid`` for each row and the named columns (new name: old name), so that rows with
    null or repeated ids stay apart and every later read sees the same numbers."""
    return written(docs.select(*[F.col(old).alias(new) for new, old in columns.items()]).withColumn("rid", F.monotonically_increasing_id()), tag)
