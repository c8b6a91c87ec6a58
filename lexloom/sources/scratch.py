"""Intermediate tables in the shared folder that the cluster names, and numbering that needs one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only where none is named and all tasks run in this machine's one JVM (tests)."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lexloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lexloom-{spark.sparkContext.applicationId}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a written table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_order(rows: DataFrame, order: list[Column], name: str, size: Column | None = None) -> DataFrame:
    """rows and `name`: how many rows come before each in the order, or with a size the sum of their sizes. Rows are dealt to
    ranges, numbered inside each, and moved up by the ranges before; only one row for each range meets in a window. The
    ranges are written, for another shuffle may draw other bounds."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumns({"__at": F.monotonically_increasing_id(), "__n": F.coalesce(size.cast("bigint"), F.lit(0).cast("bigint")) if size is not None else F.lit(1).cast("bigint")}), "ranged")
    part = F.shiftright("__at", 33).alias("__part")
    sums = ranged.groupBy(part).agg(F.sum("__n").alias("__s"))
    before = sums.select("__part", F.coalesce(F.sum("__s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")).alias("__before"))
    if size is None:
        inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    else:
        inside = F.sum("__n").over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    return ranged.withColumn("__part", part).withColumn("__in", inside).join(before, "__part").withColumn(name, F.col("__in") + F.col("__before")).drop("__part", "__at", "__n", "__in", "__before")
