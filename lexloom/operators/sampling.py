"""Shuffles, the lookup of a global index in shards, and the dealing of slots to ranks and batches."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.config import SampleConfig
from lexloom.functions.base import let
from lexloom.functions.hashing import md5_mod
from lexloom.sources.scratch import written

#: largest index space for which the exact legacy permutation is made on the driver
LEGACY_LIMIT = 5_000_000


def legacy_permutation(spark: SparkSession, count: int, seed: int) -> DataFrame:
    """slot, idx as NumPy's legacy generator shuffles 0..count-1. The generator is sequential, hence the limit."""
    if count > LEGACY_LIMIT:
        raise ValueError(f"use hashed_permutation for more than {LEGACY_LIMIT} samples")
    order = np.arange(count)
    np.random.RandomState(seed).shuffle(order)
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(order)], "slot bigint, idx bigint")


def hash_key(idx: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}_"), idx.cast("string")).cast("binary"))


def hashed_permutation(rows: DataFrame, idx_col: str, seed: int) -> DataFrame:
    """slot, idx in the order of a seeded hash, for any size: rows are dealt to ranges by the hash's first digits, numbered
    inside their range, and moved up by the sizes of the ranges before."""
    keyed = rows.select(F.col(idx_col).alias("idx"), hash_key(F.col(idx_col), seed).alias("key"))
    keyed = keyed.withColumn("range", F.conv(F.substring("key", 1, 5), 16, 10).cast("int"))  # a million ranges
    sizes = keyed.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy("key", "idx"))
    return keyed.withColumn("i", inside).join(before, "range").select((F.col("i") - 1 + F.col("before")).cast("bigint").alias("slot"), "idx")


def shard_ranges(sizes: DataFrame) -> DataFrame:
    """sizes(shard, n): shard, lo, hi. One row for each shard."""
    upto = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    return sizes.select("shard", (upto - F.col("n")).alias("lo"), upto.alias("hi"))


def union_of_shards(shards: list[DataFrame]) -> DataFrame:
    """All shards as one table with `shard`, their number in the order given; their rows are found by `shard_ranges` and `locate`."""
    return reduce(DataFrame.unionByName, [s.withColumn("shard", F.lit(i)) for i, s in enumerate(shards)])


def locate(indices: DataFrame, ranges: DataFrame, idx_col: str = "idx") -> DataFrame:
    """The shard and local index of a global index: an as-of join. Indices and starts of ranges are sorted together, each index takes
    the last start before it, within its sorted range or, where there is none, from the ranges before; only one row
    for each sorted range meets in a window. ranges(shard, lo, hi) do not overlap."""
    kept = [c for c in indices.columns if c != idx_col]
    at = F.struct("shard", "lo", "hi")
    starts = ranges.select(F.col("lo").cast("bigint").alias("__key"), F.lit(0).alias("__kind"), F.col("hi").cast("bigint").alias("__hi"), at.alias("__range"), F.lit(None).cast(indices.select(F.struct(*kept) if kept else F.lit(0)).schema[0].dataType).alias("__row"))
    asked = indices.select(F.col(idx_col).cast("bigint").alias("__key"), F.lit(1).alias("__kind"), F.lit(0).cast("bigint").alias("__hi"), F.lit(None).cast(starts.schema["__range"].dataType).alias("__range"), (F.struct(*kept) if kept else F.lit(0)).alias("__row"))
    order = ["__key", "__kind", "__hi"]
    line = starts.unionByName(asked).repartitionByRange(*order).sortWithinPartitions(*order)
    line = written(line.withColumn("__at", F.monotonically_increasing_id()), "line").withColumn("__part", F.shiftright("__at", 33))
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    ends = line.groupBy("__part").agg(F.max_by("__range", F.when(F.col("__kind") == 0, F.col("__at"))).alias("__end"))
    before = ends.select("__part", F.last("__end", ignorenulls=True).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    found = line.withColumn("__own", F.last("__range", ignorenulls=True).over(inside)).where("__kind = 1").join(before, "__part")
    found = found.withColumn("r", F.coalesce("__own", "__before")).where(F.col("__key") < F.col("r.hi"))
    columns = [F.col("__key").cast(indices.schema[idx_col].dataType).alias(idx_col) if c == idx_col else F.col("__row")[c].alias(c) for c in indices.columns]
    return found.select(*columns, F.col("r.shard").alias("shard"), (F.col("__key") - F.col("r.lo")).alias("local_idx"))


@dataclass(frozen=True)
class Permutation:
    """A keyed permutation of 0 to count - 1 by arithmetic, both ways: rounds of a Feistel network over a x b numbers, the least grid of nearly
    equal sides that holds them; what falls outside is sent through again until it is inside. A new epoch is another key."""

    count: int
    seed: int
    epoch: int = 0
    rounds: int = 4

    @property
    def sides(self) -> tuple[int, int]:
        a = max(1, math.isqrt(max(self.count - 1, 0)) + 1)
        return a, max(1, -(-self.count // a))

    def _round(self, k: int, x: Column, forward: bool) -> Column:
        a, b = self.sides
        left, right = F.floor(x / F.lit(b).cast("decimal(20,0)")).cast("bigint"), x % b
        shift = lambda of, side: md5_mod(F.concat(F.lit(f"{self.seed}_{self.epoch}_{k}_"), of.cast("string")), side).cast("bigint")
        sign = 1 if forward else -1
        if k % 2:
            return left * b + F.pmod(right + sign * shift(left, b), F.lit(b))
        return F.pmod(left + sign * shift(right, a), F.lit(a)) * b + right

    def _through(self, x: Column, forward: bool) -> Column:
        def after(k: int, v: Column) -> Column:
            if k == self.rounds:
                return v
            return let(self._round(k if forward else self.rounds - 1 - k, v, forward), lambda u: after(k + 1, u))

        return after(0, x)

    def _walk(self, x: Column, forward: bool) -> Column:
        """Through the network until the number is inside: a few times at most as a rule, never more often than numbers are outside."""
        a, b = self.sides
        outside = a * b - self.count
        once = self._through(x.cast("bigint"), forward)
        if not outside:
            return once
        again = lambda v: F.aggregate(F.sequence(F.lit(1), F.lit(outside)), v, lambda u, _: F.when(u < self.count, u).otherwise(self._through(u, forward)))
        return let(once, lambda v: F.when(v < self.count, v).otherwise(again(v)))

    def slot(self, idx: Column) -> Column:
        return self._walk(idx, True)

    def index(self, slot: Column) -> Column:
        return self._walk(slot, False)


def dealt(slots: DataFrame, total: int, config: SampleConfig) -> DataFrame:
    """slots(slot) of the current epoch to rank, batch, place; slots consumed before and incomplete batches go."""
    step = config.micro_batch * config.world
    usable = total // config.world // config.micro_batch * step
    if not usable:
        raise ValueError("fewer samples than one micro batch on each rank")
    done = config.consumed % usable
    each = (usable - done) // config.world // config.micro_batch * config.micro_batch
    at = F.col("slot") - done
    out = slots.where((at >= 0) & (at < each * config.world))
    j = F.floor(at / config.world)
    return out.select("slot", (at % config.world).cast("int").alias("rank"), F.floor(j / config.micro_batch).cast("bigint").alias("batch"), (j % config.micro_batch).cast("int").alias("place"))


def epoch_of(total: int, config: SampleConfig) -> int:
    usable = total // config.world // config.micro_batch * config.micro_batch * config.world
    return config.consumed // usable


def epoch_fraction(consumed: Column, total: int) -> Column:
    return consumed / float(total)
