"""Sums that go with joins: matches by partition, the busiest worker, how often keys come up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvern.functions.hashing import Hasher, partition_of

#: Keys of a block in which neighbours are compared.
BLOCK = 1 << 16


def matches_by_partition(matched: DataFrame, n: int, key: str = "id", hasher: str | Hasher = "mod") -> DataFrame:
    """(partition, n): matched rows in each partition that has any.

    By "murmur3", these are the very partitions that `radix` joins one by one; by "mod", those that any engine can name.
    """
    return matched.groupBy(partition_of(key, n, hasher).alias("partition")).agg(F.count(F.lit(1)).alias("n"))


def busiest(durations: DataFrame) -> DataFrame:
    """build and probe of the worker (ties: the least) whose sum of both is the largest; durations: worker, build, probe."""
    most = F.max_by(F.struct("build", "probe"), F.struct((F.col("build") + F.col("probe")).alias("sum"), (-F.col("worker")).alias("first")))
    return durations.agg(most.alias("x")).select("x.build", "x.probe")


def frequency_profile(df: DataFrame, key: str = "id") -> DataFrame:
    """(key, n): rows of each key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def rising_keys(profile: DataFrame, key: str = "id") -> DataFrame:
    """The rows (key, n, before) of a frequency profile that have more rows than the key before them; none if counts never rise.

    Keys are compared within blocks of BLOCK, and each block's first key with the last one of the block before: no
    task has all keys.
    """
    k = F.col(key).cast("long")
    blocked = profile.select(k.alias("key"), "n", F.floor(k / BLOCK).alias("block"))
    last = blocked.groupBy("block").agg(F.max(F.struct("key", "n")).alias("x"))
    # A row for each block.
    carried = last.select(F.lead("block").over(Window.orderBy("block")).alias("block"), F.col("x.key").alias("key"), F.col("x.n").alias("n")).where("block is not null")
    w = Window.partitionBy("block").orderBy("key")
    both = blocked.withColumn("own", F.lit(True)).unionByName(carried.withColumn("own", F.lit(False)))
    found = both.select("key", "n", "own", F.lag("n").over(w).alias("before")).where("own and n > before")
    return found.select(F.col("key").alias(key), "n", "before")
