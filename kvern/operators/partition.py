"""The steps of radix clustering as DataFrames: histogram, prefix sums, boundaries, clustered layout.

Rows carry their index (0, 1, ...).  Workers own consecutive batches of it; rows keep their order within a partition, so
that a row's position is a function of the data and the hash alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvern.config import MIN_BATCH
from kvern.functions.hashing import Hasher, partition_of


def worker_split(rows: int, workers: int, min_batch: int = MIN_BATCH) -> tuple[int, int]:
    """Workers and rows of a batch: as many batches as workers, unless they would be below min_batch; the last takes what remains."""
    if workers < 1:
        raise ValueError("workers: 1 at least")
    if rows // workers >= min_batch:
        return workers, rows // workers
    return -(-rows // min_batch), min_batch


def worker_of(index: Column | str, rows: int, workers: int, min_batch: int = MIN_BATCH) -> Column:
    count, batch = worker_split(rows, workers, min_batch)
    at = F.col(index) if isinstance(index, str) else index
    return F.least(F.floor(at / batch), F.lit(max(count - 1, 0))).cast("int")


def radix_partition(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """df dealt to n partitions by a hash of the key."""
    if n < 1:
        raise ValueError("partitions: 1 at least")
    return df.repartition(n, key)


def placed(df: DataFrame, n: int, workers: int, rows: int | None = None, key: str = "id", index: str = "payload", hasher: str | Hasher = "mod", min_batch: int = MIN_BATCH) -> DataFrame:
    """df with `partition` and `worker`."""
    rows = df.count() if rows is None else rows
    return df.withColumn("partition", partition_of(key, n, hasher)).withColumn("worker", worker_of(index, rows, workers, min_batch))


def histogram(placed_: DataFrame) -> DataFrame:
    """(partition, worker, n): rows of each worker for each partition."""
    return placed_.groupBy("partition", "worker").agg(F.count(F.lit(1)).alias("n"))


def prefix_sums(histogram_: DataFrame) -> DataFrame:
    """histogram with `offset`: rows of the workers before, within the partition."""
    before = Window.partitionBy("partition").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    return histogram_.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))


def sizes(df: DataFrame, n: int, key: str = "id", hasher: str | Hasher = "mod") -> DataFrame:
    """(partition, n) for all n partitions, empty ones too."""
    counted = df.select(partition_of(key, n, hasher).alias("partition")).groupBy("partition").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("partition"))
    return every.join(counted, "partition", "left").select("partition", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def boundaries(sizes_: DataFrame) -> DataFrame:
    """(partition, start, end): where each partition lies in the clustered layout; `end` is the first position after it."""
    # As many rows as partitions were asked for: one task's work.
    end = F.sum("n").over(Window.orderBy("partition"))
    return sizes_.select("partition", (end - F.col("n")).alias("start"), end.alias("end"))


def cluster(df: DataFrame, n: int, workers: int, rows: int | None = None, key: str = "id", index: str = "payload", hasher: str | Hasher = "mod", min_batch: int = MIN_BATCH) -> DataFrame:
    """df with `partition`, `worker` and `position`, its place in the clustered layout.

    Position = start of the partition + rows of the workers before + rank among the worker's own.  Ranks are taken for each
    partition and worker, so that no task has a whole partition, however skewed the keys.
    """
    rows = df.count() if rows is None else rows
    spread = placed(df, n, workers, rows, key, index, hasher, min_batch)
    offsets = prefix_sums(histogram(spread)).drop("n")
    starts = boundaries(sizes(df, n, key, hasher)).select("partition", "start")
    rank = F.row_number().over(Window.partitionBy("partition", "worker").orderBy(index)) - 1
    # A row for each partition and worker: bounded by the two parameters.
    where = F.broadcast(offsets.join(starts, "partition"))
    ranked = spread.withColumn("rank", rank.cast("long")).join(where, ["partition", "worker"])
    return ranked.withColumn("position", F.col("start") + F.col("offset") + F.col("rank")).drop("start", "offset", "rank")


def layout(clustered: DataFrame) -> DataFrame:
    """The clustered rows in the order of their positions."""
    return clustered.orderBy("position")
