"""What several operators of this subpackage use: written tables, hashes of ids, packed rows."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Rows and bytes of an Arrow batch at most (a longer row is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; only where that is unset and all runs in one process (tests), a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir: must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kvern-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def fresh_path(spark: SparkSession) -> str:
    """A new place in this session's folder under the shared one."""
    return f"{_own(spark)}/{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/kvern-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Deletes all tables that operators have written in this session; results that aren't stored elsewhere can't be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df, written as Parquet under the shared folder and read again: it cuts the lineage, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt_to(spark: SparkSession, n: int) -> np.ndarray:
    """n longs: what is dealt to n partitions by a hash of the k-th one comes to partition k.  Dealt by k itself, some would get several."""
    found = spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("id")).collect()
    keys = np.arange(n, dtype=np.int64)
    keys[[r["at"] for r in found]] = [r["id"] for r in found]
    return keys


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def numbers(column: pa.Array, dtype: str) -> np.ndarray:
    """A primitive Arrow column without nulls as numpy."""
    return column.to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def streamed(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches that are sorted by `key` as tables that never divide a key's rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key)
        if k[0] == k[-1]:  # one key fills the batch
            if held and held[-1].column(key)[-1] != k[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
            continue
        last = numbers(k, "i8")
        cut = int(np.flatnonzero(last != last[-1])[-1]) + 1
        yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def runs(values: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal values."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def bounded_batches(spark: SparkSession) -> None:
    """Lowers what a Python worker gets at once to BATCH_ROWS rows and BATCH_BYTES bytes, where the session allows more: texts can be long.

    The plan reads these when it runs, which is after the caller has its DataFrame, so they stay lowered.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is not None and (not now.isdigit() or int(now) <= 0 or int(now) > most):
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Returns freed memory to the system: workers are kept, several stand idle beside those that run, and a driver lives long."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


Batches = Iterator[pa.RecordBatch]


def mapped(df: DataFrame, f: Callable[[Batches], Batches], schema: str | StructType) -> DataFrame:
    """mapInArrow with bounded batches; the worker gives memory back after each task."""
    bounded_batches(df.sparkSession)

    def run(batches: Batches) -> Batches:
        try:
            yield from f(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def in_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Batches | pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """`mapped` for a function of one batch; what it returns may be one batch or several."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            out = f(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return mapped(df, run, schema)


def labels_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, for edges a[i] - b[i] among n nodes."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        for at in (a, b, before[a], before[b]):
            np.minimum.at(label, at, least)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        rest = label[a] != label[b]
        a, b = a[rest], b[rest]
    return label


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for edges (a, b): root is the least node that a path leads to.

    Each round takes the least label among a node's neighbours, hands it to the node and to the node that
    its label names, and follows labels twice; the rounds needed grow with the logarithm of the longest
    path.  Every round is written, so that plans stay short and nothing is held by one executor alone.
    """
    both = written(edges.select("a", "b").where("a <> b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    state = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    state = written(state)
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("least"))
        hooked = state.join(near, "node").select("node", "root", F.least("root", "least").alias("least"))
        offers = hooked.select(F.explode(F.array(F.struct("node", "least"), F.struct(F.col("root").alias("node"), "least"))).alias("o")).select("o.*")
        best = offers.groupBy("node").agg(F.min("least").alias("root"))
        jumped = best.join(best.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        fresh = written(jumped)
        moved = fresh.join(state.withColumnRenamed("root", "was"), "node").where("root <> was").limit(1).count()
        state = fresh
        if not moved:
            give_back()
            return state


def bisected(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are not above the value."""
    if not bounds:
        return F.lit(0)
    table = F.lit(bounds).cast("array<bigint>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(table, at + step - 1) <= value, F.lit(False)), at + step).otherwise(at))
