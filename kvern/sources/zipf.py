"""Skewed foreign keys.

The skew of this workload is not the textbook's.  With s = PIVOT - alpha (within GAP of alpha = 1, s is GAP away from
0 on the other side and alpha is 1 - s) and e = s + alpha, key 1 has the weight 1 + max(0, (1 - alpha) / s - 1) and key k the
weight k**-alpha * (integral of x**(e - 1) from max(k - 1, e**(1 / s)) to k).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvern.config import MIN_SKEW
from kvern.functions.random import lcg_uniform, row_uniform

#: Of the distribution (fixed values).
PIVOT, GAP = 1.001, 0.01
#: Keys whose distribution is held as a table (8 bytes each on every executor) unless a sampler is named; beyond, keys are drawn by rejection.
TABLE_KEYS = 1 << 20
SAMPLERS = ("table", "rejection")


def shape(alpha: float) -> tuple[float, float, float, float]:
    """alpha, s, e and the lower bound of the integral."""
    if not alpha >= MIN_SKEW:
        raise ValueError(f"skew: {MIN_SKEW} at least")
    near = abs(1 - alpha) < GAP
    s = (GAP if alpha > 1 else -GAP) if near else PIVOT - alpha
    own = 1 - s if near else alpha
    return own, s, s + own, (s + own) ** (1 / s)


def weights(alpha: float, n: int, pure: bool = False) -> np.ndarray:
    """Weights of keys 1 to n; pure: the textbook's k**-alpha."""
    k = np.arange(1, n + 1, dtype=np.float64)
    if pure:
        return k**-alpha
    a, s, e, low = shape(alpha)
    out = k**-a * np.maximum(0, k**e - np.maximum(k - 1, low) ** e) / e
    if n:
        out[0] = 1 + max(0.0, (1 - a) / s - 1)
    return out


def pmf(alpha: float, n: int, pure: bool = False) -> np.ndarray:
    w = weights(alpha, n, pure)
    return w / w.sum()


def zipf(spark: SparkSession, rows: int, alpha: float, low: int, high: int, seed: int = 1, pure: bool = False, sampler: str | None = None, uniform: str = "hash") -> DataFrame:
    """rows of (id, payload): ids drawn from low to high, both included; payload is the row's index from 0.

    A row's draw depends on the seed and on its index alone, not on how rows are partitioned.  The two samplers draw
    from one distribution but give other keys for a seed: "table" looks up a uniform number in the cumulated
    distribution, which every executor holds; "rejection" needs no table.  Unless one is named, the number of keys decides.
    uniform: "hash" of the row's index, or "lcg", the congruential sequence (by the table only).
    """
    if low >= high:
        raise ValueError("range: the first key must be below the last")
    if rows < 0:
        raise ValueError("rows: not below 0")
    n = high - low + 1
    shape(alpha)
    if sampler is None:
        sampler = "table" if n <= TABLE_KEYS or pure or uniform == "lcg" else "rejection"
    if sampler not in SAMPLERS or sampler == "rejection" and (pure or uniform != "hash"):
        raise ValueError("sampler: table or rejection; the latter draws this workload's skew alone, by hashed numbers")
    if sampler == "table":
        table = spark.sparkContext.broadcast(np.cumsum(pmf(alpha, n, pure)))

        @F.pandas_udf("long")
        def draw(u: pd.Series) -> pd.Series:
            return pd.Series(np.minimum(np.searchsorted(table.value, u.to_numpy(), "right"), n - 1) + low)

        drawn = lcg_uniform(spark, rows, seed) if uniform == "lcg" else spark.range(rows).withColumn("u", row_uniform(F.col("id"), seed))
        return drawn.select(draw("u").alias("key"), F.col("id").alias("payload")).withColumnRenamed("key", "id")

    def by_rejection(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            row = batch["id"].to_numpy(np.uint64)
            yield pd.DataFrame({"id": rejection(row, alpha, n, seed) + low - 1, "payload": row.astype(np.int64)})

    return spark.range(rows).mapInPandas(by_rejection, "id long, payload long")


def _uniform(row: np.ndarray, seed: int, trial: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = row * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1342543DE82EF95 + trial * 0xBF58476D1CE4E5B9) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53) + 2.0**-54


def rejection(row: np.ndarray, alpha: float, n: int, seed: int) -> np.ndarray:
    """Keys of rows without a table: a point under x**(s - 1), rounded up to k, is kept with the chance (x / k)**alpha."""
    a, s, _, low = shape(alpha)
    low = max(1.0, low)
    head = 1 + max(0.0, (1 - a) / s - 1)
    tail = (n**s - low**s) / s if n > low else 0.0
    out = np.zeros(len(row), np.int64)
    open_, trial = np.arange(len(row)), 0
    while len(open_):
        u, v = (_uniform(row[open_], seed, 2 * trial + j) for j in (0, 1))
        first = u * (head + tail) < head
        over = np.maximum(u * (head + tail) - head, 0)
        x = np.minimum((low**s + over * s) ** (1 / s), n) if tail else np.ones(len(u))
        k = np.where(first, 1, np.maximum(np.ceil(x), 2)).astype(np.int64)
        kept = first | (v <= (x / k) ** a)
        out[open_[kept]] = k[kept]
        open_, trial = open_[~kept], trial + 1
    return out


def zipf_grid(spark: SparkSession, rows: int, alpha: float, n: int, a: int = 48_271, b: int = 11, unit: int = 1_000_000) -> DataFrame:
    """rows of (id, payload) by whole numbers alone, which any engine can repeat.

    Weights are floor(weight * unit), and row i falls at (i * a + b) modulo their sum.  Every executor holds them:
    TABLE_KEYS keys at most.
    """
    if n > TABLE_KEYS:
        raise ValueError(f"n: {TABLE_KEYS} at most")
    grid = np.floor(weights(alpha, n) * unit).astype(np.int64)
    table = spark.sparkContext.broadcast(np.cumsum(grid))
    total = int(grid.sum())
    if not math.gcd(a, total) == 1:
        raise ValueError("a: must have no divisor in common with the sum of the weights")

    @F.pandas_udf("long")
    def draw(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(table.value, at.to_numpy(), "right") + 1)

    return spark.range(rows).select(draw((F.col("id") * a + b) % total).alias("id"), F.col("id").alias("payload"))
