"""Uniform numbers: a multiplicative congruential sequence, and numbers that depend on the row alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The Park-Miller generator (fixed values).
MULTIPLIER, MODULUS = 16807, 2**31 - 1


class LinearCongruential:
    """x -> 16807 x modulo 2**31 - 1; numbers are x over the modulus.  A seed that the modulus divides becomes 1."""

    def __init__(self, seed: int | None = None) -> None:
        if seed is None:
            seed = int(np.random.default_rng().integers(1, MODULUS))
        self.state = seed % MODULUS or 1

    def next(self) -> float:
        self.state = self.state * MULTIPLIER % MODULUS
        return self.state / MODULUS

    def skip(self, n: int) -> LinearCongruential:
        """The generator that n numbers have been taken from: what a task needs that starts at row n."""
        out = LinearCongruential(1)
        out.state = self.state * pow(MULTIPLIER, n, MODULUS) % MODULUS
        return out

    def __iter__(self) -> Iterator[float]:
        while True:
            yield self.next()


def row_uniform(row: Column, seed: int, salt: int = 0) -> Column:
    """A number in (0, 1) for a row's index: the same in every run and under any partitioning."""
    bits = F.shiftrightunsigned(F.xxhash64(row, F.lit(seed), F.lit(salt)), 11)
    return (bits + F.lit(0.5)) / F.lit(float(1 << 53))


def lcg_states(row: np.ndarray, seed: int) -> np.ndarray:
    """The states that the sequence from `seed` has for rows 0, 1, ...: seed times a power of the multiplier, by its binary digits."""
    out = np.full(len(row), LinearCongruential(seed).state, np.int64)
    left, power = row.astype(np.int64) + 1, MULTIPLIER
    while left.any():
        out = np.where(left & 1, out * power % MODULUS, out)
        left, power = left >> 1, power * power % MODULUS
    return out


def lcg_uniform(spark: SparkSession, rows: int, seed: int) -> DataFrame:
    """rows of (id, state, u): row i has the number that the sequence gives after i others; tasks start anywhere in it."""

    @F.pandas_udf("long")
    def state(row: pd.Series) -> pd.Series:
        return pd.Series(lcg_states(row.to_numpy(), seed))

    return spark.range(rows).withColumn("state", state("id")).withColumn("u", F.col("state") / F.lit(float(MODULUS)))
