"""Relations of (id, payload): generated, or taken from any table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvern.config import JoinSpec
from kvern.sources.zipf import zipf


def sequential(spark: SparkSession, n: int, start: int = 1) -> DataFrame:
    """n rows: ids start, start + 1, ...; payload is the row's index from 0."""
    if n < 0:
        raise ValueError("rows: not below 0")
    return spark.range(n).select((F.col("id") + start).alias("id"), F.col("id").alias("payload"))


def relation_pair(spark: SparkSession, spec: JoinSpec) -> tuple[DataFrame, DataFrame]:
    """The primary relation (unique keys 1 to N) and the secondary (foreign keys in that range), both lazy."""
    seed = 1 if spec.seed is None else spec.seed
    return sequential(spark, spec.primary), zipf(spark, spec.secondary, spec.skew, 1, spec.primary, seed)


def as_relation(df: DataFrame, key: str, payload: str | None = None) -> DataFrame:
    """A table's key, and a payload if one is named, under the names of a relation."""
    return df.select(F.col(key).alias("id"), *([F.col(payload).alias("payload")] if payload else []))
