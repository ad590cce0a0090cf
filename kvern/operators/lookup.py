"""The surface of a multimap index: whether a key is there, its first row, all its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exists(keys: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """keys with `found`; a null key is not found."""
    there = table.select(key).where(F.col(key).isNotNull()).distinct().withColumn("found", F.lit(True))
    return keys.join(there, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def get_first(keys: DataFrame, table: DataFrame, key: str = "id", payload: str = "payload") -> DataFrame:
    """keys with the least payload of their rows in `table` (null without one) and `matches`, how many rows those are."""
    first = table.groupBy(key).agg(F.min(payload).alias(payload), F.count(F.lit(1)).alias("matches"))
    return keys.join(first, key, "left").withColumn("matches", F.coalesce("matches", F.lit(0).cast("long")))


def get_all(keys: DataFrame, table: DataFrame, key: str = "id", payload: str = "payload") -> DataFrame:
    """A row for each key and each of its rows in `table`; rows, not lists, so that a frequent key stays divisible."""
    return keys.join(table.select(key, payload), key)


def bucket_count(rows: int, ratio: float = 1.25) -> int:
    """Buckets that a table of so many rows would be given at a ratio; Spark sizes its own tables, so this is for reports."""
    if rows < 0 or not ratio > 0:
        raise ValueError("rows: not below 0; ratio: above 0")
    return -int(-(rows * ratio) // 1)


def bucket_count_column(rows: Column | str, ratio: float = 1.25) -> Column:
    """The same for a column of table sizes."""
    if not ratio > 0:
        raise ValueError("ratio: above 0")
    return F.ceil((F.col(rows) if isinstance(rows, str) else rows) * F.lit(ratio)).cast("long")
