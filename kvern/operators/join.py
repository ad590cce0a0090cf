"""Equi-joins of a build relation with a probe relation.

The matched rows are those of the probe relation with one match or more: a left semi join, whatever the build
keys' duplicates.  Null keys never match; an empty side matches nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvern.operators.partition import radix_partition

#: Rows of a build relation that are broadcast at most (a long key takes about 30 bytes in the table that each executor holds), and bytes of their texts and nested values.
BROADCAST_ROWS, BROADCAST_BYTES = 4_000_000, 128 << 20
#: Types of a fixed width.
_FIXED = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp", "timestamp_ntz")


def fits_broadcast(build: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether the build side, as it is, has so few rows and so few bytes in columns of no fixed width; no more rows than these are looked at."""
    sizes = [F.octet_length(c) if t in ("string", "binary") else F.octet_length(F.to_json(F.struct(c))) for c, t in build.dtypes if t not in _FIXED]
    width = sum((F.coalesce(s, F.lit(0)) for s in sizes), F.lit(0))
    n, taken = build.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= rows and taken <= most


def no_partitioning(build: DataFrame, probe: DataFrame, key: str = "id", most: int = BROADCAST_ROWS) -> DataFrame:
    """The matched rows of probe, with one table of all build keys on each executor; a build side of over `most` rows is shuffled instead."""
    keys = build.select(key)
    keys = F.broadcast(keys) if fits_broadcast(keys, most) else keys.hint("shuffle_hash")
    return probe.join(keys, key, "left_semi")


def joined_partitions(build: DataFrame, probe: DataFrame, keys: list[str]) -> DataFrame:
    """The matched rows of probe, partition by partition; sides that are dealt alike already stay where they are."""
    return probe.join(build.select(*keys).hint("shuffle_hash"), keys, "left_semi")


def radix(build: DataFrame, probe: DataFrame, key: str = "id", partitions: int = 32, adaptive: bool = False, salt: int = 1) -> DataFrame:
    """The matched rows of probe, both sides dealt to partitions by a hash of the key and joined partition by partition.

    Fixed: both sides have just so many partitions; with a salt, a key's probe rows are dealt to so many of them, and each
    build key goes to all of these, which costs as many copies of the build keys.  Adaptive: as many partitions as
    spark.sql.shuffle.partitions says, and Spark may merge small ones and split skewed ones.  Where a key may hold much
    of the rows, use a salt or adaptive.  Columns named __kvern_* are the join's own.
    """
    if partitions < 1 or salt < 1:
        raise ValueError("partitions, salt: 1 at least")
    if adaptive:
        return joined_partitions(build, probe, [key])
    if salt == 1:
        return joined_partitions(radix_partition(build.select(key), partitions, key), radix_partition(probe, partitions, key), [key])
    spread = probe.withColumn("__kvern_salt", F.monotonically_increasing_id() % salt)
    copies = build.select(key, F.explode(F.sequence(F.lit(0), F.lit(salt - 1)).cast("array<bigint>")).alias("__kvern_salt"))
    keys = [key, "__kvern_salt"]
    return joined_partitions(copies.repartition(partitions, *keys), spread.repartition(partitions, *keys), keys).select(*probe.columns)


def counted_matches(build: DataFrame, probe: DataFrame, key: str = "id") -> DataFrame:
    """How many rows of probe match, as one row `matched`, where the rows themselves aren't asked for.

    Each task counts its probe rows by key before any is dealt out: a key that holds a third of the rows is one row of
    each task, and no partition has more of it than there are tasks.
    """
    counted = probe.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return joined_partitions(build, counted, [key]).agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("matched"))


def joined_tuples(build: DataFrame, probe: DataFrame, key: str = "id", payload: str = "payload", most: int = BROADCAST_ROWS) -> DataFrame:
    """A row for each pair of matching rows: id, payload_a (build), payload_b (probe)."""
    left = build.select(F.col(key).alias("id"), F.col(payload).alias("payload_a"))
    right = probe.select(F.col(key).alias("id"), F.col(payload).alias("payload_b"))
    left = F.broadcast(left) if fits_broadcast(left, most) else left
    return right.join(left, "id").select("id", "payload_a", "payload_b")


def matched_count(matched: DataFrame) -> DataFrame:
    return matched.agg(F.count(F.lit(1)).alias("matched"))
