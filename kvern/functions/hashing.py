"""Which partition a key belongs to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Hasher = Callable[[Column], Column]

#: mod: the key itself, which any engine can repeat; murmur3: what Spark's own exchanges use; xxhash64: a 64-bit hash.
HASHERS: dict[str, Hasher] = {"mod": lambda key: key, "murmur3": lambda key: F.hash(key), "xxhash64": lambda key: F.xxhash64(key)}


def partition_of(key: Column | str, n: int, hasher: str | Hasher = "mod") -> Column:
    """0 to n - 1; a null key has the partition of its hash under murmur3 and xxhash64, none under mod."""
    if n < 1:
        raise ValueError("partitions: 1 at least")
    f = HASHERS[hasher] if isinstance(hasher, str) else hasher
    return F.pmod(f(F.col(key) if isinstance(key, str) else key), F.lit(n)).cast("int")
