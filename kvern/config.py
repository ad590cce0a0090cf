"""What a run is asked to do, and what of that is refused before any job starts."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import StrEnum

MIN_BATCH = 10_000
MIN_SKEW = 0.01


class Join(StrEnum):
    NO_PARTITIONING = "no-partitioning"
    RADIX = "radix-partitioning"


class Unit(StrEnum):
    NS = "ns"
    US = "us"
    MS = "ms"
    S = "s"


#: Nanoseconds of each unit (fixed values).
NANOSECONDS = {Unit.NS: 1, Unit.US: 1_000, Unit.MS: 1_000_000, Unit.S: 1_000_000_000}
FORMATS, OUTPUTS = ("json",), ("file",)


@dataclass(frozen=True)
class JoinSpec:
    """Sizes of the relations, the skew of the foreign keys, and how to join.

    `partitions` belongs to the radix join alone, where it is 32 unless given.
    """

    join: Join | str
    primary: int = 10_000_000
    secondary: int = 200_000_000
    skew: float = 1.05
    partitions: int | None = None
    seed: int | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "join", Join(self.join))
        if self.primary < 2:
            raise ValueError("primary: the range of foreign keys needs 2 keys at least")
        if self.secondary < 1:
            raise ValueError("secondary: 1 row at least")
        if not self.skew >= MIN_SKEW:
            raise ValueError(f"skew: {MIN_SKEW} at least")
        if self.join == Join.NO_PARTITIONING and self.partitions is not None:
            raise ValueError("partitions: only the radix join has them")
        if self.join == Join.RADIX and self.partitions is None:
            object.__setattr__(self, "partitions", 32)
        if self.partitions is not None and self.partitions < 1:
            raise ValueError("partitions: 1 at least")

    def parameters(self, compat: bool = False) -> dict[str, str]:
        """What a result names its run by; compat: with the historic spelling of the radix type."""
        out = {"PrimaryRelationSize": str(self.primary), "SecondaryRelationSize": str(self.secondary), "Skew": f"{self.skew:.6f}"}
        out["Type"] = "NoPartitioning" if self.join == Join.NO_PARTITIONING else "RadixParitioning" if compat else "RadixPartitioning"
        if self.join == Join.RADIX:
            out["NumberOfPartitions"] = str(self.partitions)
        return dict(sorted(out.items()))


@dataclass(frozen=True)
class OutputSpec:
    filename: str = "hashjoin.txt"
    format: str = "json"
    output: str = "file"
    unit: Unit | str = field(default=Unit.MS)

    def __post_init__(self) -> None:
        object.__setattr__(self, "unit", Unit(self.unit))
        if not self.filename:
            raise ValueError("filename: may not be empty")
        if self.format not in FORMATS:
            raise ValueError(f"format: one of {FORMATS}")
        if self.output not in OUTPUTS:
            raise ValueError(f"output: one of {OUTPUTS}")
