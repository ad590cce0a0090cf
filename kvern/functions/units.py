"""Durations in whole units, cut off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kvern.config import NANOSECONDS, Unit


def in_unit(nanoseconds: int, unit: Unit | str) -> int:
    return nanoseconds // NANOSECONDS[Unit(unit)]


def in_unit_column(nanoseconds: Column | str, unit: Unit | str) -> Column:
    value = F.col(nanoseconds) if isinstance(nanoseconds, str) else nanoseconds
    return F.call_function("div", value.cast("long"), F.lit(NANOSECONDS[Unit(unit)]).cast("long"))
