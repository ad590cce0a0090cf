"""Results of runs: as JSON with all values as text, as a file, as the table of a sweep."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvern.config import OutputSpec, Unit
from kvern.functions.units import in_unit
from kvern.plans.timing import PHASES

#: What every result calls itself (a fixed value).
REPORT_ID = "hashjointimingresult"


@dataclass
class PhaseReport:
    """Parameters of a run, its phases in nanoseconds, and how many probe rows matched."""

    parameters: dict[str, str]
    durations: dict[str, int]
    matched: int = 0
    id: str = REPORT_ID


def to_json(report: PhaseReport, unit: Unit | str = Unit.MS) -> str:
    results = {p: str(in_unit(report.durations[p], unit)) for p in PHASES}
    return json.dumps({"id": report.id, "parameters": dict(sorted(report.parameters.items())), "results": results}, indent=4) + "\n"


def to_file(text: str, output: OutputSpec) -> None:
    """Overwrites the file; called after a run has succeeded, so that a failed one leaves the earlier result."""
    Path(output.filename).write_text(text)


FORMATTERS: dict[str, Callable[[PhaseReport, Unit], str]] = {"json": to_json}
RENDERERS: dict[str, Callable[[str, OutputSpec], None]] = {"file": to_file}


def render(report: PhaseReport, output: OutputSpec) -> None:
    RENDERERS[output.output](FORMATTERS[output.format](report, output.unit), output)


def json_column(timings: DataFrame) -> DataFrame:
    """The same JSON from rows (id, parameters, partition, build, probe)."""
    results = F.struct(*(F.col(p).cast("string").alias(p) for p in PHASES))
    ordered = F.map_from_entries(F.array_sort(F.map_entries("parameters")))
    return timings.select(F.to_json(F.struct("id", ordered.alias("parameters"), results.alias("results"))).alias("json"))


def timings(spark: SparkSession, reports: Iterable[PhaseReport], unit: Unit | str = Unit.MS) -> DataFrame:
    """(algorithm, phase, duration), three rows a report."""
    rows = []
    for r in reports:
        n = r.parameters.get("NumberOfPartitions")
        rows += [(f"Radix{n}" if n else "NoPartitioning", p.capitalize(), in_unit(r.durations[p], unit)) for p in PHASES]
    return spark.createDataFrame(rows, "algorithm string, phase string, duration long")


def sweep_table(timings_: DataFrame, algorithms: list[str] | None = None) -> DataFrame:
    """A row for each phase, a column for each algorithm; name the algorithms to save a pass and to fix the columns' order."""
    return timings_.groupBy("phase").pivot("algorithm", algorithms).agg(F.first("duration"))
