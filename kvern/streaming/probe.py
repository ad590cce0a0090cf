"""A probe relation that arrives as a stream, joined with a build relation at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kvern.operators.join import no_partitioning


def streamed_matches(build: DataFrame, probe: DataFrame, key: str = "id") -> DataFrame:
    """The matched rows of a streaming probe side; no state is kept, so any output mode for appended rows serves."""
    if not probe.isStreaming:
        raise ValueError("probe: a streaming DataFrame")
    return no_partitioning(build, probe, key)
