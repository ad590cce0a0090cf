"""Runs of generated relations through a join, with phases."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession

from kvern.config import Join, JoinSpec
from kvern.operators.aggregate import busiest
from kvern.operators.join import joined_partitions, matched_count, no_partitioning
from kvern.operators.partition import radix_partition
from kvern.plans.metrics import plan_metrics, task_times
from kvern.plans.report import PhaseReport
from kvern.plans.timing import PhaseTimer
from kvern.sources.relations import relation_pair

#: The partition counts of the published sweep: powers of two.
SWEEP = [1 << k for k in range(5, 14)]


@contextmanager
def held(frames: Iterable[DataFrame]) -> Iterator[tuple[DataFrame, ...]]:
    """The frames, cached and computed."""
    kept = tuple(df.cache() for df in frames)
    try:
        for df in kept:
            df.count()
        yield kept
    finally:
        for df in kept:
            df.unpersist()


def run_join(spark: SparkSession, spec: JoinSpec, relations: tuple[DataFrame, DataFrame] | None = None, timer: PhaseTimer | None = None) -> PhaseReport:
    """Joins the two relations and reports; they are generated, before any time is taken, unless they are given.

    partition: the job that deals both inputs out, once (radix join only); what it deals is what is joined.  build and
    probe of the radix join: those of the busiest task, of which building took the part that the plan reports of all
    tasks.  Of the join without partitioning: the time to make and send the table, and the rest.
    """
    timer = timer or PhaseTimer()
    if relations is None:
        with held(relation_pair(spark, spec)) as made:
            return run_join(spark, spec, made, timer)
    build, probe = (df.select("id") for df in relations)
    if spec.join != Join.RADIX:
        counted = matched_count(no_partitioning(build, probe, "id"))
        matched, took, _ = _timed(spark, counted)
        built = min(took, sum(m.get(k, 0) for name, m in plan_metrics(counted) if "BroadcastExchange" in name for k in ("collectTime", "buildTime", "broadcastTime")) * 1_000_000)
        timer.set("build", built)
        timer.set("probe", took - built)
        return PhaseReport(spec.parameters(), timer.durations(), matched)
    with ExitStack() as stack:
        with timer.phase("partition"):
            dealt = stack.enter_context(held([radix_partition(build, spec.partitions), radix_partition(probe, spec.partitions)]))
        counted = matched_count(joined_partitions(*dealt, ["id"]))
        matched, took, tasks = _timed(spark, counted)
        built = sum(m.get("buildTime", 0) for name, m in plan_metrics(counted) if "ShuffledHashJoin" in name)
    stage = max({s for s, _, _ in tasks}, key=lambda s: sum(ms for t, _, ms in tasks if t == s), default=None)
    own = [(k, ms * 1_000_000) for s, k, ms in tasks if s == stage]
    share = min(1.0, built / max(1, sum(ms for s, _, ms in tasks if s == stage)))
    workers = spark.createDataFrame([(k, int(ns * share), ns - int(ns * share)) for k, ns in own], "worker long, build long, probe long")
    slowest = busiest(workers).first()
    timer.set("build", min(slowest["build"] or 0, took))
    timer.set("probe", min(slowest["probe"] or 0, took - min(slowest["build"] or 0, took)))
    return PhaseReport(spec.parameters(), timer.durations(), matched)


def _timed(spark: SparkSession, counted: DataFrame) -> tuple[int, int, list[tuple[int, int, int]]]:
    """The count, the nanoseconds that it took, and its tasks."""
    sc, group = spark.sparkContext, f"kvern-{uuid.uuid4()}"
    sc.setJobGroup(group, "join")
    try:
        began = time.perf_counter_ns()
        matched = counted.first()["matched"]
        took = time.perf_counter_ns() - began
    finally:
        sc._jsc.clearJobGroup()
    return matched, took, task_times(spark, group)


def sweep(spark: SparkSession, primary: int, secondary: int, skew: float, partitions: list[int] | None = None, seed: int = 1) -> list[PhaseReport]:
    """The no-partitioning join, then the radix join for each partition count, on one pair of relations."""
    first = JoinSpec(Join.NO_PARTITIONING, primary, secondary, skew, seed=seed)
    specs = [first, *(JoinSpec(Join.RADIX, primary, secondary, skew, n, seed) for n in partitions or SWEEP)]
    with held(relation_pair(spark, first)) as pair:
        return [run_join(spark, s, pair) for s in specs]
