"""What a plan that has run says of itself."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def _walk(node) -> Iterator:
    yield node
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _walk(node.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from _walk(node.plan())
    children = node.children()
    for k in range(children.size()):
        yield from _walk(children.apply(k))


def plan_nodes(df: DataFrame) -> list[str]:
    """Names of the physical plan's nodes."""
    return [n.nodeName() for n in _walk(df._jdf.queryExecution().executedPlan())]


def plan_metrics(df: DataFrame) -> list[tuple[str, dict[str, int]]]:
    """Each node's metrics, after an action on this very DataFrame."""
    out = []
    for node in _walk(df._jdf.queryExecution().executedPlan()):
        metrics, keys = node.metrics(), node.metrics().keysIterator()
        own = {}
        while keys.hasNext():
            key = keys.next()
            own[key] = metrics.apply(key).value()
        out.append((node.nodeName(), own))
    return out


def task_times(spark: SparkSession, group: str) -> list[tuple[int, int, int]]:
    """(stage, task, milliseconds that it ran) of all tasks of a job group."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    store, tracker = sc._jsc.sc().statusStore(), sc.statusTracker()
    stages = sorted({s for job in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(job)) for s in info.stageIds if tracker.getStageInfo(s)})
    out = []
    for stage in stages:
        tasks = store.taskList(stage, 0, 1 << 30)
        for k in range(tasks.size()):
            metrics = tasks.apply(k).taskMetrics()
            if metrics.isDefined():
                out.append((stage, tasks.apply(k).index(), metrics.get().executorRunTime()))
    return out
