import json
import logging
import re
import time

import pytest

from kvern.cli import main
from kvern.config import JoinSpec, OutputSpec
from kvern.functions import in_unit
from kvern.log import configure, get_logger
from kvern.operators import joined_partitions
from kvern.plans import NoTimer, PhaseReport, PhaseTimer, Stopwatch, plan_metrics, run_join, sweep, sweep_table, to_json
from kvern.plans.metrics import task_times
from kvern.plans.report import json_column, timings
from kvern.sources import relation_pair
from kvern.streaming import streamed_matches


def test_config():
    spec = JoinSpec("radix-partitioning")
    assert (spec.primary, spec.secondary, spec.skew, spec.partitions) == (10_000_000, 200_000_000, 1.05, 32)
    assert spec.parameters()["Skew"] == "1.050000" and spec.parameters(compat=True)["Type"] == "RadixParitioning"
    assert "NumberOfPartitions" not in JoinSpec("no-partitioning").parameters()
    for bad in ({"primary": 1}, {"skew": 0.0}, {"partitions": 4}, {"secondary": 0}):
        with pytest.raises(ValueError):
            JoinSpec("no-partitioning", **bad)
    with pytest.raises(ValueError):
        JoinSpec("radix-partitioning", partitions=0)
    with pytest.raises(ValueError):
        JoinSpec("sort-merge")
    for bad in ({"filename": ""}, {"unit": "h"}, {"format": "csv"}, {"output": "socket"}):
        with pytest.raises(ValueError):
            OutputSpec(**bad)


def test_timers():
    t = PhaseTimer()
    for _ in range(2):
        with t.phase("build"):
            time.sleep(0.002)
    assert t.durations()["build"] >= 4_000_000 and t.durations()["probe"] == 0
    with pytest.raises(ValueError):
        t.set("probe", -1)
    with pytest.raises(RuntimeError):
        Stopwatch().stop()
    quiet = NoTimer()
    with quiet.phase("build"):
        pass
    quiet.set("probe", 5)
    assert set(quiet.durations().values()) == {0}


def test_json_and_units(spark):
    report = PhaseReport({"b": "2", "a": "1"}, {"partition": 999_999, "build": 1_000_000, "probe": 2_500_000_000})
    told = json.loads(to_json(report, "ms"))
    assert told["results"] == {"partition": "0", "build": "1", "probe": "2500"} and list(told["parameters"]) == ["a", "b"]
    assert [in_unit(1_999_999_999, u) for u in ("ns", "us", "ms", "s")] == [1_999_999_999, 1_999_999, 1999, 1]
    row = spark.createDataFrame([("x", {"b": "2", "a": "1"}, 0, 1, 2)], "id string, parameters map<string,string>, partition long, build long, probe long")
    assert json.loads(json_column(row).first()["json"]) == {"id": "x", "parameters": {"a": "1", "b": "2"}, "results": {"partition": "0", "build": "1", "probe": "2"}}


def test_runs_and_sweep(spark):
    reports = sweep(spark, 100, 2000, 1.05, [2, 4])
    assert [r.matched for r in reports] == [2000] * 3
    assert reports[1].durations["partition"] > 0 and reports[0].durations["partition"] == 0
    table = sweep_table(timings(spark, reports))
    assert set(table.columns) == {"phase", "NoPartitioning", "Radix2", "Radix4"} and table.count() == 3
    assert run_join(spark, JoinSpec("no-partitioning", 10, 50), timer=NoTimer()).durations == {"partition": 0, "build": 0, "probe": 0}


def test_plan_metrics(spark):
    df = spark.range(100).groupBy().count()
    df.collect()
    assert any("shuffleRecordsWritten" in m for _, m in plan_metrics(df))


def test_command_line(spark, tmp_path):
    out = tmp_path / "r.json"
    run = ["--primary", "50", "--secondary", "400", "--log", "error", "-f", str(out), "-u", "us"]
    assert main(["--help"]) == 0 and main(["--join", "x"]) == 1 and main([]) == 1
    assert main(["--join", "no-partitioning", "-p", "4", *run]) == 1 and not out.exists()
    assert main(["--join", "radix-partitioning", "-p", "4", *run]) == 0
    told = json.loads(out.read_text())
    assert told["parameters"]["NumberOfPartitions"] == "4" and set(told["results"]) == {"partition", "build", "probe"}


def test_streamed_probe(spark, tmp_path):
    build = spark.range(0, 100, 2)
    spark.range(100).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    query = streamed_matches(build, stream).writeStream.format("memory").queryName("matches").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("matches").count() == 50
    with pytest.raises(ValueError):
        streamed_matches(build, build)


def test_sweep_command(spark, tmp_path):
    from kvern.operators.lookup import bucket_count
    from kvern.sweep import main as sweep_main

    assert sweep_main(["-p", str(tmp_path), "--primary", "20", "--secondary", "200", "--partitions", "2", "4"]) == 0
    lines = (tmp_path / "figure.dat").read_text().split("\n")
    assert lines[0] == "NumberOfPartitions NoPartitioning Radix2 Radix4" and [x.split()[0] for x in lines[1:4]] == ["Partition", "Build", "Probe"]
    assert sorted(p.name for p in tmp_path.glob("*.txt")) == ["partitions_1.txt", "partitions_2.txt", "partitions_4.txt"]
    assert [bucket_count(n) for n in (0, 1, 10)] == [0, 2, 13] and bucket_count(10, 0.25) == 3


def test_phases_are_measured_and_add_up(spark):
    """The relations are made before the clock runs; what the radix join deals out once is what it joins."""
    spec = JoinSpec("radix-partitioning", 2000, 40_000, 1.05, 8, seed=1)
    began = time.perf_counter_ns()
    report = run_join(spark, spec)
    took = time.perf_counter_ns() - began
    assert report.matched == 40_000 and all(d >= 0 for d in report.durations.values())
    assert 0 < report.durations["partition"] and sum(report.durations.values()) < took
    pair = tuple(df.select("id").repartition(8, "id").cache() for df in relation_pair(spark, spec))
    for df in pair:
        df.count()
    joined = joined_partitions(*pair, ["id"])
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    for df in pair:
        df.unpersist()


def test_task_times(spark):
    spark.sparkContext.setJobGroup("timed", "")
    spark.range(1000, numPartitions=3).selectExpr("sum(id)").collect()
    spark.sparkContext._jsc.clearJobGroup()
    tasks = task_times(spark, "timed")
    assert {k for _, k, _ in tasks} >= {0, 1, 2} and all(ms >= 0 for _, _, ms in tasks)


def test_results_have_the_fixed_id(spark):
    told = json.loads(to_json(PhaseReport({}, {"partition": 0, "build": 0, "probe": 0})))
    assert told["id"] == "hashjointimingresult"


def test_log_lines_name_component_and_table(capsys):
    logger = logging.getLogger("kvern")
    was, logger.handlers = logger.handlers, []
    try:
        configure("trace")
        get_logger("join").about("primary").trace("%d rows", 5)
        configure("error")
        get_logger("join").info("not said")
        lines = capsys.readouterr().err.splitlines()
        assert len(lines) == 1 and re.fullmatch(r"\(join\) \(TRACE\) \(\d\d:\d\d:\d\d\.\d{3}\) \(primary\): 5 rows", lines[0])
    finally:
        logger.handlers = was
