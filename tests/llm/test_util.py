import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kvern.llm import util


def test_written_tables_are_shared_and_released(spark):
    df = util.written(spark.range(5))
    assert sorted(r["id"] for r in df.collect()) == list(range(5))
    assert df.inputFiles()[0].split(":", 1)[1].lstrip("/").startswith(util.shared_dir(spark).split(":", 1)[-1].lstrip("/"))
    util.release(spark)
    with pytest.raises(Exception, match="(?i)not exist|not found|FAILED_READ"):
        df.collect()


def test_streamed_never_divides_a_key():
    keys = [1, 1, 2, 3, 3, 3, 3, 3, 3, 4, 5, 5]
    batches = [pa.record_batch([pa.array(keys[k : k + 2], pa.int64())], ["k"]) for k in range(0, len(keys), 2)] + [pa.record_batch([pa.array([], pa.int64())], ["k"])]
    got = [t["k"].to_pylist() for t in util.streamed(iter(batches), "k")]
    assert [k for t in got for k in t] == keys
    assert all(a[-1] != b[0] for a, b in zip(got, got[1:], strict=False))
    assert list(util.runs(np.array([1, 1, 2]))) == [0, 2, 3] and list(util.runs(np.zeros(0))) == [0]


def test_batches_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "500")
        util.bounded_batches(spark)
        assert spark.conf.get(key) == "500"
        spark.conf.set(key, "0")
        util.bounded_batches(spark)
        assert int(spark.conf.get(key)) == util.BATCH_ROWS
    finally:
        spark.conf.set(key, before)


def test_dealt_to_gives_each_partition_its_own(spark):
    for n in (1, 7, 64):
        df = spark.createDataFrame([(int(k),) for k in util.dealt_to(spark, n)], "k long").repartition(n, "k")
        assert sorted(r[0] for r in df.select(F.spark_partition_id()).collect()) == list(range(n))


def test_bisected(spark):
    for bounds in ([], [3], [1, 1, 4, 9], list(range(0, 100, 3))):
        got = {r["id"]: r["n"] for r in spark.range(-2, 110).select("id", util.bisected(F.col("id"), bounds).alias("n")).collect()}
        assert got == {k: sum(b <= k for b in bounds) for k in range(-2, 110)}
