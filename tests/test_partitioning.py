import pytest

from kvern import operators as op
from kvern.functions import partition_of
from kvern.operators.partition import placed


def ordinals(spark, ids):
    return spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id long, payload long")


@pytest.mark.parametrize("rows, workers, want", [(9_999, 8, (1, 10_000)), (10_000, 8, (1, 10_000)), (10_001, 8, (2, 10_000)), (15_000, 15, (2, 10_000)), (55_000, 15, (6, 10_000)), (80_000, 8, (8, 10_000)), (100_003, 8, (8, 12_500)), (0, 4, (0, 10_000))])
def test_worker_split(rows, workers, want):
    assert op.worker_split(rows, workers) == want


@pytest.mark.parametrize("n", [1, 3, 32])
@pytest.mark.parametrize("hasher", ["mod", "murmur3", "xxhash64"])
def test_cluster_is_stable(spark, n, hasher):
    df = ordinals(spark, [(k * 7919) % 53 for k in range(400)])
    got = op.cluster(df, n, 4, hasher=hasher, min_batch=50).collect()
    assert sorted(r["position"] for r in got) == list(range(400))
    want = sorted(got, key=lambda r: (r["partition"], r["payload"]))
    assert [r["position"] for r in want] == list(range(400))
    bounds = op.boundaries(op.sizes(df, n, hasher=hasher)).orderBy("partition").collect()
    assert len(bounds) == n and bounds[0]["start"] == 0 and bounds[-1]["end"] == 400
    assert all(a["end"] == b["start"] for a, b in zip(bounds, bounds[1:], strict=False))
    assert all(bounds[r["partition"]]["start"] <= r["position"] < bounds[r["partition"]]["end"] for r in got)
    assert [r["position"] for r in op.layout(op.cluster(df, n, 4, hasher=hasher, min_batch=50)).collect()] == list(range(400))


def test_one_hot_key_is_divided_among_workers(spark):
    df = ordinals(spark, [1] * 100)
    got = op.prefix_sums(op.histogram(placed(df, 4, 4, min_batch=25))).orderBy("worker").collect()
    assert [(r["partition"], r["n"], r["offset"]) for r in got] == [(1, 25, 0), (1, 25, 25), (1, 25, 50), (1, 25, 75)]


def test_more_partitions_than_keys(spark):
    got = op.sizes(ordinals(spark, range(10)), 64).collect()
    assert len(got) == 64 and sum(r["n"] for r in got) == 10


def test_empty_relation(spark):
    df = ordinals(spark, []) if False else spark.createDataFrame([], "id long, payload long")
    assert op.cluster(df, 4, 4).count() == 0
    assert [(r["start"], r["end"]) for r in op.boundaries(op.sizes(df, 3)).collect()] == [(0, 0)] * 3


def test_radix_partition(spark):
    dealt = op.radix_partition(ordinals(spark, range(100)), 6)
    assert dealt.rdd.getNumPartitions() == 6
    from pyspark.sql import functions as F

    assert dealt.where(F.spark_partition_id() != partition_of("id", 6, "murmur3")).count() == 0


def test_bad_counts(spark):
    df = ordinals(spark, [1])
    for call in (lambda: partition_of("id", 0), lambda: op.radix(df, df, partitions=0), lambda: op.radix_partition(df, 0), lambda: op.worker_split(5, 0)):
        with pytest.raises(ValueError):
            call()


def test_busiest(spark):
    df = spark.createDataFrame([(0, 5, 5), (1, 9, 2), (2, 2, 9), (3, 1, 1)], "worker int, build long, probe long")
    assert tuple(op.busiest(df).first()) == (9, 2)
