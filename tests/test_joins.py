import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from kvern import operators as op
from kvern.config import JoinSpec
from kvern.functions import HASHERS
from kvern.operators import aggregate
from kvern.operators.join import fits_broadcast
from kvern.plans import plan_metrics, plan_nodes
from kvern.sources import relation_pair

TUPLE = "id long, payload long"


def rows(spark, ids):
    return spark.createDataFrame([(i, k) for k, i in enumerate(ids)], TUPLE)


def matched(df):
    return op.matched_count(df).first()["matched"]


def test_tiny_pair(spark):
    build, probe = relation_pair(spark, JoinSpec("radix-partitioning", 100, 2000, 1.05, seed=3))
    assert matched(op.no_partitioning(build, probe)) == 2000
    assert {matched(op.radix(build, probe, partitions=n)) for n in (1, 3, 32, 64)} == {2000}


@pytest.mark.parametrize("build, probe, want", [([1, 1, 1, 2], [1, 2, 2, 3], 3), ([1, 2], [3, 4], 0), ([], [1], 0), ([1], [], 0), ([None, 1], [None, 1], 1)])
def test_edge_relations(spark, build, probe, want):
    a, b = rows(spark, build), rows(spark, probe)
    counts = [matched(op.no_partitioning(a, b)), matched(op.no_partitioning(a, b, most=0)), matched(op.radix(a, b, partitions=64)), matched(op.radix(a, b, adaptive=True))]
    assert counts == [want] * 4
    assert op.counted_matches(a, b).first()["matched"] == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 20), max_size=30), st.lists(st.integers(0, 20), max_size=30), st.sampled_from([1, 2, 7]))
def test_strategies_agree(spark, build, probe, n):
    a, b = rows(spark, build), rows(spark, probe)
    want = sum(i in set(build) for i in probe)
    assert matched(op.no_partitioning(a, b)) == matched(op.radix(a, b, partitions=n)) == want
    pairs = sorted(map(tuple, op.joined_tuples(a, b).collect()))
    assert pairs == sorted((i, k, j) for k, i in enumerate(build) for j, x in enumerate(probe) if x == i)


def test_all_one_key(spark):
    assert matched(op.radix(rows(spark, [1]), rows(spark, [1] * 500), partitions=8)) == 500


def test_plans(spark):
    a, b = rows(spark, range(50)), rows(spark, range(50))
    one = op.no_partitioning(a, b)
    one.count()
    assert any("BroadcastHashJoin" in n for n in plan_nodes(one))
    for df in (op.radix(a, b, partitions=5), op.no_partitioning(a, b, most=1)):
        assert "ShuffledHashJoin" in df._jdf.queryExecution().executedPlan().toString()
    text = op.radix(a, b, partitions=5)._jdf.queryExecution().executedPlan().toString()
    assert text.count("hashpartitioning(id") == text.count(", 5)") == 2 or text.count(", 5),") == 2


@pytest.mark.parametrize("hasher", sorted(HASHERS))
def test_partitionwise_counts_add_up(spark, hasher):
    a, b = rows(spark, range(0, 100, 3)), rows(spark, range(100))
    got = op.matches_by_partition(op.radix(a, b), 7, hasher=hasher)
    assert sum(r["n"] for r in got.collect()) == 34


# Intents of the hash tables' own tests: insert then look up, all rows of one key, many keys inserted by several workers.
def test_insert_get_exists(spark):
    table, keys = spark.createDataFrame([(123456789, 987654321)], TUPLE), spark.createDataFrame([(123456789,), (5,)], "id long")
    assert {r["id"]: r["found"] for r in op.exists(keys, table).collect()} == {123456789: True, 5: False}
    got = {r["id"]: (r["payload"], r["matches"]) for r in op.get_first(keys, table).collect()}
    assert got == {123456789: (987654321, 1), 5: (None, 0)}


def test_all_rows_of_a_key(spark):
    table = spark.createDataFrame([(123456789, k) for k in range(10)], TUPLE)
    keys = spark.createDataFrame([(123456789,)], "id long")
    assert sorted(r["payload"] for r in op.get_all(keys, table).collect()) == list(range(10))
    assert op.get_first(keys, table).first()["payload"] == 0


def test_keys_from_several_workers(spark):
    table = spark.range(1000, numPartitions=4).selectExpr("id", "id as payload")
    assert op.exists(spark.range(1000), table).where("found").count() == 1000


def test_null_keys_are_not_found(spark):
    table = spark.createDataFrame([(None, 1)], TUPLE)
    assert op.exists(table.select("id"), table).first()["found"] is False


def test_counted_partitions_are_those_that_are_joined(spark):
    """By murmur3, a partition's count is that of the physical partition."""
    a, b = rows(spark, range(0, 300, 3)), rows(spark, [k % 300 for k in range(900)])
    matched_rows = op.radix(a, b, partitions=7)
    want = {r["p"]: r["n"] for r in matched_rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("id").alias("n")).collect()}
    assert {r["partition"]: r["n"] for r in op.matches_by_partition(matched_rows, 7, hasher="murmur3").collect()} == want


def test_salt_divides_a_hot_key(spark):
    a, b = rows(spark, [1, 1, 2, None]), spark.createDataFrame([(1, k) for k in range(600)] + [(2, 0), (3, 0), (None, 0)], TUPLE).repartition(4)
    joined = op.radix(a, b, partitions=16, salt=8)
    assert matched(joined) == 601 and joined.columns == ["id", "payload"]
    sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("id").alias("n")).collect()]
    assert max(sizes) < 400
    with pytest.raises(ValueError):
        op.radix(a, b, salt=0)


def test_a_hot_key_is_counted_before_it_is_dealt(spark):
    """One row for each task and key crosses the exchange."""
    probe = spark.createDataFrame([(k % 2, k) for k in range(5000)], TUPLE).repartition(3)
    df = op.counted_matches(rows(spark, [1]), probe)
    assert df.collect()[0]["matched"] == 2500
    sent = [m["shuffleRecordsWritten"] for name, m in plan_metrics(df) if "Exchange" in name and m.get("shuffleRecordsWritten")]
    assert 5000 in sent and max(n for n in sent if n != 5000) <= 6


def test_wide_payloads_are_not_broadcast(spark):
    wide = spark.range(10).selectExpr("id", "repeat('x', 1000) as payload")
    assert fits_broadcast(wide) and not fits_broadcast(wide, most=5000) and not fits_broadcast(wide, rows=9)
    assert fits_broadcast(wide.select("id"), most=0)


def test_rising_keys(spark, monkeypatch):
    monkeypatch.setattr(aggregate, "BLOCK", 3)
    counts = [9, 9, 7, 8, 5, 5, 6, 1]
    profile = spark.createDataFrame([(k, n) for k, n in enumerate(counts)], "id long, n long")
    assert sorted(map(tuple, op.rising_keys(profile).collect())) == [(3, 8, 7), (6, 6, 5)]
    assert op.rising_keys(profile.limit(0)).count() == 0
