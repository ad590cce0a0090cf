import numpy as np
import pytest

from kvern.config import JoinSpec
from kvern.functions import LinearCongruential, lcg_uniform
from kvern.sources import as_relation, pmf, relation_pair, sequential, weights, zipf
from kvern.sources.zipf import rejection, shape


def test_sequential(spark):
    assert [tuple(r) for r in sequential(spark, 4, 3).collect()] == [(3, 0), (4, 1), (5, 2), (6, 3)]
    assert sequential(spark, 0).count() == 0


def test_lcg():
    g = LinearCongruential(1)
    for _ in range(10_000):
        last = g.next()
    assert g.state == 1043618065 and 0 < last < 1  # the generator's published check value
    assert LinearCongruential(1).skip(10_000).state == g.state
    assert LinearCongruential(2**31 - 1).state == 1


def chi(counts, p):
    return float(((counts - counts.sum() * p) ** 2 / (counts.sum() * p)).sum())


@pytest.mark.parametrize("alpha", [0.3, 0.9, 0.99, 1.0, 1.05, 1.25, 2.0])
def test_zipf_by_rejection_has_the_distribution(alpha):
    keys = rejection(np.arange(60_000, dtype=np.uint64), alpha, 10, 5)
    counts = np.bincount(keys, minlength=11)[1:]
    assert keys.min() >= 1 and keys.max() <= 10
    assert chi(counts, pmf(alpha, 10)) < 33.7  # 9 degrees of freedom, 1 in 10 000


@pytest.mark.parametrize("alpha", [0.5, 0.99, 1.05])
def test_zipf_by_table(spark, alpha):
    got = zipf(spark, 20_000, alpha, 1, 10, seed=123456789)
    counts = np.zeros(10)
    for r in got.groupBy("id").count().collect():
        counts[r["id"] - 1] = r["count"]
    assert counts.sum() == 20_000 and chi(counts, pmf(alpha, 10)) < 33.7


def test_high_skew_counts_do_not_increase(spark):
    counts = {r["id"]: r["count"] for r in zipf(spark, 10_000, 1.25, 1, 10, seed=123456789).groupBy("id").count().collect()}
    ordered = [counts[k] for k in sorted(counts)]
    assert set(counts) <= set(range(1, 11)) and ordered[0] == max(ordered) and ordered[0] > 2 * ordered[4]


def test_rows_do_not_depend_on_partitions(spark):
    a = zipf(spark, 500, 1.05, 5, 50, seed=2).orderBy("payload").collect()
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "1")
    try:
        assert zipf(spark, 500, 1.05, 5, 50, seed=2).orderBy("payload").collect() == a
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert min(r["id"] for r in a) >= 5 and [r["payload"] for r in a] == list(range(500))


def test_many_keys_are_drawn_without_a_table(spark, monkeypatch):
    from kvern.sources import zipf as module

    monkeypatch.setattr(__import__("sys").modules["kvern.sources.zipf"], "TABLE_KEYS", 5)
    got = zipf(spark, 2000, 1.05, 11, 20, seed=1)
    ids = [r["id"] for r in got.collect()]
    assert min(ids) >= 11 and max(ids) <= 20 and len(ids) == 2000
    assert module


def test_snapped_shape():
    assert shape(1.005)[0] == pytest.approx(0.99) and shape(0.995)[0] == pytest.approx(1.01)
    assert shape(0.99)[0] == 0.99 and weights(1.05, 3, pure=True)[1] == pytest.approx(2**-1.05)


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        zipf(spark, 5, 0.001, 1, 10)
    with pytest.raises(ValueError):
        zipf(spark, 5, 1.05, 3, 3)


def test_relation_pair(spark):
    a, b = relation_pair(spark, JoinSpec("no-partitioning", 50, 300, seed=9))
    assert a.count() == 50 and b.count() == 300
    assert b.join(a, "id", "left_anti").count() == 0
    assert as_relation(a, "id").columns == ["id"]


def test_lcg_rows_are_the_sequence(spark):
    g = LinearCongruential(77)
    want = [g.next() for _ in range(300)]
    assert [r["u"] for r in lcg_uniform(spark, 300, 77).orderBy("id").collect()] == want
    ids = [r["id"] for r in zipf(spark, 300, 1.05, 5, 14, seed=77, uniform="lcg").orderBy("payload").collect()]
    assert ids == [min(int(np.searchsorted(pmf(1.05, 10).cumsum(), u, "right")), 9) + 5 for u in want]


def test_samplers_are_named(spark):
    assert zipf(spark, 50, 1.05, 1, 10, sampler="rejection").count() == zipf(spark, 50, 1.05, 1, 10, sampler="table", pure=True).count() == 50
    for bad in ({"sampler": "other"}, {"sampler": "rejection", "pure": True}, {"sampler": "rejection", "uniform": "lcg"}):
        with pytest.raises(ValueError):
            zipf(spark, 5, 1.05, 1, 10, **bad)
