import hashlib
import random

import pytest

from kvern.llm import sharding
from tests.llm.conftest import CLASHING, SCHEMA, prose


def order(row):
    text = row[1] or ""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16), -(1 << 63) if row[0] is None else row[0]


def check(rows, got, shards, tolerance=0.02):
    """rows and got: (doc_id, text, ...); got has shard and slot last."""
    assert len(rows) == len(got)
    by = {}
    for r in got:
        by.setdefault(r[-2], []).append(r)
    for part in by.values():
        assert sorted(r[-1] for r in part) == list(range(len(part)))
    ordered = sorted(got, key=lambda r: (r[-2], r[-1]))
    assert [order(r) for r in ordered] == sorted(order(r) for r in rows)
    sizes = [sum(len((r[1] or "").encode()) + 1 for r in by.get(s, [])) for s in range(shards)]
    longest = max((len((r[1] or "").encode()) + 1 for r in rows), default=0)
    assert max(sizes) - min(sizes) <= 2 * longest + tolerance * sum(sizes) / shards
    return by


def placed(df, shards):
    return [(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in sharding.shard_documents(df, shards).collect()]


def test_tables(tables):
    df = tables("documents", "sf0.01")
    rows, got = [tuple(r) for r in df.collect()], placed(df, 16)
    by = check(rows, got, 16)
    copies = {}
    for shard, part in by.items():
        for r in part:
            copies.setdefault(r[1], set()).add(shard)
    assert sum(len(s) > 1 for s in copies.values()) <= 3  # large ones on a cut only
    assert sorted(got, key=repr) == sorted(placed(df.repartition(5), 16), key=repr)


def test_hot_group_is_divided(spark):
    rng = random.Random(1)
    rows = [(k, "a text that a third of all rows have", None, None, None) for k in range(300)] + [(k, prose(rng, 12), None, None, None) for k in range(300, 900)]
    check(rows, placed(spark.createDataFrame(rows, SCHEMA), 8), 8)


def test_odd_rows(odd, odd_rows, none, tmp_path):
    out = sharding.shard_documents(odd, 4)
    assert out.columns == [c for c in odd.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    got = [(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in out.collect()]
    check(odd_rows, got, 4)
    assert all(out.first()[c] == -7 for c in CLASHING if c not in ("shard", "slot"))
    assert sharding.shard_documents(none, 4).count() == 0
    assert {r[2] for r in placed(odd, 1)} == {0}
    sharding.write_shards(out, str(tmp_path / "s"))
    assert odd.sparkSession.read.parquet(str(tmp_path / "s")).count() == len(odd_rows)
    with pytest.raises(ValueError):
        sharding.shard_documents(odd, 0)


def test_repeated_rows_are_divided(spark):
    """Half of the rows are one row: shards are as even as without repeats."""
    rng = random.Random(4)
    rows = [(7, "a row that comes again", None, None, None)] * 1500 + [(k, prose(rng, 4), None, None, None) for k in range(1500)]
    by = check(rows, placed(spark.createDataFrame(rows, SCHEMA).repartition(3), 16), 16)
    assert len(by) == 16 and sum(any(r[0] == 7 for r in part) for part in by.values()) > 4


def test_without_whole_groups_cuts_are_where_bytes_divide(spark):
    rows = [(k, f"text {k // 20}", None, None, None) for k in range(400)]
    got = [(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in sharding.shard_documents(spark.createDataFrame(rows, SCHEMA), 7, whole=0.0).collect()]
    check(rows, got, 7, tolerance=0)
    with pytest.raises(ValueError):
        sharding.shard_documents(spark.createDataFrame(rows, SCHEMA), 7, whole=2)
