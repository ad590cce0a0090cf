import itertools
import random

import numpy as np
import pytest

from kvern.llm import ngram_join as nj
from kvern.llm.util import components, labels_of
from tests.llm.conftest import SCHEMA, prose, shingles_of


def brute(rows, threshold=0.8):
    """(class, links) by position, from all pairs of whole sets."""
    sets = [shingles_of(r[1]) for r in rows]
    ids = [-(1 << 63) if r[0] is None else r[0] for r in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) >= threshold * len(a | b) - 1e-12:
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return sorted((ids[i], least[find(i)], links[i]) for i in range(len(rows)))


def joined(df, **options):
    return sorted((-(1 << 63) if r["doc_id"] is None else r["doc_id"], r["class_id"], r["n_links"]) for r in nj.join_documents(df, **options).collect())


def family(rng, n, words=60, edits=4):
    base = prose(rng, words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        out.append(" ".join(w))
    return out


def test_agrees_with_all_pairs(spark, monkeypatch):
    rng = random.Random(2)
    shared = prose(rng, 40)
    texts = [*family(rng, 90), *family(rng, 12, 200), *[prose(rng, rng.randint(3, 80)) for _ in range(60)], *[f"{shared} {prose(rng, 5)}" for _ in range(40)], *["same words here again and again"] * 5]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    monkeypatch.setattr(nj, "BLOCK", 8)
    monkeypatch.setattr(nj, "VERIFY_BLOCK", 16)
    monkeypatch.setattr(nj, "FREQUENT", 10)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows)
    assert joined(df) == want
    monkeypatch.setattr(nj, "BROADCAST_ROWS", 0)
    assert joined(df) == want


def test_tables(tables):
    df = tables("documents")
    assert joined(df) == brute([tuple(r) for r in df.collect()])


def test_odd_rows(odd, odd_rows, none):
    assert joined(odd) == brute(odd_rows)
    kept = nj.one_of_each(odd)
    assert kept.columns == odd.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    classes = {c for _, c, _ in brute(odd_rows)}
    assert len(got) == len(set(got)) == len(classes)
    assert nj.one_of_each(kept).count() == len(got)
    assert nj.join_documents(none).count() == nj.one_of_each(none).count() == 0


def test_texts_under_one_id_are_documents_of_their_own(spark):
    rng = random.Random(3)
    a, b = prose(rng, 50), prose(rng, 50)
    rows = [(1, a), (1, b), (1, b), (2, a), (3, ""), (3, "##"), (3, "##"), (None, None), (None, None)]
    kept = nj.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, kept)) == sorted(f"Row(doc_id={i!r}, text={t!r})" for i, t in ((1, a), (1, b), (3, ""), (3, "##"), (None, None)))


def test_bad_threshold(none):
    with pytest.raises(ValueError):
        nj.join_documents(none, threshold=0)


def test_pruning_keeps_what_reaches_the_threshold():
    steps = nj.least_matches(0.8, 1e-6)
    assert [n for n, _ in steps] == list(range(8, 65, 8)) and all(0 < need < n for n, need in steps[1:])
    rng = np.random.default_rng(0)
    lost = (rng.random((20_000, 64)) < 0.8).cumsum(1)[:, 7::8] < np.array([need for _, need in steps])
    assert lost.any(1).mean() < 1e-3
    far = (rng.random((20_000, 64)) < 0.3).cumsum(1)[:, 7::8] < np.array([need for _, need in steps])
    assert far.any(1).mean() > 0.99


def test_components(spark):
    chain = [(k + 1, k) for k in range(100)] + [(200, 300), (300, 250), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(101)}, 200: 200, 300: 200, 250: 200}
    a, b = np.array([5, 3, 1, 7]), np.array([3, 1, 0, 6])
    assert list(labels_of(a, b, 8)) == [0, 0, 2, 0, 4, 0, 6, 6]


def test_units_of_shingles_that_are_not_held_are_divided(spark, monkeypatch):
    """More shingles are frequent than are held: by their real size, units still have two blocks at most, about."""
    rng = random.Random(7)
    texts = [t for _ in range(3) for t in set(family(rng, 200, 60, 12))]
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    want = brute([tuple(r) for r in df.collect()])
    monkeypatch.setattr(nj, "BLOCK", 16)
    monkeypatch.setattr(nj, "FREQUENT_HELD", 1)
    read = df.select(*nj._keyed("doc_id", "text"), "text")
    units = nj._units(read, 5, 0.8, np.zeros(0, np.int64))
    assert max(r["count"] for r in units.groupBy("unit").count().collect()) <= 3 * 16
    assert joined(df) == want


def test_sets_that_share_a_first_key_are_told_apart(spark, monkeypatch):
    real = nj.set_keys

    def few(hashes, row, texts):
        key, second, size = real(hashes, row, texts)
        return key & 3, second, size

    def keyed(hashes, row, texts, shared):
        key, second, size = few(hashes, row, texts)
        return np.where(np.isin(key, shared), second, key), size

    monkeypatch.setattr(nj, "set_keys", few)
    monkeypatch.setattr(nj, "class_keys", keyed)
    rng = random.Random(11)
    texts = [*family(rng, 20), *family(rng, 10, 30, 1), *(prose(rng, 30) for _ in range(10)), ""]
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], SCHEMA)
    assert joined(df) == brute([tuple(r) for r in df.collect()])
