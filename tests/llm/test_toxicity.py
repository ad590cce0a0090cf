import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kvern.llm import textvec
from kvern.llm import toxicity as tx
from kvern.llm.util import id_fold
from tests.llm.conftest import prose


def test_held_out_accuracy(tables):
    docs, labels = tables("documents", "sf0.1"), tables("labels", "sf0.1")
    model = tx.train(docs, labels)
    held = docs.where(id_fold(F.col("doc_id"), 5) == 0).join(labels, "doc_id")
    got = tx.score_documents(held, model).select("toxic", "score").collect()
    right = sum((r["score"] >= 0.5) == bool(r["toxic"]) for r in got) / len(got)
    found = [r["score"] >= 0.5 for r in got if r["toxic"]]
    false = [r["score"] >= 0.5 for r in got if not r["toxic"]]
    assert right > 0.95 and sum(found) / len(found) > 0.75 and sum(false) / len(false) < 0.02
    assert 0 < len(model.places) < 5000  # sparse


def examples(texts, labels):
    out = []
    for text, y in zip(texts, labels, strict=True):
        for _, _, data, bounds in textvec.chunks(pa.array([text])):
            out.append((tx._once(*tx.features(data, bounds))[0], y))
    return out


def test_skip_grams_tell_apart():
    rng = random.Random(0)
    texts, labels = [], []
    for k in range(400):
        y = k % 2
        pair = ("red", "car") if y else ("car", "red")
        texts.append(f"{prose(rng, 15)} {pair[0]} {prose(rng, 1)} {pair[1]} {prose(rng, 15)}")
        labels.append(y)
    model = tx.fit(examples(texts[:300], labels[:300]))
    for first, last, data, bounds in textvec.chunks(pa.array(texts[300:])):
        got = tx.scores(model, data, bounds) >= 0.5
        assert (got == np.array(labels[300:][first:last], bool)).mean() > 0.95


def test_without_both_labels(spark, none, odd, odd_rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = tx.train(odd, labels)
    got = tx.score_documents(odd, model).collect()
    assert len(got) == len(odd_rows) and all(r["score"] < 0.01 for r in got)
    assert tx.fit([(np.array([3]), 1)]).bias > 4 > -4 > tx.fit([(np.array([3]), 0)]).bias
    assert tx.score_documents(none, model).count() == 0


def test_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(r[0], None if r[0] == 3 else 1, r[0] % 2 if r[0] is not None else 1) for r in odd_rows] + [(1, 1, None), (1, 1, 7)], "doc_id long, quality int, toxic int")
    out = tx.score_documents(odd, tx.train(odd, labels))
    assert set(out.columns) == set(odd.columns) and all(0 <= r["score"] <= 1 for r in out.collect())
    by = {r["text"]: set() for r in out.collect()}
    for r in out.collect():
        by[r["text"]].add(r["score"])
    assert all(len(s) == 1 for s in by.values())
    empty = tx.train(none, labels)
    assert len(empty.places) == 0


def test_fit_agrees_with_plain_ftrl():
    """One coordinate at a time, in dictionaries."""
    rng = random.Random(5)
    data = [(np.array(sorted(rng.sample(range(200), rng.randint(1, 30))), np.int64), k % 3 // 2) for k in range(300)]
    data = [(np.unique(np.append(at, 777)) if y else at, y) for at, y in data]
    model = tx.fit(data)
    ones = sum(y for _, y in data)
    cost = {1: tx.SHARE * len(data) / ones, 0: (1 - tx.SHARE) * len(data) / (len(data) - ones)}
    z, n, order = {}, {}, np.random.default_rng(1)

    def weight(i):
        zi = z.get(i, 0.0)
        l1, l2 = (0, 0) if i == "bias" else (tx.L1, tx.L2)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((tx.BETA + math.sqrt(n.get(i, 0.0))) / tx.ALPHA + l2)

    for _ in range(tx.EPOCHS):
        for k in order.permutation(len(data)):
            at, y = data[k]
            w = {i: weight(i) for i in (*at.tolist(), "bias")}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y) * cost[y]
            for i, wi in w.items():
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / tx.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - sigma * wi, n.get(i, 0.0) + g * g
    want = {i: weight(i) for i in z if i != "bias" and weight(i)}
    assert model.places.tolist() == sorted(want) and 777 in want
    assert model.weights.tolist() == [pytest.approx(want[i], rel=1e-6) for i in sorted(want)]
    assert abs(model.bias - weight("bias")) < 1e-6


def test_the_sample_is_bounded_whatever_ids_and_texts_there_are(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(2000)] + [(2, "other"), (3, None), (None, "x")], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (None, 1)], "doc_id long, toxic int")
    ids = [r["id"] for r in tx._sample(docs, labels, "toxic", "doc_id", "text", 10**9).collect()]
    assert sorted(ids) == [1, 2, 3]
    monkeypatch.setattr(tx, "TRAIN_ROWS", 1)
    assert tx._sample(docs, labels, "toxic", "doc_id", "text", 10**9).count() == 2
    monkeypatch.setattr(tx, "TRAIN_ROWS", 4000)
    monkeypatch.setattr(tx, "TRAIN_BYTES", 500)
    many = spark.createDataFrame([(k, "a text of 20 letters") for k in range(300)], "doc_id long, text string")
    assert tx._sample(many, many.selectExpr("doc_id", "doc_id % 2 as toxic"), "toxic", "doc_id", "text", 10**9).count() == 50
