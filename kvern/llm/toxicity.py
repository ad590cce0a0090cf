"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The features of a text are which words, neighbouring pairs and pairs with one or two words between it has,
each hashed to one of 2 ** BITS places.  The regression is fitted one example at a time with a learning
rate for each coordinate; its L1 term leaves most weights at exactly zero, so that what is sent to the
executors is a short list of places and weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvern.llm import textvec
from kvern.llm.util import bounded_batches, give_back, id_fold, in_arrow, written

BITS = 20
FOLDS = 5
#: Labelled documents that the fit takes at most, of each class, and bytes of their texts, about; they are chosen by a hash of the id.
TRAIN_ROWS, TRAIN_BYTES = 4000, 64 << 20
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 16.0, 1.0, 4
#: The part of the loss that label 1 has.
SHARE = 0.4


@dataclass
class Model:
    """Places with a weight, sorted; their weights; the intercept."""

    places: np.ndarray
    weights: np.ndarray
    bias: float


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and text of each feature, with repeats."""
    w = textvec.words(data, bounds)
    got = [textvec.grams(w, 1), textvec.grams(w, 2), textvec.grams(w, 2, 1), textvec.grams(w, 2, 2)]
    return np.concatenate([h >> np.uint64(64 - BITS) for h, _ in got]).astype(np.int64), np.concatenate([r for _, r in got])


def _once(place: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((row << BITS) | place)
    return both & ((1 << BITS) - 1), both >> BITS


def fit(examples: list[tuple[np.ndarray, int]], share: float | None = SHARE) -> Model:
    """The model for examples of (distinct places, label).

    share: the part of label 1 that the classes are weighed to, None to take them as they come.  With examples
    of one label only, every text gets that label; without any, label 0.
    """
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = bias = 0.0
    ones = sum(y for _, y in examples)
    if ones in (0, len(examples)):
        return Model(np.zeros(0, np.int64), np.zeros(0), 35.0 if ones else -35.0)
    cost = {0: 1.0, 1: 1.0}
    if share is not None:
        cost = {1: share * len(examples) / ones, 0: (1 - share) * len(examples) / (len(examples) - ones)}

    def weight(at: np.ndarray) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= L1, 0.0, -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rng = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            at, y = examples[i]
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y) * cost[y]
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
            was = np.sqrt(nb)
            nb += g * g
            zb += g - (np.sqrt(nb) - was) / ALPHA * bias
            bias = -zb / ((BETA + np.sqrt(nb)) / ALPHA)
    places = np.flatnonzero(np.abs(z) > L1)
    return Model(places, weight(places), float(bias))


def scores(model: Model, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The chance of label 1 of each text of a chunk."""
    out = np.full(len(bounds) - 1, model.bias)
    if len(model.places):
        table = np.zeros(1 << BITS)
        table[model.places] = model.weights
        place, row = features(data, bounds)
        weighed = table[place] != 0
        place, row = _once(place[weighed], row[weighed])
        out += np.bincount(row, table[place], minlength=len(out))
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def _sample(docs: DataFrame, labels: DataFrame, label: str, id_column: str, text_column: str, folds: int) -> DataFrame:
    """(id, text, y) of the documents that the fit takes, each id once."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_column).isNotNull() & (id_fold(F.col(id_column), folds) != 0))
    known = known.groupBy(F.col(id_column).alias("id")).agg(F.max(label).cast("int").alias("y"))
    luck = F.xxhash64("id", F.lit("train"))
    drawn = [known.where(F.col("y") == y).orderBy(luck, "id").limit(TRAIN_ROWS) for y in (0, 1)]
    few = drawn[0].unionByName(drawn[1])  # 2 * TRAIN_ROWS rows at most
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(few), "id")
    once = written(rows.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    before = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.partitionBy("y").orderBy(luck, "id").rowsBetween(Window.unboundedPreceding, -1))
    kept = once.select("id", "y", F.coalesce(before, F.lit(0)).alias("before")).where(F.col("before") < TRAIN_BYTES)
    return once.join(F.broadcast(kept.select("id")), "id").select("id", "text", "y")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_column: str = "doc_id", text_column: str = "text", folds: int = FOLDS) -> Model:
    """A model from labelled documents outside the held-out fold: of each label, TRAIN_ROWS ids at most, until their texts have TRAIN_BYTES.

    Labels other than 0 and 1, and null ids, are left out; an id that is labelled several times counts with
    its highest label, and an id that several rows have with one of their texts.  A null text counts as empty.
    """
    texts = _sample(docs, labels, label, id_column, text_column, folds)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, last, data, bounds in textvec.chunks(batch.column("text")):
            place, row = _once(*features(data, bounds))
            at = np.searchsorted(row, np.arange(last - first + 1))
            yield pa.record_batch([batch.column("id").slice(first, last - first), batch.column("y").slice(first, last - first), pa.array([place[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["id", "y", "places"])

    kind = docs.select(id_column).dtypes[0][1]
    got = in_arrow(texts, run, f"id {kind}, y int, places binary").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    examples = [(np.frombuffer(p.as_buffer(), "<u4"), y.as_py()) for p, y in zip(got["places"], got["y"], strict=True)]
    model = fit(examples)
    del got, examples
    give_back()
    return model


def score_documents(docs: DataFrame, model: Model, text_column: str = "text", into: str = "score") -> DataFrame:
    """All rows and columns of docs, and the column `into`, which is replaced if there is one: 0 to 1, the chance of label 1.

    A null text counts as empty; an empty one scores by the intercept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)

    # Only the texts go to Python, and only scores come back.
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(scores(shared.value, data, bounds) for _, _, data, bounds in textvec.chunks(texts))]))

    return docs.withColumn(into, score(text_column))
