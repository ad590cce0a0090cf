"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed byte 1- to 3-grams of its lower-cased words, weighed by TF-IDF and
normalised.  Each language's training vectors are clustered by cosine to a few centroids; a text
gets the language of the nearest one.  A text farther from it than (nearly) all training texts of that
centroid is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvern.llm import textvec
from kvern.llm.util import id_fold, in_arrow, mapped, numbers, written

UNKNOWN = "und"
FOLDS, HELD_OUT = 3, 1
DIMENSIONS = 4096
#: Different training texts of a language, about; centroids of a language; rounds of clustering.
TRAIN_ROWS, CENTROIDS, ROUNDS = 1000, 4, 12
#: Languages at most (a centroid takes 16 KB on every executor).
LANGUAGES = 1000
#: A text is rejected beyond this quantile of the training distances, times the slack.
QUANTILE, SLACK = 0.999, 1.5
TEXTS_AT_ONCE = 512

#: Digits separate words here.
_LETTERS = textvec._LOWERED.copy()
_LETTERS[0x30:0x3A] = 0
_ASCII_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])


@dataclass
class Model:
    langs: list[str]
    owner: np.ndarray  # language of each centroid
    centroids: np.ndarray
    radius: np.ndarray
    idf: np.ndarray


def counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Counts of the hashed n-grams of each text (float32, a row a text)."""
    n = len(bounds) - 1
    byte = _LETTERS[data].astype(np.uint32)
    row = np.repeat(np.arange(n), np.diff(bounds))
    out = np.zeros(n * DIMENSIONS, np.float32)
    code = np.zeros(len(byte), np.uint32)
    filled = np.zeros(len(byte), bool)
    for size in range(1, 4):
        code = code[: len(byte) - size + 1] * np.uint32(257) + byte[size - 1 :]
        filled = filled[: len(code)] | (byte[size - 1 :] != 0)
        whole = filled & (row[: len(code)] == row[size - 1 :]) if len(code) else filled
        place = (code[whole] * np.uint32(2654435761) + np.uint32(size * 40503)) >> np.uint32(20)
        out += np.bincount(row[: len(code)][whole] * DIMENSIONS + place, minlength=len(out)).astype(np.float32)
    return out.reshape(n, DIMENSIONS)


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(tf) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def has_letter(texts: pa.Array, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether a text has a letter of any script."""
    seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    out = seen[bounds[1:]] > seen[bounds[:-1]]
    for i in np.flatnonzero(~out & (np.diff(bounds) > 0)):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
    return out


def small_chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, last, data, bounds in textvec.chunks(texts):
        for a in range(0, last - first, TEXTS_AT_ONCE):
            b = min(a + TEXTS_AT_ONCE, last - first)
            yield first + a, first + b, data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]


def quantile(values: np.ndarray, times: np.ndarray, q: float) -> float:
    """The quantile of values that come so many times each."""
    order = np.argsort(values)
    upto = np.cumsum(times[order])
    at = q * (upto[-1] - 1)
    low, high = (values[order[np.searchsorted(upto, i, "right")]] for i in (math.floor(at), math.ceil(at)))
    return float(low + (high - low) * (at - math.floor(at)))


def cluster(x: np.ndarray, k: int, rounds: int = ROUNDS, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of normalised vectors, each there so many times, by cosine, and the centroid of each; a start far from those before, then rounds."""
    weighed = x if times is None else x * times[:, None].astype(x.dtype)
    start = [0]
    near = x @ x[0]
    while len(start) < min(k, len(x)):
        start.append(int(near.argmin()))
        near = np.maximum(near, x @ x[start[-1]])
    c = x[start]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([weighed[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, (x @ c.T).argmax(1)


def _sample(read: DataFrame, have: list, lang: str, text_column: str) -> DataFrame:
    """(lang, text, times): different texts, TRAIN_ROWS of each language at most, about; have: rows (lang, n) of all languages."""
    rate = F.create_map(*[F.lit(x) for r in have for x in (r["lang"], TRAIN_ROWS / r["n"])])
    luck = F.pmod(F.xxhash64(text_column, F.lit("language")), F.lit(1 << 40)) / float(1 << 40)
    return read.where(luck < rate[F.col(lang)]).groupBy(F.col(lang).alias("lang"), F.col(text_column).alias("text")).agg(F.count(F.lit(1)).alias("times"))


def train(docs: DataFrame, usable: Column | None = None, lang: str = "lang", text_column: str = "text") -> Model:
    """A model from documents with a language (and `usable`): those of about TRAIN_ROWS rows of each language, chosen by a hash of the text.

    A text that many rows have, whatever their ids, is one row of the sample with their number.  Texts without a letter
    teach nothing.  More than LANGUAGES languages are an error.
    """
    read = docs.where(F.col(lang).isNotNull() & F.col(text_column).isNotNull())
    if usable is not None:
        read = read.where(usable)
    have = read.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()
    if len(have) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not have:
        return Model([], np.zeros(0, int), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0), np.ones(DIMENSIONS, np.float32))
    few = _sample(read, have, lang, text_column)

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, last, data, bounds in small_chunks(batch.column("text")):
            tf = counts(data, bounds)
            keep = np.flatnonzero(has_letter(batch.column("text").slice(first, last - first), data, bounds))
            yield pa.record_batch([*(batch.column(c).slice(first, last - first).take(pa.array(keep)) for c in ("lang", "times")), pa.array([tf[i].astype("<f4").tobytes() for i in keep], pa.binary())], ["lang", "times", "tf"])

    sample = written(in_arrow(few, count, "lang string, times long, tf binary"))

    def read_tf(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, DIMENSIONS)

    def document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                tf, times = read_tf(batch.column("tf").slice(at, TEXTS_AT_ONCE)), numbers(batch.column("times").slice(at, TEXTS_AT_ONCE), "i8")
                df, n = df + times @ (tf > 0), n + int(times.sum())
        yield pa.record_batch([pa.array(np.arange(DIMENSIONS)), pa.array(df), pa.array(np.full(DIMENSIONS, n))], ["place", "df", "n"])

    df = mapped(sample.select("tf", "times"), document_frequency, "place long, df long, n long").groupBy("place").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).toPandas().sort_values("place")
    idf = (np.log((1 + df["n"]) / (1 + df["df"])) + 1).to_numpy(np.float32) if len(df) else np.ones(DIMENSIONS, np.float32)

    def centroids(table: pa.Table) -> pa.Table:
        x = vectors(read_tf(table["tf"].combine_chunks()), idf)
        order = np.lexsort(x[:, :8].T)  # the order in which rows arrive doesn't matter
        x, times = x[order], numbers(table["times"].combine_chunks(), "i8")[order]
        c, own = cluster(x, CENTROIDS, times=times)
        far = [quantile(1 - x[own == j] @ c[j], times[own == j], QUANTILE) if (own == j).any() else 0.0 for j in range(len(c))]
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(c)), "centroid": pa.array([v.astype("<f4").tobytes() for v in c], pa.binary()), "radius": pa.array(far, pa.float64())})

    got = sample.groupBy("lang").applyInArrow(centroids, "lang string, centroid binary, radius double").toPandas().sort_values(["lang", "centroid"])
    langs = sorted(set(got["lang"]))
    return Model(langs, got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), np.array([np.frombuffer(c, "<f4") for c in got["centroid"]]).reshape(-1, DIMENSIONS), got["radius"].to_numpy(), idf)


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Nearest language, cosine (0 to 1) and whether the distance rejects it, for each text."""
    langs, scores, rejected = [], [np.zeros(0)], [np.zeros(0, bool)]
    for first, last, data, bounds in small_chunks(texts):
        letter = has_letter(texts.slice(first, last - first), data, bounds)
        if not model.langs:
            best, score, far = np.zeros(last - first, int), np.zeros(last - first), np.ones(last - first, bool)
        else:
            cosine = vectors(counts(data, bounds), model.idf) @ model.centroids.T
            at = cosine.argmax(1)
            best, score = model.owner[at], cosine.max(1).astype(float)
            far = 1 - score > np.minimum(1, SLACK * model.radius[at])
        known = letter & bool(model.langs)
        langs += [model.langs[j] if k else UNKNOWN for j, k in zip(best, known, strict=True)]
        scores.append(np.where(known, np.clip(score, 0, 1), 0))
        rejected.append(far | ~known)
    return langs, np.concatenate(scores), np.concatenate(rejected)


def identify(docs: DataFrame, model: Model, text_column: str = "text", reject: bool = True) -> DataFrame:
    """All rows and columns of docs, and lang_pred, score, rejected.

    lang_pred is a learned language, or `und` for a null text, a text without a letter and (with `reject`)
    a rejected text; score is the cosine with the nearest centroid, 0 where there is no letter.
    Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    schema = docs.select(*rest).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, score, far = predict(shared.value, batch.column(batch.schema.get_field_index(text_column)))
        langs = [UNKNOWN if reject and r else x for x, r in zip(langs, far, strict=True)]
        return pa.record_batch([*batch.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(far)], [*batch.schema.names, "lang_pred", "score", "rejected"])

    return in_arrow(docs.select(*rest), run, schema)


def outside_fold(id_column: str = "doc_id") -> Column:
    return id_fold(F.col(id_column), FOLDS) != HELD_OUT


