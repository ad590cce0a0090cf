import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kvern.llm import language_id as li
from kvern.llm.util import id_fold


def test_held_out_accuracy(tables):
    docs = tables("documents", "sf0.01")
    model = li.train(docs, li.outside_fold())
    held = docs.where(id_fold(F.col("doc_id"), 3) == 1)
    got = li.identify(held, model, reject=False).select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    assert len(model.langs) == 4 and len(model.centroids) > 8


def test_rejection_and_unknown(tables):
    model = li.train(tables("documents", "sf0.01"))
    langs, scores, far = li.predict(model, pa.array([None, "", "12 %%", "zzzz qqqq xxxx jjjj", "日本語", "the of and that the"]))
    assert langs[:3] == [li.UNKNOWN] * 3 and list(scores[:3]) == [0, 0, 0]
    assert langs[3] in model.langs and langs[4] in model.langs and far[3] and not far[5]
    assert langs[5] == "en"


def test_odd_rows(odd, odd_rows, none):
    model = li.train(odd)
    out = li.identify(odd, model)
    assert set(out.columns) == set(odd.columns) | {"rejected"} and out.count() == len(odd_rows)
    assert li.identify(none, model).count() == 0
    untaught = li.train(none)
    assert {(r["lang_pred"], r["score"]) for r in li.identify(odd, untaught).collect()} == {("und", 0.0)}


def test_clusters():
    rng = np.random.default_rng(0)
    x = np.repeat(np.eye(3), 20, 0) + rng.random((60, 3)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, own = li.cluster(x, 3)
    assert len(c) == 3 and len(set(own[:20])) == 1 and len(set(own)) == 3
    assert len(li.cluster(x[:2], 4)[0]) == 2


def plain_counts(text):
    """Hashed n-grams of one text, a byte at a time."""
    out = np.zeros(li.DIMENSIONS)
    data = [li._LETTERS[b] for b in text.encode()]
    for size in (1, 2, 3):
        for i in range(len(data) - size + 1):
            gram = [int(b) for b in data[i : i + size]]
            if any(gram):
                code = 0
                for b in gram:
                    code = (code * 257 + b) % 2**32
                out[(code * 2654435761 + size * 40503) % 2**32 >> 20] += 1
    return out


def test_predictions_agree_with_plain_nearest_centroids(tables):
    docs = tables("documents", "sf0.01")
    model = li.train(docs)
    texts = [r["text"] for r in docs.limit(60).collect()] + ["Ünïcode 日本", "a"]
    langs, scores, _ = li.predict(model, pa.array(texts))
    for text, lang, score in zip(texts, langs, scores, strict=True):
        v = np.log1p(plain_counts(text)) * model.idf
        near = [float(v @ c) / max(float(np.linalg.norm(v)), 1e-12) for c in model.centroids.astype(float)]
        best = int(np.argmax(near))
        assert lang == model.langs[model.owner[best]] and abs(score - max(0, near[best])) < 1e-5


def test_many_rows_of_a_text_or_without_an_id_do_not_grow_the_sample(spark, monkeypatch):
    monkeypatch.setattr(li, "TRAIN_ROWS", 50)
    rows = [(None, f"some words number {k}", "en") for k in range(3000)] + [(7, f"mots nombre {k}", "fr") for k in range(3000)] + [(k, "les mots", "fr") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    have = docs.groupBy("lang").count().withColumnRenamed("count", "n").collect()
    got = {r["lang"]: r["count"] for r in li._sample(docs, have, "lang", "text").groupBy("lang").count().collect()}
    assert all(10 < n < 110 for n in got.values())
    assert set(li.train(docs).langs) == {"en", "fr"}


def test_quantiles_of_repeated_values():
    rng = np.random.default_rng(1)
    for _ in range(20):
        values, times = rng.random(9), rng.integers(1, 50, 9)
        for q in (0, 0.3, 0.999, 1):
            assert abs(li.quantile(values, times, q) - np.quantile(np.repeat(values, times), q)) < 1e-12


def test_long_texts_count_alike_in_training_and_use(spark):
    """More than 65535 of one n-gram are as many in both."""
    long = "ab " * 80_000
    docs = spark.createDataFrame([(1, long, "xx"), (2, "cd ef gh", "yy")], "doc_id long, text string, lang string")
    model = li.train(docs)
    langs, scores, _ = li.predict(model, pa.array([long]))
    assert langs == ["xx"] and scores[0] > 1 - 1e-5
