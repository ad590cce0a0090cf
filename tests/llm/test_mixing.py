import pytest
from pyspark.sql import functions as F

from kvern.llm import mixing
from tests.llm.conftest import SCHEMA


def test_raked_weights_meet_the_targets(spark, monkeypatch):
    rows = [(s, la, t, 10 + 7 * i * j + k) for i, s in enumerate("abc") for j, la in enumerate(("en", "fr")) for k, t in enumerate(("x", "y"))]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, n_tokens long")
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": 0.5, "topic": {"x": 3.0, "y": 1.0}}
    for most in (10**6, 0):  # by a window, and by aggregation and join
        monkeypatch.setattr(mixing, "WINDOW_CELLS", most)
        raked = mixing.rake(cells, targets, 12).cache()

        def share(dim, value, df=raked):
            return df.where(F.col(dim) == value).agg(F.sum("w")).first()[0]

        assert share("source", "a") == pytest.approx(0.5, abs=1e-5) and share("topic", "x") == pytest.approx(0.75, abs=1e-9)
        n = {r["lang"]: r["n"] for r in cells.groupBy("lang").agg(F.sum("n_tokens").alias("n")).collect()}
        assert share("lang", "en") == pytest.approx(n["en"] ** 0.5 / (n["en"] ** 0.5 + n["fr"] ** 0.5), abs=1e-5)
        got = mixing.probabilities(raked, 0.4).agg(F.sum(F.col("p") * F.col("n_tokens")), F.max("p"), F.sum("n_tokens")).first()
        assert got[0] == pytest.approx(0.4 * got[2], rel=1e-6) and got[1] <= 1


def test_sampled_shares(tables):
    docs = tables("documents", "sf0.01")
    out = mixing.mixed(docs, {"source": {}, "lang": {"en": 0.25, "fr": 0.25, "de": 0.25, "es": 0.25}}, budget=0.3).cache()
    assert out.count() == docs.count()
    n = {r["lang"]: (r["e"], r["s"]) for r in out.groupBy("lang").agg(F.sum(F.col("__kvern_chance") * F.col("__kvern_tokens")).alias("e"), F.sum(F.when(F.col("__kvern_selected"), F.col("__kvern_tokens"))).alias("s")).collect()}
    total = sum(e for e, _ in n.values())
    assert total == pytest.approx(0.3 * out.agg(F.sum("__kvern_tokens")).first()[0], rel=1e-3)
    assert all(e / total == pytest.approx(0.25, abs=0.06) for e, _ in n.values())


def test_odd_rows(odd, odd_rows, none, monkeypatch):
    got = mixing.mixed(odd)
    assert got.count() == len(odd_rows) and all(0 <= r["__kvern_chance"] <= 1 for r in got.collect())
    assert {r["__kvern_topic"] for r in got.collect()} == {"legal", "symbols", "prose"}
    kept = mixing.sample(odd)
    assert kept.columns == odd.columns
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    assert sorted(str(r["doc_id"]) for r in mixing.sample(odd).collect()) == sorted(str(r["doc_id"]) for r in kept.collect())
    assert mixing.sample(none).count() == 0 and mixing.sample(odd, budget=1.0).count() == len(odd_rows)
    assert mixing.mixed(odd, topic_column="lang").where("__kvern_topic is not null").count() == len(odd_rows) - 1
    with pytest.raises(ValueError):
        mixing.sample(none, budget=0)
    assert none.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_a_share_of_0_leaves_a_value_out(spark):
    rows = [(k, f"some words {k}", "xyz"[k % 3], "en") for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = mixing.mixed(docs, {"source": {"x": 0.0, "y": 0.5, "z": 0.5}, "lang": 1.0}, budget=0.4).collect()
    assert {r["__kvern_chance"] == 0 for r in out if r["source"] == "x"} == {True} and not any(r["__kvern_selected"] for r in out if r["source"] == "x")
    assert sum(r["__kvern_chance"] * r["__kvern_tokens"] for r in out) == pytest.approx(0.4 * sum(r["__kvern_tokens"] for r in out))
    assert not any(r["__kvern_selected"] for r in mixing.mixed(docs, {"source": {"x": 0.0, "y": 0.0, "z": 0.0}}).collect())
    for bad in ({"x": -0.1}, {"x": float("nan")}, float("inf")):
        with pytest.raises(ValueError):
            mixing.mixed(docs, {"source": bad})


def test_rounds_go_on_until_all_shares_hold(spark, caplog, monkeypatch):
    cells = spark.createDataFrame([("a", "en", 10_000), ("a", "fr", 1), ("b", "en", 1), ("b", "fr", 10_000)], "source string, lang string, n_tokens long")
    targets = {"source": {"a": 0.7, "b": 0.3}, "lang": {"en": 0.4, "fr": 0.6}}
    raked = mixing.rake(cells, targets)
    assert mixing._residual(raked, list(targets)) <= mixing.TOLERANCE and not caplog.records
    told = {(r["dimension"], r["value"]): r for r in mixing.margins(mixing.probabilities(raked, 0.1), list(targets)).collect()}
    assert told["source", "a"]["target"] == pytest.approx(0.7) and set(told) == {("source", "a"), ("source", "b"), ("lang", "en"), ("lang", "fr")}
    apart = spark.createDataFrame([("a", "en", 5), ("b", "fr", 5)], "source string, lang string, n_tokens long")
    monkeypatch.setattr(mixing, "MOST_ROUNDS", 16)
    mixing.rake(apart, targets)
    assert "contradict" in caplog.text


def test_columns_of_any_name_stay(spark):
    names = ["__topic", "__tokens", "__weight", "__chance", "__selected", "__d_source", "w", "p", "n_tokens", "topic"]
    docs = spark.createDataFrame([(1, "words", "s", "en")], "doc_id long, text string, source string, lang string").withColumns({c: F.lit(-3) for c in names})
    row = mixing.sample(docs, budget=1.0).first()
    assert all(row[c] == -3 for c in names)
