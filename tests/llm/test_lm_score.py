import math
import random
from collections import Counter

import pytest

from kvern.llm import lm_score as lm
from tests.llm.conftest import prose, words_of


def brute(rows, wanted):
    """Losses by dictionaries of strings, as the module states them; all words and all bigrams count."""
    texts = [(i, words_of(t)) for i, t in rows]

    def events(ws):
        return list(zip(["<", *ws], [*ws, ">"], strict=True)) if ws else []

    def count(docs):
        every = [e for _, ws in docs for e in events(ws)]
        return Counter(w for _, w in every), Counter(every), Counter(h for h, _ in every)

    both = [count([d for d in texts if d[0] in wanted]), count(texts)]
    n = [sum(single.values()) for single, _, _ in both]
    scale = [1.0, n[0] / n[1]]

    def loss(ws, which):
        single, pairs, after = both[which]
        s, out = scale[which], 0.0
        for h, w in events(ws):
            plain = (single[w] * s + lm.ADDED) / (n[0] + lm.ADDED * len(both[1][0]))
            out -= math.log((pairs[h, w] * s + lm.PRIOR * plain) / (after[h] * s + lm.PRIOR))
        return out / max(1, len(events(ws)))

    return {i: (len(ws), loss(ws, 0), loss(ws, 1)) for i, ws in texts}


def agree(docs, labels):
    wanted = {r["doc_id"] for r in labels.collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, got = brute(rows, wanted), lm.score_documents(docs, labels).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows)
    for r in got:
        assert (r["n_tokens"], r["target_loss"], r["background_loss"]) == pytest.approx(want[r["doc_id"]], rel=1e-9, abs=1e-12)
        assert r["score"] == pytest.approx(r["target_loss"] - r["background_loss"], abs=1e-12)


#: With these few, nothing is common but the end of a text, or nearly everything is dealt out, or in many batches.
@pytest.mark.parametrize("words, pairs, at_once", [(1 << 16, 1 << 18, 2 << 20), (0, 0, 2 << 20), (20, 10, 1000)])
def test_agrees_with_dictionaries(tables, monkeypatch, words, pairs, at_once):
    monkeypatch.setattr(lm, "COMMON_WORDS", words)
    monkeypatch.setattr(lm, "COMMON_PAIRS", pairs)
    monkeypatch.setattr(lm, "PAIRS_AT_ONCE", at_once)
    agree(tables("documents"), tables("labels").where("quality = 1"))


def test_any_kind_of_id_and_many_target_ids(spark, monkeypatch):
    monkeypatch.setattr(lm, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(lm, "DOCUMENTS", 1000)
    rng = random.Random(2)
    docs = spark.createDataFrame([(f"d{k}", prose(rng, rng.randint(0, 60))) for k in range(2500)], "doc_id string, text string").repartition(2)
    agree(docs, docs.where("doc_id like '%3'").select("doc_id"))


def test_the_wanted_kind_scores_lower(spark):
    rows = [(k, "red car on the road and more red cars") for k in range(30)] + [(k, "blue fish in the sea with other fish") for k in range(30, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, docs.where("doc_id < 20").select("doc_id")).collect()}
    assert max(got[k] for k in range(30)) < 0 < min(got[k] for k in range(30, 60))


def test_what_comes_up_twice_scores_apart(spark):
    """Rare words and bigrams are held too: of unlike texts that aren't wanted, those that occur twice score higher."""
    rng = random.Random(3)
    once, twice, liked = ([prose(rng, 1000) for _ in range(40)] for _ in range(3))
    rows = [*enumerate(once), *((100 + k, t) for k, t in enumerate(twice)), *((200 + k, t) for k, t in enumerate(twice)), *((300 + k, t) for k, t in enumerate(liked))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, docs.where("doc_id >= 300").select("doc_id")).collect()}
    assert max(got[k] for k in range(40)) < min(got[k] for k in (*range(100, 140), *range(200, 240)))


def test_odd_rows(spark, odd, odd_rows, none):
    out = lm.score_documents(odd, odd.where("doc_id > 5")).collect()
    assert len(out) == len(odd_rows)
    assert all(r["n_tokens"] > 0 or r["score"] == 0 for r in out) and all(math.isfinite(r["score"]) for r in out)
    assert lm.score_documents(none, odd).count() == 0
    assert {r["score"] for r in lm.score_documents(odd, none).collect()} == {0.0}


def test_large_vocabularies(spark):
    n = lm.COMMON_WORDS + 1000
    rows = [(d * 100 + k, " ".join(f"w{j}" for j in range(k, n, 100))) for d in range(2) for k in range(100)] + [(900, "once only w1 w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    agree(docs, docs.where("doc_id < 50").select("doc_id"))


def test_no_task_has_a_common_word(spark):
    """One word and one bigram in every text: they are answered on the spot, so no part is larger for them."""
    docs = spark.createDataFrame([(k, f"the cat a{k} b{k} the cat") for k in range(2000)], "doc_id long, text string").repartition(4)
    read = docs.selectExpr("doc_id", "text", "doc_id < 100 as wanted")
    common = lm._common(read)
    the, cat = (lm.textvec.words(*lm.textvec.buffers(lm.pa.array([w]))).hashes for w in ("the", "cat"))
    assert lm.find(common.words, the)[0] >= 0 and lm.find(common.pairs, lm.pair_key(the, cat))[0] >= 0
