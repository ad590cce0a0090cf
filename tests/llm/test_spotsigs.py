import random

import pytest
from pyspark.sql import functions as F

from kvern.llm import queries as q
from kvern.llm import spotsigs as ss
from tests.llm.conftest import SCHEMA, prose, sha, words_of

ANCHORS = set(ss.ANCHORS)


def signatures(text):
    text = text or ""
    w = words_of(text)
    content = [x for x in w if x not in ANCHORS]
    if not text:
        return set()
    if not w:
        return {("#", text)}
    if not content:
        return {("$", *w)}
    out = {("^", *content[: ss.CHAIN])}
    for i, x in enumerate(w):
        rest = [y for y in w[i + 1 :] if y not in ANCHORS]
        if x in ANCHORS and i + 1 < len(w) and w[i + 1] not in ANCHORS:
            out.add((x, *rest[: ss.CHAIN]))
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for k, (doc_id, text) in enumerate(ordered):
        text, following = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        a, b, c = signatures(text), signatures(edited), signatures(following)
        out.append((doc_id, len(text), sha(edited), round(jaccard(a, b), 9), round(jaccard(a, c), 9)))
    return out


def found(df):
    rows = ss.edited_pairs(df).select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256), F.round("near_edited", 9), F.round("near_next", 9)).collect()
    return sorted(map(tuple, rows), key=repr)


def test_tables(tables, monkeypatch):
    df = tables("documents")
    want = sorted(brute([(r["doc_id"], r["text"]) for r in df.collect()]), key=repr)
    assert found(df) == want
    monkeypatch.setattr(ss, "RANGE_BYTES", 20_000)  # many ranges
    assert found(df.repartition(5)) == want


def test_odd_rows(spark, none):
    rng = random.Random(8)
    texts = [None, "", "###", "the of and", "one", "The, the; one two three four", prose(rng, 20_000), "日本 the é x", prose(rng, 5)]
    rows = [(k * 10, t, None, None, None) for k, t in enumerate(texts)] + [(None, "null id the end is here", None, None, None), (33, "same the text was it", None, None, None), (33, "same the text was it", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as signatures", "3 as edited", "4 as __id", "5 as __range", "6 as __lent")
    assert found(df) == sorted(brute([r[:2] for r in rows]), key=repr)
    assert ss.edited_pairs(none).count() == 0 and ss.near_duplicates(none).count() == 0
    one = spark.createDataFrame(rows[8:9], SCHEMA)
    assert found(one)[0][-1] == 1.0


def test_fingerprints(spark):
    texts = ["the red car is here", "the red car is here", "a blue fish was there", "", None]
    df = ss.signatures(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "s").select("text", ss.fingerprint(F.col("s")).alias("f"))
    got = [r["f"] for r in df.collect()]
    assert got[0] == got[1] != got[2] and got[3] == got[4] == "0:"


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_pairs_agree_with_all_pairs(spark, threshold):
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        base = prose(rng, 80).split()
        for _ in range(5):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = prose(rng, 1)
            texts.append(" ".join(w))
    sets = [signatures(t) for t in texts]
    first = {frozenset(s): k for k, s in reversed(list(enumerate(sets)))}
    ids = sorted(first.values())
    want = {frozenset((i, j)) for i in ids for j in ids if i < j and jaccard(sets[i], sets[j]) >= threshold}
    got = ss.near_duplicates(spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], SCHEMA), threshold).collect()
    assert {frozenset((r["a"], r["b"])) for r in got} == want and len(got) == len(want)


def test_the_query_covers_texts_without_anchors(spark, tmp_path):
    def text(k):
        return " ".join(["same", "three", "words"] + [f"x{k}y{j}" for j in range(300)])

    rows = [(3, text(3)), (2, text(2)), (1, text(1)), (0, "same three words other end")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in q.op10_spotsigs_fingerprints(spark, str(tmp_path)).collect()}
    assert len({r["fingerprint"] for r in got.values()}) == 4
    assert all(r["near_next"] < 0.1 for r in got.values()) and all(0.3 < got[k]["near_edited"] < 0.7 for k in (3, 2))


def test_far_words_are_anchors(spark):
    def anchored(text, gap):
        w, since, c = words_of(text), None, [x for x in words_of(text) if x not in ANCHORS]
        out, at = signatures(text), 0
        for x in w:
            if x in ANCHORS:
                since = 0
                continue
            if at >= ss.CHAIN if since is None else since >= gap:
                out.add(tuple(c[at : at + ss.CHAIN + 1]))
            at, since = at + 1, None if since is None else since + 1
        return out

    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "of", *(f"w{j}" for j in range(50))]) for _ in range(n)) for n in (1, 4, 5, 9, 60, 200)] + [prose(rng, 300), "the", "a b c d e f g h i j k l m n the", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = {r["k"]: r["n"] for r in ss.signatures(df, "text", "s", ss.GAP).select("k", F.size("s").alias("n")).collect()}
    assert got == {k: len(anchored(t or "", ss.GAP)) for k, t in enumerate(texts)}


def test_ranges_divide_the_rows_of_one_id(spark, monkeypatch):
    """Ranges are even in bytes, whatever the ids; a row without an id is a row like any other."""
    rng = random.Random(12)
    rows = [(None if k % 6 else k, prose(rng, 20)) for k in range(600)]
    base = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.xxhash64("text"))
    monkeypatch.setattr(ss, "RANGE_BYTES", 4000)
    slim = base.select(F.coalesce("doc_id", F.lit(ss.LEAST)).alias("id"), "key", F.octet_length("text").cast("long").alias("bytes"))
    bounds = ss._bounds(slim)
    total = slim.agg(F.sum("bytes")).first()[0]
    sizes = [r["b"] for r in slim.groupBy(ss._bucket(F.col("id"), F.col("key"), bounds).alias("r")).agg(F.sum("bytes").alias("b")).collect()]
    assert len(sizes) == len(bounds) + 1 >= total / 4000 * 0.8 and max(sizes) < 4 * total / len(sizes)
    out = ss.with_next(base, ["key"], "doc_id", "key", F.octet_length("text")).collect()
    ordered = sorted(out, key=lambda r: (r["doc_id"] if r["doc_id"] is not None else ss.LEAST, r["key"]), reverse=True)
    assert [r["next_key"] for r in ordered] == [r["key"] for r in ordered[1:] + ordered[:1]]


def test_classes_have_all_members(spark):
    rows = [(5, "the red car is here"), (3, "The red car, is here!"), (None, "the red car is here"), (4, "a blue fish was there"), (9, ""), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in ss.classes(df).collect() if r["doc_id"] not in (8, 9)}
    assert got == {5: ss.LEAST, 3: ss.LEAST, None: ss.LEAST, 4: 4}
    assert {r["class_id"] for r in ss.classes(df).where("doc_id in (8, 9)").collect()} == {None}


def test_a_threshold_only_leaves_out_what_cannot_reach_it(tables):
    df = tables("documents")
    exact = {r["doc_id"]: r for r in ss.edited_pairs(df).collect()}
    for r in ss.edited_pairs(df, threshold=ss.NEAR).collect():
        for c in ("near_edited", "near_next"):
            assert r[c] == exact[r["doc_id"]][c] or r[c] == 0 and exact[r["doc_id"]][c] < ss.NEAR
