import random

from kvern.llm import decontaminate as dc
from tests.llm.conftest import SCHEMA, prose, words_of


def brute(docs, items):
    windows = []
    for item, text in items:
        w = words_of(text)
        windows += [(tuple(w[i : i + 10]), item) for i in range(max(1, len(w) - 9))] if w else []
    out = []
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for v, item in windows:
            for i in range(len(w) - len(v) + 1):
                if tuple(w[i : i + len(v)]) == v:
                    hit |= set(range(i, i + len(v)))
                    found |= {str(item)} - {"None"}
        out.append((doc_id is not None, doc_id or 0, len(w), len(hit), tuple(sorted(found)), bool(hit)))
    return sorted(out)


def found(docs, items):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in dc.contamination(docs, items).collect())


ITEMS = "item_id long, text string"


def test_agrees_with_all_windows(spark, monkeypatch):
    rng = random.Random(5)
    items = [(k, prose(rng, n)) for k, n in enumerate((10, 11, 25, 40, 3, 1, 5, 9))] + [(8, None), (9, ""), (10, "..."), (None, prose(rng, 12)), (11, "ÉCOLE été Ünï 42 x"), (12, "ÉCOLE été Ünï 42 x"), (13, "of the of the of the of the of the of the")]
    docs = []
    for k in range(60):
        text = prose(rng, rng.randint(0, 60))
        _, item = rng.choice(items)
        cut = (item or "").split()
        a = rng.randint(0, max(0, len(cut) - 1))
        part = " ".join(cut[a : a + rng.randint(5, 30)])
        docs.append((k, f"{text} {part.upper() if k % 3 else part.replace(' ', ', ')} {prose(rng, 5)}", None, None, None))
    docs += [(100, "of the " * 30, None, None, None), (101, "École été Ünï 42 x", None, None, None), (102, "ÉCOLE été Ünï 42 X!", None, None, None), (None, items[0][1], None, None, None), (103, items[0][1], None, None, None), (103, items[0][1], None, None, None)]
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS)
    want = brute([d[:2] for d in docs], items)
    assert found(df, bench) == want
    assert sorted(str(r["doc_id"]) for r in dc.clean(df, bench).collect()) == sorted(str(d[1]) for d in want if not d[-1])
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    assert found(df, bench) == want
    monkeypatch.setattr(dc, "BROADCAST_SHINGLES", 0)
    monkeypatch.setattr(dc, "BROADCAST_DOCUMENTS", 0)
    assert found(df, bench) == want


def join_inputs(node):
    """The columns of both sides of each join of a plan: what an exchange below it sends."""
    children = [node.children().apply(k) for k in range(node.children().size())]
    for child in children:
        if "SortMergeJoin" in node.nodeName() or "ShuffledHashJoin" in node.nodeName():
            yield child.output().mkString(",")
        yield from join_inputs(child)


def test_no_words_are_shuffled_to_find_shingles(spark, monkeypatch):
    """Without a broadcast, keys, places and hashes go through the exchange, never a document's words."""
    made, write = [], dc.written
    monkeypatch.setattr(dc, "written", lambda df: (made.append(df), write(df))[1])
    monkeypatch.setattr(dc, "BROADCAST_SHINGLES", 0)
    rng = random.Random(6)
    docs = dc.keyed(spark.createDataFrame([(k, prose(rng, 50), None, None, None) for k in range(20)], SCHEMA))
    dc._scanned(docs, spark.createDataFrame([(1,), (2,)], "h long"), [5]).count()
    exchanged = list(join_inputs(made[-1]._jdf.queryExecution().sparkPlan()))
    assert len(exchanged) == 2 and not any("words#" in x.replace("n_words#", "") for x in exchanged)
    assert any("pos#" in x for x in exchanged)


def test_odd_rows(spark, odd, odd_rows, none):
    items = [(1, odd_rows[8][1]), (2, "ÀÉ ñandú"), (2, "one")]
    bench = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 as size", "2 as words", "3 as at", "4 as window")
    assert found(odd, bench) == brute([r[:2] for r in odd_rows], items)
    kept = dc.clean(odd, bench)
    assert kept.columns == odd.columns
    assert dc.clean(odd, bench.limit(0)).count() == len(odd_rows)
    assert found(none, bench) == [] and not any(r[-1] for r in found(odd, bench.limit(0)))
