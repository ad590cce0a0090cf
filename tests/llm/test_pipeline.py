import corpus_pipeline as cp
from kvern.llm import toxicity
from kvern.llm.util import written
from tests.conftest import DATA
from tests.llm import test_decontaminate, test_ngram_join, test_sharding

SF = f"{DATA}/sf0.001"


def test_stages(spark, tables):
    docs = tables("documents")
    stages = dict(cp.STAGES)
    assert list(stages) == ["toxicity", "ngram_join", "decontamination", "mixing", "sharding"]
    clean = written(stages["toxicity"](spark, docs, SF))
    model = toxicity.train(docs, tables("labels"))
    gone = {r["doc_id"] for r in toxicity.score_documents(docs, model).where("score >= 0.5").collect()}
    assert {r["doc_id"] for r in docs.collect()} - gone == {r["doc_id"] for r in clean.collect()}
    single = written(stages["ngram_join"](spark, clean, SF))
    classes = test_ngram_join.brute([tuple(r) for r in clean.collect()])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({c for _, c, _ in classes})
    apart = written(stages["decontamination"](spark, single, SF))
    told = test_decontaminate.brute([(r["doc_id"], r["text"]) for r in single.collect()], [tuple(r) for r in tables("benchmark").select("item_id", "text").collect()])
    assert sorted(r["doc_id"] for r in apart.collect()) == sorted(t[1] for t in told if not t[-1])
    mixed = written(stages["mixing"](spark, apart, SF))
    assert 0 < mixed.count() < apart.count() and mixed.columns == docs.columns
    sharded = stages["sharding"](spark, mixed, SF)
    assert sharded.columns == [*docs.columns, "shard", "slot"]
    test_sharding.check([tuple(r) for r in mixed.collect()], [tuple(r) for r in sharded.collect()], cp.SHARDS)
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(map(tuple, sharded.collect()))


def test_odd_and_empty_tables(spark, odd, none, tmp_path):
    for k, docs in enumerate((odd, none)):
        sf = f"{tmp_path}/{k}"
        docs.write.parquet(f"{sf}/documents.parquet")
        for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
            spark.createDataFrame([], schema).write.parquet(f"{sf}/{name}.parquet")
        out = cp.run(spark, sf)
        assert set(out.columns) == {*docs.columns, "shard", "slot"}
        assert (out.count() > 0) == (k == 0)
