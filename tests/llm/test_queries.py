import pytest

from kvern.llm import queries as q
from tests.conftest import DATA

SQL = q.oracle_sql()
CONTRACT = {
    "op2": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op3": "doc_id class_id n_links",
    "op4": "doc_id size text_crc32 law shard slot grown_shard",
    "op5": "doc_id start n_tokens ids_crc32",
    "op6": "doc_id held_out score predicted",
    "op7": "doc_id held_out lang_pred score",
    "op8": "doc_id score",
    "op9": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op10": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_sql(name, agree):
    agree(q.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(SQL)))
def test_query_has_its_columns(name, spark):
    df = q.queries()[name](spark, f"{DATA}/sf0.001")
    assert set(CONTRACT[name.split("_")[0]].split()) <= set(df.columns)
    assert df.count() == spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").count()


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in q.queries()) == list(range(1, 11))
