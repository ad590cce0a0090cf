import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kvern.llm import token_ids as ti
from kvern.llm.util import fresh_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a", " a", "a ", "a  b", "a   b", "a\n b", "a \nb", "x<|endoftext|>y z", "it's don't we'll", "naïve café — ok", "日本 語", "a\tb", "tab\t\tx", "É×÷é ñ", "12ab34 !!! ##a", "\n", " \xa0x y", "ª º µ", "a\x0bb\x0cc\rd", "x" * 5000, " " * 50, None, "foobar", "5€ ½ ²", "a.\nB, c;d", "'s", "\x00\x01 \x7f", "Ωmega Привет", "ﬁ ǅ"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_agrees_with_the_library(name, tables):
    path = public_tokenizers.path(name)
    encoder, library = ti.Encoder(path), Tokenizer.from_file(path)
    texts = ODD + [r["text"] for r in tables("documents").limit(60).collect()]
    for _ in range(2):  # the second time from memory
        ids, n = encoder.encode(pa.array(texts))
        at = 0
        for text, k in zip(texts, n, strict=True):
            assert ids[at : at + k].tolist() == [*library.encode(text or "", add_special_tokens=False).ids, ti.END]
            at += k
    assert encoder.by_piece == (name == "byte_bpe_50k.json")


def test_ranks_round_trip():
    rng = np.random.default_rng(0)
    for top in (1, 200, 300, 70_000, 1 << 32):
        for n in (0, 1, 4, 5, 1000):
            ranks = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            control, data = ti.encode_ranks(ranks)
            assert len(control) == -(-n // 4) and np.array_equal(ti.decode_ranks(control, data, n), ranks)
    assert len(ti.encode_ranks(np.zeros(100, np.uint32))[1]) == 100


def brute(rows):
    library, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def indexed(spark, df):
    path = fresh_path(spark)
    ti.write_ids(df, path, PATH)
    return sorted((tuple(r) for r in ti.index_ids(spark, path).collect()), key=lambda r: r[1]), path


def test_tables(spark, tables, monkeypatch):
    df = tables("documents")
    monkeypatch.setattr(ti, "BLOCK_IDS", 3000)
    got, path = indexed(spark, df)
    assert got == brute([(r["doc_id"], r["text"]) for r in df.collect()])
    ids = ti.read_ids(spark, path).where("doc_id = 3").first()
    assert ids["n_tokens"] * 4 == len(ids["ids"])
    order = spark.read.parquet(f"{path}/ranks").orderBy("rank").limit(2).collect()
    assert order[0]["id"] != order[1]["id"]


def test_odd_rows(spark, odd, odd_rows, none):
    got, _ = indexed(spark, odd)
    want = brute([r[:2] for r in odd_rows])
    assert sorted(r[0::2] for r in got if r[0] is not None) == sorted(r[0::2] for r in want if r[0] is not None)
    assert [r[0] for r in got] == [r[0] for r in want] and [r[1:] for r in got] == [r[1:] for r in want]
    assert indexed(spark, none)[0] == []


def test_pieces_that_share_a_hash(monkeypatch):
    """Long pieces under one hash, in one text and in texts one after the other, still get their own ids."""
    of = ti.textvec.run_hashes
    monkeypatch.setattr(ti.textvec, "run_hashes", lambda data, starts, sizes: np.where(sizes > 8, np.uint64(7), of(data, starts, sizes)))
    encoder, library = ti.Encoder(PATH), Tokenizer.from_file(PATH)
    for text in ("a considerable text", "a remarkable text", "considerable remarkable", "a considerable text", "unremarkable"):
        ids, _ = encoder.encode(pa.array([text]))
        assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, ti.END]


def test_arrangements_of_the_same_letters():
    from tests.llm.test_textvec import thue_morse

    encoder, library = ti.Encoder(PATH), Tokenizer.from_file(PATH)
    for text in thue_morse(10) + thue_morse(12):
        assert encoder.encode(pa.array([text]))[0].tolist() == [*library.encode(text, add_special_tokens=False).ids, ti.END]


def test_many_rows_without_an_id_are_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(ti, "BLOCK_IDS", 50)
    df = spark.createDataFrame([(None if k % 2 else k, "same text") for k in range(400)], "doc_id long, text string").repartition(5)
    got, path = indexed(spark, df)
    assert got == brute([(None if k % 2 else k, "same text") for k in range(400)])
    sizes = [r["n"] for r in spark.read.parquet(f"{path}/blocks").groupBy("part").agg({"n_docs": "sum"}).withColumnRenamed("sum(n_docs)", "n").collect()]
    assert len(sizes) == 4 and max(sizes) < 200
