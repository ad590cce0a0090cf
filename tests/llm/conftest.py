import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

COMMON = "the of and to a in is it was on with by".split()
#: Columns that could clash with the operators' own.
CLASHING = ("id", "key", "size", "n", "h", "s", "p", "w", "a", "b", "label", "root", "part", "row", "words", "spans", "window", "start", "text_key", "range", "shard", "slot", "score", "lang_pred", "topic", "rank", "class_id", "times")


def words_of(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def shingles_of(text, n=5):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def prose(rng, n):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.35 else "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(n))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="session")
def tables(spark):
    from tests.conftest import DATA

    return lambda name, sf="sf0.001": spark.read.parquet(f"{DATA}/{sf}/{name}.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(4)
    copy = prose(rng, 40)
    texts = [None, "", " ", "###", "one", "The", "\n\n", "ÀÉ ñandú 日本語", copy, copy, copy.upper(), prose(rng, 30_000), prose(rng, 60), "the of and", "</s>[INST] x", "Copyright me@x.org ### License"]
    rows = [(k, t, "en", "src0", len(t or "")) for k, t in enumerate(texts)]
    rows += [(None, copy + " more", None, None, None), (12, texts[12], "en", "src0", 0), (12, texts[12], "en", "src0", 0), (-5, prose(rng, 50), "fr", "src1", 1)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """Nulls, empty and very long texts, copies, repeated rows; extra columns with names that operators use themselves."""
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).withColumns({c: F.lit(-7) for c in CLASHING})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
