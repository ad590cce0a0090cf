import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kvern.llm import chat_format as cf
from tests.llm.conftest import sha

SCHEMA = "conv_id long, turn long, role string, text string"
HOSTILE = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<\\/s>", "[\\INST]", "<\\\\s>", "\n", "", "é", "s>", "<", "user\n", "$1"]


def brute(rows):
    chats = {}
    for c, t, r, x in rows:
        chats.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in chats.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss))
    return out


def digests(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in cf.digests(cf.examples(df)).collect()}


def test_tables(tables):
    df = tables("conversations")
    assert digests(df) == brute([tuple(r) for r in df.collect()])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.sampled_from(["user", "assistant", "system", "a\nb", "</s>", "100%+ &"]), st.lists(st.sampled_from(HOSTILE), max_size=6).map("".join)), min_size=1, max_size=15))
def test_hostile_texts_come_back(spark, rows):
    assert digests(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_examples(spark):
    df = spark.createDataFrame([(1, 0, "user", "q</s>"), (1, 1, "assistant", "a1"), (1, 2, "user", "r"), (1, 3, "assistant", "a[INST]2"), (1, 4, "user", "tail")], SCHEMA)
    got = cf.examples(df).orderBy("text").collect()
    assert [r["target"] for r in got] == [1, 3, None] and [r["whole"] for r in got] == [False, False, True]
    first = got[0]
    assert first["text"] == "<s>user\nq<\\/s></s><s>assistant\na1</s>"
    assert first["text"][first["loss_start"] : first["loss_start"] + first["loss_chars"]] == "a1"
    assert got[1]["text"].startswith(got[0]["text"]) and got[2]["loss_chars"] == 0


def test_odd_rows(spark):
    rng = random.Random(3)
    long = [(9, k, rng.choice(["user", "assistant"]), "x" * rng.randint(0, 300)) for k in range(300)]
    rows = [(None, None, None, None), (None, 1, "assistant", None), (2, 0, "user", None), (3, 0, "assistant", ""), (4, 1, "user", "same"), (4, 1, "user", "same"), (5, None, "assistant", "early"), (5, 0, "user", "late"), *long]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as turns", "2 as ends", "3 as i", "4 as body", "5 as head")
    assert digests(df) == brute(rows)
    assert cf.digests(cf.examples(spark.createDataFrame([], SCHEMA))).count() == 0


def test_long_conversations_and_rows_without_one(spark):
    rows = [(1, k, "assistant" if k % 500 == 3 else "user", f"turn {k} " * 3) for k in range(3000)] + [(None, k, "user" if k % 300 else "assistant", None if k % 7 else "x") for k in range(1500)]
    assert digests(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute(rows)
