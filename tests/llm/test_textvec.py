import itertools
import random

import numpy as np
import pyarrow as pa

from kvern.llm import textvec as tv
from tests.llm.conftest import prose, shingles_of, words_of

TEXTS = [None, "", "a", "Ab-aB ab", "É é 日本 x1", "...", "one two three four five six one two three four five", prose(random.Random(1), 300), "é" * 10, "x" * 70]


def of(texts):
    return [tv.words(data, bounds) for _, _, data, bounds in tv.chunks(pa.array(texts))]


def test_words_agree_with_the_pattern():
    (w,) = of(TEXTS)
    assert list(np.diff(w.bounds)) == [len(words_of(t)) for t in TEXTS]
    flat = [x for t in TEXTS for x in words_of(t)]
    assert len(set(zip(flat, w.hashes.tolist(), strict=True))) == len(set(flat)) == len(set(w.hashes.tolist()))


def test_shingle_sets_agree(monkeypatch):
    def sizes():
        out = []
        for first, last, data, bounds in tv.chunks(pa.array(TEXTS)):
            _, row = tv.distinct(*tv.shingles(tv.words(data, bounds)))
            out += list(np.bincount(row, minlength=last - first))
        return out

    want = [len(shingles_of(t)) for t in TEXTS]
    assert sizes() == want
    monkeypatch.setattr(tv, "CHUNK_BYTES", 50)
    assert sizes() == want


def test_chunks_do_not_change_hashes(monkeypatch):
    whole = np.concatenate([w.hashes for w in of(TEXTS)])
    monkeypatch.setattr(tv, "CHUNK_BYTES", 8)
    assert np.array_equal(np.concatenate([w.hashes for w in of(TEXTS)]), whole)
    assert of([]) == []


def test_skip_grams():
    (w,) = of(["a b c d", "a x c"])
    two, row = tv.grams(w, 2, 1)
    assert list(row) == [0, 0, 1] and two[0] == two[2] != two[1]


def thue_morse(n, a="a", b="b"):
    """Two different words of 2**n letters that sums of powers can't tell apart modulo 2**64."""
    bits = [bin(k).count("1") % 2 for k in range(1 << n)]
    return "".join(a if x else b for x in bits), "".join(b if x else a for x in bits)


def test_arrangements_of_the_same_letters_differ():
    texts = [w for n in (6, 10, 11, 12) for w in thue_morse(n)]
    assert len({h for w in of(texts) for h in w.hashes.tolist()}) == len(texts)
    short = ["".join(p) for p in itertools.product("ab0", repeat=9)]
    assert len({h for w in of(short) for h in w.hashes.tolist()}) == len(short)
