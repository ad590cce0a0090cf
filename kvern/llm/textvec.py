"""Words and word shingles of many texts at once, as numpy arrays.

A word is a maximal run of ASCII letters and digits and of bytes of non-ASCII characters; A-Z count as
a-z, all other characters separate words.  A text column is handled as the one byte buffer that Arrow
keeps it in: no Python object is made for a word.  Hashes are 64 bits wide and depend on the text alone,
so every executor and every run gives the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Texts are taken together until they have so many bytes; a longer text is taken alone.
CHUNK_BYTES = 1 << 18

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input reaches every bit of the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _lowered() -> np.ndarray:
    """The byte that a byte counts as, 0 where it separates words."""
    table = np.zeros(256, np.uint8)
    for lo, hi in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
        table[lo:hi] = np.arange(lo, hi)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


_LOWERED = _lowered()
_STEP = 0xD1342543DE82EF95
#: Bytes that a hash takes at once; keeps the first 0 to 8 of them.
EXACT = 8
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(EXACT + 1)], np.uint64)


@dataclass
class Words:
    """The words of some texts: `hashes` in order, text i has those from bounds[i] to bounds[i + 1];
    word j is in the bytes from starts[j] on of `data`."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    data: np.ndarray

    def row(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts and each text's bounds in them; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and past-the-last text of each chunk, with its bytes and bounds."""
    data, bounds = buffers(texts)
    n, first = len(bounds) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + CHUNK_BYTES, "right")) - 1)
        own = bounds[first : last + 1]
        yield first, last, data[own[0] : own[-1]], own - own[0]
        first = last


def run_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each run, eight at a time: those so far are mixed before the next ones join them.

    Two runs of up to EXACT bytes never share a hash, unless they end in zero bytes.
    """
    eight = np.ndarray((len(data) + 1,), np.uint64, np.concatenate([data, np.zeros(EXACT, np.uint8)]), 0, (1,))
    with np.errstate(over="ignore"):
        out = np.full(len(starts), _MULTIPLIER)
        at, done = slice(None), 0
        while len(starts):
            out[at] = mix(out[at] ^ (eight[starts] & _FIRST[np.minimum(sizes - done, EXACT)]))
            done += EXACT
            more = np.flatnonzero(sizes > done)
            at = more if done == EXACT else at[more]
            starts, sizes = starts[more] + EXACT, sizes[more]
        return out


def words(data: np.ndarray, bounds: np.ndarray) -> Words:
    """The words of the texts of one chunk."""
    lowered = _LOWERED[data]
    inside = lowered != 0
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    firsts = bounds[:-1][bounds[:-1] < bounds[1:]]
    fresh[firsts] = inside[firsts]
    starts = np.flatnonzero(fresh)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | fresh[1:]
    return Words(run_hashes(lowered, starts, np.flatnonzero(last) + 1 - starts), np.searchsorted(starts, bounds), starts, data)


def grams(w: Words, n: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of n words; with skip > 0 (n = 2), of each pair with so many words between."""
    reach = n if not skip else skip + 2
    total = len(w.hashes) - reach + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = w.row()
    whole = row[:total] == row[reach - 1 :]
    parts = range(n) if not skip else (0, skip + 1)
    out = np.full(total, np.uint64(n * 16 + skip))
    with np.errstate(over="ignore"):
        for j, at in enumerate(parts):
            out += w.hashes[at : at + total] * np.uint64(_STEP * (2 * j + 1) + 2 * j & (1 << 64) - 1 | 1)
    return mix(out[whole]), row[:total][whole]


def shingles(w: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each shingle of n words.  A text of fewer words, but not none, has one: all its words."""
    hashes, row = grams(w, n)
    counts = np.diff(w.bounds)
    for short in range(1, n):
        at = np.flatnonzero(counts == short)
        if len(at):
            out = np.full(len(at), np.uint64(short * 16))
            with np.errstate(over="ignore"):
                for j in range(short):
                    out += w.hashes[w.bounds[at] + j] * np.uint64(_STEP * (2 * j + 1) + 2 * j & (1 << 64) - 1 | 1)
            hashes, row = np.concatenate([hashes, mix(out)]), np.concatenate([row, at])
    return hashes, row


def distinct(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes without repeats, sorted within the text, texts in order."""
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[keep], row[keep]
