"""Token ids in a byte-aligned file format: frequency ranks in 1 to 4 bytes, their lengths in control bytes apart.

Documents are encoded with a given tokenizer, an end id is added, and all ids are counted.  An id is stored as
its rank by frequency, so that the commonest 256 take one byte.  A block has the ids of some consecutive
documents as two streams: data bytes, and control bytes of four 2-bit lengths each.  Blocks are rows of
a Parquet table in ascending order of document ids; Spark's writer commits them, whole or not at all.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvern.llm import textvec
from kvern.llm.util import in_arrow, mapped, partitions, written

END = 0
LEAST = -(1 << 63)
#: Ids of a block, about (a longer document is a block of its own).
BLOCK_IDS = 1 << 18
#: Pieces of text whose ids a worker remembers, about (50 bytes each); then it starts anew.
REMEMBERED = 1_500_000

_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
_PLACE = np.arange(4)
#: What a byte of a text is: part of a letter run, of a digit run, of a run of other signs, a blank, other white space, or such that the text goes to the library.
_LETTER, _DIGIT, _SIGN, _BLANK, _SPACE, _OTHER = 1, 2, 3, 4, 5, 6
#: Stands between pieces that go to the library together; no text that has it is taken apart.
_BETWEEN = "\ue000"


def _kinds() -> np.ndarray:
    """Kinds of bytes; of non-ASCII characters only the Latin letters of two bytes from C3 on are told apart (but for the signs C3 97, C3 B7)."""
    kind = np.full(256, _OTHER, np.uint8)
    for b in range(128):
        c = chr(b)
        kind[b] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _BLANK if c == " " else _SPACE if c in "\t\n\v\f\r" else _SIGN if c.isprintable() and c != "'" else _OTHER
    kind[0xC3] = _LETTER
    kind[0x80:0xC0] = _LETTER  # after C3; see _taken_apart
    return kind


_KIND = _kinds()


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks (below 2 ** 32)."""
    v = ranks.astype("<u4")
    size = (1 + (v > 0xFF) + (v > 0xFFFF) + (v > 0xFFFFFF)).astype(np.uint8)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    four = codes.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    width = int(size.max()) if len(v) else 1
    data = v.view(np.uint8).reshape(-1, 4)[:, :width][_PLACE[:width] < size[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of two streams; the lengths come from a table of all control bytes."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    width = int(size.max()) if n else 1
    out = np.zeros((n, 4), np.uint8)
    low = np.zeros((n, width), np.uint8)
    low[_PLACE[:width] < size[:, None]] = np.frombuffer(data, np.uint8)
    out[:, :width] = low
    return out.reshape(-1).view("<u4")


def _apart(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each text of a chunk is the sum of its runs of letters, digits, signs and single white space.

    Not so with characters whose kind isn't known here, with an apostrophe, or with two white-space characters in a row.
    """
    kind = _KIND[data]
    after_c3 = np.zeros(len(data), bool)
    after_c3[1:] = data[:-1] == 0xC3
    high = (data >= 0x80) & (data < 0xC0)
    odd = (kind == _OTHER) | (high & ~after_c3) | (after_c3 & ((data == 0x97) | (data == 0xB7)))
    white = (kind == _BLANK) | (kind == _SPACE)
    odd[1:] |= white[1:] & white[:-1]
    seen = np.concatenate([[0], np.cumsum(odd)])
    return seen[bounds[1:]] == seen[bounds[:-1]]


def _pieces(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces start in texts that can be taken apart: a run with the blank before it is one piece."""
    kind = _KIND[data]
    fresh = np.ones(len(data), bool)
    fresh[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _SPACE)
    fresh[1:] &= ~((kind[:-1] == _BLANK) & (kind[1:] != _SPACE))
    fresh[bounds[:-1][bounds[:-1] < len(data)]] = True
    return np.flatnonzero(fresh)


class _Growing:
    """An array that is added to; its first n values are used."""

    def __init__(self, dtype: np.dtype | type) -> None:
        self.values, self.n = np.zeros(1024, dtype), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.values):
            self.values = np.concatenate([self.values[: self.n], np.zeros(self.n + 2 * len(more), self.values.dtype)])
        self.values[self.n : self.n + len(more)] = more
        self.n += len(more)


class Encoder:
    """A tokenizer of the tokenizers library, with a memory of pieces where it is a plain byte-level BPE.

    Such a tokenizer cuts a text into runs of letters, of digits and of signs, each with one blank before it, and
    encodes them one by one.  Most texts are cut here, all pieces of a chunk at once, and the library gets each
    piece that isn't remembered.  Pieces are found by a 64-bit hash, which tells those of up to eight bytes apart;
    of longer ones the bytes are compared too.  A text whose cuts aren't plain, or with one of the
    tokenizer's added tokens, goes to the library whole, as does every text for other tokenizers.
    """

    def __init__(self, path: str, end: int = END) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre, model = told.get("pre_tokenizer") or {}, told["model"]
        self.by_piece = told.get("normalizer") is None and told.get("post_processor") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        self.added = [t["content"] for t in told.get("added_tokens", [])]
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.end = end
        self.single = Tokenizer.from_file(path)
        self.single.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(_BETWEEN, "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.forget()

    def forget(self) -> None:
        # Hashes (sorted) and places of what is remembered: most of it, and what is new since it was last merged.
        self.known = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2
        self.pool, self.start, self.size = _Growing(self.dtype), _Growing(np.int64), _Growing(np.int64)
        # Bytes of long pieces; where each piece's are and how many (short ones: none).
        self.raw, self.at, self.long = _Growing(np.uint8), _Growing(np.int64), _Growing(np.int64)

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        """Where the ids of pieces are; -1 for pieces that aren't remembered."""
        out = np.full(len(hashes), -1, np.int64)
        for known, place in self.known:
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                out = np.where(known[at] == hashes, place[at], out)
        return out

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Remembers the ids of new pieces; hashes are sorted."""
        ids, size = [], []
        for at in range(0, len(pieces), 1000):
            some = [p.decode() for p in pieces[at : at + 1000]]
            got = self.single.encode(_BETWEEN.join(some), add_special_tokens=False)
            ids.append(np.array(got.ids, self.dtype))
            size.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(some)))
        fresh = np.concatenate(size)
        place = self.size.n + np.arange(len(fresh))
        self.start.add(self.pool.n + np.cumsum(fresh) - fresh)
        self.size.add(fresh)
        self.pool.add(np.concatenate(ids))
        long = np.array([len(p) if len(p) > textvec.EXACT else 0 for p in pieces])
        self.at.add(self.raw.n + np.cumsum(long) - long)
        self.long.add(long)
        self.raw.add(np.frombuffer(b"".join(p for p in pieces if len(p) > textvec.EXACT), np.uint8))
        old, new = self.known[0], self._merged(self.known[1], (hashes, place))
        if len(new[0]) > max(1 << 15, len(old[0]) // 8):
            old, new = self._merged(old, new), self._merged()
        self.known = [old, new]

    @staticmethod
    def _merged(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        hashes, place = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(hashes, kind="stable")
        return hashes[order], place[order]

    def _same(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> bool:
        """Whether the long pieces are those that are remembered at their places, and all others short."""
        sizes = np.where(sizes > textvec.EXACT, sizes, 0)
        if not np.array_equal(sizes, self.long.values[place]):
            return False
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.array_equal(data[np.repeat(starts, sizes) + inside], self.raw.values[np.repeat(self.at.values[place], sizes) + inside])

    def _by_piece(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of texts that can be taken apart, and how many each has; None if different pieces share a hash."""
        starts = _pieces(data, bounds)
        ends = np.append(starts[1:], len(data))
        hashes = textvec.run_hashes(data, starts, ends - starts)
        once, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        at = self._places(once)
        fresh = at < 0
        if fresh.any():
            raw = data.tobytes()
            before = self.size.n
            self._learn(once[fresh], [raw[starts[i] : ends[i]] for i in first[fresh]])
            at[fresh] = before + np.arange(int(fresh.sum()))
        place = at[where]
        if not self._same(data, starts, ends - starts, place):
            return None
        size = self.size.values[place]
        to = np.cumsum(size)
        ids = self.pool.values[np.arange(to[-1]) + np.repeat(self.start.values[place] - to + size, size)]
        return ids, np.diff(np.concatenate([[0], to])[np.searchsorted(starts, bounds)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts with an end id after each, and how many each has."""
        if self.size.n > REMEMBERED:
            self.forget()
        every: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for first, last, data, bounds in textvec.chunks(texts):
            apart = _apart(data, bounds) if self.by_piece else np.zeros(last - first, bool)
            if self.added and any(a.encode() in (raw := data.tobytes()) for a in self.added):
                apart &= np.array([not any(a.encode() in raw[lo:hi] for a in self.added) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)])
            n = np.zeros(last - first, np.int64)
            own = [np.zeros(0, self.dtype)] * 2
            if apart.any() and len(data):
                keep = np.repeat(apart, np.diff(bounds))
                some = np.concatenate([[0], np.cumsum(np.diff(bounds)[apart])])
                if some[-1] and (got := self._by_piece(data[keep], some)):
                    own[0], n[apart] = got
                elif some[-1]:
                    apart[:] = False
            whole = [self.library.encode(texts[first + int(i)].as_py() or "", add_special_tokens=False).ids for i in np.flatnonzero(~apart)]
            if whole:
                own[1], n[~apart] = np.array([i for ids in whole for i in ids], self.dtype), [len(ids) for ids in whole]
            to = np.cumsum(n + 1) - n - 1
            out = np.full(int((n + 1).sum()), self.end, self.dtype)
            for kind, ids in ((apart, own[0]), (~apart, own[1])):
                size = n[kind]
                out[np.arange(len(ids)) + np.repeat(to[kind] - np.cumsum(size) + size, size)] = ids
            every.append(out)
            counts.append(n + 1)
        if not every:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        return np.concatenate(every), np.concatenate(counts)


_encoders: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, end: int) -> Encoder:
    """The worker's own encoder: it is kept from task to task, and its memory with it."""
    if (path, end) not in _encoders:
        _encoders[path, end] = Encoder(path, end)
    return _encoders[path, end]


def encoded(docs: DataFrame, tokenizer: str, end: int = END, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): each document's ids with the end id, little-endian, 2 bytes each (4 for vocabularies over 65536)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, end)
        for batch in batches:
            text = batch.column("text")
            for at in range(0, batch.num_rows, 256):
                ids, n = encoder.encode(text.slice(at, 256))
                raw, width = ids.tobytes(), ids.itemsize
                to = np.cumsum(n) * width
                yield pa.record_batch([batch.column("doc_id").slice(at, 256), pa.array(n), pa.array([raw[b - k * width : b] for b, k in zip(to, n, strict=True)], pa.binary())], ["doc_id", "n_tokens", "ids"])

    read = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(LEAST)).alias("doc_id"), F.col(text_column).alias("text"))
    return mapped(read, run, "doc_id long, n_tokens long, ids binary")


def ranks_of(ids: DataFrame, vocabulary: int, dtype: str) -> np.ndarray:
    """Ids in the order of their frequency over all rows (ties: the lower id first); one row for each id of the vocabulary reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                raw = b"".join(batch.column("ids").slice(at, 256).to_pylist())
                times += np.bincount(np.frombuffer(raw, dtype), minlength=vocabulary)
        seen = np.flatnonzero(times)
        yield pa.record_batch([pa.array(seen), pa.array(times[seen])], ["id", "times"])

    got = mapped(ids.select("ids"), count, "id long, times long").groupBy("id").agg(F.sum("times").alias("times")).toPandas()
    times = np.zeros(vocabulary, np.int64)
    times[got["id"].to_numpy(np.int64)] = got["times"].to_numpy(np.int64)
    return np.lexsort((np.arange(vocabulary), -times)).astype(np.uint32)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int = END, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Writes the ids of all documents: `path`/blocks and `path`/ranks.

    Documents are in ascending order of ids (null first, those with one id by a hash of their ids).  A null text is
    empty and has the end id alone.  Rows that are alike in all of that are dealt to several ranges too.
    """
    spark = docs.sparkSession
    probe = Encoder(tokenizer, end)
    dtype = probe.dtype.str
    ids = written(encoded(docs, tokenizer, end, id_column, text_column), compression="zstd")
    order = ranks_of(ids, probe.vocabulary, dtype)
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            ids = np.concatenate([np.frombuffer(x, dtype) for _, _, x in held])
            control, data = encode_ranks(shared.value[ids])
            names = np.array([i for i, _, _ in held], "<i8").tobytes()
            lengths = np.array([n for _, n, _ in held], "<i8").tobytes()
            return pa.record_batch([pa.array([x], t) for x, t in ((part, pa.int32()), (block, pa.int32()), (len(held), pa.int64()), (len(ids), pa.int64()), (names, pa.binary()), (lengths, pa.binary()), (control, pa.binary()), (data, pa.binary()))], ["part", "block", "n_docs", "n_tokens", "doc_ids", "lengths", "control", "data"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids")), strict=True):
                if held and size + row[1] > BLOCK_IDS:
                    yield out()
                    block, held, size = block + 1, [], 0
                held.append(row)
                size += row[1]
        if held:
            yield out()

    # ids is written: its rows have the same place each time that they are read.
    keyed = ids.withColumns({"key": F.xxhash64("ids"), "row": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(partitions(spark), "doc_id", "key", "row").sortWithinPartitions("doc_id", "key", "row").select("doc_id", "n_tokens", "ids")
    mapped(dealt, blocks, "part int, block int, n_docs long, n_tokens long, doc_ids binary, lengths binary, control binary, data binary").write.parquet(f"{path}/blocks")
    spark.createDataFrame([(int(k), int(i)) for k, i in enumerate(order)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, place, doc_id, start, n_tokens, ids): the documents that the files hold; start counts from the block's first id; ids are 4 bytes each, little-endian."""
    return _read(spark, path, "ids binary", lambda raw: (raw, pa.binary()))


def index_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the files; start counts all ids before the document's."""
    read = _read(spark, path, "ids_crc32 long", lambda raw: (zlib.crc32(raw), pa.int64()))
    blocks = spark.read.parquet(f"{path}/blocks").select("part", "block", "n_tokens")
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # A row for each part: as many as the writing job had tasks.
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    placed = blocks.select("part", "block", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("inside")).join(before, "part")
    found = read.join(placed.select("part", "block", (F.col("before") + F.col("inside")).alias("first")), ["part", "block"])
    return found.select(F.when(F.col("doc_id") != LEAST, F.col("doc_id")).alias("doc_id"), (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def _read(spark: SparkSession, path: str, column: str, of) -> DataFrame:
    order = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()["id"].to_numpy(np.uint32)
    shared = spark.sparkContext.broadcast(order)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(batch.num_rows):
            part, block, n, names, lengths, control, data = (batch.column(c)[k].as_py() for c in ("part", "block", "n_tokens", "doc_ids", "lengths", "control", "data"))
            ids = shared.value[decode_ranks(control, data, n)].astype("<u4").tobytes()
            size = np.frombuffer(lengths, "<i8")
            to = np.cumsum(size)
            got = [of(ids[4 * (b - s) : 4 * b]) for b, s in zip(to.tolist(), size.tolist(), strict=True)]
            m = len(size)
            yield pa.record_batch([pa.array([part] * m, pa.int32()), pa.array([block] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array(np.frombuffer(names, "<i8")), pa.array(to - size), pa.array(size), pa.array([x for x, _ in got], got[0][1])], ["part", "block", "place", "doc_id", "start", "n_tokens", column.split()[0]])

    return in_arrow(spark.read.parquet(f"{path}/blocks"), run, f"part int, block int, place int, doc_id long, start long, n_tokens long, {column}")
