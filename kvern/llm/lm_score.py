"""Document scores by cross-entropy difference of two n-gram language models.

A target model is counted on documents that are wanted, a background model on all documents.  The two
match: one vocabulary (every word of the corpus and the end of a text), the same order and smoothing and, by
scaling the background's counts by s, the same number of tokens.  With c the counts of a model, N its tokens
(ends included) and V the size of the vocabulary,

    plain(w)    = (c(w) + ADDED) / (N + ADDED V)
    chance(w|h) = (c(h, w) + PRIOR plain(w)) / (c(h) + PRIOR)

and a text's loss is the mean of -ln chance over its words and its end, a start being the first word's history.  A
document's score is its target loss less its background loss: the lower, the more it is like the target.

Every word and bigram of every document counts, however many there are: no executor holds a model.  As

    -ln chance(w|h) = ln(c(h) + PRIOR) - ln(PRIOR plain(w)) - ln(1 + c(h, w) / (PRIOR plain(w)))

has one term of the history alone, one of the word and one that needs the bigram's count and the word's, a bigram that is
dealt to the place of its second word finds there all that the sum needs: counts and answers take one exchange,
and one more adds the answers up.  The commonest words and bigrams, which would be unsplit keys and half of the traffic,
are looked for in a sample, counted exactly over all documents, and answered where a document is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kvern.llm import textvec
from kvern.llm.util import dealt_to, mapped, numbers, partitions, runs, streamed, written

ADDED, PRIOR = 0.5, 100.0
#: What stands for a text's start (only ever a history) and for its end.
START, END = np.uint64(1), np.uint64(2)
_SALT = np.uint64(0x9E3779B97F4A7C15)
#: Words and bigrams that are answered where a document is read (about 50 bytes each in a worker), and bytes of the sample that they are looked for in, about.
COMMON_WORDS, COMMON_PAIRS, SAMPLE_BYTES = 1 << 16, 1 << 18, 32 << 20
SAMPLE_TASKS = 4
#: Bigrams that a task holds before it deals them out, about; documents of such a batch at most (15 bits).
PAIRS_AT_ONCE, DOCUMENTS = 2 << 20, 1 << 15
#: Ids of target documents that are broadcast at most; beyond, the join shuffles.
BROADCAST_ROWS = 1 << 20
Batches = Iterator[pa.RecordBatch]


def pair_key(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return textvec.mix(history ^ _SALT) + word


def events(w: textvec.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """History, word and text of all words and ends; a text without a word has none."""
    n = np.diff(w.bounds)
    some = np.flatnonzero(n > 0)
    last = w.bounds[1:][some]
    word = np.insert(w.hashes, last, END)
    row = np.repeat(some, n[some] + 1)
    history = np.empty_like(word)
    history[1:] = word[:-1]
    history[runs(row)[:-1]] = START
    return history, word, row


def find(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places in a sorted array; -1 for what it doesn't have."""
    if not len(known):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, at, -1)


@dataclass
class Common:
    """The commonest words and bigrams, sorted, and the second word of each bigram."""

    words: np.ndarray
    pairs: np.ndarray
    second: np.ndarray


@dataclass
class Counted:
    """Exact counts (row 0: target, row 1: background, scaled) of what is common, and of all tokens."""

    common: Common
    words: np.ndarray
    pairs: np.ndarray
    tokens: float
    vocabulary: int
    scale: np.ndarray

    def prior(self, counts: np.ndarray) -> np.ndarray:
        """PRIOR plain(w) of words from their scaled counts."""
        return PRIOR * (counts + ADDED) / (self.tokens + ADDED * self.vocabulary)

    def of_word(self, counts: np.ndarray) -> np.ndarray:
        """What each word adds to a loss, as itself and as the history of what follows."""
        return np.log(counts + PRIOR) - np.log(self.prior(counts))


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each key once, sorted, with the sums of its values."""
    order = np.argsort(key)
    key = key[order]
    cut = runs(key)[:-1]
    if not len(key):
        return key, *values
    return key[cut], *(np.add.reduceat(v[order], cut) for v in values)


def _common(read: DataFrame) -> Common:
    """What comes up most in a sample of the texts; another sample would change where the work is done, not one result."""
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # In a few tasks, each of which passes on what it has seen twice.
    texts = read.select("text").sample(min(1.0, SAMPLE_BYTES / max(size, 1)), 1).repartition(SAMPLE_TASKS)
    most = {"w": COMMON_WORDS, "p": COMMON_PAIRS}

    def count(batches: Batches) -> Batches:
        done: dict[str, list] = {"w": [], "p": []}
        for batch in batches:
            for _, _, data, bounds in textvec.chunks(batch.column("text")):
                history, word, _ = events(textvec.words(data, bounds))
                pair = pair_key(history, word)
                for kind, key, extra in (("w", word, word), ("p", pair, word)):
                    once, at, n = np.unique(key, return_index=True, return_counts=True)
                    done[kind].append((once, extra[at], n))
        for kind, got in done.items():
            if got:
                key, word, n = (np.concatenate(x) for x in zip(*got, strict=True))
                once, at = np.unique(key, return_index=True)
                n = _summed(key, n)[1]
                keep = np.argsort(-n, kind="stable")[: most[kind]]
                keep = keep[n[keep] > 1] if kind == "p" else keep
                yield pa.record_batch([pa.array([kind] * len(keep)), *(pa.array(x.view(np.int64)) for x in (once[keep], word[at[keep]], n[keep]))], ["kind", "key", "word", "n"])

    seen = mapped(texts, count, "kind string, key long, word long, n long").groupBy("kind", "key").agg(F.first("word").alias("word"), F.sum("n").alias("n"))
    got = {k: seen.where(F.col("kind") == k).orderBy(F.desc("n"), "key").limit(n).toArrow() for k, n in most.items()}
    pairs, words = (got[k]["key"].to_numpy().view(np.uint64) for k in ("p", "w"))
    # A common bigram's second word is common.
    second, order = got["p"]["word"].to_numpy().view(np.uint64), np.argsort(pairs)
    return Common(np.unique(np.concatenate([words, second, [END]])), pairs[order], second[order])


def _count(read: DataFrame, common: Common) -> Counted:
    """All words are counted, each once for all its tasks; the counts of common words and bigrams, and sums, reach the driver."""
    spark = read.sparkSession
    parts = partitions(spark)
    keys, shared = dealt_to(spark, parts), spark.sparkContext.broadcast(common)

    def deal(batches: Batches) -> Batches:
        done: list[tuple[np.ndarray, ...]] = []

        def packed() -> pa.RecordBatch:
            key, target, every = done[0]
            part = textvec.mix(key) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            keep = np.flatnonzero(np.diff(cut))
            rows = [[x[order[cut[p] : cut[p + 1]]].tobytes() for p in keep] for x in (key, target, every)]
            return pa.record_batch([pa.array(keys[keep]), *(pa.array(x, pa.binary()) for x in rows)], ["part", "key", "target", "background"])

        for batch in batches:
            wanted = numbers(batch.column("wanted"), "?")
            for first, last, data, bounds in textvec.chunks(batch.column("text")):
                history, word, row = events(textvec.words(data, bounds))
                own = wanted[first:last][row]
                pair = pair_key(history, word)
                hot = find(shared.value.pairs, pair) >= 0
                key = np.concatenate([word, pair[hot]])
                done.append(_summed(key, np.concatenate([own, own[hot]]).astype(np.int64), np.ones(len(key), np.int64)))
                if sum(len(x[0]) for x in done) > PAIRS_AT_ONCE:
                    done = [_summed(*(np.concatenate(x) for x in zip(*done, strict=True)))]
                    if len(done[0][0]) > PAIRS_AT_ONCE // 2:
                        yield packed()
                        done = []
        if done:
            done = [_summed(*(np.concatenate(x) for x in zip(*done, strict=True)))]
            yield packed()

    def merge(batches: Batches) -> Batches:
        for table in streamed(batches, "part"):
            cut = runs(numbers(table["part"].combine_chunks(), "i8"))
            binary = [table[c].to_pylist() for c in ("key", "target", "background")]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                key, target, every = _summed(*(np.frombuffer(b"".join(x[lo:hi]), t) for x, t in zip(binary, ("<u8", "<i8", "<i8"), strict=True)))
                word, pair = find(shared.value.words, key) >= 0, find(shared.value.pairs, key) >= 0
                kept = word | pair
                sums = [[x[~pair].sum()] for x in (target, every)]
                yield pa.record_batch([pa.array([*key[kept].view(np.int64).tolist(), None], pa.int64()), *(pa.array(np.concatenate([x[kept], s])) for x, s in ((target, sums[0]), (every, sums[1]))), pa.array([0] * int(kept.sum()) + [int((~pair).sum())])], ["key", "target", "background", "words"])

    dealt = mapped(read.select("text", "wanted"), deal, "part long, key binary, target binary, background binary")
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part")
    # Rows for what is common, which is bounded, and one more for each part.
    merged = written(mapped(dealt, merge, "key long, target long, background long, words long"))
    tokens, every, vocabulary = (x or 0 for x in merged.where("key is null").agg(F.sum("target"), F.sum("background"), F.sum("words")).first())
    scale = np.array([[1.0], [tokens / every if every else 1.0]])
    got = merged.where("key is not null").toArrow()
    key, n = got["key"].to_numpy().view(np.uint64), np.stack([got[c].to_numpy() for c in ("target", "background")]) * scale

    def of(known: np.ndarray) -> np.ndarray:
        out, at = np.zeros((2, len(known))), find(known, key)
        out[:, at[at >= 0]] = n[:, at >= 0]
        return out

    return Counted(common, of(common.words), of(common.pairs), float(tokens), vocabulary, scale)


def losses(read: DataFrame, counted: Counted) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss) of each row of read: doc_id, text, wanted.

    Batches are numbered by the task and by their place in it, so a task that runs again must read the rows that it
    read before: read is a table, or was written.
    """
    spark = read.sparkSession
    parts = partitions(spark)
    keys, shared = dealt_to(spark, parts), spark.sparkContext.broadcast(counted)
    kind, ids_type = read.schema["doc_id"].dataType.simpleString(), pa.list_(to_arrow_type(read.schema["doc_id"].dataType))
    schema = f"part long, batch long, words binary, sizes binary, pairs binary, rows binary, times binary, ids array<{kind}>, n_tokens binary, target binary, background binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def deal(batches: Batches) -> Batches:
        c = shared.value
        common, prior, of_word = c.common, c.prior(c.words), c.of_word(c.words)
        # An end is no history; a start is one as often as there are ends.
        end = int(find(common.words, np.array([END]))[0])
        of_word[:, end] = -np.log(prior[:, end])
        of_start = np.log(c.words[:, end] + PRIOR)
        of_pair = -np.log1p(c.pairs / prior[:, find(common.words, common.second)])
        held: list[tuple[np.ndarray, ...]] = []
        texts: list[tuple] = []
        number = TaskContext.get().partitionId() << 24

        def out() -> pa.RecordBatch:
            word, pair, row = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(pair, kind="stable")  # rows stay in order
            word, pair, row = word[order], pair[order], row[order]
            fresh = np.ones(len(pair), bool)
            fresh[1:] = (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])
            cut = np.flatnonzero(fresh)
            times = np.diff(np.append(cut, len(pair))).astype("<u4")
            word, pair, row = word[cut], pair[cut], row[cut].astype("<u2")
            # A common word has no place of its own: its bigrams are spread.
            part = textvec.mix(np.where(find(common.words, word) >= 0, pair, word)) % np.uint64(parts)
            order = np.lexsort((word, part))
            word, pair, row, times, part = (x[order] for x in (word, pair, row, times, part))
            of_part = runs(part)
            lists: list[list] = [[] for _ in names]
            for lo, hi in zip(of_part[:-1], of_part[1:], strict=True):
                own = runs(word[lo:hi])
                for x, v in zip(lists, (int(keys[part[lo]]), number, word[lo:hi][own[:-1]].tobytes(), np.diff(own).astype("<u4").tobytes(), pair[lo:hi].tobytes(), row[lo:hi].tobytes(), times[lo:hi].tobytes(), None, None, None, None), strict=True):
                    x.append(v)
            ids, n, sums = zip(*texts, strict=True)
            sums = np.concatenate(sums, 1)
            for x, v in zip(lists, (int(keys[(number + (number >> 24)) % parts]), number, None, None, None, None, None, pa.chunked_array(ids).to_pylist(), np.concatenate(n).tobytes(), sums[0].tobytes(), sums[1].tobytes()), strict=True):
                x.append(v)
            types = [pa.int64(), pa.int64(), *[pa.binary()] * 5, ids_type, *[pa.binary()] * 3]
            return pa.record_batch([pa.array(x, t) for x, t in zip(lists, types, strict=True)], names)

        documents = pending = 0
        for batch in batches:
            wanted = numbers(batch.column("wanted"), "?")
            for first, last, data, bounds in textvec.chunks(batch.column("text")):
                if documents and (documents + last - first > DOCUMENTS or pending > PAIRS_AT_ONCE):
                    yield out()
                    number, documents, pending, held, texts = number + 1, 0, 0, [], []
                w = textvec.words(data, bounds)
                history, word, row = events(w)
                pair = pair_key(history, word)
                at, hot = find(common.words, word), find(common.pairs, pair)
                n = np.diff(w.bounds)
                sums = np.where(n > 0, of_start[:, None], 0.0)
                for values, place in ((of_word, at), (of_pair, hot)):
                    some = np.flatnonzero(place >= 0)
                    sums += np.stack([np.bincount(row[some], v[place[some]], minlength=len(n)) for v in values])
                cold = hot < 0
                held.append((word[cold], pair[cold], ((documents + row[cold]) << 1) | wanted[first:last][row[cold]]))
                texts.append((batch.column("doc_id").slice(first, last - first), n, sums))
                documents, pending = documents + last - first, pending + int(cold.sum())
        if texts:
            yield out()

    def answered(batches: list[dict]) -> Batches:
        c = shared.value
        size = [len(b["rows"]) // 2 for b in batches]
        word = np.concatenate([np.repeat(np.frombuffer(b["words"], "<u8"), np.frombuffer(b["sizes"], "<u4")) for b in batches])
        pair, row, times = (np.frombuffer(b"".join(b[c] for b in batches), t) for c, t in (("pairs", "<u8"), ("rows", "<u2"), ("times", "<u4")))
        both = np.stack([np.where(row & 1, times, 0), times]).astype(np.float64) * c.scale

        def totals(key: np.ndarray) -> np.ndarray:
            once, where = np.unique(key, return_inverse=True)
            return np.stack([np.bincount(where, b, minlength=len(once))[where] for b in both])

        at = find(c.common.words, word)
        cold = at < 0
        of_word = totals(word)  # for words that aren't common: all of their bigrams are here
        of_word[:, ~cold] = c.words[:, at[~cold]]
        value = -np.log1p(totals(pair) / c.prior(of_word))
        value[:, cold] += c.of_word(of_word[:, cold])
        value *= times
        document = (np.repeat(np.arange(len(batches)), size) << 15) | (row >> 1)
        once, target, background = _summed(document, *value)
        cut = np.searchsorted(once >> 15, np.arange(len(batches) + 1))
        for k, b in enumerate(batches):
            lo, hi = cut[k], cut[k + 1]
            yield pa.record_batch([pa.array([b["batch"]]), *(pa.array([x], pa.binary()) for x in ((once[lo:hi] & 0x7FFF).astype("<u2").tobytes(), target[lo:hi].tobytes(), background[lo:hi].tobytes(), None)), pa.array([None], ids_type)], ["batch", "rows", "target", "background", "n_tokens", "ids"])

    def answer(batches: Batches) -> Batches:
        for table in streamed(batches, "part"):
            asked = table.filter(table["ids"].is_null())
            yield from table.filter(table["ids"].is_valid()).select(["batch", "rows", "target", "background", "n_tokens", "ids"]).to_batches()
            part = numbers(asked["part"].combine_chunks(), "i8")
            cut = runs(part)
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                yield from answered(asked.slice(lo, hi - lo).to_pylist())

    def add(batches: Batches) -> Batches:
        for table in streamed(batches, "batch"):
            number = numbers(table["batch"].combine_chunks(), "i8")
            cut = runs(number)
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                rows = table.slice(lo, hi - lo).to_pylist()
                (own,) = [r for r in rows if r["ids"] is not None]
                n = np.frombuffer(own["n_tokens"], "<i8")
                sums = [np.frombuffer(own[c], "<f8").copy() for c in ("target", "background")]
                for r in rows:
                    if r["ids"] is None:
                        at = np.frombuffer(r["rows"], "<u2")
                        for s, c in zip(sums, ("target", "background"), strict=True):
                            s[at] += np.frombuffer(r[c], "<f8")
                tokens = np.where(n > 0, n + 1, 1)
                yield pa.record_batch([pa.array(own["ids"], ids_type.value_type), pa.array(n), *(pa.array(s / tokens) for s in sums)], ["doc_id", "n_tokens", "target_loss", "background_loss"])

    dealt = mapped(read.select("doc_id", "text", "wanted"), deal, schema)
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part")
    found = mapped(dealt, answer, f"batch long, rows binary, target binary, background binary, n_tokens binary, ids array<{kind}>")
    found = found.repartition(parts, "batch").sortWithinPartitions("batch")
    return mapped(found, add, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double")


def score_documents(docs: DataFrame, wanted: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of each document; wanted: the ids of target documents, in a column of the same name.

    Losses are nats per token, a text's end being one more token than n_tokens counts; a text without a word, a
    null text too, has 0 tokens and scores 0.  Repeated rows count each time.  Without target documents both
    models are the same and all scores 0.  A null id is never a target.
    """
    ids = wanted.select(F.col(id_column).alias("__kvern_id")).where("__kvern_id is not null").distinct().withColumn("__kvern_wanted", F.lit(True))
    few = ids.count() <= BROADCAST_ROWS
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    flagged = named.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("__kvern_id"), "left")
    read = flagged.select("doc_id", "text", F.coalesce("__kvern_wanted", F.lit(False)).alias("wanted"))
    if not few:
        read = written(read)  # `losses` asks for rows that stay where they are
    if not read.where("wanted").limit(1).count():
        read = read.withColumn("wanted", F.lit(True))
    found = losses(read, _count(read, _common(read)))
    return found.withColumn("score", F.col("target_loss") - F.col("background_loss"))
