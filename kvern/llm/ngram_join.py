"""Near-duplicate join on word n-grams: MinHash candidates pruned by their posterior, the rest verified exactly.

1.  Every document becomes its set of word 5-grams (`textvec.shingles`).  Documents with the same set are one
    class: copies are counted, never paired.
2.  All shingles of all documents are counted; the frequent ones come last in the one order that all sets
    are sorted by, so that a passage many documents share is the last thing that makes two of them meet.
3.  Two sets with a Jaccard similarity of t or more share a shingle among the first
    size - ceil(t * size) + 1 of each: only those are dealt out.  No such pair is missed.  The classes
    that share one form a unit; the classes of the most frequent shingles are dealt to blocks, a unit for each two
    blocks, and any other unit that turns out large is divided in the same way: no task gets a whole group.
4.  In a unit, MinHash values are compared a few at a time, and a pair is dropped once the posterior
    probability that its similarity reaches t is below `tolerance`.  What is left links
    classes to families (only a spanning forest leaves a unit, never all pairs).
5.  In each family, in blocks again, all pairs are verified on the whole sets by a product of
    0/1 matrices.  Link counts and a spanning forest of the true links leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvern.llm import textvec
from kvern.llm.util import components, in_arrow, labels_of, mapped, numbers, partitions, runs, streamed, written

LEAST = -(1 << 63)
HASHES = 64
STEP = 8
#: Classes of a unit for MinHash values and for whole sets.
BLOCK, VERIFY_BLOCK = 512, 256
#: Shingles of a block's sets, about.
VERIFY_SHINGLES = 1 << 18
#: A shingle of at least so many documents has a place of its own in the order; of those, so many at most are held (16 bytes each), the
#: most frequent.  Any other one has less than 1 / FREQUENT_HELD of all shingles; its unit is divided once its size is known.
FREQUENT, FREQUENT_HELD = 64, 1 << 20
#: Shingles are counted by so many bits of their hash: an order depends on the counts, and how units are divided, not what is found.
COUNTED_BITS = 48
#: Rows that are broadcast at most (16 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 1 << 20
COLUMNS = 2048

_SEEDS = textvec.mix(np.arange(7, 7 + HASHES, dtype=np.uint64)) | np.uint64(1)


def _sets(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return textvec.distinct(*textvec.shingles(textvec.words(data, bounds), n))


def set_keys(hashes: np.ndarray, row: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit keys of each text's set, independent of each other, and the set's size; texts with the same set have the same keys."""
    size = np.bincount(row, minlength=texts)
    bounds = runs(row)
    keys = []
    for salt in (0xA5A5A5A5A5A5A5A5, 0x3C6EF372FE94F82B):
        key = np.zeros(texts, np.uint64)
        if len(row):
            with np.errstate(over="ignore"):
                key[row[bounds[:-1]]] = np.add.reduceat(textvec.mix(hashes ^ np.uint64(salt)), bounds[:-1])
        keys.append(textvec.mix(key + size.astype(np.uint64)))
    return keys[0].view(np.int64), keys[1].view(np.int64), size


def class_keys(hashes: np.ndarray, row: np.ndarray, texts: int, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of each text's class, and the set's size; `shared`: first keys (sorted) that different sets have, which the second ones tell apart."""
    key, second, size = set_keys(hashes, row, texts)
    if len(shared):
        both = shared[np.minimum(np.searchsorted(shared, key), len(shared) - 1)] == key
        key = np.where(both, second, key)
    return key, size


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One byte of each of the MinHash values of each set (a row a set; the sets are not empty)."""
    out = np.empty((len(bounds) - 1, HASHES), np.uint8)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(hashes * _SEEDS[k], bounds[:-1]) >> np.uint64(8)
    return out


def least_matches(threshold: float, tolerance: float, hashes: int = HASHES, step: int = STEP) -> list[tuple[int, int]]:
    """(values compared, matches that a pair needs then) for the pruning.

    Matches of n values are binomial with s + (1 - s) / 256, as a byte of two different values agrees by
    chance; with a uniform prior for s, the posterior of s >= threshold is a ratio of two integrals.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    agree = s + (1 - s) / 256
    out = []
    for n in range(step, hashes + 1, step):
        need = 0
        for m in range(n + 1):
            like = np.exp(m * np.log(agree) + (n - m) * np.log1p(-agree))
            if like[s >= threshold].sum() / like.sum() >= tolerance:
                break
            need = m + 1
        out.append((n, need))
    return out


def prefix_length(size: np.ndarray, threshold: float) -> np.ndarray:
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


def _documents(docs: DataFrame, n: int) -> DataFrame:
    """id, text_key, key (null where a text has no word), second key, size, signature of every document."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, last, data, bounds in textvec.chunks(batch.column("text")):
            hashes, row = _sets(data, bounds, n)
            key, second, size = set_keys(hashes, row, last - first)
            sig = np.zeros((last - first, HASHES), np.uint8)
            if len(row):
                cut = runs(row)
                sig[row[cut[:-1]]] = signatures(hashes, cut)
            same = [batch.column(c).slice(first, last - first) for c in ("id", "text_key")]
            yield pa.record_batch([*same, pa.array(key, mask=size == 0), pa.array(second), pa.array(size, pa.int64()), pa.array([x.tobytes() for x in sig], pa.binary())], ["id", "text_key", "key", "second", "size", "sig"])

    return in_arrow(docs, run, "id long, text_key long, key long, second long, size long, sig binary")


def _classes(own: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """own with the keys of its classes, the classes (key, id, copies, size, sig), and the first keys that different sets share (as good as always none)."""

    def grouped(rows: DataFrame) -> DataFrame:
        apart = [F.min("second").alias("lo"), F.max("second").alias("hi")]
        return written(rows.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("sig").alias("sig"), *apart))

    classes = grouped(own)
    # Of n different sets, n * n / 2 ** 65 pairs at most are expected here.
    shared = np.sort(np.array([r["key"] for r in classes.where("lo <> hi").select("key").collect()], np.int64))
    if len(shared):
        again = own.sparkSession.createDataFrame([(int(k),) for k in shared], "key long")
        own = written(own.join(F.broadcast(again.withColumn("both", F.lit(True))), "key", "left").withColumn("key", F.when(F.col("both"), F.col("second")).otherwise(F.col("key"))).drop("both"))
        classes = grouped(own)
    return own, classes, shared


def _parts(spark: SparkSession) -> int:
    return 4 * partitions(spark)


def _frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The upper COUNTED_BITS bits of frequent shingles, sorted, and how many documents have each.

    Counted over all documents: each task deals its shingles, packed, to the parts of the range of hashes.
    """
    parts, low = _parts(docs.sparkSession), np.uint64(32)

    def deal(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        got = [_sets(data, bounds, n)[0] >> np.uint64(64 - COUNTED_BITS) for _, _, data, bounds in textvec.chunks(batch.column("text"))]
        have = np.sort(np.concatenate(got)) if got else np.zeros(0, np.uint64)
        part = ((have >> np.uint64(COUNTED_BITS - 32)) * np.uint64(parts)) >> low
        at = np.searchsorted(part, np.arange(parts + 1))
        keep = np.flatnonzero(np.diff(at))
        # In order, the high bits come in runs, which compress to little.
        planes = (have >> low).astype("<u2"), have.astype("<u4")
        yield pa.record_batch([pa.array(keep, pa.int32()), *(pa.array([x[at[p] : at[p + 1]].tobytes() for p in keep], pa.binary()) for x in planes)], ["part", "high", "low"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in streamed(batches, "part"):
            part = numbers(table["part"].combine_chunks(), "i8")
            planes = [table[c].to_pylist() for c in ("high", "low")]
            cut = runs(part)
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                high, rest = (np.frombuffer(b"".join(x[lo:hi]), t).astype(np.uint64) for x, t in zip(planes, ("<u2", "<u4"), strict=True))
                value, times = np.unique((high << low) | rest, return_counts=True)
                often = times >= FREQUENT
                yield pa.record_batch([pa.array(value[often].view(np.int64)), pa.array(times[often], pa.int64())], ["value", "times"])

    dealt = in_arrow(docs.select("text"), deal, "part int, high binary, low binary").repartition(partitions(docs.sparkSession), "part").sortWithinPartitions("part")
    often = written(mapped(dealt, count, "value long, times long")).withColumn("level", F.floor(8 * F.log2("times")))
    # From a row for each level of counts: the level that the last held one has; rarer ones needn't be sorted.
    least, seen = 0, 0
    for r in often.groupBy("level").count().orderBy(F.desc("level")).collect():
        least, seen = r["level"], seen + r["count"]
        if seen >= FREQUENT_HELD:
            break
    most = often.where(F.col("level") >= least).orderBy(F.desc("times"), "value").limit(FREQUENT_HELD).toPandas().sort_values("value")
    return most["value"].to_numpy(np.uint64), most["times"].to_numpy(np.int64)


def _ordered(hashes: np.ndarray, row: np.ndarray, value: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets (texts in order) with each set's shingles from rare to frequent, and how many documents have each (0: few)."""
    often = np.zeros(len(hashes), np.int64)
    if len(value):
        upper = hashes >> np.uint64(64 - COUNTED_BITS)
        at = np.minimum(np.searchsorted(value, upper), len(value) - 1)
        often = np.where(value[at] == upper, times[at], 0)
    if often.any():
        order = np.lexsort((hashes, often, row))
        return hashes[order], row[order], often[order]
    return hashes, row, often


def _units(docs: DataFrame, n: int, threshold: float, shared: np.ndarray) -> DataFrame:
    """(unit, side, key) of the classes that meet in a shingle of their prefixes; a pair of side 1 and 1 isn't asked for."""
    spark = docs.sparkSession
    parts = _parts(spark)
    frequent = spark.sparkContext.broadcast(_frequent(docs, n))

    def deal(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        got: list[tuple[np.ndarray, ...]] = []
        for first, last, data, bounds in textvec.chunks(batch.column("text")):
            hashes, row = _sets(data, bounds, n)
            key, size = class_keys(hashes, row, last - first, shared)
            hashes, row, often = _ordered(hashes, row, *frequent.value)
            place = np.arange(len(row)) - np.searchsorted(row, np.arange(last - first))[row]
            keep = place < prefix_length(size, threshold)[row]
            got.append((hashes[keep], key[row[keep]], often[keep]))
        if not got:
            return
        token, key, often = (np.concatenate(x) for x in zip(*got, strict=True))
        blocks = np.maximum(1, -(-often // BLOCK))
        own = textvec.mix(key.view(np.uint64)) % blocks.astype(np.uint64)
        at = np.repeat(np.arange(len(token)), blocks)
        other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        mine = own[at].astype(np.int64)
        with np.errstate(over="ignore"):
            pair = np.minimum(mine, other) * blocks[at] + np.maximum(mine, other)
            unit = np.where(blocks[at] > 1, textvec.mix(token[at] + pair.astype(np.uint64) * textvec._MULTIPLIER), token[at])
        # Between two blocks only pairs of one of each count: the block with the lower number has side 0, the other 2.
        side = np.where(mine == other, 1, np.where(mine < other, 0, 2)).astype(np.uint8)
        order = np.argsort(unit)
        unit, side, key = unit[order], side[order], key[at][order]
        part = (unit >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        cut = np.searchsorted(part, np.arange(parts + 1))
        keep = np.flatnonzero(np.diff(cut))
        yield pa.record_batch([pa.array(keep, pa.int32()), *(pa.array([x[cut[p] : cut[p + 1]].tobytes() for p in keep], pa.binary()) for x in (unit, side, key))], ["part", "unit", "side", "key"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in streamed(batches, "part"):
            part = numbers(table["part"].combine_chunks(), "i8")
            packed = [table[c].to_pylist() for c in ("unit", "side", "key")]
            cut = runs(part)
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                unit, side, key = (np.frombuffer(b"".join(x[lo:hi]), t) for x, t in zip(packed, ("u8", "u1", "i8"), strict=True))
                order = np.lexsort((key, side, unit))
                unit, side, key = unit[order], side[order], key[order]
                fresh = np.ones(len(unit), bool)
                fresh[1:] = (unit[1:] != unit[:-1]) | (key[1:] != key[:-1])
                unit, side, key = unit[fresh], side[fresh], key[fresh]
                bounds = runs(unit)
                several = np.repeat((np.diff(bounds) > 1) & ((side[bounds[:-1]] == 1) | (side[bounds[:-1]] != side[bounds[1:] - 1])), np.diff(bounds))
                unit, side, key = unit[several], side[several], key[several]
                for at in range(0, len(unit), 1 << 16):
                    to = at + (1 << 16)
                    yield pa.record_batch([pa.array(unit[at:to].view(np.int64)), pa.array(side[at:to], pa.int32()), pa.array(key[at:to])], ["unit", "side", "key"])

    dealt = in_arrow(docs.select("text"), deal, "part int, unit binary, side binary, key binary").repartition(partitions(spark), "part").sortWithinPartitions("part")
    return _divided(written(mapped(dealt, meet, "unit long, side int, key long")))


def _divided(units: DataFrame) -> DataFrame:
    """units, with those that turned out larger than two blocks as units of two blocks each."""
    large = written(units.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.max("side").alias("most")).where((F.col("n") > 2 * BLOCK) & (F.col("most") == 1)).select("unit", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    found = large.count()
    if not found:
        return units
    dealt = units.join(F.broadcast(large) if found <= BROADCAST_ROWS else large, "unit", "left")
    dealt = dealt.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.when(F.col("blocks") == 1, F.col("unit")).otherwise(F.xxhash64("unit", F.least("block", "other"), F.greatest("block", "other")))
    side = F.when(F.col("blocks") == 1, F.col("side")).when(F.col("block") == F.col("other"), 1).when(F.col("block") < F.col("other"), 0).otherwise(2)
    return dealt.select(unit.alias("unit"), side.alias("side"), "key")


def _survivors(units: DataFrame, classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Edges (a, b) that join the classes which the pruning leaves together."""
    steps = least_matches(threshold, tolerance)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in streamed(batches, "unit"):
            unit, side, key, size = (numbers(table[c].combine_chunks(), "i8") for c in ("unit", "side", "key", "size"))
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, HASHES)
            left, right = [], []
            at = np.arange(len(unit))
            apart = 1
            while len(at):
                at = at[at + apart < len(unit)]
                at = at[unit[at] == unit[at + apart]]
                a, b = at, at + apart
                ok = (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9) & ((side[a] == 1) | (side[a] != side[b])) & (key[a] != key[b])
                a, b = a[ok], b[ok]
                same, done = np.zeros(len(a), np.int64), 0
                for n, need in steps:
                    same += (sig[a, done:n] == sig[b, done:n]).sum(1)
                    ok, done = same >= need, n
                    a, b, same = a[ok], b[ok], same[ok]
                left.append(a)
                right.append(b)
                apart += 1
            if not left:
                continue
            node, where = np.unique(key, return_inverse=True)
            root = labels_of(where[np.concatenate(left)], where[np.concatenate(right)], len(node))
            linked = np.flatnonzero(root != np.arange(len(node)))
            yield pa.record_batch([pa.array(node[linked]), pa.array(node[root[linked]])], ["a", "b"])

    have = units.join(classes.select("key", "size", "sig"), "key")
    dealt = have.repartition(partitions(units.sparkSession), "unit").sortWithinPartitions("unit", "side")
    return mapped(dealt, prune, "a long, b long").distinct()


def _verified(docs: DataFrame, classes: DataFrame, families: DataFrame, n: int, threshold: float, shared: np.ndarray) -> DataFrame:
    """(key, links, other): how many documents of other classes a class is linked to, in one unit each; other: a spanning forest of the links."""
    spark = docs.sparkSession
    members = written(families.select(F.col("node").alias("key"), "root").join(classes.select("key", "id", "copies", "size"), "key"))
    wanted = members.select("id", "key")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)

    def tokens(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, last, data, bounds in textvec.chunks(batch.column("text")):
            hashes, row = _sets(data, bounds, n)
            mine = class_keys(hashes, row, last - first, shared)[0]
            asked = batch.column("key").slice(first, last - first)
            at = np.searchsorted(row, np.arange(last - first + 1))
            keep = np.flatnonzero(mine == numbers(asked, "i8"))
            yield pa.record_batch([asked.take(pa.array(keep)), pa.array([hashes[at[i] : at[i + 1]].tobytes() for i in keep], pa.binary())], ["key", "have"])

    sets = in_arrow(docs.join(wanted, "id").select("key", "text"), tokens, "key long, have binary")
    many = members.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / VERIFY_BLOCK), F.ceil(F.sum("size") / VERIFY_SHINGLES)).cast("int").alias("blocks"))
    placed = members.select("root", "key", "copies").join(many, "root").withColumn("block", F.pmod(F.hash("key"), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other"))
    side = F.when(F.col("block") == F.col("other"), 1).when(F.col("block") < F.col("other"), 0).otherwise(2)
    rows = placed.select(unit.alias("unit"), side.alias("side"), "key", "copies").join(sets, "key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in streamed(batches, "unit"):
            unit, side, key, copies = (numbers(table[c].combine_chunks(), "i8") for c in ("unit", "side", "key", "copies"))
            have = table["have"].combine_chunks() if table.num_rows else None
            cut = runs(unit)
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                _, once = np.unique(key[lo:hi], return_index=True)  # a repeated row gives its set again
                at = lo + once
                links, a, b = _unit_links([np.frombuffer(have[int(i)].as_py(), np.uint64) for i in at], side[at], copies[at], threshold)
                root = labels_of(a, b, len(at))
                keep = np.flatnonzero(links)
                own = key[at]
                yield pa.record_batch([pa.array(own[keep]), pa.array(links[keep], pa.int64()), pa.array(own[root[keep]])], ["key", "links", "other"])

    dealt = rows.repartition(partitions(spark), "unit").sortWithinPartitions("unit")
    return mapped(dealt, verify, "key long, links long, other long")


def _unit_links(sets: list[np.ndarray], side: np.ndarray, copies: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set of a unit, the documents of the sets it is linked to; and the links."""
    size = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), size)
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    keep = shared[token]
    row, column = row[keep], column[token[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS))
        x = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - lo)), np.float32)
        x[row[a:b], column[a:b] - lo] = 1
        both += x @ x.T
    total = size[:, None] + size[None, :] - both
    linked = (both >= threshold * total - 1e-6) & ((side[:, None] == 1) | (side[:, None] != side[None, :]))
    np.fill_diagonal(linked, False)
    a, b = np.nonzero(np.triu(linked))
    return linked @ copies, a, b


def _classified(docs: DataFrame, threshold: float, n: int, tolerance: float, id_column: str, text_column: str) -> DataFrame:
    """(id, text_key, root, class_id, copy_id, n_links) of each row; root: the group's key, null for a text without a word."""
    if not math.isfinite(threshold) or not 0 < threshold <= 1:
        raise ValueError("threshold: above 0, 1 at most")
    read = docs.select(*_keyed(id_column, text_column), F.col(text_column).alias("text"))
    own, classes, shared = _classes(written(_documents(read, n)))
    families = components(written(_survivors(_units(read, n, threshold, shared), classes, threshold, tolerance)))
    links = written(_verified(read, classes, families, n, threshold, shared))
    counts = links.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("key").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "key")
    rooted = classes.select("key", "id", "copies").join(roots, "key", "left").join(counts, "key", "left").withColumn("root", F.coalesce("root", "key"))
    first = rooted.groupBy("root").agg(F.min("id").alias("class_id"))
    known = rooted.join(first, "root").select("key", "root", "class_id", F.col("id").alias("copy_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = own.select("id", "text_key", "key").join(known, "key", "left")
    return out.select("id", "text_key", "root", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copy_id", "id").alias("copy_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def _keyed(id_column: str, text_column: str, prefix: str = "") -> tuple[Column, Column]:
    """What tells documents apart: the id (null: LEAST) and a hash of the text."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    return F.coalesce(F.col(id_column).cast("long"), F.lit(LEAST)).alias(f"{prefix}id"), F.xxhash64(text).alias(f"{prefix}text_key")


def join_documents(docs: DataFrame, threshold: float = 0.8, n: int = textvec.SHINGLE, tolerance: float = 1e-6, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: doc_id, class_id, copy_id, n_links.

    class_id: the least id of the documents that links lead to from this one; copy_id: the least id of the
    documents with the same set of shingles; n_links: the other documents whose similarity is
    `threshold` or more, copies included.  A null text and a text without a word have no link and are classes
    of their own.  A null id counts as the least long, in class_id too, and comes back as null in doc_id.
    Repeated rows are copies of each other.  Other columns are not read.
    """
    found = _classified(docs, threshold, n, tolerance, id_column, text_column)
    return found.select(F.when(F.col("id") != LEAST, F.col("id")).alias("doc_id"), "class_id", "copy_id", "n_links")


def one_of_each(docs: DataFrame, threshold: float = 0.8, n: int = textvec.SHINGLE, tolerance: float = 1e-6, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The columns of docs, with one document of each group that links connect: the one with the least id.

    Of repeated rows one stays, also where their text has no word; different texts under one id are different
    documents.
    """
    found = _classified(docs, threshold, n, tolerance, id_column, text_column)
    told = found.groupBy("root", "id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    alone = F.when(F.col("root").isNull(), F.struct("id", "text_key"))
    picked = told.groupBy("root", alone.alias("alone")).agg(F.min(F.struct("id", "text_key", "n")).alias("x"))
    picked = written(picked.select(*(F.col(f"x.{c}").alias(f"__kvern_{c}") for c in ("id", "text_key", "n"))))
    if picked.count() <= BROADCAST_ROWS:
        picked = F.broadcast(picked)
    keyed, by = docs.select("*", *_keyed(id_column, text_column, "__kvern_")), ["__kvern_id", "__kvern_text_key"]
    once = keyed.join(picked.where("__kvern_n = 1"), by, "left_semi")
    again = keyed.join(picked.where("__kvern_n > 1"), by, "left_semi").dropDuplicates(by)
    return once.unionByName(again).select(*docs.columns)
