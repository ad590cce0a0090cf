"""Document fingerprints from spot signatures, in DataFrame operations only.

A spot signature is a common word (the anchor) with the chain of the next content words after it; content
words are those that are no anchors.  Anchors directly before another anchor give none; the text's start
counts as one more anchor.  A document's fingerprint is its set of hashed signatures (64 bits of their MD5) with the
number of the length partition that the set is in.  Sets are compared by Jaccard, pruned by their lengths: those in
partitions that do not touch can't reach the threshold, nor can those whose lengths' ratio is below it.

With a `gap`, content words are anchors too where common ones are missing: those that have so many content words
between the anchor before and themselves, and before a text's first anchor all after the first chain.  So texts
without common words (other languages, code, tables) are covered to their end; the rule looks at nearby words only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvern.llm.decontaminate import words
from kvern.llm.util import written

CHAIN = 3
#: Content words after an anchor beyond which the next ones are anchors themselves, for callers that ask for it.
GAP = 8
THRESHOLD = 0.8
#: Common words by language (fixed values).
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au aux ce dans de des du en est et il la le les par pas pour que qui sur un une "
    "auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "con del el es las lo los no para por se su una y"
).split()
LEAST = -(1 << 63)
#: A likeness that can't reach this isn't computed by the query: texts that have nothing to do with each other.
NEAR = 0.2
#: Bytes of a range of rows, about, as long as there are no more than RANGES of them; ranges are sorted on disk where they are larger.
RANGE_BYTES, RANGES = 2 << 20, 1 << 16
#: Rows drawn for each range to find its bounds.
DRAWS = 16


def _hashed(*words_: Column) -> Column:
    """64 bits, in hex, of what the words say; missing ones are left out."""
    return F.substring(F.md5(F.concat_ws(" ", *words_).cast("binary")), 1, 16)


def signatures(df: DataFrame, text: str, into: str, gap: int | None = None) -> DataFrame:
    """df and `into`: the sorted array of distinct signatures of the column `text`.

    A null or empty text has none.  A text without a content word has one, of all its words; one without
    words has one, of the text.  So equal texts have equal sets, and a set is empty for empty texts only.
    """
    w, a, c = f"_{into}_words", f"_{into}_anchors", f"_{into}_content"
    df = df.withColumn(w, words(F.col(text)))
    places = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(a, F.filter(places, lambda i: F.get(F.col(w), i).isin(*ANCHORS))).withColumn(c, F.filter(w, lambda x: ~x.isin(*ANCHORS)))

    def chain(anchor: Column, at: Column) -> Column:
        return _hashed(anchor, *(F.get(F.col(c), at + k) for k in range(CHAIN)))

    def spot(i: Column, j: Column) -> Column:
        # Of the words before place i, j are anchors: i - j content words come first.
        directly = F.coalesce(F.get(F.col(a), j + 1) == i + 1, F.lit(False))
        return F.when(~directly & (i - j < F.size(c)), chain(F.get(F.col(w), i), i - j))

    def between(first: Column, end: Column) -> Column:
        return F.when(first < end, F.sequence(first, end - 1)).otherwise(F.array().cast("array<int>"))

    def far(i: Column, j: Column) -> Column:
        # Content words after the anchor at place i are c[i - j], ... up to the next anchor.
        return between(i - j + gap, F.coalesce(F.get(F.col(a), j + 1), F.size(w)) - j - 1)

    spots = F.array_compact(F.transform(F.col(a), spot))
    if gap is not None:
        more = F.concat(between(F.lit(CHAIN), F.coalesce(F.get(F.col(a), 0), F.size(w))), F.flatten(F.transform(F.col(a), far)))
        spots = F.concat(spots, F.transform(more, lambda at: chain(F.get(F.col(c), at), at + 1)))
    whole = F.array(_hashed(F.lit("$"), F.col(w)))
    odd = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.array(_hashed(F.lit("#"), F.col(text))))
    found = F.when(F.size(c) > 0, F.concat(spots, F.array(chain(F.lit("^"), F.lit(0))))).when(F.size(w) > 0, whole).otherwise(odd)
    return df.withColumn(into, F.array_sort(F.array_distinct(found))).drop(w, a, c)


def partition_of(n: Column, threshold: float = THRESHOLD) -> Column:
    """The length partition of a set of n: sets whose lengths have a ratio of `threshold` or more are in one or in two neighbours."""
    return F.when(n > 0, F.floor(F.log(n.cast("double")) / math.log(1 / threshold)).cast("int") + 1).otherwise(0)


def fingerprint(signatures_: Column) -> Column:
    """Length partition, colon, signatures in order with commas."""
    return F.concat_ws(":", partition_of(F.size(signatures_)).cast("string"), F.concat_ws(",", signatures_))


def likeness(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard of two signature arrays; 0 where the lengths alone keep it below the threshold; 1 for two empty sets."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    exact = both / (small + large - both)
    apart = (small < threshold * large) | (small == 0)
    if threshold:
        apart |= F.abs(partition_of(F.size(a), threshold) - partition_of(F.size(b), threshold)) > 1
    return F.when(large == 0, 1.0).when(apart, 0.0).otherwise(exact)


def _bucket(id_: Column, key: Column, bounds: list[tuple[int, int]]) -> Column:
    """How many of the sorted bounds (id, key) are not above the row, by bisection."""
    if not bounds:
        return F.lit(0)
    ids, keys = (F.lit(list(x)).cast("array<bigint>") for x in zip(*bounds, strict=True))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))

    def not_above(at: Column) -> Column:
        return F.coalesce((F.get(ids, at) < id_) | ((F.get(ids, at) == id_) & (F.get(keys, at) <= key)), F.lit(False))

    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(not_above(at + step - 1), at + step).otherwise(at))


def _bounds(slim: DataFrame) -> list[tuple[int, int]]:
    """The first (id, key) of each range after the first, from rows drawn with a chance in proportion to their bytes; slim: id, key, bytes."""
    total = slim.agg(F.sum("bytes")).first()[0] or 0
    pieces = min(-(-total // RANGE_BYTES), RANGES)
    if pieces <= 1:
        return []
    share = max(1.0, total / pieces / DRAWS)
    luck = F.pmod(F.xxhash64("id", "key"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    # About DRAWS rows for each range, and those that are larger than a range's part.
    drawn = slim.where(luck * share < F.col("bytes")).select("id", "key", F.greatest("bytes", F.lit(share)).alias("weight")).orderBy("id", "key").collect()
    out, seen, step = [], 0.0, sum(r["weight"] for r in drawn) / pieces
    for r in drawn:
        if seen >= step * (len(out) + 1) and (not out or (r["id"], r["key"]) > out[-1]):
            out.append((r["id"], r["key"]))
        seen += r["weight"]
    return out


def with_next(docs: DataFrame, carried: list[str], id_column: str, key: str, size: Column, derived: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """derived(docs) with next_<column> of each carried column, from the next row by descending (id, key); after the last row comes the first.

    key: a long.  Rows are dealt to ranges of (id, key) of near-equal `size`; the first row of a range is lent to the range
    before it, so that no range needs another, and what is derived is derived once for each row and each range.
    Rows with the same id and key are interchangeable and stay in one range.  Columns named __kvern_* are the function's own.
    """
    spark = docs.sparkSession
    id_ = F.coalesce(F.col(id_column).cast("long"), F.lit(LEAST))
    slim = written(docs.select(id_.alias("id"), F.col(key).alias("key"), size.cast("long").alias("bytes")))
    bounds = _bounds(slim)
    # A row for each range: RANGES at most.
    first = F.max(F.struct("id", "key")).alias("x")
    heads = [tuple(r) for r in slim.groupBy(_bucket(F.col("id"), F.col("key"), bounds).alias("range")).agg(first).select("range", "x.id", "x.key").orderBy("range").collect()]
    if not heads:
        return derived(docs).select("*", *(F.col(c).alias(f"next_{c}") for c in carried))
    placed = docs.withColumns({"__kvern_id": id_, "__kvern_range": _bucket(id_, F.col(key), bounds), "__kvern_lent": F.lit(False)})
    lent = F.broadcast(spark.createDataFrame([(heads[i][0], *heads[i - 1][1:]) for i in range(len(heads))], "__kvern_to int, __kvern_head long, __kvern_key long"))
    borrowed = placed.join(lent, (F.col("__kvern_id") == F.col("__kvern_head")) & (F.col(key) == F.col("__kvern_key")))
    borrowed = borrowed.dropDuplicates(["__kvern_to"]).select(*docs.columns, "__kvern_id", F.col("__kvern_to").alias("__kvern_range"), F.lit(True).alias("__kvern_lent"))
    # Dealt first: what is derived is not shuffled, and the window finds its rows where they are.
    every = derived(placed.unionByName(borrowed).repartition("__kvern_range"))
    w = Window.partitionBy("__kvern_range").orderBy("__kvern_lent", F.desc("__kvern_id"), F.desc(key))
    out = every.select(*(c for c in every.columns if c not in ("__kvern_id", "__kvern_range")), *(F.lead(c).over(w).alias(f"next_{c}") for c in carried))
    return out.where(~F.col("__kvern_lent")).drop("__kvern_lent")


def edited_pairs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", gap: int | None = None, threshold: float = 0.0) -> DataFrame:
    """Each document with its fingerprint, its edited text and the next document's, and how alike they are.

    doc_id, n_chars, edited, signatures, edited_signatures, near_edited, near_next.  The edited text has the last
    third of the code points replaced by the first as many of the next document.  A null text counts as empty.
    With a threshold, sets whose length partitions or lengths rule it out have likeness 0.
    """
    base = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    own = with_next(base, ["text", "signatures"], "doc_id", "key", F.octet_length("text") + 1, lambda df: signatures(df, "text", "signatures", gap))
    third = F.floor(F.length("text") / 3).cast("int")
    edited = own.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("next_text"), F.lit(1), third)))
    slim = edited.select("doc_id", "n_chars", "edited", "signatures", likeness(F.col("signatures"), F.col("next_signatures"), threshold).alias("near_next"))
    return signatures(slim, "edited", "edited_signatures", gap).withColumn("near_edited", likeness(F.col("signatures"), F.col("edited_signatures"), threshold))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text", gap: int | None = None) -> DataFrame:
    """(a, b, likeness) of the classes (least id of the documents with one set of signatures, see `classes`) that reach the threshold.

    Signatures are ordered by rarity over all classes; two sets that reach the threshold share one among the
    first length - ceil(threshold * length) + 1 of each, and their length partitions are the same or
    neighbours: only those are joined.  Documents without a signature are in no pair; a null id counts as the least long.
    """
    sets = signatures(docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(LEAST)).alias("id"), F.col(text_column).alias("text")), "text", "signatures", gap).where(F.size("signatures") > 0)
    classes_ = written(sets.groupBy("signatures").agg(F.min("id").alias("id")).withColumn("n", F.size("signatures")))
    each = classes_.select("id", "n", F.explode("signatures").alias("s"))
    counted = each.groupBy("s").agg(F.count(F.lit(1)).alias("times"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("times", "s"))
    # A signature of one class alone pairs nothing, but has its place in the order.
    first = each.join(counted, "s").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).where("times > 1")
    dealt = written(first.select("s", "id", "n", partition_of(F.col("n"), threshold).alias("part")))
    left = dealt.select("s", F.col("id").alias("a"), F.col("n").alias("na"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    right = dealt.select("s", F.col("id").alias("b"), F.col("n").alias("nb"), "part")
    fits = (F.col("na") <= F.col("nb")) & (F.col("na") >= threshold * F.col("nb") - 1e-9) & ((F.col("na") < F.col("nb")) | (F.col("a") < F.col("b")))
    pairs = written(left.join(right, ["s", "part"]).where(fits).select("a", "b").distinct())
    full = pairs.join(classes_.select(F.col("id").alias("a"), F.col("signatures").alias("sa")), "a").join(classes_.select(F.col("id").alias("b"), F.col("signatures").alias("sb")), "b")
    return full.select("a", "b", likeness(F.col("sa"), F.col("sb"), threshold).alias("likeness")).where(F.col("likeness") >= threshold)


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", gap: int | None = None) -> DataFrame:
    """(doc_id, class_id): the class of each row, which `near_duplicates` pairs; null where a text has no signature.

    A null id counts as the least long, in class_id too, and comes back as null in doc_id.
    """
    sets = signatures(docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(LEAST)).alias("id"), F.col(text_column).alias("text")), "text", "signatures", gap)
    own = written(sets.select("id", F.when(F.size("signatures") > 0, F.md5(F.concat_ws(",", "signatures").cast("binary"))).alias("set")))
    least = own.where("set is not null").groupBy("set").agg(F.min("id").alias("class_id"))
    return own.join(least, "set", "left").select(F.when(F.col("id") != LEAST, F.col("id")).alias("doc_id"), "class_id")
