"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Every window of 10 consecutive item words (a shorter item is one window) is the set of its shingles.  Documents are
cut once: of their shingles, those that any window has are kept, with their places.  A document contains a
window only if it has every one of its shingles, so one necessary token is enough to find it: the window's rarest
shingle, as counted over all documents.  The kept shingles are joined with these prefix tokens; what meets must
leave room for the whole window on both sides (positional and length bound) and then agree with it word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvern.llm.util import written

WINDOW, SHINGLE = 10, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Shingles of windows (longs, about 30 bytes each), and windows (about 300 bytes), that are broadcast at most; more are joined by a shuffle.
BROADCAST_SHINGLES, BROADCAST_WINDOWS = 2_000_000, 100_000
#: Documents' keys that are broadcast at most.
BROADCAST_DOCUMENTS = 500_000


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, other letters as they are; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _shingle(words_: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *(F.get(words_, at + j) for j in range(n)))


def windows_of(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(window, size, words, items): the different windows of all items, `window` the MD5 of its words, `items` those that have it."""
    items = benchmark.select(F.col(id_column).cast("string").alias("item_id"), words(F.col(text_column)).alias("all")).where(F.size("all") > 0)
    last = F.greatest(F.size("all") - WINDOW, F.lit(0))
    cut = items.withColumn("at", F.explode(F.sequence(F.lit(0), last))).select("item_id", F.slice("all", F.col("at") + 1, F.lit(WINDOW)).alias("words"))
    named = cut.select(F.md5(F.concat_ws(" ", "words").cast("binary")).alias("window"), "words", "item_id")
    return named.groupBy("window").agg(F.size(F.first("words")).alias("size"), F.first("words").alias("words"), F.collect_set("item_id").alias("items"))


def _scanned(docs: DataFrame, own: DataFrame, lengths: list[int]) -> DataFrame:
    """A row for each document, with n_words and a null h, and one for each of its shingles (pos, h) that a window has.

    docs: doc_id, text_key, text; own: the windows' shingles h, of `lengths` words.  Words stay where they are cut: with
    more shingles than are broadcast, only keys, places and hashes are shuffled.
    """
    keys = own.select("h").distinct().withColumn("met", F.lit(True))
    texts = docs.select("doc_id", "text_key", words(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    # The place after the last word stands for the document.
    placed = texts.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n_words"))))
    whole, room = F.col("pos") == F.col("n_words"), F.col("n_words") - F.col("pos")
    each = [F.when(room >= n, F.xxhash64(F.lit(n), *(F.get("words", F.col("pos") + j) for j in range(n)))) for n in lengths]
    if len(each) > 1:
        placed = placed.select("*", F.posexplode(F.array(*each)).alias("length", "h")).where(F.col("h").isNotNull() | (whole & (F.col("length") == 0)))
    else:
        placed = placed.withColumn("h", each[0] if each else F.lit(None).cast("long")).where(F.col("h").isNotNull() | whole)
    # All of this is one generated loop, which drops the words as soon as they are hashed: no row has a copy of them.
    placed = placed.select("doc_id", "text_key", "n_words", "pos", "h")
    if keys.count() <= BROADCAST_SHINGLES:
        return written(placed.join(F.broadcast(keys), "h", "left").where(F.col("met") | (F.col("pos") == F.col("n_words"))).select(placed.columns))
    met = placed.where("h is not null").join(keys, "h").select(placed.columns)
    return written(met.unionByName(placed.where("h is null")))


def occurrences(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is told of each document (doc_id, text_key, n_words), and where windows occur: (doc_id, text_key, start, end, items).

    docs: doc_id, text_key, text.  Repeated rows are one document in the second table.
    """
    some = windows.withColumn("n", F.least("size", F.lit(SHINGLE)))
    lengths = sorted(r[0] for r in some.select("n").distinct().collect())  # SHINGLE values at most
    at = some.withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("n"))))
    h = F.coalesce(*(F.when(F.col("n") == n, F.xxhash64(F.lit(n), *(F.get("words", F.col("offset") + j) for j in range(n)))) for n in lengths), F.lit(None).cast("long"))
    own = written(at.select("window", "size", "n", "offset", h.alias("h")))
    scanned = _scanned(docs, own, lengths)
    documents, met = scanned.where("h is null").select("doc_id", "text_key", "n_words"), scanned.where("h is not null").distinct()
    counted = met.groupBy("h").agg(F.count(F.lit(1)).alias("times"))
    # Every shingle of a window must occur somewhere; the rarest is its prefix.
    rarest = own.join(counted, "h").groupBy("window").agg(F.min(F.struct("times", "h", "offset")).alias("rarest"), F.count(F.lit(1)).alias("met"), F.first("size").alias("size"), F.first("n").alias("n"))
    prefix = rarest.where("met = size - n + 1").select("window", F.col("rarest.h").alias("h"), F.col("rarest.offset").alias("offset"))
    prefix = written(prefix.join(windows.select("window", "size", F.col("words").alias("item_words"), "items"), "window"))
    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    small = F.broadcast(prefix) if prefix.count() <= BROADCAST_WINDOWS else prefix
    left = written(met.join(small, "h").where(fits).select("doc_id", "text_key", start.alias("start"), "size", "item_words", "items"))
    # Words again, of those documents alone that have something to compare.
    asked = written(left.select(F.col("doc_id").alias("asked_id"), F.col("text_key").alias("asked_key")).distinct())
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_DOCUMENTS else asked
    texts = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("asked_id")) & (F.col("text_key") == F.col("asked_key")), "left_semi").dropDuplicates(["doc_id", "text_key"])
    texts = texts.select("doc_id", "text_key", words(F.col("text")).alias("words")).alias("t")
    same = F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("t.text_key") == F.col("c.text_key"))
    equal = F.slice("words", F.col("start") + 1, F.col("size")) == F.col("item_words")
    hits = left.alias("c").join(texts, same).where(equal)
    return documents, hits.select("c.doc_id", "c.text_key", "start", (F.col("start") + F.col("size")).alias("end"), "items")


def keyed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text, and text_key: rows with the same id and text have the same result."""
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("text_key"))


def _covered() -> Column:
    """Words in a union of intervals, from the set of (start, end)."""
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("reach"))

    def add(seen: Column, x: Column) -> Column:
        more = F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], seen["reach"]))
        return F.struct((seen["hit"] + more).alias("hit"), F.greatest(seen["reach"], x["end"]).alias("reach"))

    return F.aggregate(F.array_sort("spans"), zero, add, lambda seen: seen["hit"]).cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, spans (of words, start to before end), items, contaminated.

    A null or empty text has no words and no hit.  Repeated rows each have a row.  A benchmark row with a null
    id marks words as hit but is no item; an empty or null item has no window.  Other columns are not read.
    """
    documents, hits = occurrences(keyed(docs, id_column, text_column), written(windows_of(benchmark)))
    # A document's spans and items are bounded by its own length and by the benchmark.
    found = hits.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    found = found.select("doc_id", "text_key", F.array_sort("spans").alias("spans"), F.array_sort("items").alias("items"), _covered().alias("n_hit")).alias("f")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_key") == F.col("f.text_key"))
    out = documents.alias("d").join(found, same, "left")
    none = F.array().cast("array<string>")
    return out.select("d.doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), "spans", F.coalesce("items", none).alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs, all columns, in which no window occurs."""
    _, hits = occurrences(keyed(docs, id_column, text_column), written(windows_of(benchmark)))
    hits = written(hits.select(F.col("doc_id").alias("__kvern_doc_id"), F.col("text_key").alias("__kvern_text_key")).distinct())
    same = F.col(id_column).eqNullSafe(F.col("__kvern_doc_id")) & (F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))) == F.col("__kvern_text_key"))
    return docs.join(F.broadcast(hits) if hits.count() <= BROADCAST_DOCUMENTS else hits, same, "left_anti")
