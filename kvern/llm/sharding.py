"""Shards of near-equal bytes by sampled splitters.

Records are ordered by a hash of their text, then by id.  Keys are drawn with a chance in proportion to
their size, and quantiles of the draw bound many small ranges (far more than shards).  A range that
turns out overfull is subdivided by a draw of its own, also between the ids of one text's copies.  The exact
rows and bytes of all ranges then give each record its place among all, and place the cuts between shards exactly, between
repeated rows too: the draw decides how work is dealt, never what a shard holds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvern.llm.util import bisected, written

LEAST = -(1 << 63)
#: Ranges for each shard at least; bytes of a range, about, as long as there are no more than RANGES_MOST of them (their sums reach the driver).
RANGES, RANGE_BYTES, RANGES_MOST = 32, 128 << 20, 1 << 16
#: Keys drawn for each range.
DRAWS = 32
#: A range with more than so many times its share is subdivided, in so many rounds at most.
OVERFULL, ROUNDS = 2, 4


def size_of(text: Column) -> Column:
    """UTF-8 bytes plus 1; a null text has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def order_key(text: Column) -> Column:
    """60 bits of the text's MD5; a null text counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _drawn(keys: DataFrame, part: Column) -> pd.DataFrame:
    """The keys that a draw takes: each with a chance of size / part, and the weight that it stands for."""
    luck = F.pmod(F.xxhash64("h", "id", F.lit("draw")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return keys.where(luck * part < F.col("size")).select("h", "id", F.greatest(F.col("size").cast("double"), part).alias("weight")).toPandas().sort_values(["h", "id"])


def _quantiles(drawn: pd.DataFrame, pieces: int) -> pd.DataFrame:
    """The keys at which the pieces after the first begin."""
    cum = drawn["weight"].cumsum().to_numpy()
    at = np.searchsorted(cum, cum[-1] * np.arange(1, pieces) / pieces) if len(cum) else []
    return drawn.iloc[np.unique(np.minimum(at, len(cum) - 1))][["h", "id"]] if len(cum) else drawn[["h", "id"]]


def _range_of(splitters: pd.DataFrame):
    """The number of splitters that are not after a key."""
    heads, ids = splitters["h"].to_numpy(np.int64), splitters["id"].to_numpy(np.int64)

    @F.pandas_udf("int")
    def place(h: pd.Series, id_: pd.Series) -> pd.Series:
        h, id_ = h.to_numpy(np.int64), id_.to_numpy(np.int64)
        low, high = np.searchsorted(heads, h, "left"), np.searchsorted(heads, h, "right")
        for head in np.unique(h[low < high]):
            own = np.flatnonzero(h == head)
            low[own] += np.searchsorted(ids[low[own[0]] : high[own[0]]], id_[own], "right")
        return pd.Series(low.astype(np.int32))

    return place


def _splitters(keys: DataFrame, total: int, ranges: int) -> pd.DataFrame:
    share = total / ranges
    drawn = _drawn(keys, F.lit(max(1.0, share / DRAWS)))
    found = _quantiles(drawn, ranges).assign(id=LEAST).drop_duplicates()
    for _ in range(ROUNDS):
        placed = keys.withColumn("range", _range_of(found)("h", "id"))
        sizes = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.min(F.struct("h", "id")).alias("lo"), F.max(F.struct("h", "id")).alias("hi"))
        over = sizes.where((F.col("bytes") > OVERFULL * share) & (F.col("lo") < F.col("hi"))).select("range", "bytes").toPandas()
        if not len(over):
            break
        own = placed.where(F.col("range").isin(over["range"].tolist()))
        again = _drawn(own, F.lit(max(1.0, share / DRAWS / 4)))
        again["range"] = _place(found, again)
        added = [_quantiles(again[again["range"] == r], int(np.ceil(b / share))) for r, b in zip(over["range"], over["bytes"], strict=True)]
        more = pd.concat([found, *added]).drop_duplicates().sort_values(["h", "id"])
        if len(more) == len(found):
            break
        found = more
    return found


def _place(splitters: pd.DataFrame, keys: pd.DataFrame) -> np.ndarray:
    return _range_of(splitters).func(keys["h"], keys["id"]).to_numpy()


def _cuts(keys: DataFrame, sums: pd.DataFrame, total: int, shards: int, whole: float) -> list[int]:
    """The place, among all records, of the first one of each shard after the first: where the middle of a record passes k / shards of all bytes.

    A group of equal texts that a cut would divide stays together on the side that it leans to, if it has no more than `whole` of a shard.
    """
    before = keys.sparkSession.createDataFrame(sums[["range", "before", "first"]].astype("int64"), "range int, before long, first long")
    w = Window.partitionBy("range").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    placed = keys.withColumns({"run": F.sum("size").over(w), "rank": F.count(F.lit(1)).over(w)}).join(F.broadcast(before), "range")
    placed = placed.select("h", "size", (F.col("run") - F.col("size") + F.col("before")).alias("at"), (F.col("rank") - 1 + F.col("first")).alias("place"))
    shard = F.expr(f"((2 * at + size) * {shards}) div {2 * total}").cast("int")
    # A row for each shard.
    first = placed.groupBy(shard.alias("shard")).agg(F.min(F.struct("place", "h")).alias("x")).orderBy("shard").collect()
    found = {r["shard"]: (r["x"]["place"], r["x"]["h"]) for r in first}
    heads = [h for _, h in found.values()]
    groups = {r["h"]: r for r in placed.where(F.col("h").isin(heads)).groupBy("h").agg(F.min("at").alias("lo"), F.sum("size").alias("bytes"), F.min("place").alias("place"), F.count(F.lit(1)).alias("n")).collect()}
    end = int((sums["first"] + sums["n"]).max())
    cuts: list[int] = []
    for k in range(1, shards):
        place, h = next((found[s] for s in range(k, shards) if s in found), (end, None))
        if h in groups and (g := groups[h])["bytes"] <= whole * total / shards:
            place = g["place"] if 2 * g["lo"] + g["bytes"] >= 2 * k * total // shards else g["place"] + g["n"]
        cuts.append(max(place, cuts[-1]) if cuts else place)
    return cuts


def shard_documents(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text", whole: float = 0.01) -> DataFrame:
    """All rows and columns of docs, with `shard` (0 to shards - 1) and `slot` (0, 1, ... within the shard).

    Shards have near-equal bytes, a record counting its UTF-8 bytes plus 1.  A null text counts as empty, a
    null id as the least one.  Copies of a text are neighbours; a group of copies that has no more than `whole` of a shard's
    bytes is in one shard, and by no more than that do shards differ.  With whole=0 every cut falls
    where it divides the bytes best.  Rows with the same id and text are interchangeable; they are dealt to one
    range, and may be in several shards.  Slots follow (hash of the text, id).  An empty table gives no row.  Columns of docs
    named shard, slot are replaced.
    """
    if shards < 1:
        raise ValueError("shards: 1 at least")
    if not 0 <= whole <= 1:
        raise ValueError("whole: 0 to 1")
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    id_, text = F.coalesce(F.col(id_column).cast("long"), F.lit(LEAST)), F.col(text_column)
    keys = written(docs.select(order_key(text).alias("h"), id_.alias("id"), size_of(text).alias("size")))
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return docs.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = max(RANGES * shards, min(-(-total // RANGE_BYTES), RANGES_MOST))
    place = _range_of(_splitters(keys, total, ranges))
    ranged = keys.withColumn("range", place("h", "id"))
    # A row for each range: bounded by RANGES_MOST and the overfull ranges' pieces, which are no more.
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("range")
    sums["before"], sums["first"] = sums["bytes"].cumsum() - sums["bytes"], sums["n"].cumsum() - sums["n"]
    starts = [0, *_cuts(ranged, sums, total, shards, whole)]
    offsets = spark.createDataFrame(sums[["range", "first"]].astype("int64"), "__kvern_range int, __kvern_first long")
    keyed = docs.withColumn("__kvern_h", order_key(text)).withColumn("__kvern_id", id_).withColumn("__kvern_range", place("__kvern_h", "__kvern_id"))
    rank = F.row_number().over(Window.partitionBy("__kvern_range").orderBy("__kvern_h", "__kvern_id"))
    numbered = keyed.withColumn("__kvern_rank", rank.cast("long")).join(F.broadcast(offsets), "__kvern_range")
    numbered = numbered.withColumn("__kvern_place", F.col("__kvern_first") + F.col("__kvern_rank") - 1)
    numbered = numbered.withColumn("shard", bisected(F.col("__kvern_place"), starts) - 1)
    return numbered.select(*docs.columns, "shard", (F.col("__kvern_place") - F.get(F.lit(starts).cast("array<bigint>"), F.col("shard"))).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """The shards as Parquet, a folder each, rows in slot order within a file; a shard is written by as many tasks as it needs."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
