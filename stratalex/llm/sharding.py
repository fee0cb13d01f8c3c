"""Sharding by sampled splitters: size-weighted samples give the range bounds, measured ranges give the shards."""

from __future__ import annotations

from bisect import bisect_right
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Workspace

#: Most ranges at first, hence bounds that a task receives: 16 bytes each, one to three megabytes in all. At 100 TB a range
#: is some 800,000 rows of 40 bytes, which a task sorts with room to spare.
MOST_RANGES = 65_536
#: Sampled keys behind each bound.
SAMPLES_PER_RANGE = 8


def _sample(keys: DataFrame, rate: float, seed: int) -> list[tuple[int, int]]:
    """Keys drawn with a chance in proportion to their size; a row larger than 1 / rate is always drawn."""
    draw = F.pmod(F.xxhash64(F.col("key"), F.col("id"), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return [(r[0], r[1]) for r in keys.filter(draw < F.col("size") * F.lit(rate)).select("key", "id").collect()]


def _bounds(drawn: list[tuple[int, int]], ranges: int) -> list[tuple[int, int]]:
    drawn = sorted(drawn)
    return sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []


def _in_range(keys: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """Add ``part``: how many bounds are at or below (key, id)."""
    first, second = np.array([b[0] for b in bounds], "int64"), np.array([b[1] for b in bounds], "int64")

    @F.pandas_udf("int")
    def part(key: pd.Series, ident: pd.Series) -> pd.Series:
        k, i = key.to_numpy("int64"), ident.to_numpy("int64")
        low, high = np.searchsorted(first, k, "left"), np.searchsorted(first, k, "right")
        out = low.copy()
        for at in np.unique(low[high > low]):
            rows = (low == at) & (high > low)
            out[rows] = at + np.searchsorted(second[at : high[rows][0]], i[rows], "right")
        return pd.Series(out.astype("int32"))

    return keys.withColumn("part", part("key", "id"))


def splitters(keys: DataFrame, rows: int, total: int, ranges: int | None = None) -> list[tuple[int, int]]:
    """Bounds of ranges of near equal size.

    Ranges found over twice their share are sampled anew, each by itself, and subdivided until none is left. A row that
    is over its share by itself is no reason to subdivide. The bounds stay under some multiple of ``ranges``, as every
    piece cut off is about one share.
    """
    ranges = ranges or min(MOST_RANGES, max(384, rows // 500))
    share = max(1.0, total / ranges)
    bounds = _bounds(_sample(keys, SAMPLES_PER_RANGE / share, 0), ranges)
    for again in count(1):
        over = [r["part"] for r in overfull(keys, bounds, share).select("part").collect()]
        if not over:
            break
        some = F.broadcast(keys.sparkSession.createDataFrame([(x,) for x in over], "part int"))  # at most half as many as ranges
        more = _sample(_in_range(keys, bounds).join(some, "part", "left_semi"), 2 * SAMPLES_PER_RANGE / share, again)
        own: dict[int, list] = {}
        for key in more:
            own.setdefault(bisect_right(bounds, key), []).append(key)
        cut = {b for drawn in own.values() for b in _bounds(drawn, max(2, len(drawn) // SAMPLES_PER_RANGE + 1))}
        if cut <= set(bounds):
            break
        bounds = sorted({*bounds, *cut})
    return bounds


def overfull(keys: DataFrame, bounds: list[tuple[int, int]], share: float) -> DataFrame:
    """part of the ranges over twice ``share`` that are over it even without their largest row."""
    measured = _in_range(keys, bounds).groupBy("part").agg(F.sum("size").alias("size"), F.max("size").alias("most"))
    return measured.filter((F.col("size") > 2 * share) & (F.col("size") - F.col("most") > share))


def shard_by_bytes(docs: DataFrame, shards: int = 24, whole_group: float = 0.02) -> DataFrame:
    """Put every row of ``docs`` into one of ``shards`` shards of near equal bytes.

    Size is the text's UTF-8 bytes plus 8; a null text has none. Rows are ordered by (hash of text, doc_id), so
    equal texts lie together: such a group goes to one shard as a whole, unless it is over ``whole_group`` of a
    shard; then it is cut between rows. Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    A null doc_id sorts first in its group; repeated rows get slots of their own; other columns are not read.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = space.save(
        docs.select(
            "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
            F.xxhash64(text).alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
        ),
        "keys",
    )
    rows, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranged = space.save(_in_range(keys, splitters(keys, rows, total)), "ranged")

    # Prefix sums in two steps: totals before each range, then a running sum inside it.
    order = W.partitionBy("part").orderBy("key", "id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"))
    before = totals.withColumn("before", F.sum("bytes").over(W.orderBy("part")) - F.col("bytes")).select("part", "before")
    placed = ranged.withColumn("upto", F.sum("size").over(order)).join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("upto") - F.col("size"))
    placed = space.save(placed.drop("upto", "before"), "placed")

    # A group is one text, told by 64 bits, its CRC and its size; a large one is cut between its rows, the others go where their middle falls.
    share = max(1.0, total / shards)
    groups = placed.groupBy("key", "text_crc32", "size").agg(F.min("start").alias("first"), F.sum("size").alias("group_bytes"), F.count("*").alias("copies")).filter("copies > 1")
    groups = space.save(groups, "groups")  # a table, so that the join below has two plain shuffles and large groups can be split
    middle = F.when(F.col("group_bytes") <= whole_group * share, F.col("first") + F.col("group_bytes") / 2).otherwise(F.col("start") + F.col("size") / 2)
    at = F.least(F.lit(shards - 1), F.floor(middle / F.lit(share))).cast("int")
    sharded = space.save(
        placed.join(groups, ["key", "text_crc32", "size"], "left").withColumn("first", F.coalesce("first", "start")).withColumn("group_bytes", F.coalesce("group_bytes", "size"))
        .withColumn("shard", at).select("doc_id", "size", "text_crc32", "key", "id", "part", "shard"),
        "sharded",
    )
    counts = sharded.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    earlier = counts.withColumn("earlier", F.sum("rows").over(W.partitionBy("shard").orderBy("part")) - F.col("rows")).drop("rows")
    slot = F.row_number().over(W.partitionBy("part", "shard").orderBy("key", "id", "size", "text_crc32"))
    return (
        sharded.withColumn("slot", slot).join(F.broadcast(earlier), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("earlier") + F.col("slot") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
