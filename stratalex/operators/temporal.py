"""Half-open validity intervals [from, to), point-in-time queries and relation expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def valid_on(day: Column, start: str = "effective_from", end: str = "effective_to") -> Column:
    """start <= day < end; a null end is open, a null start is never valid."""
    return (F.col(start) <= day) & (F.col(end).isNull() | (day < F.col(end)))


def valid_versions(provisions: DataFrame, day: Column) -> DataFrame:
    return provisions.filter((F.col("review_status") == "ACCEPTED") & valid_on(day))


def as_of(points: DataFrame, provisions: DataFrame, key: str, day: str) -> DataFrame:
    """The ACCEPTED version valid on each point's own day, by equality on ``key``: union, then the last version seen.

    Versions of a key do not overlap, so one sort by (key, day) answers all points; no range join is planned.
    """
    v = provisions.filter("review_status = 'ACCEPTED'").select(F.col(key), F.col("effective_from").alias("_day"), F.lit(0).alias("_turn"), F.struct("version", "effective_from", "effective_to").alias("_v"), F.lit(None).cast(points.schema["point_id"].dataType).alias("point_id"))
    p = points.select(F.col(key), F.col(day).alias("_day"), F.lit(1).alias("_turn"), F.lit(None).cast(v.schema["_v"].dataType).alias("_v"), "point_id")
    order = W.partitionBy(key).orderBy("_day", "_turn", F.col("_v.version")).rowsBetween(W.unboundedPreceding, W.currentRow)
    met = v.unionByName(p).withColumn("_v", F.last("_v", ignorenulls=True).over(order)).filter("_turn = 1")
    valid = F.col("_v.effective_to").isNull() | (F.col("_day") < F.col("_v.effective_to"))
    return met.select("point_id", key, F.col("_day").alias(day), F.when(valid, F.col("_v.version")).alias("version"))


def overlaps(provisions: DataFrame, key: str = "provision_id") -> DataFrame:
    """ACCEPTED rows that begin before an earlier row of their key has ended."""
    order = W.partitionBy(key).orderBy("effective_from", "version").rowsBetween(W.unboundedPreceding, -1)
    far = F.to_date(F.lit("9999-12-31"))
    reach = F.max(F.coalesce("effective_to", far)).over(order)
    return provisions.filter("review_status = 'ACCEPTED' and effective_from is not null").withColumn("_reach", reach).filter(F.col("effective_from") < F.col("_reach")).drop("_reach")


def superseded(events: DataFrame, key: str = "provision_id") -> DataFrame:
    """Intervals from dated versions: each ends where the next begins."""
    order = W.partitionBy(key).orderBy("effective_from", "version")
    return events.withColumn("effective_to", F.lead("effective_from").over(order)).withColumn("superseded_by_version", F.lead("version").over(order))


def next_version(provisions: DataFrame, key: str = "provision_id") -> DataFrame:
    return provisions.groupBy(key).agg(F.coalesce(F.max("version") + 1, F.lit(1)).alias("next_version"))


def latest(rows: DataFrame, key: str, *newest_first: str) -> DataFrame:
    """The newest row of each key, by the columns given, largest first."""
    place = F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(c) for c in newest_first]))
    return rows.withColumn("_n", place).filter("_n = 1").drop("_n")


def related(seeds: DataFrame, edges: DataFrame, provisions: DataFrame, day: Column, directions=("outbound", "inbound")) -> DataFrame:
    """Neighbours of ``seeds`` (row_id) over accepted, resolved edges whose other end is valid on ``day``.

    Both directions are kept, so an edge stored both ways gives two rows: seed, other, relation_type, direction.
    """
    good = edges.filter("review_status = 'ACCEPTED' and resolution_status = 'RESOLVED'").select("source_row", "target_row", "relation_type")
    ends = valid_versions(provisions, day).select(F.col("row_id").alias("other"))
    out = None
    for name, here, there in (("outbound", "source_row", "target_row"), ("inbound", "target_row", "source_row")):
        if name in directions:
            step = good.select(F.col(here).alias("seed"), F.col(there).alias("other"), "relation_type", F.lit(name).alias("direction"))
            step = step.join(seeds.select(F.col("row_id").alias("seed")), "seed", "left_semi").join(ends, "other", "left_semi").select("seed", "other", "relation_type", "direction")
            out = step if out is None else out.unionByName(step)
    return out


def expand(seeds: DataFrame, edges: DataFrame, provisions: DataFrame, day: Column, breadth: int = 5, most: int = 10) -> DataFrame:
    """Two rounds of ``related``: at most ``breadth`` neighbours of a row and ``most`` rows added for a seed."""
    step = related(seeds, edges, provisions, day).withColumn("_n", F.row_number().over(W.partitionBy("seed").orderBy("relation_type", "direction", "other"))).filter(F.col("_n") <= breadth)
    first = step.select(F.col("seed").alias("origin"), F.col("other").alias("row_id"), F.lit(1).alias("depth"))
    hop = related(first.select("row_id").distinct(), edges, provisions, day).withColumn("_n", F.row_number().over(W.partitionBy("seed").orderBy("relation_type", "direction", "other"))).filter(F.col("_n") <= breadth)
    second = first.join(hop, F.col("row_id") == F.col("seed")).select("origin", F.col("other").alias("row_id"), F.lit(2).alias("depth"))
    every = first.unionByName(second).filter("origin != row_id").groupBy("origin", "row_id").agg(F.min("depth").alias("depth"))
    place = F.row_number().over(W.partitionBy("origin").orderBy("depth", "row_id"))
    return every.withColumn("place", place).filter(F.col("place") <= most)
