"""Mixing sources to target weights along a time-varying curriculum.

Each source's weight changes over training time t in [0, 1]. The integral of its weight is the share of its target
that has been demanded by t; inverting that demand gives every document the position at which its first word is
used. Documents are then range-sorted by position. All steps are joins, windows and closed forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Workspace, power_of_two, word_count

#: Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (5, 2, 1)
#: A source is used at most so many times over.
MOST_PASSES = 3
#: Piecewise linear schedules (time, relative weight) that the sources take in turn; each is scaled to its target.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)))
#: Rows that one step of the running sums should hold.
ROWS_PER_STEP = 20_000


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """source, rank, source_size, target. Targets share all words by weight and stop at ``most`` times the source.

    Sources are ranked in one task, a row each: thousands, not millions, of sources are meant. What stops there is shared
    among the rest by weight. With sources in the order of ``most * size / weight`` the
    stopped ones come first, so running sums find them without repeating the sharing step by step.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything, order = W.partitionBy(F.lit(0)), W.partitionBy(F.lit(0))
    sources = sources.withColumn("rank", F.row_number().over(order.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("rank", F.lit(len(weights))) + 1)
    sources = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    earlier = order.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    sources = sources.withColumn("stopped", F.col("cap") * open_weight <= left * F.col("weight"))
    spare = F.sum("source_size").over(everything) - F.sum(F.when(F.col("stopped"), F.col("cap")).otherwise(0.0)).over(everything)
    heavy = F.sum(F.when(F.col("stopped"), 0.0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("stopped"), F.col("cap")).otherwise(F.col("weight") * spare / heavy)
    return sources.withColumn("target", target).select("source", "rank", "source_size", "target")


def _pieces(knots) -> list[tuple[float, float, float, float, float]]:
    """Start, end, weight at the start, slope and demand before each piece; demand is 1 at the end."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append((t0, t1, w0 / area, (w1 - w0) / (t1 - t0) / area, done))
        done += (t1 - t0) * (w0 + w1) / 2 / area
    return out


def position(demand: Column, rank: Column, schedules=SCHEDULES) -> Column:
    """Time at which a source of ``rank`` has been asked for the share ``demand`` (0 to 1) of its target."""

    def inverse(knots) -> Column:
        out = None
        for t0, t1, w, slope, before in reversed(_pieces(knots)):
            rest = demand - F.lit(before)
            # The root of slope/2 x^2 + w x = rest that also holds for a slope of 0.
            root = 2 * rest / (F.lit(w) + F.sqrt(F.greatest(F.lit(0.0), F.lit(w * w) + 2 * slope * rest)))
            at = F.least(F.lit(t1), F.lit(t0) + F.when(rest > 0, root).otherwise(0.0))
            out = at if out is None else F.when(demand < F.lit(_after), at).otherwise(out)
            _after = before
        return out

    turn, out = F.pmod(rank, F.lit(len(schedules))), None
    for i, knots in enumerate(schedules):
        out = F.when(turn == i, inverse(knots)) if out is None else out.when(turn == i, inverse(knots))
    return out


def _placed(docs: DataFrame, space: Workspace, carried: list[str], weights, most: int, seed: str) -> DataFrame:
    """Rows of ``docs`` (doc_id, source, text and the ``carried`` columns) with size, source_size, target, rank, start, taken."""
    mark = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    sized = space.save(docs.select("doc_id", "source", *carried, word_count(F.col("text")).alias("size"), mark.alias("mark"), F.xxhash64("text").alias("print")), "sized")
    steps = min(1 << 20, power_of_two(sized.count() / ROWS_PER_STEP, 256))
    # Rows without a doc_id share a mark; their texts deal them among the steps.
    at = F.when(F.col("doc_id").isNull(), F.pmod("print", F.lit(1 << 20))).otherwise(F.conv(F.substring("mark", 1, 5), 16, 10).cast("long"))
    sized = sized.withColumn("step", F.floor(at / F.lit((1 << 20) // steps)).cast("long"))

    # Running sums in two levels, so that a source with most of the rows is spread over its steps.
    totals = sized.groupBy("source", "step").agg(F.sum("size").alias("step_size"))
    targets = source_targets(totals.withColumnRenamed("step_size", "size"), weights, most).withColumnRenamed("source", "_source")
    before = F.sum("step_size").over(W.partitionBy("source").orderBy("step")) - F.col("step_size")
    totals = totals.withColumn("before", before).join(targets, F.col("source").eqNullSafe(F.col("_source")))
    totals = space.save(totals.select(F.col("source").alias("_source"), F.col("step").alias("_step"), "before", "rank", "source_size", "target"), "totals")
    inside = W.partitionBy("source", "step").orderBy("mark", "doc_id", "size", "print").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = sized.withColumn("within", F.sum("size").over(inside) - F.col("size")).join(totals, F.col("source").eqNullSafe(F.col("_source")) & (F.col("step") == F.col("_step")))

    wanted = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
    start = (F.col("before") + F.col("within")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), wanted - F.col("passes") * F.col("source_size") - F.col("start")))
    return placed.withColumn("passes", passes).withColumn("start", start).withColumn("taken", (F.col("passes") * F.col("size") + part).cast("long"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_PASSES, schedules=SCHEDULES, seed: str = "mix") -> DataFrame:
    """How many words of each document the mix takes, and from which position of the training order.

    One row per row of ``docs``: doc_id, source, size (words), source_size, target, taken, position. Within a source
    documents stand in the order of a hash of doc_id. Whole passes over a source come first; the words still missing
    are taken from its first documents, the last of them in part, so a source's taken words are its target rounded
    down. ``position`` is null where nothing is taken. Null and blank texts have size 0; a null source is a source;
    repeated rows count each; rows with a null doc_id stand in the order of their texts; other columns are not read.
    """
    placed = _placed(docs, Workspace(docs.sparkSession, "mixing"), [], weights, most, seed)
    demand = F.when((F.col("taken") > 0) & (F.col("target") > 0), F.least(F.lit(1.0), F.col("start") / F.col("target")))
    return placed.withColumn("demand", demand).select(
        "doc_id", "source", "size", "source_size", "target", "taken", F.when(F.col("demand").isNotNull(), F.round(position(F.col("demand"), F.col("rank"), schedules), 9)).alias("position"), "rank", "start"
    )


def training_order(docs: DataFrame, weights=WEIGHTS, most: int = MOST_PASSES, schedules=SCHEDULES, seed: str = "mix") -> DataFrame:
    """The mix itself: each row once for every pass that takes it, range-sorted by position.

    Copies are whole documents: the one that a source takes in part is given whole, so a source may exceed its
    target by less than one document. Every row has copies of its own, rows that repeat a doc_id or have none
    included; rows without words have none. Columns are those of ``docs``. Written to files, the rows stand in training
    order by file number and row; ``in_order`` reads that order back.
    """
    space = Workspace(docs.sparkSession, "training-order")
    held = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "source", "text")
    placed = _placed(held, space, ["_doc"], weights, most, seed).filter("taken > 0 and size > 0")
    placed = space.save(placed.select("_doc", "doc_id", "start", "taken", "size", "source_size", "target", "rank"), "placed")
    space.drop("sized", "totals")
    copies = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.expr("cast((taken + size - 1) div size as int)") - 1)))
    demand = F.least(F.lit(1.0), (F.col("start") + F.col("pass") * F.col("source_size")) / F.col("target"))
    return copies.withColumn("at", position(demand, F.col("rank"), schedules)).orderBy("at", "doc_id", "start", "pass").select("_doc.*")


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``place`` (from 0, gapless) of ``docs``, read from the files that ``training_order`` was written to.

    Files are numbered in training order and rows stand in it, so a row's place is the rows of the files before, counted
    from the files' metadata alone, and its own number in its file. Other columns, whatever their names, are not read.
    """
    file = docs.metadataColumn("_metadata")
    rows = docs.select("doc_id", "text", F.regexp_extract(file["file_name"], r"^part-(\d+)", 1).cast("long").alias("part"), file["row_index"].alias("row"))
    counts = rows.groupBy("part").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("rows")
    starts = counts.select("part", before.alias("before"))  # a row for each file
    return rows.join(starts, "part").select("doc_id", "text", (F.col("before") + F.col("row")).alias("place"))
