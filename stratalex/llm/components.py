"""Connected components of a distributed edge table, by alternating stars (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Edges up to which one task joins what is left: rounds over a small table cost as many jobs as over a large one.
FEW = 1 << 18


def top_of(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where each of ``x`` ends when it goes from ``parent`` to ``parent``."""
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = up


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, a, b: every node ``a`` of the edges beside the least node ``b`` that they connect it to, without that node itself."""
    held = list(batches)
    part, a, b = (np.concatenate([x.column(k).to_numpy(zero_copy_only=False) for x in held]) if held else np.zeros(0, "int64") for k in range(3))
    for p in np.unique(part):
        ids, at = np.unique(np.concatenate([a[part == p], b[part == p]]), return_inverse=True)
        one, two = at[: len(at) // 2], at[len(at) // 2 :]
        top = np.arange(len(ids))
        while (top[one] != top[two]).any():
            # The greater of two roots hangs on the least that an edge joins it to.
            np.minimum.at(top, np.maximum(top[one], top[two]), np.minimum(top[one], top[two]))
            top = top_of(top, top)
        some = np.flatnonzero(top != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), p, "int32")), pa.array(ids[some]), pa.array(ids[top[some]])], names=["part", "a", "b"])


def _star(edges: DataFrame, small: bool, space: Workspace, name: str) -> DataFrame:
    """Join neighbours to the least of them: larger ones (large star), or the smaller ones and the node itself."""
    ends = edges.select("part", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if not small:
        # Both directions of an edge, made in one pass over the table.
        ways = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = ends.select("part", F.inline(ways))
    least = ends.groupBy("part", "a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    # A table of its own, so that the join has two plain shuffles and the edges of a hub can be split among tasks.
    joined = ends.join(space.save(least, f"{name}_least").hint("merge"), ["part", "a"])
    if small:
        pairs = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))
        return joined.select("part", F.inline(pairs)).filter("a != b")
    return joined.filter("b > a").select("part", F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")


def _all_stars(edges: DataFrame) -> bool:
    """No node hangs on two others, and none that others hang on hangs on one itself."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("bears")), F.struct(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("bears")))
    per = edges.select("part", F.inline(ends)).groupBy("part", "node").agg(F.sum("hangs").alias("hangs"), F.max("bears").alias("bears"))
    return per.filter("hangs > 1 or (hangs = 1 and bears = 1)").isEmpty()


def components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """part, node, root of every node with an edge: root is the least node that edges (part, a, b) connect it to.

    Parts are separate graphs. Each round is two joins by node; rounds grow with the logarithm of the size. The
    number of edges never grows. The least neighbours of all nodes are a table before they are joined, so the edges
    of a hub are split like any skewed key. When ``FEW`` edges or fewer are left, one task ends it.
    """
    now = space.save(edges.filter("a != b").select("part", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    turn = 0
    while True:
        if now.count() <= FEW:
            now = space.save(now.select(F.col("part").cast("int").alias("part"), "a", "b").coalesce(1).mapInArrow(_joined, "part int, a bigint, b bigint"), f"{name}_ends")
            break
        if _all_stars(now):
            break
        turn += 1
        large = space.save(_star(now, False, space, f"{name}{turn}a").distinct(), f"{name}{turn}a")
        now = space.save(_star(large, True, space, f"{name}{turn}b").distinct(), f"{name}{turn}")
        for done in (f"{name}{turn - 1}", f"{name}{turn}a", f"{name}{turn}a_least", f"{name}{turn}b_least"):
            space.drop(done)
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root")))
    return now.select("part", F.inline(ends)).distinct()
