"""Approximate dense search: inverted lists around centroids, every vector indexed, candidates scored exactly.

Centroids are fitted on a bounded sample; each vector goes to its nearest centroid's list and each query to the lists of its
nearest centroids. Lists meet their queries in blocks of bounded size, however long a list is and however many
queries ask for it. Only centroids reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.sources.stored import stored

from .search import best_of, dense_top_k, unit_rows
from .sparse import ranked

#: Vectors that centroids are fitted on, lists, and vectors that the number of probes is tuned on.
SAMPLE, MOST_LISTS, TUNED_ON = 50_000, 4096, 256
#: Recall that the probes are tuned to; a margin above the 0.9 that is promised.
RECALL = 0.95
#: Vectors and queries that meet in one task.
ROWS, QUERIES = 20_000, 4096


class DenseIndex:
    """Lists over ``vectors`` (unit_id, embedding): all of them, those that are null or of another length than ``size`` left out.

    ``lists`` defaults to twice the square root of the number of vectors. The sample is the vectors whose ids hash
    lowest, ``SAMPLE`` at most.
    """

    def __init__(self, vectors: DataFrame, size: int, lists: int | None = None, sample: int = SAMPLE, seed: int = 1):
        good = vectors.filter(F.size("embedding") == size).select(F.col("unit_id").cast("long").alias("unit_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        self.size, n = size, good.count()
        self.n_lists = max(1, min(MOST_LISTS, n, lists or math.ceil(2 * math.sqrt(n))))
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
        unit = good.withColumn("_n", norm).filter("_n > 0").withColumn("unit", F.transform("embedding", lambda x: x / F.col("_n")))
        drawn = unit.orderBy(F.xxhash64("unit_id"), "unit_id").limit(sample).select(array_to_vector("unit").alias("features"))
        few = self.n_lists < 2 or drawn.limit(2).count() < 2
        self.centroids = np.zeros((1, size)) if few else np.stack(KMeans(k=self.n_lists, seed=seed, maxIter=10).fit(drawn).clusterCenters())
        self.listed = stored(good.mapInArrow(_assigned(self.centroids, 1), "list int, unit_id bigint, embedding array<double>"), "dense-lists")

    def tuned(self, k: int, recall: float = RECALL, most: int = TUNED_ON) -> int:
        """The least number of probes that finds ``recall`` of the true k nearest of ``most`` of the vectors, drawn by hash.

        One exhaustive pass answers for all numbers at once: what counts is the place of a neighbour's list in the order in
        which a query would ask the lists. How many it takes depends on how far the vectors form clusters.
        """
        drawn = self.listed.orderBy(F.xxhash64("unit_id", F.lit("tuned")), "unit_id").limit(most).select(F.col("unit_id").alias("query_id"), "embedding")
        near = dense_top_k(drawn, self.listed.select("unit_id", "embedding"), k).join(self.listed.select("unit_id", "list"), "unit_id").select("query_id", "list").toPandas()
        asked = drawn.toPandas()  # at most ``most`` vectors and k neighbours of each
        if not len(near):
            return 1
        order = np.argsort(-np.nan_to_num(unit_rows(np.stack(asked["embedding"])) @ np.nan_to_num(unit_rows(self.centroids)).T), axis=1, kind="stable")
        place = np.argsort(order, axis=1)[asked["query_id"].argsort().to_numpy()]
        needed = np.sort(place[np.searchsorted(np.sort(asked["query_id"].to_numpy()), near["query_id"].to_numpy()), near["list"].to_numpy()]) + 1
        return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)])

    def top_k(self, queries: DataFrame, k: int, probes: int | None = None, rows: int = ROWS, most: int = QUERIES) -> DataFrame:
        """query_id, unit_id, score, rank: the k nearest by cosine among the vectors of each query's ``probes`` lists (default: ``tuned``).

        Scores are exact. A vector is not held against the query of its own id. With as many probes as lists the result is
        that of the exhaustive search.
        """
        probes = min(len(self.centroids), probes or self.tuned(k))
        asked = queries.filter(F.size("embedding") == self.size).select(F.col("query_id").cast("long").alias("unit_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        asked = stored(asked.mapInArrow(_assigned(self.centroids, probes), "list int, unit_id bigint, embedding array<double>"), "dense-queries")
        return ranked(in_blocks(asked, self.listed, k, rows, most), "query_id", "score", "unit_id", k)


def in_blocks(asked: DataFrame, listed: DataFrame, k: int, rows: int = ROWS, most: int = QUERIES) -> DataFrame:
    """query_id, unit_id, score: the k best of each block of a list for each query that asks for the list.

    Both: list, unit_id, embedding. Lists longer than ``rows`` are dealt to several tasks, and so are the queries of a list.
    """
    deals = listed.groupBy("list").agg(F.ceil(F.count("*") / rows).cast("int").alias("deals"))  # a row for each list
    blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    plan = deals.join(blocks, "list")
    part = lambda n, salt: F.pmod(F.xxhash64("unit_id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = listed.join(plan, "list").withColumn("deal", part("deals", 1)).withColumn("block", every("blocks")).select("list", "deal", "block", "unit_id", "embedding")
    right = asked.join(plan, "list").withColumn("block", part("blocks", 2)).withColumn("deal", every("deals")).select("list", "deal", "block", "unit_id", "embedding")
    keys = ["list", "deal", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_met(k), "query_id bigint, unit_id bigint, score double")


def _assigned(centroids: np.ndarray, n: int):
    """Task function: each vector once for each of its ``n`` nearest centroids by cosine."""
    unit = unit_rows(centroids)
    unit[~np.isfinite(unit)] = 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                own = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(part.num_rows, -1)
                near = unit_rows(own) @ unit.T
                near[~np.isfinite(near)] = -np.inf
                lists = np.argsort(-near, axis=1, kind="stable")[:, :n]
                rows = pa.array(np.repeat(np.arange(part.num_rows), n))
                yield pa.RecordBatch.from_arrays([pa.array(lists.reshape(-1).astype("int32")), part.column(0).take(rows), part.column(1).take(rows)], names=["list", "unit_id", "embedding"])

    return run


def _met(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "unit_id", "score"]
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "unit_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        ids, units = queries["unit_id"].to_numpy("int64"), vectors["unit_id"].to_numpy("int64")
        asked, own = unit_rows(np.stack(queries["embedding"])), unit_rows(np.stack(vectors["embedding"]))
        out = []
        for q in range(0, len(ids), 256):
            found, s, u = best_of(ids[q : q + 256], asked[q : q + 256], units, own, k)
            out.append(pd.DataFrame({"query_id": np.repeat(ids[q : q + 256], found.sum(axis=1)), "unit_id": u[found], "score": s[found]}))
        return pd.concat(out)[columns]

    return run
