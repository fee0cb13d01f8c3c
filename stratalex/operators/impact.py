"""Sparse top-k that leaves out postings which cannot matter: impact blocks, upper bounds and a threshold for each query.

Postings belong to blocks by their count, four for each doubling. A query's threshold is the k-th
best exact score of a few units that are likely good. The threshold is dealt to the query's tokens as shares of their bounds,
and only postings beyond ``REACH`` of a share are joined. What they add to the rest's shares bounds a unit's score; units
whose bound is below the threshold go, the others are scored exactly. So a common token brings the units that have
it often, not all units that have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalex.sources.stored import stored

from .sparse import MOST_WANTED, ranked

#: Tokens of a query whose best units give its threshold; units of each token that are kept for that.
LEADS, SEEDS = 4, 12
#: Part of its share of the threshold beyond which a posting is joined: less joins more postings and scores fewer units.
REACH = 0.7
#: Scores are rounded to six places: a unit this far below the threshold cannot rise to it.
MARGIN = 2e-6


def block_of(tf: Column) -> Column:
    """Number of the block that holds postings with the count ``tf``: whole doublings, each in four parts."""
    return F.floor(F.log2(tf.cast("double")) * 4 + 1e-9).cast("int")


class ImpactIndex:
    """Postings of a corpus (unit_id, token, tf) in blocks, the largest count of each token and its first units.

    ``counts`` is a table that searches read several times; the block is told from the count, so it needs no copy in another order.
    """

    def __init__(self, counts: DataFrame, vocab: DataFrame, seeds: int = SEEDS):
        self.postings = counts.withColumn("block", block_of(F.col("tf")))
        top = F.row_number().over(W.partitionBy("token").orderBy(F.desc("tf"), "unit_id"))
        self.first = stored(self.postings.withColumn("_n", top).filter(F.col("_n") <= seeds).select("token", "unit_id"), "impact-seeds")
        most = self.postings.groupBy("token").agg(F.max("tf").alias("most"))
        self.tokens = stored(vocab.select("token", "idf").join(most, "token"), "impact-tokens")

    def top_k(self, query: DataFrame, k: int, stats: dict[str, int] | None = None, most: int = MOST_WANTED) -> DataFrame:
        """query_id, unit_id, score, rank: the rows of the exhaustive ``top_k``, ties by unit_id.

        ``query``: query_id, token, qtf. ``stats``, if given, is filled with the rows that the joins with postings made.
        """
        asked = query.join(self.tokens, "token").select("query_id", "token", "most", (F.col("idf") * F.col("qtf")).alias("weight"))
        asked = stored(asked.withColumn("bound", F.col("weight") * F.col("most")), "impact-asked")
        lead = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "token"))
        # The tokens of up to MOST_WANTED rows of queries travel to the postings, so that no others are shuffled.
        few = asked.count() <= most
        near = self.postings.join(F.broadcast(asked.select("token").distinct()), "token", "left_semi") if few else self.postings
        leads = asked.withColumn("_n", lead).filter(F.col("_n") <= LEADS).select("query_id", "token")
        seeded = leads.join(self.first, "token").select("query_id", "unit_id").distinct()
        known = stored(self._scores(near, asked, seeded), "impact-known")
        best = ranked(known, "query_id", "score", "unit_id", k).groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
        floor = best.select("query_id", F.when(F.col("n") >= k, F.col("kth") - MARGIN).otherwise(F.lit(0.0)).alias("floor"))
        # The same share of every token's bound: the shares add up to the threshold.
        whole = asked.groupBy("query_id").agg(F.sum("bound").alias("whole")).join(floor, "query_id", "left")
        share = whole.select("query_id", F.coalesce("floor", F.lit(0.0)).alias("floor"), F.greatest(F.lit(0.0), REACH * F.coalesce("floor", F.lit(0.0)) / F.col("whole")).alias("share"))
        cut = asked.join(share, "query_id").withColumn("least", F.col("share") * F.col("most") * (1 - 1e-9))
        open_ = F.sequence(F.greatest(F.lit(0), block_of(F.greatest(F.lit(1.0), "least"))), block_of(F.col("most")))
        wanted = stored(cut.select("query_id", "token", "weight", "least", "floor", F.explode(open_).alias("block")), "impact-wanted")
        blocks = self.postings
        if few:
            lowest = wanted.groupBy("token").agg(F.min("block").alias("_lowest"))
            blocks = blocks.join(F.broadcast(lowest), "token").filter(F.col("block") >= F.col("_lowest")).drop("_lowest")
        reached = wanted.join(blocks, ["token", "block"])
        over = reached.filter(F.col("tf") >= F.col("least")).groupBy("query_id", "unit_id").agg(F.first("floor").alias("floor"), F.sum((F.col("tf") - F.col("least")) * F.col("weight")).alias("over"))
        fresh = over.filter(F.greatest(F.lit(0.0), F.col("floor")) * REACH + F.col("over") >= F.col("floor") - MARGIN).select("query_id", "unit_id").join(known, ["query_id", "unit_id"], "left_anti")
        fresh = stored(fresh, "impact-candidates")
        scored = self._scores(near, asked, fresh)
        if stats is not None:
            stats |= {"seeds": self._joined(near, asked, seeded).count(), "blocks": reached.count(), "candidates": self._joined(near, asked, fresh).count()}
        return ranked(known.unionByName(scored), "query_id", "score", "unit_id", k)

    @staticmethod
    def _joined(postings: DataFrame, asked: DataFrame, units: DataFrame) -> DataFrame:
        """The postings of each candidate's query tokens."""
        each = units.join(asked.select("query_id", "token", "weight"), "query_id")
        return each.join(postings.select("unit_id", "token", "tf"), ["unit_id", "token"])

    @classmethod
    def _scores(cls, postings: DataFrame, asked: DataFrame, units: DataFrame) -> DataFrame:
        return cls._joined(postings, asked, units).groupBy("query_id", "unit_id").agg(F.round(F.sum(F.col("tf") * F.col("weight")), 6).alias("score"))
