"""Dense ranking, rank fusion and what follows it: dedupe, promotion, context budget, evidence and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .sparse import ranked


#: Queries that go to every task at once; with 1,000 numbers each they are some 160 MB in a task.
QUERIES_PER_PASS = 20_000


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, size: int | None = None, per_pass: int = QUERIES_PER_PASS) -> DataFrame:
    """The k nearest vectors of each query by cosine; ``queries``: query_id, embedding; ``vectors``: unit_id, embedding.

    Exhaustive. Up to ``per_pass`` queries travel with the tasks, which keep the k best of their vectors for every query; more
    queries stay a table, and blocks of queries meet blocks of vectors in tasks of bounded size. A vector is not held
    against the query of its own id; vectors of another length and those that are null are left out.
    """
    good = vectors.filter("embedding is not null") if size is None else vectors.filter(F.size("embedding") == size)
    asked = queries.filter("embedding is not null").select("query_id", "embedding")
    if asked.limit(per_pass + 1).count() > per_pass:
        from .dense_index import in_blocks

        whole = lambda df, key: df.select(F.lit(0).alias("list"), F.col(key).cast("long").alias("unit_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        out = in_blocks(whole(asked, "query_id"), whole(good, "unit_id"), k, most=per_pass)
    else:
        some = asked.toPandas()
        if not len(some):
            return queries.sparkSession.createDataFrame([], "query_id bigint, unit_id bigint, score double, rank int")
        ids, matrix = some["query_id"].to_numpy("int64"), unit_rows(np.stack([np.asarray(x, "float64") for x in some["embedding"]]))
        out = good.select("unit_id", "embedding").mapInArrow(_nearest(ids, matrix, k), "query_id bigint, unit_id bigint, score double")
    return ranked(out, "query_id", "score", "unit_id", k)


def unit_rows(m: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.sqrt((m * m).sum(axis=1))[:, None]


def best_of(ids: np.ndarray, asked: np.ndarray, units: np.ndarray, own: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray] | None = None):
    """(found, scores, units): for each query the k best of ``units`` and of ``best`` so far, by score, then unit_id."""
    scores = np.round(asked @ own.T, 6)
    scores[~np.isfinite(scores) | (ids[:, None] == units)] = -np.inf
    held = np.broadcast_to(units, scores.shape)
    s, u = (scores, held) if best is None else (np.concatenate([best[0], scores], axis=1), np.concatenate([best[1], held], axis=1))
    # Scores have six places, so score and id order as one pair: stable sort by id, then by score.
    order = np.argsort(u, axis=1, kind="stable")
    order = np.take_along_axis(order, np.argsort(-np.take_along_axis(s, order, 1), axis=1, kind="stable"), 1)[:, :k]
    s, u = np.take_along_axis(s, order, 1), np.take_along_axis(u, order, 1)
    return np.isfinite(s), s, u


def _nearest(ids: np.ndarray, matrix: np.ndarray, k: int):
    """Task function: of the vectors of a partition the k best for each query, by score, then unit_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_s, best_u = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo("int64").max)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                units = part.column(0).to_numpy(zero_copy_only=False).astype("int64")
                own = unit_rows(part.column(1).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(units), -1))
                for q in range(0, len(ids), 1024):
                    some = slice(q, q + 1024)
                    _, best_s[some], best_u[some] = best_of(ids[some], matrix[some], units, own, k, (best_s[some], best_u[some]))
        found = np.isfinite(best_s)
        rows = np.repeat(ids, found.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(best_u[found]), pa.array(best_s[found])], names=["query_id", "unit_id", "score"])

    return run


def provider_vectors(texts: DataFrame, answers: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Vectors of the texts that a provider was asked for, in the order of its indexes, and what is wrong with its batches.

    ``texts``: batch, place (from 0), text_id; ``answers``: batch, index, embedding. A batch counts whole or not at all: its
    answers must be as many as its texts, with one for each place, each of ``size`` numbers. Errors: batch, error (count, index,
    dimension, not_numeric), one row for each kind.
    """
    asked = texts.groupBy("batch").agg(F.count("*").alias("_n"))
    bad = lambda test: F.max(F.coalesce(test, F.lit(True)).cast("int"))
    numeric = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    got = answers.groupBy("batch").agg(F.count("*").alias("_got"), F.countDistinct("index").alias("_indexes"), F.min("index").alias("_low"), F.max("index").alias("_high"), bad(F.size("embedding") != size).alias("_size"), bad(~numeric).alias("_number"))
    met = asked.join(got, "batch", "left").withColumn("_got", F.coalesce("_got", F.lit(0)))
    errors = [F.when(F.col("_got") != F.col("_n"), "count"), F.when((F.col("_indexes") != F.col("_got")) | (F.col("_low") < 0) | (F.col("_high") >= F.col("_n")), "index"), F.when(F.col("_size") == 1, "dimension"), F.when(F.col("_number") == 1, "not_numeric")]
    told = met.select("batch", F.array_compact(F.array(*errors)).alias("errors"))
    good = told.filter(F.size("errors") == 0).select("batch")
    found = texts.join(good, "batch", "left_semi").join(answers.withColumnRenamed("index", "place"), ["batch", "place"]).select("text_id", "batch", "place", "embedding")
    return found, told.select("batch", F.explode("errors").alias("error"))


def fuse(lists: list[DataFrame], constant: int = 60, prefetch: int = 30, limit: int = 20, list_weights: list[float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, unit_id, rank from 1): score, rank and the sources met."""
    parts = None
    for i, ranked_list in enumerate(lists):
        weight = (list_weights or [1.0] * len(lists))[i]
        part = ranked_list.filter(F.col("rank") <= prefetch).select("query_id", "unit_id", F.lit(i).alias("source"), (F.lit(weight) / (F.lit(constant) + F.col("rank"))).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    fused = parts.groupBy("query_id", "unit_id").agg(F.round(F.sum("part"), 6).alias("score"), F.count("*").alias("lists"))
    return ranked(fused, "query_id", "score", "unit_id", limit)


def dedupe_candidates(candidates: DataFrame) -> DataFrame:
    """Best rank of each (query_id, provision_id) and the sources that found it."""
    return candidates.groupBy("query_id", "provision_id").agg(F.min("rank").alias("rank"), F.array_sort(F.collect_set("source")).alias("sources"))


def promote_exact(candidates: DataFrame, exact: Column) -> DataFrame:
    """Reorder: exact matches first, each part by its old rank."""
    return candidates.withColumn("promoted", F.row_number().over(W.partitionBy("query_id").orderBy(F.when(exact, 0).otherwise(1), "rank", "unit_id")))


def within_budget(candidates: DataFrame, most_tokens: int = 12_000, most_units: int = 10) -> DataFrame:
    """Leading candidates whose running token total and count stay within the budget."""
    order = W.partitionBy("query_id").orderBy("rank", "unit_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return candidates.withColumn("running", F.sum("tokens").over(order)).withColumn("place", F.count("*").over(order)).filter((F.col("running") <= most_tokens) & (F.col("place") <= most_units))


def evidence_gap(required: Column, covered: Column) -> Column:
    """Evidence classes still missing, in order; empty means complete."""
    return F.array_sort(F.array_except(required, covered))


def verified(*layers: Column) -> Column:
    """All layers pass; an unknown layer fails closed."""
    out = F.lit(True)
    for layer in layers:
        out = out & F.coalesce(layer, F.lit(False))
    return out
