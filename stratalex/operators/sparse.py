"""Sparse encoding and ranking: vocabulary, idf, tf x idf postings and top-k by dot product (idf applied once)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalex.functions.text import LETTER, normalised, tokens
from stratalex.sources.stored import stored

#: Rows (a query's token each) that travel with the tasks of a search, some 100 MB of a task at the most; more stay a table.
MOST_WANTED = 200_000
#: Scores of units against queries that a task holds at once.
SCORES = 1 << 21


def token_rows(units: DataFrame, key: str, text: str, drop_stopwords: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
    """key, token: one row for each token of each unit, or for those in ``only``, which are chosen before they are rows."""
    found = tokens(F.col(text), drop_stopwords)
    return units.select(F.col(key).alias("unit_id"), F.explode(found if only is None else F.filter(found, lambda x: x.isin(*only))).alias("token"))


def counts_of(units: DataFrame, key: str, text: str, terms: tuple[str, ...]) -> DataFrame:
    """unit_id, token, tf of the given tokens alone (lower case, ASCII), counted where the texts lie: no text becomes a list of tokens.

    Composition can only change such a token where a mark follows it, so texts without marks are counted as they are.
    """
    held = F.col(text)
    marked = held.rlike(r"\p{M}")
    plain = F.lower(F.when(marked, normalised(F.when(marked, held))).otherwise(held))
    found = [F.struct(F.lit(t).alias("token"), F.regexp_count(plain, F.lit(rf"(?<!{LETTER}){t}(?!{LETTER})")).cast("long").alias("tf")) for t in terms]
    rows = units.select(F.col(key).alias("unit_id"), F.inline(F.array(*found)))
    return rows.filter("tf > 0")


def term_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("unit_id", "token").agg(F.count("*").alias("tf"))


def text_counts(units: DataFrame, key: str, text: str, drop_stopwords: bool = False) -> DataFrame:
    """The rows of ``term_counts`` over ``token_rows``, counted in each text's own sorted tokens: nothing is shuffled but what several texts of one key share."""
    keys = units.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_key")
    several = stored(keys, "several")
    if several.isEmpty():
        return _counted(units, key, text, drop_stopwords)
    same = F.col(key).eqNullSafe(F.col("_key"))
    shared = _counted(units.join(several, same, "left_semi"), key, text, drop_stopwords).groupBy("unit_id", "token").agg(F.sum("tf").alias("tf"))
    return _counted(units.join(several, same, "left_anti"), key, text, drop_stopwords).unionByName(shared)


def _counted(units: DataFrame, key: str, text: str, drop_stopwords: bool) -> DataFrame:
    """unit_id, token, tf of each row by itself: where a token begins among the sorted ones, and how far it is to the next."""
    rows = units.select(F.col(key).alias("unit_id"), F.sort_array(tokens(F.col(text), drop_stopwords)).alias("_t"))
    places = F.when(F.size("_t") > 0, F.sequence(F.lit(0), F.size("_t") - 1))
    begins = F.filter(places, lambda i: (i == 0) | (F.get("_t", i) != F.get("_t", i - 1)))
    pairs = F.transform("_b", lambda i, n: F.struct(F.get("_t", i).alias("token"), (F.coalesce(F.get("_b", n + 1), F.size("_t")) - i).cast("long").alias("tf")))
    # The outer form, as the inner one evaluates the array once more in a filter on its size.
    return rows.withColumn("_b", begins).select("unit_id", F.inline_outer(pairs)).filter("token is not null")


def idf(total: Column, df: Column) -> Column:
    return F.log(1 + (total - df + 0.5) / (df + 0.5))


def vocabulary(counts: DataFrame, total: int | Column) -> DataFrame:
    """token, df, idf of a corpus of ``total`` units, from its term counts."""
    n = F.lit(total) if isinstance(total, int) else total
    return counts.groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", idf(n, F.col("df")))


def numbered(vocab: DataFrame) -> DataFrame:
    """Add token_id, the token's place from 1 in code-point order.

    Places are counted inside ranges by the first two characters and offset by the ranges before, so no task sorts it all.
    """
    part = F.ascii("token").cast("long") * (1 << 21) + F.ascii(F.substring("token", 2, 1))
    sized = vocab.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sized.select(F.col("part").alias("_part"), (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy(part).orderBy("token"))
    return vocab.withColumn("_in", inside).withColumn("_p", part).join(before, F.col("_p") == F.col("_part")).withColumn("token_id", (F.col("before") + F.col("_in")).cast("long")).drop("_in", "_p", "_part", "before")


def weights(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Postings unit_id, token, weight; tokens outside the vocabulary are skipped."""
    return counts.join(vocab, "token").select("unit_id", "token", (F.col("tf") * F.col("idf")).alias("weight"))


def unfitted(counts: DataFrame) -> DataFrame:
    """Postings without a corpus: the weight is the count, the id is the token's place among the text's own sorted tokens."""
    place = F.row_number().over(W.partitionBy("unit_id").orderBy("token"))
    return counts.select("unit_id", place.cast("long").alias("token_id"), F.col("tf").cast("double").alias("weight"))


def refreshed(frozen: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """A frozen vocabulary (token, token_id) with idf from today's corpus; 1.0 where no unit has the token."""
    df = counts.groupBy("token").agg(F.count("*").alias("df"))
    return frozen.join(df, "token", "left").withColumn("idf", F.when(F.col("df").isNull(), 1.0).otherwise(idf(F.lit(total), F.col("df")))).withColumn("df", F.coalesce("df", F.lit(0)))


def wire(postings: DataFrame) -> DataFrame:
    """unit_id, indices (strictly increasing) and values, from unit_id, token_id, weight; empty vectors are absent."""
    packed = postings.groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct("token_id", "weight"))).alias("v"))
    return packed.select("unit_id", F.col("v.token_id").alias("indices"), F.col("v.weight").alias("values"))


def top_k(counts: DataFrame, query: DataFrame, vocab: DataFrame, k: int, most: int = MOST_WANTED) -> DataFrame:
    """The k best units of each query by the dot product of query and unit weights; ties by unit_id.

    ``query``: query_id, token, qtf. Up to ``most`` rows of queries travel with the tasks: postings of tokens that some query
    has are brought together by unit, and a task keeps the k best of its units for every query. More queries stay a
    table that is joined with the postings.
    """
    wanted = query.join(vocab.select("token", "idf"), "token").select("query_id", "token", (F.col("idf") * F.col("qtf")).alias("weight"))
    some = wanted.limit(most + 1).toPandas()
    if len(some) > most:
        scored = counts.join(wanted, "token").groupBy("query_id", "unit_id").agg(F.round(F.sum(F.col("tf") * F.col("weight")), 6).alias("score"))
        return ranked(scored, "query_id", "score", "unit_id", k)
    kinds = f"query_id {wanted.schema['query_id'].dataType.simpleString()}, unit_id {counts.schema['unit_id'].dataType.simpleString()}, score double"
    if not len(some):
        return ranked(counts.sparkSession.createDataFrame([], kinds), "query_id", "score", "unit_id", k)
    tokens_, ids = sorted(set(some["token"])), some["query_id"].unique()
    code, at = {x: i for i, x in enumerate(tokens_)}, {x: i for i, x in enumerate(ids)}
    codes, queries = some["token"].map(code).to_numpy("int64"), some["query_id"].map(at).to_numpy("int64")
    order = np.argsort(codes, kind="stable")
    begins = np.searchsorted(codes[order], np.arange(len(tokens_) + 1))
    coded = counts.sparkSession.createDataFrame(list(code.items()), "token string, code int")
    postings = counts.join(F.broadcast(coded), "token").select("unit_id", "code", "tf")
    best = _best(ids.tolist(), begins, queries[order], some["weight"].to_numpy("float64")[order], k)
    out = postings.repartition("unit_id").sortWithinPartitions("unit_id").mapInArrow(best, kinds)
    return ranked(out, "query_id", "score", "unit_id", k)


def _best(ids: list, begins: np.ndarray, queries: np.ndarray, weights: np.ndarray, k: int):
    """Task function: of postings (unit_id, code, tf) sorted by unit the k best units for each query; tokens are numbers into ``begins``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, per = len(ids), max(1, SCORES // len(ids))
        top, place = np.full((n, k), -np.inf), np.full((n, k), -1)  # places in ``held``
        held = rest = None

        def take(rows: pa.Table, starts: np.ndarray) -> None:
            nonlocal top, place, held
            code, tf = (rows.column(c).to_numpy().astype("int64") for c in (1, 2))
            unit = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            for first in range(0, len(starts) - 1, per):
                last = min(first + per, len(starts) - 1)
                some = slice(starts[first], starts[last])
                low, size = begins[code[some]], begins[code[some] + 1] - begins[code[some]]
                each = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
                cell = np.repeat(unit[some] - first, size) + (last - first) * queries[each]
                found = np.bincount(cell, minlength=n * (last - first)) > 0
                score = np.bincount(cell, np.repeat(tf[some], size) * weights[each], minlength=n * (last - first))
                score = np.where(found, np.floor(score * 1e6 + 0.5) / 1e6, -np.inf).reshape(n, -1)
                names = rows.column(0).take(pa.array(starts[first:last])).combine_chunks()
                names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
                count = 0 if held is None else len(held)
                # Units come in order, so a stable sort by score alone leaves ties to the smaller id.
                s = np.concatenate([top, score], axis=1)
                u = np.concatenate([place, np.broadcast_to(np.arange(count, count + last - first), score.shape)], axis=1)
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                top, place = np.take_along_axis(s, best, 1), np.take_along_axis(u, best, 1)
                used, back = np.unique(place, return_inverse=True)
                gone = int(used[0] == -1)
                every = names if held is None else pa.concat_arrays([held, names])
                held, place = every.take(pa.array(used[gone:])), back.reshape(place.shape) - gone

        def whole(rows: pa.Table, end: bool) -> pa.Table:
            key = rows.column(0).combine_chunks()
            key = key.combine_chunks() if isinstance(key, pa.ChunkedArray) else key
            codes = pc.dictionary_encode(key, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])
            if end:
                take(rows, starts)
                return rows.slice(0, 0)
            if len(starts) > 2:
                take(rows.slice(0, starts[-2]), starts[:-1])
            return rows.slice(starts[-2])

        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                rest = whole(rows if rest is None or not rest.num_rows else pa.concat_tables([rest, rows]).combine_chunks(), False)
        if rest is not None and rest.num_rows:
            whole(rest, True)
        if held is not None:
            good = np.isfinite(top)
            asked = [ids[i] for i in np.repeat(np.arange(n), good.sum(axis=1))]
            yield pa.RecordBatch.from_arrays([pa.array(asked), held.take(pa.array(place[good])), pa.array(top[good])], names=["query_id", "unit_id", "score"])

    return run


def ranked(scored: DataFrame, by: str, score: str, key: str, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), key))
    return scored.withColumn("rank", place).filter(F.col("rank") <= k)
