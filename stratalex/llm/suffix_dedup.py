"""Repeated passages by sparse suffixes, none lost.

Every run of ``length`` words has a minimiser: its ``gram``-word gram with the least hash. Equal runs have equal
minimisers, so a text keeps only the places where a minimiser stands, each with the stretch of words whose runs it
is the minimiser of. Places are brought together by their gram. Where all stretches of a gram are equal they match
whole, to the left and to the right. Where they differ, sorting what lies ahead of them and comparing neighbours is
not enough: a match may lie behind the gram, and the neighbour that shares most of it may sort anywhere. There each
distinct stretch gives its runs, named by two independent hashes of their words, and runs of one name are joined as stars to the
least document. However many documents share a passage or a part of it, no limit on neighbours decides what is met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Workspace
from .hashing import U, Words, mixed, runs, spans_named

#: Words that a repeated passage has at least, words of a gram.
LENGTH, GRAM = 50, 10
#: Salt of the names of stretches.
NAME = 0x51F15EED
_STRETCH = "gram bigint, name bigint, doc bigint, place int, n int"


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every window of ``width``, by doubling."""
    step, out = 1, x
    while 2 * step <= width:
        out = pick(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def minimisers(words: Words, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash of the minimiser's gram) of every run of ``length`` words within a text."""
    h, n = words.hash, len(words.hash)
    if n < length:
        return np.zeros(0, "int64"), np.zeros(0, U)
    grams = np.zeros(n - gram + 1, U)
    for i in range(gram):
        grams = grams * U(0x9E3779B97F4A7C15) + mixed(h[i : n - gram + 1 + i])
    least = _sliding(mixed(grams), length - gram + 1, np.minimum)
    at = np.flatnonzero(words.text[: len(least)] == words.text[length - 1 :])
    return at, least[at]


def _places(words: Words, at: np.ndarray) -> np.ndarray:
    """Word numbers within their texts."""
    count = words.count()
    return (at - (np.cumsum(count) - count)[words.text[at]]).astype("int32")


def _stretches(length: int, gram: int):
    """gram, name, doc, place and n of every stretch of ``n`` neighbouring runs that have the same minimiser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in runs(batch.column(1)):
                words = Words(data, offsets, lower=False)
                at, h = minimisers(words, length, gram)
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1] + 1) | (h[1:] != h[:-1])
                heads = np.flatnonzero(new)
                n = np.diff(np.append(heads, len(at)))
                begin = at[heads]
                ids = batch.column(0).slice(first, end - first).take(pa.array(words.text[begin]))
                name = spans_named(words.hash, begin, begin + n - 1 + length, NAME)
                columns = [pa.array(h[heads].view("int64")), pa.array(name.view("int64")), ids, pa.array(_places(words, begin)), pa.array(n.astype("int32"))]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "name", "doc", "place", "n"])

    return run


def _runs_of(length: int):
    """one, two, doc, place, name, off and last of every run in the stretches (place, n, name, last) that a row asks for.

    A stretch that another row with the same doc_id holds is told by its name and left to that row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in runs(batch.column(1)):
                words = Words(data, offsets, lower=False, both=True)
                count = words.count()
                base = np.cumsum(count) - count
                asked = batch.column(2).slice(first, end - first)
                row = np.repeat(np.arange(end - first), asked.value_lengths().to_numpy())
                place, n, name, last = (asked.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(4))
                held = place + n - 1 + length <= count[row]
                begin = (base[row] + place)[held]
                held[held] = spans_named(words.hash, begin, begin + n[held] - 1 + length, NAME).view("int64") == name[held]
                row, place, n, name, last = (x[held] for x in (row, place, n, name, last))
                off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(base[row] + place, n) + off
                one, two = (spans_named(h, at, at + length) for h in (words.hash, words.other))
                ids = batch.column(0).slice(first, end - first).take(pa.array(np.repeat(row, n)))
                columns = [pa.array(one.view("int64")), pa.array(two.view("int64")), ids, pa.array(np.repeat(place, n).astype("int32")), pa.array(np.repeat(name, n)), pa.array(off.astype("int32")), pa.array(np.repeat(last, n))]
                yield pa.RecordBatch.from_arrays(columns, names=["one", "two", "doc", "place", "name", "off", "last"])

    return run


def repeated_runs(held: DataFrame, space: Workspace, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc, begin, end, low, high: words that are covered by runs of ``length`` words which several documents hold.

    ``held`` has doc_id (bigint, not null) and text (not null). low and high are the least and the greatest document
    that hold the runs. Spans of one document may touch and overlap.
    """
    # Only places with a gram that several documents hold go on: for most of a text the first sum is the end.
    stretches = space.save(held.select("doc_id", "text").mapInArrow(_stretches(length, gram), _STRETCH), "stretches")
    often = stretches.groupBy("gram").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), (F.min("name") == F.max("name")).alias("alike")).filter("low < high")
    often = space.save(often, "often")  # a table, so that the join below has two plain shuffles and common grams can be split
    met = space.save(stretches.join(often, "gram"), "met_stretches")
    space.drop("stretches")
    ends = F.col("place") + F.col("n") - 1 + length
    whole = met.filter("alike").select("doc", F.col("place").alias("begin"), ends.alias("end"), "low", "high")

    # Stretches of one gram that differ: each distinct one once, by its first place.
    differing = met.filter("not alike")
    kinds = differing.groupBy("gram", "name", "n").agg(F.min(F.struct("doc", "place")).alias("first"), F.max("doc").alias("last"))
    kinds = space.save(kinds.select("gram", "name", "n", "first.doc", "first.place", "last"), "kinds")
    asked = kinds.groupBy("doc").agg(F.collect_list(F.struct("place", "n", "name", "last")).alias("asked"))
    texts = held.join(asked.hint("merge"), F.col("doc_id") == F.col("doc")).select("doc_id", "text", "asked")
    every = space.save(texts.mapInArrow(_runs_of(length), "one bigint, two bigint, doc bigint, place int, name bigint, off int, last bigint").distinct(), "runs")
    # Sums before the shuffle leave one row of a run for each task.
    stars = every.groupBy("one", "two").agg(F.min("doc").alias("low"), F.max("last").alias("high")).filter("low < high")
    stars = space.save(stars, "stars")
    order = W.partitionBy("doc", "place", "name", "low", "high").orderBy("off")
    pieces = every.join(stars, ["one", "two"]).withColumn("island", F.col("off") - F.row_number().over(order))
    pieces = pieces.groupBy("doc", "place", "name", "low", "high", "island").agg(F.min("off").alias("from"), F.max("off").alias("to"))
    parts = kinds.join(pieces, ["doc", "place", "name"]).select("gram", "name", "n", "from", "to", "low", "high")
    parts = space.save(parts, "parts")
    for name in ("runs", "stars"):
        space.drop(name)
    partial = differing.select("gram", "name", "n", "doc", "place").join(parts, ["gram", "name", "n"])
    partial = partial.select("doc", (F.col("place") + F.col("from")).alias("begin"), (F.col("place") + F.col("to") + length).alias("end"), "low", "high")
    return whole.unionByName(partial)


def islands(spans: DataFrame, *by: str) -> DataFrame:
    """``spans`` with ``island``: overlapping or touching ones (begin, end) of the same ``by`` have the same number."""
    order = W.partitionBy(*by).orderBy("begin", "end")
    new = F.coalesce((F.col("begin") > F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))).cast("int"), F.lit(1))
    return spans.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("new")


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Passages of at least ``length`` words that other documents hold word for word.

    One row per document that has any: doc_id, n_words_repeated, spans (array of begin, end: word numbers from 0, end
    exclusive, merged) and others (of each repeated run of ``length`` words the least doc_id that holds it, for that
    document itself the greatest; ascending): documents that share a passage share its least doc_id. Words are runs
    without white space, in their own case. Documents are told apart by doc_id; rows with a null doc_id or text are
    left out, repeated rows count once, empty texts have no passages, an empty table gives none, other columns are
    not read. Runs are told by two independent 64-bit hashes of their words, stretches of one gram by one of them. One text is one row of a task, however long.
    """
    space = Workspace(docs.sparkSession, "suffixes")
    held = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    matches = repeated_runs(held, space, length, gram)
    matches = matches.withColumn("other", F.when(F.col("doc") == F.col("low"), F.col("high")).otherwise(F.col("low"))).distinct()
    spans = islands(matches, "doc").groupBy("doc", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.collect_set("other").alias("others"))
    return spans.groupBy(F.col("doc").alias("doc_id")).agg(
        F.sum(F.col("end") - F.col("begin")).alias("n_words_repeated"), F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("others")))).alias("others")
    )
