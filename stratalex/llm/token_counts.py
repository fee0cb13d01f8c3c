"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit."""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Workspace

#: Lengths that one step of the suffix sums holds.
STEP = 4096
_ENCODERS: dict = {}


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str | None):
    """The byte-level encoder of a rank file; read once in each Python worker."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path or vocabulary_path(), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def length_histogram(docs: DataFrame, group: str | None = "source", path: str | None = None) -> DataFrame:
    """group, length, n_docs: how many documents of each group have so many tokens.

    Whole texts are encoded; a null text has no tokens. Every batch is counted before it leaves its task, so
    rows shuffled are at most the distinct lengths of a task, however many documents share one.
    """
    held = docs.select(F.col(group).cast("string").alias("group") if group else F.lit(None).cast("string").alias("group"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, found = encoder(path).encode_ordinary, Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found[key, len(encode(text.as_py())) if text.is_valid else 0] += 1
            if len(found) > 200_000:
                yield rows(found)
                found = Counter()
        if found:
            yield rows(found)

    def rows(found: Counter) -> pa.RecordBatch:
        keys, lengths = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(lengths, pa.int64()), pa.array(list(found.values()), pa.int64())], names=["group", "length", "n_docs"])

    counted = held.mapInArrow(count, "group string, length bigint, n_docs bigint")
    return counted.groupBy("group", "length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with docs_at_least, tokens_at_least, tokens_truncated and the group's docs_total, tokens_total.

    tokens_truncated is the total when every document is cut to ``length`` tokens. Sums run inside steps of
    ``STEP`` lengths and over the steps' totals, so no task needs all lengths of a group.
    """
    histogram = histogram.withColumn("step", F.expr(f"length div {STEP}"))
    steps = histogram.groupBy("group", "step").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("length")).alias("tokens"))
    later, whole = W.partitionBy("group").orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, -1), W.partitionBy("group")
    steps = steps.select(
        F.col("group").alias("_group"), F.col("step").alias("_step"), F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_later"), F.coalesce(F.sum("tokens").over(later), F.lit(0)).alias("tokens_later"),
        F.sum("docs").over(whole).alias("docs_total"), F.sum("tokens").over(whole).alias("tokens_total"),
    )
    inside = W.partitionBy("group", "step").orderBy(F.desc("length"))
    out = histogram.withColumn("docs_in", F.sum("n_docs").over(inside)).withColumn("tokens_in", F.sum(F.col("n_docs") * F.col("length")).over(inside))
    out = out.join(steps, F.col("group").eqNullSafe(F.col("_group")) & (F.col("step") == F.col("_step")))
    at_least, tokens = F.col("docs_in") + F.col("docs_later"), F.col("tokens_in") + F.col("tokens_later")
    return out.select(
        "group", "length", "n_docs", at_least.alias("docs_at_least"), tokens.alias("tokens_at_least"),
        (F.col("tokens_total") - tokens + F.col("length") * at_least).alias("tokens_truncated"), "docs_total", "tokens_total",
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """group, limit, docs_over, tokens_truncated, tokens_lost for each context limit, from the histogram alone."""
    each = histogram.withColumn("limit", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])))
    cut = F.least("length", "limit")
    return each.groupBy("group", "limit").agg(
        F.sum(F.when(F.col("length") > F.col("limit"), F.col("n_docs")).otherwise(0)).alias("docs_over"), F.sum(F.col("n_docs") * cut).alias("tokens_truncated"), F.sum(F.col("n_docs") * (F.col("length") - cut)).alias("tokens_lost")
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """group, share, length: the smallest length that at least ``share`` of the documents do not exceed."""
    upto = F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")
    each = sums.withColumn("upto", upto).withColumn("share", F.explode(F.array(*[F.lit(float(x)) for x in shares])))
    return each.filter(F.col("upto") >= F.ceil(F.col("share") * F.col("docs_total"))).groupBy("group", "share").agg(F.min("length").alias("length"))


def token_counts(docs: DataFrame, group: str | None = "source", path: str | None = None) -> DataFrame:
    """Histogram with suffix sums of every group. Empty tables give empty results; repeated rows count each;
    rows with a null group are a group; other columns are not read."""
    space = Workspace(docs.sparkSession, "token-counts")
    return suffix_sums(space.save(length_histogram(docs, group, path), "histogram"))
