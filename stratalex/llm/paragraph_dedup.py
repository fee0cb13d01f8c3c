"""Substring dedup: MinHash banding of paragraphs, exact verification, and removals by components.

Paragraphs are the lines of a text, and where blank lines divide it the blocks of several lines between them; each
counts over its whole length, fewer words than a shingle as one shingle. Equal paragraphs become one content. Bands
are tuned to the recall wanted; every content that shares a band value with another goes on to an exact Jaccard
join, however many share the value, and of each component of copies the first paragraph stays. Passages that no
line break marks are found beside them: all runs of ``LENGTH`` words that an earlier document holds word for word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .exact_dedup import numbered
from .hashing import U, Words, distinct, mixed, runs, sequences
from .jaccard_join import linked
from .suffix_dedup import islands, repeated_runs

#: Words of an unmarked passage, words of a shingle.
LENGTH, SHINGLE = 36, 5
#: Similarity in hundredths, and the recall that bands must have at it.
LEAST, RECALL = 75, 0.98


def tuned_bands(least: int = LEAST, recall: float = RECALL, most: int = 6) -> tuple[int, int]:
    """(bands, rows): as many rows to a band as leave the recall 1 - (1 - t^rows)^bands within ``most`` bands.

    More rows mean fewer chance collisions; shingles of five words make those rare already.
    """
    t = least / 100
    for rows in range(4, 0, -1):
        for bands in range(1, most + 1):
            if 1 - (1 - t**rows) ** bands >= recall:
                return bands, rows
    raise ValueError("no banding within that many bands")


def paragraph_bounds(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, end) of every line that has words, and of blocks of several lines in texts that blank lines divide."""
    n, text = len(words.hash), words.text
    breaks = np.searchsorted(np.flatnonzero(words.data == 10), words.start)
    line, block = np.ones(n, bool), np.ones(n, bool)
    line[1:] = (text[1:] != text[:-1]) | (breaks[1:] > breaks[:-1])
    block[1:] = (text[1:] != text[:-1]) | (breaks[1:] > breaks[:-1] + 1)
    lines, blocks = np.flatnonzero(line), np.flatnonzero(block)
    line_ends, block_ends = np.append(lines[1:], n)[: len(lines)], np.append(blocks[1:], n)[: len(blocks)]
    several = np.searchsorted(lines, block_ends) - np.searchsorted(lines, blocks) > 1
    several &= np.bincount(text[blocks], minlength=1)[text[blocks]] > 1
    return np.concatenate([lines, blocks[several]]), np.concatenate([line_ends, block_ends[several]])


def _shingle_sets(words: Words, begin: np.ndarray, end: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, ...]:
    """(paragraph, hash, other hash) of the distinct shingles of each paragraph; of one with fewer words, all of them as one."""
    n = np.maximum(end - begin - shingle + 1, 1)
    start = np.cumsum(n) - n
    long = np.repeat(end - begin >= shingle, n)
    at, short = (np.repeat(begin - start, n) + np.arange(int(n.sum())))[long], [np.flatnonzero(end - begin == k) for k in range(1, shingle)]
    flat = []
    for h in (words.hash, words.other):
        every = sequences(h, np.arange(max(0, len(h) - shingle + 1)), shingle)
        out = np.zeros(len(long), U)
        out[long] = every[at]
        for k, some in enumerate(short, 1):
            out[start[some]] = sequences(h, begin[some], k)
        flat.append(out)
    return distinct(np.repeat(np.arange(len(n)), n), *flat)


def _starts(unit: np.ndarray, units: int) -> np.ndarray:
    """Where each paragraph's shingles start; every paragraph has some."""
    return np.searchsorted(unit, np.arange(units))


def _contents(flat: np.ndarray, other: np.ndarray, start: np.ndarray) -> pa.Array:
    """Names of each paragraph's set of shingles: sums of either hash."""
    out = np.zeros((len(start), 2), U)
    for i, h in enumerate((flat, other) if len(start) else ()):
        out[:, i] = mixed(np.add.reduceat(mixed(h), start))
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.arange(0, 16 * len(start) + 1, 16, dtype="int32").tobytes()), pa.py_buffer(out.tobytes())])


def _values(flat: np.ndarray, start: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band values of each paragraph, the band mixed in."""
    out = np.zeros((len(start), bands), U)
    for b in range(bands if len(start) else 0):
        for r in range(rows):
            low = np.minimum.reduceat(mixed(flat ^ U((b * rows + r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), start)
            out[:, b] = mixed(out[:, b] + low + U(b + 1))
    return out


def _paragraphs(bands: int, rows: int, shortest: int = 1):
    """doc, place, size, content and band values of every paragraph of at least ``shortest`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in runs(batch.column(1)):
                words = Words(data, offsets, lower=False, both=True)
                begin, stop = paragraph_bounds(words)
                begin, stop = begin[stop - begin >= shortest], stop[stop - begin >= shortest]
                unit, flat, other = _shingle_sets(words, begin, stop)
                start = _starts(unit, len(begin))
                values, text, count = _values(flat, start, bands, rows), words.text[begin], words.count()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, bands, dtype="int32")), pa.array(values.reshape(-1).view("int64")))
                columns = [
                    batch.column(0).slice(first, end - first).take(pa.array(text)), pa.array((begin - (np.cumsum(count) - count)[text]).astype("int32")), pa.array((stop - begin).astype("int32")),
                    _contents(flat, other, start), lists,
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "place", "size", "content", "bands"])

    return run


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """number and shingles of the paragraphs (place, size, content, number) that a row asks for."""
    for batch in batches:
        for first, end, data, offsets in runs(batch.column(1)):
            words = Words(data, offsets, lower=False, both=True)
            count = words.count()
            base = np.cumsum(count) - count
            asked = batch.column(2).slice(first, end - first)
            row, parts = np.repeat(np.arange(end - first), asked.value_lengths().to_numpy()), asked.flatten()
            place, size = (parts.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            # Another row with the same doc_id may hold the paragraph: the content tells.
            held = np.flatnonzero(place + size <= count[row])
            begin = (base[row] + place)[held]
            unit, flat, other = _shingle_sets(words, begin, begin + size[held])
            start = _starts(unit, len(held))
            same = np.array(pa.compute.equal(_contents(flat, other, start), parts.field(2).take(pa.array(held)).cast(pa.binary())), bool) if len(held) else np.zeros(0, bool)
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(flat)).astype("int32")), pa.array(flat.view("int64"))).filter(pa.array(same))
            yield pa.RecordBatch.from_arrays([parts.field(3).take(pa.array(held[same])), lists], names=["doc", "tokens"])


def copied_paragraphs(held: DataFrame, space: Workspace, least: int = LEAST, recall: float = RECALL, shortest: int = 1) -> DataFrame:
    """doc, place, size, keep (doc, place, size) of every paragraph in a group that several documents share: the first is kept.

    Groups are components of links: equal contents, and contents that share a band value with any other and whose
    similarity is at least ``least``.
    """
    bands, rows = tuned_bands(least, recall)
    found = space.save(held.select("doc_id", "text").mapInArrow(_paragraphs(bands, rows, shortest), "doc bigint, place int, size int, content binary, bands array<bigint>"), "paragraphs")
    # Equal paragraphs meet in map-side sums: however often one is copied, a row for each task goes on.
    contents = found.groupBy("content").agg(F.min(F.struct("doc", "place", "size")).alias("keep"), F.max("doc").alias("last"), F.first("bands").alias("bands"))
    contents = space.save(contents, "contents")
    entries = contents.select("content", F.xxhash64("content").alias("of"), F.explode("bands").alias("value"))
    shared = entries.groupBy("value").agg(F.min("of").alias("a"), F.max("of").alias("b")).filter("a < b").select("value")
    shared = space.save(shared, "shared")  # a table, so that the join below has two plain shuffles and common values can be split
    meeting = entries.join(shared.hint("merge"), "value", "left_semi").select("content").distinct()
    meeting = space.save(numbered(meeting, "content").withColumnRenamed("name", "number"), "meeting")

    # The shingles of those, read again from the first text that holds each.
    firsts = space.save(contents.drop("bands").join(meeting.hint("merge"), "content", "left"), "firsts")
    for name in ("contents", "shared", "meeting"):
        space.drop(name)
    asked = firsts.filter("number is not null").select("keep.*", "content", "number").groupBy("doc").agg(F.collect_list(F.struct("place", "size", "content", "number")).alias("asked"))
    texts = held.join(asked.hint("merge"), F.col("doc_id") == F.col("doc")).select("doc_id", "text", "asked")
    sets = texts.mapInArrow(_shingled, "doc bigint, tokens array<bigint>").groupBy("doc").agg(F.first("tokens").alias("tokens"))
    roots = space.save(linked(space.save(sets, "sets"), space, least), "roots")
    for name in ("sets", "prefixes", "tokens_shared", "clusters", "sizes", "members", "found"):
        space.drop(name)

    # Groups of contents, and the first paragraph of each group that more than one document holds.
    grouped = firsts.filter("number is not null").join(roots, F.col("number") == F.col("rep"), "left").select("content", "keep", "last", F.coalesce("root", "number").alias("root"))
    grouped = space.save(grouped, "grouped")
    groups = space.save(grouped.groupBy("root").agg(F.min("keep").alias("keep"), F.max("last").alias("last")).filter("keep.doc < last").select("root", "keep"), "groups")
    alone = firsts.filter("number is null and keep.doc < last").select("content", "keep")
    kept = space.save(grouped.select("content", "root").join(groups, "root").select("content", "keep").unionByName(alone), "kept")
    copies = space.save(found.drop("bands").join(kept, "content").select("doc", "place", "size", "keep").distinct(), "copies")
    for name in ("paragraphs", "firsts", "roots", "grouped", "groups", "kept"):
        space.drop(name)
    return copies


def repeated_paragraphs(docs: DataFrame, least: int = LEAST, recall: float = RECALL, length: int = LENGTH, shortest: int = 1) -> DataFrame:
    """Documents that share paragraphs or unmarked passages with others.

    One row per such document: doc_id, n_paragraphs (lines, and blocks of several lines, in components with another
    document), n_removed (those that are not their component's first, by doc_id, then place), removed (array of begin,
    end: word numbers from 0, end exclusive, merged; of paragraphs, and of all runs of ``length`` words that a
    document with a smaller doc_id holds) and keepers (doc_ids that hold the first copies, ascending). Words keep their
    case. A paragraph that overlaps its component's first stays. Paragraphs of fewer than ``shortest`` words are no
    duplicates: 1 counts all; a larger number leaves licence lines and greetings to line filters.

    Rows with a null doc_id or text are left out; rows that repeat a doc_id and text count once; texts without words
    have no paragraphs; an empty table gives none; other columns are not read. One text is one row of a task, however
    long. Contents and runs are told by two independent 64-bit hashes of their words, shingles by one.
    """
    space = Workspace(docs.sparkSession, "paragraphs")
    held = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    copies = copied_paragraphs(held, space, least, recall, shortest)
    gone = (F.col("doc") != F.col("keep.doc")) | (F.col("place") >= F.col("keep.place") + F.col("keep.size"))
    copies = copies.select("doc", F.col("place").alias("begin"), (F.col("place") + F.col("size")).alias("end"), F.col("keep.doc").alias("keeper"), gone.alias("gone"), F.lit(1).alias("n"))
    passages = repeated_runs(held, space, length).select("doc", "begin", "end", F.col("low").alias("keeper"), (F.col("doc") != F.col("low")).alias("gone"), F.lit(0).alias("n"))
    spans = islands(copies.unionByName(passages), "doc", "gone").groupBy("doc", "gone", "island")
    spans = spans.agg(F.sum("n").alias("n"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.collect_set("keeper").alias("keepers"))
    return spans.groupBy(F.col("doc").alias("doc_id")).agg(
        F.sum("n").alias("n_paragraphs"), F.sum(F.when(F.col("gone"), F.col("n")).otherwise(0)).alias("n_removed"),
        F.sort_array(F.collect_list(F.when(F.col("gone"), F.struct("begin", "end")))).alias("removed"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("keepers")))).alias("keepers"),
    )
