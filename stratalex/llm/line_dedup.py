"""Line dedup by levelled sorted runs of line digests.

Documents come in batches. A batch's lines are counted by key, merge-anti-joined against the runs (a key that a run
already holds as common needs no further count) and added as a sorted run of its own. Two runs of one level are compacted
into one of the next by a merge join. Runs are bucketed and sorted by key, so neither step shuffles a run. A key's
documents are the sum over the runs; each row of the documents is in one batch, so every count is exact.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE_CHARS, Workspace, shuffle_width

#: Documents from which a line is common; batches that the documents are dealt into.
LEAST, BATCHES = 10, 8
_WHITE = WHITE_CHARS.encode()


def line_key(line: bytes) -> bytes:
    """A line without white space at its ends, A-Z lower-cased; empty for a blank line."""
    return line.strip(_WHITE).lower()  # bytes: ASCII letters only


def digest(key: bytes) -> bytes:
    """128 bits that stand for a key; a cryptographic digest, so no two keys of a corpus share one."""
    return hashlib.md5(key, usedforsecurity=False).digest()


def _texts(column: pa.Array) -> Iterator[bytes]:
    for text in column.cast(pa.large_binary()):
        yield (text.as_py() if text.is_valid else b"") or b""


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, deal and key: the distinct keys of every row's lines."""
    for batch in batches:
        rows, keys = [], []
        for row, text in enumerate(_texts(batch.column(2))):
            own = {line_key(line) for line in text.split(b"\n")} - {b""}
            keys += map(digest, own)
            rows += [row] * len(own)
            if len(keys) > 200_000 or row == batch.num_rows - 1:
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(keys, pa.binary())], names=["id", "deal", "key"])
                rows, keys = [], []


class LineRuns:
    """Sorted runs (key, n): how many documents hold each line, in levels of doubling size.

    ``add`` takes the next batch, one row (key) for each document that holds a line; ``common`` gives the keys that
    ``least`` documents hold. Runs are tables in the shared folder.
    """

    def __init__(self, space: Workspace, least: int = LEAST):
        self.space, self.least, self.buckets = space, least, shuffle_width(space.spark)
        self.levels: list[str | None] = []

    def add(self, lines: DataFrame) -> None:
        counted = lines.groupBy("key").agg(F.count("*").alias("n"))
        for run in filter(None, self.levels):
            settled = self.space.spark.table(run).filter(F.col("n") >= self.least).select("key")
            counted = counted.join(settled.hint("merge"), "key", "left_anti")
        run = self._write(counted)
        for level, other in enumerate(self.levels):
            if other is None:
                self.levels[level] = run
                return
            self.levels[level], run = None, self._merged(other, run)
        self.levels.append(run)

    def common(self) -> DataFrame:
        """Keys of at least ``least`` documents. All runs are compacted into one."""
        whole = None
        for run in filter(None, self.levels):
            whole = run if whole is None else self._merged(whole, run)
        self.levels = [whole] if whole else []
        if whole is None:
            return self.space.spark.createDataFrame([], "key binary")
        return self.space.spark.table(whole).filter(F.col("n") >= self.least).select("key")

    def close(self) -> None:
        for run in filter(None, self.levels):
            self._drop(run)
        self.levels = []

    def _merged(self, one: str, two: str) -> str:
        a, b = (self.space.spark.table(x).withColumnRenamed("n", n) for x, n in ((one, "a"), (two, "b")))
        both = a.join(b.hint("merge"), "key", "full").select("key", (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("n"))
        run = self._write(both)
        self._drop(one)
        self._drop(two)
        return run

    def _write(self, rows: DataFrame) -> str:
        name = f"lines_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.space.root}/{name}").format("parquet").saveAsTable(name)
        return name

    def _drop(self, run: str) -> None:
        self.space.spark.sql(f"DROP TABLE {run}")
        self.space.drop(run)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_lines, n_dropped and text without the lines whose keys a row brings along."""
    for batch in batches:
        lines, dropped, texts, size, first = [], [], [], 0, 0
        for row, (text, keys) in enumerate(zip(_texts(batch.column(1)), batch.column(2))):
            every = text.split(b"\n")
            gone = set(keys.as_py() or ()) if keys.is_valid else ()
            kept = [line for line in every if not (key := line_key(line)) or digest(key) not in gone] if gone else every
            lines.append(len(every))
            dropped.append(len(every) - len(kept))
            texts.append(b"\n".join(kept))
            size += len(text)
            if size > 1 << 24 or row == batch.num_rows - 1:
                columns = [batch.column(0).slice(first, row + 1 - first), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_lines", "n_dropped", "text"])
                lines, dropped, texts, size, first = [], [], [], 0, row + 1


def drop_common_lines(docs: DataFrame, least: int = LEAST, batches: int = BATCHES) -> DataFrame:
    """Every document without the lines that at least ``least`` documents hold.

    One row per row of ``docs``: doc_id, n_lines (lines between \\n, before dropping), n_dropped and text (lines left,
    joined by \\n). Lines are equal when their keys are: without white space at both ends, A-Z lower-cased. Blank lines
    always stay; a line that one document repeats counts once, and all its places go. Every row is a document of its own,
    repeated rows and rows that share a doc_id or have none included. A null or empty text is one empty line; an
    empty table gives none; other columns are not read. One text is one row of a task, however long.
    """
    spark, space = docs.sparkSession, Workspace(docs.sparkSession, "lines")
    # Rows that share an id share their common lines; those are common for each of them.
    ident = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    held = docs.select("doc_id", "text", ident.alias("id"))
    dealt = held.select("id", F.pmod(F.spark_partition_id(), F.lit(batches)).cast("int").alias("deal"), "text")
    lines = space.save(dealt.mapInArrow(_digests, "id bigint, deal int, key binary"), "lines", by="deal")
    runs = LineRuns(space, least)
    for (deal,) in sorted(lines.select("deal").distinct().collect()):
        runs.add(lines.filter(F.col("deal") == deal).select("key"))
    common = space.save(runs.common(), "common")
    runs.close()
    # Both sides are tables, so that a line that a third of all documents hold can be split.
    gone = lines.select("id", "key").join(common.hint("merge"), "key").groupBy("id").agg(F.collect_set("key").alias("gone"))
    gone = space.save(gone, "gone")
    space.drop("lines", "common")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return held.join(gone.hint("merge"), "id", "left").select("doc_id", "text", "gone").mapInArrow(_without, f"doc_id {kind}, n_lines bigint, n_dropped bigint, text string")
