"""Vector code compression: product codes whose nearest entries are found by metric trees.

Vectors are cut into equal parts, and each part position has a small codebook. The entries of a position stand in a
vantage-point tree: a node's entry divides the rest into a near and a far half, and keeps for each half the least and the
greatest distance from itself, rounded outwards. A subtree is visited unless its bound exceeds the best distance
found, ties included, and the best is always decided by squared distances in integers, then by the lower index. The trees
hold at most ``ENTRIES`` entries for each position, whatever the table's size, so they travel with the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries that a tree's leaf holds at most.
LEAF = 6
#: Greatest component after scaling: sums of squared differences then fit 64 bits.
MOST = 1 << 27
#: Relative width by which bounds are rounded outwards, far above the error of a square root in doubles.
SLACK = 1e-9
#: Rows that one step of a task assigns.
STEP = 8192


@dataclass
class Node:
    """Subtree of a position's entries; a leaf has only members. Bounds: distances from the vantage to each half."""

    members: np.ndarray
    vantage: int = -1
    near: Node | None = None
    far: Node | None = None
    near_bounds: tuple[float, float] = (0.0, 0.0)
    far_bounds: tuple[float, float] = (0.0, 0.0)


def squared(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    d = points - entry
    return (d * d).sum(axis=1)


def built(entries: np.ndarray, members: np.ndarray | None = None) -> Node:
    """Vantage-point tree over the rows of ``entries`` (integers)."""
    members = np.arange(len(entries)) if members is None else members
    if len(members) <= LEAF:
        return Node(members)
    # The entry farthest from the mean divides the others most evenly.
    vantage = int(members[np.argmax(((entries[members] - entries[members].mean(axis=0)) ** 2).sum(axis=1))])
    rest = members[members != vantage]
    d = np.sqrt(squared(entries[rest], entries[vantage]).astype("float64"))
    order = np.argsort(d, kind="stable")
    half = len(rest) // 2
    bounds = [(d[x].min() * (1 - SLACK), d[x].max() * (1 + SLACK)) for x in (order[:half], order[half:])]
    return Node(members, vantage, built(entries, np.sort(rest[order[:half]])), built(entries, np.sort(rest[order[half:]])), *bounds)


def nearest(points: np.ndarray, entries: np.ndarray, tree: Node) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each point, the lower index on ties."""
    best = np.full(len(points), np.iinfo("int64").max)
    index = np.full(len(points), len(entries), "int64")

    def meet(rows: np.ndarray, entry: int) -> np.ndarray:
        d = squared(points[rows], entries[entry])
        better = (d < best[rows]) | ((d == best[rows]) & (entry < index[rows]))
        best[rows[better]], index[rows[better]] = d[better], entry
        return d

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.vantage < 0:
            for entry in node.members:
                meet(rows, int(entry))
            return
        d = np.sqrt(meet(rows, node.vantage).astype("float64"))
        halves = [(node.near, node.near_bounds), (node.far, node.far_bounds)]
        bounds = [np.maximum(d * (1 - SLACK) - high, low - d * (1 + SLACK)) for _, (low, high) in halves]
        # Every row takes the half with the lesser bound first: what it finds there may spare the other.
        first = bounds[0] <= bounds[1]
        for half, own in ((0, first), (1, ~first), (1, first), (0, ~first)):
            reach = np.sqrt(best[rows].astype("float64")) * (1 + SLACK)
            visit(halves[half][0], rows[own & (bounds[half] <= reach)])

    visit(tree, np.arange(len(points)))
    return index, best


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype("int64").reshape(len(column), -1)


def _assigned(books: list[np.ndarray], trees: list[Node], points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances) of rows of parts, a column for each position."""
    width = points.shape[1] // len(books)
    found = [nearest(np.ascontiguousarray(points[:, p * width : (p + 1) * width]), book, tree) for p, (book, tree) in enumerate(zip(books, trees))]
    return np.stack([x for x, _ in found], axis=1), np.stack([x for _, x in found], axis=1)


def _sums(books: list[np.ndarray]) -> Callable:
    """Task function: part, entry, n and sums of the parts assigned, one row for each entry used in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, width = [built(b) for b in books], books[0].shape[1]
        total, count = np.zeros((len(books), len(books[0]), width), "int64"), np.zeros((len(books), len(books[0])), "int64")
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                points = _matrix(batch.column(0).slice(at, STEP))
                codes, _ = _assigned(books, trees, points)
                for p in range(len(books)):
                    np.add.at(total[p], codes[:, p], points[:, p * width : (p + 1) * width])
                    count[p] += np.bincount(codes[:, p], minlength=count.shape[1])
        part, entry = np.nonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(0, len(part) * width + 1, width, dtype="int32")), pa.array(total[part, entry].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), sums], names=["part", "entry", "n", "sums"])

    return run


def _codes(books: list[np.ndarray]) -> Callable:
    """Task function: vec_id, label, code and error of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [built(b) for b in books]
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                rows = batch.slice(at, STEP)
                codes, errors = _assigned(books, trees, _matrix(rows.column(2)))
                text = [row.tobytes().hex() for row in codes.astype("uint8")]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(text, pa.string()), pa.array(errors.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return run


def kept_vectors(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """vec_id, label and v (integers floor(scale * x)) of the vectors that can be coded."""
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    held = vectors.filter(whole & F.coalesce(finite, F.lit(False))).select("vec_id", "label", scaled.alias("v"))
    over = F.exists("v", lambda x: (x > MOST) | (x < -MOST))
    return held.withColumn("v", F.when(over, F.raise_error(F.concat(F.lit(f"a component of a vector exceeds {MOST // scale}: vec_id "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))))).otherwise(F.col("v")))


def codebooks(held: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebook of every part position after ``rounds`` of assignment and mean; [] without vectors."""
    # At most ``entries`` rows, and parts x entries sums a round, reach the driver.
    def smallest(rows: DataFrame) -> list:
        return rows.filter("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(entries).collect()

    first = smallest(held)
    if not first:
        return []
    size = len(first[0].v)
    if any(len(r.v) != size for r in first):
        first = smallest(held.filter(F.size("v") == size))
    start = np.array([r.v for r in first], "int64")
    books = [np.ascontiguousarray(x) for x in np.split(start, parts, axis=1)]
    for _ in range(rounds):
        used = held.filter(F.size("v") == size).select("v").mapInArrow(_sums(books), "part bigint, entry bigint, n bigint, sums array<bigint>")
        dims = [F.sum(F.col("sums")[i]) for i in range(size // parts)]
        for r in used.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*dims).alias("sums")).collect():
            books[r.part][r.entry] = [x // r.n for x in r.sums]
    return books


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Product code of every vector: vec_id, label, code, error, label_error, codebooks_sha256.

    ``vectors`` has vec_id, embedding, label. Codebooks start as the parts of the vectors with the ``entries`` smallest
    vec_ids; each round assigns every part to its nearest entry and replaces the entries used by the floor of the mean.
    ``entries`` is 256 at most: a code has two hex digits for each part. label_error is the error summed over the rows
    of one label, null being a label.

    Vectors that are null or empty, hold null or non-finite components, or cannot be cut into ``parts`` equal parts are
    left out; so are vectors of another length than that of the smallest vec_id. A component over 2^27 after scaling is
    an error, as its squares exceed 64 bits. Rows without a vec_id are coded but start no codebook; of rows that
    share one, the least vector does. Repeated rows repeat; fewer rows than entries make smaller codebooks; tables
    without a vec_id give no rows; other columns are not read.
    """
    spark, space = vectors.sparkSession, Workspace(vectors.sparkSession, "vector-codes")
    held = kept_vectors(vectors, parts, scale)
    ident, label = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    schema = f"vec_id {ident}, label {label}, code string, error bigint"
    books = codebooks(held, parts, entries, rounds)
    if not books:
        return spark.createDataFrame([], f"{schema}, label_error bigint, codebooks_sha256 string")
    name = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    size = len(books) * books[0].shape[1]
    coded = space.save(held.filter(F.size("v") == size).mapInArrow(_codes(books), schema), "coded")
    # Tables on both sides: Spark knows their sizes, and a label of a third of all rows can be split.
    totals = space.save(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "totals")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "label", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))
