"""Cross-tokenizer alignment by an event sweep.

Each text is encoded by two tokenizers, A (byte-level) and B (pieces). The ends of their tokens are events on the
bytes of the text; events travel in blocks (document, offset, side, ids), are dealt by document, sorted by offset
inside each partition and streamed through a machine. Where both sides end a group closes: the machine emits
its ids, and a link for each stretch between neighbouring events, as exactly one token of either side covers it. Its
state is the tokens of the open group and at most a few blocks, beside a document's distinct links.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Events in a block, events that the machine gathers before it sweeps.
BLOCK, GATHER = 2048, 1 << 16
#: Id pairs up to which their counts are broadcast (16 bytes each); beyond, a merge join looks them up.
MOST_BROADCAST = 1 << 21
#: Ids or links that one emitted batch holds.
BATCH = 1 << 20
#: Characters outside these blocks may be letters to one Unicode version and unassigned to another.
_RECENT = re.compile("[^\x00-ԯ -⁯₠-₽℀-⅏←-⏿─-➿　-ㄭㄱ-ㆎ一-龥가-힣️＀-￯\U0001f300-\U0001f6ff\U0001f900-\U0001f9ff]")
_LOADED: dict = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Side A: ids and bytes of a byte-level vocabulary in a tokenizer file.

    Ids of merges ascend in the order of the merges, so the ids serve as ranks of a faster encoder of the same vocabulary;
    texts with characters that a Unicode version might class otherwise go through the file's own library.
    """

    def __init__(self, path: str | None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path("byte_bpe_50k.json")
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        letters, special = byte_letters(), {t["content"] for t in held["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in special}
        self.bytes = [b""] * (max(ranks.values()) + 2)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True

    def encode(self, text: str) -> list[int]:
        if _RECENT.search(text):
            return self.own.encode(" " + text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(" " + text)


class Pieces:
    """Side B: ids and bytes of a SentencePiece model, which puts the space before the text itself."""

    def __init__(self, path: str | None):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


def sides(a_path: str | None = None, b_path: str | None = None) -> tuple[ByteLevel, Pieces]:
    """Both tokenizers; read once in each Python worker."""
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = ByteLevel(a_path), Pieces(b_path)
    return _LOADED[a_path, b_path]


def _tokens(text: str, both, sizes: list[np.ndarray]) -> list[np.ndarray]:
    """Ids of either side; none where a side's bytes are not those of a space and the text."""
    if not text:
        return []
    a, b, whole = both[0].encode(text), both[1].encode(text), b" " + text.encode()
    known, ids = both[1].bytes, [np.asarray(a, "int32"), np.array(b, "int32")]
    # A's tokens are pieces of the text's own bytes in order, so only their number can differ.
    if int(sizes[0][ids[0]].sum()) != len(whole) or b"".join([known[i] for i in b]) != whole:
        return []
    return ids


def _events(a_path, b_path):
    """row, doc_id, first (offset of the first token), side and ids of blocks of tokens; a row without tokens has one empty block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(a_path, b_path)
        sizes, kind = _sizes(both), _kind(both)
        for batch in batches:
            held, n = [], 0
            for i, text in enumerate(batch.column(2)):
                tokens = _tokens((text.as_py() or "") if text.is_valid else "", both, sizes)
                for side, ids in enumerate(tokens):
                    starts = np.cumsum(sizes[side][ids]) - sizes[side][ids]
                    held += [(i, int(starts[at]), side, ids[at : at + BLOCK].astype(kind).tobytes()) for at in range(0, len(ids), BLOCK)]
                    n += len(ids)
                if not tokens:
                    held.append((i, 0, 0, b""))
                if n > BATCH or i == batch.num_rows - 1:
                    at, first, side, ids = zip(*held)
                    rows = pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first, pa.int64()), pa.array(side, pa.int32()), pa.array(ids, pa.binary())], names=["row", "doc_id", "first", "side", "ids"])
                    held, n = [], 0

    return run


class Sweep:
    """The machine over one document's blocks in the order of their offsets."""

    def __init__(self, sizes: list[np.ndarray]):
        self.sizes, self.ids, self.ends, self.n = sizes, [[], []], [[], []], 0
        self.tokens = [0, 0]

    def feed(self, side: int, first: int, ids: np.ndarray) -> None:
        self.ids[side].append(ids)
        self.ends[side].append(first + np.cumsum(self.sizes[side][ids]))
        self.tokens[side] += len(ids)
        self.n += len(ids)

    def closed(self) -> Closed:
        """The groups that are whole by now; the tokens of the open one are kept."""
        (a, b), (a_ends, b_ends) = ([np.concatenate(x) if x else np.zeros(0, "int64") for x in y] for y in (self.ids, self.ends))
        over_a, over_b = np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)
        last_a = np.append(b_ends, -1)[over_a] == a_ends
        last_b = np.append(a_ends, -1)[over_b] == b_ends
        n_a, n_b = (int(np.flatnonzero(x)[-1]) + 1 if x.any() else 0 for x in (last_a, last_b))
        self.ids, self.ends = ([[x[n:]] if n < len(x) else [] for x, n in zip(y, (n_a, n_b))] for y in ((a, b), (a_ends, b_ends)))
        self.n = len(a) - n_a + len(b) - n_b
        return Closed(a[:n_a], b[:n_b], a_ends[:n_a], over_a[:n_a], over_b[:n_b], last_a[:n_a], last_b[:n_b])


@dataclass
class Closed:
    """Tokens of whole groups: ids of either side, A's ends, the token of the other side under each end, and which end a group."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    over_a: np.ndarray
    over_b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(A id, B id) of every pair of tokens whose byte ranges overlap: one for each stretch between neighbouring ends."""
        inner = ~self.last_b
        return np.concatenate([self.a, self.a[self.over_b[inner]]]), np.concatenate([self.b[self.over_a], self.b[inner]])

    def cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each group begins in either side's tokens, and the end of the last."""
        return tuple(np.append(0, np.flatnonzero(x) + 1) for x in (self.last_a, self.last_b))


class Spelling:
    """Groups as text: A's ids, a bar, B's ids, and a semicolon after each group."""

    def __init__(self, sizes: list[np.ndarray]):
        names = [str(i).encode() for i in range(max(map(len, sizes)))]
        self.length = np.array([len(x) for x in names])
        self.width = int(self.length.max()) + 1
        self.digits = np.frombuffer(b"".join(x.ljust(self.width) for x in names), "uint8").reshape(len(names), self.width)

    def __call__(self, groups: Closed) -> bytes:
        (begin_a, begin_b), n = groups.cuts(), len(groups.a) + len(groups.b)
        ids, ends = np.empty(n, "int64"), np.empty(n, "uint8")
        # A group's A tokens come after the B tokens of the groups before, its B tokens after its own A tokens.
        at_a = np.arange(len(groups.a)) + begin_b[np.cumsum(groups.last_a) - groups.last_a]
        at_b = np.arange(len(groups.b)) + begin_a[np.cumsum(groups.last_b) - groups.last_b + 1]
        ids[at_a], ids[at_b] = groups.a, groups.b
        ends[at_a], ends[at_b] = np.where(groups.last_a, ord("|"), ord(",")), np.where(groups.last_b, ord(";"), ord(","))
        length = self.length[ids]
        letters = self.digits[ids]
        letters[np.arange(n), length] = ends
        return letters[np.arange(self.width) <= length[:, None]].tobytes()


def _sizes(both) -> list[np.ndarray]:
    """Bytes of each token of either side."""
    return [np.array([len(x) for x in side.bytes], "int64") for side in both]


def _kind(both) -> str:
    """The smallest integers that hold the ids of both sides."""
    return "<u2" if max(len(side.bytes) for side in both) <= 1 << 16 else "<u4"


def _documents(a_path, b_path, emit):
    """Task function over sorted blocks: ``emit(machine, sizes)`` is a generator per task that is sent (doc_id, closed groups or None at the end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, kind = _sizes(sides(a_path, b_path)), _kind(sides(a_path, b_path))
        out, row, doc, sweep = emit(sizes), None, None, None
        for batch in batches:
            for r, d, first, side, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if r != row:
                    if sweep:
                        yield from out.end(row, doc, sweep)
                    row, doc, sweep = r, d, Sweep(sizes)
                if ids:
                    sweep.feed(side, first, np.frombuffer(ids, kind))
                if sweep.n > GATHER:
                    yield from out.groups(row, doc, sweep.closed())
        if sweep:
            yield from out.end(row, doc, sweep)
        yield from out.flush()

    return run


class _Digests:
    """Rows of counts, the digest of the groups' text, and the distinct links with how often each occurs."""

    def __init__(self, sizes):
        self.spelling, self.width, self.rows, self.size = Spelling(sizes), len(sizes[1]), [], 0
        self._new()

    def _new(self):
        self.hash, self.n_groups, self.n_links, self.found, self.times = hashlib.sha256(), 0, 0, [], []

    def groups(self, row, doc, closed):
        if len(closed.a):
            self.hash.update((b";" if self.n_groups else b"") + self.spelling(closed)[:-1])
            left, right = closed.links()
            pairs = np.sort(left.astype("int64") * self.width + right)
            first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
            self.found.append(pairs[first])
            self.times.append(np.diff(np.append(first, len(pairs))))
            self.n_groups += int(closed.last_a.sum())
            self.n_links += len(pairs)
            if sum(map(len, self.found)) > 4 * GATHER:
                self._compact()
        return ()

    def _compact(self):
        found, at = np.unique(np.concatenate(self.found), return_inverse=True)
        self.found, self.times = [found], [np.bincount(at, np.concatenate(self.times), len(found)).astype("int64")]

    def end(self, row, doc, sweep):
        self.groups(row, doc, sweep.closed())
        if len(self.found) > 1:
            self._compact()
        found, times = (self.found[0], self.times[0]) if self.found else (np.zeros(0, "int64"), np.zeros(0, "int64"))
        self.rows.append((row, doc, *sweep.tokens, self.n_groups, self.n_links, self.hash.hexdigest() if self.n_groups else "", found, times))
        self.size += len(found)
        self._new()
        return self.flush() if self.size > BATCH or len(self.rows) > 10_000 else ()

    def flush(self):
        if not self.rows:
            return
        row, doc, n_a, n_b, n_groups, n_links, text, found, times = zip(*self.rows)
        ends, pairs = np.cumsum([0, *map(len, found)]).astype("int32"), np.concatenate(found)
        fields = [pa.array((pairs // self.width).astype("int32")), pa.array((pairs % self.width).astype("int32")), pa.array(np.concatenate(times).astype("int32"))]
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["a", "b", "times"]))
        counts = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)]
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(doc, pa.int64()), *counts, pa.array(text, pa.string()), lists], names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])
        self.rows, self.size = [], 0


class _Groups:
    """One row for each group: its byte range in the text and either side's ids."""

    def __init__(self, sizes):
        self.at = 0

    def groups(self, row, doc, closed):
        if not len(closed.a):
            return
        lists = [pa.ListArray.from_arrays(pa.array(cuts.astype("int32")), pa.array(ids.astype("int32"))) for cuts, ids in zip(closed.cuts(), (closed.a, closed.b))]
        end = closed.a_ends[closed.last_a]
        begin = np.concatenate([[self.at], end[:-1]])
        self.at = int(end[-1])
        # The text starts after the space that both sides see before it.
        yield pa.RecordBatch.from_arrays([pa.array([row] * len(end), pa.int64()), pa.array([doc] * len(end), pa.int64()), pa.array(np.maximum(begin - 1, 0)), pa.array(end - 1), *lists], names=["row", "doc_id", "begin", "end", "a", "b"])

    def end(self, row, doc, sweep):
        yield from self.groups(row, doc, sweep.closed())
        self.at = 0

    def flush(self):
        return ()


def events(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Blocks of token ends of both sides, dealt by document and sorted by offset in each partition.

    ``row`` is a number of the row of ``docs``, so rows that repeat or share a doc_id stay apart.
    """
    held = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = held.mapInArrow(_events(a_path, b_path), "row bigint, doc_id bigint, first bigint, side int, ids binary")
    return blocks.repartition("row").sortWithinPartitions("row", "first", "side")


def aligned_groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """The groups themselves: row, doc_id, begin, end (bytes of the text), a and b (ids), for each group of each text."""
    return events(docs, a_path, b_path).mapInArrow(_documents(a_path, b_path, _Groups), "row bigint, doc_id bigint, begin bigint, end bigint, a array<int>, b array<int>")


def token_alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Counts of every document's alignment: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Space and text are encoded by A, the text by B, without special tokens. Byte offsets where tokens of both end cut them
    into groups; tokens whose byte ranges overlap are linked. An id pair's count is the number of documents (rows)
    that hold it linked; n_best are the links whose count is the highest of their A id, ties included,
    and count_sum sums the counts over the links. groups_sha256 digests the groups' text, `a1,a2|b1;a3|b2,b3`.

    Null and empty texts, and those that either side does not give back byte for byte, have no tokens: zeros and an empty
    digest. Every row is a document of its own, repeated rows too; a null doc_id is returned as null; an empty table
    gives none; other columns are not read. Encoding holds one text, the machine one document's distinct links.
    """
    space = Workspace(docs.sparkSession, "alignment")
    schema = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links array<struct<a:int,b:int,times:int>>"
    aligned = space.save(events(docs, a_path, b_path).mapInArrow(_documents(a_path, b_path, _Digests), schema), "aligned")
    each = aligned.select("row", F.inline("links"))
    counts = space.save(each.groupBy("a", "b").agg(F.count("*").alias("count")), "counts")
    most = counts.groupBy(F.col("a").alias("_a")).agg(F.max("count").alias("most"))
    scored = space.save(counts.join(most, F.col("a") == F.col("_a")).select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")), "scored")
    # A document's links leave its task as one sum when the counts are broadcast.
    looked = each.join(scored.hint("broadcast" if scored.count() <= most_broadcast else "merge"), ["a", "b"])
    sums = looked.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("count") * F.col("times")).alias("count_sum"))
    return aligned.drop("links").join(space.save(sums, "sums"), "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256"
    )
