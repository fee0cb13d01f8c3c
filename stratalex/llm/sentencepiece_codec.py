"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The best segmentation under the model's own piece scores is found left to right. Only boundaries within one piece
length of the current position can still start a piece; as soon as the best paths to all of them pass through
one common boundary, the ids up to it are final and are committed, so memory is bounded by the window, not the text.
The stretches between boundaries that every path has (between characters that stand side by side in no piece) are
searched once and kept for the next time they occur.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "\u2581"
#: A space mark that the text itself holds. It is spelled in bytes, so that decoding gives it back.
LITERAL_SPACE = "\udc81"
#: Segments whose ids are kept between texts in each Python worker (some 200 MB at most), and the length up to which they are kept.
MOST_CACHED, LONGEST_CACHED = 800_000, 40
#: Ids in one output batch.
BATCH_IDS = 400_000
_CODECS: dict = {}


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """Encoder and decoder over the pieces and scores of one model file.

    ``pieces``: (piece, score, kind) by id, kind one of normal, byte, unknown, control. Ties go to the
    segmentation whose last differing piece is longer, as in the unigram decoder of the public library.
    """

    def __init__(self, pieces: list[tuple[str, float, str]], prefix: bool = True):
        self.prefix = prefix
        self.known = {p: (i, s) for i, (p, s, kind) in enumerate(pieces) if kind == "normal"}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == "unknown"), 0)
        self.unknown_score = min((s for _, s, kind in pieces if kind == "normal"), default=0.0) - 10.0
        self.longest = max(map(len, self.known), default=1)
        self.raw = [bytes([int(p[3:5], 16)]) if kind == "byte" else p.replace(SPACE, " ").encode() if kind == "normal" else b"" if kind == "control" else b" \xe2\x81\x87 " for p, _, kind in pieces]
        self.cache: dict[str, tuple[int, ...]] = {}
        self.committed = 0  # characters whose ids the search has found, those from the cache not counted
        # Nodes (next characters, id or -1, score): a search from a start ends where no piece goes on.
        self.trie: list = [{}, -1, 0.0]
        for piece, (i, s) in self.known.items():
            node = self.trie
            for char in piece:
                node = node[0].setdefault(char, [{}, -1, 0.0])
            node[1:] = i, s
        # Characters that stand side by side within some piece; between others every path has a boundary.
        self.joined = {p[i : i + 2] for p in self.known for i in range(len(p) - 1)}
        # Where no piece runs over a space mark that follows another character, every path has a boundary before it; so
        # it has on both sides of a line feed that stands beside nothing in any piece.
        free = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.known)
        alone = "" if any("\n" in pair for pair in self.joined) else "\n"
        self.segments = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|{alone}" if alone else "") if free else r"(?s:.+)").findall

    @classmethod
    def load(cls, path: str | None = None) -> Codec:
        if path not in _CODECS:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path or model_path())
            kind = lambda i: "byte" if sp.is_byte(i) else "unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) or sp.is_unused(i) else "normal"
            _CODECS[path] = cls([(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())])
        return _CODECS[path]

    def _spell(self, char: str) -> list[int]:
        raw = SPACE.encode() if char == LITERAL_SPACE else char.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in raw] if len(self.bytes) == 256 else [self.unknown]

    def stream(self, text: str) -> Iterator[list[int]]:
        """Ids of ``text`` in parts, each as soon as it is final.

        The lists hold the boundaries from ``done``, the last final one, to ``reach``, the last that a piece has come
        to. Where no piece goes past the current boundary it is the only one alive, so all paths meet in it.
        Elsewhere the paths are followed back to where they meet, once in every two piece lengths.
        """
        first, longest, unknown, n = self.trie[0].get, self.longest, self.unknown_score, len(text)
        score, came, by, done, reach = [0.0], [0], [-1], 0, 0
        for start in range(n):
            if start == reach and start > done:
                yield self._path(text, came, by, start, done)
                score, came, by, done = [0.0], [0], [-1], start
            elif start - done >= 2 * longest and (start - done) % (2 * longest) == 0:
                at = self._meeting(came, [k for k in range(start, reach + 1) if score[k - done] > -1e299], done)
                if at > done:
                    yield self._path(text, came, by, at, done)
                    low, cut, done = min(score[start - done :]), at - done, at
                    score, came, by = [x - low for x in score[cut:]], came[cut:], by[cut:]
            here, end, node = score[start - done], start + 1, first(text[start])
            if end > reach:
                score.append(-1e300)
                came.append(0)
                by.append(-1)
                reach = end
            if (node is None or node[1] < 0) and here + unknown > score[end - done]:
                score[end - done], came[end - done], by[end - done] = here + unknown, start, -1
            while node is not None:
                if node[1] >= 0:
                    while end > reach:
                        score.append(-1e300)
                        came.append(0)
                        by.append(-1)
                        reach += 1
                    if here + node[2] > score[end - done]:
                        score[end - done], came[end - done], by[end - done] = here + node[2], start, node[1]
                if end == n:
                    break
                node = node[0].get(text[end])
                end += 1
        if n > done:
            yield self._path(text, came, by, n, done)

    @staticmethod
    def _meeting(came: list[int], alive: list[int], done: int) -> int:
        """The last boundary that the best paths to all boundaries of ``alive`` share."""
        paths = set(alive)
        while len(paths) > 1:
            last = max(paths)
            paths.discard(last)
            paths.add(came[last - done])
        return max(paths.pop(), done)

    def _path(self, text: str, came: list[int], by: list[int], end: int, done: int) -> list[int]:
        out: list[int] = []
        self.committed += end - done
        while end > done:
            piece, before = by[end - done], came[end - done]
            if piece >= 0:
                out.append(piece)
            else:
                out += self._spell(text[before])[::-1]
            end = before
        return out[::-1]

    def encode(self, text: str, into: array | None = None) -> array:
        """Ids of ``text``. An empty text has none."""
        out = array("i") if into is None else into
        if not text:
            return out
        marked = text.replace(SPACE, LITERAL_SPACE).replace(" ", SPACE)
        segments = self.segments(SPACE + marked if self.prefix else marked)
        found = list(map(self.cache.get, segments))
        if None in found:
            found = [self.cache.get(s) or self._segment(s) if ids is None else ids for s, ids in zip(segments, found)]
        out.extend(chain.from_iterable(found))
        return out

    def _segment(self, segment: str) -> tuple[int, ...]:
        """Ids of a segment that is not cached: of its parts between certain boundaries, which may be."""
        cache, joined, n = self.cache, self.joined, len(segment)
        cuts = [i for i in range(1, n) if segment[i - 1 : i + 1] not in joined]
        if cuts:
            ids: list[int] = []
            for a, b in zip([0, *cuts], [*cuts, n]):
                part = segment[a:b]
                known = cache.get(part)
                ids += self._part(part) if known is None else known
            return tuple(ids) if n > LONGEST_CACHED else self._keep(segment, tuple(ids))
        return self._part(segment)

    def _part(self, part: str) -> tuple[int, ...]:
        ids = tuple(i for some in self.stream(part) for i in some)
        return ids if len(part) > LONGEST_CACHED else self._keep(part, ids)

    def _keep(self, text: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(self.cache) >= MOST_CACHED:
            self.cache.clear()
        self.cache[text] = ids
        return ids

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def encode(docs: DataFrame, path: str | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip and ``carried`` columns of every row of ``docs``; round_trip: decoding gives the text back.

    Whole texts are encoded; null counts as empty and has no ids; repeated rows repeat; an empty table gives none;
    other columns are not read. The model's path is a parameter; the file is read where the tasks run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path)
        for batch in batches:
            ids, ends, fine, first = array("i"), [0], [], 0
            for row, x in enumerate(batch.column(1)):
                text = (x.as_py() or "") if x.is_valid else ""
                codec.encode(text, ids)
                fine.append(codec.decode(ids[ends[-1] :]) == text)
                ends.append(len(ids))
                if len(ids) >= BATCH_IDS or row == batch.num_rows - 1:
                    values = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids.tobytes())])
                    lengths = [b - a for a, b in zip(ends, ends[1:])]
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                    ident, *more = (batch.column(k).slice(first, row + 1 - first) for k in (0, *range(2, batch.num_columns)))
                    yield pa.RecordBatch.from_arrays([ident, pa.array(lengths, pa.int64()), lists, pa.array(fine), *more], names=["doc_id", "n_tokens", "ids", "round_trip", *carried])
                    ids, ends, fine, first = array("i"), [0], [], row + 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return docs.select("doc_id", "text", *carried).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids array<int>, round_trip boolean{more}")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text from the ids of ``encoded``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path)
        for batch in batches:
            texts = [codec.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
