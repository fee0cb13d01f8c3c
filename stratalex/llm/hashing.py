"""Words and word shingles of many texts at once as hashes, in linear time and small memory.

A word has two hashes of 64 bits, made from its bytes with different keys: each is a chain of mixed blocks of eight
bytes, and a word over ``LONG`` bytes is digested by BLAKE2. Both are fixed functions: no pattern in a text (periods,
complements, repeats) makes two of them agree, so unequal things agree by chance, 2^-64 for one hash and 2^-128 for both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_MASK = (1 << 64) - 1
#: Keys of the two hashes.
KEYS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bytes that one step works on; a longer text is cut between words, a longer word is not cut.
STEP = 1 << 21
#: Bytes up to which words are hashed side by side.
LONG = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two hashes, the order of which counts."""
    return mixed(mixed(left + U(KEYS[0])) * U(KEYS[1] | 1) + right)


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int) -> np.ndarray:
    """64 bits of the bytes from each ``start`` to its ``end``."""
    n = end - start
    out = mixed(n.astype(U) + U(key))
    blocks = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, "uint8")]), strides=(1,))
    cut = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
    some, at = np.flatnonzero(n <= LONG), 0
    while True:
        some = some[n[some] > at]
        if not len(some):
            break
        out[some] = mixed((out[some] * U(key | 1)) ^ (blocks[start[some] + at] & cut[np.minimum(n[some] - at, 8)]))
        at += 8
    for i in np.flatnonzero(n > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8, salt=key.to_bytes(8, "little")).digest(), "little")
    return out


def spans_named(h: np.ndarray, begin: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64 bits of the hashes from each ``begin`` to its ``end`` (one at least), in linear time for each doubling of length.

    Windows of a power of two are named by their halves; two of them that overlap cover a span.
    """
    size, out, level = end - begin, np.zeros(len(begin), U), mixed(h + U(salt))
    if not len(size):
        return out
    power, last = np.frexp(size.astype("float64"))[1] - 1, 0  # whole part of the logarithm
    for k in range(int(power.max()) + 1):
        if k:
            level = paired(level[: len(level) - last], level[last:])
        last = 1 << k
        some = np.flatnonzero(power == k)
        if len(some):
            out[some] = paired(paired(level[begin[some]], level[end[some] - last]), size[some].astype(U))
    return out


class Words:
    """Words of a run of texts: text (row in the run), start and end (bytes in the run's data), hash and, if asked for, other."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, both: bool = False):
        self.data, self.offsets = data, offsets
        parts, at, n = [], 0, len(data)
        while at < n:
            stop = min(n, at + STEP)
            if stop < n:
                white = np.flatnonzero(_white(data[at:stop]))
                cuts = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, stop, "right")]
                last = max(at + white[-1] + 1 if len(white) else 0, cuts[-1] if len(cuts) else 0)
                while last <= at:  # one word fills the step
                    stop = min(n, stop + STEP)
                    more = np.flatnonzero(_white(data[at:stop]))
                    cuts = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, stop, "right")]
                    last = max(at + more[0] + 1 if len(more) else 0, cuts[0] if len(cuts) else 0, n if stop == n else 0)
                stop = int(last)
            parts.append(_words(data, offsets, at, stop, lower, both))
            at = stop
        self.start, self.end, self.hash, self.other = (np.concatenate(x) if parts else np.zeros(0, k) for x, k in zip(zip(*parts) if parts else ((),) * 4, ("int64", "int64", U, U)))
        self.text = np.searchsorted(offsets, self.start, "right") - 1

    def count(self) -> np.ndarray:
        return np.bincount(self.text, minlength=len(self.offsets) - 1)


def _white(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b >= 9) & (b <= 13))


def _words(data, offsets, at, stop, lower, both):
    b = data[at:stop]
    word = ~_white(b)
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = offsets[np.searchsorted(offsets, at, "left") : np.searchsorted(offsets, stop, "left")] - at
    first[heads] |= word[heads]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if lower:
        b = np.where((b >= 65) & (b <= 90), b + 32, b)
    h = byte_hashes(b, start, end, KEYS[0])
    return start + at, end + at, h, byte_hashes(b, start, end, KEYS[1]) if both else h


def runs(texts: pa.Array, most: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, data, offsets) of runs of rows of at most ``most`` bytes, one row at least. Null is empty."""
    if pa.types.is_large_string(texts.type):
        wide = texts
    else:
        wide = texts.cast(pa.large_string())
    wide = pa.compute.fill_null(wide, "")
    offsets = np.frombuffer(wide.buffers()[1], "int64")[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, "int64")
    data = np.frombuffer(wide.buffers()[2], "uint8") if len(wide) and wide.buffers()[2] is not None and wide.buffers()[2].size else np.zeros(0, "uint8")
    at = 0
    while at < len(wide):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, other hash) of every run of ``width`` words; of a text with fewer words, all of them as one."""
    text, n = words.text, len(words.hash)
    count = words.count()
    first = np.cumsum(count) - count
    begin = np.flatnonzero(text[: n - width + 1] == text[width - 1 :]) if n >= width else np.zeros(0, "int64")
    short = np.flatnonzero((count > 0) & (count < width))
    out = [np.concatenate([sequences(h, begin, width), *(sequences(h, first[short[count[short] == k]], k) for k in range(1, width))]) for h in (words.hash, words.other)]
    return np.concatenate([text[begin], *(short[count[short] == k] for k in range(1, width))]), *out


def sequences(h: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` hashes from each ``begin``."""
    total = np.full(len(begin), U(size))
    for i in range(size):
        total += mixed(h[begin + i] + U(i + 1)) * U((0xA0761D6478BD642F * (2 * i + 1)) & _MASK | 1)
    return mixed(total)


def distinct(text: np.ndarray, h: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct (text, hash) in order, each with its other hash if given."""
    order = np.lexsort((h, text))
    out = [x[order] for x in (text, h) + (() if other is None else (other,))]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (out[1][1:] != out[1][:-1]) | (out[0][1:] != out[0][:-1])
        out = [x[new] for x in out]
    return tuple(out)
