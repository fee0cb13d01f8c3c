"""Terminology over whole texts: a pinned version of a term table, words looked up, longer variants matched by one automaton."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Variants of a version that travel with the tasks; more stay a table and meet blocks of texts.
MOST_VARIANTS = 200_000
#: Letters of texts in a block that meets its variants, and about those that are written at once.
BLOCK, AT_ONCE = 8_000_000, 1_000_000
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")
_TERMS = "text string, terms array<struct<begin:int,end:int,canonical:string>>"


def term_key(term: str) -> str:
    """What variants are compared by: composed, white space collapsed, case folded."""
    return _SPACE.sub(" ", unicodedata.normalize("NFC", term)).strip().casefold()


def _variants(terms: DataFrame, version: str) -> DataFrame:
    held = terms.filter(F.col("version") == version)
    return held.select("canonical", "variant").unionByName(held.select("canonical", F.col("canonical").alias("variant"))).filter("canonical is not null and variant is not null").distinct()


def pinned(terms: DataFrame, version: str, most: int = MOST_VARIANTS) -> dict[str, str]:
    """Key of each variant to its canonical term in ``version`` of ``terms`` (version, canonical, variant).

    A canonical term is a variant of itself. Of a key with several canonical terms the least in code-point order holds.
    A version that the table does not have is an error, and so are more than ``most`` variants.
    """
    rows = _variants(terms, version).limit(most + 1).collect()
    if not rows:
        raise ValueError(f"terminology has no version {version!r}")
    if len(rows) > most:
        raise ValueError(f"terminology {version!r} has more than {most} variants")
    out: dict[str, str] = {}
    for row in sorted(rows, key=lambda r: r.canonical, reverse=True):
        if term_key(row.variant):
            out[term_key(row.variant)] = row.canonical
    return out


class Automaton:
    """A trie of keys with failure links: all places of all keys in one pass over a text."""

    def __init__(self, keys: dict[str, str]):
        self.next: list[dict[str, int]] = [{}]
        self.fail, self.size, self.shorter, self.term = [0], [0], [0], [None]
        for key, canonical in keys.items():
            at = 0
            for letter in key:
                if letter not in self.next[at]:
                    self.next[at][letter] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.size.append(0)
                    self.shorter.append(0)
                    self.term.append(None)
                at = self.next[at][letter]
            self.size[at], self.term[at] = len(key), canonical
        level = list(self.next[0].values())
        while level:
            deeper = []
            for at in level:
                for letter, to in self.next[at].items():
                    back = self.fail[at]
                    while back and letter not in self.next[back]:
                        back = self.fail[back]
                    self.fail[to] = self.next[back].get(letter, 0)
                    # The longest key that ends here without being the node's own.
                    self.shorter[to] = self.fail[to] if self.size[self.fail[to]] else self.shorter[self.fail[to]]
                    deeper.append(to)
            level = deeper

    def ends(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(begin, end, canonical) of every key at every place, by end, the longest first."""
        at, follow, fail = 0, self.next, self.fail
        for i, letter in enumerate(text):
            while at and letter not in follow[at]:
                at = fail[at]
            at = follow[at].get(letter, 0)
            found = at if self.size[at] else self.shorter[at]
            while found:
                yield i + 1 - self.size[found], i + 1, self.term[found]
                found = self.shorter[found]


def _inside(text: str, at: int) -> bool:
    """Whether a word goes on across ``at``."""
    return 0 < at < len(text) and (text[at - 1].isalnum() or text[at - 1] == "_") and (text[at].isalnum() or text[at] == "_")


def matches(automaton: Automaton, folded: str) -> list[tuple[int, int, str]]:
    """Whole terms from the left, of those that begin at one place the longest, none overlapping."""
    return _leftmost(_whole(automaton, folded))


def _whole(automaton: Automaton, folded: str) -> list[tuple[int, int, str]]:
    return [m for m in automaton.ends(folded) if not _inside(folded, m[0]) and not _inside(folded, m[1])]


def _leftmost(whole: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out, last = [], 0
    for begin, end, canonical in sorted(whole, key=lambda m: (m[0], -m[1])):
        if begin >= last:
            out.append((begin, end, canonical))
            last = end
    return out


class Matcher:
    """Keys that are one word are looked up word by word, all others go through an automaton."""

    def __init__(self, keys: dict[str, str]):
        self.words = {k: v for k, v in keys.items() if _WORD.fullmatch(k)}
        others = {k: v for k, v in keys.items() if k not in self.words}
        self.automaton = Automaton(others) if others else None

    def __call__(self, folded: str) -> list[tuple[int, int, str]]:
        get, found = self.words.get, []
        for m in _WORD.finditer(folded):
            canonical = get(m[0])
            if canonical is not None:
                found.append((m.start(), m.end(), canonical))
        return found if self.automaton is None else _leftmost(found + _whole(self.automaton, folded))


def anchor(key: str) -> str:
    """What every text with the whole term ``key`` holds: its first word, as a whole word, or its first letter if it has no word."""
    found = _WORD.search(key)
    return found[0] if found else key[0]


def anchors(folded: str) -> set[str]:
    """Anchors that terms of a text may have: its words and its letters outside words."""
    return {*_WORD.findall(folded), *_WORD.sub("", folded)}


def folding(text: str) -> tuple[str, list[int] | None]:
    """(folded text, place of each of its letters in ``text`` and the end); None where places are the same."""
    folded = text.casefold()
    if len(folded) == len(text):
        return folded, None
    parts = [c.casefold() for c in text]
    return "".join(parts), [i for i, part in enumerate(parts) for _ in part] + [len(text)]


def _composed(text: str) -> str:
    return _SPACE.sub(" ", unicodedata.normalize("NFC", text)).strip()


def _replaced(keys: pa.Array, texts: pa.Array, matcher: Matcher) -> Iterator[pa.RecordBatch]:
    """The texts with their terms, in batches of about ``AT_ONCE`` letters."""
    out, begins, ends, names, offsets, first, letters = [], [], [], [], [0], 0, 0

    def batch(upto: int) -> pa.RecordBatch:
        found = pa.StructArray.from_arrays([pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array(names, pa.string())], names=["begin", "end", "canonical"])
        return pa.RecordBatch.from_arrays([keys.slice(first, upto - first), pa.array(out, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)], names=["_key", "text", "terms"])

    for n, value in enumerate(texts):
        text = value.as_py()
        if text is None:
            out.append(None)
        else:
            plain = _composed(text)
            folded, places = folding(plain)
            parts, last = [], 0
            for begin, end, canonical in matcher(folded):
                if places is not None:
                    begin, end = places[begin], places[end]
                parts += (plain[last:begin], canonical)
                begins.append(begin)
                ends.append(end)
                names.append(canonical)
                last = end
            out.append("".join([*parts, plain[last:]]))
            letters += len(text)
        offsets.append(len(begins))
        if letters >= AT_ONCE:
            yield batch(n + 1)
            out, begins, ends, names, offsets, first, letters = [], [], [], [], [0], n + 1, 0
    if out:
        yield batch(len(texts))


def _normalised(keys: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(keys)
        for batch in batches:
            yield from _replaced(batch.column(0), batch.column(1), matcher)

    return run


def _block_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: block, anchor of texts that are sorted by block, each once."""
    at, held = None, set()

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at] * len(held), pa.int64()), pa.array(list(held), pa.string())], names=["block", "anchor"])

    for batch in batches:
        for block, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if block != at:
                if held:
                    yield told()
                at, held = block, set()
            if text.is_valid:
                held |= anchors(folding(_composed(text.as_py()))[0])
    if held:
        yield told()


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: anchor, variant, canonical of variants by what they are compared by; blank ones are left out."""
    for batch in batches:
        rows = [(term_key(variant), canonical) for canonical, variant in zip(*(c.to_pylist() for c in batch.columns))]
        rows = [(anchor(key), key, canonical) for key, canonical in rows if key]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["anchor", "variant", "canonical"])


def _of_block(texts: pa.Table, variants: pa.Table) -> pa.Table:
    matcher = Matcher(dict(zip(variants["variant"].to_pylist(), variants["canonical"].to_pylist())))
    texts = texts.combine_chunks()
    keys, held = ((texts[c].combine_chunks() if texts[c].num_chunks != 1 else texts[c].chunk(0)) for c in ("_key", "_text"))
    kind = pa.schema([("_key", keys.type), ("text", pa.string()), ("terms", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("canonical", pa.string())])))])
    return pa.Table.from_batches(list(_replaced(keys, held, matcher)), kind)


def _by_blocks(rows: DataFrame, key: str, text: str, terms: DataFrame, version: str, letters: int) -> DataFrame:
    """The same for any number of variants: those whose anchor a block of texts holds are brought to it."""
    total = rows.agg(F.sum(F.length(text))).first()[0] or 0
    block: Column = F.pmod(F.xxhash64(key, text), F.lit(-(-total // letters) or 1))
    texts = rows.select(F.col(key).alias("_key"), F.col(text).alias("_text"), block.alias("block"))
    held = texts.repartition("block").sortWithinPartitions("block").select("block", "_text").mapInArrow(_block_anchors, "block long, anchor string")
    keyed = _variants(terms, version).mapInArrow(_keyed, "anchor string, variant string, canonical string").groupBy("anchor", "variant").agg(F.min("canonical").alias("canonical"))
    met = held.join(keyed, "anchor").select("block", "variant", "canonical")
    kind = rows.schema[key].dataType.simpleString()
    return texts.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(_of_block, f"_key {kind}, {_TERMS}")


def with_terminology(rows: DataFrame, key: str, text: str, terms: DataFrame, version: str, most: int = MOST_VARIANTS, letters: int = BLOCK) -> DataFrame:
    """key, text, terms: each text with its variants replaced by their canonical terms, and where they stood.

    Texts are composed (NFC) and their white space collapsed; case is folded for the comparison only. A variant counts where
    no word goes on at its ends; from the left the longest wins. ``terms``: begin, end (in the composed text), canonical. A
    null text stays null. One pass over each text, however many variants there are: up to ``most`` travel with the tasks,
    more are joined to blocks of about ``letters`` letters of texts.
    """
    if _variants(terms, version).limit(most + 1).count() > most:
        return _by_blocks(rows, key, text, terms, version, letters).withColumnRenamed("_key", key)
    kind = rows.schema[key].dataType.simpleString()
    out = rows.select(key, text).mapInArrow(_normalised(pinned(terms, version, most)), f"_key {kind}, {_TERMS}")
    return out.withColumnRenamed("_key", key)
