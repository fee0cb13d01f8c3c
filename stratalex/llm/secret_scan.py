"""Secret scans: patterns, and a lexer that reads assignments in source and configuration text.

The lexer turns assignments (``name = literal``, ``name: literal``, ``name => literal``, ``name: type = literal``,
``box["name"] = literal``), calls (``setName("literal")``, ``put("name", "literal")``), XML elements and attributes,
``--name literal`` and credentials in URLs into name-literal pairs. Literals may be quoted, triple-quoted over several
lines, bare, or concatenated. Constants are followed (``A = "..."``, ``password = A``, ``"${A}"``) to the latest
definition before the use, and a literal is scored by the most sensitive name that it reaches. Every character is
read a bounded number of times. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

#: Base patterns with the length their match (assign: its second group) must have.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "literal")

#: Weight of a name's parts; the largest counts.
SENSITIVE = {
    "password": 0.6, "passwd": 0.6, "pwd": 0.6, "passphrase": 0.6, "secret": 0.6, "token": 0.5, "apikey": 0.6,
    "credential": 0.5, "credentials": 0.5, "auth": 0.4, "authorization": 0.5, "bearer": 0.5, "private": 0.4, "signature": 0.3, "key": 0.3,
}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|change_?me|example|placeholder|none|null|true|false|todo|your[-_ ].*|test)$")
THRESHOLD = 0.75

#: Where a statement of interest may be: the lexer starts at the line that holds one of these.
_CANDIDATE = re.compile(r"[=:]|\([ \t]*[\"']")
_TOKEN = re.compile(
    r"(?P<skip>[ \t\r\f\v]+|\\\r?\n)|(?P<line>\n)|(?P<escape>\\.)|(?<![A-Za-z0-9])[rbufRBUF]{0,2}(?P<triple>\"\"\"|''')"
    r"|(?P<string>\"(?:[^\"\\\n]|\\.)*+\"|(?<![A-Za-z0-9])'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`)"
    r"|(?P<other>[=!<>]=+|->|::|:(?=//))|(?P<op>:=|=>|[=:])|(?P<word>[^\s\"'`=:,;(){}\[\]<>|&\\]+)|(?P<mark>.)",
    re.S,
)
_TRIPLE = {q: re.compile(rf"(?:[^{q[0]}\\]|\\.|{q[0]}(?!{q[0]}{q[0]}))*+{q}", re.S) for q in ('"' * 3, "'" * 3)}
_NAME = re.compile(r"[\w.$ /-]*+(?<=[\w.$ /-])")
_FLAG = re.compile(r"(?<![\w-])--([A-Za-z][A-Za-z0-9-]*)[ \t]+[\"']?([^\s\"'-][^\s\"']*)")
_URL = re.compile(r"://([^\s:/@\"']+):([^\s/@\"']+)@")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*)>\s*+([^<>\s]+)\s*+</")
_REFERENCE = re.compile(r"\$?\{?\{?[ ]*([A-Za-z_][A-Za-z0-9_.]*)[ ]*\}?\}?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    name: str
    score: float


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each pattern that do not overlap within their kind and are long enough."""
    found = [Span(*m.span(), "assign", m[1].lower(), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [Span(*m.span(), "access", "", 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # A run of sixteen or more is what the unbounded pattern finds, less the short runs that it drops.
    return found + [Span(*m.span(), "hex", "", 1.0) for m in HEX.finditer(text)]


class Assigned(NamedTuple):
    """A name and the pieces (start, end, quoted) of the value that it is given, concatenated."""

    name: str
    pieces: list[tuple[int, int, bool]]


def _tokens(text: str, at: int, closed: dict[str, bool]) -> tuple[list[tuple[str, int, int]], int]:
    """Tokens (kind, start, end; strings without their quotes) up to the end of the line, and where that is.

    A string may run over several lines. ``closed`` remembers for each triple quote that nothing ends it.
    """
    out = []
    while m := _TOKEN.match(text, at):
        kind, start, at = m.lastgroup, m.start(), m.end()
        if kind == "line":
            break
        if kind == "triple":
            end = _TRIPLE[m["triple"]].match(text, at) if closed.get(m["triple"], True) else None
            if end:
                out.append(("string", at, end.end() - 3))
                at = end.end()
            else:
                closed[m["triple"]] = False
        elif kind == "string":
            out.append(("string", start + 1, at - 1))
        elif kind == "mark":
            out.append((text[start:at], start, at))
        elif kind in ("op", "word", "other"):
            out.append((kind, start, at))
    return out, at


def _value(text: str, tokens: list, k: int) -> tuple[list[tuple[int, int, bool]], int]:
    """Pieces of the value that begins at token ``k``, and the token after it."""
    pieces, n, wanted = [], len(tokens), True
    while k < n:
        kind, start, end = tokens[k]
        if kind == "word" and text[start] == "+" and not wanted:
            start, wanted = start + 1, True
        if kind == "string" and (wanted or pieces[-1][2]):
            pieces.append((start, end, True))
            wanted = False
        elif kind == "word" and wanted:
            joined = text[end - 1] == "+" and end > start and k + 1 < n and tokens[k + 1][0] == "string"
            after = tokens[k + 1] if k + 1 < n and tokens[k + 1][0] in ("op", "other") and tokens[k + 1][1] == end else None
            if after and not text[end : after[2]].strip("=") and (k + 2 == n or tokens[k + 2][1] > after[2] or tokens[k + 2][0] in ",;)}]"):
                k, end = k + 1, after[2]  # the padding of base64
            if end - joined > start:
                pieces.append((start, end - joined, False))
            wanted = joined or end == start
        else:
            break
        k += 1
    return pieces, k


def _name_before(text: str, tokens: list, i: int) -> str:
    """The name that token ``i`` gives a value to."""
    back = i - 1
    if back >= 2 and tokens[back][0] == "]" and tokens[back - 1][0] == "string" and tokens[back - 2][0] == "[":
        back -= 1
    return _name(text[tokens[back][1] : tokens[back][2]]) if back >= 0 and tokens[back][0] in ("word", "string") else ""


def _name(text: str) -> str:
    name = text.strip("-+*&@$.!?/ ")
    return name if _NAME.fullmatch(name) else ""


def assignments(text: str) -> list[Assigned]:
    """Names and the values that the text gives them, in order."""
    out, at, closed = [], 0, {}
    while m := _CANDIDATE.search(text, at):
        at = text.rfind("\n", at, m.start()) + 1 or at
        tokens, at = _tokens(text, at, closed)
        key = ""  # of <add key="name" value="literal"/> and {"name": "...", "value": "..."}
        for i, (kind, _, end) in enumerate(tokens):
            if kind == "op" and (name := _name_before(text, tokens, i)):
                pieces, k = _value(text, tokens, i + 1)
                if text[end - 1] == ":" and len(pieces) == 1 and not pieces[0][2] and k < len(tokens) and text[tokens[k][1] : tokens[k][2]] == "=":
                    pieces, k = _value(text, tokens, k + 1)  # what stood there was a type
                if name in ("key", "name") and len(pieces) == 1:
                    key = text[pieces[0][0] : pieces[0][1]]
                elif name == "value" and key:
                    name = key
                if pieces:
                    out.append(Assigned(name, pieces))
            elif kind == "(" and i and tokens[i - 1][0] == "word" and i + 1 < len(tokens) and tokens[i + 1][0] == "string":
                first, name = tokens[i + 1], _name(text[tokens[i - 1][1] : tokens[i - 1][2]])
                if [t[0] for t in tokens[i + 2 : i + 4]] == [",", "string"]:
                    name, first = _name(text[first[1] : first[2]]), tokens[i + 3]
                if name:
                    out.append(Assigned(name, [(first[1], first[2], True)]))
            elif kind in (">", "}"):
                key = ""
    if "--" in text:
        out += [Assigned(m[1], [(*m.span(2), False)]) for m in _FLAG.finditer(text)]
    if "://" in text:
        out += [Assigned("password", [(*m.span(2), True)]) for m in _URL.finditer(text)]
    if "</" in text:
        out += [Assigned(m[1], [(*m.span(2), True)]) for m in _ELEMENT.finditer(text)]
    return sorted(out, key=lambda x: x.pieces[0])


def name_weight(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:])}
    return max((SENSITIVE.get(p, 0.0) for p in (*parts, *joined)), default=0.0)


def literal_weight(literal: str, quoted: bool) -> float:
    """What a literal itself adds: length, mixed characters and entropy; placeholders and plain words take away."""
    if len(literal) < 6 or PLACEHOLDER.match(literal):
        return -1.0
    n = len(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    mixed = any(c.isdigit() for c in literal) and any(c.isalpha() for c in literal)
    return 0.1 * (n >= 8) + 0.2 * mixed + 0.1 * (entropy >= 3) + 0.05 * quoted - 0.3 * (not mixed and not quoted)


def literal_spans(text: str) -> list[Span]:
    """Literals that reach a sensitive name, directly or through constants."""
    found = assignments(text)
    weights = {name: name_weight(name) for name in {x.name for x in found}}
    if not any(weights.values()):
        return []
    places: dict[str, list[int]] = defaultdict(list)
    for i, x in enumerate(found):
        for name in {x.name, x.name.rsplit(".", 1)[-1]}:
            places[name].append(i)

    def definition(start: int, end: int, user: int) -> int | None:
        """The latest definition before ``user`` of the constant that a piece names, or else its first one."""
        m = _REFERENCE.fullmatch(text, start, end)
        known = places.get(m[1]) if m else None
        if not known:
            return None
        at = bisect_left(known, user)
        return known[at - 1] if at else next((i for i in known if i != user), None)

    # From the most sensitive names down, each value is reached once, with the best name that uses it.
    best: dict[int, str] = {}
    for i in sorted((i for i, x in enumerate(found) if weights[x.name]), key=lambda i: (-weights[found[i].name], i)):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in best:
                best[k] = found[i].name
                todo += [d for s, e, _ in found[k].pieces if (d := definition(s, e, k)) is not None]
    out: dict[tuple[int, int], Span] = {}
    for k, name in best.items():
        literals = [p for p in found[k].pieces if p[1] > p[0] and definition(p[0], p[1], k) is None]
        whole = "".join(text[s:e] for s, e, _ in literals)
        score = round(weights[name] + literal_weight(whole, literals[0][2]), 3) if literals else 0.0
        for s, e, _ in literals if score >= THRESHOLD else ():
            if (s, e) not in out or out[s, e].score < score:
                out[s, e] = Span(s, e, "literal", name, score)
    return list(out.values())


def scan(text: str) -> list[Span]:
    """All spans by start, then kind; the base ones and literals that are not base spans already."""
    base = base_spans(text)
    taken = {(s.start, s.end) for s in base}
    return sorted(base + [s for s in literal_spans(text) if (s.start, s.end) not in taken], key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of start, end, kind, name, score) of every row of ``docs``.

    Whole texts are scanned, in linear time; null and empty texts have no spans. Rows are scanned each by itself:
    repeated rows repeat, an empty table gives none, other columns are not read. One text is one row of a task.
    """
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[s._asdict() for s in scan(x.as_py())] if x.is_valid else [] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span))], names=["doc_id", "spans"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, spans array<struct<start:bigint,end:bigint,kind:string,name:string,score:double>>")


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_literal: ``secret_spans`` in short, in the same pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [scan(x.as_py()) if x.is_valid else [] for x in batch.column(1)]
            counts = [Counter(s.kind for s in spans) for spans in every]
            base = [hashlib.sha256(joined([s for s in spans if s.kind != "literal"]).encode()).hexdigest() for spans in every]
            n = {k: pa.array([c[k] for c in counts], pa.int64()) for k in KINDS}
            columns = [batch.column(0), n["assign"], n["access"], n["hex"], pa.array(base, pa.string()), pa.array([joined(spans) for spans in every], pa.string()), n["literal"]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_literal bigint")
