"""Line dedup, vector codes and token alignment against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, corpus

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return line.strip(WHITE).translate({c: c + 32 for c in range(65, 91)})


def line_rows():
    r = random.Random(5)
    common = ["All rights reserved.", "  Über UNS\t", "x", "İ shared"]
    rows = corpus()
    for i in range(60):
        lines = [r.choice(common).swapcase() if r.random() < 0.3 and i % 2 else r.choice(common) for _ in range(r.randint(0, 4))] + [f"own {i} {j}" for j in range(r.randint(0, 3))] + [""] * r.randint(0, 2)
        r.shuffle(lines)
        rows.append((1000 + i, "\n".join(lines), "en", "a", 1, 1, "q", "z"))
    rows += [(2000, "\n".join(["many"] * 40), "en", "a", 1, 1, "q", "z"), (None, "x\nkeep", "en", "a", 1, 1, "q", "z"), (None, "X \n\nkeep", "en", "a", 1, 1, "q", "z")]
    return rows + [(3000, "again\nown", "en", "a", 1, 1, "q", "z")] * 10 + [(3001, "nine", "en", "a", 1, 1, "q", "z")] * 9 + [(1000, "x\ndifferent text", "en", "a", 1, 1, "q", "z")]


def without_common(rows, least):
    held = collections.Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")} - {""})
    want = collections.Counter()
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if held[key(x)] < least]
        want[d, len(lines), len(lines) - len(left), "\n".join(left)] += 1
    return want


@pytest.mark.parametrize("batches, least, parts", [(8, 10, 11), (1, 10, 3), (5, 2, 7)])
def test_common_lines(spark, batches, least, parts):
    from stratalex.llm.line_dedup import drop_common_lines

    rows = line_rows()
    docs = spark.createDataFrame([(*x, 1, "k", "g", 2) for x in rows], SCHEMA + ", n_lines int, key string, gone string, deal int").repartition(parts)
    got = collections.Counter((g.doc_id, g.n_lines, g.n_dropped, g.text) for g in drop_common_lines(docs, least, batches).collect())
    assert got == without_common(rows, least)
    assert any(n for _, _, n, _ in got)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lines_")]


def test_no_lines(spark):
    from stratalex.llm.line_dedup import drop_common_lines

    assert drop_common_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    got = drop_common_lines(spark.createDataFrame([(None, None), (1, None), (2, "")], "doc_id bigint, text string")).collect()
    assert sorted((g.doc_id or 0, g.n_lines, g.n_dropped, g.text) for g in got) == [(0, 1, 0, ""), (1, 1, 0, ""), (2, 1, 0, "")]


def test_runs_meet_without_a_shuffle(spark):
    """Two runs are merged bucket by bucket; a batch shuffles its own keys only."""
    from stratalex.llm.common import Workspace
    from stratalex.llm.line_dedup import LineRuns

    runs = LineRuns(Workspace(spark, "test"), 2)
    for deal in (b"aab", b"bbc"):
        runs.levels.append(runs._write(spark.createDataFrame([(bytes([x]),) for x in deal], "key binary").groupBy("key").agg(F.count("*").alias("n"))))
    one, two = (spark.table(x) for x in runs.levels)
    plan = one.join(two.withColumnRenamed("n", "m").hint("merge"), "key", "full")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert sorted(bytes(r.key) for r in runs.common().collect()) == [b"a", b"b"]
    runs.close()


def coded(rows, parts, entries, rounds):
    """Codes, errors and codebooks by trying every entry."""
    fine = [(i, [int(np.floor(256 * float(x))) for x in v], label) for i, v, label in rows if v and len(v) % parts == 0 and all(x is not None and np.isfinite(x) for x in v)]
    known = {}
    for i, v, _ in fine:
        if i is not None:
            known[i] = min(known.get(i, v), v)
    size = len(known[min(known)])
    width = size // parts
    fine = [r for r in fine if len(r[1]) == size]
    first = [known[i] for i in sorted(i for i in known if len(known[i]) == size)[:entries]]
    books = [[tuple(v[p * width : (p + 1) * width]) for v in first] for p in range(parts)]

    def assign(v):
        out = []
        for p, book in enumerate(books):
            x = v[p * width : (p + 1) * width]
            out.append(min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book)))
        return out

    for _ in range(rounds):
        members = collections.defaultdict(list)
        for _, v, _ in fine:
            for p, (_, e) in enumerate(assign(v)):
                members[p, e].append(v[p * width : (p + 1) * width])
        for (p, e), xs in members.items():
            books[p][e] = tuple(sum(c) // len(xs) for c in zip(*xs))
    out = [(i, label, assign(v)) for i, v, label in fine]
    total = collections.Counter()
    for _, label, found in out:
        total[label] += sum(d for d, _ in found)
    name = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return collections.Counter((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), total[label], name) for i, label, found in out)


@pytest.mark.parametrize("grid, entries", [(1, 64), (64, 64), (1, 5)])
def test_vector_codes(spark, grid, entries):
    from stratalex.llm.vector_codes import vector_codes

    r = random.Random(grid)
    # A coarse grid makes many ties and equal vectors.
    vector = lambda n=32: [float(np.float32(round(r.gauss(0, 1) * grid) / grid if grid > 1 else round(r.gauss(0, 2)))) for _ in range(n)]
    rows = [(i, vector(), i % 3 if i % 5 else None) for i in range(300)]
    rows += [(-5, None, 1), (-4, [1.0, None] * 16, 1), (-3, [float("nan")] * 32, 1), (-2, [float("inf")] * 32, 1), (400, [], 0), (401, vector(31), 0), (402, vector(16), 0), (2, vector(), 1), (None, vector(), 2), rows[7], rows[7]]
    vectors = spark.createDataFrame([(*x, "c", 1) for x in rows], "vec_id bigint, embedding array<float>, label int, code string, error int").repartition(4)
    got = vector_codes(vectors, entries=entries).collect()
    assert collections.Counter((g.vec_id, g.code, g.error, g.label_error, g.codebooks_sha256) for g in got) == coded(rows, 16, entries, 2)


def test_vectors_that_cannot_be_coded(spark):
    from stratalex.llm.vector_codes import vector_codes

    schema = "vec_id bigint, embedding array<double>, label int"
    assert vector_codes(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes(spark.createDataFrame([(None, [1.0] * 16, 1), (1, None, 1)], schema)).count() == 0
    with pytest.raises(Exception, match="exceeds"):
        vector_codes(spark.createDataFrame([(1, [1e30] * 16, 1)], schema)).collect()


def test_trees_visit_what_ties():
    """The tree finds the same entry as a full search, ties and doubled entries included, and visits fewer."""
    from stratalex.llm import vector_codes as vc

    rng = np.random.default_rng(3)
    for spread in (2, 5, 1000, 1 << 27):
        entries = rng.integers(-spread, spread, (64, 4)).astype("int64")
        entries[40:44] = entries[3]
        points = np.concatenate([entries, rng.integers(-spread, spread, (4000, 4))]).astype("int64")
        d = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        index, best = vc.nearest(points, entries, vc.built(entries))
        assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    met, real = [], vc.squared
    vc.squared = lambda points, entry: met.append(len(points)) or real(points, entry)
    try:
        entries = rng.integers(-1000, 1000, (64, 4)).astype("int64")
        tree = vc.built(entries)
        met.clear()
        vc.nearest(rng.integers(-1000, 1000, (4000, 4)).astype("int64"), entries, tree)
    finally:
        vc.squared = real
    assert sum(met) < 0.7 * 64 * 4000


def alignment(rows):
    """Every document's tokens by the libraries themselves, and links by the overlap of every pair of ranges."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = {}
    spare = 256
    for b in range(256):
        if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255):
            letters[chr(spare)] = b
            spare += 1
        else:
            letters[chr(b)] = b
    assert decoders.ByteLevel  # the letters above are those of its decoder
    held = []
    for _, t, *_ in rows:
        a = own.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        b = model.encode(t) if t else []
        x = [bytes(letters[c] for c in own.id_to_token(i)) for i in a]
        y = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = b" " + (t or "").encode()
        held.append((list(zip(a, x)), list(zip(b, y))) if t and b"".join(x) == whole == b"".join(y) else ([], []))
    linked, texts, count = [], [], collections.Counter()
    for a, b in held:
        spans, ends = [], []
        for side in (a, b):
            at, own_spans = 0, []
            for i, x in side:
                own_spans.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own_spans)
            ends.append({e for *_, e in own_spans})
        cuts = sorted(ends[0] & ends[1])
        groups, begin = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if begin <= s and e <= cut) for side in spans) if len(a) < 500 else "")
            begin = cut
        pairs, j = collections.Counter(), 0
        for i, s, e in spans[0]:
            while j and spans[1][j - 1][2] > s:
                j -= 1
            while spans[1][j][2] <= s:
                j += 1
            while j < len(spans[1]) and spans[1][j][1] < e:
                pairs[i, spans[1][j][0]] += 1
                j += 1
            j -= 1
        linked.append(pairs)
        texts.append(";".join(groups) if len(a) < 500 else None)
        count.update(pairs.keys())
    most = collections.Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (d, *_), (a, b), pairs, text in zip(rows, held, linked, texts):
        best = sum(n for p, n in pairs.items() if count[p] == most[p[0]])
        total = sum(n * count[p] for p, n in pairs.items())
        out.append((d, len(a), len(b), sum(pairs.values()), best, total, None if text is None else hashlib.sha256(text.encode()).hexdigest() if a else "", text))
    return out


ODD = ["<|endoftext|> and <s>", "▁ piece", "double  spaces   and\ttabs\n\n", " leading", "trailing ", "ﬁ ligature", "日本語のテキスト", "émigré Straße 12345 ½ ²", "😀 emoji 👩‍👩‍👧", "x" * 300, "​zero", "ꟊ Ʂ 𞤀 \U00010570 ᲊ new letters", "a b c", "\x00\x01", "don't we'll I'M"]


@pytest.fixture(scope="module")
def token_rows():
    rows = corpus()
    return rows + [(5000 + i, t, "en", "a", 1, 1, "q", "z") for i, t in enumerate(ODD)]


@pytest.mark.parametrize("broadcast", [1 << 21, 0])
def test_token_alignment(spark, token_rows, broadcast, monkeypatch):
    from stratalex.llm import token_alignment as ta

    docs = spark.createDataFrame([(*x, 1, "k") for x in token_rows], SCHEMA + ", row int, links string").repartition(5)
    got = ta.token_alignment(docs, most_broadcast=broadcast).collect()
    want = alignment(token_rows)
    shape = lambda g: (g.doc_id, g.n_a, g.n_b, g.n_links, g.n_best, g.count_sum)
    assert collections.Counter(map(shape, got)) == collections.Counter(x[:6] for x in want)
    digests = collections.Counter((g.doc_id, g.groups_sha256) for g in got if g.n_a < 500)
    assert digests == collections.Counter((x[0], x[6]) for x in want if x[1] < 500)
    assert all(g.n_links == g.n_a + g.n_b - g.n_groups for g in got) and sum(not g.n_a for g in got) < len(got) / 4
    assert ta.token_alignment(docs.limit(0)).count() == 0


def test_aligned_groups(spark, token_rows):
    """Groups cover each text without gaps, in bytes, and their ids are the digest's."""
    from stratalex.llm import token_alignment as ta

    docs = spark.createDataFrame(token_rows, SCHEMA).filter("doc_id is not null").dropDuplicates(["doc_id"]).repartition(3)
    groups = collections.defaultdict(list)
    for g in ta.aligned_groups(docs).collect():
        groups[g.doc_id].append(g)
    text = {r.doc_id: r.text for r in docs.collect()}
    digest = {g.doc_id: g for g in ta.token_alignment(docs).collect()}
    a, b = ta.sides()
    for d, own in groups.items():
        own.sort(key=lambda g: (g.end, g.begin))
        assert own[0].begin == 0 and own[-1].end == len(text[d].encode()) and all(x.end == y.begin for x, y in zip(own, own[1:]))
        for g in own:
            part = (b"" if g.begin or g is not own[0] else b" ") + text[d].encode()[g.begin : g.end]
            assert b"".join(a.bytes[i] for i in g.a) == b"".join(b.bytes[i] for i in g.b) == part
        spelled = ";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in own)
        assert hashlib.sha256(spelled.encode()).hexdigest() == digest[d].groups_sha256 and digest[d].n_groups == len(own)
    assert set(groups) == {d for d, g in digest.items() if g.n_a}


def test_the_machine_in_small_steps(spark, token_rows, monkeypatch):
    """Blocks of any size and any number of gathered events give the same groups and links."""
    from stratalex.llm import token_alignment as ta

    sizes = [np.array([len(x) for x in side.bytes], "int64") for side in ta.sides()]
    for _, t, *_ in token_rows[30:36] + token_rows[-15:]:
        tokens = ta._tokens(t or "", ta.sides(), sizes)
        seen = set()
        for block, gather in ((1 << 20, 1 << 20), (1, 1), (3, 5), (7, 1)):
            held = []
            for side, ids in enumerate(tokens):
                starts = np.cumsum(sizes[side][ids]) - sizes[side][ids]
                held += [(int(starts[at]), side, ids[at : at + block]) for at in range(0, len(ids), block)]
            sweep, out = ta.Sweep(sizes), ta._Digests(sizes)
            for first, side, ids in sorted(held, key=lambda x: x[:2]):
                sweep.feed(side, first, ids)
                if sweep.n > gather:
                    out.groups(0, 0, sweep.closed())
            out.end(0, 0, sweep)
            _, _, *rest, found, times = out.rows[0]
            seen.add((*rest, tuple(found), tuple(times)))
        assert len(seen) == 1


def test_the_faster_encoder_is_the_files_own():
    """Ids of side A are those of the tokenizer file's library, however white space, letters and new characters mix."""
    from stratalex.llm import token_alignment as ta

    side, r = ta.sides()[0], random.Random(3)
    parts = [" ", " ", "  ", "\t", "\n", "\n\n", "\xa0", "\u2003", "'s", "'LL", "the", "The", "wörter", "1234", "½", "!?", "日本", "é", "\u0301", "😀", "x" * 70, "ﬁ", "\x1c", "▁", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 12)))
        ids = side.encode(text)
        assert list(ids) == side.own.encode(" " + text, add_special_tokens=False).ids and b"".join(side.bytes[i] for i in ids) == b" " + text.encode(), repr(text)
    kept = [c for c in map(chr, range(0x20000)) if not ta._RECENT.match(c) and not 0xD800 <= ord(c) < 0xE000]
    text = " ".join(a + b for a, b in zip(kept, kept[1:] + kept[:1]))
    assert len(kept) > 30_000 and list(side.fast.encode_ordinary(text)) == side.own.encode(text, add_special_tokens=False).ids
