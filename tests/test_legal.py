"""Amendment intervals, terminology, reference spans, nested parses and encoders against brute force."""

import datetime as dt
import random
import re
import time
import unicodedata

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from stratalex.operators import amendments as am
from stratalex.operators import corpus_qa as qa
from stratalex.operators import nested as ne
from stratalex.operators import terminology as te

EVENTS = "provision_id string, event_id long, event_type string, effective_on date, until date, version int, priority int, review_status string"
DAY = dt.date(2024, 1, 1)


def valid_on(events, day):
    """The winning version on a day, from all events up to it."""
    done = sorted((e for e in events if e[3] <= day), key=lambda e: (e[3], e[1]))
    turned = [e[2] for e in done if e[2] in ("SUSPENDED", "RESUMED")]
    if turned and turned[-1] == "SUSPENDED":
        return None
    best = None
    for e in done:
        if e[2] in am.OPENS and (e[4] is None or (e[4] > day and e[4] > e[3])):
            if not any(c[2] in am.CLOSES and c[3] > e[3] and c[5] in (None, e[5]) for c in done):
                best = max(best or (-1, -1, -1), (e[6] or 0, e[5], e[1]))
    return best and best[1]


def test_amendment_intervals(spark):
    r, rows = random.Random(5), []
    for p in range(60):
        for _ in range(r.randint(1, 14)):
            kind, on = r.choice([*am.OPENS * 2, *am.CLOSES, "SUSPENDED", "RESUMED", "NOTED"]), DAY + dt.timedelta(r.randint(0, 40))
            until = on + dt.timedelta(r.randint(-1, 15)) if r.random() < 0.4 else None
            version = r.randint(1, 4) if kind in am.OPENS or r.random() < 0.5 else None
            rows.append((f"p{p}", len(rows), kind, on, until if kind in am.OPENS else None, version, r.choice([None, 0, 1]), "ACCEPTED"))
    odd = [("p0", 9000, "AMENDED", None, None, 9, 9, "ACCEPTED"), ("p0", 9001, "AMENDED", DAY, None, 9, 9, "PENDING"), ("p0", 9002, "AMENDED", DAY, None, None, 9, "ACCEPTED"), (None, 9003, "AMENDED", DAY, None, 9, 9, "ACCEPTED"), ("p0", 9004, None, DAY, None, 9, 9, "ACCEPTED"), ("p0", 9005, "AMENDED", DAY, None, 9, 9, None)]
    got = am.effect_intervals(spark.createDataFrame(rows + odd, EVENTS).repartition(5)).collect()
    held = {}
    for g in got:
        held.setdefault(g.provision_id, []).append((g.effective_from, g.effective_to, g.version))
    for p in {x[0] for x in rows}:
        own, intervals = [x for x in rows if x[0] == p and x[2] != "NOTED"], sorted(held.get(p, []), key=lambda i: i[0])
        for n in range(-1, 60):
            day = DAY + dt.timedelta(n)
            assert [v for a, b, v in intervals if a <= day and (b is None or day < b)] == ([valid_on(own, day)] if valid_on(own, day) is not None else []), (p, day)
        for (a, b, v), (c, _, w) in zip(intervals, intervals[1:]):
            assert a < b <= c and (b < c or v != w)  # half-open, apart, coalesced
    assert {x.event_id for x in am.undated_events(spark.createDataFrame(rows + odd, EVENTS)).collect()} == {9000, 9001, 9005}
    assert am.effect_intervals(spark.createDataFrame([], EVENTS)).count() == 0


def test_many_events_of_one_provision(spark):
    n = 50_000
    rows = spark.range(n).selectExpr("'p' as provision_id", "id as event_id", "'AMENDED' as event_type", "date_add(date'1900-01-01', cast(id % 40000 as int)) as effective_on", "date_add(date'1900-01-01', cast(id % 40000 as int) + 400) as until", "cast(id % 1000 as int) as version", "cast(0 as int) as priority", "'ACCEPTED' as review_status")
    began = time.time()
    assert am.effect_intervals(rows).count() > 40 and time.time() - began < 30


TERMS = [("1.0.0", "xe ô tô", v) for v in ("xe ôtô", "xe oto", "ô tô", "ôtô")] + [("1.0.0", "giấy phép lái xe", "GPLX"), ("1.0.0", "nồng độ cồn", "nồng độ cồn trong máu"), ("1.0.0", "Straße", "strasse"), ("2.0.0", "car", "xe oto"), ("1.0.0", "empty", " "), ("1.0.0", "lost", None)]


def replaced(text, keys):
    """Every place, every key, letter by letter of the folded text."""
    plain = re.sub(r"\s+", " ", unicodedata.normalize("NFC", text)).strip()
    word = lambda c: c.isalnum() or c == "_"
    out, i = [], 0
    while i < len(plain):
        best = None
        for j in range(i + 1, min(len(plain), i + 60) + 1):
            found = keys.get(plain[i:j].casefold())
            if found and not (i and word(plain[i - 1]) and word(plain[i])) and not (j < len(plain) and word(plain[j - 1]) and word(plain[j])):
                best = (j, found)
        out.append(best[1] if best else plain[i])
        i = best[0] if best else i + 1
    return "".join(out)


def test_terminology(spark):
    terms = spark.createDataFrame(TERMS, "version string, canonical string, variant string")
    r = random.Random(9)
    parts = ["xe", "ôtô", "ô", "tô", "oto", "Xe  OTO", "gplx", "GPLX.", "nồng độ cồn", "trong máu", "STRASSE", "straße", "GPLX2", "_oto", ",", "\n", "ß", "(xe ôtô)", "ôtô", "İ xe oto"]
    texts = [" ".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(300)] + ["", "xe ô tô"]
    keys = te.pinned(terms, "1.0.0")
    assert keys["xe oto"] == "xe ô tô" and te.pinned(terms, "2.0.0")["xe oto"] == "car" and "" not in keys
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "gplx"), (-1, None)]
    got = te.with_terminology(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text", terms, "1.0.0").collect()
    assert {g.doc_id: g.text for g in got} == {i: None if t is None else replaced(t, keys) for i, t in rows}
    assert all(len(g.terms) == 0 for g in got if g.text is None)
    with pytest.raises(ValueError, match="no version"):
        te.with_terminology(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", terms, "3.0.0")
    with pytest.raises(ValueError, match="more than"):
        te.pinned(terms, "1.0.0", most=3)


def test_terminology_in_blocks(spark):
    """More variants than travel with the tasks: blocks of texts meet theirs, with the result of the others."""
    terms = spark.createDataFrame([*TERMS, ("1.0.0", "mark", "§ §"), ("1.0.0", "cut", "(xe"), ("1.0.0", "dash", "--")], "version string, canonical string, variant string")
    r = random.Random(3)
    parts = ["xe", "ôtô", "ô", "tô", "oto", "Xe  OTO", "gplx", "nồng độ cồn", "trong máu", "STRASSE", "straße", "_oto", ",", "\n", "(xe ôtô)", "§", "--", "---", "İ xe oto"]
    rows = [(i, " ".join(r.choice(parts) for _ in range(r.randint(0, 12)))) for i in range(300)] + [(None, "gplx"), (-1, None), (-2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = te.pinned(terms, "1.0.0")
    got = te.with_terminology(docs, "doc_id", "text", terms, "1.0.0", most=3, letters=500).collect()
    assert {g.doc_id: g.text for g in got} == {i: None if t is None else replaced(t, keys) for i, t in rows}
    assert sorted(map(str, got)) == sorted(map(str, te.with_terminology(docs, "doc_id", "text", terms, "1.0.0").collect()))


def test_the_automaton_is_linear():
    """Thousands of terms, many of which are one another's endings; time grows with the text."""
    keys = {"a" * n: str(n) for n in range(1, 200)} | {f"term {i}": str(i) for i in range(5000)}
    automaton = te.Automaton({k: v for k, v in keys.items() if "a" * 2 not in k or len(k) > 190})
    took = []
    for n in (50_000, 200_000):
        text = "term 17 term 4999 " * (n // 18)
        began = time.process_time()
        found = te.matches(automaton, text)
        took.append(time.process_time() - began)
        assert len(found) == 2 * (n // 18) and {m[2] for m in found} == {"17", "4999"}
    assert took[1] < 12 * took[0] + 0.5
    assert [m[2] for m in te.matches(te.Automaton({"ab": "1", "abc d": "2", "bc": "3", "d": "4"}), "abc d ab bc abcd")] == ["2", "1", "3"]


def test_spans(spark):
    """Leftmost, then longest; patterns on their own; a joined pattern would take the shorter."""
    rows = [(1, "theo quy định tại Khoản 4 Điều 6 của Nghị định 168/2024/NĐ-CP và Điểm a Khoản 2 Điều 9"), (2, "Điều 5. Phạm vi"), (3, "THEO  Điều 12, theo Điểm đ) nữa, điểm của"), (4, None), (5, "ababab b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cites = {}
    for g in qa.references(docs, "doc_id", "text").orderBy("doc_id", "place").collect():
        cites.setdefault(g.doc_id, []).append((g.citation, g.doc_kind, g.article, g.clause, g.point))
    assert cites == {1: [("theo quy định tại Khoản 4 Điều 6 của Nghị định 168/2024/NĐ-CP", "nd", "6", "4", None), ("Điểm a Khoản 2 Điều 9", None, "9", "2", "a")], 3: [("THEO Điều 12", None, "12", None, None), ("theo Điểm đ", None, None, None, None)]}
    found = [(g.place, g.begin, g.end, g.raw) for g in qa.spans(docs.filter("doc_id = 5"), "doc_id", "text", ("a", "ab", "bab")).orderBy("place").collect()]
    assert found == [(0, 0, 2, "ab"), (1, 2, 4, "ab"), (2, 4, 6, "ab")]
    assert qa.chosen([(0, 2), (0, 5), (1, 9), (5, 6), (5, 7)]) == [(0, 5), (5, 7)]


def test_nested_parses(spark):
    parses = [("a1", "a", 1, "old"), ("a2", "a", 2, "new"), ("b1", "b", 1, None), ("c1", "c", 5, "empty")]
    box = (0.1, 0.2, 0.3, 0.4)
    elements = [("a2", 2, 1, "e3", "p", "three", box, None, None), ("a2", 1, 2, "e2", "table", None, None, "e1", "<table>"), ("a2", 1, 1, "e1", "p", "one", box, None, None), ("a2", 1, 3, "e4", "p", " \t", box, None, None), ("a1", 1, 1, "e0", "p", "gone", box, None, None), ("b1", 1, 1, "x", "p", None, None, None, None)]
    kind = "parse_id string, page_number int, reading_order int, element_id string, element_type string, text string, box struct<left:double,top:double,right:double,bottom:double>, parent_element_id string, table_html string"
    held = spark.createDataFrame(elements, kind)
    pages = spark.createDataFrame([("a2", 3), ("a2", 1), ("a1", 7)], "parse_id string, page_number int")
    nested = ne.rebuilt(spark.createDataFrame(parses, "parse_id string, document_id string, completed_at int, note string"), held, pages)
    got = {r.document_id: r for r in nested.collect()}
    assert [(p.page_number, p.text, [e.element_id for e in p.elements]) for p in got["a"].pages] == [(1, "one", ["e1", "e2", "e4"]), (2, "three", ["e3"]), (3, None, [])]
    assert got["a"].note == "new" and [p.text for p in got["b"].pages] == [None] and got["c"].pages == []
    back = ne.flattened(nested).select(*held.columns).collect()
    assert sorted(map(str, back)) == sorted(str(r) for r in held.filter("parse_id != 'a1'").collect())  # without loss


def test_encoders(spark, tmp_path):
    from stratalex.functions.text import cache_key
    from stratalex.operators import sparse as sp
    from stratalex.operators.encoder import EmbeddingLookup, SparseEncoder, SparseEncoderModel

    texts = [(1, "the car of the man"), (2, "a car"), (3, ""), (4, None), (5, "the 12 MAN")]
    docs = spark.createDataFrame(texts, "id long, body string")
    vectors = docs.filter("id in (1, 2)").select(cache_key(F.lit("m"), F.col("body")).alias("cache_key"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    vectors.write.parquet(f"{tmp_path}/vectors")
    stages = [SparseEncoder(keyCol="id", inputCol="body", outputCol="w"), EmbeddingLookup(inputCol="body", outputCol="v", modelName="m", path=f"{tmp_path}/vectors", size=2)]
    fitted = Pipeline(stages=stages).fit(docs)
    fitted.write().save(f"{tmp_path}/model")
    Pipeline(stages=stages).write().save(f"{tmp_path}/pipeline")
    new = spark.createDataFrame([(10, "car the the unknown"), (11, "unknown"), (12, None), (2, "a car")], "id long, body string")
    plain = lambda model: sorted((r.id, r.w.indices, [round(x, 9) for x in r.w["values"]], r.v) for r in model.transform(new).collect())
    want = plain(fitted)
    assert plain(PipelineModel.load(f"{tmp_path}/model")) == want == plain(Pipeline.load(f"{tmp_path}/pipeline").fit(docs))
    counts = sp.term_counts(sp.token_rows(docs, "id", "body"))
    idf = {r.token: r.idf for r in sp.vocabulary(counts, 5).collect()}
    ids = {t: i for i, t in enumerate(sorted(idf), 1)}
    by_id = {w[0]: w for w in want}
    assert by_id[10][1] == sorted([ids["car"], ids["the"]]) and dict(zip(by_id[10][1], by_id[10][2]))[ids["the"]] == round(2 * idf["the"], 9)
    assert by_id[11][1:3] == ([], []) and by_id[12][1:3] == ([], []) and by_id[2][3] == [1.0, 2.0] and by_id[10][3] is None
    model = fitted.stages[0]
    assert isinstance(model, SparseEncoderModel) and SparseEncoderModel.load(f"{tmp_path}/model/stages/0_{model.uid}").uid == model.uid
    with pytest.raises(Exception, match="has not 3 numbers"):
        EmbeddingLookup(inputCol="body", modelName="m", path=f"{tmp_path}/vectors", size=3).transform(docs).collect()
