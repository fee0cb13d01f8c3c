"""Structure recognition against a plain sequential simulation of the same rules, on random marked lines."""

import random
import re

from pyspark.sql import functions as F

from stratalex.functions.text import collapsed
from stratalex.operators import context, quality, structure

LETTERS = "abcdđeghiklmnoôơpqrstuưvxy"


def simulate(lines):
    """Kinds, numbers and labels of one document's (type, text) lines, step by step."""
    out, article, clause, counter, labels, appendix, heading = [], None, None, 0, [], 0, 0
    for place, (kind, text) in enumerate(lines):
        head, _, _ = text.partition(" ")
        if head == "Chương":
            article = clause = None
            counter, labels = 0, []
            out.append((place, "CHAPTER", text.split()[1].rstrip("."), None))
        elif head == "Điều":
            article, clause, counter, labels = text.split()[1].rstrip("."), None, 0, []
            out.append((place, "ARTICLE", article, None))
        elif text.startswith("Phụ lục"):
            rest = text.split()[2:]
            appendix = max(appendix, int(rest[0])) if rest and rest[0].isdigit() else appendix + 1
            number = rest[0] if rest and rest[0].isdigit() else str(appendix)
            article = clause = None
            labels = []
            out.append((place, "APPENDIX", number, None))
        elif head[:-1].isdigit() and head.endswith("."):
            clause, labels = head[:-1], []
            counter = max(counter, int(clause))
            out.append((place, "CLAUSE", clause, None))
        elif len(head) == 2 and head[1] == ")":
            label = head
            if label == "d)" and "d)" in labels and "đ)" not in labels:
                label = "đ)"
            labels.append(label)
            out.append((place, "POINT", None, label))
        elif kind == "list_item" and article is not None:
            if clause is None or text.endswith("như sau:"):
                counter += 1
                clause, labels = str(counter), []
                out.append((place, "CLAUSE", clause, None))
            else:
                label = next((f"{x})" for x in LETTERS if f"{x})" not in labels), "a)")
                labels.append(label)
                out.append((place, "POINT", None, label))
        elif kind == "heading":
            heading += 1
            out.append((place, "HEADING", str(heading), None))
    return out


def random_lines(r):
    kinds = [("p", "Chương I. x"), ("p", "Điều {n}. tên"), ("p", "{n}. khoản"), ("p", "a) điểm"), ("p", "d) điểm"), ("p", "d) điểm"), ("p", "đ) điểm"), ("list_item", "mục"), ("list_item", "mục như sau:"), ("heading", "đề mục"), ("p", "Phụ lục"), ("p", "Phụ lục {n}"), ("p", "văn xuôi")]
    return [(k, t.format(n=r.randint(1, 6)) + (f" {i}" if t.endswith("điểm") else "")) for i in range(r.randint(3, 25)) for k, t in [r.choice(kinds)]]


def test_simulation(spark):
    r = random.Random(4)
    docs = {f"nd-{i}": random_lines(r) for i in range(120)}
    rows = [(d, 1, i, k, t, 0.5, 0.6) for d, lines in docs.items() for i, (k, t) in enumerate(lines)]
    elements = spark.createDataFrame(rows, "doc_id string, page_number int, reading_order int, element_type string, text string, top double, bottom double")
    got = structure.nodes(elements.repartition(3)).select("doc_id", "reading_order", "kind", "number", "label").collect()
    want = {(d, *row) for d, lines in docs.items() for row in simulate(lines)}
    assert {tuple(g) for g in got} == want


def test_provisions_and_context(spark):
    lines = ["Chương I. Chung", "Điều 5. Phạt", "1. Phạt tiền", "a) vượt đèn", "d) đi ngược", "d) dừng sai", "2. Phạt khác", "a) khác", "b) x", "Điều 6a. Lạ", "1. mất"]
    rows = [("nd-1", 1, i, "p", t, 0.5, 0.6) for i, t in enumerate(lines)]
    e = spark.createDataFrame(rows, "doc_id string, page_number int, reading_order int, element_type string, text string, top double, bottom double")
    p = structure.provisions(structure.nodes(e))
    ids = [r.provision_id for r in p.orderBy("reading_order").collect()]
    assert ids == ["nd-1__dieu-5", "nd-1__dieu-5__khoan-1", "nd-1__dieu-5__khoan-1__diem-a", "nd-1__dieu-5__khoan-1__diem-d", "nd-1__dieu-5__khoan-1__diem-đ", "nd-1__dieu-5__khoan-2", "nd-1__dieu-5__khoan-2__diem-a", "nd-1__dieu-5__khoan-2__diem-b"]
    rich = {r.provision_id: r for r in context.enriched(p).collect()}
    assert rich["nd-1__dieu-5__khoan-1__diem-a"].parent_context == "Khoản 1. Phạt tiền"
    assert rich["nd-1__dieu-5__khoan-1"].parent_context == "Điều 5. Phạt" and rich["nd-1__dieu-5"].parent_context is None
    assert context.completeness(context.enriched(p)).first().completeness == 1.0
    assert quality.hierarchy(p).first().asDict() == {"doc_id": "nd-1", "n": 8, "orphan_clauses": 0, "orphan_points": 0, "duplicates": 0, "point_label_detection": 1.0}


def test_context_text(spark):
    one = spark.createDataFrame([("Chương I Điều 5. Phạt tiền đối với xe 1. Người đi bộ 2. Người lái xe",)], "c string")
    r = one.select(context.lead_in_by_number(F.col("c"), F.lit("2")).alias("a"), context.article_heading(F.col("c")).alias("b"), context.lead_in_after_article(F.col("c")).alias("d")).first()
    assert r.a == "Khoản 2. Người lái xe" and r.b == "Điều 5. Phạt tiền đối với xe" and r.d == "Khoản 2. Người lái xe"


def allocated(numbers):
    out, used, last = [], set(), 0
    for n in numbers:
        n = last + 1 if n is None else n
        while n in used:
            n += 1
        used.add(n)
        out.append(n)
        last = n
    return out


def test_table_ordinals(spark):
    """Numbers asked for, numbers after the last one given, and the next free one, against a step by step search."""
    r = random.Random(8)
    cases = {"a": [5, None, 2, None], "b": [2, 2, None, 1], "c": [None], "d": [None, 1, 1, 1, None], "e": [0, None, 0, 10**12, None]}
    cases |= {f"r{i}": [r.choice([None, r.randint(0, 12)]) for _ in range(r.randint(1, 60))] for i in range(40)}
    rows = [(p, i, None if n is None else str(n)) for p, numbers in cases.items() for i, n in enumerate(numbers)]
    rows += [("word", 0, "x"), ("word", 1, "3a"), (None, 0, "2"), (None, 1, None)]
    got = {(t.parent_id, t.reading_order): t.ordinal for t in structure.table_ordinals(spark.createDataFrame(rows, "parent_id string, reading_order int, number string").repartition(5)).collect()}
    assert got == {(p, i): n for p, numbers in cases.items() for i, n in enumerate(allocated(numbers))} | {("word", 0): 1, ("word", 1): 2, (None, 0): 2, (None, 1): 3}
    assert [got["a", i] for i in range(4)] == [5, 6, 2, 3]


def test_many_tables_of_one_parent(spark):
    """All ask for number 1: linear work, not a search of what the others took."""
    import time

    n, began = 100_000, time.time()
    t = spark.range(n).selectExpr("'p' as parent_id", "id as reading_order", "1 as number")
    got = structure.table_ordinals(t).selectExpr("min(ordinal - reading_order) as low", "max(ordinal - reading_order) as high", "count(*) as n").first()
    assert (got.low, got.high, got.n) == (1, 1, n) and time.time() - began < 30


def test_tables_contexts_and_drops(spark):
    lines = [("table", "mất"), ("p", "Chương I. Chung"), ("p", "Mục 1. Đầu"), ("p", "Điều 5. Phạt"), ("table", "Bảng 5. năm"), ("p", "1. Phạt tiền"), ("table", "không số"), ("p", "Bảng 2: hai"), ("table", "sau hai"), ("heading", "đề mục")]
    lines += [("p", "Chuyển tiếp"), ("p", "3. mất khoản"), ("table", "mất bảng"), ("p", "Phụ lục II. Mẫu"), ("table", "mẫu"), ("p", "Chương II. Sau"), ("p", "Điều 6a. Lạ"), ("table", "mất nữa"), ("p", "Điều 5. Lặp"), ("table", "lặp")]
    rows = [("nd-1", 1, i, k, t, 0.5, 0.6) for i, (k, t) in enumerate(lines)]
    e = spark.createDataFrame(rows, "doc_id string, page_number int, reading_order int, element_type string, text string, top double, bottom double")
    got = [(r.provision_id, r.parent_context) for r in structure.provisions(structure.contexts(structure.nodes(e))).orderBy("reading_order").collect()]
    head = "Chương I. Chung Mục 1. Đầu"
    assert got == [
        ("nd-1__dieu-5", head), ("nd-1__dieu-5__bang-5", f"{head} Điều 5. Phạt"), ("nd-1__dieu-5__khoan-1", f"{head} Điều 5. Phạt"), ("nd-1__dieu-5__bang-6", f"{head} Điều 5. Phạt 1. Phạt tiền"),
        ("nd-1__dieu-5__bang-2", f"{head} Điều 5. Phạt 1. Phạt tiền"), ("nd-1__dieu-5__bang-3", f"{head} Điều 5. Phạt 1. Phạt tiền"), ("nd-1__tieu-de-1", f"{head} Điều 5. Phạt 1. Phạt tiền"),
        ("nd-1__chuyen-tiep-1", head), ("nd-1__phu-luc-2", head), ("nd-1__phu-luc-2__bang-1", head), ("nd-1__dieu-5", "Chương II. Sau"), ("nd-1__dieu-5__bang-4", "Chương II. Sau Điều 5. Lặp"),
    ]


def test_rows_without_parent_are_dealt(spark):
    """Articles look for no parent: they must not meet in one task as nulls, and get none."""
    rows = [(1, f"nd-1-2024__dieu-{n}", "ARTICLE", f"Điều {n}.", str(n), str(n), None) for n in range(5)] + [(1, "nd-1-2024__dieu-2__khoan-1", "CLAUSE", "1. x", "2", "1", "1")]
    up = context.with_parents(spark.createDataFrame(rows, "doc_id long, provision_id string, kind string, line string, article string, number string, clause string"))
    assert {r.provision_id: r.parent_line for r in up.collect()} == {r[1]: "Điều 2." if r[2] == "CLAUSE" else None for r in rows}
    assert "coalesce(parent_id" in up._jdf.queryExecution().optimizedPlan().toString()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_made_once(spark):
    """White space is collapsed in one place of the plan and rows are dealt by document once before their labels and once behind, with or without boxes at an edge."""
    for top in ("0.5", "rand()"):
        e = spark.range(40).selectExpr("id % 4 as doc_id", "1 as page_number", "cast(id as int) as reading_order", "'p' as element_type", "concat('Điều ', id) as text", f"{top} as top", "0.5 as bottom")
        plan = _plan(structure.provisions(structure.contexts(structure.nodes(e))))
        assert plan.count("regexp_replace(text") == 1 and plan.count("Range (") == 1


def test_scopes_share_one_order(spark):
    """Runs, clauses and counters need no order of their own."""
    e = spark.createDataFrame([("nd-1", 1, 0, "p", "Điều 5. x", 0.5, 0.6)], "doc_id string, page_number int, reading_order int, element_type string, text string, top double, bottom double")
    windows = [x for x in _plan(structure.nodes(e)).split("\n") if "Window [" in x]
    assert windows and not any("scope_run" in x.rsplit("], [", 2)[1] or "article_run" in x.rsplit("], [", 2)[1] for x in windows)


def test_many_points_of_one_document(spark):
    """Ids given before are dropped and tables numbered in one pass, whatever stands between them."""
    lines = [("p", "Điều 5. x"), ("p", "1. y"), ("p", "a) z"), ("table", "một"), ("p", "a) lặp"), ("p", "Điều 7. x"), ("table", "hai"), ("p", "Điều 5. x"), ("p", "1. y"), ("p", "a) lặp nữa"), ("table", "ba")]
    rows = [(d, 1, i, k, t, 0.5, 0.6) for d in ("nd-1", "nd-2") for i, (k, t) in enumerate(lines)]
    e = spark.createDataFrame(rows, "doc_id string, page_number int, reading_order int, element_type string, text string, top double, bottom double")
    got = [(r.doc_id, r.provision_id.split("__", 1)[1]) for r in structure.provisions(structure.nodes(e)).orderBy("doc_id", "reading_order").collect()]
    want = ["dieu-5", "dieu-5__khoan-1", "dieu-5__khoan-1__diem-a", "dieu-5__bang-1", "dieu-7", "dieu-7__bang-1", "dieu-5", "dieu-5__khoan-1", "dieu-5__bang-2"]
    assert got == [(d, x) for d in ("nd-1", "nd-2") for x in want]


def test_parents_read_the_provisions_once(spark):
    from stratalex.plans import structure_q

    assert "MapInArrow" not in _plan(structure_q.parent_join(spark, "/root/testdata/sf0.001"))


def test_lost_labels_read_the_points_once(spark):
    from stratalex.plans import structure_q

    assert _plan(structure_q.missing_point_labels(spark, "/root/testdata/sf0.001")).count("parquet") == 1


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_parents_against_brute_force(spark):
    """Parents by id and by labels, of repeated, nested, nameless and foreign ids; lines cross one exchange, with those by labels too."""
    r, rows = random.Random(11), []
    for i in range(400):
        kind, doc, a = r.choice(["ARTICLE", "CLAUSE", "POINT", "POINT", "TABLE", None]), r.choice([1, 2, 3, None]), r.choice(["1", "2", None])
        number, clause = r.choice(["1", "2", None]), r.choice(["1", "2", None])
        tail = {"ARTICLE": "", "CLAUSE": f"__khoan-{number}", "POINT": r.choice([f"__khoan-{clause}__diem-a", "__diem-đ", f"__khoan-{clause}__khoan-1__diem-\n", "__diem-", ""])}.get(kind, "__bang-1")
        rows.append((i, doc, r.choice([f"nd-{doc}__dieu-{a}{tail}", f"x_{a}{tail}", tail, None]), kind, r.choice([f"line {i}", f"line {i % 7}", None]), a, number, clause))
    schema = "at int, doc_id long, provision_id string, kind string, line string, article string, number string, clause string"
    stripped = lambda x: re.sub(r"__(diem|khoan)-[^_]+\Z", "", x)
    want = {}
    for at, doc, pid, kind, _, a, _, c in rows:
        by_id = [x[4] for x in rows if kind in ("CLAUSE", "POINT") and pid is not None and x[2] == stripped(pid) and x[4] is not None]
        labels = [x[4] for x in rows if kind in ("CLAUSE", "POINT") and x[4] is not None and None not in (doc, a) and (x[1], x[5]) == (doc, a) and x[3] == {"POINT": "CLAUSE", "CLAUSE": "ARTICLE"}[kind] and (kind == "CLAUSE" or x[6] == c)]
        want[at] = min(by_id or labels, default=None)
    up = context.with_parents(spark.createDataFrame(rows, schema).repartition(3))
    assert {x["at"]: x.parent_line for x in up.collect()} == want and up.count() == len(rows)
    assert up.columns == [x.split()[0] for x in schema.split(", ")] + ["parent_id", "parent_line"]
    whole = context.with_parents(spark.createDataFrame(rows, schema))
    assert _exchanges(whole) - whole._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange ") == 1


def test_gold_texts_meet_as_digests(spark):
    found = spark.createDataFrame([("a", "x  y"), ("b", "x z"), ("c", None), ("d", "w")], "provision_id string, retrieval_text string")
    gold = spark.createDataFrame([("a", " x\ny "), ("b", "x y"), ("c", ""), ("e", "w")], "provision_id string, expected string")
    got = context.gold_match(found, gold)
    assert {tuple(r) for r in got.collect()} == {("a", True), ("b", False), ("c", True)}
    assert _plan(got).count("sha2(") == 2 and "expected" not in _plan(got).split("Join", 1)[1].split("\n", 1)[0]
    r = random.Random(3)
    texts = spark.createDataFrame([("".join(r.choice("  a\t\n\u00a0\u3000\x1cé") for _ in range(r.randint(0, 12))),) for _ in range(500)], "t string")
    assert texts.filter(context.as_compared(F.col("t")) != F.unhex(F.sha2(collapsed(F.col("t")), 256))).count() == 0
    made = found.select("provision_id", context.as_compared(found.retrieval_text).alias("retrieval_digest"))
    assert {tuple(r) for r in context.gold_match(made, gold).collect()} == {("a", True), ("b", False), ("c", True)}
