"""Records, provenance, constraints, evidence, costs, verification and provider batches on awkward rows."""

import datetime as dt
import json

from pyspark.sql import functions as F

from stratalex.operators import evaluation as ev
from stratalex.operators import index as ix
from stratalex.operators import quality, records, search, validation, verification
from stratalex.sources import files


def test_attribution_is_exact(spark):
    provisions = spark.createDataFrame([("a", ["1", "1", "2"]), ("b", ["1", "2"]), ("c", None), ("d", [])], "provision_id string, source_element_ids array<string>")
    sources = spark.createDataFrame([("a", "v1", "BASE_TEXT", "1", 1), ("a", "v2", "AMENDMENT_TEXT", "1", 9), ("a", "v2", "AMENDMENT_TEXT", "2", 9), ("b", "v1", "BASE_TEXT", "1", 1), ("b", "v1", "BASE_TEXT", "1", 1), ("c", "v1", "BASE_TEXT", "5", 1), ("x", "v1", "BASE_TEXT", "5", 1)], "provision_id string, source_version_id string, role string, element_id string, page_number int")
    good, bad = records.attributed(provisions, sources)
    assert [r.provision_id for r in good.collect()] == ["a"] * 3
    assert {r.provision_id: (r.expected, r.attributed) for r in bad.collect()} == {"b": (["1", "2"], ["1", "1"]), "c": ([], ["5"])}
    empty = provisions.limit(0).withColumn("page_number", F.lit(1))
    assert [tuple(r) for r in records.provenance_coverage(empty).collect()] == [(0.0, 0)]


def test_constraints(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    rows = [(1, "p", 1, "ACCEPTED", day(0), day(5), "x"), (2, "p", 1, "ACCEPTED", day(5), None, None), (3, "p", 2, "ACCEPTED", day(9), day(9), "y"), (4, "p", 2, "PENDING", day(1), day(3), "x"), (5, None, 1, "PENDING", None, None, "x"), (6, None, 1, "PENDING", None, day(1), "x"), (7, "p", 3, "ACCEPTED", day(7), day(8), "x")]
    held = spark.createDataFrame(rows, "id long, p string, version int, status string, f date, t date, parent string")
    parents = spark.createDataFrame([("x",), (None,)], "k string")
    accepted = F.col("status") == "ACCEPTED"
    got = records.violations(held, "id", {"unique": (("p", "version"), None), "one": (("p",), ~accepted)}, {"order": F.col("t") > F.col("f")}, {"parent": ("parent", parents, "k")}, {"apart": ("p", "f", "t", accepted)})
    assert sorted((r.constraint, r.key) for r in got.collect()) == [("apart", "7"), ("order", "3"), ("parent", "3"), ("unique", "2"), ("unique", "4")]
    assert records.repeated_in_order(held.withColumn("g", F.lit(1)), "version", "g", "id").first().ids == [1, 2]
    assert [(r.id, r.place) for r in records.queued(held, 2, "PENDING", "id").orderBy("place").collect()] == [(4, 1), (5, 2)]


def test_evidence_and_costs(spark):
    required = spark.createDataFrame([(1, "a", 10), (1, "a", 11), (1, "b", 12), (2, "a", 10), (3, "a", 9)], "query_id int, category string, unit_id int")
    found = spark.createDataFrame([(1, 11, 3), (1, 12, 11), (2, 10, 10), (3, 9, 1)], "query_id int, unit_id int, rank int")
    got = ev.evidence_metrics(required, found, spark.createDataFrame([(1,), (2,), (2,), (7,)], "query_id int"))
    assert sorted((r.query_id, r.recall, r.all_at_k, r.hops, r.complete) for r in got.collect()) == [(1, 1.0, False, 2, True), (2, 1.0, True, 1, None)]
    usage = spark.createDataFrame([("v", 1, "m", 1_000_000, 0), ("v", 2, "m", 0, 500_000), ("w", 1, "none", 5, 5)], "variant string, query_id int, model string, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("m", "0.1", "4")], "model string, input_price string, output_price string")
    assert sorted((r.variant, r.queries, r.tokens, r.cost, r.cost_per_query) for r in ev.costs(usage, prices, "variant").collect()) == [("v", 2, 1_500_000, 2.1, 1.05), ("w", 1, 10, None, None)]


def test_scores_by_label(spark):
    units = spark.createDataFrame([(i, i % 3 if i < 9 else None) for i in range(10)], "unit_id long, label int")
    asked = units.filter("unit_id in (0, 4, 9)").withColumnRenamed("unit_id", "query_id")
    ranked = spark.createDataFrame([(0, 3, 1), (0, 1, 2), (0, 6, 3), (4, 2, 1), (4, 7, 12)], "query_id long, unit_id long, rank int")
    relevant = spark.createDataFrame([(q, u) for q in (0, 4) for u in range(9) if u % 3 == q % 3 and u != q], "query_id long, unit_id long")
    plain = lambda df: sorted(tuple(r) for r in df.select("query_id", "recall", "mrr", "ndcg").collect())
    assert plain(ev.scores_by_label(ranked, asked, units)) == plain(ev.retrieval_scores(ranked, relevant))


def test_six_layers(spark):
    day = dt.date(2024, 1, 1)
    answers = [(i, "text", day) for i in range(1, 8)] + [(8, " ", day), (9, "text", None), (10, "none", day)]
    claims = [(i, 1, "phạt 800.000 đồng") for i in range(1, 10)]
    claims[3] = (4, 1, "phạt 900,000 đồng")
    claims[4] = (5, 1, "something else entirely")
    cites = [(i, 1, {2: "gone", 3: "old"}.get(i, "p")) for i in range(1, 10)]
    provisions = [("p", 1, "Phạt tiền 800000 đồng", "penalty", "ACCEPTED", dt.date(2023, 1, 1), None), ("old", 2, "phạt 800.000 đồng", "penalty", "ACCEPTED", dt.date(2020, 1, 1), day), ("p", 3, "x", "y", "PENDING", dt.date(2020, 1, 1), None)]
    frame = spark.createDataFrame
    context = frame([(a, p) for a, _, p in cites if a != 6], "answer_id int, provision_id string")
    got = verification.verified_answers(
        frame(answers, "answer_id int, text string, query_date date"), frame(claims, "answer_id int, claim_id int, text string"), frame(cites, "answer_id int, claim_id int, provision_id string"), context,
        frame(provisions, "provision_id string, row_id long, text string, category string, review_status string, effective_from date, effective_to date"), frame([(i, "penalty") for i in range(1, 7)] + [(7, "speed"), (7, "penalty")], "answer_id int, category string"),
    )
    failed = {r.answer_id: [n for n in verification.LAYERS if not r[n]] for r in got.collect()}
    assert failed == {1: [], 2: ["citations", "temporal", "numbers", "support", "evidence"], 3: ["temporal", "numbers", "support", "evidence"], 4: ["numbers"], 5: ["support"], 6: ["citations"], 7: ["evidence"], 8: ["schema"], 9: ["schema", "temporal", "numbers", "support"], 10: ["schema", "citations", "temporal", "numbers", "support"]}
    assert {r.answer_id for r in got.collect() if r.valid} == {1} and next(r.checked for r in got.collect() if r.answer_id == 1) == [1]


def test_manifest_schema(spark):
    good = {"document_id": "nd-168-2024", "source_url": "https://a.b/c", "downloaded_at": "2024-01-02", "file_hash": "a" * 64, "document_number": "1", "document_type": "LAW", "issuer": "x", "issued_date": "2024-01-01", "effective_from": None, "effective_to": None, "status": "UNKNOWN", "relation_notes": "", "review_status": "PENDING"}
    cases = {
        "good": (good, []), "reviewed": (good | {"review_status": "ACCEPTED", "effective_from": "2024-01-01", "reviewed_by": "r", "reviewed_at": "2024-01-01T00:00:00+07:00"}, []),
        "undated": (good | {"review_status": "ACCEPTED", "reviewed_by": "r", "reviewed_at": "2024-01-01"}, ["accepted_undated"]), "alone": (good | {"review_status": "REJECTED"}, ["missing:reviewed_at", "missing:reviewed_by"]),
        "types": (good | {"issuer": None, "relation_notes": [1], "status": 3}, ["type:issuer", "type:relation_notes", "type:status"]), "empty": (good | {"issuer": "", "document_id": "ND", "issued_date": "01/02/2024"}, ["value:document_id", "value:issued_date", "value:issuer"]),
        "ends": (good | {"effective_from": "2024-05-01", "effective_to": "2024-05-01T23:59:59Z"}, ["interval"]), "more": (good | {"a": 1, "b": 2}, ["unknown:a", "unknown:b"]),
        "few": ({k: v for k, v in good.items() if k != "effective_to"}, ["missing:effective_to"]),
    }
    rows = [(k, json.dumps(v)) for k, (v, _) in cases.items()] + [("text", "no json"), ("list", "[1]"), ("none", None)]
    got = {}
    for r in validation.manifest_schema_errors(spark.createDataFrame(rows, "k string, raw string"), "k", "raw").collect():
        got.setdefault(r.k, []).append(r.error)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(e) for k, (_, e) in cases.items() if e} | {"text": ["not_object"], "list": ["not_object"], "none": ["not_object"]}


def test_provider_batches_and_uploads(spark, tmp_path):
    texts = spark.createDataFrame([(b, p, f"t{b}{p}") for b in range(4) for p in range(2)], "batch int, place int, text_id string")
    answers = spark.createDataFrame([(0, 1, [1.0, 2.0]), (0, 0, [3.0, 4.0]), (1, 0, [1.0, 2.0]), (2, 0, [1.0]), (2, 0, [1.0, None])], "batch int, index int, embedding array<double>")
    found, errors = search.provider_vectors(texts, answers, 2)
    assert {r.text_id: r.embedding for r in found.collect()} == {"t00": [3.0, 4.0], "t01": [1.0, 2.0]}
    assert sorted(map(tuple, errors.collect())) == [(1, "count"), (2, "dimension"), (2, "index"), (2, "not_numeric"), (3, "count")]
    uploads = spark.createDataFrame([(1, "h", "a.PDF", None, 5), (2, "h", "b.pdf", "text/plain", 5), (3, None, "c.pdf", "application/pdf", 5), (4, None, None, "application/pdf", 5), (5, "k", "d.pdf.exe", None, 5), (6, "m", "e.pdf", None, None), (7, "n", "f.pdf", None, 5)], "upload_id int, file_hash string, file_name string, mime string, bytes long")
    assert sorted(r.upload_id for r in files.accepted_uploads(uploads, spark.createDataFrame([("n",), (None,)], "file_hash string")).collect()) == [1, 3, 4]
    store = ix.VersionedIndex(spark, f"file://{tmp_path}/index")
    assert store.current() is None and store.read().count() == 0 and store.read("v9").columns == ["point_id", "content_hash"]


def test_layout_pairs(spark):
    assert quality.order_pairs([(1, (0.1, 0)), (1, (0.2, 0)), (2, (0.1, 0)), (3, (0.3, 0))]) == (4, 3)
    rows = [("a", 1, i, 0.1 * (i % 3), 0.0) for i in range(9)] + [("b", 1, 1, None, None)]
    elements = spark.createDataFrame(rows, "doc_id string, page_number int, reading_order int, top double, left double")
    pairs = [(x, y) for i, x in enumerate(rows[:9]) for y in rows[i + 1 : 9] if round(x[3], 2) != round(y[3], 2)]
    got = {r.doc_id: r.layout_coherence for r in quality.layout_coherence(elements, spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")).collect()}
    assert got == {"a": round(sum(y[3] > x[3] for x, y in pairs) / len(pairs), 6), "b": None, "c": 1.0}
