"""The object store, the versioned index, and sources that no named query reads."""

import pytest
from pyspark.sql import functions as F

from stratalex.operators import index as ix
from stratalex.operators import search as se
from stratalex.sources import files as fi


def test_object_store(spark, tmp_path):
    store = fi.ObjectStore(spark, f"file://{tmp_path}/objects")
    store.put("a/one.bin", b"\x00one")
    store.put("a/two words+.txt", b"two")
    store.put("a/one.bin", b"new")
    assert store.get("a/one.bin") == b"new" and store.get("a/two words+.txt") == b"two"
    assert {(r.key, r.bytes) for r in store.list("a/").collect()} == {("a/one.bin", 3), ("a/two words+.txt", 3)}
    assert store.delete("a/one.bin") and not store.delete("a/one.bin")
    with pytest.raises(KeyError):
        store.get("a/one.bin")
    for key in ("../x", "/x", "a//b", "a\\b"):
        with pytest.raises(ValueError):
            store.put(key, b"")


def test_versions_and_alias(spark, tmp_path):
    index = ix.VersionedIndex(spark, f"file://{tmp_path}/index")
    points = spark.createDataFrame([(1, "a"), (2, "b")], "point_id int, content_hash string")
    assert index.current() is None and index.rebuild("v1", points) and index.current() == "v1"
    index.write("v2", points.limit(1))
    assert not index.switch("v2", 2) and index.current() == "v1"
    assert index.rebuild("v3", points) and index.current() == "v3" and index.read().count() == 2
    assert (tmp_path / "index" / "alias").is_file()  # one file, replaced whole


def test_first_available_and_filled(spark):
    a, b = (spark.createDataFrame(rows, "k int, x string") for rows in ([(1, "a")], [(1, "b"), (2, "b")]))
    assert {tuple(r) for r in fi.first_available([a, b], "k").select("k", "x").collect()} == {(1, "a"), (2, "b")}
    vectors = spark.createDataFrame([(1, [1]), (2, [])], "unit_id int, indices array<int>")
    assert [r.unit_id for r in ix.filled(vectors).collect()] == [1]


def test_dense_search_against_brute_force(spark):
    import math
    import random

    r = random.Random(3)
    rows = [(i, [r.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(300)] + [(300, None), (301, [0.0] * 4), (302, [1.0])]
    vectors = spark.createDataFrame(rows, "unit_id bigint, embedding array<float>").repartition(5)
    queries = vectors.filter("unit_id % 10 = 0").select(F.col("unit_id").alias("query_id"), "embedding")
    good = [(i, x) for i, x in rows if x and len(x) == 4]
    norm = lambda x: math.sqrt(sum(c * c for c in x))
    want = {}
    for q, x in good:
        if q % 10 == 0 and norm(x):
            scored = sorted((-round(sum(a * b for a, b in zip(x, y)) / (norm(x) * norm(y)), 6), u) for u, y in good if u != q and norm(y))
            want |= {(q, u): (round(-s, 6), k + 1) for k, (s, u) in enumerate(scored[:7])}
    for per_pass in (1000, 7):
        got = {(g.query_id, g.unit_id): (g.score, g["rank"]) for g in se.dense_top_k(queries.filter("embedding is not null"), vectors, 7, 4, per_pass).collect()}
        assert got == want


def test_outcomes_go_to_their_sinks_and_redeliveries_go(spark, tmp_path):
    from stratalex.streaming import jobs

    rows = spark.createDataFrame([(1, "retry"), (2, "dead_letter"), (3, "retry")], "job_id int, outcome string")
    write = jobs.split_sink(f"{tmp_path}/ok", f"{tmp_path}/dead")
    for _ in range(2):  # a batch that runs again replaces its own rows
        write(rows, 7)
    assert spark.read.parquet(f"{tmp_path}/ok").count() == 2 and [r.job_id for r in spark.read.parquet(f"{tmp_path}/dead").collect()] == [2]
    sent = [(1, "PARSED", "2024-01-01 10:00:00"), (1, "PARSED", "2024-01-01 10:00:09"), (1, "GATED", "2024-01-01 10:00:10"), (2, "PARSED", "2024-01-01 10:00:11")]
    stream = spark.createDataFrame(sent, "job_id int, stage string, t string").selectExpr("job_id", "stage", "cast(t as timestamp) as ts")
    stream.coalesce(1).write.parquet(f"{tmp_path}/in")
    once = jobs.stream_without_redelivery(spark.readStream.schema(stream.schema).parquet(f"{tmp_path}/in"))
    once.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.job_id, r.stage) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, "GATED"), (1, "PARSED"), (2, "PARSED")]


def test_scans_certify_nothing(spark):
    from stratalex.operators.quality import certified

    gates = spark.createDataFrame([(1, True, "passed", "passed", "passed"), (2, False, "passed", "passed", "passed")], "doc_id int, scan boolean, provenance_coverage_gate string, text_extraction_rate_gate string, group_a string")
    got = {r.doc_id: (r.provenance_coverage_gate, r.text_extraction_rate_gate, r.group_a) for r in certified(gates, F.col("scan")).collect()}
    assert got == {1: ("failed",) * 3, 2: ("passed",) * 3}


def test_latest_parse_and_annotations(spark, tmp_path):
    from stratalex.operators.elements import latest_parse

    parses = spark.createDataFrame([("d", "2024-01-01", 1), ("d", "2024-02-01", 2), ("d", "2024-02-01", 3), ("e", "2023-01-01", 4)], "document_id string, parse_started_at string, parsed_document_id int")
    assert {r.parsed_document_id for r in latest_parse(parses).collect()} == {3, 4}
    (tmp_path / "a.json").write_text('{"provision_id": "x",\n "expected": "y"}')
    assert [tuple(r) for r in fi.annotations(spark, f"file://{tmp_path}/a.json", "provision_id string, expected string").collect()] == [("x", "y")]
