"""Text functions, intervals, gates, index versions and jobs at their boundaries."""

import datetime as dt
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from stratalex.functions import text as tx
from stratalex.operators import index, quality, search, temporal
from stratalex.sources import files
from stratalex.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text(spark):
    lit = F.lit
    assert one(spark, tx.clean(lit("  Diều  5\n"))) == "Điều 5".replace("Đ", "D").replace("iều", "iều")
    assert one(spark, tx.provision_text(lit("a)Xe  đ)ô"))) == "a) Xe đ) ô"
    assert one(spark, tx.tokens(lit("Xe Ô-tô 12 và ĐI_bộ"))) == ["xe", "ô", "tô", "và", "đi", "bộ"]
    assert one(spark, tx.tokens(lit("xe và tôi"), True)) == ["xe", "tôi"]
    assert one(spark, tx.roman_letters(lit("Ⅻ ⅳ"))) == "XII iv" and one(spark, tx.roman_value(lit("MCMXCIV"))) == 1994 and one(spark, tx.roman_value(lit("A"))) is None
    assert [one(spark, tx.point_label(lit(x), lit(n).cast("int"))) for x, n in (("d)", 4), ("d)", 5), ("d)", 1), ("Đ)", None), ("điểm g)", None), ("x", 1))] == ["d)", "đ)", None, "đ)", "g)", None]
    assert one(spark, tx.slug(lit("168/2024/NĐ-CP"))) == "168-2024" and one(spark, tx.valid_id(lit("nd-168-2024__dieu-5__khoan-2__diem-đ"))) and not one(spark, tx.valid_id(lit("nd-168__dieu-5"))) and not one(spark, tx.valid_id(lit("nd__khoan-2")))
    assert one(spark, tx.parsed_date(lit("30/02/2024"))) is None and one(spark, tx.parsed_date(lit("ngày 1 tháng 2 năm 2024"))) == dt.date(2024, 2, 1)
    assert one(spark, tx.leaked_header(lit("CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM\nĐộc lập – Tự do – Hạnh phúc"))) and not one(spark, tx.leaked_header(lit("Độc lập - Tự do - Hạnh phúc")))
    assert one(spark, tx.reference_text(lit(" Theo «Điều 5», khoản 1; "))) == "theo điều 5 khoản 1"
    assert one(spark, tx.is_short_point(lit("POINT"), lit("a) xe máy"))) and not one(spark, tx.is_short_point(lit("POINT"), lit("a) xe máy điện")))


@pytest.mark.parametrize("day,valid", [("2024-01-01", True), ("2024-05-31", True), ("2024-06-01", False), ("2023-12-31", False)])
def test_half_open(spark, day, valid):
    rows = [(1, "ACCEPTED", dt.date(2024, 1, 1), dt.date(2024, 6, 1)), (2, "PENDING", dt.date(2020, 1, 1), None), (3, "ACCEPTED", None, None)]
    p = spark.createDataFrame(rows, "id int, review_status string, effective_from date, effective_to date")
    assert [r.id for r in temporal.valid_versions(p, F.to_date(F.lit(day))).collect()] == ([1] if valid else [])


def test_overlap_and_open_end(spark):
    d = dt.date
    rows = [("a", 1, d(2024, 1, 1), d(2024, 6, 1)), ("a", 2, d(2024, 6, 1), None), ("a", 3, d(2025, 1, 1), None), ("b", 1, d(2024, 1, 1), None)]
    p = spark.createDataFrame([(*r, "ACCEPTED") for r in rows], "provision_id string, version int, effective_from date, effective_to date, review_status string")
    assert [(r.provision_id, r.version) for r in temporal.overlaps(p).collect()] == [("a", 3)]


def test_relations_keep_both_directions(spark):
    e = spark.createDataFrame([(1, 2, "AMENDS", "ACCEPTED", "RESOLVED"), (2, 1, "AMENDS", "ACCEPTED", "RESOLVED"), (1, 3, "GUIDES", "PENDING", "RESOLVED")], "source_row int, target_row int, relation_type string, review_status string, resolution_status string")
    p = spark.createDataFrame([(i, "ACCEPTED", dt.date(2020, 1, 1), None) for i in (1, 2, 3)], "row_id int, review_status string, effective_from date, effective_to date")
    got = temporal.related(p.filter("row_id = 1"), e, p, F.to_date(F.lit("2024-01-01"))).collect()
    assert sorted((r.other, r.direction) for r in got) == [(2, "inbound"), (2, "outbound")]


def test_gates(spark):
    assert one(spark, quality.gate(F.lit(0.9), 0.9)) == "passed" and one(spark, quality.gate(F.lit(None).cast("double"), 0.9)) == "na"
    assert one(spark, quality.verdict(F.lit("passed"), F.lit("failed"))) == "failed" and one(spark, quality.verdict(F.lit("na"), F.lit("na"))) == "na"
    assert one(spark, search.verified(F.lit(True), F.lit(None).cast("boolean"))) is False


def test_fusion(spark):
    a = spark.createDataFrame([(0, 10, 1), (0, 11, 2)], "query_id int, unit_id int, rank int")
    b = spark.createDataFrame([(0, 11, 1)], "query_id int, unit_id int, rank int")
    assert [(r.unit_id, r.score) for r in search.fuse([a, b]).orderBy("rank").collect()] == [(11, round(1 / 62 + 1 / 61, 6)), (10, round(1 / 61, 6))]


def test_index_versions(spark, tmp_path):
    store = index.VersionedIndex(spark, f"file://{tmp_path}/index")
    points = spark.createDataFrame([(1, "a"), (2, "b")], "point_id int, content_hash string")
    assert store.current() is None and store.rebuild("v1", points) and store.current() == "v1"
    store.write("v2", points.limit(1))
    assert not store.switch("v2", 2) and store.current() == "v1"
    with pytest.raises(Exception, match="(?i)exist"):
        store.write("v1", points)
    assert store.rebuild("v3", points) and store.current() == "v3" and store.read().count() == 2
    stale = spark.createDataFrame([(1, None), (3, "c")], "point_id int, content_hash string")
    assert {tuple(r) for r in index.diff(points, stale).collect()} == {(1, "stale"), (2, "missing"), (3, "extra")}
    assert index.diff(points, index.reconciled(points, stale)).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.manifest.json").write_text('{"document_id": "nd-1", "status": "EFFECTIVE", "other": 1}')
    (tmp_path / "a" / "x.json").write_text("{}")
    got = files.manifests(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].document_id == "nd-1" and got[0].issuer is None
    assert one(spark, files.object_key(F.lit("a"), F.lit("../b"))) is None and one(spark, files.object_key(F.lit("a"), F.lit("b"))) == "a/b"
    vocab = spark.createDataFrame([("x", 1)], "token string, token_id int")
    assert files.vocabulary(spark, str(tmp_path), "1", vocab).count() == 1 and files.vocabulary(spark, str(tmp_path), "1", vocab.union(vocab)).count() == 1
    files.write_once(vocab, f"{tmp_path}/run")
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_once(vocab, f"{tmp_path}/run")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, 0, i % 60, i // 60), i % 7, ("RECEIVED", "PARSED", "NORMALIZED", "EXTRACTED")[(i * 5) % 4]) for i in range(200)]
    m = spark.createDataFrame(rows, "event_id bigint, ts timestamp, job_id bigint, stage string")
    for k in range(2):
        m.filter(f"event_id % 2 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(m.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = jobs.job_states(stream).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("states").groupBy("job_id").agg(F.max_by("stage", "messages").alias("stage"), F.max("messages").alias("messages"))
    assert {tuple(r) for r in last.collect()} == {(r.job_id, r.stage, r.messages) for r in jobs.job_status(m).collect()}


def test_retries(spark):
    rows = [(i, 1, "PARSED", dt.datetime(2024, 1, 1, 0, i), i != 9) for i in range(4)] + [(9, 2, "PARSED", dt.datetime(2024, 1, 1), False)]
    plan = {r.event_id: (r.outcome, r.wait_s) for r in jobs.retry_plan(spark.createDataFrame(rows, "event_id int, job_id int, stage string, ts timestamp, transient boolean")).collect()}
    assert plan == {0: ("retry", 15), 1: ("retry", 30), 2: ("dead_letter", None), 3: ("dead_letter", None), 9: ("dead_letter", None)}


def test_text_in_normal_form_skips_python(spark):
    """The ranges hold what NFC never changes, and only other texts are given to Python."""
    held = [chr(c) for low, high in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", tx.SETTLED) for c in range(int(low, 16), int(high, 16) + 1)]
    joined = {c for x in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if len(unicodedata.normalize("NFD", x)) > 1 for c in unicodedata.normalize("NFD", x)[1:]}
    assert len(held) > 20_000 and not joined & set(held)
    assert all(unicodedata.is_normalized("NFC", c) and not unicodedata.combining(c) for c in held)
    rows = ["abc", "Điều", "e\u0301 x", "ﬁ", "Å", "", None, "стол и\u0306", "\n\u4e2d"]
    df = spark.createDataFrame([(x,) for x in rows], "t string")
    for form in ("NFC", "NFKC"):
        made = df.select("t", tx.normalised(F.col("t"), form).alias("n"))
        assert {r.t: r.n for r in made.collect()} == {x: x and unicodedata.normalize(form, x) for x in rows}
        assert re.search(r"ArrowEvalPython \[normal\(CASE WHEN", made._jdf.queryExecution().optimizedPlan().toString())
