"""Queries of metadata, questions, upserts, outcomes, citations, time and grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.operators import evaluation as ev
from stratalex.operators import index as ix
from stratalex.operators import metadata as me
from stratalex.operators import quality as qu
from stratalex.session import table

from . import views as v
from .catalog import query
from .documents_q import _values

_IN_FORCE = (
    (0, "Nghị định này có hiệu lực thi hành từ ngày 01 tháng 01 năm 2025.", "2025-01-01", "Bộ Công an"),
    (1, "có hiệu lực thi hành kể từ ngày 15/8/2023", "2023-08-15", "Quốc hội"),
    (2, "kể từ ngày 15 tháng 8 năm 2023", None, None),
    (3, "có hiệu lực từ ngày 31/2/2024", None, "Chính phủ"),
)


def _cycle(s: SparkSession, d: str, rows: list[tuple], schema: str) -> DataFrame:
    """A sample row for each document, in turn."""
    return v.documents(s, d).select("doc_id", (F.col("doc_id") % len(rows)).alias("k"), F.coalesce("text", F.lit("")).alias("whole")).join(s.createDataFrame(rows, f"k bigint, {schema}"), "k")


def _before(sample: str) -> Column:
    """A sample before the whole text of its document."""
    return F.concat(sample, F.lit("\n"), "whole")


@query(f"WITH r AS (SELECT * FROM (VALUES {_values(_IN_FORCE)}) t(k, body, day, issuer)) SELECT doc_id, CAST(day AS DATE) AS day, issuer FROM documents JOIN r ON doc_id % 4 = k")
def effective_dates(s: SparkSession, d: str) -> DataFrame:
    rows = _cycle(s, d, [(k, body + " " + (name or "").upper()) for k, body, _, name in _IN_FORCE], "body string")
    return rows.select("doc_id", me.effective_from(_before("body")).alias("day"), me.first_page_issuer(_before("body")).alias("issuer"))


@query(f"WITH {v.ELEMENTS}, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, reading_order) AS n FROM elements WHERE element_type = 'heading' AND trim(text) != '') SELECT doc_id, trim(text) AS title FROM t WHERE n = 1")
def document_titles(s: SparkSession, d: str) -> DataFrame:
    return me.titles(v.elements(s, d))


@query(
    """SELECT doc_id AS document_id, CASE WHEN doc_id % 3 = 0 THEN 'LAW' WHEN doc_id % 2 = 0 THEN 'DECREE' END AS document_type, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 != 0 THEN 'Bộ Y tế' WHEN doc_id % 7 != 0 THEN 'Quốc hội' END AS issuer,
    concat_ws(',', CASE WHEN doc_id % 3 != 0 AND doc_id % 2 != 0 THEN 'document_type' END, CASE WHEN NOT (doc_id % 3 = 0 AND doc_id % 5 != 0) AND doc_id % 7 = 0 THEN 'issuer' END, CASE WHEN doc_id % 4 = 0 THEN 'issued_date' END) AS needs_review FROM documents"""
)
def metadata_merge(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    docs = v.documents(s, d)
    extracted = docs.select(i.alias("document_id"), F.when(i % 2 == 0, "DECREE").alias("document_type"), F.when(i % 7 != 0, "QUỐC HỘI").alias("issuer"), F.when(i % 4 != 0, F.to_date(F.lit("2024-01-01"))).alias("issued_date"))
    manifests = docs.filter("doc_id % 3 = 0").select(i.alias("document_id"), F.lit("LAW").alias("document_type"), F.when(i % 5 == 0, " ").otherwise("Bộ Y Tế").alias("issuer"))
    return me.merged(extracted, manifests).select("document_id", "document_type", "issuer", F.concat_ws(",", "needs_review").alias("needs_review"))


_QUESTIONS = (
    (0, "Hiện nay xe máy vượt đèn đỏ phạt bao nhiêu?", None, None, None, None, "xe máy", "CURRENT", "2024-05-05", None),
    (1, "Năm 2021 Ô TÔ bị phạt gì?", None, "2021", None, None, "ô tô", "HISTORICAL", "2021-07-01", None),
    (2, "Năm 2024 xe tải thì sao", None, "2024", None, None, "xe tải", "HISTORICAL", None, "MISSING_QUERY_DATE"),
    (3, "Điểm a Khoản 2 Điều 7 Nghị định 168/2024/NĐ-CP", None, "2024", "168/2024/NĐ-CP", "7", None, "SOURCE_SEARCH", None, "MISSING_QUERY_DATE"),
    (4, "Ngày 26/12/2019 quy định thế nào", "2019-12-26", "2019", None, None, None, "HISTORICAL", "2019-12-26", None),
    (5, "So sánh  trước và sau", None, None, None, None, None, "COMPARISON", "2024-05-05", None),
)


@query(f"WITH r AS (SELECT * FROM (VALUES {_values(_QUESTIONS)}) t(k, question, day, year, number, article, vehicle, intent, applied, abstain)) SELECT doc_id, CAST(day AS DATE) AS query_date, CAST(year AS INTEGER) AS query_year, number, article, vehicle, intent, CAST(applied AS DATE) AS applied_date, abstain FROM documents JOIN r ON doc_id % 6 = k")
def question_parse(s: SparkSession, d: str) -> DataFrame:
    parsed = me.parsed_questions(_cycle(s, d, [r[:2] for r in _QUESTIONS], "question string"))
    dated = me.dated_questions(parsed, F.to_date(F.lit("2024-05-05")), s.createDataFrame([(2024,)], "query_year int"))
    return dated.select("doc_id", "query_date", "query_year", "number", "article", "vehicle", "intent", "applied_date", "abstain")


_EVIDENCE = (
    (0, "Người đi bộ bị phạt 150.000 đồng", "violation_definition,monetary_penalty"),
    (1, "Tước quyền sử dụng giấy phép lái xe, trừ 2 điểm giấy phép lái xe", "license_points,license_suspension"),
    (2, "Không phạt khi đủ điều kiện theo thủ tục", "exception,procedure,legal_condition"),
    (3, "văn xuôi", ""),
)


@query(f"WITH r AS (SELECT * FROM (VALUES {_values(_EVIDENCE)}) t(k, body, classes)) SELECT doc_id, classes FROM documents JOIN r ON doc_id % 4 = k")
def evidence_detectors(s: SparkSession, d: str) -> DataFrame:
    return _cycle(s, d, [r[:2] for r in _EVIDENCE], "body string").select("doc_id", F.concat_ws(",", me.evidence_classes(_before("body"))).alias("classes"))


@query("SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 2 ELSE 0 END AS phrase_hits, CASE doc_id % 2 WHEN 0 THEN 1 ELSE 0 END AS d_labels, CASE doc_id % 2 WHEN 0 THEN 1 ELSE 0 END AS dd_labels FROM documents")
def scan_counts(s: SparkSession, d: str) -> DataFrame:
    rows = _cycle(s, d, [(0, "XỬ PHẠT d) giấy phép đ) xe"), (1, "abc")], "text string")
    return me.scan_text_counts(rows, ("xử phạt", "giấy phép", "hành chính")).select("doc_id", "phrase_hits", "d_labels", "dd_labels")


@query(f"WITH {v.INDEX}, batch AS (SELECT point_id, content_hash FROM authority WHERE point_id % 2 = 0) SELECT point_id, content_hash FROM snapshot WHERE point_id NOT IN (SELECT point_id FROM batch) UNION ALL SELECT * FROM batch")
def index_upsert(s: SparkSession, d: str) -> DataFrame:
    """Every row comes twice in the batch; the later one is right."""
    a = v.authority(s, d).filter("point_id % 2 = 0")
    batch = a.withColumn("content_hash", F.lit("old")).withColumn("seq", F.lit(1)).unionByName(a.withColumn("seq", F.lit(2)))
    return ix.upserted(v.index_snapshot(s, d), batch)


@query(
    f"""WITH {v.PROVISIONS}, u AS (SELECT sha256(provision_id || '__v' || version) AS point_id, provision_id, version, split_part(provision_id, '__', 1) AS document_id FROM provisions WHERE review_status = 'ACCEPTED')
    SELECT point_id, provision_id, version, u.document_id, CASE WHEN CAST(string_split(u.document_id, '-')[2] AS INTEGER) % 3 != 0 THEN 'n-' || u.document_id END AS document_number FROM u"""
)
def payload_projection(s: SparkSession, d: str) -> DataFrame:
    p = v.provisions(s, d)
    docs = p.select(F.concat(F.lit("nd-"), F.col("document_no").cast("string"), F.lit("-2024")).alias("document_id"), "document_no").distinct().filter("document_no % 3 != 0")
    docs = docs.select("document_id", F.concat(F.lit("n-"), "document_id").alias("document_number"), F.lit("DECREE").alias("document_type"), F.lit("t").alias("document_title"), F.lit("EFFECTIVE").alias("document_status"))
    return ix.payload(ix.units(p), docs).select("point_id", "payload.provision_id", "payload.version", "payload.document_id", "payload.document_number")


@query(f"WITH {v.PROVISIONS} SELECT provision_id, version FROM provisions WHERE review_status = 'ACCEPTED' AND effective_from <= DATE '{v.DAY}' AND (effective_to IS NULL OR effective_to > DATE '{v.DAY}')")
def index_valid_filter(s: SparkSession, d: str) -> DataFrame:
    return ix.valid_units(ix.units(v.provisions(s, d)), F.to_date(F.lit(v.DAY))).select("provision_id", "version")


@query(f"WITH {v.ELEMENTS} SELECT element_type AS node_kind, count(*) AS n FROM elements GROUP BY ROLLUP (element_type)")
def unit_counts(s: SparkSession, d: str) -> DataFrame:
    return ix.unit_counts(v.elements(s, d).withColumnRenamed("element_type", "node_kind"))


@query(
    """WITH a AS (SELECT doc_id, doc_id % 13 != 0 AS ok, CASE WHEN doc_id % 7 = 0 THEN 'failed' WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'passed' END AS a FROM documents), b AS (SELECT doc_id, doc_id % 2 = 0 AS b FROM documents WHERE doc_id % 5 != 0),
    o AS (SELECT CASE WHEN NOT ok THEN 'failed' WHEN a = 'passed' THEN 'accepted' WHEN coalesce(b, false) THEN 'accepted_alternate' ELSE 'review' END AS outcome, doc_id % 4 AS lot FROM a LEFT JOIN b USING (doc_id))
    SELECT 'outcome' AS dimension, outcome AS value, count(*) AS n FROM o GROUP BY outcome UNION ALL SELECT 'lot', CAST(lot AS VARCHAR), count(*) FROM o GROUP BY lot"""
)
def gate_outcomes(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    docs = v.documents(s, d)
    a = docs.select("doc_id", (i % 13 != 0).alias("parser_ok"), (i % 7 == 0).alias("partial"), F.when(i % 3 == 0, "failed").otherwise("passed").alias("group_a"))
    b = docs.filter("doc_id % 5 != 0").select("doc_id", F.lit(True).alias("parser_ok"), F.lit(False).alias("partial"), F.when(i % 2 == 0, "passed").otherwise("na").alias("group_a"))
    return qu.outcome_histogram(qu.gated_outcome(a, b).withColumn("lot", i % 4), "outcome", "lot")


@query("SELECT doc_id, CASE WHEN doc_id % 10 % 3 = 0 THEN '2024-01-01' WHEN doc_id % 2 = 0 THEN '2020-01-01' END AS effective_from, CASE WHEN doc_id % 10 % 3 = 0 THEN NULL ELSE '2021-01-01' END AS effective_to FROM documents")
def manifest_intervals(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    p = v.documents(s, d).select("doc_id", (i % 10).alias("document_id"), F.when(i % 2 == 0, "2020-01-01").alias("effective_from"), F.lit("2021-01-01").alias("effective_to"))
    m = s.range(10).select(F.col("id").alias("document_id"), F.when(F.col("id") % 3 == 0, "EFFECTIVE").otherwise("EXPIRED").alias("status"), F.lit("2024-01-01").alias("effective_from"), F.lit(None).cast("string").alias("effective_to"))
    return qu.manifest_intervals(p, m).select("doc_id", "effective_from", "effective_to")


@query(
    """WITH x AS (SELECT l_orderkey AS item_id, CASE l_returnflag WHEN 'N' THEN 'NEEDS_REVIEW' WHEN 'A' THEN 'ACCEPTED' ELSE 'REJECTED' END AS decision, l_shipdate AS made, l_linenumber * 1000000 + l_partkey AS id FROM lineitem WHERE l_linestatus = 'F'),
    l AS (SELECT item_id, arg_max(CASE decision WHEN 'NEEDS_REVIEW' THEN 'PENDING' ELSE decision END, (made, id)) AS status, count(*) AS n FROM x GROUP BY item_id)
    SELECT o_orderkey AS item_id, coalesce(l.status, 'PENDING') AS status, coalesce(n, 0) AS decisions FROM orders LEFT JOIN l ON o_orderkey = item_id"""
)
def review_decisions(s: SparkSession, d: str) -> DataFrame:
    decision = F.when(F.col("l_returnflag") == "N", "NEEDS_REVIEW").when(F.col("l_returnflag") == "A", "ACCEPTED").otherwise("REJECTED")
    made = table(s, d, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("item_id"), decision.alias("decision"), F.col("l_shipdate").alias("decided_at"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("decision_id"))
    items = table(s, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.lit("PENDING").alias("status"))
    return qu.decided(items, made)


@query(
    """WITH i AS (SELECT event_id, ['L6_EVIDENCE_INCOMPLETE', 'L5_CLAIM_NOT_SUPPORTED', 'L1_SCHEMA_INVALID', 'L3_TEMPORAL_INVALID', 'OTHER'][event_id % 5 + 1] AS issue, user_id % 5 AS attempts FROM events)
    SELECT event_id, CASE WHEN attempts >= 3 OR issue = 'OTHER' THEN 'abstain' ELSE CASE left(issue, 2) WHEN 'L6' THEN 'targeted_retrieval' WHEN 'L5' THEN 'regenerate' WHEN 'L1' THEN 'regenerate_structured' ELSE 'temporal_retry' END END AS step,
    CASE WHEN attempts >= 3 OR issue = 'OTHER' THEN CASE left(issue, 2) WHEN 'L3' THEN 'TEMPORAL_CONFLICT' WHEN 'L6' THEN 'INSUFFICIENT_EVIDENCE' ELSE 'CITATION_VERIFICATION_FAILED' END END AS reason FROM i"""
)
def repair_plan(s: SparkSession, d: str) -> DataFrame:
    codes = F.array(*[F.lit(x) for x in ("L6_EVIDENCE_INCOMPLETE", "L5_CLAIM_NOT_SUPPORTED", "L1_SCHEMA_INVALID", "L3_TEMPORAL_INVALID", "OTHER")])
    issues = table(s, d, "events").select("event_id", F.element_at(codes, (F.col("event_id") % 5 + 1).cast("int")).alias("issue"), (F.col("user_id") % 5).alias("attempts"))
    return qu.repair_plan(issues).select("event_id", "step", "reason")


@query(
    """WITH g AS (SELECT DISTINCT o_custkey AS q, o_orderkey % 50 AS p FROM orders WHERE o_orderkey % 2 = 0), c AS (SELECT DISTINCT o_custkey AS q, o_orderkey % 50 AS p FROM orders WHERE o_orderkey % 3 = 0),
    n AS (SELECT g.q, count(*) AS g, count(c.p) AS tp, (SELECT count(*) FROM c WHERE c.q = g.q) AS c FROM g LEFT JOIN c ON g.q = c.q AND g.p = c.p GROUP BY g.q), r AS (SELECT q, CASE WHEN c > 0 THEN round(tp / c, 6) END AS p, round(tp / g, 6) AS r FROM n)
    SELECT q AS query_id, p AS precision, r AS recall, CASE WHEN p IS NOT NULL THEN CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 6) ELSE 0.0 END END AS f1 FROM r"""
)
def citation_scores(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 50).alias("provision_id"), "o_orderkey")
    return ev.citation_scores(o.filter("o_orderkey % 3 = 0"), o.filter("o_orderkey % 2 = 0"))


@query("SELECT round(avg(CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 40) THEN 0.0 ELSE 1.0 END), 6) AS invalid_rate, count(*) AS n FROM lineitem")
def invalid_citations(s: SparkSession, d: str) -> DataFrame:
    cited = table(s, d, "lineitem").select(F.col("l_partkey").alias("provision_id"))
    return ev.invalid_citation_rate(cited, table(s, d, "part").filter("p_size < 40").select(F.col("p_partkey").alias("provision_id")))


@query(
    f"""WITH {v.PROVISIONS}, c AS (SELECT document_no AS query_id, provision_id, version, effective_from + CAST(version * 30 AS INTEGER) AS day, effective_from, effective_to, review_status FROM provisions)
    SELECT query_id, round(avg(CASE WHEN review_status = 'ACCEPTED' AND effective_from <= day AND (effective_to IS NULL OR day < effective_to) THEN 1.0 ELSE 0.0 END), 6) AS validity, bool_or(NOT (review_status = 'ACCEPTED' AND effective_from <= day AND (effective_to IS NULL OR day < effective_to))) AS leak FROM c GROUP BY query_id"""
)
def temporal_citations(s: SparkSession, d: str) -> DataFrame:
    p = v.provisions(s, d)
    cited = p.select(F.col("document_no").alias("query_id"), "provision_id", "version", F.expr("date_add(effective_from, version * 30)").alias("query_date"))
    return ev.temporal_scores(cited, p)


@query(
    """WITH c AS (SELECT o_custkey AS q, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 7 END AS a FROM orders), e AS (SELECT DISTINCT o_custkey AS q, o_orderkey % 7 AS a FROM orders WHERE o_orderkey % 3 = 0), m AS (SELECT c.a, e.a AS found FROM c LEFT JOIN e ON c.q = e.q AND c.a = e.a)
    SELECT round(count(found) / count(a), 6) AS numeric_accuracy, round(avg(CASE WHEN found IS NULL THEN 1.0 ELSE 0.0 END), 6) AS unsupported_rate FROM m"""
)
def grounding(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    claims = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 7).alias("amount"))
    return ev.grounding(claims, o.filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 7).alias("amount")))


@query("SELECT count(*) FILTER (doc_id % 5 != 0) AS hits, count(*) AS total, round(count(*) FILTER (doc_id % 5 != 0) / count(*), 6) AS recall FROM documents WHERE n_chars < 1000")
def short_point_recall(s: SparkSession, d: str) -> DataFrame:
    docs = v.documents(s, d)
    return ev.recall_of(docs, docs.filter("doc_id % 5 != 0"), "doc_id", F.col("n_chars") < 1000)


@query(
    """WITH p AS (SELECT doc_id % 31 AS document_id, CASE WHEN doc_id % 2 = 0 THEN 300 ELSE 600 END AS dpi, (n_chars % 17) + CASE WHEN doc_id % 2 = 0 THEN 5.0 ELSE 12.0 END AS s, (n_chars % 11) / 10.0 AS f, (n_chars % 7) / 6.0 AS b FROM documents),
    a AS (SELECT document_id, round(avg(s) FILTER (dpi = 300), 4) AS s3, round(avg(s) FILTER (dpi = 600), 4) AS s6, round(avg(f) FILTER (dpi = 300), 4) AS f3, round(avg(f) FILTER (dpi = 600), 4) AS f6, round(avg(b) FILTER (dpi = 300), 4) AS b3, round(avg(b) FILTER (dpi = 600), 4) AS b6 FROM p GROUP BY 1)
    SELECT document_id, CASE WHEN coalesce((f6 > f3 OR b6 > b3) AND s6 <= 2 * s3, false) THEN 600 ELSE 300 END AS dpi FROM a"""
)
def scan_resolution(s: SparkSession, d: str) -> DataFrame:
    i, n = F.col("doc_id"), F.col("n_chars")
    dpi = F.when(i % 2 == 0, 300).otherwise(600)
    pages = v.documents(s, d).select((i % 31).alias("document_id"), dpi.alias("dpi"), ((n % 17) + F.when(i % 2 == 0, 5.0).otherwise(12.0)).alias("seconds"), ((n % 11) / 10.0).alias("phrase_share"), ((n % 7) / 6.0).alias("box_share"))
    return ev.resolution_choice(pages).select("document_id", "dpi")
