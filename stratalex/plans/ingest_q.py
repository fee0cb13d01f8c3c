"""Queries of validation, gates, routing, projection, indexing and layout sources over composed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.functions import text as tx
from stratalex.operators import context as cx
from stratalex.operators import corpus_qa as qa
from stratalex.operators import elements as el
from stratalex.operators import evaluation as ev
from stratalex.operators import index as ix
from stratalex.operators import metadata as me
from stratalex.operators import quality as qu
from stratalex.operators import sparse as sp
from stratalex.operators import validation as va
from stratalex.session import table
from stratalex.sources.stored import stored

from . import views as v
from .catalog import query

_CHROME = "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM\nĐộc lập - Tự do - Hạnh phúc\n"
_REMARKS = (*qu.REMARK_REASONS, "something else")
_REASON_SQL = "CASE remark " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in qu.REMARK_REASONS.items()) + " ELSE 'NEEDS_REVIEW' END"
_REMARK_SQL = "[" + ", ".join(f"'{x}'" for x in _REMARKS) + "]"

# Six rows of a tree for each document, some missing: orphans, repeated ids, doubtful labels, remarks, documents without any.
_TREE = f"""tree AS (SELECT * FROM (SELECT doc_id, CAST(k AS INTEGER) AS k, CASE k WHEN 0 THEN 'ARTICLE' WHEN 1 THEN 'CLAUSE' ELSE 'POINT' END AS kind,
    'nd-' || doc_id || '-2024__dieu-1' || CASE k WHEN 0 THEN '' WHEN 1 THEN '__khoan-1' WHEN 2 THEN '__khoan-1__diem-a' WHEN 3 THEN '__khoan-1__diem-d' WHEN 4 THEN CASE WHEN doc_id % 4 = 1 THEN '__khoan-1__diem-d' ELSE '__khoan-1__diem-đ' END ELSE '__khoan-1__diem-g' END AS provision_id,
    CASE k WHEN 2 THEN 'a)' WHEN 3 THEN 'd)' WHEN 4 THEN 'd)' WHEN 5 THEN CASE doc_id % 5 WHEN 0 THEN 'g)' WHEN 1 THEN '?' ELSE 'đ)' END END AS label, CASE WHEN (doc_id + k) % 4 = 0 THEN {_REMARK_SQL}[CAST((doc_id + k) % {len(_REMARKS)} AS INTEGER) + 1] END AS remark,
    CASE WHEN doc_id % 23 = 0 THEN 'unknown' WHEN doc_id % 29 = 0 THEN NULL ELSE '2024-01-01' END AS effective_from, CASE WHEN doc_id % 9 = 0 THEN 'failed' ELSE 'passed' END AS gate FROM documents, (SELECT unnest(range(6)) AS k))
    WHERE NOT (k = 0 AND doc_id % 7 = 3) AND NOT (k = 1 AND doc_id % 5 = 2) AND doc_id % 11 != 5)"""
_HIERARCHY = f"""{_TREE}, seen AS (SELECT *, count(*) OVER (PARTITION BY doc_id, provision_id) AS times, row_number() OVER (PARTITION BY doc_id, provision_id ORDER BY k) AS place, sum(CASE WHEN label = 'd)' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS d_place FROM tree),
    h AS (SELECT doc_id, count(*) AS n, count(*) FILTER (kind = 'CLAUSE' AND doc_id % 7 = 3) AS orphan_clauses, count(*) FILTER (kind = 'POINT' AND doc_id % 5 = 2) AS orphan_points, count(*) FILTER (place = 2) AS duplicates,
    round(coalesce(CAST(count(*) FILTER (kind = 'POINT' AND (label IN ('a)', 'đ)') OR (label = 'd)' AND d_place <= 2))) AS DOUBLE) / nullif(count(*) FILTER (kind = 'POINT'), 0), 0.0), 6) AS point_label_detection FROM seen GROUP BY doc_id)"""
_GROUP_B = f"""{_HIERARCHY}, b AS (SELECT d.doc_id, coalesce(point_label_detection, 0.0) AS point_label_detection, round(coalesce(CAST(n - orphan_clauses - orphan_points - duplicates AS DOUBLE) / n, 0.0), 6) AS hierarchy_completeness FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id)"""
_ROUTED = f"""{_GROUP_B}, x AS (SELECT t.doc_id, t.provision_id, k, times > 1 AS twice, kind = 'POINT' AND label = '?' AS bad,
    concat_ws(',', CASE WHEN kind = 'POINT' AND label = 'd)' THEN 'D_D_AMBIGUITY' WHEN kind = 'POINT' AND label = 'g)' THEN 'POINT_LABEL_AMBIGUOUS' END, CASE WHEN remark IS NOT NULL THEN {_REASON_SQL} END, CASE WHEN t.doc_id % 12 = 0 THEN 'HEADER_FOOTER_LEAKAGE' END,
    CASE WHEN effective_from IS NULL OR effective_from = 'unknown' THEN 'UNKNOWN_EFFECTIVE_DATE' END, CASE WHEN gate = 'failed' THEN 'LOW_OCR_COVERAGE' END, CASE WHEN point_label_detection < 0.9 OR hierarchy_completeness < 0.9 THEN 'NEEDS_REVIEW' END) AS review FROM seen t JOIN b ON b.doc_id = t.doc_id),
    y AS (SELECT doc_id, provision_id, k, concat_ws(',', CASE WHEN twice THEN 'DUPLICATE_PROVISION' END, CASE WHEN bad THEN 'INVALID_POINT_LABEL' END) AS hard, list_filter(string_split(review, ','), lambda z: z != '') AS r FROM x),
    decided AS (SELECT doc_id, provision_id, k, CASE WHEN hard != '' THEN 'DROPPED' WHEN len(r) > 0 THEN 'NEEDS_REVIEW' ELSE 'ACCEPTED' END AS status, CASE WHEN hard != '' THEN hard ELSE array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: list_position(r, r[i]) = i), lambda i: r[i]), ',') END AS reasons FROM y)"""


def _tree(s: SparkSession, d: str) -> DataFrame:
    i, k = F.col("doc_id"), F.col("k")
    rows = v.documents(s, d).select("doc_id", F.concat(F.when(i % 12 == 0, _CHROME).otherwise(""), F.coalesce("text", F.lit(""))).alias("source_text"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    tail = (
        F.when(k == 0, "").when(k == 1, "__khoan-1").when(k == 2, "__khoan-1__diem-a").when(k == 3, "__khoan-1__diem-d")
        .when(k == 4, F.when(i % 4 == 1, "__khoan-1__diem-d").otherwise("__khoan-1__diem-đ")).otherwise("__khoan-1__diem-g")
    )
    remarks = F.array(*[F.lit(x) for x in _REMARKS])
    remark = F.when((i + k) % 4 == 0, F.get(remarks, ((i + k) % len(_REMARKS)).cast("int")))
    rows = rows.filter(~((k == 0) & (i % 7 == 3)) & ~((k == 1) & (i % 5 == 2)) & (i % 11 != 5))
    gate = F.when(i % 9 == 0, "failed").otherwise("passed")
    return rows.select(
        "doc_id", "k", "source_text", F.when(k == 0, "ARTICLE").when(k == 1, "CLAUSE").otherwise("POINT").alias("kind"), F.concat(F.lit("nd-"), i.cast("string"), F.lit("-2024__dieu-1"), tail).alias("provision_id"),
        F.when(k == 2, "a)").when(k.isin(3, 4), "d)").when(k == 5, F.when(i % 5 == 0, "g)").when(i % 5 == 1, "?").otherwise("đ)")).alias("label"), remark.alias("ambiguity"), remark.isNotNull().alias("needs_review"),
        F.when(i % 23 == 0, "unknown").when(i % 29 == 0, None).otherwise("2024-01-01").alias("effective_from"), gate.alias("extraction_gate"), F.lit("passed").alias("provenance_gate"), gate.alias("group_a"),
        F.lit(1).alias("page_number"), k.alias("reading_order"),
    )


@query(f"WITH {_HIERARCHY} SELECT * FROM h")
def hierarchy_metrics(s: SparkSession, d: str) -> DataFrame:
    return qu.hierarchy(_tree(s, d))


@query(f"WITH {_GROUP_B} SELECT doc_id, point_label_detection, hierarchy_completeness, concat_ws(',', CASE WHEN point_label_detection < 0.9 THEN 'point_label_detection' END, CASE WHEN hierarchy_completeness < 0.9 THEN 'hierarchy_completeness' END) AS failed_checks, point_label_detection >= 0.9 AND hierarchy_completeness >= 0.9 AS group_b FROM b")
def group_b_gates(s: SparkSession, d: str) -> DataFrame:
    return qu.group_b(qu.hierarchy(_tree(s, d)), v.documents(s, d)).withColumn("failed_checks", F.concat_ws(",", "failed_checks"))


def _routed(s: SparkSession, d: str) -> DataFrame:
    tree = _tree(s, d)
    return qu.routed(tree.join(qu.group_b(qu.hierarchy(tree), v.documents(s, d)).select("doc_id", "group_b"), "doc_id"))


@query(f"WITH {_ROUTED} SELECT doc_id, provision_id, status, reasons FROM decided")
def review_routing(s: SparkSession, d: str) -> DataFrame:
    return _routed(s, d).withColumn("reasons", F.concat_ws(",", "reasons"))


@query(f"WITH {_ROUTED} SELECT status, nullif(reason, '') AS reason, count(*) AS n FROM (SELECT status, unnest(string_split(reasons, ',')) AS reason FROM decided) GROUP BY ALL")
def routing_histogram(s: SparkSession, d: str) -> DataFrame:
    return qu.routing_histogram(_routed(s, d))


@query(
    f"""WITH {_ROUTED}, w AS (SELECT doc_id, max(CASE status WHEN 'NEEDS_REVIEW' THEN 2 WHEN 'DROPPED' THEN 1 ELSE 0 END) AS w, count(*) AS n FROM decided GROUP BY doc_id)
    SELECT d.doc_id, CASE coalesce(w, 2) WHEN 2 THEN 'NEEDS_REVIEW' WHEN 1 THEN 'DROPPED' ELSE 'ACCEPTED' END AS decision, coalesce(n, 0) AS n FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id"""
)
def document_decision(s: SparkSession, d: str) -> DataFrame:
    return qu.document_decision(_routed(s, d), v.documents(s, d))


_FILES = """f AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'text/html' ELSE 'application/pdf' END AS mime, doc_id % 3 != 0 AS has_text_layer, CASE WHEN doc_id % 2 = 0 THEN doc_id % 7 END AS layout_complexity FROM documents),
    r AS (SELECT *, CASE WHEN mime != 'application/pdf' THEN 'other_mime' WHEN layout_complexity >= 3 THEN 'compare_complex_tables' WHEN has_text_layer THEN 'text' ELSE 'ocr' END AS route FROM f),
    o AS (SELECT *, CASE WHEN doc_id % 4 = 3 THEN NULL WHEN doc_id % 9 = 0 THEN 'review' WHEN doc_id % 8 = 1 THEN 'accepted_alternate' ELSE 'accepted' END AS outcome, CASE WHEN doc_id % 9 = 0 THEN 'failed' ELSE 'passed' END AS gate FROM r)"""


@query(
    f"""WITH {_FILES}, q AS (SELECT doc_id, '{{"decision":{{"compare":' || (route = 'compare_complex_tables') || ',"has_fallback":' || (route != 'other_mime') || ',"ocr_required":' || (mime = 'application/pdf' AND NOT has_text_layer) || ',"route":"' || route || '"}},"document_id":"' || doc_id || '","executed":' || (outcome IS NOT NULL) || ',"gates":'
    || CASE WHEN outcome IS NULL THEN 'null' ELSE '{{"provenance_coverage_gate":"passed","text_extraction_rate_gate":"' || gate || '","group_a":"' || gate || '"}}' END || ',"inputs":{{"mime":"' || mime || '","has_text_layer":' || has_text_layer || ',"layout_complexity":' || coalesce(CAST(layout_complexity AS VARCHAR), 'null') || '}},"routed_to_review":'
    || CASE WHEN outcome IS NULL THEN 'null' ELSE CAST(outcome = 'review' AS VARCHAR) END || ',"source_parser":' || CASE WHEN outcome IS NULL THEN 'null' WHEN outcome = 'accepted_alternate' THEN '"alternate"' ELSE '"primary"' END || ',"terminal_outcome":' || coalesce('"' || outcome || '"', 'null') || '}}' AS record FROM o) SELECT doc_id, record FROM q"""
)
def routing_record(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    docs = v.documents(s, d)
    files = qu.parser_route(docs.select("doc_id", F.when(i % 5 == 0, "text/html").otherwise("application/pdf").alias("mime"), (i % 3 != 0).alias("has_text_layer"), F.when(i % 2 == 0, i % 7).alias("layout_complexity")))
    gate = F.when(i % 9 == 0, "failed").otherwise("passed")
    gates = docs.select("doc_id", F.lit("passed").alias("provenance_coverage_gate"), gate.alias("text_extraction_rate_gate"), gate.alias("group_a"))
    outcomes = docs.filter("doc_id % 4 != 3").select("doc_id", F.when(i % 9 == 0, "review").when(i % 8 == 1, "accepted_alternate").otherwise("accepted").alias("outcome"))
    return qu.routing_record(files, gates, outcomes)


_RULE_TESTS = {
    "id_empty": "i % 31 = 0", "id_grammar": "i % 31 != 0 AND i % 37 = 0", "source_text": "i % 19 = 0", "retrieval_text": "i % 41 = 0", "sources": "i % 43 = 0", "sources_unique": "i % 43 != 0 AND i % 47 = 0", "page": "i % 53 = 0", "version": "i % 13 = 0",
    "status": "i % 59 = 0", "review_status": "i % 61 = 0", "kind": "i % 67 = 0", "article": "i % 71 = 0", "interval": "i % 17 = 0", "accepted_undated": "i % 2 = 0 AND i % 61 != 0 AND i % 73 = 0 AND i % 17 != 0",
    "hash_form": "i % 23 = 0", "hash": "i % 23 != 0 AND i % 29 = 0", "bbox_keys": "i % 79 = 0", "bbox_missing": "i % 79 != 0 AND i % 83 = 0", "bbox_numeric": "i % 79 != 0 AND i % 83 != 0 AND i % 89 = 0",
}


@query("SELECT provision_id, CAST(version AS INTEGER) AS version, error FROM (SELECT CASE WHEN i % 31 = 0 THEN '' WHEN i % 37 = 0 THEN 'nd-' || i || '__dieu-1' ELSE 'nd-' || i || '-2024__dieu-1' END AS provision_id, CASE WHEN i % 13 = 0 THEN 0 ELSE 1 END AS version, unnest([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in _RULE_TESTS.items()) + "]) AS error FROM (SELECT doc_id AS i FROM documents)) WHERE error IS NOT NULL")
def provision_validation(s: SparkSession, d: str) -> DataFrame:
    """All rules over the whole texts of all documents, each broken by some."""
    i, t = F.col("doc_id"), F.col("text")
    bad = lambda n: i % n == 0
    text = F.when(bad(19), F.lit(" ")).otherwise(F.concat(F.lit("."), F.coalesce(t, F.lit(""))))
    plain = F.create_map(*[x for k in va.BOX for x in (F.lit(k), F.lit(0.5))])
    box = (
        F.when(bad(79), F.create_map(F.lit("depth"), F.lit(1.0))).when(bad(83), F.create_map(F.lit("left"), F.lit(0.5)))
        .when(bad(89), F.create_map(*[x for k in va.BOX for x in (F.lit(k), F.lit(None).cast("double") if k == "top" else F.lit(0.5))])).otherwise(plain)
    )
    dated = F.when(bad(73) & ~bad(17), None).otherwise(F.to_date(F.lit("2024-01-01")))
    given = v.documents(s, d).select(
        F.when(bad(31), "").when(bad(37), F.concat(F.lit("nd-"), i.cast("string"), F.lit("__dieu-1"))).otherwise(F.concat(F.lit("nd-"), i.cast("string"), F.lit("-2024__dieu-1"))).alias("provision_id"), F.when(bad(13), 0).otherwise(1).alias("version"),
        F.when(bad(67), "VERSE").when(bad(71), "CLAUSE").otherwise("APPENDIX").alias("node_kind"), F.when(bad(61), "MAYBE").when(i % 2 == 0, "ACCEPTED").otherwise("PENDING").alias("review_status"), F.when(bad(59), "LOST").otherwise("EFFECTIVE").alias("status"), text.alias("source_text"),
        F.when(bad(41), "").otherwise("x").alias("retrieval_text"), F.when(bad(43), F.array().cast("array<string>")).when(bad(47), F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"))).alias("source_ids"), F.when(bad(53), 0).otherwise(1).alias("page_number"),
        F.when(bad(67) & ~bad(71), "1").alias("article"), dated.alias("effective_from"), F.when(bad(17), F.to_date(F.lit("2024-01-01"))).alias("effective_to"), F.when(bad(23), "0").when(bad(29), F.sha2(F.lit("other"), 256)).otherwise(F.sha2(text, 256)).alias("content_hash"), box.alias("bbox"),
    )
    return va.provision_errors(given)


@query(
    """SELECT document_id, error FROM (SELECT 'nd-' || i || '-2024' AS document_id, unnest([CASE WHEN i % 7 = 0 THEN 'missing:file_hash' END, CASE WHEN i % 11 = 0 THEN 'enum:document_type' END, CASE WHEN i % 13 = 0 THEN 'enum:status' END, CASE WHEN i % 17 = 0 THEN 'interval' END,
    CASE WHEN i % 3 = 0 AND i % 19 = 0 AND i % 17 != 0 THEN 'accepted_undated' END, CASE WHEN i % 5 = 0 THEN 'conflict:document_number' END, CASE WHEN i % 11 = 0 THEN 'conflict:document_type' END]) AS error FROM (SELECT doc_id AS i FROM documents)) WHERE error IS NOT NULL"""
)
def document_guards(s: SparkSession, d: str) -> DataFrame:
    """Manifests against the heads of the texts: the number is read out of each whole text."""
    i = F.col("doc_id")
    key = F.concat(F.lit("nd-"), i.cast("string"), F.lit("-2024")).alias("document_id")
    number = F.concat((i % 1000).cast("string"), F.lit("/2024/NĐ-CP"))
    docs = v.documents(s, d)
    manifests = docs.select(
        key, F.when(i % 5 == 0, "9999/2024/NĐ-CP").otherwise(number).alias("document_number"), F.when(i % 11 == 0, "POEM").otherwise("DECREE").alias("document_type"), F.when(i % 7 != 0, "h").alias("file_hash"), F.when(i % 13 == 0, "LOST").otherwise("EFFECTIVE").alias("status"),
        F.when(i % 3 == 0, "ACCEPTED").otherwise("PENDING").alias("review_status"), F.when((i % 19 == 0) & (i % 17 != 0), None).otherwise("2024-01-01").alias("effective_from"), F.when(i % 17 == 0, "2023-01-01").alias("effective_to"),
    )
    whole = docs.select(key, F.concat(F.lit("Số: "), number, F.lit("\nNGHỊ ĐỊNH\n"), F.coalesce("text", F.lit(""))).alias("text"))
    return va.document_errors(manifests, whole.select("document_id", tx.document_number(F.col("text")).alias("document_number"), tx.document_type(F.col("text")).alias("document_type")))


@query(
    """WITH p AS (SELECT doc_id AS i, CASE WHEN doc_id % 10 = 0 THEN 'header' ELSE '' END || coalesce(text, '') AS t FROM documents)
    SELECT 'nd-' || i || '-2024__dieu-1' AS provision_id, CASE WHEN i % 4 != 0 THEN 'EFFECTIVE' ELSE 'UNKNOWN' END AS status, CASE WHEN i % 4 != 0 THEN DATE '2024-01-01' END AS effective_from, CASE WHEN i % 10 = 0 THEN 'PENDING' WHEN i % 4 != 0 AND i % 3 = 0 THEN 'ACCEPTED' ELSE 'REJECTED' END AS review_status,
    i % 10 = 0 AS leaked, i % 7 != 0 AS hash_matches FROM p"""
)
def provision_projection(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    docs, key = v.documents(s, d), F.concat(F.lit("nd-"), i.cast("string"), F.lit("-2024"))
    text = F.concat(F.when(i % 10 == 0, _CHROME).otherwise(""), F.coalesce("text", F.lit("")))
    rows = docs.select(
        key.alias("document_id"), F.concat(key, F.lit("__dieu-1")).alias("provision_id"), text.alias("source_text"), text.alias("retrieval_text"), F.when(i % 7 == 0, "x").otherwise(F.sha2(text, 256)).alias("content_hash"),
        F.lit("UNKNOWN").alias("status"), F.lit(None).cast("date").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), F.lit("REJECTED").alias("review_status"),
    )
    known = docs.filter("doc_id % 4 != 0").select(key.alias("document_id"), F.lit("EFFECTIVE").alias("status"), F.to_date(F.lit("2024-01-01")).alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), F.when(i % 3 == 0, "ACCEPTED").alias("review_status"))
    return ix.projected(rows, known).select("provision_id", "status", "effective_from", "review_status", "leaked", "hash_matches")


_INDEXED = """p AS (SELECT doc_id AS i, 'nd-' || doc_id || '-2024__dieu-1__v1' AS unit_id, doc_id % 3 != 0 AS accepted, doc_id % 5 != 0 AS dated, len(regexp_extract_all(lower(text), '([\\p{L}\\p{Nl}\\p{No}]+)', 1)) > 0 AS filled FROM documents)"""


def _indexed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    i = F.col("doc_id")
    docs, pid = v.documents(s, d), F.concat(F.lit("nd-"), i.cast("string"), F.lit("-2024__dieu-1"))
    rows = docs.select(pid.alias("provision_id"), F.lit(1).alias("version"), F.when(i % 3 != 0, "ACCEPTED").otherwise("PENDING").alias("review_status"), F.when(i % 5 != 0, F.to_date(F.lit("2024-01-01"))).alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), F.sha2("text", 256).alias("content_hash"))
    unit = F.concat(pid, F.lit("__v1"))
    counts = sp.text_counts(docs.select(unit.alias("u"), "text"), "u", "text")
    old = docs.filter("doc_id % 7 = 0").select(F.sha2(F.concat(F.lit("old-"), i.cast("string")), 256).alias("point_id"), F.lit("h").alias("content_hash"), F.when(i % 2 == 0, "v2").otherwise("v1").alias("sparse_encoder_version"), F.array().cast("array<bigint>").alias("indices"), F.array().cast("array<double>").alias("values"))
    return ix.index_accepted(rows, sp.wire(sp.unfitted(counts)), old, "v2")


@query(
    f"""WITH {_INDEXED}, {v.TOKENS}, u AS (SELECT 'nd-' || unit_id || '-2024__dieu-1__v1' AS unit_id, tf, row_number() OVER (PARTITION BY unit_id ORDER BY token) AS token_id FROM tf), w AS (SELECT unit_id, string_agg(token_id || ':' || tf, ',' ORDER BY token_id) AS weights FROM u GROUP BY unit_id)
    SELECT sha256(unit_id) AS point_id, 'v2' AS sparse_encoder_version, weights FROM p JOIN w USING (unit_id) WHERE accepted AND dated AND filled UNION ALL SELECT sha256('old-' || doc_id), 'v2', '' FROM documents WHERE doc_id % 14 = 0"""
)
def index_accepted(s: SparkSession, d: str) -> DataFrame:
    """Accepted, dated texts encoded and upserted; points of the older encoder go."""
    pairs = F.zip_with("indices", "values", lambda a, b: F.concat(a.cast("string"), F.lit(":"), b.cast("long").cast("string")))
    return _indexed(s, d)[0].select("point_id", "sparse_encoder_version", F.concat_ws(",", pairs).alias("weights"))


@query(f"WITH {_INDEXED} SELECT CAST(count(*) FILTER (accepted) AS BIGINT) AS accepted, CAST(count(*) FILTER (accepted AND NOT dated) AS BIGINT) AS skipped_no_effective_from, CAST(count(*) FILTER (accepted AND dated AND filled) AS BIGINT) AS upserted, CAST(count(*) FILTER (accepted AND dated AND NOT coalesce(filled, false)) AS BIGINT) AS skipped_empty FROM p")
def index_accepted_counts(s: SparkSession, d: str) -> DataFrame:
    return _indexed(s, d)[1]


@query(rf"WITH {v.TOKENS}, u AS (SELECT unit_id, tf, row_number() OVER (PARTITION BY unit_id ORDER BY token) AS token_id FROM tf) SELECT unit_id, string_agg(token_id || ':' || tf, ',' ORDER BY token_id) AS weights FROM u GROUP BY unit_id")
def unfitted_encoding(s: SparkSession, d: str) -> DataFrame:
    wire = sp.wire(sp.unfitted(sp.text_counts(v.documents(s, d), "doc_id", "text")))
    pairs = F.zip_with("indices", "values", lambda a, b: F.concat(a.cast("string"), F.lit(":"), b.cast("long").cast("string")))
    return wire.select("unit_id", F.concat_ws(",", pairs).alias("weights"))


@query("SELECT doc_id, CAST(n // 32 AS BIGINT) AS batch, CAST(n % 32 AS BIGINT) AS place FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents)")
def embedding_batches(s: SparkSession, d: str) -> DataFrame:
    return ix.batches(v.documents(s, d).select("doc_id"), 32, "doc_id").select("doc_id", "batch", "place")


@query("""SELECT doc_id, 'sha256:' || sha256('{"document_id":"nd-' || doc_id || '-2024","effective_to":null,"source":' || coalesce('"' || source || '"', 'null') || ',"version":1}') AS manifest_hash FROM documents""")
def manifest_hashes(s: SparkSession, d: str) -> DataFrame:
    record = F.struct(F.concat(F.lit("nd-"), F.col("doc_id").cast("string"), F.lit("-2024")).alias("document_id"), F.lit(None).cast("string").alias("effective_to"), "source", F.lit(1).alias("version"))
    return v.documents(s, d).select("doc_id", tx.manifest_hash(record).alias("manifest_hash"))


_CELL = "replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"SELECT doc_id, '<table>' || string_agg('<tr><td>' || i || '</td><td>' || {_CELL} || '</td></tr>', '' ORDER BY i) || '</table>' AS html FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) GROUP BY doc_id")
def html_tables(s: SparkSession, d: str) -> DataFrame:
    """Each text as a table of its lines with their numbers."""
    cells = F.transform(F.split("text", "\n"), lambda line, i: F.array((i + 1).cast("string"), line))
    return v.documents(s, d).filter("text is not null").select("doc_id", el.html_table(cells).alias("html"))


@query(
    """SELECT doc_id AS document_id, CAST(i AS INTEGER) AS reading_order, CASE i % 4 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'heading' ELSE 'paragraph' END WHEN 1 THEN 'table' WHEN 2 THEN 'page_header' ELSE 'figure' END AS element_type, line AS text, CAST(i // 3 + 1 AS INTEGER) AS page_number, 0.25 AS left_edge
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)"""
)
def content_list_elements(s: SparkSession, d: str) -> DataFrame:
    """Lines of the texts as the items of a parser's content list, and back to elements."""
    kinds = F.array(*[F.lit(x) for x in ("text", "table", "header", "image")])
    item = lambda line, i: F.struct(F.get(kinds, i % 4).alias("type"), line.alias("text"), F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("text_level"), F.expr("0").alias("_"), (F.floor(i / 3)).cast("int").alias("page_idx"), F.array(F.lit(250), F.lit(0), F.lit(750), F.lit(100)).alias("bbox"))
    raw = v.documents(s, d).select(F.col("doc_id").alias("document_id"), F.transform(F.split("text", "\n"), item).alias("items"), "doc_id").filter("items is not null")
    return el.content_list(raw).select("document_id", "reading_order", "element_type", "text", "page_number", F.col("bbox")[0].alias("left_edge"))


@query(
    """SELECT vec_id, round(greatest(0.0, least(1.0, CAST(embedding[1] AS DOUBLE))), 6) AS left_edge, round(greatest(0.0, least(1.0, (CAST(embedding[2] AS DOUBLE) * 842 + 100) / 842)), 6) AS top_edge, CASE label % 3 WHEN 0 THEN 'heading' WHEN 1 THEN 'list_item' ELSE 'unknown_label' END AS element_type FROM embeddings WHERE vec_id % 7 != 0
    UNION ALL SELECT vec_id, NULL, NULL, CASE label % 3 WHEN 0 THEN 'heading' WHEN 1 THEN 'list_item' ELSE 'unknown_label' END FROM embeddings WHERE vec_id % 7 = 0"""
)
def layout_boxes(s: SparkSession, d: str) -> DataFrame:
    """Boxes in page points to the unit square; none where the page has no size. Labels to element types."""
    e = table(s, d, "embeddings")
    x, y = F.col("embedding")[0].cast("double") * 595, F.col("embedding")[1].cast("double") * 842 + 100
    width = F.when(F.col("vec_id") % 7 != 0, F.lit(595.0))
    label = F.when(F.col("label") % 3 == 0, "section_header").when(F.col("label") % 3 == 1, "list_item").otherwise("unknown_label")
    box = el.unit_box(x, y, x + 10, y + 10, width, F.lit(842.0))
    return e.select("vec_id", box.alias("b"), el.mapped(label, el.LAYOUT_TYPES).alias("element_type")).select("vec_id", F.round("b.left", 6).alias("left_edge"), F.round("b.top", 6).alias("top_edge"), "element_type")


# An article, a clause and a point for each document; where a parent is missing the context text must do.
_CONTEXT = r"""src AS (SELECT doc_id AS i, 'nd-' || doc_id || '-2024__dieu-5' AS pid, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS body FROM documents),
  ctx AS (SELECT pid AS provision_id, 'ARTICLE' AS kind, NULL AS parent_context, 'Điều 5. ' || t AS line FROM src WHERE i % 3 != 0
  UNION ALL SELECT pid || '__khoan-4', 'CLAUSE', CASE WHEN i % 3 != 0 THEN regexp_replace('Điều 5. ' || body, '\s+$', '') ELSE 'Điều 5. Tiêu đề' END, '4. ' || t FROM src WHERE i % 5 != 0
  UNION ALL SELECT pid || '__khoan-4__diem-a', 'POINT', CASE WHEN i % 5 != 0 THEN 'Khoản 4.' || CASE WHEN body = '' THEN '' ELSE ' ' || body END WHEN i % 4 = 0 THEN 'Khoản 4. Phạt 14.000.000 đồng' WHEN i % 4 = 1 THEN 'Khoản 7. khác' END, 'a) ' || t FROM src)"""


def _context(s: SparkSession, d: str) -> DataFrame:
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    pid = F.concat(F.lit("nd-"), i.cast("string"), F.lit("-2024__dieu-5"))
    said = F.when(i % 4 == 0, "Chương I. Chung Điều 5. Tiêu đề 3. trước 4. Phạt 14.000.000 đồng").when(i % 4 == 1, "Điều 5. Tiêu đề 6. trước 7. khác").when(i % 4 == 3, "Mục 2. Điều 5. Tiêu đề")
    row = lambda kind, tail, mark, number, clause, context: F.struct(
        F.lit(kind).alias("kind"), F.concat(pid, F.lit(tail)).alias("provision_id"), F.concat(F.lit(mark), text).alias("line"), F.lit("5").alias("article"), F.lit(number).cast("string").alias("number"), F.lit(clause).cast("string").alias("clause"), context.cast("string").alias("context_text")
    )
    kinds = F.array(row("ARTICLE", "", "Điều 5. ", "5", None, F.lit(None)), row("CLAUSE", "__khoan-4", "4. ", "4", "4", F.lit("Chương II. Điều 5. Tiêu đề 4. cũ")), row("POINT", "__khoan-4__diem-a", "a) ", None, "4", said))
    rows = v.documents(s, d).select("doc_id", F.inline(kinds))
    return rows.filter("not (kind = 'ARTICLE' and doc_id % 3 = 0) and not (kind = 'CLAUSE' and doc_id % 5 = 0)")


@query(f"WITH {_CONTEXT} SELECT provision_id, kind, parent_context, CASE WHEN kind = 'ARTICLE' OR parent_context IS NULL THEN line ELSE parent_context || ' ' || line END AS retrieval_text FROM ctx")
def context_enrich(s: SparkSession, d: str) -> DataFrame:
    return cx.enriched(_context(s, d)).select("provision_id", "kind", "parent_context", "retrieval_text")


@query(f"WITH {_CONTEXT} SELECT round(avg(CASE WHEN parent_context IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS completeness, count(*) AS n FROM ctx WHERE kind != 'ARTICLE'")
def context_completeness(s: SparkSession, d: str) -> DataFrame:
    return cx.completeness(cx.enriched(_context(s, d)))


@query(f"WITH {_CONTEXT} SELECT provision_id, CAST(split_part(provision_id, '-', 2) AS BIGINT) % 7 != 0 AS matches FROM ctx WHERE kind = 'POINT'")
def context_gold_match(s: SparkSession, d: str) -> DataFrame:
    """Annotations of every point, blanks doubled; those of each seventh document expect another text."""
    found = cx.enriched(_context(s, d))
    expected = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("khác "), "retrieval_text")).otherwise(F.replace("retrieval_text", F.lit(" "), F.lit("  ")))
    # Both sides come from one pass, so that lines move once.
    found = stored(found.select("provision_id", "kind", cx.as_compared(F.col("retrieval_text")).alias("retrieval_digest"), F.when(F.col("kind") == "POINT", cx.as_compared(expected)).alias("expected_digest")), "gold_digests")
    return cx.gold_match(found, found.filter("kind = 'POINT'").select("provision_id", "expected_digest"))


@query(
    f"""WITH {_TREE}, o AS (SELECT doc_id, provision_id, min(k) AS k, regexp_replace(provision_id, '__(diem|khoan|dieu)-[^_]+$', '') AS parent_id FROM tree GROUP BY doc_id, provision_id),
    n AS (SELECT provision_id AS source_id, lead(provision_id) OVER (PARTITION BY doc_id, parent_id ORDER BY k, provision_id) AS target_id FROM o)
    SELECT o.parent_id AS source_id, 'PARENT_OF' AS relation, o.provision_id AS target_id FROM o JOIN o p ON p.doc_id = o.doc_id AND p.provision_id = o.parent_id UNION ALL SELECT source_id, 'SIBLING_OF', target_id FROM n WHERE target_id IS NOT NULL"""
)
def structure_relations(s: SparkSession, d: str) -> DataFrame:
    return qa.relations(_tree(s, d))


@query(f"WITH {_TREE} SELECT count(*) FILTER (doc_id % 12 = 0) AS leaked, count(*) AS n, round(count(*) FILTER (doc_id % 12 = 0) / count(*), 6) AS leakage_rate FROM tree")
def header_leakage_rate(s: SparkSession, d: str) -> DataFrame:
    leaked = tx.leaked_header(F.col("source_text"))
    return _tree(s, d).agg(F.sum(leaked.cast("long")).alias("leaked"), F.count("*").alias("n"), F.round(F.avg(leaked.cast("double")), 6).alias("leakage_rate"))


@query(
    """WITH g AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ['d', 'đ'] WHEN 1 THEN ['đ'] ELSE ['d'] END AS gold, CASE doc_id % 5 WHEN 0 THEN ['d', 'đ'] WHEN 1 THEN ['đ'] WHEN 2 THEN ['d'] ELSE [] END AS found FROM documents),
    c AS (SELECT count(*) FILTER (list_contains(gold, 'đ') AND list_contains(found, 'đ')) AS matched, count(*) FILTER (list_contains(gold, 'đ')) AS gold_dd, count(*) FILTER (list_contains(gold, 'đ') AND list_contains(found, 'd')) AS dd_as_d, count(*) FILTER (list_contains(gold, 'd') AND list_contains(found, 'đ')) AS d_as_dd FROM g)
    SELECT *, round(matched / gold_dd, 6) AS recall FROM c"""
)
def d_confusion(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    both, dd, plain = F.array(F.lit("d"), F.lit("đ")), F.array(F.lit("đ")), F.array(F.lit("d"))
    rows = lambda letters: v.documents(s, d).select("doc_id", F.lit("1").alias("article"), F.lit("1").alias("clause"), F.explode(letters).alias("letter"))
    return ev.d_confusion(rows(F.when(i % 3 == 0, both).when(i % 3 == 1, dd).otherwise(plain)), rows(F.when(i % 5 == 0, both).when(i % 5 == 1, dd).when(i % 5 == 2, plain)))


@query(
    f"""WITH {v.ELEMENTS}, h AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, reading_order) AS n, trim(text) AS document_title FROM elements WHERE element_type = 'heading' AND trim(text) != '')
    SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN (d.doc_id % 1000) || '/2024/NĐ-CP' END AS document_number, CASE WHEN d.doc_id % 2 = 0 THEN 'DECREE' END AS document_type, CASE WHEN d.doc_id % 2 = 0 THEN DATE '2024-12-26' END AS issued_date, CASE WHEN d.doc_id % 2 = 0 THEN DATE '2025-01-01' END AS effective_from, document_title FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id AND n = 1"""
)
def document_metadata(s: SparkSession, d: str) -> DataFrame:
    """All metadata of each whole text at once; every second text says its own."""
    head = F.concat(F.lit("Số: "), (F.col("doc_id") % 1000).cast("string"), F.lit("/2024/NĐ-CP\nHà Nội, ngày 26 tháng 12 năm 2024\nNGHỊ ĐỊNH\nNghị định này có hiệu lực thi hành từ ngày 01 tháng 01 năm 2025.\n"))
    docs = v.documents(s, d).select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, head).otherwise(""), F.coalesce("text", F.lit(""))).alias("text"))
    return me.extracted(docs, v.elements(s, d)).drop("issuer")


@query(
    f"""WITH {_TREE}, g AS (SELECT DISTINCT provision_id, kind, doc_id FROM tree WHERE kind != 'POINT'), e AS (SELECT provision_id, CASE WHEN doc_id % 6 = 1 THEN 'POINT' ELSE kind END AS kind FROM g WHERE doc_id % 8 != 3)
    SELECT g.provision_id, 'missing' AS field, g.provision_id AS expected, NULL AS actual FROM g ANTI JOIN e ON g.provision_id = e.provision_id UNION ALL SELECT g.provision_id, 'kind', g.kind, e.kind FROM g JOIN e ON g.provision_id = e.provision_id WHERE g.kind != e.kind"""
)
def gold_mismatches(s: SparkSession, d: str) -> DataFrame:
    gold = _tree(s, d).filter("kind != 'POINT'").select("provision_id", "kind", "doc_id").distinct()
    found = gold.filter("doc_id % 8 != 3").select("provision_id", F.when(F.col("doc_id") % 6 == 1, "POINT").otherwise(F.col("kind")).alias("kind"))
    return ev.mismatches(gold, found, "provision_id", ("kind",))
