"""Queries over document text: metadata, references, markup, provenance and the corpus report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.functions import text as tx
from stratalex.operators import corpus_qa as qa
from stratalex.operators import validation as va
from stratalex.session import table
from stratalex.sources import files as fi

from . import views as v
from .catalog import query

# Own sample text for the grammar, the same rows in both engines.
_HEADS = (
    (0, "CHÍNH PHỦ\nSố: 168/2024/NĐ-CP\nHà Nội, ngày 26 tháng 12 năm 2024\nNGHỊ ĐỊNH\nQuy định xử phạt", "168/2024/NĐ-CP", "DECREE", "2024-12-26"),
    (1, "BỘ CÔNG AN\nSố: 24/2023/TT-BCA\nHà Nội, ngày 1 tháng 7 năm 2023\nTHÔNG TƯ\nvề cấp biển số", "24/2023/TT-BCA", "CIRCULAR", "2023-07-01"),
    (2, "QUỐC HỘI\nLUẬT\nSố 36/2024/QH15", "36/2024/QH15", "LAW", None),
    (3, "Không có gì ở đây", None, None, None),
    (4, "QUYẾT ĐỊNH\nNGHỊ ĐỊNH\nngày 31 tháng 2 năm 2024", None, "DECISION", None),
)


def _values(rows: tuple) -> str:
    quote = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


_SAMPLES = f"heads AS (SELECT * FROM (VALUES {_values(_HEADS)}) t(head_id, head, number, type, issued))"


def _heads(s: SparkSession, d: str) -> DataFrame:
    """A head before the whole text of each document, chosen by its id."""
    samples = s.createDataFrame([(r[0], r[1]) for r in _HEADS], "head_id bigint, sample string")
    docs = v.documents(s, d).select("doc_id", "text", (F.col("doc_id") % len(_HEADS)).alias("head_id")).join(samples, "head_id")
    return docs.select("doc_id", F.concat("sample", F.lit("\n"), F.coalesce("text", F.lit(""))).alias("head"))


@query(f"WITH {_SAMPLES} SELECT doc_id, number, type, CAST(issued AS DATE) AS issued FROM documents JOIN heads ON doc_id % 5 = head_id")
def metadata_extract(s: SparkSession, d: str) -> DataFrame:
    issued = F.regexp_extract("head", r"(?iu)(ngày\s+\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4})", 1)
    return _heads(s, d).select("doc_id", tx.document_number(F.col("head")).alias("number"), tx.document_type(F.col("head")).alias("type"), tx.parsed_date(issued).alias("issued"))


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Chính phủ' WHEN 1 THEN 'Bộ Công an' WHEN 2 THEN NULL WHEN 3 THEN 'Văn phòng Quốc hội' WHEN 4 THEN 'Sở X' END AS issuer,
    CASE doc_id % 6 WHEN 0 THEN DATE '2024-01-15' WHEN 1 THEN DATE '2024-01-15' WHEN 2 THEN DATE '2024-02-05' WHEN 3 THEN DATE '2024-12-26' END AS day FROM documents"""
)
def metadata_normalize(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id") % 6
    name = F.when(i == 0, " CHÍNH  PHỦ ").when(i == 1, "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM Bộ Công An").when(i == 2, "Độc lập - Tự do - Hạnh phúc").when(i == 3, "văn phòng QUỐC HỘI").when(i == 4, "Sở  X")
    date = F.when(i == 0, "2024-01-15").when(i == 1, "2024-01-15T10:00:00").when(i == 2, "5/2/2024").when(i == 3, "ngày 26 tháng 12 năm 2024").when(i == 4, "31/2/2024").otherwise("mai")
    return v.documents(s, d).select("doc_id", tx.issuer(name).alias("issuer"), tx.parsed_date(date).alias("day"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE lang END AS term FROM documents")
def terminology_map(s: SparkSession, d: str) -> DataFrame:
    terms = s.createDataFrame([("en", "English"), ("fr", "French")], "term string, canonical string")
    docs = v.documents(s, d).select("doc_id", F.lower(tx.collapsed(F.col("lang"))).alias("key"), "lang")
    return docs.join(terms.withColumnRenamed("term", "key"), "key", "left").select("doc_id", F.coalesce("canonical", "lang").alias("term"))


@query(
    """WITH e AS (SELECT doc_id AS document_id, lang, source FROM documents), m AS (SELECT doc_id AS document_id, CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id % 9 = 0 THEN 'src-x' ELSE source END AS source FROM documents)
    SELECT document_id, 'lang' AS field, e.lang AS extracted, m.lang AS declared FROM e JOIN m USING (document_id) WHERE e.lang != m.lang UNION ALL SELECT document_id, 'source', e.source, m.source FROM e JOIN m USING (document_id) WHERE e.source != m.source"""
)
def manifest_conflicts(s: SparkSession, d: str) -> DataFrame:
    docs = v.documents(s, d).select(F.col("doc_id").alias("document_id"), "lang", "source")
    i = F.col("document_id")
    m = docs.select("document_id", F.when(i % 6 == 0, None).when(i % 5 == 0, "xx").otherwise(F.col("lang")).alias("lang"), F.when(i % 9 == 0, "src-x").otherwise(F.col("source")).alias("source"))
    return va.manifest_conflicts(docs, m, ("lang", "source"))


@query(
    """WITH m AS (SELECT doc_id AS document_id, CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE 'n' END AS document_number, CASE WHEN doc_id % 6 = 0 THEN 'OLD' ELSE 'EFFECTIVE' END AS status, doc_id % 10 = 0 AS bad FROM documents)
    SELECT document_id, error FROM (SELECT document_id, unnest([CASE WHEN trim(document_number) = '' THEN 'missing:document_number' END, CASE WHEN status = 'OLD' THEN 'enum:status' END, CASE WHEN bad THEN 'interval' END]) AS error FROM m) WHERE error IS NOT NULL"""
)
def manifest_validation(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    m = v.documents(s, d).select(
        i.alias("document_id"), F.when(i % 4 == 0, " ").otherwise("n").alias("document_number"), F.lit("LAW").alias("document_type"), F.when(i % 6 == 0, "OLD").otherwise("EFFECTIVE").alias("status"),
        F.lit("2024-01-01").alias("effective_from"), F.when(i % 10 == 0, "2023-01-01").otherwise("2025-01-01").alias("effective_to"),
    )
    return va.manifest_errors(m.withColumn("document_id", F.col("document_id").cast("string"))).withColumn("document_id", F.col("document_id").cast("long"))


@query("SELECT doc_id, CAST([1, 4, 9, 14, 40, 90, 400, 1994, NULL][doc_id % 9 + 1] AS INTEGER) AS value FROM documents")
def roman_to_int(s: SparkSession, d: str) -> DataFrame:
    samples = ("I", "iv", "IX", "XIV", "Ⅹ" + "L", "XC", "CD", "MCMXCIV", "Z")
    word = F.element_at(F.array(*[F.lit(x) for x in samples]), (F.col("doc_id") % 9 + 1).cast("int"))
    return v.documents(s, d).select("doc_id", tx.roman_value(tx.roman_letters(word)).alias("value"))


_REF_ROWS = (
    (0, "theo quy định tại Khoản 4 Điều 6 của Nghị định 168/2024 thì phạt", "theo quy định tại Khoản 4 Điều 6 của Nghị định 168/2024", "6", "4", "nd"),
    (1, "xem Điểm a Khoản 2 Điều 9", "Điểm a Khoản 2 Điều 9", "9", "2", None),
    (2, "Điều 5. Phạm vi", None, None, None, None),
    (3, "thực hiện theo  Điều 12 và bãi bỏ", "theo Điều 12", "12", None, None),
)


@query(f"WITH r AS (SELECT * FROM (VALUES {_values(_REF_ROWS)}) t(k, body, citation, article, clause, doc_kind)) SELECT doc_id, citation, article, clause, doc_kind FROM documents JOIN r ON doc_id % 4 = k WHERE citation IS NOT NULL")
def cross_references(s: SparkSession, d: str) -> DataFrame:
    rows = s.createDataFrame([(r[0], r[1]) for r in _REF_ROWS], "k bigint, body string")
    docs = v.documents(s, d).select("doc_id", (F.col("doc_id") % 4).alias("k"), F.coalesce("text", F.lit("")).alias("whole")).join(rows, "k").withColumn("body", F.concat("body", F.lit("\n"), "whole"))
    return qa.references(docs, "doc_id", "body").select("doc_id", "citation", "article", "clause", "doc_kind")


@query(f"WITH r AS (SELECT * FROM (VALUES {_values(_REF_ROWS)}) t(k, body, citation, article, clause, doc_kind)) SELECT doc_id, citation, CASE WHEN k = 1 THEN 'own__dieu-9__khoan-2__diem-a' WHEN k = 0 THEN 'nd-168-2024__dieu-6__khoan-4' END AS target_id FROM documents JOIN r ON doc_id % 4 = k WHERE citation IS NOT NULL")
def cross_ref_resolve(s: SparkSession, d: str) -> DataFrame:
    rows = s.createDataFrame([(r[0], r[1]) for r in _REF_ROWS], "k bigint, body string")
    docs = v.documents(s, d).select("doc_id", (F.col("doc_id") % 4).alias("k"), F.coalesce("text", F.lit("")).alias("whole")).join(rows, "k").withColumn("body", F.concat("body", F.lit("\n"), "whole"))
    ids = s.createDataFrame([("nd-168-2024__dieu-6__khoan-4",), ("own__dieu-9__khoan-2__diem-a",), ("own__dieu-1",)], "provision_id string")
    return qa.resolved(qa.references(docs, "doc_id", "body"), ids, F.lit("own")).select("doc_id", "citation", "target_id")


@query(
    r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)) AS text, 'heading' AS kind FROM pages UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '<title>([^<]*)</title>', 1)), 'title' FROM pages UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)"', 1)), 'link' FROM pages)
    SELECT page_id, kind, count(*) AS n, min(text) AS first_text FROM h GROUP BY ALL"""
)
def html_elements(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "pages")
    kinds = (("heading", r"<h1>([^<]*)</h1>"), ("title", r"<title>([^<]*)</title>"), ("link", r'<li><a href="([^"]*)"'))

    def of(kind: str, pattern: str):
        return F.transform(F.regexp_extract_all(F.col("html"), F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text")))

    found = F.flatten(F.array(*[of(k, e) for k, e in kinds]))
    return p.select("page_id", F.explode(found).alias("e")).groupBy("page_id", "e.kind").agg(F.count("*").alias("n"), F.min("e.text").alias("first_text"))


@query(f"WITH {v.ELEMENTS} SELECT doc_id, page_number, count(*) AS sources, CAST(min(reading_order) AS INTEGER) AS first_source FROM elements GROUP BY ALL")
def provenance_explode(s: SparkSession, d: str) -> DataFrame:
    merged = v.elements(s, d).groupBy("doc_id", "page_number").agg(F.collect_list("reading_order").alias("source_ids"))
    return merged.select("doc_id", "page_number", F.explode("source_ids").alias("source")).groupBy("doc_id", "page_number").agg(F.count("*").alias("sources"), F.min("source").alias("first_source"))


@query(
    f"""WITH {v.ELEMENTS}, claimed AS (SELECT doc_id, page_number, reading_order FROM elements WHERE reading_order % 31 != 7), a AS (SELECT doc_id, page_number, list_sort(list(reading_order)) AS x FROM elements GROUP BY ALL), b AS (SELECT doc_id, page_number, list_sort(list(reading_order)) AS x FROM claimed GROUP BY ALL)
    SELECT a.doc_id, a.page_number, coalesce(a.x = b.x, false) AS exact FROM a LEFT JOIN b USING (doc_id, page_number)"""
)
def provenance_multi(s: SparkSession, d: str) -> DataFrame:
    """Pages whose claimed sources equal their true ones as multisets."""
    e = v.elements(s, d)
    sides = lambda df, name: df.groupBy("doc_id", "page_number").agg(F.sort_array(F.collect_list("reading_order")).alias(name))
    joined = sides(e, "a").join(sides(e.filter("reading_order % 31 != 7"), "b"), ["doc_id", "page_number"], "left")
    return joined.select("doc_id", "page_number", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("exact"))


@query("SELECT doc_id, 'lang=' || lang || '/' || source || '/' || sha256(text) AS object_key FROM documents")
def object_keys(s: SparkSession, d: str) -> DataFrame:
    return v.documents(s, d).select("doc_id", fi.object_key(F.concat(F.lit("lang="), "lang"), F.col("source"), F.sha2("text", 256)).alias("object_key"))


@query(
    """WITH u AS (SELECT doc_id, CASE WHEN doc_id % 17 != 4 THEN sha256(text) END AS h FROM documents WHERE doc_id % 3 != 0 AND doc_id % 7 != 5 AND doc_id % 11 != 6), k AS (SELECT sha256(text) AS h FROM documents WHERE doc_id % 50 = 0)
    SELECT min(doc_id) AS upload_id, h AS file_hash FROM u WHERE h IS NOT NULL AND h NOT IN (SELECT h FROM k) GROUP BY h UNION ALL SELECT doc_id, NULL FROM u WHERE h IS NULL"""
)
def upload_dedupe(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    docs = v.documents(s, d)
    name = F.concat(F.lit("v1.2/file "), "doc_id", F.when(i % 7 == 5, ".pdf.exe").when(i % 11 == 6, "").when(i % 2 == 0, ".PDF").otherwise(".pdf"))
    uploads = docs.select(i.alias("upload_id"), F.when(i % 17 != 4, F.sha2("text", 256)).alias("file_hash"), name.alias("file_name"), F.when(i % 3 == 0, "image/png").when(i % 3 == 1, "text/plain").alias("mime"), F.length("text").alias("bytes"))
    known = docs.filter("doc_id % 50 = 0").select(F.sha2("text", 256).alias("file_hash")).distinct()
    return fi.accepted_uploads(uploads, known).select("upload_id", "file_hash")


@query(
    r"""SELECT doc_id, lower(trim(regexp_replace(regexp_replace(text, '[.,;:!?()\[\]{}"''«»“”‘’…•]+', '', 'g'), '\s+', ' ', 'g'))) AS ref_text FROM documents"""
)
def reference_text(s: SparkSession, d: str) -> DataFrame:
    return v.documents(s, d).select("doc_id", tx.reference_text(F.col("text")).alias("ref_text"))


@query(
    f"""WITH {v.EDGES}, u AS (SELECT source_row, relation_type || CASE WHEN l_linenumber % 2 = 0 THEN ' !' ELSE '' END AS source_text FROM edges WHERE resolution_status = 'UNRESOLVED')
    SELECT source_row, ref_key, count(*) AS n FROM (SELECT source_row, md5(trim(lower(replace(source_text, '!', '')))) AS ref_key FROM u) GROUP BY ALL HAVING count(*) > 1"""
)
def unresolved_ref_unique(s: SparkSession, d: str) -> DataFrame:
    """Unresolved references of one source that differ in punctuation only."""
    u = v.edges(s, d).filter("resolution_status = 'UNRESOLVED'").withColumn("source_text", F.concat("relation_type", F.when(F.col("l_linenumber") % 2 == 0, " !").otherwise("")))
    return va.repeated(u.withColumn("ref_key", F.md5(tx.reference_text(F.col("source_text")))), "source_row", "ref_key")


_QA_ROWS = """p AS (SELECT doc_id, 'd' || (doc_id % 20) AS document_id, 'd' || (doc_id % 20) || '__dieu-' || (doc_id // 60 * 3 + CASE WHEN doc_id % 97 = 0 THEN 0 ELSE doc_id % 3 END) || '-' || (doc_id % 3) AS provision_id, ['ARTICLE', 'CLAUSE', 'POINT'][doc_id % 3 + 1] AS node_kind,
    doc_id % 4 = 0 AS short_point, CASE WHEN doc_id % 5 = 0 THEN 'REJECTED' ELSE 'ACCEPTED' END AS review_status, CASE WHEN doc_id % 7 = 0 THEN 'd)' ELSE 'a)' END AS label, doc_id % 2 = 0 AS label_good, CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'x' END AS parent_context, doc_id % 8 AS n_sources,
    CASE WHEN doc_id % 9 > 0 THEN DATE '2024-01-01' END AS effective_from, CASE WHEN doc_id % 10 = 0 THEN DATE '2023-01-01' END AS effective_to FROM documents)"""


@query(
    f"""WITH {_QA_ROWS} SELECT count(DISTINCT document_id) AS document_count, count(*) FILTER (node_kind = 'ARTICLE') AS article_count, count(*) FILTER (node_kind = 'CLAUSE') AS clause_count, count(*) FILTER (node_kind = 'POINT') AS point_count, round(count(*) FILTER (node_kind = 'POINT') / 1000, 6) AS point_coverage,
    round(count(*) FILTER (short_point AND review_status = 'ACCEPTED') / count(*) FILTER (short_point), 6) AS short_point_retention, round(count(*) FILTER (label = 'd)' AND label_good) / count(*) FILTER (label = 'd)'), 6) AS d_point_detection_rate, round(count(*) FILTER (parent_context != '') / count(*), 6) AS parent_context_coverage,
    round(count(*) FILTER (n_sources > 0) / count(*), 6) AS provenance_coverage, 0.0 AS table_coverage, count(*) FILTER (effective_from IS NULL) AS unknown_effective_date_count, count(*) FILTER (effective_to < effective_from) AS temporal_conflict_count,
    (SELECT count(*) FROM (SELECT provision_id FROM p GROUP BY 1 HAVING count(*) > 1)) AS duplicate_provision_count, count(*) FILTER (node_kind = 'POINT' AND doc_id % 11 = 0) AS orphan_point_count, count(*) FILTER (node_kind = 'CLAUSE' AND doc_id % 11 = 0) AS orphan_clause_count, CAST(0 AS BIGINT) AS unresolved_cross_reference_count FROM p"""
)
def corpus_qa_16(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    doc = F.concat(F.lit("d"), (i % 20).cast("string"))
    pid = F.concat(doc, F.lit("__dieu-"), (F.expr("doc_id div 60 * 3") + F.when(i % 97 == 0, 0).otherwise(i % 3)).cast("string"), F.lit("-"), (i % 3).cast("string"))
    p = v.documents(s, d).select(
        doc.alias("document_id"), pid.alias("provision_id"), F.element_at(F.array(F.lit("ARTICLE"), F.lit("CLAUSE"), F.lit("POINT")), (i % 3 + 1).cast("int")).alias("node_kind"), (i % 4 == 0).alias("short_point"),
        F.when(i % 5 == 0, "REJECTED").otherwise("ACCEPTED").alias("review_status"), F.when(i % 7 == 0, "d)").otherwise("a)").alias("label"), (i % 2 == 0).alias("label_good"), F.when(i % 6 == 0, "").otherwise("x").alias("parent_context"),
        F.slice(F.array(*[F.lit(1)] * 7), F.lit(1), (i % 8).cast("int")).alias("source_ids"), F.when(i % 9 > 0, F.to_date(F.lit("2024-01-01"))).alias("effective_from"), F.when(i % 10 == 0, F.to_date(F.lit("2023-01-01"))).alias("effective_to"),
        F.when(i % 11 == 0, "none").otherwise("d0__dieu-0-0").alias("parent_id"),
    )
    return qa.report(p, expected_points=1000)


@query(
    r"""WITH b AS (SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'phạt 1.200.000 đồng ' WHEN n_chars % 3 = 1 THEN '800 nghìn ' ELSE '' END || coalesce(text, '') AS body FROM documents),
    m AS (SELECT doc_id, regexp_extract(body, '(?i)(\d{1,3}(?:\.\d{3})+|\d+)(?:,(\d{1,3}))?\s*(nghìn|ngàn|triệu|tỷ|tỉ)?', ['whole', 'part', 'unit']) AS m FROM b)
    SELECT doc_id, CASE WHEN m.whole != '' THEN TRY_CAST(TRY_CAST(replace(m.whole, '.', '') || '.' || rpad(m.part, 3, '0') AS DECIMAL(18,3)) * CASE lower(m.unit) WHEN 'nghìn' THEN 1000 WHEN 'ngàn' THEN 1000 WHEN 'triệu' THEN 1000000 WHEN 'tỷ' THEN 1000000000 WHEN 'tỉ' THEN 1000000000 ELSE 1 END AS BIGINT) END AS amount FROM m"""
)
def money_amounts(s: SparkSession, d: str) -> DataFrame:
    """The first amount of each whole text, behind a sample for two thirds of them."""
    head = F.when(F.col("n_chars") % 3 == 0, "phạt 1.200.000 đồng ").when(F.col("n_chars") % 3 == 1, "800 nghìn ").otherwise("")
    return v.documents(s, d).select("doc_id", tx.amount(F.concat(head, F.coalesce("text", F.lit("")))).cast("bigint").alias("amount"))
