"""Document metadata from text, the manifest's word over it, and the reading of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalex.functions import text as tx

# Fixed value: both forms of the clause that says from when a text is in force.
EFFECTIVE = (
    r"(?iu)(?:có hiệu lực|kể từ)\s+(?:thi hành\s+)?(?:kể\s+)?từ\s+ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
    r"|(?:có hiệu lực|kể từ)\s+(?:thi hành\s+)?(?:kể\s+)?từ\s+ngày\s+(\d{1,2})/(\d{1,2})/(\d{4})"
)
# Issuers as the first page names them.
FIRST_PAGE_ISSUERS = (
    ("văn phòng quốc hội", "Văn phòng Quốc hội"), ("quốc hội", "Quốc hội"), ("bộ giao thông vận tải", "Bộ Giao thông vận tải"), ("bộ công an", "Bộ Công an"), ("chính phủ", "Chính phủ"),
)
# Keywords of vehicles, intents and evidence.
VEHICLES = ("xe máy", "ô tô", "xe đạp", "xe tải")
EVIDENCE = {
    "violation_definition": r"(?iu)bị phạt|bị xử lý", "monetary_penalty": r"(?iu)\d[\d.]*\s*(?:triệu\s+)?đồng", "license_points": r"(?iu)trừ\s.*điểm giấy phép lái xe",
    "license_suspension": r"(?iu)tước quyền sử dụng giấy phép lái xe", "exception": r"(?iu)không phạt|trường hợp không áp dụng", "procedure": r"(?iu)nộp phạt|trình tự|thủ tục", "legal_condition": r"(?iu)điều kiện|được phép",
}


def effective_from(text: Column) -> Column:
    """Date of the first clause that says from when a text is in force; null where it names no real day."""
    part = lambda i: F.regexp_extract(text, EFFECTIVE, i)
    day = F.when(part(1) != "", F.concat_ws("/", part(1), part(2), part(3))).otherwise(F.concat_ws("/", part(4), part(5), part(6)))
    return F.try_to_timestamp(F.nullif(day, F.lit("//")), F.lit("d/M/yyyy")).cast("date")


def first_page_issuer(text: Column) -> Column:
    low, out = F.lower(tx.collapsed(text)), None
    for key, name in FIRST_PAGE_ISSUERS:
        out = F.when(low.contains(key), name) if out is None else out.when(low.contains(key), name)
    return out


def titles(elements: DataFrame) -> DataFrame:
    """Title of each document: its first title element, else its first heading."""
    kind = F.lower("element_type")
    wanted = elements.filter(kind.isin("title", "heading") & (F.trim("text") != ""))
    place = F.struct(F.when(kind == "title", 0).otherwise(1).alias("k"), "page_number", "reading_order")
    return wanted.groupBy("doc_id").agg(F.min_by(F.trim("text"), place).alias("title"))


def extracted(docs: DataFrame, elements: DataFrame) -> DataFrame:
    """document metadata from whole texts and their elements: doc_id, document_number, document_type, issuer, issued_date,
    effective_from, document_title; null where the text does not say."""
    said = F.regexp_extract("text", r"(?iu)(ngày\s+\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4})", 1)
    read = docs.select(
        "doc_id", tx.document_number(F.col("text")).alias("document_number"), tx.document_type(F.col("text")).alias("document_type"), first_page_issuer(F.col("text")).alias("issuer"),
        tx.parsed_date(said).alias("issued_date"), effective_from(F.col("text")).alias("effective_from"),
    )
    return read.join(titles(elements).withColumnRenamed("title", "document_title"), "doc_id", "left")


def merged(extracted: DataFrame, manifests: DataFrame) -> DataFrame:
    """Extracted metadata under the manifest: its type always wins, its issuer if not blank; flags tell what is missing."""
    m = manifests.select("document_id", F.col("document_type").alias("_type"), F.nullif(F.trim("issuer"), F.lit("")).alias("_issuer"))
    joined = extracted.join(m, "document_id", "left")
    out = joined.withColumn("document_type", F.coalesce("_type", "document_type")).withColumn("issuer", tx.issuer(F.coalesce("_issuer", "issuer"))).drop("_type", "_issuer")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("document_type", "issuer", "issued_date")]))
    return out.withColumn("needs_review", missing)


def question(text: Column) -> Column:
    """Normalised question: compatibility form, lower case, collapsed."""
    return tx.collapsed(F.lower(tx.normalised(text, "NFKC")))


def parsed_questions(questions: DataFrame) -> DataFrame:
    """Add dates, year, number, article, clause, point, vehicle and intent of each question, from its words alone."""
    q = F.col("q")
    part = lambda p: F.nullif(F.regexp_extract(q, p, 1), F.lit(""))
    date = tx.parsed_date(F.coalesce(part(r"(\d{1,2}/\d{1,2}/\d{4})"), part(r"(ngày \d{1,2} tháng \d{1,2} năm \d{4})")))
    vehicle = None
    for name in VEHICLES:
        vehicle = F.when(q.contains(name), name) if vehicle is None else vehicle.when(q.contains(name), name)
    out = questions.withColumn("q", question(F.col("question"))).withColumn("query_date", date).withColumn("query_year", part(r"(?:^|\D)((?:19|20)\d{2})(?:\D|$)").cast("int"))
    out = out.withColumn("number", F.upper(part(r"(\d{1,4}/\d{4}/[a-zđ][a-zđ0-9-]*)"))).withColumn("article", part(r"điều (\d+)")).withColumn("clause", part(r"khoản (\d+)")).withColumn("point", part(r"điểm ([a-zđ])(?![\p{L}])")).withColumn("vehicle", vehicle)
    compared = q.contains("trước và sau") | q.contains("so sánh")
    located = F.col("number").isNotNull() | F.col("article").isNotNull() | F.col("clause").isNotNull()
    intent = F.when(compared, "COMPARISON").when(located, "SOURCE_SEARCH").when(F.col("query_date").isNotNull() | F.col("query_year").isNotNull(), "HISTORICAL").otherwise("CURRENT")
    return out.withColumn("intent", intent)


def dated_questions(parsed: DataFrame, asked_on: Column, changing_years: DataFrame) -> DataFrame:
    """Add applied_date and abstain: the day named, the request's day, or 1 July of a year without changes in force.

    A year in which validity changes (``changing_years``: query_year) does not fix a day: MISSING_QUERY_DATE.
    """
    joined = parsed.join(changing_years.select("query_year", F.lit(True).alias("_changes")), "query_year", "left")
    only_year = F.col("query_date").isNull() & F.col("query_year").isNotNull()
    applied = F.when(F.col("query_date").isNotNull(), F.col("query_date")).when(only_year & F.col("_changes").isNull(), F.make_date("query_year", F.lit(7), F.lit(1))).when(~only_year, asked_on)
    return joined.withColumn("applied_date", applied).withColumn("abstain", F.when(only_year & F.col("_changes").isNotNull(), "MISSING_QUERY_DATE")).drop("_changes")


def evidence_classes(text: Column) -> Column:
    """Names of the evidence classes that a text shows, in fixed order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in EVIDENCE.items()]))


def scan_text_counts(texts: DataFrame, phrases: tuple[str, ...]) -> DataFrame:
    """Add phrase_hits, marks and point labels of scanned text: d and đ apart."""
    low = F.lower("text")
    hits = sum((low.contains(p.lower()).cast("int") for p in phrases), F.lit(0))
    labels = F.transform(F.regexp_extract_all(low, F.lit(r"(?<![\p{L}])([a-zđ])\)"), F.lit(1)), lambda x: F.concat(x, F.lit(")")))
    out = texts.withColumn("phrase_hits", hits).withColumn("marks", F.regexp_count(tx.normalised(low, "NFD"), F.lit(r"[\p{Mn}đ]"))).withColumn("labels", labels)
    n = lambda x: F.size(F.filter("labels", lambda y: y == x))
    return out.withColumn("d_labels", n("d)")).withColumn("dd_labels", n("đ)"))
