"""Deterministic stand-ins for legal input, derived from the supplied tables; the same derivations as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalex.operators import elements as el
from stratalex.session import table

DAY = "1998-06-01"
RELATIONS = ("AMENDS", "REFERS_TO", "GUIDES", "REPLACES")


def documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def elements(s: SparkSession, d: str) -> DataFrame:
    return el.from_lines(documents(s, d))


def marked(s: SparkSession, d: str) -> DataFrame:
    """Elements whose lines carry marks of a hierarchy by their place: an article, a clause, then points."""
    ro = F.col("reading_order")
    turn, group = ro % 8, F.expr("reading_order div 8 + 1").cast("string")
    mark = (
        F.when(ro == 0, "Chương I. ").when(turn == 0, F.concat(F.lit("Điều "), group, F.lit(". "))).when(turn == 1, "1. ").when(turn == 2, "a) ")
        .when(turn == 3, "d) ").when(turn == 4, "d) ").when(turn == 5, "").when(turn == 6, "2. ").otherwise("b) ")
    )
    kind = F.when(turn == 5, "list_item").otherwise("paragraph")
    return elements(s, d).withColumn("text", F.concat(mark, "text")).withColumn("element_type", kind).withColumn("doc_id", F.concat(F.lit("nd-"), "doc_id"))


def provisions(s: SparkSession, d: str) -> DataFrame:
    """Versions of one provision for each customer, an order each; a version ends where the next begins."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(s, d, "orders").select(
        F.concat(F.lit("nd-"), (F.col("o_custkey") % 100).cast("string"), F.lit("-2024__dieu-"), F.col("o_custkey").cast("string")).alias("provision_id"), F.col("o_orderkey").alias("row_id"),
        F.row_number().over(w).alias("version"), F.to_date("o_orderdate").alias("effective_from"), F.to_date(F.lead("o_orderdate").over(w)).alias("effective_to"),
        F.when(F.col("o_orderstatus") == "F", "ACCEPTED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("DROPPED").alias("review_status"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("content_hash"), (F.col("o_custkey") % 100).alias("document_no"), F.col("o_orderpriority").alias("priority"),
    )


def edges(s: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in RELATIONS]), F.col("l_linenumber") % 4 + 1)
    return table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("source_row"), F.col("l_partkey").alias("target_row"), kind.alias("relation_type"),
        F.when(F.col("l_returnflag") == "N", "ACCEPTED").when(F.col("l_returnflag") == "A", "PENDING").otherwise("REJECTED").alias("review_status"),
        F.when(F.col("l_linestatus") == "F", "RESOLVED").otherwise("UNRESOLVED").alias("resolution_status"), "l_linenumber",
    )


def messages(s: SparkSession, d: str) -> DataFrame:
    """A job for each user; the event type gives the stage."""
    kind = F.col("event_type")
    stage = F.when(kind == "signup", "RECEIVED").when(kind == "view", "PARSED").when(kind == "click", "NORMALIZED").when(kind == "purchase", "EXTRACTED").otherwise("STAGED")
    return table(s, d, "events").select("event_id", "ts", F.col("user_id").alias("job_id"), stage.alias("stage"), "value", "event_type", "user_id")


def index_snapshot(s: SparkSession, d: str) -> DataFrame:
    """The index as it fell behind its documents: some missing, some stale, some without a hash, some extra."""
    docs = documents(s, d).select("doc_id", F.sha2("text", 256).alias("h"))
    old = docs.filter("doc_id % 10 != 0").select(F.col("doc_id").alias("point_id"), F.when(F.col("doc_id") % 7 == 0, F.sha2("h", 256)).when(F.col("doc_id") % 11 == 0, None).otherwise(F.col("h")).alias("content_hash"))
    extra = docs.filter("doc_id % 25 = 0").select((F.col("doc_id") + 1_000_000_000).alias("point_id"), F.col("h").alias("content_hash"))
    return old.unionByName(extra)


def authority(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).select(F.col("doc_id").alias("point_id"), F.sha2("text", 256).alias("content_hash"))


ELEMENTS = """elements AS (SELECT doc_id, CAST(ro AS INTEGER) AS reading_order, line AS text, CAST(ro // 4 + 1 AS INTEGER) AS page_number, (ro % 4) / 4.0 AS top, (ro % 4) / 4.0 + 0.25 AS bottom,
  CASE ro % 5 WHEN 0 THEN 'paragraph' WHEN 1 THEN 'list_item' WHEN 2 THEN 'heading' WHEN 3 THEN 'table' ELSE 'page_header' END AS element_type
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ro FROM documents))"""
MARKED = (
    ELEMENTS
    + """, marked AS (SELECT 'nd-' || doc_id AS doc_id, reading_order, page_number, top, bottom, CASE WHEN reading_order % 8 = 5 THEN 'list_item' ELSE 'paragraph' END AS element_type,
  CASE WHEN reading_order = 0 THEN 'Chương I. ' WHEN reading_order % 8 = 0 THEN 'Điều ' || (reading_order // 8 + 1) || '. ' ELSE CASE reading_order % 8 WHEN 1 THEN '1. ' WHEN 2 THEN 'a) ' WHEN 3 THEN 'd) ' WHEN 4 THEN 'd) ' WHEN 5 THEN '' WHEN 6 THEN '2. ' ELSE 'b) ' END END || text AS text FROM elements)"""
)
PROVISIONS = """provisions AS (SELECT 'nd-' || (o_custkey % 100) || '-2024__dieu-' || o_custkey AS provision_id, o_orderkey AS row_id, CAST(row_number() OVER w AS INTEGER) AS version,
  CAST(o_orderdate AS DATE) AS effective_from, CAST(lead(o_orderdate) OVER w AS DATE) AS effective_to,
  CASE o_orderstatus WHEN 'F' THEN 'ACCEPTED' WHEN 'O' THEN 'PENDING' ELSE 'DROPPED' END AS review_status, sha256(CAST(o_orderkey AS VARCHAR)) AS content_hash, o_custkey % 100 AS document_no, o_orderpriority AS priority
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""
EDGES = """edges AS (SELECT l_orderkey AS source_row, l_partkey AS target_row, CASE l_linenumber % 4 WHEN 0 THEN 'AMENDS' WHEN 1 THEN 'REFERS_TO' WHEN 2 THEN 'GUIDES' ELSE 'REPLACES' END AS relation_type,
  CASE l_returnflag WHEN 'N' THEN 'ACCEPTED' WHEN 'A' THEN 'PENDING' ELSE 'REJECTED' END AS review_status, CASE l_linestatus WHEN 'F' THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS resolution_status, l_linenumber FROM lineitem)"""
MESSAGES = """messages AS (SELECT event_id, ts, user_id AS job_id, CASE event_type WHEN 'signup' THEN 'RECEIVED' WHEN 'view' THEN 'PARSED' WHEN 'click' THEN 'NORMALIZED' WHEN 'purchase' THEN 'EXTRACTED' ELSE 'STAGED' END AS stage,
  CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS place, value FROM events)"""
INDEX = """docs_h AS (SELECT doc_id, sha256(text) AS h FROM documents), authority AS (SELECT doc_id AS point_id, h AS content_hash FROM docs_h),
  snapshot AS (SELECT doc_id AS point_id, CASE WHEN doc_id % 7 = 0 THEN sha256(h) WHEN doc_id % 11 = 0 THEN NULL ELSE h END AS content_hash FROM docs_h WHERE doc_id % 10 != 0
  UNION ALL SELECT doc_id + 1000000000, h FROM docs_h WHERE doc_id % 25 = 0)"""
TOKENS = r"""tokens AS (SELECT doc_id AS unit_id, unnest(regexp_extract_all(lower(nfc_normalize(text)), '([\p{L}\p{Nl}\p{No}]+)', 1)) AS token FROM documents),
  tf AS (SELECT unit_id, token, count(*) AS tf FROM tokens GROUP BY ALL), vocab AS (SELECT token, count(*) AS df, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY token)"""
QUERIES = r"""query AS (SELECT item_id AS query_id, token, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(nfc_normalize(text)), '([\p{L}\p{Nl}\p{No}]+)', 1)) AS token FROM benchmark) GROUP BY ALL)"""
