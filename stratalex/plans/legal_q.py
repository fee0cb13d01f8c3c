"""Queries of amendment intervals, terminology, reference spans, nested parses and encoders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.functions import text as tx
from stratalex.operators import amendments as am
from stratalex.operators import corpus_qa as qa
from stratalex.operators import nested as ne
from stratalex.operators import terminology as te
from stratalex.session import table
from stratalex.sources.stored import shared_folder, stored_once

from . import views as v
from .catalog import query

_EVENTS = """ev AS (SELECT 'p-' || o_custkey AS p, o_orderkey AS id, CASE o_orderkey % 11 WHEN 0 THEN 'REPEALED' WHEN 1 THEN 'SUSPENDED' WHEN 2 THEN 'RESUMED' WHEN 3 THEN 'EXPIRED' WHEN 4 THEN 'CORRECTED' ELSE 'AMENDED' END AS kind,
  CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 11 = 4 THEN CAST(o_orderdate AS DATE) + 200 END AS until, CASE WHEN o_orderkey % 11 > 2 THEN CAST(o_orderkey % 5 AS INTEGER) END AS version, o_orderkey % 3 AS priority FROM orders WHERE o_orderkey % 13 != 5)"""


@query(
    f"""WITH {_EVENTS}, opens AS (SELECT * FROM ev WHERE kind IN ('AMENDED', 'CORRECTED')), ends AS (SELECT * FROM ev WHERE kind IN ('REPEALED', 'EXPIRED')), marks AS (SELECT p, day FROM ev UNION SELECT p, until FROM opens WHERE until IS NOT NULL),
    seg AS (SELECT p, day AS a, lead(day) OVER (PARTITION BY p ORDER BY day) AS b FROM marks),
    alive AS (SELECT seg.p, a, o.version, o.priority, o.id FROM seg JOIN opens o ON o.p = seg.p AND o.day <= a AND (o.until IS NULL OR o.until > a) LEFT JOIN ends c ON c.p = o.p AND c.day <= a AND c.day > o.day AND (c.version IS NULL OR c.version = o.version) GROUP BY ALL HAVING count(c.id) = 0),
    best AS (SELECT p, a, arg_max(version, (priority, version, id)) AS version FROM alive GROUP BY ALL), held AS (SELECT seg.p, a, arg_max(kind, (day, id)) = 'SUSPENDED' AS held FROM seg JOIN ev ON ev.p = seg.p AND day <= a AND kind IN ('SUSPENDED', 'RESUMED') GROUP BY ALL),
    won AS (SELECT seg.*, CASE WHEN NOT coalesce(held, false) THEN version END AS version FROM seg LEFT JOIN best USING (p, a) LEFT JOIN held USING (p, a)),
    islands AS (SELECT *, sum(new) OVER (PARTITION BY p ORDER BY a) AS island FROM (SELECT *, CASE WHEN version IS DISTINCT FROM lag(version) OVER (PARTITION BY p ORDER BY a) OR a = min(a) OVER (PARTITION BY p) THEN 1 ELSE 0 END AS new FROM won))
    SELECT p AS provision_id, version, min(a) AS effective_from, CASE WHEN NOT bool_or(b IS NULL) THEN max(b) END AS effective_to FROM islands WHERE version IS NOT NULL GROUP BY p, version, island"""
)
def amendment_intervals(s: SparkSession, d: str) -> DataFrame:
    """An event of legal effect for each order; which version of each customer's provision holds when."""
    i, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    kind = F.when(i % 11 == 0, "REPEALED").when(i % 11 == 1, "SUSPENDED").when(i % 11 == 2, "RESUMED").when(i % 11 == 3, "EXPIRED").when(i % 11 == 4, "CORRECTED").otherwise("AMENDED")
    events = table(s, d, "orders").select(
        F.concat(F.lit("p-"), "o_custkey").alias("provision_id"), i.alias("event_id"), kind.alias("event_type"), day.alias("effective_on"), F.when(i % 11 == 4, F.date_add(day, 200)).alias("until"),
        F.when(i % 11 > 2, (i % 5).cast("int")).alias("version"), (i % 3).cast("int").alias("priority"), F.when(i % 13 == 5, "PENDING").otherwise("ACCEPTED").alias("review_status"),
    )
    return am.effect_intervals(events)


_WORDS = r"words AS (SELECT doc_id, unnest(regexp_extract_all(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[\p{L}\p{N}_]+')) AS word FROM documents)"


@query(
    rf"""WITH {_WORDS}, known AS (SELECT word AS variant, word[1:4] AS canonical FROM words WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3), terms AS (SELECT * FROM known UNION SELECT canonical, canonical FROM known)
    SELECT d.doc_id, count(canonical) AS n_terms, count(DISTINCT canonical) AS n_canonical FROM documents d LEFT JOIN words w USING (doc_id) LEFT JOIN terms t ON t.variant = w.word GROUP BY d.doc_id"""
)
def terminology_texts(s: SparkSession, d: str) -> DataFrame:
    """Whole texts against a table of all words that come three times: thousands of variants, one pass."""
    docs = v.documents(s, d).select("doc_id", "text")
    words = docs.select(F.explode(F.regexp_extract_all(tx.folded(tx.normalised(F.col("text"))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))).alias("variant"))
    build = lambda: words.filter(F.length("variant") >= 5).groupBy("variant").agg(F.count("*").alias("n")).filter("n >= 3").select(F.lit("1.0.0").alias("version"), F.substring("variant", 1, 4).alias("canonical"), "variant")
    terms = stored_once(s, "terms", f"{d}/documents.parquet", build)
    found = te.with_terminology(docs, "doc_id", "text", terms, "1.0.0")
    return found.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.size(F.array_distinct(F.col("terms.canonical"))).cast("long").alias("n_canonical"))


@query(
    r"""WITH found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+([.,@-][0-9]+)?')) AS span, generate_subscripts(regexp_extract_all(text, '[0-9]+([.,@-][0-9]+)?'), 1) AS i FROM documents)
    SELECT doc_id, count(*) AS n, sha256(string_agg(span, '|' ORDER BY i)) AS spans_sha256 FROM found GROUP BY doc_id"""
)
def longest_spans(s: SparkSession, d: str) -> DataFrame:
    """Injected patterns, the shorter first: of one beginning the longest match is taken, over whole texts."""
    patterns = (r"[0-9]+", r"[0-9]+[.,@-][0-9]+")
    found = qa.spans(v.documents(s, d), "doc_id", "text", patterns).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "raw"))).alias("f"))
    return found.select("doc_id", F.size("f").cast("long").alias("n"), F.sha2(F.array_join("f.raw", "|"), 256).alias("spans_sha256"))


@query(
    f"""WITH {v.ELEMENTS}, newest AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS parse FROM documents), e AS (SELECT e.*, parse FROM elements e JOIN newest USING (doc_id) WHERE parse = 1 OR reading_order % 2 = 0)
    SELECT doc_id || '-' || parse AS parse_id, doc_id AS document_id, page_number, nullif(string_agg(text, chr(10) ORDER BY reading_order) FILTER (trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) != '') OVER (PARTITION BY doc_id, page_number), '') AS page_text, reading_order, element_type, text, top FROM e"""
)
def nested_parse(s: SparkSession, d: str) -> DataFrame:
    """Two parses of some documents: the newest, nested by page, and back to rows with the page's text."""
    lines = v.elements(s, d)
    number = F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1)
    parse = lambda n: F.concat(F.col("doc_id").cast("string"), F.lit("-"), n.cast("string"))
    docs = v.documents(s, d)
    parses = docs.withColumn("n", F.explode(F.sequence(F.lit(1), number))).select(parse(F.col("n")).alias("parse_id"), F.col("doc_id").alias("document_id"), F.timestamp_seconds(F.col("n") * 60).alias("completed_at"))
    rows = lines.withColumn("n", F.explode(F.sequence(F.lit(1), number))).filter("n = 1 or reading_order % 2 = 0")
    box = F.struct("left", "top", "right", "bottom")
    elements = rows.select(parse(F.col("n")).alias("parse_id"), "page_number", "reading_order", F.concat(F.lit("e"), "reading_order").alias("element_id"), "element_type", "text", box.alias("box"), F.lit(None).cast("string").alias("parent_element_id"), F.lit(None).cast("string").alias("table_html"))
    return ne.flattened(ne.rebuilt(parses, elements)).select("parse_id", "document_id", "page_number", "page_text", "reading_order", "element_type", "text", F.col("box.top").alias("top"))


@query(
    rf"""WITH {v.TOKENS}, numbered AS (SELECT token, idf, row_number() OVER (ORDER BY token) AS token_id FROM vocab), b AS (SELECT item_id, unnest(regexp_extract_all(lower(nfc_normalize(text)), '([\p{{L}}\p{{Nl}}\p{{No}}]+)', 1)) AS token FROM benchmark),
    w AS (SELECT item_id, token_id, count(*) * min(idf) AS weight FROM b JOIN numbered USING (token) GROUP BY ALL) SELECT i.item_id AS unit_id, coalesce(string_agg(CAST(token_id AS VARCHAR), ',' ORDER BY token_id), '') AS indices, round(coalesce(sum(weight), 0), 4) AS total FROM benchmark i LEFT JOIN w USING (item_id) GROUP BY i.item_id"""
)
def encoder_pipeline(s: SparkSession, d: str) -> DataFrame:
    """A pipeline fitted on all texts, saved, read again and applied to the benchmark."""
    from pyspark.ml import Pipeline, PipelineModel

    from stratalex.operators.encoder import SparseEncoder

    path = f"{shared_folder(s)}/encoder-{uuid.uuid4().hex}"
    fitted = Pipeline(stages=[SparseEncoder(keyCol="unit_id", inputCol="text", outputCol="weights")]).fit(v.documents(s, d).select(F.col("doc_id").alias("unit_id"), "text"))
    fitted.write().overwrite().save(path)
    coded = PipelineModel.load(path).transform(table(s, d, "benchmark").select(F.col("item_id").alias("unit_id"), "text"))
    total = F.aggregate("weights.values", F.lit(0.0), lambda a, x: a + x)
    return coded.select("unit_id", F.concat_ws(",", F.transform("weights.indices", lambda x: x.cast("string"))).alias("indices"), F.round(total, 4).alias("total"))
