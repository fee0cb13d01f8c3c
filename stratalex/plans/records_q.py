"""Queries of stored rows, provenance, constraints, evidence and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalex.operators import elements as el
from stratalex.operators import evaluation as ev
from stratalex.operators import index as ix
from stratalex.operators import nested as ne
from stratalex.operators import records as re
from stratalex.operators import search as se
from stratalex.operators import validation as va
from stratalex.operators import verification as vf
from stratalex.session import table

from . import views as v
from .catalog import query

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _rows(s: SparkSession, d: str) -> DataFrame:
    """Stored rows: the first line of each document is a point's text, its version that of the document's language."""
    i = F.col("doc_id")
    blank = F.lit(None).cast("string")
    day = F.date_add(F.to_date(F.lit("2020-01-01")), (i % 700).cast("int"))
    return v.documents(s, d).select(
        F.concat(F.lit("p-"), i % 500).alias("provision_id"), F.concat(F.lit("v-"), "lang").alias("document_version_id"), *[blank.alias(c) for c in ("chapter", "section", "article", "clause", "point", "heading", "parent_context")],
        F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("source_text"), F.col("text").alias("retrieval_text"), F.lit("UNKNOWN").alias("status"), F.when(i % 9 != 4, (i % 30).cast("int")).alias("page_number"),
        F.when(i % 7 != 3, F.transform(F.sequence(F.lit(0), (i % 4).cast("int")), lambda x: F.concat(F.lit("e"), x))).alias("source_element_ids"), F.sha2("text", 256).alias("content_hash"),
        (i % 5).cast("int").alias("version"), F.when(i % 3 == 0, "PENDING").otherwise("ACCEPTED").alias("review_status"), F.when(i % 2 == 0, "POINT").otherwise("CLAUSE").alias("node_kind"),
        F.when(i % 11 != 0, day).alias("effective_from"), F.when(i % 4 != 0, F.date_add(day, (i % 300 - 5).cast("int"))).alias("effective_to"), i.alias("row_id"), F.col("source").alias("owner"),
    )


_ROWS = """stored AS (SELECT doc_id AS row_id, 'p-' || (doc_id % 500) AS provision_id, 'v-' || lang AS document_version_id, split_part(coalesce(text, ''), chr(10), 1) AS source_text, CASE WHEN doc_id % 9 != 4 THEN doc_id % 30 END AS page_number,
  CASE WHEN doc_id % 7 != 3 THEN list_transform(range(doc_id % 4 + 1), lambda x: 'e' || x) END AS ids, CAST(doc_id % 5 AS INTEGER) AS version, CASE WHEN doc_id % 3 = 0 THEN 'PENDING' ELSE 'ACCEPTED' END AS review_status,
  CASE WHEN doc_id % 2 = 0 THEN 'POINT' ELSE 'CLAUSE' END AS node_kind, CASE WHEN doc_id % 11 != 0 THEN DATE '2020-01-01' + CAST(doc_id % 700 AS INTEGER) END AS effective_from,
  CASE WHEN doc_id % 4 != 0 THEN DATE '2020-01-01' + CAST(doc_id % 700 + doc_id % 300 - 5 AS INTEGER) END AS effective_to, source AS owner FROM documents)"""


@query(
    rf"""WITH {_ROWS} SELECT row_id, node_kind = 'POINT' AND len(regexp_extract_all(source_text, '[^\s\x0b]+')) <= 3 AS short_point, coalesce(len(ids), 0) AS sources, strftime(effective_from, '%Y-%m-%d') AS effective_from, strftime(effective_to, '%Y-%m-%d') AS effective_to FROM stored"""
)
def row_records(s: SparkSession, d: str) -> DataFrame:
    rows = _rows(s, d)
    out = re.records(rows.withColumn("heading", F.col("row_id").cast("string")))
    return out.select(F.col("heading").cast("long").alias("row_id"), "short_point", F.size("source_element_ids").cast("long").alias("sources"), "effective_from", "effective_to")


@query(f"WITH {_ROWS} SELECT row_id, 'd-' || substr(document_version_id, 3, 1) AS document_id FROM stored WHERE document_version_id IN ('v-en', 'v-fr')")
def provisions_of_versions(s: SparkSession, d: str) -> DataFrame:
    versions = s.createDataFrame([("v-en", "d-e", "1"), ("v-fr", "d-f", "2"), ("v-xx", "d-x", "1")], "document_version_id string, document_id string, version_label string")
    return re.document_provisions(_rows(s, d), versions).select("row_id", "document_id")


@query(
    f"""WITH {v.ELEMENTS}, src AS (SELECT doc_id, reading_order, CASE WHEN reading_order % 31 = 7 THEN reading_order + 1 ELSE reading_order END AS claimed FROM elements), p AS (SELECT doc_id, list_sort(list(CAST(reading_order AS VARCHAR))) AS x, list_sort(list(CAST(claimed AS VARCHAR))) AS y FROM src GROUP BY doc_id)
    SELECT doc_id, CASE WHEN x = y THEN len(x) ELSE 0 END AS records, x != y AS rejected FROM p"""
)
def provenance_records(s: SparkSession, d: str) -> DataFrame:
    """All lines of a document as a provision's elements; where one source is claimed for another, the provision is refused."""
    e = v.elements(s, d)
    ro = F.col("reading_order")
    provisions = e.groupBy(F.col("doc_id").alias("provision_id")).agg(F.collect_list(ro.cast("string")).alias("source_element_ids"))
    claimed = F.when(ro % 31 == 7, ro + 1).otherwise(ro)
    sources = e.select(F.col("doc_id").alias("provision_id"), F.when(ro % 3 == 0, "base").otherwise("amendment").alias("source_version_id"), F.when(ro % 3 == 0, "BASE_TEXT").otherwise("AMENDMENT_TEXT").alias("role"), claimed.cast("string").alias("element_id"), "page_number")
    records, refused = re.attributed(provisions, sources)
    per = records.groupBy("provision_id").agg(F.count("*").alias("records"))
    out = provisions.select("provision_id").join(per, "provision_id", "left").join(refused.select("provision_id", F.lit(True).alias("rejected")), "provision_id", "left")
    return out.select(F.col("provision_id").alias("doc_id"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("rejected", F.lit(False)).alias("rejected"))


@query(f"WITH {_ROWS} SELECT document_version_id, round(avg(CASE WHEN coalesce(len(ids), 0) > 0 AND page_number IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS provenance_coverage, count(*) AS n FROM stored GROUP BY ALL UNION ALL SELECT 'none', 0.0, 0")
def provision_provenance(s: SparkSession, d: str) -> DataFrame:
    rows = _rows(s, d)
    return re.provenance_coverage(rows, "document_version_id").unionByName(re.provenance_coverage(rows.filter("version > 9")).withColumn("document_version_id", F.lit("none")))


@query(f"WITH {_ROWS}, f AS (SELECT owner, provision_id, min(row_id) AS first FROM stored GROUP BY ALL HAVING count(*) > 1) SELECT owner, string_agg(provision_id, ',' ORDER BY first) AS ids FROM f GROUP BY owner")
def repeated_first_seen(s: SparkSession, d: str) -> DataFrame:
    return re.repeated_in_order(_rows(s, d), "provision_id", "owner", "row_id").withColumn("ids", F.array_join("ids", ","))


@query(f"WITH {_ROWS} SELECT row_id, CAST(row_number() OVER (ORDER BY effective_from NULLS FIRST, row_id) AS INTEGER) AS place FROM stored WHERE review_status = 'PENDING' QUALIFY place <= 50")
def review_queue(s: SparkSession, d: str) -> DataFrame:
    return re.queued(_rows(s, d).withColumn("status", F.col("review_status")), 50, "PENDING", "effective_from", "row_id").select("row_id", "place")


@query(
    f"""WITH {_ROWS}, u AS (SELECT 'unique_version' AS "constraint", row_id FROM (SELECT *, min(row_id) OVER (PARTITION BY provision_id, version, owner) AS first FROM stored WHERE owner IS NOT NULL) WHERE row_id != first),
    p AS (SELECT 'one_pending_point' AS "constraint", row_id FROM (SELECT *, min(row_id) OVER (PARTITION BY provision_id) AS first FROM stored WHERE review_status = 'PENDING' AND node_kind = 'POINT') WHERE row_id != first),
    c AS (SELECT 'accepted_is_dated', row_id FROM stored WHERE review_status = 'ACCEPTED' AND effective_from IS NULL UNION ALL SELECT 'interval', row_id FROM stored WHERE effective_to <= effective_from), f AS (SELECT 'version_exists', row_id FROM stored WHERE document_version_id NOT IN ('v-en', 'v-fr', 'v-de')),
    m AS (SELECT *, coalesce(effective_to, DATE '9999-12-31') AS fin FROM stored WHERE review_status = 'ACCEPTED' AND effective_from IS NOT NULL AND coalesce(effective_to, DATE '9999-12-31') > effective_from),
    x AS (SELECT 'accepted_apart', row_id FROM (SELECT *, max(fin) OVER (PARTITION BY provision_id ORDER BY effective_from, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m) WHERE effective_from < reach)
    SELECT "constraint", CAST(row_id AS VARCHAR) AS key FROM (SELECT * FROM u UNION ALL SELECT * FROM p UNION ALL SELECT * FROM c UNION ALL SELECT * FROM f UNION ALL SELECT * FROM x)"""
)
def constraint_report(s: SparkSession, d: str) -> DataFrame:
    """Unique, partly unique, checks, references and excluded overlaps of stored rows in one report."""
    accepted, pending = F.col("review_status") == "ACCEPTED", (F.col("review_status") == "PENDING") & (F.col("node_kind") == "POINT")
    versions = s.createDataFrame([("v-en",), ("v-fr",), ("v-de",)], "id string")
    return re.violations(
        _rows(s, d), "row_id", {"unique_version": (("provision_id", "version", "owner"), None), "one_pending_point": (("provision_id",), pending)},
        {"accepted_is_dated": ~accepted | F.col("effective_from").isNotNull(), "interval": F.col("effective_to") > F.col("effective_from")},
        {"version_exists": ("document_version_id", versions, "id")}, {"accepted_apart": ("provision_id", "effective_from", "effective_to", accepted)},
    )


@query(
    f"""WITH {v.INDEX}, f AS (SELECT coalesce(a.point_id, i.point_id) AS id, CASE WHEN i.point_id IS NULL THEN 'missing' WHEN a.point_id IS NULL THEN 'extra' WHEN i.content_hash IS DISTINCT FROM a.content_hash OR i.content_hash IS NULL THEN 'stale' END AS state FROM authority a FULL JOIN snapshot i ON a.point_id = i.point_id)
    SELECT CASE WHEN state = 'extra' THEN 'delete' ELSE 'upsert' END AS action, state, count(*) AS points FROM f WHERE state IS NOT NULL GROUP BY ALL"""
)
def reconcile_plan(s: SparkSession, d: str) -> DataFrame:
    return ix.repair_plan(v.authority(s, d), v.index_snapshot(s, d))


@query(
    rf"""WITH {v.ELEMENTS} SELECT doc_id, reading_order, CASE WHEN element_type IN ('table', 'list_item') THEN CASE WHEN reading_order % 2 = 0 AND trim(text, {_BLANK}) != '' THEN text WHEN doc_id % 3 = 0 THEN '<table>body</table>'
      WHEN doc_id % 3 = 1 THEN '<table><tr><td>' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</td></tr></table>' END END AS table_html FROM elements"""
)
def table_html_precedence(s: SparkSession, d: str) -> DataFrame:
    """A table item's own HTML, else its body, else its cells, over all lines."""
    i, ro = F.col("doc_id"), F.col("reading_order")
    cells = F.when(i % 3 == 1, F.array(F.array("text")))
    html = el.item_table(F.upper("element_type"), F.when(ro % 2 == 0, F.col("text")), F.when(i % 3 == 0, "<table>body</table>").otherwise("  "), cells, ("table", "list_item"))
    return v.elements(s, d).select("doc_id", "reading_order", html.alias("table_html"))


@query(
    f"""WITH {v.ELEMENTS}, e AS (SELECT doc_id, page_number, CASE WHEN reading_order % 23 = 9 THEN 'e0' ELSE 'e' || reading_order END AS element_id, CASE WHEN reading_order % 29 = 11 THEN page_number + 1 ELSE page_number END AS own FROM elements)
    SELECT CAST(doc_id AS VARCHAR) AS parse_id, 'repeated_id' AS rule, count(*) AS n FROM (SELECT doc_id, element_id FROM e GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_id UNION ALL SELECT CAST(doc_id AS VARCHAR), 'page_match', count(*) FROM e WHERE own != page_number GROUP BY doc_id
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'time_order', 1 FROM documents WHERE doc_id % 13 = 2"""
)
def nested_violations(s: SparkSession, d: str) -> DataFrame:
    """Nested documents in which ids repeat, elements name another page, or a parse ends before it begins."""
    i, ro = F.col("doc_id"), F.col("reading_order")
    parses = v.documents(s, d).select(i.cast("string").alias("parse_id"), i.alias("document_id"), F.timestamp_seconds(F.lit(100)).alias("started_at"), F.timestamp_seconds(F.when(i % 13 == 2, 99).otherwise(100)).alias("completed_at"))
    rows = v.elements(s, d).select(i.cast("string").alias("parse_id"), F.col("page_number").alias("page"), F.when(ro % 29 == 11, F.col("page_number") + 1).otherwise(F.col("page_number")).alias("page_number"), "reading_order", F.when(ro % 23 == 9, "e0").otherwise(F.concat(F.lit("e"), ro)).alias("element_id"), "text")
    held = rows.select("parse_id", F.col("page").alias("_page"), "reading_order", "element_id", "text", F.col("page_number").alias("own"))
    nested = ne.rebuilt(parses, held.withColumnRenamed("_page", "page_number"), element=("reading_order", "element_id", "text", "own"))
    renamed = F.transform("pages", lambda p: F.struct(p["page_number"].alias("page_number"), p["text"].alias("text"), F.transform(p["elements"], lambda e: F.struct(e["element_id"].alias("element_id"), e["own"].alias("page_number"))).alias("elements")))
    return ne.violations(nested.withColumn("pages", renamed))


@query(
    """WITH r AS (SELECT vec_id % 97 AS query_id, label % 4 AS category, vec_id AS unit_id FROM embeddings WHERE vec_id % 5 < 2), f AS (SELECT vec_id % 97 AS query_id, vec_id AS unit_id, 1 + vec_id // 97 % 30 AS rank FROM embeddings WHERE vec_id % 3 != 1), a AS (SELECT DISTINCT query_id FROM r WHERE query_id % 6 != 5),
    b AS (SELECT query_id, category, min(rank) AS rank FROM r LEFT JOIN f USING (query_id, unit_id) WHERE query_id IN (SELECT query_id FROM a) GROUP BY ALL), p AS (SELECT query_id, avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0.0 END) AS recall, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END) = 1 AS all_at_k, count(*) AS hops FROM b GROUP BY query_id)
    SELECT query_id, round(recall, 6) AS recall, all_at_k, hops, CASE WHEN hops > 1 THEN recall = 1 END AS complete FROM p"""
)
def evidence_sets(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings").withColumn("query_id", F.col("vec_id") % 97)
    required = e.filter("vec_id % 5 < 2").select("query_id", (F.col("label") % 4).alias("category"), F.col("vec_id").alias("unit_id"))
    found = e.filter("vec_id % 3 != 1").select("query_id", F.col("vec_id").alias("unit_id"), (F.expr("vec_id div 97") % 30 + 1).alias("rank"))
    return ev.evidence_metrics(required, found, required.filter("query_id % 6 != 5"))


@query(
    """WITH u AS (SELECT role AS variant, conv_id AS query_id, CASE turn % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE CASE WHEN role = 'system' THEN 'unpriced' ELSE 'small' END END AS model, length(coalesce(text, '')) AS i, turn + 1 AS o FROM conversations),
    p AS (SELECT *, CASE model WHEN 'small' THEN 0.15 * i + 0.6 * o WHEN 'large' THEN 2.5 * i + 10 * o END AS cost FROM u), g AS (SELECT variant, count(DISTINCT query_id) AS queries, CAST(sum(i + o) AS BIGINT) AS tokens, CASE WHEN count(cost) = count(*) THEN CAST(sum(CAST(cost AS DECIMAL(30, 6))) AS DOUBLE) / 1000000 END AS total FROM p GROUP BY variant)
    SELECT variant, queries, tokens, round(total, 6) AS cost, round(total / queries, 6) AS cost_per_query FROM g"""
)
def query_costs(s: SparkSession, d: str) -> DataFrame:
    turn = F.col("turn")
    model = F.when(turn % 3 == 0, "small").when(turn % 3 == 1, "large").when(F.col("role") == "system", "unpriced").otherwise("small")
    usage = table(s, d, "conversations").select(F.col("role").alias("variant"), F.col("conv_id").alias("query_id"), model.alias("model"), F.length(F.coalesce("text", F.lit(""))).alias("input_tokens"), (turn + 1).alias("output_tokens"))
    prices = s.createDataFrame([("small", "0.15", "0.6"), ("large", "2.5", "10")], "model string, input_price string, output_price string")
    return ev.costs(usage, prices, "variant")


_ANSWERS = rf"""a AS (SELECT doc_id AS answer_id, text, CASE WHEN doc_id % 19 != 3 THEN DATE '2021-01-01' + CAST(doc_id % 400 AS INTEGER) END AS query_date FROM documents),
  claims AS (SELECT doc_id AS answer_id, n AS claim_id, split_part(coalesce(text, ''), chr(10), CAST(n AS INTEGER)) AS text FROM documents, (SELECT unnest([1, 2]) AS n)),
  cites AS (SELECT doc_id AS answer_id, n AS claim_id, 'p-' || CASE WHEN doc_id % 5 = 4 AND n = 2 THEN doc_id + 1 ELSE doc_id END AS provision_id FROM documents, (SELECT unnest([1, 2]) AS n) WHERE doc_id % 17 != 6),
  p AS (SELECT 'p-' || doc_id AS provision_id, doc_id AS row_id, text, lang AS category, CASE WHEN doc_id % 23 = 1 THEN 'PENDING' ELSE 'ACCEPTED' END AS review_status, DATE '2020-01-01' + CAST(doc_id % 500 AS INTEGER) AS f, CASE WHEN doc_id % 3 = 0 THEN DATE '2021-06-01' + CAST(doc_id % 500 AS INTEGER) END AS t FROM documents)"""
_OWN = r"list_distinct(regexp_extract_all(lower(nfc_normalize(coalesce({}, ''))), '([\p{{L}}\p{{Nl}}\p{{No}}]+)', 1))"
_NUMBERS = r"list_distinct(list_transform(regexp_extract_all(coalesce({}, ''), '([0-9]+(?:[.,][0-9]+)*)', 1), lambda x: regexp_replace(x, '[.,]', '', 'g')))"


@query(
    rf"""WITH {_ANSWERS}, vers AS (SELECT c.*, p.row_id, p.text, p.category FROM cites c JOIN a USING (answer_id) JOIN p USING (provision_id) WHERE review_status = 'ACCEPTED' AND f <= query_date AND (t IS NULL OR query_date < t)),
    known AS (SELECT provision_id FROM p WHERE review_status = 'ACCEPTED'), cit AS (SELECT c.answer_id, bool_and(c.provision_id IN (SELECT provision_id FROM known) AND c.answer_id % 29 != 8) AS citations, bool_and(row_id IS NOT NULL) AS temporal, coalesce(string_agg(DISTINCT CAST(row_id AS VARCHAR), ',' ORDER BY CAST(row_id AS VARCHAR)), '') AS checked
      FROM cites c LEFT JOIN vers v ON v.answer_id = c.answer_id AND v.claim_id = c.claim_id AND v.provision_id = c.provision_id GROUP BY c.answer_id),
    e AS (SELECT answer_id, claim_id, {_NUMBERS.format("string_agg(text, ' | ')")} AS nums, {_OWN.format("string_agg(text, ' | ')")} AS words FROM vers GROUP BY ALL),
    cl AS (SELECT c.answer_id, {_OWN.format("c.text")} AS own, {_NUMBERS.format("c.text")} AS mine, nums, words FROM claims c LEFT JOIN e ON e.answer_id = c.answer_id AND e.claim_id = c.claim_id),
    per AS (SELECT answer_id, bool_and(len(own) > 0) AS worded, bool_and(len(list_filter(mine, lambda x: NOT list_contains(coalesce(nums, []), x))) = 0) AS numbers, bool_and(words IS NOT NULL AND len(list_intersect(own, coalesce(words, []))) >= 0.5 * len(own)) AS support FROM cl GROUP BY answer_id),
    pl AS (SELECT doc_id AS answer_id, bool_and(EXISTS (SELECT 1 FROM vers v WHERE v.answer_id = doc_id AND v.category = q.category)) AS evidence FROM (SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN 'en' ELSE lang END AS category FROM documents WHERE doc_id % 4 != 3) q GROUP BY doc_id),
    o AS (SELECT a.answer_id, coalesce(trim(a.text, ' ') != '', false) AND query_date IS NOT NULL AND worded AS "schema", coalesce(citations, false) AS citations, coalesce(temporal, false) AS temporal, numbers, support, coalesce(evidence, true) AS evidence, coalesce(checked, '') AS checked FROM a LEFT JOIN cit USING (answer_id) LEFT JOIN per USING (answer_id) LEFT JOIN pl USING (answer_id))
    SELECT *, "schema" AND citations AND temporal AND numbers AND support AND evidence AS valid FROM o"""
)
def six_layers(s: SparkSession, d: str) -> DataFrame:
    """Whole documents as answers: their first two lines are claims, which cite the document's own row or its neighbour's."""
    i, docs = F.col("doc_id"), v.documents(s, d)
    date = F.when(i % 19 != 3, F.date_add(F.to_date(F.lit("2021-01-01")), (i % 400).cast("int")))
    answers = docs.select(i.alias("answer_id"), "text", date.alias("query_date"))
    parts = F.split(F.coalesce("text", F.lit("")), "\n")
    claims = docs.select(i.alias("answer_id"), F.posexplode(F.array(F.coalesce(F.get(parts, 0), F.lit("")), F.coalesce(F.get(parts, 1), F.lit("")))).alias("at", "text")).select("answer_id", (F.col("at") + 1).alias("claim_id"), "text")
    cited = F.when((i % 5 == 4) & (F.col("claim_id") == 2), i + 1).otherwise(i)
    citations = docs.filter("doc_id % 17 != 6").withColumn("claim_id", F.explode(F.array(F.lit(1), F.lit(2)))).select(i.alias("answer_id"), "claim_id", F.concat(F.lit("p-"), cited).alias("provision_id"))
    context = citations.filter("answer_id % 29 != 8").select("answer_id", "provision_id")
    begin = F.date_add(F.to_date(F.lit("2020-01-01")), (i % 500).cast("int"))
    provisions = docs.select(F.concat(F.lit("p-"), i).alias("provision_id"), i.alias("row_id"), "text", F.col("lang").alias("category"), F.when(i % 23 == 1, "PENDING").otherwise("ACCEPTED").alias("review_status"), begin.alias("effective_from"), F.when(i % 3 == 0, F.date_add(F.to_date(F.lit("2021-06-01")), (i % 500).cast("int"))).alias("effective_to"))
    plan = docs.filter("doc_id % 4 != 3").select(i.alias("answer_id"), F.when(i % 6 == 1, "en").otherwise(F.col("lang")).alias("category"))
    out = vf.verified_answers(answers, claims, citations, context, provisions, plan)
    return out.withColumn("checked", F.array_join(F.array_sort(F.transform("checked", lambda x: x.cast("string"))), ","))


@query(
    """WITH e AS (SELECT doc_id AS point_id, list_filter(['relation', 'relation_type', 'target_provision_id', 'vehicle_types'], lambda x: (x = 'relation' AND doc_id % 7 = 1) OR (x = 'relation_type' AND doc_id % 5 = 2) OR (x = 'target_provision_id' AND lang IS DISTINCT FROM 'en' AND doc_id % 4 = 1) OR (x = 'vehicle_types' AND doc_id % 9 = 4)) AS errors FROM documents WHERE doc_id % 8 != 5)
    SELECT point_id, array_to_string(errors, ',') AS errors FROM e WHERE len(errors) > 0"""
)
def payload_refusals(s: SparkSession, d: str) -> DataFrame:
    """Relations without a type or target, null relations and empty vehicle types; units without either are fine."""
    i = F.col("doc_id")
    relation = F.struct(F.when(i % 5 == 2, "").otherwise("REFERS_TO").alias("relation_type"), F.when(~((i % 4 == 1) & (F.col("lang") != "en")), F.concat(F.lit("p-"), i)).alias("target_provision_id"))
    relations = F.when(i % 8 != 5, F.when(i % 7 == 1, F.array(relation, F.lit(None).cast("struct<relation_type:string,target_provision_id:string>"))).otherwise(F.array(relation)))
    vehicles = F.when(i % 8 != 5, F.when(i % 9 == 4, F.array(F.lit("car"), F.lit(""))).otherwise(F.array(F.lit("car"))))
    return vf.payload_errors(v.documents(s, d).select(i.alias("point_id"), relations.alias("relations"), vehicles.alias("vehicle_types"))).withColumn("errors", F.array_join("errors", ","))


@query(
    r"""WITH m AS (SELECT doc_id AS i, text FROM documents), e AS (SELECT i, unnest([CASE WHEN i % 31 = 30 THEN 'not_object' END, CASE WHEN i % 31 != 30 THEN CASE WHEN i % 7 = 3 THEN 'missing:file_hash' WHEN i % 7 = 4 THEN 'value:file_hash' END END, CASE WHEN i % 31 != 30 AND i % 5 = 1 THEN 'unknown:extra' END, CASE WHEN i % 31 != 30 AND i % 11 = 2 THEN 'type:issuer' END,
      CASE WHEN i % 31 != 30 AND i % 13 = 5 THEN 'value:document_type' END, CASE WHEN i % 31 != 30 AND i % 9 = 4 THEN 'value:issued_date' END, CASE WHEN i % 31 != 30 AND i % 6 = 2 THEN 'missing:reviewed_by' END, CASE WHEN i % 31 != 30 AND i % 6 = 2 THEN 'missing:reviewed_at' END,
      CASE WHEN i % 31 != 30 AND i % 6 IN (1, 2) AND i % 8 = 7 THEN 'accepted_undated' END, CASE WHEN i % 31 != 30 AND i % 8 != 7 AND i % 10 = 6 THEN 'interval' END, CASE WHEN i % 31 != 30 AND text IS NULL THEN 'missing:relation_notes' END, CASE WHEN i % 31 != 30 AND i % 17 = 9 THEN 'value:source_url' END]) AS error FROM m)
    SELECT i AS doc_id, error FROM e WHERE error IS NOT NULL"""
)
def manifest_schema(s: SparkSession, d: str) -> DataFrame:
    """A manifest for each document, its whole text as notes, against every rule of the schema."""
    i = F.col("doc_id")
    fields = {
        "document_id": F.concat(F.lit("nd-"), i), "source_url": F.when(i % 17 == 9, "no address").otherwise("https://example.org/a"), "downloaded_at": F.lit("2024-01-02T03:04:05Z"),
        "file_hash": F.when(i % 7 == 3, None).when(i % 7 == 4, "ABC").otherwise(F.sha2(F.coalesce("text", F.lit("")), 256)), "document_number": F.lit("1/2024"), "document_type": F.when(i % 13 == 5, "LETTER").otherwise("LAW"),
        "issuer": F.when(i % 11 == 2, "@5@").otherwise("X"), "issued_date": F.when(i % 9 == 4, "2024-02-30").otherwise("2024-02-29"), "effective_from": F.when(i % 8 == 7, "@null@").otherwise("2024-03-01"),
        "effective_to": F.when(i % 10 == 6, "2024-03-01T23:00:00+07:00").when(i % 10 == 5, "2024-03-02").otherwise("@null@"), "status": F.lit("EFFECTIVE"), "relation_notes": F.col("text"),
        "review_status": F.when(i % 6 == 0, "PENDING").when(i % 6 < 3, "ACCEPTED").otherwise("DROPPED"), "reviewed_by": F.when(i % 6 == 1, "r"), "reviewed_at": F.when(i % 6 == 1, "2024-01-01"), "extra": F.when(i % 5 == 1, "x"),
    }
    raw = F.regexp_replace(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])), '"@(null|5)@"', "$1")
    return va.manifest_schema_errors(v.documents(s, d).select("doc_id", F.when(i % 31 == 30, F.concat(F.lit("["), raw, F.lit("]"))).otherwise(raw).alias("raw")), "doc_id", "raw")


@query(
    """WITH t AS (SELECT vec_id, vec_id // 16 AS batch, vec_id % 16 AS place, len(embedding) AS n FROM embeddings), b AS (SELECT batch, CASE batch % 7 WHEN 1 THEN 'count' WHEN 2 THEN 'dimension' WHEN 3 THEN 'index' WHEN 4 THEN 'not_numeric' END AS error, count(*) AS n FROM t GROUP BY ALL)
    SELECT batch, error, CAST(CASE WHEN error IS NULL THEN n ELSE 0 END AS BIGINT) AS vectors FROM b"""
)
def provider_batches(s: SparkSession, d: str) -> DataFrame:
    """Batches of vectors as a provider gives them, backwards; some lack one, repeat an index, are short, or hold no number."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("text_id"), F.expr("vec_id div 16").alias("batch"), (F.col("vec_id") % 16).alias("place"), "embedding")
    kind = F.col("batch") % 7
    first, vector = F.min("place").over(W.partitionBy("batch")) == F.col("place"), F.col("embedding").cast("array<double>")
    held = e.withColumn("first", first).filter(~((kind == 1) & F.col("first")))
    broken = F.when((kind == 2) & F.col("first"), F.slice(vector, 1, 63)).when((kind == 4) & F.col("first"), F.transform(vector, lambda x: F.lit(float("nan")))).otherwise(vector)
    answers = held.select("batch", F.when((kind == 3) & F.col("first"), F.col("place") + 99).otherwise(F.col("place")).alias("index"), broken.alias("embedding")).orderBy(F.desc("index"))
    found, errors = se.provider_vectors(e.drop("embedding"), answers, 64)
    per = found.groupBy("batch").agg(F.count("*").alias("vectors"))
    return e.select("batch").distinct().join(errors, "batch", "left").join(per, "batch", "left").select("batch", "error", F.coalesce("vectors", F.lit(0)).alias("vectors"))
