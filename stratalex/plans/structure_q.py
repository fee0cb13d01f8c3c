"""Queries of structure recognition, context, gates and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalex.functions.text import point_label
from stratalex.operators import context as cx
from stratalex.operators import elements as el
from stratalex.operators import quality as qu
from stratalex.operators import structure as st
from stratalex.sources.stored import stored

from . import views as v
from .catalog import query

W_ALL = "PARTITION BY doc_id ORDER BY page_number, reading_order"
# A line without its outer and repeated white space, as both engines see it.
_LINE = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_FOLD = rf"replace(lower({_LINE}), 'ß', 'ss')"
_CLEAN = f"""{v.MARKED}, counted AS (SELECT *, {_LINE} AS line, count(*) OVER (PARTITION BY doc_id, {_FOLD}) AS times, min(page_number) OVER (PARTITION BY doc_id, {_FOLD}) AS low, max(page_number) OVER (PARTITION BY doc_id, {_FOLD}) AS high FROM marked),
    clean AS (SELECT * FROM counted WHERE line != '' AND NOT (element_type IN ('page_header', 'page_footer') OR ((top <= 0.15 OR bottom >= 0.85) AND times > 1 AND low < high)))"""
_KIND = r"""CASE WHEN regexp_matches(line, '(?i)^Chương\s+([IVXLCDM]+|\d+)\s*[.:-]?\s*(.*)$') THEN 'CHAPTER' WHEN regexp_matches(line, '(?i)^Mục\s+([IVXLCDM]+|\d+)\s*[.:-]?\s*(.*)$') THEN 'SECTION' WHEN regexp_matches(line, '(?i)^Điều\s+(\d+[A-Za-z]?)\s*[.:-]?\s*(.*)$') THEN 'ARTICLE'
    WHEN element_type = 'table' OR regexp_matches(line, '(?i)^Bảng\s+\d+') THEN 'TABLE' WHEN regexp_matches(line, '(?i)^([aăâbcdđeêghiklmnoôơpqrstuưvxy])\s*[)]\s*(.*)$') THEN 'POINT' WHEN regexp_matches(line, '^(\d+)\s*[.]\s*(.*)$') THEN 'CLAUSE'
    WHEN element_type = 'list_item' THEN 'ITEM' WHEN element_type IN ('heading', 'title') THEN 'HEADING' END"""
_MATCHED = rf"""{_CLEAN}, kinds AS (SELECT *, {_KIND} AS kind FROM clean), matched AS (SELECT *, CASE kind WHEN 'CHAPTER' THEN regexp_extract(line, '(?i)^Chương\s+([IVXLCDM]+|\d+)', 1) WHEN 'SECTION' THEN regexp_extract(line, '(?i)^Mục\s+([IVXLCDM]+|\d+)', 1)
    WHEN 'ARTICLE' THEN regexp_extract(line, '(?i)^Điều\s+(\d+[A-Za-z]?)', 1) WHEN 'CLAUSE' THEN regexp_extract(line, '^(\d+)', 1) WHEN 'TABLE' THEN nullif(regexp_extract(line, '(\d+)', 1), '') END AS number, CASE WHEN kind = 'POINT' THEN lower(line[1]) || ')' END AS label FROM kinds WHERE kind IS NOT NULL)"""
_SCOPES = f"""{_MATCHED}, scoped AS (SELECT *, nullif(last_value(CASE WHEN kind = 'ARTICLE' THEN number WHEN kind IN ('CHAPTER', 'SECTION') THEN '' END IGNORE NULLS) OVER ({W_ALL} ROWS UNBOUNDED PRECEDING), '') AS article,
    nullif(last_value(CASE WHEN kind = 'CHAPTER' THEN number END IGNORE NULLS) OVER ({W_ALL} ROWS UNBOUNDED PRECEDING), '') AS chapter, sum(CASE WHEN kind IN ('CHAPTER', 'SECTION', 'ARTICLE') THEN 1 ELSE 0 END) OVER ({W_ALL} ROWS UNBOUNDED PRECEDING) AS run FROM matched)"""
_ITEMS = f"""{_SCOPES}, opened AS (SELECT *, coalesce(max(CASE WHEN kind IN ('CLAUSE', 'ITEM') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run ORDER BY page_number, reading_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS opened FROM scoped WHERE kind != 'ITEM' OR article IS NOT NULL),
    items AS (SELECT * EXCLUDE (kind), kind = 'ITEM' AS rebuilt, CASE WHEN kind != 'ITEM' THEN kind WHEN opened = 0 OR suffix(lower(line), 'gồm:') OR suffix(lower(line), 'như sau:') OR suffix(lower(line), 'sau đây:') THEN 'CLAUSE' ELSE 'POINT' END AS kind FROM opened)"""


@query(f"WITH {v.ELEMENTS} SELECT * FROM (SELECT doc_id, page_number, reading_order, element_type, text, top, bottom, 0.1 AS \"left\", 0.9 AS \"right\" FROM elements)")
def elements_from_lines(s: SparkSession, d: str) -> DataFrame:
    return v.elements(s, d)


@query(f"WITH {v.ELEMENTS} SELECT doc_id, page_number, coalesce(string_agg(text, chr(10) ORDER BY reading_order) FILTER (trim(text) != ''), '') AS page_text FROM elements GROUP BY doc_id, page_number")
def ir_page_text(s: SparkSession, d: str) -> DataFrame:
    return el.page_texts(v.elements(s, d))


@query(f"WITH {v.ELEMENTS} SELECT element_type, count(*) AS n FROM elements GROUP BY element_type")
def element_type_histogram(s: SparkSession, d: str) -> DataFrame:
    return el.histogram(v.elements(s, d))


@query(
    f"""WITH {v.ELEMENTS}, e AS (SELECT doc_id, reading_order % 50 AS element_id, CASE WHEN reading_order % 37 = 5 THEN 1.5 ELSE bottom END AS bottom, CASE WHEN reading_order % 41 = 6 THEN 0 ELSE page_number END AS page_number FROM elements), m AS (SELECT *, count(*) OVER (PARTITION BY doc_id, element_id) > 1 AS twice FROM e)
    SELECT doc_id, rule, count(*) AS n FROM (SELECT doc_id, unnest([CASE WHEN bottom > 1 THEN 'box' END, CASE WHEN page_number < 1 THEN 'page' END, CASE WHEN twice THEN 'repeated_id' END]) AS rule FROM m) WHERE rule IS NOT NULL GROUP BY ALL"""
)
def ir_violations(s: SparkSession, d: str) -> DataFrame:
    ro = F.col("reading_order")
    e = v.elements(s, d).withColumns({"element_id": ro % 50, "bottom": F.when(ro % 37 == 5, 1.5).otherwise(F.col("bottom")), "page_number": F.when(ro % 41 == 6, 0).otherwise(F.col("page_number"))})
    return el.violations(e)


@query(f"WITH {_CLEAN} SELECT doc_id, reading_order, line FROM clean")
def chrome_filter(s: SparkSession, d: str) -> DataFrame:
    return st.without_chrome(v.marked(s, d)).select("doc_id", "reading_order", "line")


@query(f"WITH {_MATCHED} SELECT doc_id, reading_order, kind, number, label FROM matched")
def structure_nodes(s: SparkSession, d: str) -> DataFrame:
    return st.matched(st.without_chrome(v.marked(s, d))).select("doc_id", "reading_order", "kind", "number", "label")


@query(f"WITH {_SCOPES} SELECT doc_id, reading_order, chapter, article, CAST(run AS BIGINT) AS run FROM scoped")
def scope_tracking(s: SparkSession, d: str) -> DataFrame:
    return st.scopes(st.matched(st.without_chrome(v.marked(s, d)))).select("doc_id", "reading_order", "chapter", "article", F.col("article_run").alias("run"))


@query(
    f"""WITH {_ITEMS}, k AS (SELECT *, sum(CASE WHEN rebuilt AND kind = 'CLAUSE' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run ORDER BY page_number, reading_order ROWS UNBOUNDED PRECEDING) AS k FROM items),
    n AS (SELECT *, k + greatest(0, coalesce(max(CASE WHEN kind = 'CLAUSE' AND NOT rebuilt THEN CAST(number AS BIGINT) - k END) OVER (PARTITION BY doc_id, run ORDER BY page_number, reading_order ROWS UNBOUNDED PRECEDING), 0)) AS n FROM k)
    SELECT doc_id, reading_order, CASE WHEN rebuilt THEN CAST(CAST(n AS BIGINT) AS VARCHAR) ELSE number END AS number, rebuilt FROM n WHERE kind = 'CLAUSE'"""
)
def missing_clause_numbers(s: SparkSession, d: str) -> DataFrame:
    n = st.clause_numbers(st.list_items(st.scopes(st.matched(st.without_chrome(v.marked(s, d))))))
    return n.filter("kind = 'CLAUSE'").select("doc_id", "reading_order", "number", "rebuilt")


_RUNS = f"""{_ITEMS}, runs AS (SELECT *, sum(CASE WHEN kind IN ('CHAPTER', 'SECTION', 'ARTICLE', 'CLAUSE', 'APPENDIX') THEN 1 ELSE 0 END) OVER ({W_ALL} ROWS UNBOUNDED PRECEDING) AS point_run FROM items)"""


@query(
    f"""WITH {_RUNS}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, point_run, label ORDER BY page_number, reading_order) AS nth FROM runs WHERE kind = 'POINT' AND label IS NOT NULL)
    SELECT doc_id, reading_order, CASE WHEN label = 'd)' AND nth = 2 THEN 'đ)' ELSE label END AS label, CASE WHEN label = 'd)' AND nth = 2 THEN 'OCR d/đ ambiguity normalized from duplicate d)' WHEN label = 'd)' AND nth > 2 THEN 'duplicate d) point label' END AS remark FROM p"""
)
def duplicate_d_repair(s: SparkSession, d: str) -> DataFrame:
    n = st.list_items(st.scopes(st.matched(st.without_chrome(v.marked(s, d))))).filter("kind != 'POINT' or label is not null")
    return st.point_labels(n).filter("kind = 'POINT'").select("doc_id", "reading_order", "label", "remark")


_FALLBACK = "[" + ", ".join(f"'{x})'" for x in st.FALLBACK) + "]"
_NEXT = f"CASE WHEN t.label IS NULL THEN coalesce(list_filter({_FALLBACK}, lambda x: NOT list_contains(acc, x))[1], 'a)') WHEN t.label = 'd)' AND list_contains(acc, 'd)') AND NOT list_contains(acc, 'đ)') THEN 'đ)' ELSE t.label END"


@query(
    f"""WITH RECURSIVE {_RUNS}, t AS (SELECT doc_id, point_run, reading_order, CASE WHEN reading_order % 3 != 2 THEN label END AS label, row_number() OVER (PARTITION BY doc_id, point_run ORDER BY page_number, reading_order) AS n FROM (SELECT doc_id, page_number, reading_order, label, reading_order // 24 AS point_run FROM runs WHERE kind = 'POINT')),
    f AS (SELECT doc_id, point_run, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS label, CAST([] AS VARCHAR[]) AS acc FROM (SELECT DISTINCT doc_id, point_run FROM t)
      UNION ALL SELECT t.doc_id, t.point_run, t.n, {_NEXT} AS label, list_append(acc, {_NEXT}) AS acc FROM f JOIN t ON t.doc_id = f.doc_id AND t.point_run = f.point_run AND t.n = f.n + 1)
    SELECT t.doc_id, t.reading_order, f.label FROM t JOIN f USING (doc_id, point_run, n) WHERE t.label IS NULL"""
)
def missing_point_labels(s: SparkSession, d: str) -> DataFrame:
    """All points that lost their label, a third of them, in runs of 24 lines."""
    n = st.list_items(st.scopes(st.matched(st.without_chrome(v.marked(s, d))))).filter("kind = 'POINT'")
    lost = n.withColumn("label", F.when(F.col("reading_order") % 3 != 2, F.col("label")))
    # A mark ahead of every 24 lines closes the run before; the first point behind it brings it along, so the rows are read once.
    r = F.expr("reading_order div 24")
    first = ~r.eqNullSafe(F.lag(r).over(W.partitionBy("doc_id").orderBy("reading_order")))
    own = F.struct((F.col("reading_order") * 2 + 1).alias("reading_order"), F.lit("POINT").alias("kind"), F.col("label"))
    mark = F.struct((r.cast("int") * 48).alias("reading_order"), F.lit("CLAUSE").alias("kind"), F.lit(None).cast("string").alias("label"))
    marked = lost.select("doc_id", F.lit(-1).alias("page_number"), own.alias("own"), F.when(first, mark).alias("mark"))
    ordered = marked.select("doc_id", "page_number", F.inline(F.array_compact(F.array("mark", "own"))))
    return st.point_labels(ordered).filter(F.col("remark") == st.LOST).select("doc_id", F.expr("cast(reading_order div 2 as int)").alias("reading_order"), "label")


_ARTICLES = f"{_SCOPES}, ids AS (SELECT doc_id || '__dieu-' || article AS provision_id, doc_id, kind, line FROM scoped WHERE kind = 'ARTICLE' AND regexp_matches(article, '^[0-9]+$'))"


@query(
    f"""WITH {_ITEMS}, k AS (SELECT *, sum(CASE WHEN rebuilt AND kind = 'CLAUSE' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run ORDER BY page_number, reading_order ROWS UNBOUNDED PRECEDING) AS k FROM items),
    n AS (SELECT *, k + greatest(0, coalesce(max(CASE WHEN kind = 'CLAUSE' AND NOT rebuilt THEN CAST(number AS BIGINT) - k END) OVER (PARTITION BY doc_id, run ORDER BY page_number, reading_order ROWS UNBOUNDED PRECEDING), 0)) AS n FROM k),
    c AS (SELECT doc_id || '__dieu-' || article AS parent_id, doc_id || '__dieu-' || article || '__khoan-' || (CASE WHEN rebuilt THEN CAST(CAST(n AS BIGINT) AS VARCHAR) ELSE number END) AS provision_id FROM n WHERE kind = 'CLAUSE' AND regexp_matches(article, '^[0-9]+$')),
    a AS (SELECT doc_id || '__dieu-' || article AS provision_id, min(line) AS line FROM scoped WHERE kind = 'ARTICLE' GROUP BY 1) SELECT c.provision_id, a.line AS parent_line FROM c LEFT JOIN a ON c.parent_id = a.provision_id"""
)
def parent_join(s: SparkSession, d: str) -> DataFrame:
    # Three sides of the joins read the provisions: they are built once.
    built = st.provisions(st.nodes(v.marked(s, d))).select("doc_id", "provision_id", "kind", "line", "article", "number", "clause")
    return cx.with_parents(stored(built, "provisions")).filter("kind = 'CLAUSE'").select("provision_id", "parent_line")


_GATES = f"""{v.ELEMENTS}, e AS (SELECT *, CASE WHEN reading_order % 11 = 3 THEN NULL ELSE top END AS box FROM elements), p AS (SELECT doc_id, page_number, max(CASE WHEN trim(text) != '' THEN 1.0 ELSE 0.0 END) AS filled FROM e GROUP BY ALL),
    m AS (SELECT e.doc_id, round(avg(CASE WHEN box IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS provenance_coverage, count(*) FILTER (element_type = 'table') AS tables FROM e GROUP BY 1), t AS (SELECT doc_id, round(avg(filled), 6) AS text_extraction_rate FROM p GROUP BY 1),
    q AS (SELECT m.doc_id, provenance_coverage, text_extraction_rate, CASE WHEN m.doc_id % 4 > 0 THEN round(tables / (m.doc_id % 4), 6) END AS table_detection_rate FROM m JOIN t USING (doc_id))"""


def _metrics(s: SparkSession, d: str) -> DataFrame:
    e = v.elements(s, d).withColumn("left", F.when(F.col("reading_order") % 11 != 3, F.col("left")))
    expected = v.documents(s, d).select("doc_id", (F.col("doc_id") % 4).cast("int").alias("expected"))
    return qu.extraction_metrics(e, el.page_texts(v.elements(s, d)), expected)


@query(f"WITH {_GATES} SELECT doc_id, provenance_coverage, text_extraction_rate, table_detection_rate FROM q")
def extraction_metrics(s: SparkSession, d: str) -> DataFrame:
    return _metrics(s, d)


@query(
    f"""WITH {_GATES}, g AS (SELECT doc_id, CASE WHEN provenance_coverage >= 0.95 THEN 'passed' ELSE 'failed' END AS a, CASE WHEN text_extraction_rate >= 0.9 THEN 'passed' ELSE 'failed' END AS b, CASE WHEN table_detection_rate IS NULL THEN 'na' WHEN table_detection_rate >= 0.8 THEN 'passed' ELSE 'failed' END AS c FROM q)
    SELECT doc_id, a AS provenance_coverage_gate, b AS text_extraction_rate_gate, c AS table_detection_rate_gate, 'na' AS layout_coherence_gate, CASE WHEN 'failed' IN (a, b, c) THEN 'failed' WHEN 'passed' IN (a, b, c) THEN 'passed' ELSE 'na' END AS group_a FROM g"""
)
def group_a_gates(s: SparkSession, d: str) -> DataFrame:
    return qu.group_a(_metrics(s, d).join(qu.layout_coherence(v.elements(s, d)), "doc_id", "left"))


_BENT = "e AS (SELECT doc_id, page_number, reading_order // 2 AS ro, CASE WHEN reading_order % 7 = 3 THEN 0.5 ELSE top END AS top FROM elements)"


@query(
    f"""WITH {v.ELEMENTS}, {_BENT.replace("FROM elements", "FROM elements WHERE doc_id % 10 != 7")}, pairs AS (SELECT a.doc_id, a.page_number, avg(CASE WHEN round(b.top, 2) > round(a.top, 2) THEN 1.0 ELSE 0.0 END) AS score FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.page_number = b.page_number AND a.ro < b.ro AND round(a.top, 2) != round(b.top, 2) GROUP BY ALL),
    pages AS (SELECT DISTINCT doc_id, page_number FROM e), s AS (SELECT doc_id, round(avg(coalesce(score, 1.0)), 6) AS layout_coherence FROM pages LEFT JOIN pairs USING (doc_id, page_number) GROUP BY doc_id)
    SELECT doc_id, CASE WHEN doc_id % 10 = 7 OR text IS NULL THEN 1.0 ELSE layout_coherence END AS layout_coherence FROM documents LEFT JOIN s USING (doc_id)"""
)
def layout_coherence(s: SparkSession, d: str) -> DataFrame:
    """Orders and boxes with ties, which say nothing of the layout, and documents without elements."""
    bent = v.elements(s, d).filter("doc_id % 10 != 7").withColumn("top", F.when(F.col("reading_order") % 7 == 3, 0.5).otherwise(F.col("top")))
    return qu.layout_coherence(bent.withColumn("reading_order", F.expr("reading_order div 2")), v.documents(s, d))


@query(
    f"""WITH {v.ELEMENTS}, t AS (SELECT doc_id, count(*) AS tables, count(*) FILTER (reading_order % 3 != 0 AND trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) != '') AS preserved FROM elements WHERE element_type = 'table' GROUP BY doc_id),
    e AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE doc_id % 7 END AS expected FROM documents), c AS (SELECT doc_id, tables, preserved, coalesce(expected > 0, false) AND tables IS NOT NULL AS ok FROM e LEFT JOIN t USING (doc_id))
    SELECT doc_id, CASE WHEN ok THEN 'computed' ELSE 'na' END AS status, CASE WHEN ok THEN preserved END AS preserved, CASE WHEN ok THEN tables END AS tables, CASE WHEN ok THEN round(preserved / tables, 6) END AS table_preservation FROM c"""
)
def table_preservation(s: SparkSession, d: str) -> DataFrame:
    """Tables of whole documents, a third of which lost their HTML, against a gold count that is missing, zero or not."""
    i = F.col("doc_id")
    html = v.elements(s, d).withColumn("table_html", F.when(F.col("reading_order") % 3 != 0, F.col("text")))
    gold = v.documents(s, d).select("doc_id", F.when(i % 4 == 0, None).when(i % 4 == 1, F.lit(0)).otherwise(i % 7).alias("expected"))
    return qu.table_preservation(html, gold)


@query(
    """WITH f AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'text/html' ELSE 'application/pdf' END AS mime, doc_id % 3 != 0 AS has_text_layer, CASE WHEN doc_id % 2 = 0 THEN doc_id % 7 END AS layout_complexity FROM documents),
    r AS (SELECT *, CASE WHEN mime != 'application/pdf' THEN 'other_mime' WHEN layout_complexity >= 3 THEN 'compare_complex_tables' WHEN has_text_layer THEN 'text' ELSE 'ocr' END AS route FROM f)
    SELECT doc_id, route, mime = 'application/pdf' AND NOT has_text_layer AS ocr_required, route = 'compare_complex_tables' AS compare, route != 'other_mime' AS has_fallback FROM r"""
)
def parser_route(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    files = v.documents(s, d).select("doc_id", F.when(i % 5 == 0, "text/html").otherwise("application/pdf").alias("mime"), (i % 3 != 0).alias("has_text_layer"), F.when(i % 2 == 0, i % 7).alias("layout_complexity"))
    return qu.parser_route(files).select("doc_id", "route", "ocr_required", "compare", "has_fallback")


@query(
    """WITH a AS (SELECT doc_id, coalesce(CASE WHEN doc_id % 4 > 0 THEN (doc_id % 5) / 4.0 END, -1) AS t, (doc_id % 3) / 2.0 AS p, (doc_id % 7) / 6.0 AS x FROM documents), b AS (SELECT doc_id, coalesce(CASE WHEN doc_id % 6 > 0 THEN (doc_id % 4) / 3.0 END, -1) AS t, (doc_id % 2) / 1.0 AS p, (doc_id % 5) / 4.0 AS x FROM documents WHERE doc_id % 8 != 0)
    SELECT a.doc_id, CASE WHEN b.doc_id IS NULL OR a.t > b.t OR (a.t = b.t AND (a.p > b.p OR (a.p = b.p AND a.x >= b.x))) THEN 'primary' ELSE 'alternate' END AS picked FROM a LEFT JOIN b USING (doc_id)"""
)
def compare_pick(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    docs = v.documents(s, d)
    a = docs.select("doc_id", F.when(i % 4 > 0, (i % 5) / 4.0).alias("table_detection_rate"), ((i % 3) / 2.0).alias("provenance_coverage"), ((i % 7) / 6.0).alias("text_extraction_rate"))
    b = docs.filter("doc_id % 8 != 0").select("doc_id", F.when(i % 6 > 0, (i % 4) / 3.0).alias("table_detection_rate"), ((i % 2) / 1.0).alias("provenance_coverage"), ((i % 5) / 4.0).alias("text_extraction_rate"))
    return qu.compare_and_pick(a, b)


def _ordinal_sql(tables: str) -> str:
    """A fold over each parent's tables, one table a step; ``tables``: parent_id, n (place from 1), number."""
    free = "list_min(list_filter(range(w, w + len(used) + 1), lambda x: NOT list_contains(used, x)))"
    return f"""f AS (SELECT parent_id, n, coalesce(number, 1) AS ordinal, [coalesce(number, 1)] AS used FROM {tables} WHERE n = 1
    UNION ALL SELECT parent_id, n, {free} AS ordinal, list_append(used, {free}) AS used FROM (SELECT t.parent_id, t.n, coalesce(t.number, f.ordinal + 1) AS w, f.used FROM f JOIN {tables} t ON t.parent_id = f.parent_id AND t.n = f.n + 1))"""


@query(
    f"""WITH RECURSIVE {v.ELEMENTS}, t AS (SELECT doc_id || '-' || reading_order // 40 AS parent_id, reading_order, CASE (reading_order * 7 + doc_id) % 6 WHEN 0 THEN 5 WHEN 2 THEN 2 WHEN 4 THEN reading_order % 9 WHEN 5 THEN length(text) % 4 END::BIGINT AS number,
      row_number() OVER (PARTITION BY doc_id, reading_order // 40 ORDER BY reading_order) AS n FROM elements WHERE reading_order % 3 < 2), {_ordinal_sql("t")}
    SELECT parent_id, reading_order, ordinal FROM f JOIN t USING (parent_id, n)"""
)
def table_ordinals(s: SparkSession, d: str) -> DataFrame:
    """Tables of several parents in each document, that ask for mixed numbers or none."""
    i, ro = F.col("doc_id"), F.col("reading_order")
    turn = (ro * 7 + i) % 6
    number = F.when(turn == 0, F.lit(5)).when(turn == 2, F.lit(2)).when(turn == 4, ro % 9).when(turn == 5, F.length("text") % 4)
    t = v.elements(s, d).filter(ro % 3 < 2).select(F.concat(i, F.lit("-"), F.expr("reading_order div 40")).alias("parent_id"), "reading_order", number.alias("number"))
    return st.table_ordinals(t).select("parent_id", "reading_order", "ordinal")


_TABLED = f"""{v.MARKED}, tabled AS (SELECT doc_id, page_number, reading_order, 0.5 AS top, 0.5 AS bottom, CASE WHEN reading_order % 4 = 3 THEN 'table' ELSE 'paragraph' END AS element_type,
  CASE WHEN reading_order % 4 = 3 THEN CASE reading_order % 5 WHEN 0 THEN 'Bảng ' || (reading_order % 3 + 1) || '. ' WHEN 1 THEN 'Bảng 5: ' ELSE '' END WHEN reading_order % 48 = 30 THEN 'Chuyển tiếp ' WHEN reading_order % 64 = 37 THEN 'Phụ lục. ' WHEN reading_order % 80 = 56 THEN 'Mục 2. ' ELSE '' END || text AS text FROM marked)"""
_TABLE_KINDS = _MATCHED.replace(v.MARKED, _TABLED).replace("high FROM marked)", "high FROM tabled)").replace(
    "WHEN element_type = 'table' OR", r"WHEN regexp_matches(line, '(?i)^Phụ\s+lục(?:\s+([IVXLCDM]+|\d+))?\s*[.:-]?\s*(.*)$') THEN 'APPENDIX' WHEN regexp_matches(line, '(?i)^(?:Điều\s+khoản\s+)?chuyển\s+tiếp') THEN 'TRANSITIONAL' WHEN element_type = 'table' OR"
)


def _open_sql(value: str, kind: str, *resets: str) -> str:
    return f"nullif(last_value(CASE WHEN kind = '{kind}' THEN {value} WHEN kind IN ('', {', '.join(repr(r) for r in resets)}) THEN '' END IGNORE NULLS) OVER w, '')"


_HIGHER = ("CHAPTER", "SECTION", "APPENDIX", "TRANSITIONAL")
_TABLE_ROWS = rf"""{_TABLE_KINDS}, numbered AS (SELECT * EXCLUDE (number), CASE WHEN kind = 'APPENDIX' THEN CAST(sum(CASE WHEN kind = 'APPENDIX' THEN 1 ELSE 0 END) OVER ({W_ALL} ROWS UNBOUNDED PRECEDING) AS VARCHAR) ELSE number END AS number FROM matched),
    around AS (SELECT *, {_open_sql("number", "CLAUSE", "ARTICLE", *_HIGHER)} AS clause, concat_ws(' ', {_open_sql("line", "CHAPTER", "-")}, {_open_sql("line", "SECTION", "CHAPTER")}) AS head, {_open_sql("line", "ARTICLE", *_HIGHER)} AS article_line, sum(CASE WHEN kind IN ('CHAPTER', 'SECTION', 'ARTICLE', 'CLAUSE', 'APPENDIX') THEN 1 ELSE 0 END) OVER w AS point_run, {_open_sql("number", "ARTICLE", *_HIGHER)} AS article, {_open_sql("number", "APPENDIX", "CHAPTER", "SECTION", "ARTICLE", "TRANSITIONAL")} AS appendix, concat_ws(' ', {_open_sql("line", "CHAPTER", "-")}, {_open_sql("line", "SECTION", "CHAPTER")}, {_open_sql("line", "ARTICLE", *_HIGHER)}, {_open_sql("line", "CLAUSE", "ARTICLE", *_HIGHER)}) AS parent_context FROM numbered WINDOW w AS ({W_ALL} ROWS UNBOUNDED PRECEDING)),
    t AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY page_number, reading_order) AS n FROM (SELECT * EXCLUDE (number), TRY_CAST(number AS BIGINT) AS number, doc_id || CASE WHEN appendix IS NOT NULL THEN '__phu-luc-' || appendix WHEN regexp_full_match(article, '[0-9]+') THEN '__dieu-' || article END AS parent_id FROM around WHERE kind = 'TABLE') WHERE parent_id IS NOT NULL),
    {_ordinal_sql("t")}"""


def _tabled(s: SparkSession, d: str) -> DataFrame:
    """The marked elements with tables, numbered or not, transitional parts, appendices and sections between them."""
    ro = F.col("reading_order")
    mark = (
        F.when((ro % 4 == 3) & (ro % 5 == 0), F.concat(F.lit("Bảng "), (ro % 3 + 1).cast("string"), F.lit(". "))).when((ro % 4 == 3) & (ro % 5 == 1), "Bảng 5: ").when(ro % 4 == 3, "")
        .when(ro % 48 == 30, "Chuyển tiếp ").when(ro % 64 == 37, "Phụ lục. ").when(ro % 80 == 56, "Mục 2. ").otherwise("")
    )
    kind = F.when(ro % 4 == 3, "table").otherwise("paragraph")
    return v.marked(s, d).withColumn("text", F.concat(mark, "text")).withColumn("element_type", kind).withColumn("top", F.lit(0.5)).withColumn("bottom", F.lit(0.5))


@query(f"WITH RECURSIVE {_TABLE_ROWS.strip()} SELECT parent_id || '__bang-' || ordinal AS provision_id, reading_order, sha256(line) AS content_hash, nullif(parent_context, '') AS parent_context FROM f JOIN t USING (parent_id, n)")
def table_provisions(s: SparkSession, d: str) -> DataFrame:
    """Tables as provisions: ids under their article or appendix, and the lines that enclose them."""
    built = st.provisions(st.contexts(st.nodes(_tabled(s, d))))
    return built.filter("kind = 'TABLE'").select("provision_id", "reading_order", "content_hash", "parent_context")


@query(
    f"""WITH RECURSIVE {_TABLE_ROWS.strip()}, points AS (SELECT *, row_number() OVER (PARTITION BY doc_id, point_run, label ORDER BY page_number, reading_order) AS nth FROM around WHERE kind = 'POINT'),
    own AS (SELECT doc_id, page_number, reading_order, line, kind, head, CASE WHEN kind = 'CLAUSE' THEN concat_ws(' ', head, article_line) ELSE head END AS context, doc_id || CASE kind WHEN 'ARTICLE' THEN '__dieu-' || number WHEN 'CLAUSE' THEN '__dieu-' || article || '__khoan-' || number WHEN 'APPENDIX' THEN '__phu-luc-' || number
      WHEN 'TRANSITIONAL' THEN '__chuyen-tiep-' || row_number() OVER (PARTITION BY doc_id, kind ORDER BY page_number, reading_order) END AS id FROM around WHERE kind IN ('APPENDIX', 'TRANSITIONAL') OR (kind IN ('ARTICLE', 'CLAUSE') AND coalesce(regexp_full_match(article, '[0-9]+'), false))),
    lettered AS (SELECT doc_id, page_number, reading_order, line, parent_context AS context, doc_id || '__dieu-' || article || '__khoan-' || clause || '__diem-' || CASE WHEN label = 'd)' AND nth = 2 THEN 'đ' ELSE label[1] END AS id FROM points WHERE regexp_full_match(article, '[0-9]+') AND clause IS NOT NULL)
    SELECT id AS provision_id, reading_order, sha256(line) AS content_hash, nullif(context, '') AS parent_context FROM own UNION ALL SELECT id, reading_order, sha256(line), nullif(context, '') FROM lettered QUALIFY row_number() OVER (PARTITION BY id ORDER BY page_number, reading_order) = 1
    UNION ALL SELECT parent_id || '__bang-' || ordinal, reading_order, sha256(line), nullif(parent_context, '') FROM f JOIN t USING (parent_id, n)"""
)
def provision_build(s: SparkSession, d: str) -> DataFrame:
    """Provisions of every kind with the lines that enclose them."""
    built = st.provisions(st.contexts(st.nodes(_tabled(s, d))))
    return built.select("provision_id", "reading_order", "content_hash", "parent_context")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE doc_id % 5 WHEN 4 THEN 'd)' WHEN 3 THEN NULL ELSE NULL END WHEN 1 THEN 'đ)' WHEN 2 THEN 'a)' END AS label FROM documents")
def canonical_labels(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    raw = F.when(i % 4 == 0, "d)").when(i % 4 == 1, "Điểm Đ) x").when(i % 4 == 2, "A）").otherwise("12")
    return v.documents(s, d).select("doc_id", point_label(raw, (i % 5).cast("int")).alias("label"))
