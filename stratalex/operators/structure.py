"""Recognition of the hierarchy of legal texts: a sequential scan, told as windows and ordered folds.

A line is matched by the first rule that holds, in the order chapter, section, article, appendix, transitional part,
table, point, clause, list item, heading. Scopes are last values over windows; counters that an explicit number can
push forward are running maxima; only the labels of a run of points need a fold, within that run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from stratalex.functions.text import collapsed, folded, roman_value

# What each level looks like, and the letters of points.
POINT_LETTERS = "aăâbcdđeêghiklmnoôơpqrstuưvxy"
FALLBACK = "abcdđeghiklmnoôơpqrstuưvxy"
CHAPTER = r"(?iu)^Chương\s+([IVXLCDM]+|\d+)\s*[.:-]?\s*(.*)$"
SECTION = r"(?iu)^Mục\s+([IVXLCDM]+|\d+)\s*[.:-]?\s*(.*)$"
ARTICLE = r"(?iu)^Điều\s+(\d+[A-Za-z]?)\s*[.:-]?\s*(.*)$"
APPENDIX = r"(?iu)^Phụ\s+lục(?:\s+([IVXLCDM]+|\d+))?\s*[.:-]?\s*(.*)$"
TRANSITIONAL = r"(?iu)^(?:Điều\s+khoản\s+)?chuyển\s+tiếp(?![\p{L}\p{N}_])"
TABLE = r"(?iu)^Bảng\s+\d+"
POINT = rf"(?iu)^([{POINT_LETTERS}])\s*[)]\s*(.*)$"
CLAUSE = r"^(\d+)\s*[.]\s*(.*)$"
LEAD_INS = ("gồm:", "như sau:", "sau đây:")
CHROME = ("page_header", "page_footer", "header", "footer")


def without_chrome(elements: DataFrame) -> DataFrame:
    """Drop headers and footers, by type or as text that repeats at the edges of several pages, and blank lines; add line (collapsed text).

    The line is made before rows are dealt by document, and every later step finds its rows in place. It is exploded, as
    the filters that follow would otherwise be moved ahead of it and make it anew for every pattern they test.
    """
    lined = elements.withColumn("line", F.explode(F.array(collapsed(F.col("text"))))).repartition("doc_id")
    w = W.partitionBy("doc_id", folded(F.col("line")))
    edge = (F.col("top") <= 0.15) | (F.col("bottom") >= 0.85)
    repeated = F.coalesce(edge, F.lit(False)) & (F.count("*").over(w) > 1) & (F.min("page_number").over(w) < F.max("page_number").over(w))
    return lined.withColumn("_chrome", F.lower("element_type").isin(*CHROME) | repeated).filter(~F.col("_chrome") & (F.col("line") != "")).drop("_chrome")


def matched(elements: DataFrame) -> DataFrame:
    """Add kind of the explicit rules, number, label to rows with their line; list items and headings keep their type."""
    t = F.col("line")
    item, head = F.lower("element_type") == "list_item", F.lower("element_type").isin("heading", "title")
    kind = (
        F.when(t.rlike(CHAPTER), "CHAPTER").when(t.rlike(SECTION), "SECTION").when(t.rlike(ARTICLE), "ARTICLE").when(t.rlike(APPENDIX), "APPENDIX")
        .when(t.rlike(TRANSITIONAL), "TRANSITIONAL").when((F.lower("element_type") == "table") | t.rlike(TABLE), "TABLE").when(t.rlike(POINT), "POINT")
        .when(t.rlike(CLAUSE), "CLAUSE").when(item, "ITEM").when(head, "HEADING")
    )
    number = (
        F.when(F.col("kind") == "CHAPTER", F.regexp_extract(t, CHAPTER, 1)).when(F.col("kind") == "SECTION", F.regexp_extract(t, SECTION, 1))
        .when(F.col("kind") == "ARTICLE", F.regexp_extract(t, ARTICLE, 1)).when(F.col("kind") == "APPENDIX", F.regexp_extract(t, APPENDIX, 1))
        .when(F.col("kind") == "TABLE", F.regexp_extract(t, r"(\d+)", 1)).when(F.col("kind") == "CLAUSE", F.regexp_extract(t, CLAUSE, 1))
    )
    out = elements.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    return out.withColumn("number", F.nullif(number, F.lit(""))).withColumn("label", F.when(F.col("kind") == "POINT", F.concat(F.lower(F.regexp_extract(t, POINT, 1)), F.lit(")"))))


def _order() -> W:
    return W.partitionBy("doc_id").orderBy("page_number", "reading_order")


def scopes(nodes: DataFrame) -> DataFrame:
    """Add the scope that holds after each row: chapter, section, article, in_article, in_clause and runs.

    A row of a kind that resets a scope writes an empty value, so the last value that is not null is the scope.
    """
    w = _order().rowsBetween(W.unboundedPreceding, W.currentRow)

    def last(kind: str, *resets: str) -> Column:
        mark = F.when(F.col("kind") == kind, F.coalesce("number", F.lit("?"))).when(F.col("kind").isin(*resets), F.lit(""))
        return F.nullif(F.last(mark, ignorenulls=True).over(w), F.lit(""))

    out = nodes.withColumn("chapter", last("CHAPTER")).withColumn("section", last("SECTION", "CHAPTER"))
    out = out.withColumn("article", last("ARTICLE", "CHAPTER", "SECTION", "APPENDIX"))
    out = out.withColumn("appendix", last("APPENDIX", "CHAPTER", "SECTION", "ARTICLE"))
    reset = F.col("kind").isin("CHAPTER", "SECTION", "ARTICLE")
    return out.withColumn("article_run", F.sum(reset.cast("int")).over(w)).withColumn("scope_run", F.sum((reset | (F.col("kind") == "APPENDIX")).cast("int")).over(w))


def list_items(nodes: DataFrame) -> DataFrame:
    """Resolve list items inside an article: a clause if none is open or a lead-in ends the text, else a point.

    The first item of an article's scope opens a clause, so a clause is open from the scope's first clause or item on.
    Scopes are numbered upwards, so the last one with a clause or item is the largest.
    """
    before = _order().rowsBetween(W.unboundedPreceding, -1)
    opened = F.coalesce(F.max(F.when(F.col("kind").isin("CLAUSE", "ITEM"), F.col("scope_run"))).over(before) == F.col("scope_run"), F.lit(False))
    lead, low = F.lit(False), F.lower("line")
    for ending in LEAD_INS:
        lead = lead | low.endswith(ending)
    usable = nodes.filter((F.col("kind") != "ITEM") | F.col("article").isNotNull())
    out = usable.withColumn("_opened", opened).withColumn("rebuilt", F.col("kind") == "ITEM")
    kind = F.when(~F.col("rebuilt"), F.col("kind")).when(~F.col("_opened") | lead, "CLAUSE").otherwise("POINT")
    return out.withColumn("kind", kind).drop("_opened")


def clause_numbers(nodes: DataFrame) -> DataFrame:
    """Number the clauses that lost their marker: one more than the largest number so far in the article's run.

    With k rebuilt clauses so far and explicit numbers n, the counter is k + max(0, n - k at n): a running maximum. All
    windows are those of the document, so rows are sorted once: k counts from the document's start, less what stood before
    the run, and as runs are numbered upwards, the maximum with the run before it is the run's own.
    """
    w = _order().rowsBetween(W.unboundedPreceding, W.currentRow)
    rebuilt = F.col("rebuilt") & (F.col("kind") == "CLAUSE")
    out = nodes.withColumn("_k", F.sum(rebuilt.cast("long")).over(w))
    explicit = F.when((F.col("kind") == "CLAUSE") & ~F.col("rebuilt"), F.col("number").try_cast("long") - F.col("_k"))
    most = F.max(F.when(explicit.isNotNull(), F.struct(F.col("article_run").alias("run"), explicit.alias("n")))).over(w)
    before = F.coalesce(F.last(F.when(F.col("kind").isin("CHAPTER", "SECTION", "ARTICLE"), F.col("_k")), ignorenulls=True).over(w), F.lit(0))
    out = out.withColumns({"_most": most, "_before": before})
    ahead = F.when(F.col("_most.run") == F.col("article_run"), F.col("_most.n") + F.col("_before"))
    n = (F.col("_k") - F.col("_before") + F.greatest(F.lit(0), F.coalesce(ahead, F.lit(0)))).cast("long")
    return out.withColumn("number", F.when(rebuilt, n.cast("string")).otherwise(F.col("number"))).drop("_k", "_most", "_before")


def appendix_numbers(nodes: DataFrame) -> DataFrame:
    """Arabic numbers of appendices; one without a number follows the largest so far in its document."""
    w = _order().rowsBetween(W.unboundedPreceding, W.currentRow)
    is_appendix = F.col("kind") == "APPENDIX"
    given = F.coalesce(F.col("number").try_cast("long"), roman_value(F.col("number")).cast("long"))
    out = nodes.withColumn("_given", F.when(is_appendix, given)).withColumn("_k", F.sum((is_appendix & F.col("number").isNull()).cast("long")).over(w))
    auto = F.col("_k") + F.greatest(F.lit(0), F.coalesce(F.max(F.col("_given") - F.col("_k")).over(w), F.lit(0)))
    return out.withColumn("_auto", auto).withColumn("number", F.when(is_appendix, F.coalesce("_given", "_auto").cast("string")).otherwise(F.col("number"))).drop("_given", "_k", "_auto")


def running_numbers(nodes: DataFrame) -> DataFrame:
    """Numbers of headings and transitional parts: their place in the document."""
    w = _order().rowsBetween(W.unboundedPreceding, W.currentRow)
    place = {k: F.count(F.when(F.col("kind") == k, 1)).over(w).cast("string") for k in ("HEADING", "TRANSITIONAL")}
    number = F.when(F.col("kind") == "HEADING", place["HEADING"]).when(F.col("kind") == "TRANSITIONAL", place["TRANSITIONAL"])
    return nodes.withColumn("number", number.otherwise(F.col("number")))


# Remarks on repaired points.
LOST, MISREAD, AGAIN = "point label reconstructed from marker-stripped list item", "OCR d/đ ambiguity normalized from duplicate d)", "duplicate d) point label"


def next_label(label: str | None, given: set[str]) -> tuple[str, str | None]:
    """(label, remark) of the next point of a run whose points so far have the labels ``given``."""
    if label is None:
        return next((f"{x})" for x in FALLBACK if f"{x})" not in given), "a)"), LOST
    if label == "d)" and "d)" in given:
        return (label, AGAIN) if "đ)" in given else ("đ)", MISREAD)
    return label, None


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document and place, with the labels repaired and ``remark``; state: the labels of one run."""
    run, given = None, set()
    for batch in batches:
        labels, remarks = batch.column("label").to_pylist(), [None] * batch.num_rows
        for i, (doc, number, kind) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "point_run", "kind")))):
            if (doc, number) != run:
                run, given = (doc, number), set()
            if kind == "POINT":
                labels[i], remarks[i] = next_label(labels[i], given)
                given.add(labels[i])
        place = batch.schema.get_field_index("label")
        yield batch.set_column(place, "label", pa.array(labels, pa.string())).append_column("remark", pa.array(remarks, pa.string()))


def point_labels(nodes: DataFrame) -> DataFrame:
    """Labels of the points of each run: lost ones get the first unused letter, a second ``d)`` becomes ``đ)``.

    A run is what lies between clauses and higher marks. The window that numbers the runs leaves each document whole and in
    order in one partition, and one pass over that stream repairs its points; the state is a run's few letters.
    """
    w = _order().rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = F.col("kind").isin("CHAPTER", "SECTION", "ARTICLE", "CLAUSE", "APPENDIX")
    runs = nodes.withColumn("point_run", F.sum(ends.cast("int")).over(w)).sortWithinPartitions("doc_id", "page_number", "reading_order")
    return runs.mapInArrow(_labelled, T.StructType([*runs.schema.fields, T.StructField("remark", T.StringType())]))


def nodes(elements: DataFrame) -> DataFrame:
    """Structure nodes of ``elements`` (doc_id, page_number, reading_order, element_type, text, top, bottom).

    kind, number, label, line (for text), scopes, needs_review and ambiguity; the first remark that applies is given.
    Labels come last: behind them Spark no longer knows that rows lie by document.
    """
    found = running_numbers(clause_numbers(appendix_numbers(list_items(scopes(matched(without_chrome(elements).drop("text")))))))
    w = _order().rowsBetween(W.unboundedPreceding, W.currentRow)
    k = F.col("kind")
    last = F.last(F.when((k == "CLAUSE") & F.col("number").isNotNull(), F.struct(F.col("scope_run").alias("run"), F.col("number").alias("n"))), ignorenulls=True).over(w)
    clause = F.when((F.col("article").isNotNull() | (k == "CLAUSE")) & (F.col("_last.run") == F.col("scope_run")), F.col("_last.n"))
    found = point_labels(found.withColumn("_last", last).withColumn("clause", F.when(k.isin("CLAUSE", "POINT", "TABLE"), clause)).drop("_last"))
    ambiguity = (
        F.when((k == "ARTICLE") & ~F.col("number").rlike(r"^\d+$"), "non-numeric article suffix")
        .when((k == "CLAUSE") & F.col("article").isNull(), "orphan clause without article")
        .when((k == "CLAUSE") & F.col("rebuilt"), "clause number reconstructed from marker-stripped list item")
        .when((k == "POINT") & F.col("remark").isNotNull(), F.col("remark"))
        .when((k == "POINT") & (F.col("article").isNull() | F.col("clause").isNull()), "orphan point without article/clause")
        .when((k == "TABLE") & F.col("article").isNull() & F.col("appendix").isNull(), "table without article or appendix")
    )
    return found.withColumn("ambiguity", ambiguity).withColumn("needs_review", F.col("ambiguity").isNotNull())


def contexts(found: DataFrame) -> DataFrame:
    """Add parent_context: the lines of the open chapter, section, article and clause, as far as they enclose a node's kind.

    A transitional part or an appendix closes the article; a heading stands in what is open around it.
    """
    w = _order().rowsBetween(W.unboundedPreceding, W.currentRow)
    higher, k = ("CHAPTER", "SECTION", "APPENDIX", "TRANSITIONAL"), F.col("kind")

    def open_line(kind: str, *resets: str) -> Column:
        return F.nullif(F.last(F.when(k == kind, F.col("line")).when(k.isin(*resets), F.lit("")), ignorenulls=True).over(w), F.lit(""))

    chapter, section = open_line("CHAPTER"), open_line("SECTION", "CHAPTER")
    article, clause = open_line("ARTICLE", *higher), open_line("CLAUSE", "ARTICLE", *higher)
    inner = k.isin("POINT", "TABLE", "HEADING")
    lines = F.concat_ws(" ", chapter, section, F.when(inner | (k == "CLAUSE"), article), F.when(inner, clause))
    return found.withColumn("parent_context", F.when(~k.isin("CHAPTER", "SECTION"), F.nullif(lines, F.lit(""))))


def provisions(found: DataFrame) -> DataFrame:
    """Provisions with stable ids from nodes: articles, clauses, points, appendices, tables, transitional parts, headings.

    Dropped: what has no open article with a plain number around it (a table: nor an appendix), articles without
    a plain number, and points whose id has been given. A transitional part closes the article before it. A table's id
    ends in its ordinal under its article or appendix.
    """
    k, doc = F.col("kind"), F.col("doc_id").cast("string")
    w = _order().rowsBetween(W.unboundedPreceding, W.currentRow)
    level = F.when(k.isin("CHAPTER", "SECTION", "ARTICLE", "APPENDIX", "TRANSITIONAL"), k)
    closed = F.coalesce(F.last(level, ignorenulls=True).over(w) == "TRANSITIONAL", F.lit(False))
    # The appendix by its Arabic number: what the scan gave it where it has none of its own.
    appendix = F.last(F.when(k == "APPENDIX", F.col("number")).when(k.isin("CHAPTER", "SECTION", "ARTICLE", "TRANSITIONAL"), F.lit("")), ignorenulls=True).over(w)
    found = found.withColumn("_closed", closed).withColumn("_appendix", F.nullif(appendix, F.lit("")))
    article = F.concat(doc, F.lit("__dieu-"), F.col("article"))
    letter = F.translate(F.substring("label", 1, 1), "ăâêôơư", "aaeoou")
    pid = (
        F.when(k == "ARTICLE", article).when(k == "CLAUSE", F.concat(article, F.lit("__khoan-"), F.col("number")))
        .when(k == "POINT", F.concat(article, F.lit("__khoan-"), F.col("clause"), F.lit("__diem-"), letter)).when(k == "APPENDIX", F.concat(doc, F.lit("__phu-luc-"), F.col("number")))
        .when(k == "TRANSITIONAL", F.concat(doc, F.lit("__chuyen-tiep-"), F.col("number"))).when(k == "HEADING", F.concat(doc, F.lit("__tieu-de-"), F.col("number")))
        .when(k == "TABLE", F.coalesce(F.concat(doc, F.lit("__phu-luc-"), F.col("_appendix")), article))
    )
    good = found.filter(k.isin("ARTICLE", "CLAUSE", "POINT", "APPENDIX", "TABLE", "TRANSITIONAL", "HEADING")).withColumn("provision_id", pid)
    plain = F.coalesce(F.col("article").rlike(r"^\d+$"), F.lit(False))
    under = (plain | ((k == "TABLE") & F.col("_appendix").isNotNull())) & ((k == "ARTICLE") | ~F.col("_closed"))
    good = good.filter(F.col("provision_id").isNotNull() & F.when(k.isin("ARTICLE", "CLAUSE", "POINT", "TABLE"), under).otherwise(True)).drop("_closed", "_appendix")
    # One pass over each document's rows in order numbers the tables and finds the ids given before.
    good = good.withColumn("_number", _asked(F.col("number"))).repartition("doc_id").sortWithinPartitions("doc_id", "page_number", "reading_order")
    filed = good.mapInArrow(_filed, T.StructType([*good.schema.fields, T.StructField("_ordinal", T.LongType()), T.StructField("_again", T.BooleanType())]))
    pid = F.when(k == "TABLE", F.concat("provision_id", F.lit("__bang-"), F.col("_ordinal").cast("string"))).otherwise(F.col("provision_id"))
    filed = filed.filter(~F.col("_again")).withColumn("provision_id", pid).drop("_number", "_ordinal", "_again")
    return filed.withColumn("content_hash", F.sha2("line", 256)).withColumn("short_point", (k == "POINT") & (F.size(F.split("line", " ")) <= 3))


def _asked(number: Column) -> Column:
    """The number that a table asks for: digits alone."""
    return F.when(number.cast("string").rlike(r"^\d+$"), number.try_cast("long"))


def next_free(used: dict[int, int], wanted: int) -> int:
    """The least number from ``wanted`` on that is not used, which then is. ``used`` leads from each used number towards a free one."""
    free = wanted
    while free in used:
        free = used[free]
    while wanted != free:  # every number on the way now leads straight there
        used[wanted], wanted = free, used[wanted]
    used[free] = free + 1
    return free


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their documents, with the ordinal of tables under their id and whether a point's id has been given; state: one document."""
    held, tables, points = object(), {}, set()
    for batch in batches:
        ordinals, again = [None] * batch.num_rows, [False] * batch.num_rows
        for i, (doc, kind, pid, number) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "kind", "provision_id", "_number")))):
            if doc != held:
                held, tables, points = doc, {}, set()
            if kind == "TABLE":
                last, used = tables.get(pid) or (0, {})
                ordinals[i] = next_free(used, last + 1 if number is None or number < 0 else number)
                tables[pid] = ordinals[i], used
            elif kind == "POINT":
                again[i] = pid in points
                points.add(pid)
        yield batch.append_column("_ordinal", pa.array(ordinals, pa.int64())).append_column("_again", pa.array(again, pa.bool_()))


def _ordinals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (parent, number, ...) sorted by parent and order, with ``ordinal``; state: the used numbers of one parent."""
    held, last, used = object(), 0, {}
    for batch in batches:
        ordinals = []
        for parent, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if parent != held:
                held, last, used = parent, 0, {}
            last = next_free(used, last + 1 if number is None or number < 0 else number)
            ordinals.append(last)
        yield batch.append_column("ordinal", pa.array(ordinals, pa.int64()))


def table_ordinals(tables: DataFrame, parent: str = "parent_id", order: tuple[str, ...] = ("reading_order",)) -> DataFrame:
    """``tables`` with ``ordinal``: each table's number under its parent, in order.

    A table that asks for a number (``number``, digits) gets it, one that does not the number after the last given; where that is
    taken, the next free one. Partitions are sorted streams and a used number leads straight to the next free one, so a
    parent of many tables costs little more than its sort.
    """
    rows = tables.select(F.col(parent).alias("_parent"), _asked(F.col("number")).alias("_number"), *tables.columns)
    rows = rows.repartition("_parent").sortWithinPartitions("_parent", *order)
    schema = T.StructType([*rows.schema.fields, T.StructField("ordinal", T.LongType())])
    return rows.mapInArrow(_ordinals, schema).drop("_parent", "_number")
