"""Stored parses as one nested document each (pages, elements, boxes), and back to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .temporal import latest

#: What an element row has beside its document and page.
ELEMENT = ("reading_order", "element_id", "element_type", "text", "box", "parent_element_id", "table_html")


def rebuilt(parses: DataFrame, elements: DataFrame, pages: DataFrame | None = None, element: tuple[str, ...] = ELEMENT) -> DataFrame:
    """The newest parse of each document as one row: its own columns and ``pages``.

    ``parses``: parse_id, document_id, completed_at and more; ``elements``: parse_id, page_number and ``element``. A page has
    page_number, text (its elements' texts that are not blank, one a line, null if there are none) and its elements, in
    reading order, then by id. Pages come in order; those of ``pages`` (parse_id, page_number) without elements are kept empty.
    A parse without elements has no pages.
    """
    newest = latest(parses, "document_id", "completed_at", "parse_id")
    held = elements.join(newest.select("parse_id"), "parse_id", "left_semi")
    items = F.array_sort(F.collect_list(F.struct(*element)))
    filled = held.groupBy("parse_id", "page_number").agg(items.alias("elements"))
    if pages is not None:
        known = pages.join(newest.select("parse_id"), "parse_id", "left_semi").select("parse_id", "page_number").distinct()
        filled = known.join(filled, ["parse_id", "page_number"], "full").withColumn("elements", F.coalesce("elements", F.array()))
    lines = F.filter(F.transform("elements", lambda e: e["text"]), lambda t: t.isNotNull() & (F.btrim(t, F.lit(" \t\n\r\x0b\x0c")) != ""))
    paged = filled.withColumn("text", F.nullif(F.array_join(lines, "\n"), F.lit("")))
    whole = paged.groupBy("parse_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text", "elements"))).alias("pages"))
    return newest.join(whole, "parse_id", "left").withColumn("pages", F.coalesce("pages", F.array()))


def flattened(documents: DataFrame) -> DataFrame:
    """Element rows of nested documents: parse_id, document_id, page_number, page_text and ``ELEMENT``."""
    pages = documents.select("parse_id", "document_id", F.explode("pages").alias("p"))
    rows = pages.select("parse_id", "document_id", "p.page_number", F.col("p.text").alias("page_text"), F.explode("p.elements").alias("e"))
    return rows.select("parse_id", "document_id", "page_number", "page_text", "e.*")


def violations(documents: DataFrame) -> DataFrame:
    """parse_id, rule, n of nested documents that break a rule: an element id on several places, an element with a page number
    of its own (``page_number`` in the element, if it has one) other than its page's, a parse that ended before it began."""
    pages = documents.select("parse_id", F.explode("pages").alias("p"))
    rows = pages.select("parse_id", F.col("p.page_number").alias("page"), F.explode("p.elements").alias("e"))
    broken = [rows.groupBy("parse_id", "e.element_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("parse_id", F.lit("repeated_id").alias("rule"))]
    if "page_number" in rows.schema["e"].dataType.fieldNames():
        broken.append(rows.filter(F.col("e.page_number") != F.col("page")).select("parse_id", F.lit("page_match").alias("rule")))
    if {"started_at", "completed_at"} <= set(documents.columns):
        broken.append(documents.filter(F.col("completed_at") < F.col("started_at")).select("parse_id", F.lit("time_order").alias("rule")))
    found = broken[0]
    for more in broken[1:]:
        found = found.unionByName(more)
    return found.groupBy("parse_id", "rule").agg(F.count("*").alias("n"))
