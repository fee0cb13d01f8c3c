"""Layout elements: lines or content lists to elements, pages back from elements, and their invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalex.functions.text import escaped

# Labels of the two parsers and the element types they become.
LAYOUT_TYPES = {
    "section_header": "heading", "title": "title", "text": "paragraph", "paragraph": "paragraph", "list_item": "list_item", "table": "table",
    "page_header": "page_header", "page_footer": "page_footer", "picture": "figure", "caption": "caption", "footnote": "footnote", "formula": "formula",
}
CONTENT_TYPES = {"text": "paragraph", "title": "title", "list": "list_item", "table": "table", "image": "figure", "equation": "formula", "header": "page_header", "footer": "page_footer"}
CYCLE = ("paragraph", "list_item", "heading", "table", "page_header")


def mapped(label: Column, types: dict[str, str]) -> Column:
    """Element type of a parser's label; unknown labels pass through."""
    pairs = [F.lit(x) for pair in types.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[label], label)


def unit_box(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """Page points to the unit square; null where a page dimension is missing."""
    inside = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    box = F.struct(inside(left / width).alias("left"), inside(top / height).alias("top"), inside(right / width).alias("right"), inside(bottom / height).alias("bottom"))
    return F.when(width.isNotNull() & height.isNotNull() & (width > 0) & (height > 0), box)


def content_list(raw: DataFrame) -> DataFrame:
    """Elements of a parser's content list: document_id, items array of (type, text, text_level, page_idx, bbox permille, ...)."""
    rows = raw.select("document_id", F.posexplode("items").alias("reading_order", "item"))
    kind = F.when((F.col("item.type") == "text") & (F.coalesce(F.col("item.text_level"), F.lit(0)) > 0), "heading").otherwise(mapped(F.col("item.type"), CONTENT_TYPES))
    box = F.transform(F.col("item.bbox"), lambda x: x / 1000.0)
    return rows.select("document_id", kind.alias("element_type"), F.col("item.text").alias("text"), (F.col("item.page_idx") + 1).alias("page_number"), "reading_order", box.alias("bbox"))


def html_table(cells: Column) -> Column:
    """Rows of cells as an HTML table, text escaped."""
    row = lambda r: F.concat(F.lit("<tr>"), F.concat_ws("", F.transform(r, lambda c: F.concat(F.lit("<td>"), escaped(c), F.lit("</td>")))), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), F.concat_ws("", F.transform(cells, row)), F.lit("</table>"))


def item_table(kind: Column, html: Column, body: Column, cells: Column, tables: tuple[str, ...] = ("table",)) -> Column:
    """HTML of a table item: its own, else its body, else its cells; blank ones give way, and what is no table has none."""
    said = lambda c: F.when(F.btrim(c, F.lit(" \t\n\r\x0b\x0c")) != "", c)
    return F.when(F.lower(kind).isin(*tables), F.coalesce(said(html), said(body), F.when(F.size(cells) > 0, html_table(cells))))


def from_lines(docs: DataFrame, key: str = "doc_id", per_page: int = 4) -> DataFrame:
    """One element for each line: page, reading_order, type and box by the line's place."""
    rows = docs.select(F.col(key).alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("reading_order", "text"))
    kinds = F.element_at(F.array(*[F.lit(x) for x in CYCLE]), F.col("reading_order") % len(CYCLE) + 1)
    top = (F.col("reading_order") % per_page) / F.lit(float(per_page))
    return rows.select(
        "doc_id", F.expr(f"cast(reading_order div {per_page} as int) + 1").alias("page_number"), "reading_order", kinds.alias("element_type"), "text",
        F.lit(0.1).alias("left"), top.alias("top"), F.lit(0.9).alias("right"), (top + 1.0 / per_page).alias("bottom"),
    )


def page_texts(elements: DataFrame) -> DataFrame:
    """Page text: element texts that are not blank, in order, a line each."""
    full = F.expr("concat_ws('\n', transform(array_sort(collect_list(if(trim(text) = '', null, struct(reading_order, text)))), x -> x.text))")
    return elements.groupBy("doc_id", "page_number").agg(full.alias("page_text"))


def violations(elements: DataFrame) -> DataFrame:
    """doc_id, rule, n of broken invariants: repeated ids, boxes outside the unit square, negative order, page below 1."""
    box = F.col("left").isNotNull() & ((F.col("left") < 0) | (F.col("top") < 0) | (F.col("right") > 1) | (F.col("bottom") > 1) | (F.col("right") < F.col("left")) | (F.col("bottom") < F.col("top")))
    twice = F.count("*").over(W.partitionBy("doc_id", "element_id")) > 1
    rules = {"box": box, "order": F.col("reading_order") < 0, "page": F.col("page_number") < 1, "repeated_id": twice}
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return elements.select("doc_id", broken.alias("rules")).select("doc_id", F.explode("rules").alias("rule")).groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


def histogram(elements: DataFrame) -> DataFrame:
    return elements.groupBy("element_type").agg(F.count("*").alias("n"))


def latest_parse(parses: DataFrame) -> DataFrame:
    """The newest parse of each document, by start time, then id."""
    place = F.row_number().over(W.partitionBy("document_id").orderBy(F.desc("parse_started_at"), F.desc("parsed_document_id")))
    return parses.withColumn("_n", place).filter("_n = 1").drop("_n")
