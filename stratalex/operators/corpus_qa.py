"""Corpus report and cross-references."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Pieces of a reference and its four forms, the most specific first. Case does not count.
_POINT = r"(?:Điểm\s*[a-zđ](?=\s|\))\s+)?"
_CLAUSE = r"(?:Khoản\s*\d+\s+)?"
_ONE = r"(?:Điều\s*\d+|Khoản\s*\d+|Điểm\s*[a-zđ](?=\s|\)))"
_DOC = r"(?:\s+(?:của\s+)?(?:nghị\s+định|luật|thông\s+tư|nghị\s+quyết|quyết\s+định)\s*(?:số\s+)?\d+(?:/\d+)*(?:/[a-zđ]+(?:-[a-z]+)*)?)?"
FORMS = (
    rf"theo\s+quy\s+định\s+tại\s+{_POINT}{_CLAUSE}{_ONE}{_DOC}",
    rf"quy\s+định\s+tại\s+{_POINT}{_CLAUSE}{_ONE}{_DOC}",
    rf"theo\s+{_POINT}{_CLAUSE}{_ONE}{_DOC}",
    rf"{_POINT}Khoản\s*\d+\s+Điều\s*\d+{_DOC}",
)
# Document kinds in ids.
DOC_KINDS = {"nghị định": "nd", "luật": "luat", "thông tư": "tt", "nghị quyết": "nq", "quyết định": "qd"}


def chosen(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans from the left, of those that begin at one place the longest, none overlapping one before it."""
    out, last = [], -1
    for begin, end in sorted(spans, key=lambda s: (s[0], -s[1])):
        if begin >= last:
            out.append((begin, end))
            last = end
    return out


def _spans(patterns: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = [re.compile(p, re.IGNORECASE) for p in patterns]
        for batch in batches:
            found = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                every = [m.span() for form in forms for m in form.finditer(text or "")]
                found += [(i, place, begin, end, text[begin:end]) for place, (begin, end) in enumerate(chosen(every))]
            at, place, begin, end, raw = zip(*found) if found else ((),) * 5
            columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int32()) for x in (place, begin, end)), pa.array(raw, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["_key", "place", "begin", "end", "raw"])

    return run


def spans(rows: DataFrame, key: str, text: str, patterns: tuple[str, ...] = FORMS) -> DataFrame:
    """key, place, begin, end, raw of what ``patterns`` find in whole texts.

    Each pattern is matched from the left on its own; of all matches the leftmost are taken, of one beginning the longest,
    and what begins inside one taken is left out. A null text has none.
    """
    kind = rows.schema[key].dataType.simpleString()
    found = rows.select(key, text).mapInArrow(_spans(patterns), f"_key {kind}, place int, begin int, end int, raw string")
    return found.withColumnRenamed("_key", key)


def references(rows: DataFrame, key: str, text: str, patterns: tuple[str, ...] = FORMS) -> DataFrame:
    """key, place, citation, article, clause, point, doc_kind, doc_number, doc_year of every reference in the texts: the ``spans`` of ``patterns``."""
    found = spans(rows, key, text, patterns)
    c = F.trim(F.regexp_replace("raw", r"\s+", " "))
    part = lambda p: F.nullif(F.regexp_extract("citation", p, 1), F.lit(""))
    kind = F.lower(part(r"(?iu)(nghị định|luật|thông tư|nghị quyết|quyết định)\s*(?:số )?\d+"))
    pairs = [F.lit(x) for pair in DOC_KINDS.items() for x in pair]
    return found.select(key, "place", c.alias("citation")).select(
        key, "place", "citation", part(r"(?iu)Điều\s*(\d+)").alias("article"), part(r"(?iu)Khoản\s*(\d+)").alias("clause"), F.lower(part(r"(?iu)Điểm\s*([a-zđ])(?=\s|\))")).alias("point"),
        F.create_map(*pairs)[kind].alias("doc_kind"), part(r"(?iu)(?:nghị định|luật|thông tư|nghị quyết|quyết định)\s*(?:số )?(\d+)").alias("doc_number"),
        part(r"(?iu)(?:nghị định|luật|thông tư|nghị quyết|quyết định)\s*(?:số )?\d+/(\d{4})").alias("doc_year"),
    )


def resolved(found: DataFrame, ids: DataFrame, own_doc: Column) -> DataFrame:
    """Add target_id: the provision that a reference names, in the document it names or its own; null if there is none."""
    doc = F.when(F.col("doc_kind").isNotNull(), F.concat_ws("-", "doc_kind", "doc_number", "doc_year")).otherwise(own_doc)
    key = F.concat(doc, F.lit("__dieu-"), F.col("article"), F.coalesce(F.concat(F.lit("__khoan-"), F.col("clause")), F.lit("")), F.coalesce(F.concat(F.lit("__diem-"), F.col("point")), F.lit("")))
    return found.withColumn("_key", key).join(ids.select(F.col("provision_id").alias("target_id")).distinct(), F.col("_key") == F.col("target_id"), "left").drop("_key")


def relations(provisions: DataFrame) -> DataFrame:
    """source_id, relation, target_id of the tree: PARENT_OF from articles to clauses to points, SIBLING_OF to the next of one parent.

    Siblings are linked in order, each to the next, so a parent of many is no square of links.
    """
    own = provisions.filter(F.col("kind").isin("ARTICLE", "CLAUSE", "POINT")).groupBy("doc_id", "provision_id").agg(F.min(F.struct("page_number", "reading_order")).alias("at"))
    own = own.withColumn("parent_id", F.regexp_replace("provision_id", r"__(diem|khoan|dieu)-[^_]+$", ""))
    held = own.select(F.col("doc_id").alias("_doc"), F.col("provision_id").alias("_id"))
    parents = own.join(held, (F.col("doc_id") == F.col("_doc")) & (F.col("parent_id") == F.col("_id"))).select(F.col("parent_id").alias("source_id"), F.lit("PARENT_OF").alias("relation"), F.col("provision_id").alias("target_id"))
    following = F.lead("provision_id").over(W.partitionBy("doc_id", "parent_id").orderBy("at", "provision_id"))
    return parents.unionByName(own.select(F.col("provision_id").alias("source_id"), F.lit("SIBLING_OF").alias("relation"), following.alias("target_id")).filter("target_id is not null"))


def report(p: DataFrame, expected_points: int = 0, expected_tables: int = 0, unresolved: DataFrame | None = None) -> DataFrame:
    """The corpus's 16 metrics in one row; rates over nothing are 0.0."""
    n = lambda test: F.sum(test.cast("long"))
    rate = lambda a, b: F.coalesce(F.round(F.when(b > 0, a / b), 6), F.lit(0.0))
    k = F.col("node_kind")
    short = F.col("short_point")
    ids = p.groupBy("provision_id").agg(F.count("*").alias("c"))
    twice = ids.agg(F.coalesce(F.sum(F.when(F.col("c") > 1, 1)), F.lit(0)).alias("duplicate_provision_count"))
    parents = p.filter(k.isin("ARTICLE", "CLAUSE")).select(F.col("provision_id").alias("parent_id")).distinct()
    orphans = p.filter(k.isin("POINT", "CLAUSE")).join(parents, "parent_id", "left_anti").agg(n(k == "POINT").alias("op"), n(k == "CLAUSE").alias("oc")).select(F.coalesce("op", F.lit(0)).alias("orphan_point_count"), F.coalesce("oc", F.lit(0)).alias("orphan_clause_count"))
    lost = (unresolved.agg(F.count("*").alias("unresolved_cross_reference_count")) if unresolved is not None else p.limit(0).agg(F.count("*").alias("unresolved_cross_reference_count")))
    main = p.agg(
        F.countDistinct("document_id").alias("document_count"), n(k == "ARTICLE").alias("article_count"), n(k == "CLAUSE").alias("clause_count"), n(k == "POINT").alias("point_count"),
        rate(n(k == "POINT"), F.lit(expected_points)).alias("point_coverage"), rate(n(short & F.col("review_status").isin("PENDING", "ACCEPTED")), n(short)).alias("short_point_retention"),
        rate(n(F.col("label").isin("d)", "đ)") & F.col("label_good")), n(F.col("label").isin("d)", "đ)"))).alias("d_point_detection_rate"),
        rate(n(F.coalesce(F.trim("parent_context"), F.lit("")) != ""), F.count("*")).alias("parent_context_coverage"), rate(n(F.size("source_ids") > 0), F.count("*")).alias("provenance_coverage"),
        rate(n(k == "TABLE"), F.lit(expected_tables)).alias("table_coverage"), n(F.col("effective_from").isNull()).alias("unknown_effective_date_count"),
        n(F.coalesce(F.col("effective_to") < F.col("effective_from"), F.lit(False))).alias("temporal_conflict_count"),
    )
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(main).join(one(twice), "_one").join(one(orphans), "_one").join(one(lost), "_one").drop("_one")
