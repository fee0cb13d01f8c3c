"""Stored provision rows: records for the extractor, versions of documents, provenance, queues and constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Columns of a record that a stored row keeps as they are.
KEPT = ("provision_id", "document_version_id", "chapter", "section", "article", "clause", "point", "heading", "source_text", "retrieval_text", "parent_context", "status", "page_number", "source_element_ids", "content_hash", "version", "review_status", "node_kind")


def records(rows: DataFrame) -> DataFrame:
    """Extractor records of stored rows: dates as ISO text, no source ids as an empty list, short_point told anew.

    A point of three words or less is short. point_label, needs_review and ambiguity are not stored: null, false and null.
    """
    words = F.size(F.filter(F.split("source_text", r"(?U)\s+"), lambda x: x != ""))
    short = F.coalesce((F.col("node_kind") == "POINT") & (words <= 3), F.lit(False))
    ids = F.coalesce("source_element_ids", F.array().cast("array<string>"))
    held = rows.select(*[ids.alias(c) if c == "source_element_ids" else F.col(c) for c in KEPT], *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("effective_from", "effective_to")])
    return held.withColumns({"short_point": short, "point_label": F.lit(None).cast("string"), "needs_review": F.lit(False), "ambiguity": F.lit(None).cast("string")})


def document_provisions(provisions: DataFrame, versions: DataFrame, document: Column | None = None) -> DataFrame:
    """Provisions with the document of their version (document_id, version_label), of one document if given.

    ``versions``: document_version_id, document_id, version_label. A provision whose version is not known has no row.
    """
    v = versions.select("document_version_id", "document_id", "version_label")
    return provisions.join(v if document is None else v.filter(F.col("document_id") == document), "document_version_id")


def attributed(provisions: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Provenance records of provisions from several sources, and the provisions whose sources do not add up.

    ``provisions``: provision_id, source_element_ids; ``sources``: provision_id, source_version_id, role, element_id, page_number.
    The elements attributed must be exactly the provision's, each as often as it has it; else the provision is in the second
    result (provision_id, expected, attributed: sorted lists) and has no records.
    """
    lists = sources.groupBy("provision_id").agg(F.sort_array(F.collect_list("element_id")).alias("attributed"))
    none = F.array().cast("array<string>")
    own = provisions.select("provision_id", F.sort_array(F.coalesce("source_element_ids", none)).alias("expected"))
    told = own.join(lists, "provision_id", "left").withColumn("attributed", F.coalesce("attributed", none))
    good = told.filter(F.col("expected") == F.col("attributed")).select("provision_id")
    return sources.join(good, "provision_id", "left_semi"), told.filter(F.col("expected") != F.col("attributed"))


def provenance_coverage(provisions: DataFrame, *by: str) -> DataFrame:
    """Share of provisions with a source element and a page, for each ``by``; without any provisions one row of 0.0."""
    covered = (F.size(F.coalesce("source_element_ids", F.array().cast("array<string>"))) > 0) & F.col("page_number").isNotNull()
    share = F.coalesce(F.round(F.avg(covered.cast("double")), 6), F.lit(0.0)).alias("provenance_coverage")
    return provisions.groupBy(*by).agg(share, F.count("*").alias("n"))


def repeated_in_order(rows: DataFrame, key: str, group: str, *order: str) -> DataFrame:
    """group, ids: ids that several rows of a group have, in the order in which each was first seen."""
    seen = rows.groupBy(group, key).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n")).filter("n > 1")
    return seen.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("first", F.col(key).alias("id")))).alias("s")).select(group, F.col("s.id").alias("ids"))


def queued(items: DataFrame, most: int, status: str = "PENDING", *order: str) -> DataFrame:
    """The first ``most`` waiting items, oldest first, with their place from 1; a limit that is the feature."""
    first = items.filter(F.col("status") == status).orderBy(*(order or ("created_at", "item_id"))).limit(most)
    return first.withColumn("place", F.row_number().over(W.orderBy(*(order or ("created_at", "item_id")))))


def violations(rows: DataFrame, key: str, unique: dict[str, tuple[tuple[str, ...], Column | None]], checks: dict[str, Column], parents: dict[str, tuple[str, DataFrame, str]], apart: dict[str, tuple[str, str, str, Column]]) -> DataFrame:
    """One report of all constraints: constraint, key, of every row that breaks one.

    ``unique``: columns, and a condition where only some rows are meant; a null in a column equals nothing. ``checks``: a condition
    that must not be false (unknown is fine). ``parents``: column, table, its key; a null refers to nothing.
    ``apart``: (key column, begin, end, condition): of the rows meant, half-open intervals of one key must not overlap; a
    null end is open; of two that overlap the later one breaks it.
    """
    out = None

    def add(name: str, broken: DataFrame) -> None:
        nonlocal out
        found = broken.select(F.lit(name).alias("constraint"), F.col(key).cast("string").alias("key"))
        out = found if out is None else out.unionByName(found)

    for name, (columns, condition) in unique.items():
        meant = rows if condition is None else rows.filter(condition)
        whole = meant.dropna(subset=list(columns))
        # The first row of each key is right; keys that repeat are found by their sums before any row moves.
        again = whole.groupBy(*columns).agg(F.min(key).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
        add(name, whole.join(again, list(columns)).filter(F.col(key) != F.col("_first")))
    for name, condition in checks.items():
        add(name, rows.filter(~condition))
    for name, (column, table, parent) in parents.items():
        held = table.select(F.col(parent).alias("_parent")).distinct()
        add(name, rows.filter(F.col(column).isNotNull()).join(held, F.col(column) == F.col("_parent"), "left_anti"))
    for name, (column, begin, end, condition) in apart.items():
        far = F.to_date(F.lit("9999-12-31"))
        before = W.partitionBy(column).orderBy(begin, key).rowsBetween(W.unboundedPreceding, -1)
        meant = rows.filter(condition & F.col(column).isNotNull() & F.col(begin).isNotNull()).filter(F.coalesce(F.col(end), far) > F.col(begin))
        add(name, meant.withColumn("_reach", F.max(F.coalesce(end, far)).over(before)).filter(F.col(begin) < F.col("_reach")))
    return out
