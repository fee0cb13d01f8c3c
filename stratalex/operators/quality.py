"""Layout metrics, gates, hierarchy checks, review routing and document decisions."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalex.functions.text import canonical_json, leaked_header, point_label


def extraction_metrics(elements: DataFrame, pages: DataFrame, expected_tables: DataFrame | None = None) -> DataFrame:
    """doc_id, provenance_coverage, text_extraction_rate, table_detection_rate; null where nothing is to be counted."""
    per = elements.groupBy("doc_id").agg(F.avg(F.col("left").isNotNull().cast("double")).alias("provenance_coverage"), F.sum((F.col("element_type") == "table").cast("int")).alias("tables"))
    text = pages.groupBy("doc_id").agg(F.avg((F.coalesce(F.trim("page_text"), F.lit("")) != "").cast("double")).alias("text_extraction_rate"))
    out = per.join(text, "doc_id", "full")
    out = out.join(expected_tables, "doc_id", "left") if expected_tables is not None else out.withColumn("expected", F.lit(None).cast("int"))
    rate = F.when(F.col("expected") > 0, F.coalesce("tables", F.lit(0)) / F.col("expected"))
    return out.select("doc_id", F.round("provenance_coverage", 6).alias("provenance_coverage"), F.round("text_extraction_rate", 6).alias("text_extraction_rate"), F.round(rate, 6).alias("table_detection_rate"))


def order_pairs(placed: list[tuple[int, tuple]]) -> tuple[int, int]:
    """(pairs, agreeing pairs) of (order, place) rows in ascending order: pairs that differ in both, each row held against the places before it, sorted."""
    before: list[tuple] = []
    pairs = agree = at = 0
    while at < len(placed):
        end = at
        while end < len(placed) and placed[end][0] == placed[at][0]:
            end += 1
        for _, place in placed[at:end]:
            lower, upper = bisect_left(before, place), bisect_right(before, place)
            pairs, agree = pairs + len(before) - (upper - lower), agree + lower
        for _, place in placed[at:end]:
            insort(before, place)
        at = end
    return pairs, agree


def _page_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page of a document, order, top, left) sorted by page, then order: the share of agreeing pairs of each page; state: one page."""
    page, placed = None, []

    def scored() -> tuple:
        pairs, agree = order_pairs(placed)
        return page["doc_id"], agree / pairs if pairs else 1.0

    for batch in batches:
        out = []
        for key, order, top, left in zip(*(c.to_pylist() for c in batch.columns)):
            if key != page:
                if placed:
                    out.append(scored())
                page, placed = key, []
            placed.append((order, (top, float("-inf") if left is None else left)))
        yield _scores(out, batch.schema.field(0).type.field("doc_id").type)
    if placed:
        yield _scores([scored()], batch.schema.field(0).type.field("doc_id").type)


def _scores(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.float64())], names=["doc_id", "score"])


def layout_coherence(elements: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Share of comparable element pairs of a page whose reading order agrees with (top, left) order; the mean over pages.

    Pairs with equal boxes (to two places) or equal orders say nothing and are left out; a page without comparable
    pairs scores 1. Of ``documents``, those without elements score 1, those whose elements have no boxes null; without
    ``documents``, documents without boxes have no row. Pages are sorted streams, counted in n log n.
    """
    page = F.struct("doc_id", "page_number").alias("page")
    rows = elements.filter("top is not null and reading_order is not null").select(page, "reading_order", F.round("top", 2).cast("double").alias("top"), F.round("left", 2).cast("double").alias("left"))
    kind = elements.schema["doc_id"].dataType.simpleString()
    scores = rows.repartition("page").sortWithinPartitions("page", "reading_order").mapInArrow(_page_scores, f"doc_id {kind}, score double")
    out = scores.groupBy("doc_id").agg(F.round(F.avg("score"), 6).alias("layout_coherence"))
    if documents is None:
        return out
    held = elements.select("doc_id").distinct().withColumn("_held", F.lit(True))
    every = documents.select("doc_id").distinct().join(held, "doc_id", "left").join(out, "doc_id", "left")
    return every.select("doc_id", F.when(F.col("_held").isNull(), 1.0).otherwise(F.col("layout_coherence")).alias("layout_coherence"))


def table_preservation(elements: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id, status, preserved, tables, table_preservation: the share of found tables that keep their HTML.

    ``expected``: doc_id, expected (tables that the gold annotation holds, or null). ``na`` where the gold tells of no tables or
    the parser found none: there is nothing to preserve, and no percentage is made up.
    """
    kept = (F.coalesce(F.btrim("table_html", F.lit(" \t\n\r\x0b\x0c")), F.lit("")) != "").cast("long")
    found = elements.filter("element_type = 'table'").groupBy("doc_id").agg(F.sum(kept).alias("preserved"), F.count("*").alias("tables"))
    told = expected.join(found, "doc_id", "left")
    computed = F.coalesce(F.col("expected") > 0, F.lit(False)) & F.col("tables").isNotNull()
    value = lambda c: F.when(computed, c)
    return told.select("doc_id", F.when(computed, "computed").otherwise("na").alias("status"), value(F.col("preserved")).alias("preserved"), value(F.col("tables")).alias("tables"), value(F.round(F.col("preserved") / F.col("tables"), 6)).alias("table_preservation"))


def gate(value: Column, least: float | None) -> Column:
    """``passed`` at or above the threshold, ``failed`` below, ``na`` where either is missing."""
    return F.when(value.isNull() | F.lit(least is None), "na").when(value >= F.lit(least), "passed").otherwise("failed")


def verdict(*gates: Column) -> Column:
    """One failure fails; else one pass passes; else na."""
    every = F.array(*gates)
    return F.when(F.array_contains(every, "failed"), "failed").when(F.array_contains(every, "passed"), "passed").otherwise("na")


# Thresholds of the gates on extraction and layout (layout has none of its own), and on structure.
GROUP_A = {"provenance_coverage": 0.95, "text_extraction_rate": 0.9, "table_detection_rate": 0.8, "layout_coherence": None}
GROUP_B = {"point_label_detection": 0.9, "hierarchy_completeness": 0.9}
# Review reason of each remark that the structure builder leaves on a provision.
REMARK_REASONS = {
    "OCR d/đ ambiguity normalized from duplicate d)": "D_D_AMBIGUITY",
    "duplicate d) point label": "D_D_AMBIGUITY",
    "point label reconstructed from marker-stripped list item": "POINT_LABEL_AMBIGUOUS",
    "clause number reconstructed from marker-stripped list item": "HIERARCHY_VIOLATION",
    "non-numeric article suffix": "HIERARCHY_VIOLATION",
    "orphan point without article/clause": "HIERARCHY_VIOLATION",
    "orphan clause without article": "HIERARCHY_VIOLATION",
    "table without article or appendix": "HIERARCHY_VIOLATION",
}


def group_a(metrics: DataFrame, thresholds: dict = GROUP_A) -> DataFrame:
    gates = {name: gate(F.col(name), least) for name, least in thresholds.items()}
    return metrics.select("doc_id", *[g.alias(f"{name}_gate") for name, g in gates.items()], verdict(*gates.values()).alias("group_a"))


def hierarchy(provisions: DataFrame) -> DataFrame:
    """doc_id, n (articles, clauses and points), orphan_clauses, orphan_points, duplicates (ids that several rows have),
    point_label_detection (points whose label is one of the first run a to e; 0 without points).

    A bare d) counts by its place among the bare ones of its clause: the first is d), the second đ).
    """
    tree = provisions.filter(F.col("kind").isin("ARTICLE", "CLAUSE", "POINT"))
    tree = tree.withColumn("parent_id", F.when(F.col("kind").isin("POINT", "CLAUSE"), F.regexp_replace("provision_id", r"__(diem|khoan)-[^_]+$", "")))
    parents = tree.filter(F.col("kind").isin("ARTICLE", "CLAUSE")).select(F.col("doc_id").alias("_doc"), F.col("provision_id").alias("_id")).distinct()
    met = tree.join(parents, (F.col("doc_id") == F.col("_doc")) & (F.col("parent_id") == F.col("_id")), "left")
    bare = F.lower(F.trim("label")).isin("d)", "d）")
    seen = F.sum(F.coalesce(bare, F.lit(False)).cast("int")).over(W.partitionBy("doc_id", "parent_id").orderBy("page_number", "reading_order").rowsBetween(W.unboundedPreceding, W.currentRow))
    canonical = point_label(F.col("label"), F.when(bare, F.lit(3) + seen))
    valid = F.coalesce(F.substring(canonical, 1, 1).isin("a", "b", "c", "d", "đ", "e"), F.lit(False))
    met = met.withColumn("_valid", valid).withColumn("_place", F.row_number().over(W.partitionBy("doc_id", "provision_id").orderBy("page_number", "reading_order")))
    total = lambda test: F.sum(test.cast("int"))
    point, orphan = F.col("kind") == "POINT", F.col("_id").isNull()
    return met.groupBy("doc_id").agg(
        F.count("*").alias("n"), total((F.col("kind") == "CLAUSE") & orphan).alias("orphan_clauses"), total(point & orphan).alias("orphan_points"), total(F.col("_place") == 2).alias("duplicates"),
        F.round(F.coalesce(F.try_divide(total(point & F.col("_valid")), total(point)), F.lit(0.0)), 6).alias("point_label_detection"),
    )


def d_label_rate(points: DataFrame) -> DataFrame:
    """Share of d and đ labels that are canonical at their place in the run: d fourth, đ fifth; null without any."""
    place = F.row_number().over(W.partitionBy("doc_id", "point_run").orderBy("page_number", "reading_order"))
    met = points.withColumn("place", place).filter(F.col("label").isin("d)", "đ)"))
    good = F.coalesce(point_label(F.col("label"), F.col("place")) == F.col("label"), F.lit(False))
    return met.groupBy("doc_id").agg(F.round(F.avg(good.cast("double")), 6).alias("d_label_rate"), F.count("*").alias("n"))


def group_b(metrics: DataFrame, documents: DataFrame | None = None, thresholds: dict = GROUP_B) -> DataFrame:
    """doc_id, hierarchy_completeness, failed_checks, group_b (passed) from ``hierarchy``.

    Completeness is the share of articles, clauses and points without an orphan or duplicate defect. ``documents`` adds
    those without any provision: nothing extracted fails both checks. Short points are all retained and gate nothing.
    """
    if documents is not None:
        metrics = documents.select("doc_id").join(metrics, "doc_id", "left")
    rate = F.try_divide(F.col("n") - F.col("orphan_clauses") - F.col("orphan_points") - F.col("duplicates"), F.col("n"))
    out = metrics.withColumns({"hierarchy_completeness": F.round(F.coalesce(rate, F.lit(0.0)), 6), "point_label_detection": F.coalesce("point_label_detection", F.lit(0.0))})
    failed = F.array_compact(F.array(*[F.when(F.col(name) < least, F.lit(name)) for name, least in thresholds.items()]))
    return out.select("doc_id", "point_label_detection", "hierarchy_completeness", failed.alias("failed_checks"), (F.size(failed) == 0).alias("group_b"))


def routed(provisions: DataFrame) -> DataFrame:
    """provision_id, status, reasons: DROPPED before NEEDS_REVIEW before ACCEPTED, reasons in fixed order.

    Reads kind, label, needs_review, ambiguity, source_text, effective_from (text), extraction and provenance gates,
    group_a verdict and group_b.
    """
    twice = F.count("*").over(W.partitionBy("doc_id", "provision_id")) > 1
    point, bare_d = F.col("kind") == "POINT", F.lower(F.trim(F.coalesce("label", F.lit("")))).isin("d)", "d）")
    canonical = point_label(F.col("label"), F.lit(None).cast("int"))
    status = F.when(~point, None).when(canonical.isNotNull(), F.when(F.substring(canonical, 1, 1).isin("a", "b", "c", "d", "đ", "e"), "valid").otherwise("ambiguous")).when(bare_d, "d_ambiguity").otherwise("invalid")
    out = provisions.withColumn("_twice", twice).withColumn("_label", status)
    hard = F.array_compact(F.array(F.when(F.col("_twice"), F.lit("DUPLICATE_PROVISION")), F.when(F.col("_label") == "invalid", F.lit("INVALID_POINT_LABEL"))))
    reason = F.create_map(*[F.lit(x) for pair in REMARK_REASONS.items() for x in pair])
    ambiguity = F.when(F.col("needs_review"), F.coalesce(F.when(F.col("ambiguity").isNotNull(), F.try_element_at(reason, F.col("ambiguity"))), F.lit("NEEDS_REVIEW")))
    undated = F.lower(F.trim(F.coalesce("effective_from", F.lit("")))).isin("", "unknown", "pending_review")
    low_scan = (F.col("extraction_gate") == "failed") | (F.col("provenance_gate") == "failed")
    review = F.array_distinct(F.array_compact(F.array(
        F.when(F.col("_label") == "d_ambiguity", F.lit("D_D_AMBIGUITY")).when(F.col("_label") == "ambiguous", F.lit("POINT_LABEL_AMBIGUOUS")), ambiguity,
        F.when(leaked_header(F.col("source_text")), F.lit("HEADER_FOOTER_LEAKAGE")), F.when(undated, F.lit("UNKNOWN_EFFECTIVE_DATE")),
        F.when(low_scan, F.lit("LOW_OCR_COVERAGE")).when(F.col("group_a") != "passed", F.lit("NEEDS_REVIEW")), F.when(~F.col("group_b"), F.lit("NEEDS_REVIEW")),
    )))
    verdict_ = F.when(F.size(hard) > 0, "DROPPED").when(F.size(review) > 0, "NEEDS_REVIEW").otherwise("ACCEPTED")
    return out.select("doc_id", "provision_id", verdict_.alias("status"), F.when(F.size(hard) > 0, hard).otherwise(review).alias("reasons"))


def routing_histogram(decisions: DataFrame) -> DataFrame:
    return decisions.select("status", F.explode_outer("reasons").alias("reason")).groupBy("status", "reason").agg(F.count("*").alias("n"))


def document_decision(decisions: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Any review: NEEDS_REVIEW; else any dropped: DROPPED; else ACCEPTED. ``documents`` adds those without provisions: NEEDS_REVIEW."""
    severity = F.when(F.col("status") == "NEEDS_REVIEW", 2).when(F.col("status") == "DROPPED", 1).otherwise(0)
    worst = decisions.groupBy("doc_id").agg(F.max(severity).alias("w"), F.count("*").alias("n"))
    if documents is not None:
        worst = documents.select("doc_id").join(worst, "doc_id", "left").select("doc_id", F.coalesce("w", F.lit(2)).alias("w"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return worst.select("doc_id", F.when(F.col("w") == 2, "NEEDS_REVIEW").when(F.col("w") == 1, "DROPPED").otherwise("ACCEPTED").alias("decision"), "n")


def routing_record(files: DataFrame, gates: DataFrame, outcomes: DataFrame) -> DataFrame:
    """doc_id and the canonical JSON record of each document's routing, for the run table: inputs, decision, gates, outcome.

    A document without an outcome has a decision only: nothing was executed.
    """
    joined = files.join(gates, "doc_id", "left").join(outcomes, "doc_id", "left")
    executed = F.col("outcome").isNotNull()
    given = F.struct("mime", "has_text_layer", "layout_complexity")
    measured = F.when(executed, F.struct(*[F.col(c) for c in sorted(gates.columns) if c.endswith("_gate")], "group_a"))
    record = F.struct(
        F.struct("compare", "has_fallback", "ocr_required", "route").alias("decision"), F.col("doc_id").cast("string").alias("document_id"), executed.alias("executed"), measured.alias("gates"), given.alias("inputs"),
        (F.col("outcome") == "review").alias("routed_to_review"), F.when(executed, F.when(F.col("outcome") == "accepted_alternate", "alternate").otherwise("primary")).alias("source_parser"), F.col("outcome").alias("terminal_outcome"),
    )
    return joined.select("doc_id", canonical_json(record).alias("record"))


def parser_route(files: DataFrame, complex_tables: int = 3, compare: bool = True) -> DataFrame:
    """Route of each file by MIME type, text layer and table count: the first row of the policy that holds."""
    mime = F.lower(F.coalesce("mime", F.lit("")))
    pdf = (mime == "application/pdf") | mime.endswith("/pdf")
    many = F.lit(compare) & F.coalesce(F.col("layout_complexity") >= complex_tables, F.lit(False))
    route = F.when(~pdf, "other_mime").when(many, "compare_complex_tables").when(F.col("has_text_layer"), "text").otherwise("ocr")
    return files.withColumn("route", route).withColumn("ocr_required", pdf & ~F.col("has_text_layer") & (F.col("route") != "text")).withColumn("compare", F.col("route") == "compare_complex_tables").withColumn("has_fallback", F.col("route") != "other_mime")


def compare_and_pick(primary: DataFrame, alternate: DataFrame, key: str = "doc_id") -> DataFrame:
    """Better parser of each document: tables, then provenance, then text; a missing metric loses; ties stay primary."""
    names = ("table_detection_rate", "provenance_coverage", "text_extraction_rate")
    a = primary.select(F.col(key), F.struct(*[F.coalesce(n, F.lit(-1.0)).alias(n) for n in names]).alias("_a"))
    b = alternate.select(F.col(key), F.struct(*[F.coalesce(n, F.lit(-1.0)).alias(n) for n in names]).alias("_b"))
    picked = F.when(F.col("_b").isNull() | F.coalesce(F.col("_a") >= F.col("_b"), F.lit(False)), "primary").otherwise("alternate")
    return a.join(b, key, "full").select(key, picked.alias("picked"))


def gated_outcome(primary: DataFrame, alternate: DataFrame, key: str = "doc_id") -> DataFrame:
    """Outcome after the gates: accepted, accepted by the alternate parser, review or failed.

    Both tables have key, parser_ok (one source parser, the one selected), partial and group_a. A partial parse never
    passes; parts of two parsers are never mixed: the whole document is one parser's.
    """
    a = primary.select(key, F.col("parser_ok").alias("_ok"), F.when(F.col("partial"), "failed").otherwise(F.col("group_a")).alias("_a"))
    b = alternate.select(key, (F.col("parser_ok") & ~F.col("partial") & (F.col("group_a") == "passed")).alias("_b"))
    outcome = F.when(~F.col("_ok"), "failed").when(F.col("_a") == "passed", "accepted").when(F.coalesce("_b", F.lit(False)), "accepted_alternate").otherwise("review")
    return a.join(b, key, "left").select(key, outcome.alias("outcome"))


def outcome_histogram(outcomes: DataFrame, *dimensions: str) -> DataFrame:
    """Counts for each value of each dimension, in one pass by grouping sets: dimension, value, n."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    return outcomes.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def manifest_intervals(provisions: DataFrame, manifests: DataFrame) -> DataFrame:
    """Provisions under their document's interval where the whole document is EFFECTIVE; others keep their own."""
    m = manifests.filter("status = 'EFFECTIVE' and coalesce(effective_from, '') != ''").select("document_id", F.col("effective_from").alias("_from"), F.col("effective_to").alias("_to"))
    joined = provisions.join(m, "document_id", "left")
    given = F.col("_from").isNotNull()
    return joined.withColumn("effective_to", F.when(given, F.col("_to")).otherwise(F.col("effective_to"))).withColumn("effective_from", F.coalesce("_from", "effective_from")).drop("_from", "_to")


def certified(gates: DataFrame, scan_only: Column) -> DataFrame:
    """Gates as routing sees them: a source that is a scan only cannot certify its text, whatever was measured."""
    failed = lambda c: F.when(scan_only, "failed").otherwise(F.col(c))
    return gates.withColumns({c: failed(c) for c in ("provenance_coverage_gate", "text_extraction_rate_gate", "group_a")})


def decided(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Review items after decisions: the last one counts, NEEDS_REVIEW is stored as PENDING; history keeps them all."""
    stored = F.when(F.col("decision") == "NEEDS_REVIEW", "PENDING").otherwise(F.col("decision"))
    last = decisions.groupBy("item_id").agg(F.max_by(stored, F.struct("decided_at", "decision_id")).alias("_status"), F.count("*").alias("decisions"))
    return items.join(last, "item_id", "left").withColumn("status", F.coalesce("_status", "status")).withColumn("decisions", F.coalesce("decisions", F.lit(0))).drop("_status")


def repair_plan(issues: DataFrame, most: int = 3) -> DataFrame:
    """Next step of each failed answer by its issue and the attempts so far; from ``most`` attempts on it abstains."""
    code = F.col("issue")
    path = (
        F.when(code.isin("L6_EVIDENCE_INCOMPLETE", "INSUFFICIENT_EVIDENCE"), "targeted_retrieval").when(code.isin("L5_CLAIM_NOT_SUPPORTED", "L2_CITATION_NOT_IN_CONTEXT"), "regenerate")
        .when(code == "L1_SCHEMA_INVALID", "regenerate_structured").when(code.isin("L3_TEMPORAL_INVALID", "L3_TEMPORAL_CONFLICT"), "temporal_retry")
    )
    reason = F.when(code.startswith("L3"), "TEMPORAL_CONFLICT").when(code.isin("L6_EVIDENCE_INCOMPLETE", "INSUFFICIENT_EVIDENCE"), "INSUFFICIENT_EVIDENCE").otherwise("CITATION_VERIFICATION_FAILED")
    stop = (F.col("attempts") >= most) | path.isNull()
    return issues.withColumn("step", F.when(stop, "abstain").otherwise(path)).withColumn("reason", F.when(stop, reason))
