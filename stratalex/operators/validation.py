"""Constraints that a store would enforce, as queries that return what breaks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalex.functions.text import valid_id

# Members of the closed lists.
KINDS = ("ARTICLE", "CLAUSE", "POINT", "APPENDIX", "TABLE", "TRANSITIONAL", "HEADING", "OTHER")
NON_ARTICLE = ("APPENDIX", "TABLE", "HEADING", "TRANSITIONAL", "OTHER")
BOX = ("left", "top", "right", "bottom")
TYPES = ("LAW", "DECREE", "CIRCULAR", "RESOLUTION", "DECISION", "OTHER")
REVIEW = ("PENDING", "ACCEPTED", "REJECTED", "DROPPED")
STATUSES = ("NOT_YET_EFFECTIVE", "EFFECTIVE", "PARTIALLY_EFFECTIVE", "EXPIRED", "UNKNOWN")


def provision_errors(provisions: DataFrame) -> DataFrame:
    """provision_id, version, error of every rule that a provision breaks.

    ``bbox`` is a map of numbers; a null value stands for one that is no number. Page sizes may stand beside the edges.
    """
    empty = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    unless = lambda test: F.coalesce(~test, F.lit(True))
    n = F.coalesce(F.size("source_ids"), F.lit(0))
    keys = F.map_keys("bbox")
    extra = F.size(F.array_except(keys, F.array(*[F.lit(x) for x in (*BOX, "page_height", "page_width")]))) > 0
    missing = F.size(F.array_except(F.array(*[F.lit(x) for x in BOX]), keys)) > 0
    hashed = F.col("content_hash").rlike("^[a-f0-9]{64}$")
    rules = {
        "id_empty": empty("provision_id"), "id_grammar": ~empty("provision_id") & unless(valid_id(F.col("provision_id"))), "source_text": empty("source_text"), "retrieval_text": empty("retrieval_text"),
        "sources": n <= 0, "sources_unique": (n > 0) & (F.size(F.array_distinct("source_ids")) < n), "page": unless(F.col("page_number") >= 1), "version": unless(F.col("version") >= 1),
        "status": unless(F.col("status").isin(*STATUSES)), "review_status": unless(F.col("review_status").isin(*REVIEW)), "kind": unless(F.col("node_kind").isin(*KINDS)),
        "article": F.col("article").isNull() & unless(F.col("node_kind").isin(*NON_ARTICLE)), "interval": F.col("effective_to") <= F.col("effective_from"),
        "accepted_undated": (F.col("review_status") == "ACCEPTED") & F.col("effective_from").isNull(), "hash_form": unless(hashed), "hash": hashed & (F.col("content_hash") != F.sha2("source_text", 256)),
        "bbox_keys": extra, "bbox_missing": ~extra & missing, "bbox_numeric": ~extra & ~missing & F.exists(F.array(*[F.col("bbox")[x] for x in BOX]), lambda x: x.isNull()),
    }
    errors = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return provisions.select("provision_id", "version", F.explode(errors).alias("error"))


def document_errors(manifests: DataFrame, extracted: DataFrame, fields: tuple[str, ...] = ("document_number", "document_type")) -> DataFrame:
    """document_id, error of every guard that keeps a manifest from becoming a document: a row here goes to review.

    Required fields, closed lists, an interval that ends after it starts, a date behind acceptance, and no conflict
    with what was extracted from the text.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    begin, end = F.to_date("effective_from"), F.to_date("effective_to")
    required = [F.when(blank(c), F.lit(f"missing:{c}")) for c in ("document_id", "document_number", "document_type", "file_hash", "status", "review_status")]
    lists = [F.when(~blank(c) & ~F.col(c).isin(*known), F.lit(f"enum:{c}")) for c, known in (("document_type", TYPES), ("status", STATUSES), ("review_status", REVIEW))]
    dates = [F.when(end <= begin, F.lit("interval")), F.when((F.col("review_status") == "ACCEPTED") & begin.isNull(), F.lit("accepted_undated"))]
    found = manifests.select("document_id", F.explode(F.array_compact(F.array(*required, *lists, *dates))).alias("error"))
    conflicts = manifest_conflicts(extracted, manifests, fields).select("document_id", F.concat(F.lit("conflict:"), "field").alias("error"))
    return found.unionByName(conflicts)


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that several rows have, with their number."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def dangling(rows: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no parent; a null reference is none."""
    return rows.filter(F.col(column).isNotNull()).join(parents.select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_anti")


def manifest_errors(manifests: DataFrame) -> DataFrame:
    """document_id, error: required fields, closed lists, and an end that does not follow the start."""
    missing = [F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(f"missing:{c}")) for c in ("document_id", "document_number", "document_type", "status")]
    rules = [F.when(~F.col("status").isin(*STATUSES), F.lit("enum:status")), F.when(F.to_date("effective_to") <= F.to_date("effective_from"), F.lit("interval"))]
    return manifests.select("document_id", F.explode(F.array_compact(F.array(*missing, *rules))).alias("error"))


def manifest_conflicts(extracted: DataFrame, manifests: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """document_id, field, extracted, declared where both are known and differ."""
    joined = extracted.alias("e").join(manifests.alias("m"), "document_id")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"e.{f}").cast("string").alias("extracted"), F.col(f"m.{f}").cast("string").alias("declared")) for f in fields])
    found = joined.select("document_id", F.explode(F.filter(pairs, lambda p: p["extracted"] != p["declared"])).alias("c"))
    return found.select("document_id", "c.field", "c.extracted", "c.declared")


# Fields of a manifest and what each must be; those after the bar may be absent.
MANIFEST = {
    "document_id": "^[a-z0-9]+-[a-z0-9-]*[a-z0-9]+$", "source_url": "uri", "downloaded_at": "date", "file_hash": "^[a-f0-9]{64}$", "document_number": "text", "document_type": TYPES, "issuer": "text",
    "issued_date": "date", "effective_from": "date or null", "effective_to": "date or null", "status": STATUSES, "relation_notes": "any text", "review_status": REVIEW, "|reviewed_by": "text", "|reviewed_at": "date",
}


def _dated(c: Column) -> Column:
    """Whether a text is a day, or a moment with its offset, that the calendar has."""
    day = c.rlike(r"^\d{4}-\d{2}-\d{2}$") & c.try_cast("date").isNotNull()
    moment = c.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$") & F.upper(c).try_cast("timestamp").isNotNull()
    return F.coalesce(day | moment, F.lit(False))


def manifest_schema_errors(manifests: DataFrame, key: str, raw: str, fields: dict = MANIFEST) -> DataFrame:
    """key, error of every rule of the manifest schema that a JSON text breaks; unknown fields are refused.

    not_object, unknown:f, missing:f, type:f (no text where one must be), value:f (pattern, list, date, address, empty text), a decided
    review without reviewer (missing:reviewed_by, missing:reviewed_at), accepted_undated, and interval for an end that
    does not follow the start by days.
    """
    whole = F.try_parse_json(F.col(raw))
    rows = manifests.select(F.col(key), F.coalesce(F.json_object_keys(F.when(whole.isNotNull(), F.col(raw))), F.array().cast("array<string>")).alias("_keys"), F.coalesce(F.schema_of_variant(whole), F.lit("")).alias("_kind"), whole.alias("_v"))
    names = [name.lstrip("|") for name in fields]
    kinds = {n: F.schema_of_variant(F.try_variant_get("_v", f"$.{n}", "variant")).alias(f"_k_{n}") for n in names}
    texts = {n: F.when(F.schema_of_variant(F.try_variant_get("_v", f"$.{n}", "variant")) == "STRING", F.try_variant_get("_v", f"$.{n}", "string")).alias(n) for n in names}
    rows = rows.select(key, "_keys", "_kind", *kinds.values(), *texts.values())
    errors = [F.when(~F.col("_kind").startswith("OBJECT"), F.lit("not_object"))]
    held = lambda n: F.array_contains("_keys", n)
    for name, rule in fields.items():
        n, kind = name.lstrip("|"), F.col(f"_k_{name.lstrip('|')}")
        if not name.startswith("|"):
            errors.append(F.when(F.col("_kind").startswith("OBJECT") & ~held(n), F.lit(f"missing:{n}")))
        errors.append(F.when(held(n) & F.coalesce(kind != "STRING", F.lit(True)) & ~F.coalesce((kind == "VOID") & F.lit(rule == "date or null"), F.lit(False)), F.lit(f"type:{n}")))
        good = F.lit(True) if rule == "any text" else F.col(n) != "" if rule == "text" else F.col(n).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$") if rule == "uri" else _dated(F.col(n)) if rule in ("date", "date or null") else F.col(n).isin(*rule) if isinstance(rule, tuple) else F.col(n).rlike(rule)
        errors.append(F.when(F.col(n).isNotNull() & ~good, F.lit(f"value:{n}")))
    decided = F.coalesce(F.col("review_status").isin("ACCEPTED", "REJECTED"), F.lit(False))
    errors += [F.when(decided & ~held(n), F.lit(f"missing:{n}")) for n in ("reviewed_by", "reviewed_at")]
    errors.append(F.when(F.coalesce(F.col("review_status") == "ACCEPTED", F.lit(False)) & held("effective_from") & F.col("effective_from").isNull(), F.lit("accepted_undated")))
    day = lambda n: F.when(_dated(F.col(n)), F.substring(n, 1, 10))
    errors.append(F.when(day("effective_to") <= day("effective_from"), F.lit("interval")))
    unknown = F.transform(F.array_except("_keys", F.array(*[F.lit(n) for n in names])), lambda x: F.concat(F.lit("unknown:"), x))
    return rows.select(key, F.explode(F.concat(F.array_compact(F.array(*errors)), unknown)).alias("error"))
