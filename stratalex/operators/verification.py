"""Six layers of verification of drafted answers against what they cite; an answer is valid when all six pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalex.functions.text import tokens

from .temporal import valid_on

#: Share of a claim's words that its provisions must hold, where its words decide.
SUPPORT = 0.5
LAYERS = ("schema", "citations", "temporal", "numbers", "support", "evidence")


def numbers(text: Column) -> Column:
    """Numbers of a text without the marks between their digits, each once: ``800.000`` and ``800,000`` are 800000."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+(?:[.,]\d+)*)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "[.,]", "")))


def verified_answers(answers: DataFrame, claims: DataFrame, citations: DataFrame, context: DataFrame, provisions: DataFrame, plan: DataFrame, support: float = SUPPORT) -> DataFrame:
    """answer_id, one boolean for each of ``LAYERS``, valid and checked (row ids of the versions that were looked at, ascending).

    ``answers``: answer_id, text, query_date; ``claims``: answer_id, claim_id, text; ``citations``: answer_id, claim_id,
    provision_id; ``context``: answer_id, provision_id that retrieval or expansion brought; ``provisions``: provision_id, row_id,
    text, category, review_status, effective_from, effective_to; ``plan``: answer_id, category that is required.

    schema: text, a date and a claim are there, and every claim has words. citations: there is one, and each names a provision that
    exists, is accepted and is in the context. temporal: of each a version is valid on the query's date. numbers: every
    number of a claim stands in a version it cites that is valid then. support: so does ``support`` of its distinct words; a
    claim that cites nothing fails. evidence: every required category is that of a valid cited version. What cannot be told fails.
    """
    cited = citations.select("answer_id", "claim_id", "provision_id").distinct()
    held = context.select("answer_id", "provision_id").distinct().withColumn("_held", F.lit(True))
    accepted = provisions.filter("review_status = 'ACCEPTED'")
    known = accepted.select("provision_id").distinct().withColumn("_known", F.lit(True))
    dated = cited.join(answers.select("answer_id", "query_date"), "answer_id")
    # Versions of one provision do not overlap, so a citation meets one row at most.
    row = accepted.select("provision_id", "row_id", F.col("text").alias("_text"), "category", "effective_from", "effective_to")
    versions = dated.join(row, "provision_id").filter(valid_on(F.col("query_date"))).select("answer_id", "claim_id", "provision_id", "row_id", "_text", "category")
    met = cited.join(held, ["answer_id", "provision_id"], "left").join(known, "provision_id", "left").join(versions.select("answer_id", "claim_id", "provision_id", "row_id", "category"), ["answer_id", "claim_id", "provision_id"], "left")
    every = lambda test: F.min(F.coalesce(test, F.lit(False)).cast("int")) == 1
    by_citation = met.groupBy("answer_id").agg(every(F.col("_held") & F.col("_known")).alias("citations"), every(F.col("row_id").isNotNull()).alias("temporal"), F.array_sort(F.collect_set("row_id")).alias("checked"))

    # A claim and what it cites: sets of numbers and words, of a claim's few provisions each.
    evidence = versions.groupBy("answer_id", "claim_id").agg(F.flatten(F.collect_list(numbers(F.col("_text")))).alias("_numbers"), F.flatten(F.collect_list(F.array_distinct(tokens(F.col("_text"))))).alias("_words"))
    own = claims.withColumn("_own", F.array_distinct(tokens(F.coalesce("text", F.lit(""))))).join(evidence, ["answer_id", "claim_id"], "left")
    common = F.size(F.array_intersect("_own", "_words")) >= support * F.size("_own")
    by_claim = own.groupBy("answer_id").agg(
        every(F.size("_own") > 0).alias("_worded"), every(F.size(F.array_except(numbers(F.col("text")), F.coalesce("_numbers", F.array().cast("array<string>")))) == 0).alias("numbers"), every(F.col("_words").isNotNull() & common).alias("support")
    )
    covered = versions.select("answer_id", "category").distinct().withColumn("_covered", F.lit(True))
    by_plan = plan.select("answer_id", "category").distinct().join(covered, ["answer_id", "category"], "left").groupBy("answer_id").agg(every(F.col("_covered")).alias("evidence"))

    out = answers.join(by_citation, "answer_id", "left").join(by_claim, "answer_id", "left").join(by_plan, "answer_id", "left")
    schema = (F.btrim(F.coalesce("text", F.lit(""))) != "") & F.col("query_date").isNotNull() & F.coalesce("_worded", F.lit(False))
    told = {name: F.coalesce(name, F.lit(False)) for name in ("citations", "temporal", "numbers", "support")} | {"evidence": F.coalesce("evidence", F.lit(True)), "schema": schema}
    out = out.withColumns(told).withColumn("checked", F.coalesce("checked", F.array().cast("array<bigint>")))
    valid = out[LAYERS[0]]
    for name in LAYERS[1:]:
        valid = valid & out[name]
    return out.select("answer_id", *LAYERS, valid.alias("valid"), "checked")


def payload_errors(units: DataFrame) -> DataFrame:
    """point_id, errors of units whose payload is refused: relations (relation_type, target_provision_id) and vehicle_types.

    A relation has a type and a target that are not empty; so is every vehicle type. Missing lists are empty ones.
    """
    said = lambda c: F.coalesce(c != "", F.lit(False))
    relations, vehicles = F.coalesce("relations", F.array()), F.coalesce("vehicle_types", F.array())
    rules = {
        "relation": F.exists(relations, lambda r: r.isNull()), "relation_type": F.exists(relations, lambda r: r.isNotNull() & ~said(r["relation_type"])),
        "target_provision_id": F.exists(relations, lambda r: r.isNotNull() & ~said(r["target_provision_id"])), "vehicle_types": F.exists(vehicles, lambda x: ~said(x)),
    }
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return units.select("point_id", found.alias("errors")).filter(F.size("errors") > 0)
