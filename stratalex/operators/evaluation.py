"""Evaluation metrics: sets against gold, pooled fractions, ranked retrieval, citations, abstention, time and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    return F.when(b > 0, F.round(a / b, digits))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def set_scores(gold: DataFrame, found: DataFrame, by: str, *key: str) -> DataFrame:
    """Precision, recall and F1 of ``found`` against ``gold`` for each value of ``by``; keys count once."""
    g, f = gold.select(by, *key).distinct().withColumn("_g", F.lit(1)), found.select(by, *key).distinct().withColumn("_f", F.lit(1))
    both = g.join(f, [by, *key], "full")
    has_g, has_f = F.col("_g").isNotNull(), F.col("_f").isNotNull()
    counts = both.groupBy(by).agg(F.sum((has_g & has_f).cast("int")).alias("tp"), F.sum((~has_g & has_f).cast("int")).alias("fp"), F.sum((has_g & ~has_f).cast("int")).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(by, "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1(tp, fp, fn).alias("f1"))


def pooled(metrics: DataFrame, by: str) -> DataFrame:
    """Sum of numerators over sum of denominators, beside the plain mean of the fractions; na rows do not count."""
    known = metrics.filter(F.col("denominator") > 0)
    return known.groupBy(by).agg(F.round(F.sum("numerator") / F.sum("denominator"), 6).alias("pooled"), F.round(F.avg(F.col("numerator") / F.col("denominator")), 6).alias("mean"), F.count("*").alias("n"))


def retrieval_scores(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """query_id, recall, mrr, ndcg at k; ``ranked``: query_id, unit_id, rank; ``relevant``: query_id, unit_id, each pair once."""
    top = ranked.filter(F.col("rank") <= k)
    hits = top.join(relevant.select("query_id", "unit_id"), ["query_id", "unit_id"], "left_semi")
    gain = 1 / F.log2(F.col("rank") + 1)
    scored = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("best"), F.sum(gain).alias("dcg"))
    total = relevant.groupBy("query_id").agg(F.count("*").alias("total"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("total").cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return total.join(scored, "query_id", "left").select(
        "query_id", F.round(F.coalesce("hits", F.lit(0)) / F.col("total"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("best"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 6).alias("ndcg")
    )


def scores_by_label(ranked: DataFrame, asked: DataFrame, units: DataFrame, k: int = 10) -> DataFrame:
    """``retrieval_scores`` where the relevant units of a query are those of its label, itself left out.

    ``asked``: query_id, label; ``units``: unit_id, label. Only the units found are looked at; of the others the number of a
    label's units is enough, so no query meets all units of its label.
    """
    totals = units.groupBy("label").agg(F.count("*").alias("_n"))
    own = asked.join(units.withColumnRenamed("unit_id", "query_id"), ["query_id", "label"], "left_semi").select("query_id", F.lit(1).alias("_own"))
    total = asked.join(totals, "label").join(own, "query_id", "left").select("query_id", "label", (F.col("_n") - F.coalesce("_own", F.lit(0))).alias("total")).filter("total > 0")
    found = ranked.filter(F.col("rank") <= k).join(units.withColumnRenamed("label", "_found"), "unit_id").join(total, "query_id").filter((F.col("_found") == F.col("label")) & (F.col("unit_id") != F.col("query_id")))
    hits = found.groupBy("query_id").agg(F.count("*").alias("_hits"), F.min("rank").alias("_best"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("_dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("total")).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    out = total.join(hits, "query_id", "left")
    value = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return out.select("query_id", value(F.col("_hits") / F.col("total")).alias("recall"), value(1 / F.col("_best")).alias("mrr"), value(F.col("_dcg") / ideal).alias("ndcg"))


def confusion(rows: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 of a yes-no guess."""
    n = lambda t, g: F.sum(((truth if t else ~truth) & (guess if g else ~guess)).cast("int"))
    c = rows.agg(n(True, True).alias("tp"), n(False, True).alias("fp"), n(True, False).alias("fn"), n(False, False).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1(tp, fp, fn).alias("f1"))


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(F.round(F.expr(f"percentile({value}, 0.5)"), 6).alias("p50"), F.round(F.expr(f"percentile({value}, 0.95)"), 6).alias("p95"), F.count("*").alias("n"))


def evidence_recall(required: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, recall, complete: share of required (query_id, item) pairs found."""
    need = required.select("query_id", "item", F.lit(1).alias("_r"), F.lit(0).alias("_f"))
    got = found.filter("query_id is not null and item is not null").select("query_id", "item", F.lit(0).alias("_r"), F.lit(1).alias("_f"))
    met = need.unionByName(got).groupBy("query_id", "item").agg(F.max("_r").alias("_r"), F.max("_f").alias("_f")).filter("_r = 1")
    share = F.avg(F.col("_f").cast("double"))
    return met.groupBy("query_id").agg(F.round(share, 6).alias("recall"), (share == 1).alias("complete"))


def evidence_metrics(required: DataFrame, found: DataFrame, answerable: DataFrame, k: int = 10) -> DataFrame:
    """query_id, recall, all_at_k, hops, complete of the answerable questions that require evidence.

    ``required``: query_id, category, unit_id (the units that serve a category); ``found``: query_id, unit_id, rank;
    ``answerable``: query_id. recall: share of the categories with a unit found at any rank; all_at_k: every category has
    one in the first ``k``; hops: number of categories; complete: all covered, only told where there are several (null else).
    Questions that are not answerable, or require nothing, have no row: they are neither above nor below the line.
    """
    asked = required.join(answerable.select("query_id").distinct(), "query_id", "left_semi")
    ranks = found.groupBy("query_id", "unit_id").agg(F.min("rank").alias("rank"))
    best = asked.join(ranks, ["query_id", "unit_id"], "left").groupBy("query_id", "category").agg(F.min("rank").alias("rank"))
    share = lambda test: F.avg(F.coalesce(test, F.lit(False)).cast("double"))
    per = best.groupBy("query_id").agg(F.round(share(F.col("rank").isNotNull()), 6).alias("recall"), (share(F.col("rank") <= k) == 1).alias("all_at_k"), F.count("*").alias("hops"))
    return per.withColumn("complete", F.when(F.col("hops") > 1, F.col("recall") == 1))


def costs(usage: DataFrame, prices: DataFrame, by: str) -> DataFrame:
    """by, queries, tokens, cost, cost_per_query of metered calls; cost is null where a call's model has no price.

    ``usage``: ``by``, query_id, model, input_tokens, output_tokens; ``prices``: model, input_price, output_price, in money for a
    million tokens, as decimals so that sums do not depend on their order.
    """
    price = lambda c: F.col(c).cast("decimal(18,6)")
    spent = usage.join(prices, "model", "left").withColumn("_cost", F.col("input_tokens") * price("input_price") + F.col("output_tokens") * price("output_price"))
    total = F.when(F.count("_cost") == F.count("*"), F.sum("_cost").cast("double") / 1_000_000)
    out = spent.groupBy(by).agg(F.countDistinct("query_id").alias("queries"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), total.alias("_total"))
    return out.select(by, "queries", "tokens", F.round("_total", 6).alias("cost"), F.round(F.col("_total") / F.col("queries"), 6).alias("cost_per_query"))


def resolution_choice(pages: DataFrame) -> DataFrame:
    """The finer scan resolution if it reads better (phrases or boxes) in at most twice the time, else the coarser.

    ``pages``: document_id, dpi (300 or 600), seconds, phrase_share, box_share of pages that succeeded.
    """
    at = lambda dpi, c: F.avg(F.when(F.col("dpi") == dpi, F.col(c)))
    per = pages.groupBy("document_id").agg(*[F.round(at(dpi, c), 4).alias(f"{c}_{dpi}") for dpi in (300, 600) for c in ("seconds", "phrase_share", "box_share")])
    better = (F.col("phrase_share_600") > F.col("phrase_share_300")) | (F.col("box_share_600") > F.col("box_share_300"))
    return per.withColumn("dpi", F.when(F.coalesce(better & (F.col("seconds_600") <= 2 * F.col("seconds_300")), F.lit(False)), 600).otherwise(300))


def citation_scores(cited: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, precision, recall, f1 over queries that have gold. Without citations precision is unknown, recall 0."""
    g = gold.select("query_id", "provision_id").distinct()
    c = cited.select("query_id", "provision_id").distinct()
    both = g.join(c, ["query_id", "provision_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("tp"))
    per = g.groupBy("query_id").agg(F.count("*").alias("g")).join(c.groupBy("query_id").agg(F.count("*").alias("c")), "query_id", "left").join(both, "query_id", "left")
    tp, p, r = F.coalesce("tp", F.lit(0)), F.col("precision"), F.col("recall")
    per = per.select("query_id", ratio(tp, F.col("c")).alias("precision"), ratio(tp, F.col("g")).alias("recall"))
    return per.withColumn("f1", F.when(p.isNotNull(), F.when(p + r > 0, F.round(2 * p * r / (p + r), 6)).otherwise(0.0)))


def invalid_citation_rate(cited: DataFrame, known: DataFrame) -> DataFrame:
    """Share of citations whose provision does not exist; null without citations."""
    marked = cited.join(known.select("provision_id").distinct().withColumn("_k", F.lit(1)), "provision_id", "left")
    return marked.agg(F.round(F.avg(F.col("_k").isNull().cast("double")), 6).alias("invalid_rate"), F.count("*").alias("n"))


def temporal_scores(cited: DataFrame, provisions: DataFrame) -> DataFrame:
    """query_id, validity (share of citations valid on the query's day) and leak (some are not)."""
    p = provisions.select("provision_id", "version", "effective_from", "effective_to", "review_status")
    valid = (F.col("review_status") == "ACCEPTED") & (F.col("effective_from") <= F.col("query_date")) & (F.col("effective_to").isNull() | (F.col("query_date") < F.col("effective_to")))
    met = cited.join(p, ["provision_id", "version"], "left").withColumn("ok", F.coalesce(valid, F.lit(False)))
    return met.groupBy("query_id").agg(F.round(F.avg(F.col("ok").cast("double")), 6).alias("validity"), F.max(~F.col("ok")).alias("leak"))


def grounding(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """numeric_accuracy and unsupported_rate: claims (query_id, claim_id, amount or null) against evidence (query_id, amount)."""
    e = evidence.select("query_id", "amount").distinct().withColumn("_e", F.lit(1))
    met = claims.join(e, ["query_id", "amount"], "left")
    number = F.col("amount").isNotNull()
    return met.agg(ratio(F.sum((number & F.col("_e").isNotNull()).cast("int")), F.sum(number.cast("int"))).alias("numeric_accuracy"), F.round(F.avg(F.col("_e").isNull().cast("double")), 6).alias("unsupported_rate"))


def d_confusion(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Points (doc_id, article, clause, letter): gold đ found as đ, gold đ clauses with a d found, gold d clauses with a đ found."""
    place = ["doc_id", "article", "clause"]
    has = lambda df, letter, name: df.filter(F.col("letter") == letter).select(*place).distinct().withColumn(name, F.lit(True))
    met = has(gold, "đ", "gold_dd").join(has(gold, "d", "gold_d"), place, "full").join(has(found, "đ", "found_dd"), place, "left").join(has(found, "d", "found_d"), place, "left")
    n = lambda a, b: F.coalesce(F.sum((F.col(a).isNotNull() & F.col(b).isNotNull()).cast("long")), F.lit(0))
    total = F.count("gold_dd")
    return met.agg(n("gold_dd", "found_dd").alias("matched"), total.alias("gold_dd"), n("gold_dd", "found_d").alias("dd_as_d"), n("gold_d", "found_dd").alias("d_as_dd"), ratio(n("gold_dd", "found_dd"), total).alias("recall"))


def mismatches(gold: DataFrame, found: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """key, field, expected, actual where a gold row was not found (field ``missing``) or was found with another value."""
    got = found.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_{f}") for f in fields])
    met = gold.join(got, F.col(key) == F.col("_key"), "left")
    row = lambda name, a, b: F.struct(F.lit(name).alias("field"), a.cast("string").alias("expected"), b.cast("string").alias("actual"))
    differ = [F.when(F.col("_key").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_{f}")), row(f, F.col(f), F.col(f"_{f}"))) for f in fields]
    lost = F.when(F.col("_key").isNull(), row("missing", F.col(key), F.lit(None)))
    return met.select(key, F.explode(F.array_compact(F.array(lost, *differ))).alias("m")).select(key, "m.field", "m.expected", "m.actual")


def recall_of(gold: DataFrame, found: DataFrame, key: str, test: Column) -> DataFrame:
    """Share of gold rows under ``test`` that were found: hits, total, recall; unknown without any."""
    met = gold.filter(test).join(found.select(key).distinct().withColumn("_f", F.lit(1)), key, "left")
    hits = F.sum(F.col("_f").isNotNull().cast("int"))
    return met.agg(F.coalesce(hits, F.lit(0)).alias("hits"), F.count("*").alias("total"), ratio(hits, F.count("*")).alias("recall"))
