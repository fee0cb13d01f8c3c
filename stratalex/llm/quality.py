"""Quality rules whose cutoffs come with a guarantee on the clean documents they reject.

Every rule is a rate, high for poor text. On labelled documents, for each stratum (language) and rule, cutoffs are
tried from the mildest on; one is certified while an exact binomial test shows that it rejects less than ``risk`` of
the stratum's clean documents. The error level is divided among rules and strata (Bonferroni); along the cutoffs
of one rule the tests form a fixed sequence that stops at its first failure, which needs no further correction.
The rates are not fitted to labels, so all labelled documents are holdout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WHITE, Workspace, without_white, word_list

#: Rules: rate of a document, with the cutoffs tried, mildest first.
RULES = {
    "symbols": ("n_symbols / greatest(1, word_chars)", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03)),
    "shouting": ("n_shouts / greatest(1, word_chars)", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03)),
    "repeats": ("n_repeat_words / greatest(1, n_words)", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "lines": ("n_dup_lines / greatest(1, n_lines)", (0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
}
#: Clean documents of a stratum that all rules together may reject, and the chance that any bound fails.
RISK, LEVEL = 0.04, 0.05
#: Strata up to which their cutoffs are sent to every task (some hundred bytes each).
SMALL = 10_000


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_shouts and n_lines of the whole text.

    A null text has no words. Columns of the same names are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != "")
    out = docs.withColumns({"_w": word_list(F.col("text")), "_lines": lines})
    # Windows of three words beside their places, sorted: equal windows are neighbours. Linear memory, no shuffle.
    out = out.withColumn("_s", F.expr("case when size(_w) < 3 then null else sort_array(slice(arrays_zip(_w, slice(_w, 2, size(_w)), slice(_w, 3, size(_w)), sequence(0, size(_w) - 1)), 1, size(_w) - 2)) end"))
    out = out.withColumn("_t", F.expr("slice(_s, 2, size(_s))"))
    names = out.schema["_s"].dataType.elementType.names
    same = " and ".join(f"p._s.`{n}` = p._t.`{n}`" for n in names[:3])
    out = out.withColumn("_p", F.expr(f"filter(arrays_zip(_s, _t), p -> {same})"))
    place = names[3]
    found = F.expr(f"sort_array(array_distinct(flatten(transform(_p, p -> array(p._s.`{place}`, p._t.`{place}`)))))")
    covered = F.aggregate(found, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")))["n"]
    return out.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(without_white(text)).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(F.size("_p") > 0, covered).otherwise(0).cast("long"),
            "n_shouts": (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
        }
    ).drop("_w", "_lines", "_s", "_t", "_p")


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_shouts", "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def chance_at_most(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exact: a sum of its terms in logarithms. 1 where k is at or above the mean."""
    ratio = F.lit(p / (1 - p))
    first = n * F.log(F.lit(1 - p))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i * ratio)
        high, low = F.greatest(acc["sum"], term), F.least(acc["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    folded = F.aggregate(terms, F.struct(first.alias("term"), first.alias("sum")), add)["sum"]
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(folded))


def calibrate(scored: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL, rules=RULES) -> DataFrame:
    """Certified cutoffs: one row per stratum (column stratum) and rule that has one: rule, cutoff, clean, rejected.

    Clean are documents with quality 1 in ``labels``; a document with several labels is clean if one says so.
    Documents that already fail the base are not counted: rules only act on the others; rows with an equal ``_print``
    (where ``scored`` has one) count once in a stratum. A stratum with too few
    clean labels to certify any cutoff gets none, so nothing is rejected there.
    """
    # Copies of a text are no independent trials: each distinct text of a stratum counts once.
    clean = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_labelled")).distinct()
    held = scored.filter(~base_failed()).join(clean, F.col("doc_id") == F.col("_labelled"), "left_semi")
    held = held.dropDuplicates(["lang", "_print"]) if "_print" in held.columns else held
    tries = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(i).alias("place"), F.lit(float(c)).alias("cutoff"), (F.expr(rate) > F.lit(float(c))).alias("over")) for name, (rate, cutoffs) in rules.items() for i, c in enumerate(cutoffs)])
    counted = (
        held.select(F.col("lang").alias("stratum"), F.explode(tries).alias("t"))
        .groupBy("stratum", "t.rule", "t.place", "t.cutoff")
        .agg(F.count("*").alias("clean"), F.sum(F.col("t.over").cast("long")).alias("rejected"))
    )
    tests = F.size(F.collect_set(F.coalesce(F.col("stratum"), F.lit("\x00null"))).over(W.partitionBy("rule", "place"))) * len(rules)
    tested = counted.withColumn("tests", tests).withColumn("p", chance_at_most(F.col("rejected"), F.col("clean"), risk / len(rules)))
    passed = F.min((F.col("p") <= F.lit(level) / F.col("tests")).cast("int")).over(W.partitionBy("stratum", "rule").orderBy("place"))
    return tested.withColumn("passed", passed).filter("passed = 1").groupBy("stratum", "rule").agg(F.min_by("cutoff", "cutoff").alias("cutoff"), F.max("clean").alias("clean"), F.max("rejected").alias("rejected"))


def judge(scored: DataFrame, cutoffs: DataFrame, rules=RULES) -> DataFrame:
    """``scored`` with base_failed and kept. A document is kept unless it fails the base or is over a cutoff."""
    wide = cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(*[F.max(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"_cut_{name}") for name in rules])
    wide = F.broadcast(wide) if wide.count() <= SMALL else wide
    over = F.lit(False)
    for name, (rate, _) in rules.items():
        over = over | F.coalesce(F.expr(rate) > F.col(f"_cut_{name}"), F.lit(False))
    joined = scored.join(wide, scored["lang"].eqNullSafe(F.col("_stratum")), "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~over).drop("_stratum", *[f"_cut_{name}" for name in rules])


def quality(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """doc_id, lang, the features, base_failed and kept of every row of ``docs``.

    Null texts count as empty and fail the base; a null lang is a stratum of its own; repeated rows are judged
    each; empty tables give empty results; other columns are not read.
    """
    space = Workspace(docs.sparkSession, "quality")
    scored = space.save(features(docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("_print"))).drop("text"), "scored")
    return judge(scored.drop("_print"), space.save(calibrate(scored, labels, risk, level), "cutoffs"))


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """Rows of ``docs`` that are kept; columns unchanged. The features are computed once, beside the rows."""
    space = Workspace(docs.sparkSession, "quality")
    held = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "lang", "text", F.xxhash64("text").alias("_print"))
    scored = space.save(features(held).drop("text"), "scored")
    cutoffs = space.save(calibrate(scored.drop("_doc"), labels, risk, level), "cutoffs")
    return judge(scored, cutoffs).filter("kept").select("_doc.*")
