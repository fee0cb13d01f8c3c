"""Context of a provision: the lead-in of its parent, by id, by labels or from the context text it carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalex.sources.stored import stored


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clause_lead_in(number: Column, text: Column) -> Column:
    """``Khoản n. body`` from a clause's own text, whatever marker it has."""
    body = _stripped(F.regexp_replace(text, r"(?iu)^\s*(?:Khoản\s+)?\d+\s*[.]\s*", ""))
    return F.when(text.isNotNull(), F.concat(F.lit("Khoản "), number, F.lit("."), F.when(body == "", "").otherwise(F.concat(F.lit(" "), body))))


def lead_in_by_number(context: Column, number: Column) -> Column:
    """Lead-in from the last ``n. ...`` of a context text, n being the clause's number."""
    found = F.call_function("regexp_extract", context, F.concat(F.lit(r"(?s)^(?:.*\s)?("), number, F.lit(r"\.\s.*)$")), F.lit(1))
    return F.when(found != "", clause_lead_in(number, found))


def lead_in_after_article(context: Column) -> Column:
    """Lead-in from the last clause marker behind the last article's label, whatever its number."""
    tail = F.regexp_extract(context, r"(?isu)^.*(?:^|\s)(Điều\s+\d+.*)$", 1)
    tail = F.when(tail != "", F.regexp_replace(tail, r"(?iu)^Điều\s+\d+[.:]?", "")).otherwise(context)
    found = F.regexp_extract(tail, r"(?su)^(?:.*\s)?(\d+\.\s.*)$", 1)
    return F.when(found != "", clause_lead_in(F.regexp_extract(found, r"^(\d+)", 1), found))


def article_heading(context: Column) -> Column:
    """The last article heading, cut at the first clause marker."""
    found = F.regexp_extract(context, r"(?isu)^.*(Điều\s+\d+[.:]?.*?)(?:\s(?:Khoản\s+)?\d+\.\s.*)?$", 1)
    return F.when(found != "", _stripped(found))


#: What a point's or clause's id has behind its parent's id; all that a document's ids have behind the part they share.
_TAIL, _TAILS = r"__(diem|khoan)-[^_]+$", r"(__(diem|khoan)-[^_]+)+$"


def _lines_by_label(own: DataFrame) -> DataFrame | None:
    """_d, _a, _c, _k, _by_label: lines for rows whose parent no id gives, by (document, article, clause) labels and the kind that asks; None without any.

    Whose labels are asked for is settled without lines, so that only lines that are taken move.
    """
    asks = F.col("kind").isin("POINT", "CLAUSE")
    rows = own.filter(asks).select("parent_id", F.col("doc_id").alias("_d"), F.col("article").alias("_a"), F.when(F.col("kind") == "POINT", F.col("clause")).alias("_c"), F.col("kind").alias("_k"))
    known = own.filter("line is not null and provision_id is not null").select(F.col("provision_id").alias("parent_id")).distinct()
    # Rows without an id stay out of the join: as nulls they would all meet in one task.
    missing = rows.filter("parent_id is not null").join(known, "parent_id", "left_anti").unionByName(rows.filter("parent_id is null"))
    up = F.when(F.col("kind") == "ARTICLE", F.lit("CLAUSE")).when(F.col("kind") == "CLAUSE", F.lit("POINT"))
    keys = [F.col("doc_id").alias("_d"), F.col("article").alias("_a"), F.when(F.col("kind") == "CLAUSE", F.col("number")).alias("_c"), up.alias("_k")]
    lines = own.filter(F.col("kind").isin("ARTICLE", "CLAUSE") & F.col("line").isNotNull()).select(*keys, "line")
    asked = missing.select(*[F.col(c).alias(f"{c}_") for c in ("_d", "_a", "_c", "_k")]).distinct()
    same = (F.col("_d") == F.col("_d_")) & (F.col("_a") == F.col("_a_")) & F.col("_c").eqNullSafe(F.col("_c_")) & (F.col("_k") == F.col("_k_"))
    met = stored(asked.join(lines.drop("line"), same, "left_semi"), "labels_asked")
    if met.isEmpty():
        return None
    return stored(lines.join(met, same, "left_semi").groupBy("_d", "_a", "_c", "_k").agg(F.min("line").alias("_by_label")), "lines_by_label")


def with_parents(provisions: DataFrame) -> DataFrame:
    """Add parent_id and parent_line: the parent's line by parent_id, else by (document, article, clause) labels.

    Points look for their clause, clauses for their article; the id's answer comes first. Lines are shuffled once: an
    id and its parent's id share what is left without their endings, by which rows are dealt, and there each row stands
    under its own id for those that look for it and under its parent's.
    """
    own = provisions.withColumn("parent_id", F.when(F.col("kind").isin("POINT", "CLAUSE"), F.regexp_replace("provision_id", _TAIL, "")))
    columns, labelled = own.columns, _lines_by_label(own)
    if labelled is None:
        own = own.withColumn("_by_label", F.lit(None).cast("string"))
    else:
        clause = F.when(F.col("kind") == "POINT", F.col("clause"))
        same = (F.col("doc_id") == F.col("_d")) & (F.col("article") == F.col("_a")) & clause.eqNullSafe(F.col("_c")) & (F.col("kind") == F.col("_k"))
        own = own.join(labelled, same, "left").drop("_d", "_a", "_c", "_k")
    # Rows without an id are found by none and may go anywhere, but not all to one task.
    dealt = own.withColumn("_root", F.coalesce(F.regexp_replace("provision_id", _TAILS, ""), F.col("doc_id").cast("string"), F.xxhash64("line").cast("string"))).repartition("_root")
    rest = F.struct(*[c for c in own.columns if c != "line"])
    place = lambda key, asks, row: F.struct(key.alias("_key"), asks.alias("_asks"), "line", row.alias("_rest"))
    asking = place(F.coalesce("parent_id", "provision_id"), F.col("parent_id").isNotNull(), rest)
    places = F.when(F.col("parent_id").isNull(), F.array(asking)).otherwise(F.array(asking, place(F.col("provision_id"), F.lit(False), F.when(F.lit(False), rest))))
    met = dealt.select("_root", F.inline(places)).withColumn("_by_id", F.min(F.when(~F.col("_asks"), F.col("line"))).over(W.partitionBy("_root", "_key"))).filter("_rest is not null")
    found = F.coalesce(F.when(F.col("_asks"), F.col("_by_id")), F.col("_rest._by_label"))
    return met.select(*[F.col("line") if c == "line" else F.col("_rest")[c].alias(c) for c in columns], found.alias("parent_line"))


def enriched(provisions: DataFrame) -> DataFrame:
    """Add parent_context and retrieval_text; the source line itself is never changed.

    Points take their clause's lead-in, clauses their article's line. Where the parent is no row of the document, the
    text in ``context_text`` (if there is such a column) is searched: for the clause of that number, for the last clause
    behind the last article, for the last article's heading. The whole context is never put before points and clauses.
    """
    up = with_parents(provisions if "context_text" in provisions.columns else provisions.withColumn("context_text", F.lit(None).cast("string")))
    own, parent = F.col("context_text"), F.col("parent_line")
    point = F.when(parent.isNotNull(), clause_lead_in(F.col("clause"), parent)).otherwise(F.coalesce(lead_in_by_number(own, F.col("clause")), lead_in_after_article(own)))
    clause = F.when(parent.isNotNull(), _stripped(parent)).otherwise(article_heading(own))
    lead = F.when(F.col("kind") == "POINT", point).when(F.col("kind") == "CLAUSE", clause).otherwise(_stripped(own))
    text = F.when(F.col("kind").isin("POINT", "CLAUSE"), F.concat_ws(" ", "parent_context", "line")).otherwise(F.col("line"))
    return up.withColumn("parent_context", F.nullif(lead, F.lit(""))).withColumn("retrieval_text", text)


def as_compared(text: Column) -> Column:
    """32 bytes (SHA-256) that tell a text but for its white space.

    The text is that of ``collapsed``; single blanks stay untouched, as replacing each of them takes most of the time.
    """
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("  "), F.lit(" "))
    return F.unhex(F.sha2(F.trim(F.regexp_replace(text, r"(?U)[\s&&[^ ]]\s*| \s+", " ")), 256))


def gold_match(provisions: DataFrame, gold: DataFrame) -> DataFrame:
    """provision_id, matches: annotated provisions that were extracted, and whether their retrieval text is the expected one but for white space.

    Texts meet as digests. Either table may bring them made (retrieval_digest, expected_digest, by ``as_compared``) instead of its text.
    """
    brought = lambda df, digest, text: F.col(digest) if digest in df.columns else as_compared(F.col(text)).alias(digest)
    left = gold.select("provision_id", brought(gold, "expected_digest", "expected"))
    return left.join(provisions.select("provision_id", brought(provisions, "retrieval_digest", "retrieval_text")), "provision_id").select("provision_id", (F.col("retrieval_digest") == F.col("expected_digest")).alias("matches"))


def completeness(provisions: DataFrame) -> DataFrame:
    """Share of points and clauses with a context; 0.0 when there is none."""
    has = (F.coalesce(F.trim("parent_context"), F.lit("")) != "").cast("double")
    return provisions.filter(F.col("kind").isin("POINT", "CLAUSE")).agg(F.coalesce(F.round(F.avg(has), 6), F.lit(0.0)).alias("completeness"), F.count("*").alias("n"))
