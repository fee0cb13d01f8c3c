"""Exact dedup by deterministic block naming (Karp, Miller and Rosenberg's naming, as joins).

A text without its white space is cut into blocks of ``block_chars`` characters. Distinct blocks are sorted and
numbered; then adjacent pairs of numbers are numbered in turn, until one number stands for each text. Two texts
have the same number after as many rounds exactly when they are equal: no equality of blocks rests on a fingerprint.
Only rows that share a doc_id (or have none) are told apart by 128 bits of their texts and the length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Workspace, shuffle_width, without_white

#: Stands for a null doc_id in keys; sorts after every real id.
NO_ID = (1 << 63) - 1


def row_key(text: Column) -> Column:
    """Tells rows of one doc_id apart: 128 bits of the text and its length."""
    return F.concat_ws(":", F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(1), text)), F.length(text))


def fingerprint(block: Column) -> Column:
    return F.xxhash64(block)


def _blocks(text: Column, block_chars: int) -> Column:
    """Blocks in order; an empty text has none. One pass over the text however long it is."""
    cut = F.regexp_extract_all(text, F.lit(r"(?s).{1,%d}+" % block_chars), F.lit(0))  # a class such as [\s\S] is forty times slower
    return F.when(text == "", F.array().cast("array<string>")).when(F.length(text) <= block_chars, F.array(text)).otherwise(cut)


def numbered(distinct: DataFrame, *by: str) -> DataFrame:
    """Give each row of ``distinct`` an integer: its place in the sorted range it falls in, ranges interleaved."""
    ranges = 4 * shuffle_width(distinct.sparkSession)
    at = F.pmod(F.xxhash64(*by), F.lit(ranges)).cast("long")
    place = F.row_number().over(W.partitionBy("_at").orderBy(*by)).cast("long")
    return distinct.withColumn("_at", at).withColumn("name", place * ranges + F.col("_at")).drop("_at")


def name_documents(docs: DataFrame, space: Workspace, block_chars: int = 2048, hash_of=fingerprint) -> DataFrame:
    """One row per row of ``docs``: doc_id, _id, _row, n_chars, text_sha256, level, name.

    (level, name) is the text's identity. ``_id`` is doc_id with null as ``NO_ID``; (_id, _row) tells rows apart
    unless they repeat one another. ``hash_of`` only routes blocks: blocks whose fingerprints clash are numbered
    by their content.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), text.alias("_text"))
    rows = rows.withColumn("_bare", without_white(F.col("_text")))
    keyed = rows.select(
        "doc_id", "_id", row_key(F.col("_text")).alias("_row"), F.length("_text").cast("long").alias("n_chars"), F.sha2("_bare", 256).alias("text_sha256"),
        F.transform(_blocks(F.col("_bare"), block_chars), hash_of).alias("_hashes"),
    )
    keyed = space.save(keyed, "keyed")
    spread = rows.select("_id", row_key(F.col("_text")).alias("_row"), F.posexplode(_blocks(F.col("_bare"), block_chars)).alias("pos", "block"))

    # The texts are shuffled once, by block; from here on only integers move.
    distinct = spread.select(hash_of(F.col("block")).alias("hash"), "block").distinct()
    prints = numbered(distinct.groupBy("hash").agg(F.count("*").alias("blocks")), "hash")
    prints = space.save(prints, "prints")
    first = keyed.select("_id", "_row", F.posexplode("_hashes").alias("pos", "hash")).join(prints.filter("blocks = 1"), "hash").select("_id", "_row", "pos", "name")
    clashing = prints.filter("blocks > 1").select("hash")
    if not clashing.isEmpty():
        rest = space.save(spread.withColumn("hash", hash_of(F.col("block"))).join(clashing, "hash"), "clashing")
        named = numbered(rest.select("hash", "block").distinct(), "hash", "block").withColumn("name", -F.col("name"))
        first = first.unionByName(rest.join(named, ["hash", "block"]).select("_id", "_row", "pos", "name"))
    size = keyed.select("_id", "_row", F.size("_hashes").alias("left")).distinct()
    now = space.save(first.join(size, ["_id", "_row"]).distinct(), "level0")

    done, level = [now.filter("left = 1").select("_id", "_row", F.lit(0).alias("level"), "name")], 0
    most = now.agg(F.max("left")).first()[0] or 0
    while most > 1:
        level += 1
        most = (most + 1) // 2
        even = F.col("pos") % 2 == 0
        pairs = (
            now.filter("left > 1")
            .groupBy("_id", "_row", F.expr("cast(pos div 2 as int)").alias("pos"), F.expr("cast((left + 1) div 2 as int)").alias("left"))
            .agg(F.max(F.when(even, F.col("name"))).alias("one"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(0)).alias("two"))
        )
        now = space.save(pairs.join(numbered(pairs.select("one", "two").distinct(), "one", "two"), ["one", "two"]).select("_id", "_row", "pos", "left", "name"), f"level{level}")
        done.append(now.filter("left = 1").select("_id", "_row", F.lit(level).alias("level"), "name"))
    identity = done[0]
    for more in done[1:]:
        identity = identity.unionByName(more)
    return keyed.drop("_hashes").join(identity, ["_id", "_row"], "left").select(
        "doc_id", "_id", "_row", "n_chars", "text_sha256", F.coalesce("level", F.lit(-1)).alias("level"), F.coalesce("name", F.lit(0)).alias("name")
    )


def exact_groups(docs: DataFrame, block_chars: int = 2048, hash_of=fingerprint) -> DataFrame:
    """Groups of documents whose texts are equal but for white space.

    Of a group the row with most characters stays, then the smallest doc_id. One row per row of ``docs``:
    doc_id, keep_id, group_size, kept, text_sha256 and the keys _id, _row. A null text counts as empty, a null
    doc_id sorts last and is returned as null. Of rows that repeat both doc_id and text, one is kept. Other columns
    of ``docs``, whatever their names, are not read; an empty table gives an empty result.
    """
    space = Workspace(docs.sparkSession, "exact-dedup")
    named = space.save(name_documents(docs, space, block_chars, hash_of), "named")
    space.drop("keyed", "prints", "clashing", *(f"level{i}" for i in range(64)))
    groups = named.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("n_chars")).alias("less"), "_id", "_row")).alias("keep"))
    groups = space.save(groups, "groups")  # a table, so that the join below has two plain shuffles and large groups can be split
    again = F.row_number().over(W.partitionBy("_id", "_row").orderBy("_id"))
    return (
        named.join(groups, ["level", "name"])
        .withColumn("again", again)
        .select(
            "doc_id", F.when(F.col("keep._id") != NO_ID, F.col("keep._id")).alias("keep_id"), "group_size",
            ((F.col("_id") == F.col("keep._id")) & (F.col("_row") == F.col("keep._row")) & (F.col("again") == 1)).alias("kept"), "text_sha256", "_id", "_row",
        )
    )


def drop_copies(docs: DataFrame, block_chars: int = 2048) -> DataFrame:
    """``docs`` with one row of each group of equal texts; columns unchanged."""
    kept = exact_groups(docs, block_chars).filter("kept").select("_id", "_row")
    text = F.coalesce(F.col("text"), F.lit(""))
    held = docs.select(F.struct(*docs.columns).alias("_doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), row_key(text).alias("_row"))
    return held.join(kept, ["_id", "_row"], "left_semi").dropDuplicates(["_id", "_row"]).select("_doc.*")
