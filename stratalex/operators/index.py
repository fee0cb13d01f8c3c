"""A derived index kept in step with its authoritative rows: diff, repair, rebuild, versions and an alias."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalex.functions.text import leaked_header, provision_text
from stratalex.sources.stored import stored


def units(provisions: DataFrame) -> DataFrame:
    """Retrieval units of accepted, dated provisions: unit_id, point_id, text, hash and the payload's fields."""
    good = provisions.filter("review_status = 'ACCEPTED' and effective_from is not null")
    unit = F.concat_ws("__v", "provision_id", F.col("version").cast("string"))
    logical = F.when(F.col("provision_id").contains("__"), F.substring_index("provision_id", "__", 1))
    return good.select(unit.alias("unit_id"), F.sha2(unit, 256).alias("point_id"), "provision_id", "version", logical.alias("document_id"), "content_hash", "effective_from", "effective_to")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, with ``position`` the order of its first."""
    newest = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    first = F.min(order).over(W.partitionBy(key))
    return rows.withColumn("position", first).withColumn("_n", newest).filter("_n = 1").drop("_n")


def diff(authority: DataFrame, index: DataFrame) -> DataFrame:
    """point_id, state: missing from the index, extra in it, or stale (hash differs or is unknown). One full join."""
    a = authority.select("point_id", F.col("content_hash").alias("_a"), F.lit(True).alias("_in_a"))
    i = index.select("point_id", F.col("content_hash").alias("_i"), F.lit(True).alias("_in_i"))
    state = F.when(F.col("_in_i").isNull(), "missing").when(F.col("_in_a").isNull(), "extra").when(~F.col("_a").eqNullSafe(F.col("_i")) | F.col("_i").isNull(), "stale")
    return a.join(i, "point_id", "full").select("point_id", state.alias("state")).filter(F.col("state").isNotNull())


def reconciled(authority: DataFrame, index: DataFrame) -> DataFrame:
    """The repaired index: stale and missing points from the authority, extra points gone, others as they are."""
    state = diff(authority, index)
    kept = index.select("point_id", "content_hash").join(state, "point_id", "left_anti")
    fresh = authority.select("point_id", "content_hash").join(state.filter(F.col("state") != "extra"), "point_id", "left_semi")
    return kept.unionByName(fresh)


def repair_plan(authority: DataFrame, index: DataFrame) -> DataFrame:
    """What ``reconciled`` would do, without doing it: action (upsert, delete), state, points."""
    action = F.when(F.col("state") == "extra", "delete").otherwise("upsert").alias("action")
    return diff(authority, index).groupBy(action, "state").agg(F.count("*").alias("points"))


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class VersionedIndex:
    """Immutable versions under one root, and an alias file that names the current one.

    A version is written once (a name in use is refused); the alias is one file, replaced by an overwriting rename, so
    readers see either the old or the new version whole. Works on any file system that Spark reaches. What was never
    written reads as empty, with the columns of ``schema``.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str = "point_id string, content_hash string"):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def write(self, version: str, points: DataFrame, *partition: str) -> None:
        writer = points.write.mode("errorifexists")
        (writer.partitionBy(*partition) if partition else writer).parquet(f"{self.root}/versions/{version}")

    def read(self, version: str | None = None) -> DataFrame:
        fs, p = _path(self.spark, f"{self.root}/versions/{version or self.current()}")
        return self.spark.read.parquet(str(p)) if fs.exists(p) else self.spark.createDataFrame([], self.schema)

    def current(self) -> str | None:
        fs, p = _path(self.spark, f"{self.root}/alias")
        return self.spark.read.text(f"{self.root}/alias").first()[0] if fs.exists(p) else None

    def switch(self, version: str, expected: int) -> bool:
        """Name ``version`` current if it holds ``expected`` points; a partial rebuild leaves the alias alone."""
        if self.read(version).count() != expected:
            return False
        fresh = f"{self.root}/alias.next"
        self.spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(fresh)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        part = next(f.getPath() for f in _path(self.spark, fresh)[0].listStatus(_path(self.spark, fresh)[1]) if f.getPath().getName().startswith("part-"))
        _, target = _path(self.spark, f"{self.root}/alias")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(conf).getUri(), conf)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        files.rename(part, target, options)
        return True

    def rebuild(self, version: str, authority: DataFrame) -> bool:
        self.write(version, authority)
        return self.switch(version, authority.count())


def payload(units_: DataFrame, documents: DataFrame) -> DataFrame:
    """Index payload: the unit's fields with its document's number, type, title and status as one struct."""
    d = documents.select("document_id", "document_number", "document_type", "document_title", "document_status")
    joined = units_.join(d, "document_id", "left")
    fields = [c for c in joined.columns if c not in ("point_id",)]
    return joined.select("point_id", F.struct(*fields).alias("payload"))


def upserted(index: DataFrame, batch: DataFrame, key: str = "point_id", order: str = "seq") -> DataFrame:
    """The index after an idempotent upsert: within the batch the last row of a key wins, and it replaces the old one."""
    fresh = last_wins(batch, key, order).select(*index.columns)
    return index.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def filled(vectors: DataFrame) -> DataFrame:
    """Sparse vectors that have weights; empty ones are not sent."""
    return vectors.filter(F.size("indices") > 0)


def index_accepted(provisions: DataFrame, vectors: DataFrame, index: DataFrame, encoder_version: str) -> tuple[DataFrame, DataFrame]:
    """The index after all accepted, dated provisions with weights are upserted, and the counts of what was done.

    ``vectors``: unit_id, indices, values of the same encoder; ``index``: point_id, content_hash, sparse_encoder_version,
    indices, values. Points of another encoder version never stay beside the new ones: two sparse spaces do not mix.
    """
    ready = units(provisions).join(filled(vectors), "unit_id", "left")
    points = ready.filter(F.col("indices").isNotNull()).select("point_id", "content_hash", F.lit(encoder_version).alias("sparse_encoder_version"), "indices", "values")
    kept = index.filter(F.col("sparse_encoder_version") == encoder_version).join(points.select("point_id"), "point_id", "left_anti")
    accepted = F.col("review_status") == "ACCEPTED"
    total = lambda test: F.sum(test.cast("long"))
    read = provisions.agg(total(accepted).alias("accepted"), total(accepted & F.col("effective_from").isNull()).alias("skipped_no_effective_from"))
    sent = ready.agg(total(F.col("indices").isNotNull()).alias("upserted"), total(F.col("indices").isNull()).alias("skipped_empty"))
    return kept.unionByName(points), read.join(F.broadcast(sent))  # two single rows


def projected(provisions: DataFrame, documents: DataFrame) -> DataFrame:
    """Stored rows of extracted provisions: the document's dates and status where it gives them, else their own.

    A provision whose text or retrieval text is page furniture is PENDING whatever was asked for; ``hash_matches``
    tells whether the extractor's hash is that of the text.
    """
    d = documents.select("document_id", *[F.col(c).alias(f"_{c}") for c in ("status", "effective_from", "effective_to", "review_status")])
    joined = provisions.join(d, "document_id", "left")
    leaked = leaked_header(F.col("source_text")) | leaked_header(F.col("retrieval_text"))
    over = {c: F.coalesce(f"_{c}", c) for c in ("status", "effective_from", "effective_to")}
    review = F.when(leaked, "PENDING").otherwise(F.coalesce("_review_status", "review_status"))
    out = joined.withColumns(over | {"review_status": review, "leaked": leaked, "retrieval_text": provision_text(F.col("retrieval_text")), "hash_matches": F.sha2("source_text", 256) == F.col("content_hash")})
    return out.drop(*[f"_{c}" for c in ("status", "effective_from", "effective_to", "review_status")])


def batches(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """``rows`` with ``batch`` and ``place`` (both from 0): runs of ``size`` in order, within the ranges of a range sort.

    Ranges are numbered where the rows lie, then offset by the rows before them, so no task sorts it all.
    """
    # Written once, so that counts and rows speak of the same ranges.
    ranged = stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    return ranged.withColumn("_i", inside).join(F.broadcast(before), "_part").withColumn("_at", (F.col("_before") + F.col("_i") - 1).cast("long")).withColumn("batch", F.floor(F.col("_at") / size)).withColumn("place", F.col("_at") % size).drop("_part", "_i", "_before", "_at")


def valid_units(units_: DataFrame, day) -> DataFrame:
    """Units valid on ``day``, the filter on plain columns so that it reaches the files."""
    return units_.filter((F.col("effective_from") <= day) & (F.col("effective_to").isNull() | (F.col("effective_to") > day)))


def unit_counts(units_: DataFrame) -> DataFrame:
    """Units of each kind and their total, as one rollup; the total's kind is null."""
    return units_.rollup("node_kind").agg(F.count("*").alias("n"))
