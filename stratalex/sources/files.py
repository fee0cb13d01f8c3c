"""Files in and out: manifests, annotations, vocabularies, run records, stored parses and uploads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

# Fields of a manifest and the buckets of the object store.
MANIFEST_FIELDS = (
    "document_id", "source_url", "downloaded_at", "file_hash", "document_number", "document_type", "issuer", "issued_date",
    "effective_from", "effective_to", "status", "relation_notes", "review_status", "reviewed_by", "reviewed_at",
)
MANIFEST = T.StructType([T.StructField(f, T.StringType()) for f in MANIFEST_FIELDS])


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """All ``*.manifest.json`` below ``root``, one row each; the schema is closed, other fields are not read."""
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).option("pathGlobFilter", "*.manifest.json").option("multiLine", True).json(root)


def annotations(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def first_available(candidates: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first candidate that has each key."""
    every = None
    for i, df in enumerate(candidates):
        part = df.withColumn("_turn", F.lit(i))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    return every.withColumn("_first", F.min("_turn").over(W.partitionBy(key))).filter("_turn = _first").drop("_turn", "_first")


def object_key(*parts: Column) -> Column:
    """Storage key; null if a part would leave its folder."""
    joined = F.concat_ws("/", *parts)
    return F.when(~joined.rlike(r"(^|/)\.\.(/|$)|^/|//|\\"), joined)


def write_once(df: DataFrame, path: str, kind: str = "json") -> None:
    """Write a run's record; a path in use is refused."""
    df.write.mode("errorifexists").format(kind).save(path)


def vocabulary(spark: SparkSession, root: str, version: str, built: DataFrame) -> DataFrame:
    """The stored vocabulary of ``version``; ``built`` is stored first if there is none. What is returned was read back."""
    path = f"{root}/vocab/version={version}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        built.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def accepted_uploads(uploads: DataFrame, known: DataFrame, most_bytes: int = 50_000_000, kinds=("application/pdf", "text/plain"), extensions: tuple[str, ...] = (".pdf",)) -> DataFrame:
    """Uploads of a good name, type and size whose content (file_hash) is new; of equal ones the first by upload_id.

    The extension of file_name decides, in either case; a missing name stands for a good one, and so does a missing type. A
    size that is not known is refused. Uploads without a hash are equal to nothing and each stays.
    """
    named = F.lit(True) if "file_name" not in uploads.columns else F.col("file_name").isNull() | F.lower(F.regexp_extract("file_name", r"(\.[^./\\\\]*)$", 1)).isin(*extensions)
    good = uploads.filter(named & (F.col("mime").isNull() | F.col("mime").isin(*kinds)) & (F.col("bytes") <= most_bytes))
    first = F.row_number().over(W.partitionBy("file_hash", F.when(F.col("file_hash").isNull(), F.col("upload_id"))).orderBy("upload_id"))
    return good.withColumn("_n", first).filter("_n = 1").drop("_n").join(known.select("file_hash"), "file_hash", "left_anti")


class ObjectStore:
    """Objects under one root of any file system that Spark reaches: put, get, delete and list, by safe keys."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, key: str):
        if key.startswith("/") or "\\" in key or any(part in ("", "..") for part in key.split("/")):
            raise ValueError(f"unsafe key {key!r}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def put(self, key: str, content: bytes) -> None:
        """Write one object, whole; an object of the key is replaced."""
        fs, path = self._at(key)
        out = fs.create(path, True)
        out.write(bytearray(content))
        out.close()

    def get(self, key: str) -> bytes:
        fs, path = self._at(key)
        if not fs.exists(path):
            raise KeyError(key)
        return bytes(self.spark.read.format("binaryFile").load(path.toString()).first()["content"])

    def delete(self, key: str) -> bool:
        fs, path = self._at(key)
        return bool(fs.delete(path, False))

    def list(self, prefix: str = "") -> DataFrame:
        """key, bytes of the objects whose key begins with ``prefix``; the listing is a table, the contents are not read."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.root).select("path", "length")
        root = self._at("x")[1].getParent().toUri().getPath()
        key = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^.*?" + re.escape(root) + "/", "")
        return files.select(key.alias("key"), F.col("length").alias("bytes")).filter(F.col("key").startswith(prefix))
