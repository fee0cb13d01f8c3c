"""Shared pieces of the training-data operators: durable tables, word rules and prefix sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of every contract: space and U+0009 to U+000D. Java and Python read it alike.
WHITE = r"[\x20\x09-\x0D]"
WHITE_CHARS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local master uses the machine's
    temporary folder and any other master the warehouse, which is shared by definition.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):
        return f"{tempfile.gettempdir()}/stratalex-shared"
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/stratalex-shared"


#: Spark's setting that deletes a query's shuffle files when it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Intermediate tables of one run, written to the shared folder so that a lost executor loses nothing."""

    #: Workspaces of this driver, oldest first.
    opened: list[Workspace] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.opened.append(self)

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write ``df``, in folders by the column ``by`` if given, and return it as a scan: the lineage ends here."""
        path, before = f"{self.root}/{name}", self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            (df.write.partitionBy(by) if by else df.write).parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            self._delete(f"{self.root}/{name}")

    @classmethod
    def close_since(cls, opened: int) -> None:
        """Delete the workspaces opened after the first ``opened`` ones: what they led to is written elsewhere."""
        for space in cls.opened[opened:]:
            space._delete(space.root)
        del cls.opened[opened:]

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_white(text: Column) -> Column:
    """``text`` without its white space; plain replacement is several times faster than a regular expression."""
    for char in WHITE_CHARS:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def word_list(text: Column) -> Column:
    """Words of ``text`` as an array; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE + "+"))


def word_count(text: Column) -> Column:
    return F.size(word_list(text)).cast("long")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def power_of_two(n: float, least: int) -> int:
    return max(least, 1 << max(0, int(n) - 1).bit_length())
