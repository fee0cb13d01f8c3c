"""Index upkeep as a stream: batches are merged by a deterministic id, replays change nothing, failing batches are recorded.

The index is a base and the batches since, one folder each. A batch that runs again writes its own folder again, and readers
take the newest row of an id, so a crash between a write and its commit leaves no trace. Compaction
folds batches into a new base; the base in force is named by its last batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalex.operators.index import last_wins

FAILURES = "batch long, rows long, error string, recorded_at timestamp"


class StreamIndex:
    """An index of points under ``root``: ``schema`` has ``key`` and the columns that a batch delivers.

    ``write`` is a ``foreachBatch`` function. ``build`` turns a micro-batch into points; what it raises is recorded
    with the batch's number, and the stream goes on. Of the rows of one id in a batch the last by ``order`` wins; a
    row without an id is no point.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "point_id", order: str = "seq", build: Callable[[DataFrame], DataFrame] = lambda batch: batch):
        self.spark, self.root, self.key, self.order, self.build = spark, root.rstrip("/"), key, order, build
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def write(self, batch: DataFrame, number: int) -> None:
        try:
            points = last_wins(self.build(batch).filter(F.col(self.key).isNotNull()), self.key, self.order).select(*self.schema.fieldNames())
            points.write.mode("overwrite").parquet(f"{self.root}/batches/batch={number}")
            error = None
        except Exception as raised:  # the batch's own fault or its builder's: the next batches do not depend on it
            error = str(raised).split("\n")[0][:500]
            self._delete(f"{self.root}/batches/batch={number}")
        if error is None:
            self._delete(f"{self.root}/failures/batch={number}")
        else:
            row = batch.agg(F.count("*").alias("rows")).select("rows", F.lit(error).alias("error"), F.current_timestamp().alias("recorded_at"))
            row.write.mode("overwrite").parquet(f"{self.root}/failures/batch={number}")

    def points(self) -> DataFrame:
        """The index as it stands: of each id the row of the newest batch."""
        base, last = self._base()
        fresh = self._batches().filter(F.col("batch") > last)
        newest = fresh.groupBy(self.key).agg(F.max("batch").alias("batch"))
        rows = fresh.join(newest, [self.key, "batch"], "left_semi").drop("batch").select(*self.schema.fieldNames())
        if base is None:
            return rows
        return base.join(newest, self.key, "left_anti").select(*self.schema.fieldNames()).unionByName(rows)

    def failures(self) -> DataFrame:
        """batch, rows, error and recorded_at of the batches that failed."""
        return self._read("failures", T.StructType.fromDDL(FAILURES.split(", ", 1)[1])).select("batch", "rows", "error", "recorded_at")

    def compact(self) -> None:
        """Fold the batches into a new base. A crash before its marker leaves the old base in force; folded folders are deleted last."""
        top = self._batches().agg(F.max("batch")).first()[0]
        _, last = self._base()
        if top is None or top <= last:
            return
        self.points().write.mode("overwrite").parquet(f"{self.root}/bases/upto={top}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.root}/bases/done={top}")
        for number in [r.batch for r in self._batches().filter(F.col("batch") <= top).select("batch").distinct().collect()]:  # a row for each batch
            self._delete(f"{self.root}/batches/batch={number}")
        for old in self._numbers("bases", "done"):
            if old < top:
                self._delete(f"{self.root}/bases/done={old}")
                self._delete(f"{self.root}/bases/upto={old}")

    def _base(self) -> tuple[DataFrame | None, int]:
        done = self._numbers("bases", "done")
        if not done:
            return None, -1
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/bases/upto={max(done)}"), max(done)

    def _batches(self) -> DataFrame:
        return self._read("batches", self.schema)

    def _read(self, folder: str, schema: T.StructType) -> DataFrame:
        whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        if not self._numbers(folder, "batch"):
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(f"{self.root}/{folder}")

    def _numbers(self, folder: str, name: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        names = [x.getPath().getName() for x in files.listStatus(path)]
        return [int(x.split("=")[1]) for x in names if x.startswith(f"{name}=")]

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
