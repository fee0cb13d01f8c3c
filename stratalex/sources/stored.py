"""Intermediate tables in the folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Tables of this driver by application, name and state of their source.
_BUILT: dict[tuple, DataFrame] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, the machine's folder for a local master, else the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named
    return f"{tempfile.gettempdir()}/stratalex-shared" if spark.sparkContext.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir')}/stratalex-shared"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a scan of it: what reads it several times does not build it again, and joins see its size.

    The table is deleted when the driver ends.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _until_the_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_once(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` makes of the file or folder ``source``, built once for each state of it (files, sizes, times) and driver."""
    place = spark._jvm.org.apache.hadoop.fs.Path(source)
    files, found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place), []
    for file in files:
        found.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    key = (spark.sparkContext.applicationId, name, tuple(sorted(found)))
    if key not in _BUILT:
        _BUILT[key] = stored(build(), name)
    return _BUILT[key]


def _until_the_end(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
