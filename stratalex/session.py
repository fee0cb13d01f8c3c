"""Session factory: UTC, adaptive execution, shuffle width left to the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "stratalex", master: str | None = None, **conf: str) -> SparkSession:
    build = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        build = build.master(master)
    for key, value in conf.items():
        build = build.config(key.replace("_", "."), value)
    return build.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
