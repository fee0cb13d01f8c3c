"""Event-time windows over a stream: sliding, with a watermark, each window written once when it is closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sliding(events: DataFrame, size: str, slide: str, *by: str) -> DataFrame:
    """window_start, window_end, ``by``, n and total of the values in windows of ``size`` that begin every ``slide``."""
    w = F.window("ts", size, slide).alias("w")
    counted = events.groupBy(w, *by).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def closed_windows(events: DataFrame, late: str, size: str, slide: str, *by: str) -> DataFrame:
    """``sliding`` over a stream in append mode: a window is final when the watermark, ``late`` behind the newest row, passes its end.

    A row that comes after that is dropped from the window; windows that are still open take it.
    """
    return sliding(events.withWatermark("ts", late), size, slide, *by)


def late_rows(closed: DataFrame, events: DataFrame, size: str, slide: str, *by: str) -> DataFrame:
    """``closed`` with ``late``: rows of each closed window that came too late to be in it, from all ``events``."""
    every = sliding(events, size, slide, *by).withColumnRenamed("n", "_n").select("window_start", *by, "_n")
    held = closed.join(every, ["window_start", *by])
    return held.withColumn("late", F.col("_n") - F.col("n")).drop("_n")


def watermark_after(events: DataFrame, late_seconds: int) -> Column:
    """Where the watermark stands after all of ``events``, as a timestamp in whole milliseconds."""
    return F.date_trunc("millisecond", F.max("ts")) - F.make_dt_interval(secs=F.lit(late_seconds).cast("decimal(18,6)"))
