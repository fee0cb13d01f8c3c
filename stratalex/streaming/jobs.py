"""Job messages as a stream: a stage machine with keyed state, retries, a dead-letter sink and event windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Stages in order. A message for a stage that the job has passed is a redelivery and changes nothing.
STAGES = ("RECEIVED", "PARSED", "NORMALIZED", "EXTRACTED", "STAGED", "GATED", "EMBEDDED", "INDEXED")
TERMINAL = ("STAGED", "INDEXED", "FAILED")
RETRIES, FIRST_WAIT, LONGEST_WAIT = 3, 15, 3600


def stage_index(stage: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage).cast("int") - 1


def job_status(messages: DataFrame) -> DataFrame:
    """Batch form: job_id, furthest stage, messages, redeliveries (messages at or below a stage reached before)."""
    at = stage_index(F.col("stage"))
    before = F.max(at).over(W.partitionBy("job_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1))
    marked = messages.withColumn("_at", at).withColumn("_old", F.coalesce(before >= at, F.lit(False)))
    return marked.groupBy("job_id").agg(F.max("_at").alias("_at"), F.count("*").alias("messages"), F.sum(F.col("_old").cast("int")).alias("redeliveries")).select("job_id", F.element_at(F.array(*[F.lit(s) for s in STAGES]), F.col("_at") + 1).alias("stage"), "messages", "redeliveries")


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    at, seen = state.get if state.exists else (-1, 0)
    for frame in frames:
        for stage in frame.sort_values(["ts", "event_id"])["stage"]:
            seen += 1
            if stage in STAGES and STAGES.index(stage) > at:
                at = STAGES.index(stage)
    state.update((at, seen))
    yield pd.DataFrame({"job_id": [key[0]], "stage": [STAGES[at] if at >= 0 else None], "messages": [seen]})


def job_states(messages: DataFrame) -> DataFrame:
    """Streaming form: the state of each job after every batch; stages never go back, however messages repeat."""
    return messages.groupBy("job_id").applyInPandasWithState(_advance, "job_id long, stage string, messages long", "at int, seen long", "update", GroupStateTimeout.NoTimeout)


def retry_plan(failures: DataFrame, most: int = RETRIES) -> DataFrame:
    """Add attempt, wait_s and outcome: transient failures are retried with doubled waits, others go to dead letter."""
    attempt = F.row_number().over(W.partitionBy("job_id", "stage").orderBy("ts", "event_id"))
    wait = F.least(F.lit(LONGEST_WAIT), F.lit(FIRST_WAIT) * F.pow(F.lit(2), F.col("attempt") - 1)).cast("long")
    retry = F.col("transient") & (F.col("attempt") < most)
    return failures.withColumn("attempt", attempt).withColumn("outcome", F.when(retry, "retry").otherwise("dead_letter")).withColumn("wait_s", F.when(retry, wait))


def without_redelivery(messages: DataFrame, per: str = "1 minute") -> DataFrame:
    """The first message of each (job, stage, minute)."""
    slot = F.date_trunc("minute", "ts") if per == "1 minute" else F.window("ts", per)["start"]
    first = F.row_number().over(W.partitionBy("job_id", "stage", slot).orderBy("ts", "event_id"))
    return messages.withColumn("_n", first).filter("_n = 1").drop("_n")


def stream_without_redelivery(messages: DataFrame, late: str = "10 minutes") -> DataFrame:
    return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job_id", "stage"])


def windowed(events: DataFrame, size: str = "1 hour") -> DataFrame:
    """Count and value of each event type in tumbling windows; over a stream, after ``withWatermark``."""
    return events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: runs of events with less than ``gap`` between them."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def split_sink(ok_path: str, dead_path: str):
    """``foreachBatch`` function: rows with outcome dead_letter to one sink, the others to another, each batch once."""

    def write(batch: DataFrame, number: int) -> None:
        for test, path in (("outcome = 'dead_letter'", dead_path), ("outcome != 'dead_letter'", ok_path)):
            batch.filter(test).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
