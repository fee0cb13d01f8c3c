"""Queries that run as streams over the supplied tables, to their end, and are held against batch SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.session import table
from stratalex.sources.stored import shared_folder
from stratalex.streaming import event_time as et
from stratalex.streaming import limits as li
from stratalex.streaming.upsert import StreamIndex

from . import views as v
from .catalog import query

#: Limits of the query: minutes instead of seconds, as the events of a user are hours apart.
LIMITS = {stage: 60 * n for stage, n in li.LIMITS.items()}


def _root(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def _run(stream: DataFrame, root: str, mode: str, write: Callable[[DataFrame, int], None]) -> None:
    """Run ``stream`` over all that is there, from where its checkpoint ends."""
    sink = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").outputMode(mode)
    sink.trigger(availableNow=True).start().awaitTermination()


def _to(folder: str) -> Callable[[DataFrame, int], None]:
    """Each batch to a folder of its own: one that is run again replaces it."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def _arriving(s: SparkSession, rows: DataFrame, root: str) -> Callable[[int], DataFrame]:
    """The rows as they arrive: slice k is appended to a folder, and the stream over that folder is returned."""
    rows.write.partitionBy("slice").parquet(f"{root}/arrivals")
    schema = rows.drop("slice").schema

    def arrive(k: int) -> DataFrame:
        s.read.parquet(f"{root}/arrivals").filter(F.col("slice") == k).drop("slice").write.mode("append").parquet(f"{root}/in")
        return s.readStream.schema(schema).parquet(f"{root}/in")

    return arrive


_LIMIT_CASE = "CASE stage " + " ".join(f"WHEN '{stage}' THEN {n}" for stage, n in LIMITS.items()) + " END"


@query(
    f"""WITH {v.MESSAGES}, u AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY AS until FROM events), m AS (SELECT event_id, ts, job_id * 100 + day(ts) AS job_id, stage, place FROM messages, u WHERE ts <= until),
    steps AS (SELECT * FROM (SELECT *, max(place) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m) WHERE before IS NULL OR place > before),
    ends AS (SELECT *, ts + to_seconds({_LIMIT_CASE}) AS fin, lead(ts) OVER (PARTITION BY job_id ORDER BY place) AS nxt FROM steps), overdue AS (SELECT *, coalesce(fin <= until AND (nxt IS NULL OR nxt > fin), false) AS late FROM ends, u),
    kept AS (SELECT * FROM (SELECT *, coalesce(max(late::INT) OVER (PARTITION BY job_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM overdue) WHERE gone = 0),
    out AS (SELECT job_id, stage, ts AS entered, lag(stage) OVER (PARTITION BY job_id ORDER BY place) AS left_stage FROM kept UNION ALL SELECT job_id, 'FAILED', fin, stage FROM kept WHERE late)
    SELECT job_id, stage, strftime(entered, '%Y-%m-%d %H:%M:%S.%f') AS entered_at, left_stage FROM out"""
)
def stage_time_limits(s: SparkSession, d: str) -> DataFrame:
    """Jobs of a user's day as a stream with a limit for every stage: each step, and FAILED once where a limit passes."""
    root = _root(s, "limits")
    raw = s.readStream.schema(table(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    kind = F.col("event_type")
    stage = F.when(kind == "signup", "RECEIVED").when(kind == "view", "PARSED").when(kind == "click", "NORMALIZED").when(kind == "purchase", "EXTRACTED").otherwise("STAGED")
    messages = raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("job_id"), stage.alias("stage"))
    stream = li.stream_transitions(messages, "1 day", LIMITS)
    _run(stream, root, "append", _to(f"{root}/out"))
    return s.read.schema(stream.schema).parquet(f"{root}/out").select("job_id", "stage", F.date_format("entered_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("entered_at"), "left_stage")


_ARRIVAL = "ts + to_hours(CASE WHEN event_id % 5 = 0 THEN event_id % 72 ELSE 0 END)"


@query(
    f"""WITH e AS (SELECT ts, event_type, CAST(value AS DECIMAL(18, 4)) AS value, CAST(least(3, date_diff('day', (SELECT min(ts) FROM events)::DATE, ({_ARRIVAL})::DATE) // 8) AS INT) AS slice FROM events),
    marks AS (SELECT slice, date_trunc('millisecond', max(max(ts)) OVER (ORDER BY slice)) - INTERVAL 12 HOUR AS mark FROM e GROUP BY slice), before AS (SELECT slice, lag(mark) OVER (ORDER BY slice) AS mark FROM marks),
    w AS (SELECT e.*, TIMESTAMP '1970-01-01' + to_seconds(CAST((epoch_us(ts) // 7200000000 - k) * 7200 AS BIGINT)) AS window_start FROM e, (SELECT unnest(range(3)) AS k)),
    told AS (SELECT window_start, event_type, value, coalesce(window_start + INTERVAL 6 HOUR <= mark, false) AS late FROM w JOIN before USING (slice) WHERE window_start + INTERVAL 6 HOUR > ts AND window_start + INTERVAL 6 HOUR <= (SELECT max(mark) FROM marks))
    SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) FILTER (NOT late) AS n, round(CAST(sum(value) FILTER (NOT late) AS DOUBLE), 4) AS total, count(*) FILTER (late) AS late FROM told GROUP BY ALL HAVING count(*) FILTER (NOT late) > 0"""
)
def event_sliding_windows(s: SparkSession, d: str) -> DataFrame:
    """Windows of six hours, every two, over events that arrive in four slices, a fifth of them up to three days late."""
    root, events = _root(s, "windows"), table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    first = events.agg(F.to_date(F.min("ts"))).first()[0]
    hours = F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 72).otherwise(0).cast("int")
    arrival = F.to_date(F.col("ts") + F.make_dt_interval(hours=hours))
    arrive = _arriving(s, events.withColumn("slice", F.least(F.lit(3), F.floor(F.datediff(arrival, F.lit(first)) / 8)).cast("int")), root)
    for k in range(4):
        stream = et.closed_windows(arrive(k), "12 hours", "6 hours", "2 hours", "event_type")
        _run(stream, root, "append", _to(f"{root}/out"))
    closed = s.read.schema(stream.schema).parquet(f"{root}/out")
    out = et.late_rows(closed, events, "6 hours", "2 hours", "event_type")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round(F.col("total").cast("double"), 4).alias("total"), "late")


@query(
    f"""WITH {v.PROVISIONS}, sliced AS (SELECT p.provision_id, row_id, version, (year(effective_from) - 1992) // 2 % 4 AS slice FROM provisions p),
    kept AS (SELECT provision_id, arg_max(row_id, slice * 1000000 + version) AS row_id, max(version) FILTER (slice = top) AS version FROM (SELECT *, max(slice) OVER (PARTITION BY provision_id) AS top FROM sliced WHERE slice != 2) GROUP BY provision_id)
    SELECT 'point' AS kind, provision_id AS id, row_id, CAST(version AS BIGINT) AS version FROM kept UNION ALL SELECT 'failure', '2', count(*), NULL FROM sliced WHERE slice = 2"""
)
def stream_upsert(s: SparkSession, d: str) -> DataFrame:
    """Versions arrive in four slices: the newest of each provision stays, one slice fails as a whole, a replay changes nothing."""
    root = _root(s, "upsert")
    rows = v.provisions(s, d).select(F.col("provision_id").alias("point_id"), "row_id", "version", F.pmod(F.expr("(year(effective_from) - 1992) div 2"), F.lit(4)).cast("int").alias("slice"))
    build = lambda batch: batch.withColumn("row_id", F.when(F.col("broken"), F.raise_error(F.lit("no vector"))).otherwise(F.col("row_id")))
    rows = rows.withColumn("broken", (F.col("slice") == 2) & (F.col("row_id") % 3 == 0))
    index = StreamIndex(s, root, "point_id string, row_id long, version int", order="version", build=build)
    arrive = _arriving(s, rows, root)
    for k in range(4):
        _run(arrive(k), root, "append", index.write)
        if k == 1:
            index.compact()
    first = s.read.parquet(f"{root}/arrivals").filter("slice = 0")
    index.write(first, 0)  # as after a crash before the commit, and after a compaction
    points = index.points().select(F.lit("point").alias("kind"), F.col("point_id").alias("id"), "row_id", F.col("version").cast("long").alias("version"))
    failed = index.failures().select(F.lit("failure").alias("kind"), F.col("batch").cast("string").alias("id"), F.col("rows").alias("row_id"), F.lit(None).cast("long").alias("version"))
    return points.unionByName(failed)
