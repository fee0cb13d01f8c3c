"""Streams of many batches, in disorder and replayed, against the same rules over a finished table."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stratalex.streaming import event_time, limits
from stratalex.streaming.jobs import STAGES
from stratalex.streaming.upsert import StreamIndex

START = dt.datetime(2024, 1, 1)
SCHEMA = "job_id long, stage string, ts timestamp, event_id long"


def fed(spark, root, batches, schema, stream_of, mode="append"):
    """Batches in turn through one checkpoint; what the stream wrote."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{root}/in")
        stream = stream_of(spark.readStream.schema(schema).parquet(f"{root}/in"))
        sink = stream.writeStream.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}"))
        sink.option("checkpointLocation", f"{root}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out").select(*stream.columns)


def simulated(rows, until, seconds):
    """Job by job, message by message."""
    out, jobs = [], collections.defaultdict(list)
    for job, stage, ts, i in rows:
        if job is not None and ts is not None and ts <= until and stage in STAGES:
            jobs[job].append((ts, i, STAGES.index(stage)))
    for job, messages in jobs.items():
        place, deadline, failed = -1, None, False
        for ts, _, at in sorted(messages):
            if deadline is not None and deadline < ts:
                break
            if at > place:
                out.append((job, STAGES[at], ts, STAGES[place] if place >= 0 else None))
                place = at
                deadline = ts + dt.timedelta(seconds=seconds[STAGES[at]]) if STAGES[at] in seconds else None
        if deadline is not None and deadline <= until:
            out.append((job, "FAILED", deadline, STAGES[place]))
    return sorted(out, key=str)


def test_stage_limits(spark, tmp_path):
    r, seconds = random.Random(6), {"RECEIVED": 1200, "PARSED": 300, "NORMALIZED": 600, "EXTRACTED": 300, "GATED": 600, "EMBEDDED": 300}
    assert limits.LIMITS == seconds
    rows = []
    for job in range(60):
        at = START + dt.timedelta(seconds=r.randint(0, 7000))
        for stage in STAGES[: r.randint(1, 8)]:
            for _ in range(r.choice([1, 1, 2])):  # redelivered
                rows.append((job, r.choice([stage] * 9 + ["RECEIVED", "UNKNOWN", None]), at + dt.timedelta(microseconds=r.randint(0, 2_000_000)), len(rows)))
            at += dt.timedelta(seconds=r.choice([10, 250, 299, 300, 301, 500, 600, 1100, 1300]))
    exact = START + dt.timedelta(seconds=8000)
    rows += [(100, "RECEIVED", exact, 9000), (100, "PARSED", exact + dt.timedelta(seconds=1200), 9001), (101, "RECEIVED", exact, 9002), (101, "PARSED", exact + dt.timedelta(seconds=1200, microseconds=1), 9003), (None, "PARSED", exact, 9004)]
    rows += [(102, "RECEIVED", START + dt.timedelta(seconds=20_000), 9005)]
    until = max(x[2] for x in rows) - dt.timedelta(seconds=900)
    # Arrival within the watermark's delay, dealt to six batches.
    arrival = sorted(rows, key=lambda x: x[2] + dt.timedelta(seconds=r.randint(0, 800)))
    batches = [arrival[len(arrival) * k // 6 : len(arrival) * (k + 1) // 6] for k in range(6)]
    got = fed(spark, str(tmp_path), batches, SCHEMA, lambda m: limits.stream_transitions(m, "900 seconds"))
    plain = lambda df: sorted(((g.job_id, g.stage, g.entered_at, g.left_stage) for g in df.collect()), key=str)
    want = simulated(rows, until, seconds)
    batch = limits.transitions(spark.createDataFrame(rows, SCHEMA), F.lit(until))
    assert plain(batch) == want
    assert plain(got) == want
    failed = [x[0] for x in want if x[1] == "FAILED"]
    assert len(failed) == len(set(failed)) > 10 and 101 in failed and 100 not in [x[0] for x in want if x[3] == "RECEIVED" and x[1] == "FAILED"] and 102 not in failed


def test_limits_share_states(spark, tmp_path):
    """Many jobs, few states: the calls do not grow with the jobs, and each job is settled by itself."""
    r = random.Random(5)
    rows = [(job, r.choice(STAGES[:4]), START + dt.timedelta(seconds=r.randint(0, 4000)), k) for k, job in enumerate(list(range(2000)) * 2)]
    rows += [(5000, "RECEIVED", START + dt.timedelta(seconds=9000), 9999)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = limits.stream_transitions(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "900 seconds", groups=8)
    query = stream.writeStream.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    assert 0 < max(x["stateOperators"][0]["numRowsTotal"] for x in query.recentProgress) <= 8
    got = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").select(*stream.columns).collect()
    assert sorted(map(tuple, got), key=str) == simulated(rows, START + dt.timedelta(seconds=8100), limits.LIMITS)


def test_sliding_windows_with_late_rows(spark, tmp_path):
    r, schema = random.Random(2), "event_id long, ts timestamp, event_type string, value double"
    rows = [(i, START + dt.timedelta(minutes=r.randint(0, 1500)), r.choice(["a", "b", None]), float(r.randint(0, 99)) / 4) for i in range(600)]
    late = lambda x: x[1] + (dt.timedelta(minutes=r.randint(0, 900)) if x[0] % 7 == 0 else dt.timedelta())
    arrival = sorted(rows, key=late)
    batches = [arrival[:200], arrival[200:400], arrival[400:]]
    got = fed(spark, str(tmp_path), batches, schema, lambda e: event_time.closed_windows(e, "2 hours", "60 minutes", "20 minutes", "event_type"))
    marks, newest = [], None
    for batch in batches:
        marks.append(newest and newest - dt.timedelta(hours=2))
        newest = max([x[1] for x in batch] + ([newest] if newest else []))
    final, want, dropped = newest - dt.timedelta(hours=2), collections.Counter(), collections.Counter()
    for batch, mark in zip(batches, marks):
        for _, ts, kind, _ in batch:
            begin = START + dt.timedelta(minutes=20 * ((ts - START) // dt.timedelta(minutes=20)))
            for k in range(3):
                end = begin - dt.timedelta(minutes=20 * k) + dt.timedelta(hours=1)
                if end <= final:
                    (dropped if mark and end <= mark else want)[end, kind] += 1
    assert {(g.window_end, g.event_type): g.n for g in got.collect()} == dict(want) and sum(dropped.values()) > 20
    known = event_time.late_rows(got.filter("event_type is not null"), spark.createDataFrame(rows, schema).filter("event_type is not null"), "60 minutes", "20 minutes", "event_type")
    assert {(g.window_end, g.event_type): g.late for g in known.collect()} == {k: dropped[k] for k in want if k[1]}


@pytest.mark.parametrize("compact", [False, True])
def test_stream_index(spark, tmp_path, compact):
    """Batches with repeated and failing rows, replays and compaction against a dictionary."""
    root, schema = f"{tmp_path}/index", "point_id string, seq long, text string"

    def build(batch):
        return batch.withColumn("text", F.when(F.col("text") == "bad", F.raise_error(F.lit("cannot encode"))).otherwise(F.col("text")))

    index = StreamIndex(spark, root, schema, build=build)
    assert index.points().count() == 0 and index.failures().count() == 0
    batches = [
        [("a", 1, "a1"), ("b", 1, "b1"), ("a", 2, "a2"), (None, 1, "lost")], [("b", 3, "b3"), ("c", 1, "c1")], [("c", 2, "bad"), ("a", 9, "a9")], [], [("a", 1, "again"), ("d", 1, None)],
    ]
    want = {}
    for number, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, schema)
        index.write(frame, number)
        if not any(t == "bad" for *_, t in rows):
            for key, _, text in sorted((x for x in rows if x[0]), key=lambda x: x[1]):
                want[key] = text
        if compact and number == 1:
            index.compact()
        if number in (0, 1, 3):
            index.write(frame, number)  # replayed
        assert {r.point_id: r.text for r in index.points().collect()} == want
    assert [(r.batch, r.rows, "cannot encode" in r.error) for r in index.failures().collect()] == [(2, 2, True)]
    if compact:
        index.compact()
        index.compact()
        index.write(spark.createDataFrame(batches[4], schema), 4)  # replayed after it was folded
        assert {r.point_id: r.text for r in StreamIndex(spark, root, schema).points().collect()} == want
    index.write(spark.createDataFrame([("c", 2, "good"), ("a", 9, "a9")], schema), 7)  # sent again as a new batch
    assert {r.point_id: r.text for r in index.points().collect()} == want | {"c": "good", "a": "a9"}
