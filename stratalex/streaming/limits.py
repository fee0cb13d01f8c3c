"""Time limits of job stages: timers in keyed state over event time, and the same rule over a finished table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .jobs import STAGES, TERMINAL, stage_index

# Seconds that the step after each stage may take; a terminal stage waits for nothing.
LIMITS = {"RECEIVED": 1200, "PARSED": 300, "NORMALIZED": 600, "EXTRACTED": 300, "GATED": 600, "EMBEDDED": 300}
#: Microseconds in a second and in a millisecond.
SECOND, MILLI = 1_000_000, 1_000
#: Groups of jobs that share one state each: the calls of a batch are at most as many, however many jobs there are.
GROUPS = 4096
_OUT = "job_id long, stage string, entered_at timestamp, left_stage string"
_STATE = "job array<long>, place array<int>, deadline array<long>, failed array<boolean>, ts array<long>, id array<long>, stage array<int>, of array<long>"


def limit_of(stage: Column, limits: dict[str, int] = LIMITS) -> Column:
    """Seconds that a job may stay in ``stage``; null for a stage without a limit."""
    pairs = [F.lit(x) for s, n in limits.items() for x in (s, n)]
    return F.try_element_at(F.create_map(*pairs), stage)


def transitions(messages: DataFrame, until: Column, limits: dict[str, int] = LIMITS) -> DataFrame:
    """What a stream with limits has settled by ``until``: job_id, stage, entered_at, left_stage, one row for each step of a job.

    ``messages``: job_id, stage, ts, event_id. A job enters a stage when a message for a later one than any before
    comes, in the order of ts, then event_id. If its limit passes without a later stage, the job is FAILED at that moment,
    once, and what comes after changes nothing. A message at the very end of the limit is in time. Messages with an unknown
    stage or without ts or job are left out.
    """
    seen = messages.filter(F.col("job_id").isNotNull() & (F.col("ts") <= until)).withColumn("_place", stage_index(F.col("stage"))).filter("_place >= 0")
    order = W.partitionBy("job_id").orderBy("ts", "event_id")
    steps = seen.withColumn("_before", F.max("_place").over(order.rowsBetween(W.unboundedPreceding, -1))).filter("_before is null or _place > _before")
    end = F.col("ts") + F.make_dt_interval(secs=limit_of(F.col("stage"), limits).cast("decimal(18,6)"))
    steps = steps.withColumn("_end", end).withColumn("_next", F.lead("ts").over(order))
    late = F.coalesce((F.col("_end") <= until) & (F.col("_next").isNull() | (F.col("_next") > F.col("_end"))), F.lit(False))
    failed_before = F.coalesce(F.max(late.cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = steps.withColumn("_late", late).withColumn("_gone", failed_before).filter("_gone = 0")
    entered = kept.select("job_id", "stage", F.col("ts").alias("entered_at"), F.lag("stage").over(W.partitionBy("job_id").orderBy("_place")).alias("left_stage"))
    return entered.unionByName(kept.filter("_late").select("job_id", F.lit("FAILED").alias("stage"), F.col("_end").alias("entered_at"), F.col("stage").alias("left_stage")))


def _timed(limits: dict[str, int]):
    waits = [limits[s] * SECOND if s in limits and s not in TERMINAL else -1 for s in STAGES]

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        jobs, waiting = {}, []
        if state.exists:
            job, *told = state.get[:4]
            jobs = dict(zip(job, zip(*told)))
            waiting = list(zip(*state.get[4:]))
        if not state.hasTimedOut:
            for frame in frames:
                known = frame[frame["place"] >= 0]
                waiting += zip(known["us"].tolist(), known["event_id"].tolist(), known["place"].tolist(), known["job_id"].tolist())
        now, out = state.getCurrentWatermarkMs() * MILLI, []
        # Messages up to the watermark are complete, so they and the limits between them are settled in order, job by job.
        due = sorted(x for x in waiting if x[0] <= now)
        for us, _, at, job in due:
            place, deadline, failed = jobs.get(job, (-1, -1, False))
            if failed:
                continue
            if 0 <= deadline < us:
                out.append((job, "FAILED", deadline, STAGES[place]))
                jobs[job] = (place, -1, True)
            elif at > place:
                out.append((job, STAGES[at], us, STAGES[place] if place >= 0 else None))
                jobs[job] = (at, us + waits[at] if waits[at] >= 0 else -1, False)
        for job, (place, deadline, failed) in jobs.items():
            if 0 <= deadline <= now and not failed:
                out.append((job, "FAILED", deadline, STAGES[place]))
                jobs[job] = (place, -1, True)
        waiting = [x for x in waiting if x[0] > now and not (x[3] in jobs and jobs[x[3]][2])]
        columns = [list(x) for x in zip(*jobs.values())] or [[], [], []]
        state.update((list(jobs), *columns, *([list(x) for x in zip(*waiting)] or [[], [], [], []])))
        ahead = [x[0] for x in waiting] + [x for x in columns[1] if x >= 0]
        if ahead:  # a timer fires once the watermark is past it
            state.setTimeoutTimestamp(max(-(-min(ahead) // MILLI) - 1, now // MILLI))
        if out:
            job, stages, entered, left = zip(*out)
            yield pd.DataFrame({"job_id": job, "stage": stages, "entered_at": pd.to_datetime(pd.Series(entered), unit="us"), "left_stage": pd.Series(left, dtype="object")})

    return advance


def stream_transitions(messages: DataFrame, late: str, limits: dict[str, int] = LIMITS, groups: int = GROUPS) -> DataFrame:
    """The same steps as a stream, appended when the watermark, ``late`` behind the newest message, has passed them.

    Messages may come in any order within ``late``. Jobs are dealt to ``groups`` by a hash of their id; a group's state holds, job
    by job, where it stands and the messages that the watermark has not reached, and a timer at the next of them or at
    the end of a stage's limit, whichever is first.
    """
    known = messages.select("job_id", "event_id", "ts", F.unix_micros("ts").alias("us"), F.coalesce(stage_index(F.col("stage")), F.lit(-1)).alias("place"))
    timed = known.filter("job_id is not null and ts is not null").withWatermark("ts", late)
    dealt = timed.withColumn("group", F.pmod(F.xxhash64("job_id"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandasWithState(_timed(limits), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
