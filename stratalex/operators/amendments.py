"""Amendment events to intervals of validity, by a sweep over each provision's days.

Events open versions, for good or until a day, close one version or all, and suspend or resume the provision. Between two
days on which something changes one version wins, or none; equal neighbours are one interval.
"""

from __future__ import annotations

import datetime as dt
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Event types of legal effect, by what they do to the versions of a provision.
OPENS = ("EFFECTIVE", "AMENDED", "PARTIAL_AMENDED", "CORRECTED")
CLOSES = ("SUPERSEDED", "REPEALED", "EXPIRED")
SUSPENDS, RESUMES = "SUSPENDED", "RESUMED"
_OUT = "provision_id string, version int, effective_from date, effective_to date"


class Sweep:
    """Days of one provision, in order; ``intervals`` are (version, first day, day after the last or None)."""

    def __init__(self) -> None:
        self.best: list[tuple] = []  # (-priority, -version, -event, start, until): what is over stays until it is on top
        self.ends: list[dt.date] = []
        self.closed, self.closed_versions = dt.date.min, {}
        self.suspended, self.now, self.since = False, None, None
        self.intervals: list[tuple] = []

    def day(self, day: dt.date, events: list[tuple]) -> None:
        """All events (event, type, version, until, priority) of a day; closings come before openings."""
        while self.ends and self.ends[0] < day:
            end = heapq.heappop(self.ends)
            self._settle(end)
        for event, kind, version, until, priority in sorted(events, key=lambda e: e[0]):
            if kind in CLOSES and version is None:
                self.closed = day
            elif kind in CLOSES:
                self.closed_versions[version] = day
            elif kind in OPENS and (until is None or until > day):
                heapq.heappush(self.best, (-priority, -version, -event, day, until))
                if until is not None:
                    heapq.heappush(self.ends, until)
            elif kind in (SUSPENDS, RESUMES):
                self.suspended = kind == SUSPENDS
        self._settle(day)

    def end(self) -> list[tuple]:
        while self.ends:
            self._settle(heapq.heappop(self.ends))
        if self.now is not None:
            self.intervals.append((self.now, self.since, None))
        return self.intervals

    def _over(self, version: int, start: dt.date, until: dt.date | None, day: dt.date) -> bool:
        return start < self.closed or start < self.closed_versions.get(version, dt.date.min) or (until is not None and until <= day)

    def _settle(self, day: dt.date) -> None:
        while self.best and self._over(-self.best[0][1], self.best[0][3], self.best[0][4], day):
            heapq.heappop(self.best)
        wins = None if self.suspended or not self.best else -self.best[0][1]
        if wins != self.now:
            if self.now is not None:
                self.intervals.append((self.now, self.since, day))
            self.now, self.since = wins, day


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by provision, then day; state: one provision's open versions."""
    key, sweep, today, events = None, None, None, []

    def done() -> pa.RecordBatch:
        sweep.day(today, events)
        rows = sweep.end()
        return pa.RecordBatch.from_arrays([pa.array([key] * len(rows), pa.string()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.date32(), pa.date32())))], names=["provision_id", "version", "effective_from", "effective_to"])

    for batch in batches:
        for provision, day, *event in zip(*(c.to_pylist() for c in batch.columns)):
            if provision != key:
                if sweep:
                    yield done()
                key, sweep, today, events = provision, Sweep(), day, []
            elif day != today:
                sweep.day(today, events)
                today, events = day, []
            events.append(event)
    if sweep:
        yield done()


def effect_intervals(events: DataFrame) -> DataFrame:
    """provision_id, version, effective_from, effective_to: which version of each provision is valid when.

    ``events``: provision_id, event_id (long), event_type, effective_on (date), until (date or null), version (int or
    null), priority (int or null: 0), review_status. Accepted events with a provision and a date count; an opening needs
    a version. An opening holds from its day, ``until`` the day given, if any; a closing ends the version it names, or all
    if it names none, that opened before its day; suspension hides all versions until the provision is resumed. On each day
    the open version of the highest priority wins, then the highest version, then the latest event. Intervals are half-open,
    do not overlap and are coalesced; null is an open end. Of one day closings come first; suspensions and resumptions
    follow one another by event_id.
    """
    known = F.col("event_type").isin(*OPENS, *CLOSES, SUSPENDS, RESUMES) & (~F.col("event_type").isin(*OPENS) | F.col("version").isNotNull())
    good = events.filter(known & (F.col("review_status") == "ACCEPTED") & F.col("provision_id").isNotNull() & F.col("effective_on").isNotNull() & F.col("event_id").isNotNull())
    rows = good.select(F.col("provision_id").cast("string").alias("provision_id"), "effective_on", F.col("event_id").cast("long").alias("event_id"), "event_type", F.col("version").cast("int").alias("version"), "until", F.coalesce(F.col("priority").cast("int"), F.lit(0)).alias("priority"))
    return rows.repartition("provision_id").sortWithinPartitions("provision_id", "effective_on").mapInArrow(_swept, _OUT)


def undated_events(events: DataFrame) -> DataFrame:
    """Events that wait for a reviewer: no date, or not yet accepted. They change no interval."""
    return events.filter(F.col("effective_on").isNull() | F.coalesce(F.col("review_status") != "ACCEPTED", F.lit(True)))
