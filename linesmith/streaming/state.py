"""Keyed state: the retry ladder of writes, with its timers, and the one event of a request that is done.

Both live in the state store, so a restart from the same progress folder goes on where it was; nothing is rewritten as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from linesmith.sources.storage import Committed

from .jobs import FIRST_WAIT, LONGEST_WAIT, MOST_RETRIES, each_batch

STEPS = "id string, status string, retry_count int, retry_after long, at_s long"
DONE = "request_id string, total long, done_at_s long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which keyed state needs; the session's own setting comes back after."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class _Ladder(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("ladder", "status string, retry_count int, retry_after long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        status, retries, after = self._state.get() if self._state.exists() else ("pending", 0, None)
        start = (status, retries, after)
        for at, ok in sorted((r.at_s, r.ok) for r in rows):  # of outcomes at one time, failures first
            if status in ("committed", "failed") or (after is not None and at < after):
                continue  # nothing was due
            if ok:
                status, after = "committed", None
            elif retries >= MOST_RETRIES:
                status, after = "failed", None
            else:
                status, after, retries = "scheduled", at + min(LONGEST_WAIT, FIRST_WAIT * 2**retries), retries + 1
            yield Row(id=key[0], status=status, retry_count=retries, retry_after=after, at_s=at)
        if (status, retries, after) != start:
            self._state.update((status, retries, after))
            if start[2] is not None and start[0] == "scheduled":
                self._handle.deleteTimer(start[2] * 1000)
            if after is not None:
                self._handle.registerTimer(after * 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        status, retries, after = self._state.get()
        if status == "scheduled" and expiredTimerInfo.getExpiryTimeInMs() == after * 1000:
            self._state.update(("due", retries, after))
            yield Row(id=key[0], status="due", retry_count=retries, retry_after=after, at_s=after)

    def close(self) -> None:
        pass


def retry_ladder(outcomes: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """The steps of writes as a stream (STEPS), from a stream of outcomes (id, ok, at: when the write was tried).

    A write is pending until its first outcome. A success commits it; a failure schedules it again, after 120 s and then twice as
    long each time, up to an hour; the sixth fails it for good. A write that is scheduled becomes due by a timer, when the stream's
    time passes it; outcomes before that, or after the end, count for nothing. Outcomes without id, ok or time are left out; those
    that are later than `lateness` are dropped by the watermark, which begins at 1970: no time up to that counts. The few outcomes that a write has in one micro-batch are put in order in memory.
    """
    rows = outcomes.where("id IS NOT NULL AND ok IS NOT NULL AND at IS NOT NULL").select(F.col("id").cast("string").alias("id"), "ok", "at", F.unix_seconds("at").alias("at_s"))
    return rows.withWatermark("at", lateness).groupBy("id").transformWithState(_Ladder(), STEPS, "Append", "EventTime")


def failures(steps: DataFrame, members: DataFrame) -> DataFrame:
    """Lines (parents and the duplicates that hang on them) of writes that failed for good. members: id, line_id."""
    return steps.where("status = 'failed'").join(members, "id").select("line_id", F.lit("AI_ERROR").alias("line_status"))


class _FirstDone(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._jobs = handle.getMapState("jobs", "id string", "at_s long")
        self._state = handle.getValueState("request", "n long, last long, told boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n, last, told = self._state.get() if self._state.exists() else (0, 0, False)
        if told:
            return  # late jobs of a request that is done
        total = None
        for r in rows:
            total = r.total
            if not self._jobs.containsKey((r.id,)):
                self._jobs.updateValue((r.id,), (r.at_s,))
                n, last = n + 1, max(last, r.at_s)
        if total is not None and n >= total:
            told = True
            self._jobs.clear()
            yield Row(request_id=key[0], total=total, done_at_s=last)
        self._state.update((n, last, told))

    def close(self) -> None:
        pass


def first_done(jobs: DataFrame, totals: DataFrame) -> DataFrame:
    """One event (DONE) per request, when as many of its jobs have ended as it has; done_at_s is the time of the last of them.

    jobs: a stream of request_id, id, status, at_s. totals: request_id, total (one row each). A job ends with done or error; ends
    that repeat count once, and those after the event for nothing. Requests without a total are never done.
    """
    ended = jobs.where(F.col("status").isin("done", "error") & F.col("id").isNotNull()).select(F.col("request_id").cast("string").alias("request_id"), F.col("id").cast("string").alias("id"), F.col("at_s").cast("long").alias("at_s"))
    sized = totals.where("total IS NOT NULL").select(F.col("request_id").cast("string").alias("request_id"), F.col("total").cast("long").alias("total"))
    return ended.join(sized, "request_id").groupBy("request_id").transformWithState(_FirstDone(), DONE, "Append", "None")


def drain(stream: DataFrame, path: str) -> DataFrame:
    """What a stream with keyed state emits now, added to the whole batches in a folder, with the progress beside it."""
    kept = Committed(stream.sparkSession, path)
    with keyed_state(stream.sparkSession):
        each_batch(stream, f"{path}-progress", kept.write)
    return kept.read_all(stream.schema)
