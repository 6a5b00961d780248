"""Structured Streaming forms of the incremental jobs; state is bounded by watermarks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import checks as C
from ..operators.page_signals import page_signals

c = F.col


def read_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format("parquet")
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def _timed(df: DataFrame, ts: str, watermark: str) -> DataFrame:
    """Event time as TIMESTAMP (watermarks need one), with its watermark."""
    return df.withColumn(ts, c(ts).cast("timestamp")).withWatermark(ts, watermark)


def stream_page_audit(pages: DataFrame, scheme: str = "pillars") -> DataFrame:
    """Checks of pages as they arrive; stateless, the same functions as the batch job."""
    return C.check_rows(page_signals(pages), scheme)


def stream_frontier_dedup(urls: DataFrame, watermark: str = "1 day", ts: str = "ts", key: str = "url") -> DataFrame:
    """Each URL once within the watermark."""
    return _timed(urls, ts, watermark).dropDuplicatesWithinWatermark([key])


def still_open(batch: DataFrame, end: str, watermark: str | None) -> DataFrame:
    """Windows of the batch form that a stream stopped at ``watermark`` has not written yet (None: all)."""
    return batch if watermark is None else batch.where(c(end) > F.lit(watermark).cast("timestamp"))


def stream_funnel(events: DataFrame, watermark: str = "1 hour", window: str = "1 hour", slide: str | None = None,
                  ts: str = "ts", step: str = "event_type") -> DataFrame:
    """Events per tumbling (or sliding) window and step."""
    frame = F.window(ts, window, slide) if slide else F.window(ts, window)
    return _timed(events, ts, watermark).groupBy(frame.alias("w"), step).agg(
        F.count(F.lit(1)).alias("n")).select(c("w.start").alias("window_start"), c("w.end").alias("window_end"), step, "n")


def stream_sessions(events: DataFrame, watermark: str = "1 hour", gap: str = "30 minutes", ts: str = "ts",
                    user: str = "user_id") -> DataFrame:
    """Sessions per user, closed by a gap.

    Start and end are aggregates, not the window's own fields: a filter on those would be pushed below the merge of
    the sessions and drop single events.
    """
    return _timed(events, ts, watermark).groupBy(F.session_window(ts, gap).alias("w"), user).agg(
        F.min(ts).alias("session_start"), (F.max(ts) + F.expr(f"INTERVAL '{gap}'")).alias("session_end"),
        F.count(F.lit(1)).alias("n")).select(user, "session_start", "session_end", "n")


# --- sessions with a timer ------------------------------------------------------------------------
SESSION_STATE = "site_id string, step string, tie long, created long, updated long, done boolean"
BUCKET_STATE = "id array<string>, site_id array<string>, step array<string>, tie array<long>, created array<long>, updated array<long>, done array<boolean>"
EVENT = ["id", "site_id", "step", "event_id", "at"]


class AbandonedSessions(StatefulProcessor):
    """One small row of state per open session; a timer ends it some hours after its first event.

    A session that reaches ``done`` is not reported.  State goes when the timer fires, and events that come later are dropped.
    Times are microseconds.
    """

    def __init__(self, done: str, hours: int):
        self.done, self.wait = done, hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", SESSION_STATE)

    def handleInputRows(self, key, rows, timerValues):
        held = self.open.get()  # None for a new session; each call goes to the JVM and back, so there are few of them
        before = held
        for r in rows:
            held = self._after(held, r.site_id, r.step, r.event_id, r.at)
        due = self._due(held)
        if before is None or self._due(before) != due:
            if before is not None:
                self.handle.deleteTimer(self._due(before))
            self.handle.registerTimer(due)
        if before is None or tuple(before) != held:
            self.open.update(held)
        return iter(())

    def _after(self, held, site_id, step, event_id, at) -> tuple:
        """The row of a session after one more event."""
        if held is None:
            return site_id, step, event_id, at, at, step == self.done
        first_site, last, tie, created, updated, done = held
        done = done or step == self.done
        if (at, event_id) > (updated, tie):
            last, tie, updated = step, event_id, at
        return first_site, last, tie, min(created, at), updated, done

    def _due(self, held) -> int:
        return -(-(held[3] + self.wait) // 1000)

    def _ended(self, id, held) -> Row:
        site_id, step, _, created, updated, _ = held
        return Row(id=id, site_id=site_id, current_step=step, created=created, updated=updated, ended=created + self.wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.open.get()
        self.open.clear()
        if not held[5]:
            yield self._ended(key[0], held)


class AbandonedSessionsByBucket(AbandonedSessions):
    """The same for all sessions of a bucket at once, in frames: their rows by column, and one timer for the next of them to end.

    Calls to the state store are then made per bucket and not per session.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", BUCKET_STATE)

    def handleInputRows(self, key, rows, timerValues):
        held = dict(self._held())
        before = self._next(held)
        for frame in rows:
            for id, *event in zip(*(frame[name].tolist() for name in EVENT)):
                held[id] = self._after(held.get(id), *event)
        due = self._next(held)
        if before != due:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
        self._store(held)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """All sessions whose time the watermark has reached; Spark itself deletes the timer that it calls for."""
        now, left, ended = timerValues.getCurrentWatermarkInMs(), {}, []
        for id, held in self._held():
            if self._due(held) > now:
                left[id] = held
            elif not held[5]:
                ended.append(self._ended(id, held))
        if left:
            self.handle.registerTimer(self._next(left))
            self._store(left)
        else:
            self.open.clear()
        if ended:
            yield pd.DataFrame(ended, columns=ended[0].__fields__)

    def _held(self):
        """Ids with the rows of their sessions."""
        ids, *columns = self.open.get() or ([],)
        return zip(ids, zip(*columns))

    def _next(self, held: dict) -> int | None:
        return min(map(self._due, held.values()), default=None)

    def _store(self, held: dict) -> None:
        self.open.update((list(held), *map(list, zip(*held.values()))))


def stream_abandoned(events: DataFrame, done: str = "purchase", hours: int = 24, watermark: str = "1 hour",
                     buckets: int | None = 4096) -> DataFrame:
    """Sessions that are still not completed some hours after their first event, with the step they stopped at.

    ``events(id, site_id, step, event_id, ts)``; of events at one time the greatest ``event_id`` is the newest.  The stream form of
    ``sessions.abandoned`` on ``sessions.current_state``: state is one row per session younger than that, and each row comes
    once, when the watermark passes its time.  Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``), as Spark keeps timers there.

    Sessions are kept by bucket of their id; a batch reads and writes the buckets that it has events of.  ``buckets=None`` keeps each
    session by itself, which suits many open sessions and small batches.  Both give the same rows.  A stream that goes on from
    its checkpoint must keep the number (None for one begun without buckets).
    """
    tie = F.coalesce("event_id", F.lit(-2**63)).alias("event_id")  # without nulls, frames keep numbers as they are
    at = F.coalesce(F.unix_micros("ts"), F.raise_error(F.lit("an event has no time")).cast("long")).alias("at")
    timed = _timed(events, "ts", watermark).select("id", "site_id", "step", tie, "ts", at)
    state = {"outputStructType": "id string, site_id string, current_step string, created long, updated long, ended long",
             "outputMode": "Append", "timeMode": "eventTime"}
    if buckets is None:
        ended = timed.groupBy("id").transformWithState(AbandonedSessions(done, hours), **state)
    else:
        bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket")
        ended = timed.select(bucket, "*").groupBy("bucket").transformWithStateInPandas(AbandonedSessionsByBucket(done, hours), **state)
    times = {"created_at": "created", "updated_at": "updated", "abandoned_at": "ended"}
    return ended.select("id", "site_id", "current_step", *[F.timestamp_micros(old).alias(new) for new, old in times.items()])
