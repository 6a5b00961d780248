"""Session analytics over ``sessions(id, site_id, status, current_step, created_at, updated_at, completed_at)``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_values as fv

c = F.col


def _ts(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def funnel(sessions: DataFrame, as_of: dt.datetime | str, steps: list[str] | None = None, days: int = 30) -> DataFrame:
    """Sessions of the last days per step, with their share of all of them, in step order.

    The window runs over the aggregated rows (one per step), not over sessions.
    """
    steps = steps or fv.FUNNEL_STEPS
    recent = sessions.where(c("created_at") > _ts(as_of) - F.make_dt_interval(F.lit(days)))
    counted = recent.groupBy("current_step").agg(F.count(F.lit(1)).alias("sessions"))
    place = F.array_position(F.array(*[F.lit(s) for s in steps]), c("current_step"))
    return counted.select(
        "current_step", "sessions",
        (c("sessions") * 100.0 / F.sum("sessions").over(Window.partitionBy())).cast("double").alias("percentage"),
        F.when(place == 0, len(steps) + 1).otherwise(place).cast("bigint").alias("step_order"),
    ).orderBy("step_order", "current_step")


def _seconds() -> Column:
    def micros(name: str) -> Column:
        return F.unix_micros(c(name).cast("timestamp"))

    return micros("completed_at") / 1e6 - micros("created_at") / 1e6


def completion_metrics(sessions: DataFrame) -> DataFrame:
    done = c("status") == "completed"
    return sessions.agg(
        F.count(F.lit(1)).alias("total_started"), F.count_if(done).alias("total_completed"),
        (F.count_if(done) * F.lit(100.0).cast("double") / F.count(F.lit(1))).alias("completion_rate"),
        (F.avg(F.when(done, _seconds())) / 60).alias("avg_minutes_to_complete"))


def abandoned(sessions: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Started longer ago than the given hours and never completed."""
    cut = _ts(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours))
    return sessions.where((c("status") == "started") & (c("created_at") < cut) & c("completed_at").isNull())


def avg_time_to_complete(sessions: DataFrame) -> DataFrame:
    return sessions.where(c("status") == "completed").agg(F.avg(_seconds()).alias("avg_seconds"))


def sessions_for_site(sessions: DataFrame, site_id: str) -> DataFrame:
    return sessions.where(c("site_id") == site_id).orderBy(c("created_at").desc(), "id")


def current_step(sessions: DataFrame, session_id: str) -> DataFrame:
    return sessions.where(c("id") == session_id).select("id", "site_id", "current_step", "status")


def completed_desc(sessions: DataFrame) -> DataFrame:
    return sessions.where(c("status") == "completed").orderBy(c("completed_at").desc(), "id")


def retention_cleanup(sessions: DataFrame, as_of, days: int = 7) -> DataFrame:
    """What stays after started sessions older than the given days are dropped."""
    cut = _ts(as_of) - F.make_dt_interval(F.lit(days))
    return sessions.where(~((c("status") == "started") & (c("created_at") < cut) & c("completed_at").isNull()))


def current_state(events: DataFrame, key: str = "id", ts: str = "updated_at") -> DataFrame:
    """Newest row per key of an append-only log."""
    rest = [n for n in events.columns if n != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), ts).alias("s")).select(key, "s.*")
