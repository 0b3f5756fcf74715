"""Streaming queries; each ends when all that is there is processed, so its result equals the batch query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.plans.registry import query
from gleanery.streaming import events as ev


def _events(spark: SparkSession, d: str) -> DataFrame:
    return ev.read_events(spark, ev.source_path(d, "events"))


@query("select cast(epoch_us(date_trunc('day', ts)) as bigint) as start_us, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts and totals by event type."""
    return ev.run_available(ev.windowed(_events(spark, d)), "update", ("start_us", "event_type"))


@query(
    """
with g as (select user_id, event_id, cast(epoch_us(ts) as bigint) as t, lag(cast(epoch_us(ts) as bigint)) over (partition by user_id order by ts, event_id) as p from events),
s as (select *, sum(case when p is null or t - p >= 21600000000 then 1 else 0 end) over (partition by user_id order by t, event_id) as session from g)
select user_id, min(t) as start_us, count(*) as n from s group by user_id, session
"""
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of every user with a gap of six hours."""
    return ev.run_available(ev.sessions(_events(spark, d)), "complete")


@query(
    """
with g as (select event_id, cast(epoch_us(ts) as bigint) as t, lag(cast(epoch_us(ts) as bigint)) over (partition by user_id, event_type order by ts, event_id) as p from events)
select event_id, case when p is null or t - p > 604800000000 then 'miss' when t - p > 259200000000 then 'stale' else 'hit' end as status from g
"""
)
def stream_access(spark: SparkSession, d: str) -> DataFrame:
    """Status of every cached access from keyed state that ends after seven days."""
    return ev.run_available(ev.access_status(_events(spark, d), 259_200_000_000, 604_800_000_000), "append")
