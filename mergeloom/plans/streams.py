"""Streaming queries over the events table. Output is compared with the same windows computed in a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.plans.registry import query
from mergeloom.streaming import windows as W

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return W.event_stream(spark, d, "events.parquet", SCHEMA, "ts").filter("ts is not null")


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


#: Windows that end an hour or more before the newest event are final; the others are still open.
_CLOSED = "<= (select max(ts) - interval 1 hour from events)"


@query(f"select strftime(time_bucket(interval 1 day, ts),'%Y-%m-%d %H:%M:%S') as start, event_type, count(*) n from events where ts is not null and time_bucket(interval 1 day, ts) + interval 1 day {_CLOSED} group by 1,2")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events a day and kind, of the days that are over by the watermark of one hour."""
    return _shown(W.run(W.tumbling(_events(spark, d), "ts", "1 day", ["event_type"])))


@query(f"""with s as (select event_type, unnest([time_bucket(interval 6 hour, ts), time_bucket(interval 6 hour, ts) - interval 6 hour]) st from events where ts is not null) select strftime(st,'%Y-%m-%d %H:%M:%S') as start, event_type, count(*) n from s where st + interval 12 hour {_CLOSED} group by 1,2""")
def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    return _shown(W.run(W.sliding(_events(spark, d), "ts", "12 hours", "6 hours", ["event_type"])))


@query(f"""with l as (select user_id, ts, lag(ts) over (partition by user_id order by ts) p from events where ts is not null), g as (select *, sum(case when p is null or ts - p >= interval 30 minute then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) k from l) select strftime(min(ts),'%Y-%m-%d %H:%M:%S') as start, user_id, count(*) n from g group by user_id, k having max(ts) + interval 30 minute {_CLOSED}""")
def session_counts(spark: SparkSession, d: str) -> DataFrame:
    return _shown(W.run(W.sessions(_events(spark, d), "ts", "30 minutes", ["user_id"])))


@query("select event_id, user_id from (select *, row_number() over (partition by event_id order by ts) rn from events where ts is not null) where rn=1")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every file is read twice; the second copy of an event is dropped, as it comes within the hour for which its id is kept."""
    e = _events(spark, d)
    return W.run(W.without_repeats(e.union(_events(spark, d)), "ts", ["event_id"])).select("event_id", "user_id")
