"""Streaming queries over the events table, run over all that is there so that results can be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.sources.tables import table, with_timestamps
from vellumine.streaming import feeds

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    like = table(spark, d, "events")
    return with_timestamps(feeds.file_stream(spark, f"{d}/event[s].parquet", like), "ts")


@query("select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n from events group by all")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Events of a day and kind; the last state of every window of the stream."""
    rows = feeds.collect_once(feeds.tumbling(_events(spark, d)), "update")
    return rows.groupBy("began", "event_type").agg(F.max("n").alias("n")).select(F.date_format("began", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("select event_id, user_id from events")
def events_watermark_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Events sent twice by the stream, once each."""
    e = _events(spark, d)
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return feeds.collect_once(feeds.deduplicated(twice).select("event_id", "user_id"))


@query("with h as (select event_id, user_id, epoch_us(ts) as us from events) select user_id, event_id, count(*) over (partition by user_id order by us range between 86399999999 preceding and current row) - count(*) over (partition by user_id, us) as before from h")
def throttle_stream(spark: SparkSession, d: str) -> DataFrame:
    """The sliding throttle as state of a stream."""
    return feeds.collect_once(feeds.throttle_stream(_events(spark, d)))


@query("select user_id, max(event_id) as version, count(*) as n from events group by user_id")
def change_feed(spark: SparkSession, d: str) -> DataFrame:
    """The last snapshot of every user in the feed."""
    rows = feeds.collect_once(feeds.change_feed(_events(spark, d)), "update")
    return rows.groupBy("user_id").agg(F.max("version").alias("version"), F.max("n").alias("n"))
