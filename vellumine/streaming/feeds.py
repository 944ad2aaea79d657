"""Structured Streaming: change feed, throttle with state, deduplication within a watermark, tumbling windows, work queue."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vellumine.session import shared_dir


def file_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the parquet files of a folder, as they land."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_once(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over all that is there and stop; the checkpoint is in the shared folder."""
    q = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    q.awaitTermination()


def collect_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows a stream emits over all that is there, as a table in the shared folder."""
    out = f"{shared_dir(stream.sparkSession)}/feed-{uuid.uuid4().hex}"
    run_once(stream, mode, lambda df, k: df.write.mode("append").parquet(out))
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by kind in tumbling windows with a watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("began"), "event_type", "n", "total")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """The first of repeated events within a watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def _throttle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of a key: times of the hits of the last window, in microseconds."""
    kept = list(state.get[0]) if state.exists else []
    rows = pd.concat(list(frames)).sort_values(["us", "event_id"])
    ids, before = [], []
    for i, us in zip(rows["event_id"], rows["us"]):
        kept = [x for x in kept if us - x < WINDOW_US]
        ids.append(i)
        before.append(sum(x < us for x in kept))
        kept.append(us)
    state.update((kept,))
    yield pd.DataFrame({"user_id": key[0], "event_id": ids, "before": before})


WINDOW_US = 86_400_000_000


def throttle_stream(events: DataFrame) -> DataFrame:
    """Events with the number of earlier hits of their user in a sliding day, kept as state."""
    hits = events.select("event_id", "user_id", F.unix_micros("ts").alias("us"))
    return hits.groupBy("user_id").applyInPandasWithState(_throttle, "user_id bigint, event_id bigint, before bigint", "kept array<bigint>", "append", GroupStateTimeout.NoTimeout)


def change_feed(events: DataFrame) -> DataFrame:
    """A snapshot by user that is sent on in update mode."""
    return events.groupBy("user_id").agg(F.max("event_id").alias("version"), F.count("*").alias("n"))
