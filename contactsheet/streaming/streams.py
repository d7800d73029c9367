"""The reference's polling loops as Structured Streaming. Watermarks are our own policy: the reference has none."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATERMARK = "10 minutes"


def read_events(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    """Files of a folder as a stream; each once."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 4).parquet(folder)


def rolling(events: DataFrame, ts: str, length: str, slide: str, *aggregates, watermark: str = WATERMARK) -> DataFrame:
    """STR-03, STR-04. Aggregates of sliding windows."""
    out = events.withWatermark(ts, watermark).groupBy(F.window(ts, length, slide)).agg(*aggregates)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in out.columns if c != "window"])


def health(events: DataFrame, ts: str, kind: str, watermark: str = WATERMARK) -> DataFrame:
    """STR-05. Errors of each hour and what they mean."""
    out = rolling(events, ts, "1 hour", "1 hour", F.count_if(F.col(kind) == "critical").alias("critical"), F.count_if(F.col(kind) == "error").alias("errors"), watermark=watermark)
    return out.withColumn("health", F.when(F.col("critical") > 0, "red").when(F.col("errors") > 3, "yellow").otherwise("green"))


def ingest(files: DataFrame, target: str, checkpoint: str, trigger: dict | None = None):
    """SRC-04, STR-01. New paths go to a table, each path once: the stream's state knows those seen, and a batch that runs again
    writes its own folder anew."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    once = files.dropDuplicates(["path"])
    return once.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stale_jobs(beats: DataFrame, job: str, ts: str, minutes: int = 5, watermark: str = WATERMARK) -> DataFrame:
    """STR-02. Each job once when no heartbeat of it has come for so many minutes of event time; beats after that start it anew."""

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"job": [key[0]], "last_beat": [pd.Timestamp(last, unit="us")]})
            return
        last = max(int(f["us"].max()) for f in frames)
        last = max(last, state.get[0]) if state.exists else last
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job": pd.Series([], dtype="int64"), "last_beat": pd.Series([], dtype="datetime64[ns]")})

    keyed = beats.select(F.col(job).alias("job"), F.col(ts).alias("ts"), F.unix_micros(F.col(ts)).alias("us")).withWatermark("ts", watermark)
    return keyed.groupBy("job").applyInPandasWithState(watch, "job long, last_beat timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def due_posts(ticks: DataFrame, posts: DataFrame, ts: str, minutes: int = 15, watermark: str = "1 hour") -> DataFrame:
    """STR-06. post_id, scheduled_at and genre of posts within so many minutes of a tick, each once. A genre that must not be published never is.

    posts: post_id, scheduled_at, genre. An equi-join on buckets of time of that length: a tick asks its own and both neighbours. A post
    is met by ticks of twice that time at most, so that the watermark, which must be longer, bounds the state that keeps it single.
    """
    length = minutes * 60
    bucket = lambda c: F.floor(F.unix_timestamp(c) / length)
    ok = posts.where(F.coalesce(F.lower("genre") != "boudoir", F.lit(True))).withColumn("bucket", bucket(F.col("scheduled_at")))
    asked = ticks.withWatermark(ts, watermark).withColumn("bucket", F.explode(F.array(*(bucket(F.col(ts)) + i for i in (-1, 0, 1)))))
    near = asked.join(ok, "bucket").where(F.abs(F.unix_timestamp(F.col(ts)) - F.unix_timestamp("scheduled_at")) <= length)
    return near.dropDuplicatesWithinWatermark(["post_id"]).select("post_id", "scheduled_at", "genre")


def run_once(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there and ends; the result is in parquet files. In complete mode the last one is whole, in append
    mode each batch has a folder of its own, which it replaces when it runs again."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(folder if mode == "complete" else f"{folder}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
