"""Event logs as streams: appended, counted in windows, kept for their time, and worked off once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from .jobs import with_large_state

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS, files: int = 50) -> DataFrame:
    """Rows of the Parquet files that appear in a folder, `files` to a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to Parquet by day."""
    days = stream.withColumn("day", F.to_date("ts"))
    return days.writeStream.partitionBy("day").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path, format="parquet", outputMode="append")


def rates(stream: DataFrame, minutes: int = 1, late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Events of each type in tumbling windows; a window is final once the watermark has passed it, later events are dropped."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    rows = timed.groupBy(F.window(time, f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("count"))
    return rows.select(F.col("w.start").alias("window_start"), "event_type", "count")


def newest_only(stream: DataFrame, keep: str = "90 days", time: str = "ts") -> DataFrame:
    """Events without repeats of an id; ids are remembered for as long as events are kept."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, keep)
    return timed.dropDuplicatesWithinWatermark(["event_id"])


#: Events whose times fall into one span share a key and a timer, dealt to so many shares by their ids.
SPAN_SECONDS, SHARES = 3600, 16


class Kept(StatefulProcessor):
    """Events of one span: said to be kept when they come, and to have ended when the watermark passes their time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getListState("held", "event_id long, micros long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))[["event_id", "micros"]].drop_duplicates()
        found = found[found.micros // 1000 >= timerValues.getCurrentWatermarkInMs()]
        held = set(self.held.get()) if self.held.exists() else set()
        new = [r for r in found.itertuples(index=False, name=None) if r not in held]
        if new:
            self.held.appendList(new)
            if not held:
                self._wait(new)
        yield self._said(new, "kept")

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, now = list(self.held.get()), timerValues.getCurrentWatermarkInMs()
        left = [r for r in held if r[1] // 1000 >= now]
        if left:
            self.held.put(left)
            self._wait(left)
        else:
            self.held.clear()
        yield self._said([r for r in held if r[1] // 1000 < now], "ended")

    def _wait(self, held: list[tuple[int, int]]) -> None:
        """Until the first watermark above the oldest event's time. Later events of the span may come before it: then all older ones end with them."""
        self.handle.registerTimer(min(m for _, m in held) // 1000 + 1)

    @staticmethod
    def _said(rows: list[tuple[int, int]], change: str) -> pd.DataFrame:
        return pd.DataFrame({"event_id": [r[0] for r in rows], "created_at": pd.to_datetime([r[1] for r in rows], unit="us"), "change": change})


def retention_changes(stream: DataFrame, days: int, key: str = "event_id", time: str = "ts") -> DataFrame:
    """(event_id, created_at, change) of a stream of events: "kept" when one comes, "ended" once it is older than the newest by more than `days`.

    The watermark runs that many days behind the newest event, so what it passes has ended. The events of an hour share state
    and a timer, which go with the last of them. Events that are too old when they come are never kept; repeats of an event do
    nothing. What is kept and has not ended after the last batch are the rows that activity.retained() leaves of all events so
    far. Times count in milliseconds here.
    """
    with_large_state(stream.sparkSession)
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, f"{days} days")
    timed = timed.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).cast("long").alias("event_id"), time, F.unix_micros(time).alias("micros"))
    keyed = timed.withColumns({"span": F.floor(F.col("micros") / (SPAN_SECONDS * 1_000_000)), "share": F.pmod(F.xxhash64("event_id"), F.lit(SHARES)).cast("int")})
    return keyed.groupBy("span", "share").transformWithStateInPandas(Kept(), "event_id long, created_at timestamp, change string", "append", "EventTime")


def work_queue(stream: DataFrame, work: Callable[[DataFrame], None], checkpoint: str, key: str = "event_id") -> StreamingQuery:
    """Hands each batch's new jobs to `work`, each id once within a batch; after a restart the unfinished batch is handed over again."""
    return stream.writeStream.foreachBatch(lambda rows, _: work(rows.dropDuplicates([key]))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_lines(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream as JSON lines."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path, format="json", outputMode="append")
