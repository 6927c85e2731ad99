"""A work queue as a stream: jobs wait in lanes, are handed out on lease, tried again and given up.

Commands (submit, done, failed) come in and orders go out. A job that is waiting or running is known by its id, and further
submits of it do nothing until it is done, whatever the batch they come in and across restarts: all of that is keyed state in
RocksDB. Every lane works off its jobs in the order of their submits, at most `slots` at a time. One lane of one slot is a
serial queue; more lanes spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

COMMANDS = "job_id string, command string, at timestamp, payload string"
ORDERS = "lane int, job_id string, attempt int, action string, payload string, at timestamp"


def with_large_state(spark: SparkSession) -> None:
    """State with timers and several variables needs the RocksDB store, on local disks and saved to the query's checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Lane(StatefulProcessor):
    def __init__(self, slots: int, lease_ms: int, attempts: int, wall: bool):
        self.slots, self.lease_ms, self.attempts, self.wall = slots, lease_ms, attempts, wall

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: Where each job waits; those that run are in running.
        self.known = handle.getMapState("known", "job_id string", "place long")
        self.waiting = handle.getMapState("waiting", "place long", "job_id string, payload string, attempt int")
        self.cursor = handle.getValueState("cursor", "head long, tail long")
        self.running = handle.getMapState("running", "job_id string", "payload string, attempt int, until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))
        # At one time what ends a job comes before what submits it again.
        found = found.assign(late=found["command"] == "submit").sort_values(["at", "late", "job_id"], kind="stable")
        out: list[tuple] = []
        self._load()
        for job, command, at, payload in zip(found["job_id"], found["command"], found["at"], found["payload"], strict=True):
            now = timerValues.getCurrentProcessingTimeInMs() if self.wall else at.value // 1_000_000
            self._expire(now, out, key[0])
            if command == "submit":
                if job not in self.runs and not self._waits(job):
                    self._wait(job, payload, 0, out, key[0], now)
            elif job in self.runs or self._waits(job):
                self._ended(job, command == "done", out, key[0], now)
            self._hand_out(out, key[0], now)
        self._store()
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        self._load()
        self._expire(expiredTimerInfo.getExpiryTimeInMs(), out, key[0])
        self._store()
        yield self._frame(out)

    def _load(self) -> None:
        """What runs in the lane, and where its queue begins and ends."""
        self.before = {job: run for (job,), run in self.running.iterator()}
        self.runs = dict(self.before)
        #: (until, job) of all leases. Those of jobs that ended before stay until they come first.
        self.ends = [(until, job) for job, (_, _, until) in self.runs.items()]
        heapify(self.ends)
        self.head, self.tail = self.cursor.get() if self.cursor.exists() else (0, 0)

    def _store(self) -> None:
        for job in self.before.keys() - self.runs.keys():
            self.running.removeKey((job,))
        for job, run in self.runs.items():
            if self.before.get(job) != run:
                self.running.updateValue((job,), run)
                self.handle.registerTimer(run[2])
        self.cursor.update((self.head, self.tail))

    def _expire(self, now: int, out: list[tuple], lane: int) -> None:
        """Ends leases in the order of their ends, each at its own time, so that orders don't depend on how commands fall into batches."""
        while self.ends and self.ends[0][0] <= now:
            until, job = heappop(self.ends)
            if job in self.runs and self.runs[job][2] == until:
                self._ended(job, False, out, lane, until)
                self._hand_out(out, lane, until)

    def _waits(self, job: str) -> bool:
        """Whether a job is in the queue; an empty one is not asked."""
        return self.head < self.tail and self.known.containsKey((job,))

    def _run(self, job: str, payload: str | None, attempt: int, out: list[tuple], lane: int, now: int) -> None:
        self.runs[job] = (payload, attempt, now + self.lease_ms)
        heappush(self.ends, (now + self.lease_ms, job))
        out.append((lane, job, attempt, "run", payload, now))

    def _wait(self, job: str, payload: str | None, attempt: int, out: list[tuple], lane: int, now: int) -> None:
        """Puts a job at the queue's end, or hands it out at once where none waits and a slot is free."""
        if self.head == self.tail and len(self.runs) < self.slots:
            self._run(job, payload, attempt + 1, out, lane, now)
            return
        self.waiting.updateValue((self.tail,), (job, payload, attempt))
        self.known.updateValue((job,), (self.tail,))
        self.tail += 1

    def _ended(self, job: str, well: bool, out: list[tuple], lane: int, now: int) -> None:
        """Forgets a job that is done, in time or after its lease; one that failed or ran out of its lease waits again, or is given up."""
        run = self.runs.pop(job, None)
        if not run and not well:
            return
        if well or run[1] >= self.attempts:
            if not run:
                self.known.removeKey((job,))
            if not well:
                out.append((lane, job, run[1], "give up", run[0], now))
        else:
            self._wait(job, run[0], run[1], out, lane, now)

    def _hand_out(self, out: list[tuple], lane: int, now: int) -> None:
        while len(self.runs) < self.slots and self.head < self.tail:
            job, payload, attempt = self.waiting.getValue((self.head,))
            self.waiting.removeKey((self.head,))
            # A job that was done while it waited for another try has gone, or waits elsewhere.
            if self.known.containsKey((job,)) and self.known.getValue((job,)) == (self.head,):
                self.known.removeKey((job,))
                self._run(job, payload, attempt + 1, out, lane, now)
            self.head += 1

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(out, columns=[f.split()[0] for f in ORDERS.split(", ")])
        return made.assign(at=pd.to_datetime(made["at"].astype("int64"), unit="ms"), lane=made["lane"].astype("int32"), attempt=made["attempt"].astype("int32"))


def orders(commands: DataFrame, lanes: int = 1, slots: int = 1, lease_seconds: int = 600, attempts: int = 3, late: str = "0 seconds", wall: bool = False) -> DataFrame:
    """Orders (lane, job_id, attempt, action, payload, at) from a stream of commands (job_id, command, at, payload).

    action is "run" or, after so many attempts that failed or ran out of their lease, "give up". Leases are counted in the
    commands' own time, so a replay gives the same orders: they end before a later command of their lane, or once the watermark passes them. With `wall` they end by the
    clock, also while no commands come. Commands later than the watermark by more than `late` are lost.
    """
    with_large_state(commands.sparkSession)
    lane = F.pmod(F.xxhash64("job_id"), F.lit(lanes)).cast("int")
    keyed = commands.where("job_id is not null and at is not null").select(lane.alias("lane"), "job_id", "command", F.col("at").cast("timestamp").alias("at"), F.col("payload").cast("string").alias("payload"))
    if not wall:
        keyed = keyed.withWatermark("at", late)
    return keyed.groupBy("lane").transformWithStateInPandas(Lane(slots, lease_seconds * 1000, attempts, wall), ORDERS, "append", "ProcessingTime" if wall else "EventTime")


def order_log(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes each batch's orders below path. A batch that is repeated after a loss writes over its own folder, so no order is logged twice."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
