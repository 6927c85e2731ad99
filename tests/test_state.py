"""Keyed state with timers: the work queue, retention and answers that stop, each over several batches."""

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from attestor.operators import activity
from attestor.streaming import citations, events, jobs

T0 = datetime(2024, 1, 1)
S = lambda n: T0 + timedelta(seconds=n)


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_jobs_in_flight_are_handed_out_once(spark, tmp_path):
    def run():
        made = jobs.orders(stream(spark, tmp_path / "in", jobs.COMMANDS), lease_seconds=100, attempts=2)
        jobs.order_log(made, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
        return [(r.job_id, r.attempt, r.action, int((r.at - T0).total_seconds())) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at", "attempt").collect()]

    put(spark, tmp_path / "in", [("a", "submit", S(0), "A"), ("b", "submit", S(1), "B"), ("a", "submit", S(2), "A2")], jobs.COMMANDS)
    put(spark, tmp_path / "in", [("a", "submit", S(10), "A3"), ("b", "submit", S(11), None)], jobs.COMMANDS)
    assert run() == [("a", 1, "run", 0)]
    # A restart, and the third batch: a is done, so b runs, and a may come again.
    put(spark, tmp_path / "in", [("a", "done", S(20), None), ("a", "submit", S(21), "again"), ("c", "done", S(22), None)], jobs.COMMANDS)
    assert run() == [("a", 1, "run", 0), ("b", 1, "run", 20)]
    # b's lease ends at 120: a runs, then b once more, and is given up when that fails too.
    put(spark, tmp_path / "in", [("z", "failed", S(130), None)], jobs.COMMANDS)
    put(spark, tmp_path / "in", [("a", "done", S(140), None), ("b", "failed", S(150), None), ("b", "submit", S(160), "new")], jobs.COMMANDS)
    assert run() == [("a", 1, "run", 0), ("b", 1, "run", 20), ("a", 1, "run", 120), ("b", 2, "run", 140), ("b", 2, "give up", 150), ("b", 1, "run", 160)]


def test_leases_end_with_the_watermark(spark, tmp_path):
    lane = {r.j: r.lane for r in spark.createDataFrame([(f"z{k}",) for k in range(20)] + [("a",)], "j string").withColumn("lane", F.pmod(F.xxhash64("j"), F.lit(4))).collect()}
    other = next(j for j in lane if lane[j] != lane["a"])
    for rows in ([("a", "submit", S(0), "A")], [(other, "failed", S(150), None)], [(other, "failed", S(500), None)]):
        put(spark, tmp_path / "in", rows, jobs.COMMANDS)
    made = jobs.orders(stream(spark, tmp_path / "in", jobs.COMMANDS), lanes=4, lease_seconds=100, attempts=2)
    jobs.order_log(made, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("at", "attempt").collect()
    assert [(r.job_id, r.attempt, r.action, r.payload, int((r.at - T0).total_seconds())) for r in rows] == [("a", 1, "run", "A", 0), ("a", 2, "run", "A", 100), ("a", 2, "give up", "A", 200)]


def test_lanes_work_side_by_side(spark, tmp_path):
    put(spark, tmp_path / "in", [(f"j{k}", "submit", S(k), None) for k in range(20)] + [(None, "submit", S(1), None)], jobs.COMMANDS)
    made = jobs.orders(stream(spark, tmp_path / "in", jobs.COMMANDS), lanes=4, slots=2)
    jobs.order_log(made, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out")).groupBy("lane").agg(F.count("*").alias("n"), F.count_distinct("job_id").alias("d")).collect()
    assert len(found) == 4 and all(r.n == r.d == 2 for r in found)


def test_retention_on_the_stream_is_that_of_the_table(spark, tmp_path):
    schema = "event_id long, ts timestamp"
    days = lambda n: T0 + timedelta(days=n)
    batches = [[(1, days(0)), (2, days(5)), (2, days(5))], [(3, days(9)), (1, days(0))], [(4, days(11)), (5, days(2)), (6, None)], [(7, days(15)), (8, days(4)), (None, days(15))]]
    seen = []
    for batch in batches:
        seen += [r for r in dict.fromkeys(batch) if None not in r and r not in seen]
        put(spark, tmp_path / "in", batch, schema)
        made = events.retention_changes(stream(spark, tmp_path / "in", schema), 10)
        made.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet").awaitTermination(120)
        out = spark.read.parquet(str(tmp_path / "out"))
        left = out.groupBy("event_id").agg(F.sum(F.when(F.col("change") == "kept", 1).otherwise(-1)).alias("n"), F.min("created_at").alias("created_at"))
        now = max(t for _, t in seen)
        want = activity.retained(spark.createDataFrame(seen, "event_id long, created_at timestamp"), F.lit(now), 10)
        assert {tuple(r) for r in left.where("n = 1").select("event_id", "created_at").collect()} == {tuple(r) for r in want.collect()}
        assert left.where("n not in (0, 1)").count() == 0


def test_answers_cut_off_are_stopped_with_what_was_shown(spark, tmp_path):
    schema = "message_id long, seq long, at timestamp, token string, verified array<string>, last boolean, stop boolean"
    q = ["Q1"]
    batches = [
        [(1, 0, S(0), "The cap [Q1", q, None, None), (2, 0, S(1), "Whole. ", q, False, False), (3, 0, S(2), "Halted ", q, False, False)],
        [(2, 1, S(30), "[Q9]End", q, True, False), (3, 1, S(31), "unread", q, False, True), (3, 2, S(32), "after", q, False, False), (1, 1, S(33), "] is [", q, False, False)],
        [(4, 0, S(200), "x", None, False, False)],
        [(1, 2, S(210), "late", q, True, False), (4, 1, S(211), None, None, True, None)],
    ]
    for batch in batches:
        put(spark, tmp_path / "in", batch, schema)
        made = citations.messages(stream(spark, tmp_path / "in", schema), 60, "30 seconds")
        made.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet").awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.message_id, r.status, r.content) for r in rows if r.content is not None} == {(1, "STOPPED", "The cap [Q1] is "), (2, "COMPLETE", "Whole. End"), (3, "STOPPED", "Halted "), (4, "COMPLETE", "x")}
    assert {(r.message_id, "".join(x.text for x in sorted(rows, key=lambda x: x.seq) if x.message_id == r.message_id and x.text)) for r in rows} == {(1, "The cap [Q1] is "), (2, "Whole. End"), (3, "Halted "), (4, "x")}


def test_a_lane_with_room_hands_out_without_asking_its_queue():
    class Value:
        exists = lambda self: False
        update = lambda self, row: None

    class Runs:
        iterator = lambda self: iter(())
        updateValue = lambda self, key, row: None

    class Handle:
        # The queue's own states are not there at all.
        getMapState = lambda self, name, *kinds: Runs() if name == "running" else None
        getValueState = lambda self, *names: Value()
        registerTimer = lambda self, at: None

    lane = jobs.Lane(1 << 30, 1000, 2, False)
    lane.init(Handle())
    rows = pd.DataFrame([("a", "submit", 0, "A"), ("b", "submit", 1, "B"), ("a", "submit", 2, "A"), ("b", "done", 500, None), ("b", "submit", 600, "B"), ("c", "submit", 1300, "C")], columns=["job_id", "command", "at", "payload"])
    out = pd.concat(lane.handleInputRows((0,), iter([rows.assign(at=pd.to_datetime(rows["at"], unit="ms"))]), None))
    assert list(zip(out["job_id"], out["attempt"], out["at"].astype("datetime64[ms]").astype("int64"))) == [("a", 1, 0), ("b", 1, 1), ("b", 1, 600), ("a", 2, 1000), ("c", 1, 1300)]


def test_answers_that_are_whole_ask_for_no_state_of_their_own():
    asked = []

    class State:
        def __getattr__(self, name):
            return lambda *a: asked.append((name, a))

    class Handle(State):
        getMapState = getValueState = lambda self, *a: State()

    lane = citations.Lane(60_000)
    lane.init(Handle())
    tokens = [(k, n, n * 1_000_000, f"part {n} [Q9]", ["Q1"], n == 1 and k != 7, n == 1 and k == 5) for n in (1, 0) for k in range(300)]
    rows = pd.DataFrame(tokens, columns=["message_id", "seq", "micros", "token", "verified", "last", "stop"])
    out = pd.concat(lane.handleInputRows((0,), iter([rows[:250], rows[250:]]), None))
    ends = out[out["status"] != "STREAMING"]
    assert {k: (s, c) for k, s, c in zip(ends["message_id"], ends["status"], ends["content"])} == {k: ("STOPPED", "part 0 ") if k == 5 else ("COMPLETE", "part 0 part 1 ") for k in range(300) if k != 7}
    assert [name for name, _ in asked] == ["exists", "updateValue", "registerTimer", "update"]


def test_messages_of_one_lane_end_each_in_its_own_time(spark, tmp_path):
    schema = "message_id long, seq long, at timestamp, token string, verified array<string>, last boolean, stop boolean"
    token = lambda m, n, at, text, last=False: (m, n, S(at), text, ["Q1"], last, False)
    batches = [[token(1, 0, 0, "a"), token(2, 0, 50, "b ["), token(3, 0, 10, "c")], [token(3, 1, 55, "d", True), token(9, 0, 61, "x", True)], [token(2, 1, 100, "Q1] e"), token(1, 1, 90, "late")], [token(9, 0, 400, "y", True)], [token(2, 2, 500, "again", True)]]
    seen = {}
    for lanes in (1, 64):
        for k, batch in enumerate(batches):
            put(spark, tmp_path / f"in{lanes}", batch, schema)
            made = citations.messages(stream(spark, tmp_path / f"in{lanes}", schema), 60, lanes=lanes)
            made.writeStream.option("checkpointLocation", str(tmp_path / f"c{lanes}")).trigger(availableNow=True).start(str(tmp_path / f"out{lanes}"), format="parquet").awaitTermination(120)
        seen[lanes] = sorted((r.message_id, r.seq, r.status, r.content) for r in spark.read.parquet(str(tmp_path / f"out{lanes}")).collect() if r.content is not None)
    assert seen[1] == seen[64]
    assert (1, 0, "STOPPED", "a") in seen[1] and (3, 1, "COMPLETE", "cd") in seen[1] and (2, 1, "STOPPED", "b [Q1] e") in seen[1]
