"""Keyed state on streams: equal to the batch twins, and it shrinks."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from docprep.operators import runs as R
from docprep.streaming import run_to_end, stream_latest, stream_lines, stream_sessions, stream_states

EVENTS = "entity_id STRING, ts TIMESTAMP, at BIGINT, event STRING"


@pytest.fixture
def arrive(spark, tmp_path):
    """Writes events (entity, seconds, at, event) as the next file to arrive."""
    folder, n = tmp_path / "in", iter(range(1000))
    folder.mkdir()

    def put(rows):
        k = next(n)
        lines = [json.dumps({"entity_id": e, "ts": f"2024-01-01T{s // 3600:02}:{s // 60 % 60:02}:{s % 60:02}Z", "at": at, "event": v}) for e, s, at, v in rows]
        # Files are read in order of their time, which need not tell two quick ones apart.
        (folder / f"{k:04}.tmp").write_text("\n".join(lines))
        os.utime(folder / f"{k:04}.tmp", (1_700_000_000 + k,) * 2)
        (folder / f"{k:04}.tmp").rename(folder / f"{k:04}.json")

    put.folder = str(folder)
    return put


def stream_of(spark, arrive, schema=EVENTS):
    return stream_lines(spark, f"{arrive.folder}/*.json", schema, files_per_batch=1)


def started(stream, tmp_path, name):
    return stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()


def held(query):
    return query.lastProgress.stateOperators[0].numRowsTotal


def test_sessions_equal_batch(spark, rows, arrive):
    rng = random.Random(4)
    events = [(f"u{rng.randint(0, 2)}", 10 * k, k, rng.choice(["start", "start", "cancel", "result", "error", "line"])) for k in range(150)]
    ends = [(f"u{u}", 7200, 1000 + u, "line") for u in range(3)] + [("z", 7200, 2000, "start")]
    late = sorted(events, key=lambda e: e[1] + rng.randint(0, 280))  # in disorder, within the delay
    for k in range(0, 150, 50):
        arrive(late[k : k + 50])
    arrive(ends)
    got = run_to_end(stream_sessions(stream_of(spark, arrive), "5 minutes"), "sessions")
    batch = R.run_sessions(spark.createDataFrame([(e, at, v) for e, _, at, v in events], "entity_id STRING, at BIGINT, event STRING"))
    names = ["entity_id", "state", "started", "ended", "refused"]
    assert rows(got, *names) == rows(batch.filter("ended is not null"), *names)


def test_ended_sessions_leave_the_state(spark, arrive, tmp_path):
    arrive([("a", 0, 1, "start"), ("b", 1, 2, "start"), ("a", 2, 3, "start"), (None, 3, 4, "start")])
    query = started(stream_sessions(stream_of(spark, arrive), "1 minute", "20 minutes"), tmp_path, "left_sessions")
    try:
        query.processAllAvailable()
        waiting = held(query)
        arrive([("a", 60, 5, "cancel"), ("a", 70, 6, "result"), ("c", 400, 7, "start")])
        query.processAllAvailable()
        arrive([("a", 65, 8, "start"), ("c", 500, 9, "line"), ("c", 501, 10, "start")])  # the first is late
        query.processAllAvailable()
        # An ended run has left; "b" and "c" are open.
        assert [tuple(r) for r in spark.table("left_sessions").collect()] == [("a", "cancelled", 1, 6, 1)]
        between = held(query)
        arrive([("d", 4000, 11, "line"), ("e", 4000, 12, "cancel")])
        query.processAllAvailable()
        given_up = {tuple(r) for r in spark.table("left_sessions").collect()} - {("a", "cancelled", 1, 6, 1)}
        assert given_up == {("b", "running", 2, None, 0), ("c", "running", 7, None, 1)}
        assert held(query) < between and held(query) < waiting
    finally:
        query.stop()


def test_states_leave_after_their_delay(spark, arrive, tmp_path):
    shape = "run_id STRING, ts TIMESTAMP, at BIGINT, event STRING"
    events = [("a", 0, 1, "start"), ("b", 5, 2, "start"), ("a", 9, 4, "result"), ("a", 8, 3, "cancel"), ("b", 12, 5, "start"), (None, 1, 1, "start")]
    arrive(events)
    stream = stream_states(stream_of(spark, arrive, EVENTS).withColumnRenamed("entity_id", "run_id"), "1 minute", "10 minutes")
    writer = stream.writeStream.format("memory").queryName("left_states").outputMode("update")
    query = writer.option("checkpointLocation", str(tmp_path / "states")).start()
    try:
        query.processAllAvailable()
        want = R.run_states(spark.createDataFrame([(r, at, e) for r, _, at, e in events if r], "run_id STRING, at BIGINT, event STRING"))
        assert {tuple(r) for r in spark.table("left_states").collect()} == {tuple(r) for r in want.collect()}
        assert shape and held(query) == 2
        arrive([("c", 1000, 6, "start")])
        query.processAllAvailable()
        assert held(query) == 2  # "b" and "c"; "a" has left
    finally:
        query.stop()


def test_latest_equals_batch_for_any_arrival(spark, rows, arrive):
    shape = "entity_id STRING, seq BIGINT, state STRING, value DOUBLE, ts TIMESTAMP, at BIGINT, event STRING"
    rng = random.Random(7)
    runs = [(f"u{rng.randint(0, 3)}", k, k, rng.choice(["result", "result", "error", "cancelled"])) for k in range(60)]
    rng.shuffle(runs)
    for k in range(0, 60, 20):
        arrive(runs[k : k + 20])
    arrive([(None, 1, 99, "result")])
    stream = stream_of(spark, arrive, shape).select("entity_id", F.col("at").alias("seq"), F.col("event").alias("state"), (F.col("at") / 4).alias("value"))
    got = run_to_end(stream_latest(stream), "latest", "update", F.col("entity_id"))
    batch = R.latest_result(spark.createDataFrame([(e, at, s, at / 4) for e, _, at, s in runs], "entity_id STRING, seq BIGINT, state STRING, value DOUBLE"))
    assert rows(got, *batch.columns) == rows(batch)
