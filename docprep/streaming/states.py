"""Keyed state on streams: sessions that end, run states that leave, newest results.

Each entity's state lies with the entity, in the RocksDB state store; an entity's events are handled one after
the other, and only entities with new events or a due timer are touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: the store that keyed state needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENDS = ("result", "error")


def use_keyed_state(spark: SparkSession) -> None:
    """Let streams started from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _millis(delay: str) -> int:
    """Milliseconds of an interval such as "10 minutes"."""
    spark = SparkSession.active()
    return spark.sql(f"SELECT unix_millis(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {delay})").first()[0]


class _Sessions(StatefulProcessor):
    """Events wait until the watermark has passed them, so that they are read in order of time."""

    def __init__(self, give_up: int | None):
        self.give_up = give_up

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms BIGINT, at BIGINT, event STRING")
        self.run = handle.getValueState("run", "started BIGINT, cancelled BOOLEAN, refused BIGINT, ms BIGINT")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [(r["ms"], r["at"], r["event"]) for r in rows]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(new)[0])
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        run = self.run.get() if self.run.exists() else None
        waiting = sorted(tuple(e) for e in self.waiting.get())
        later = [e for e in waiting if e[0] > now]
        for ms, at, event in waiting[: len(waiting) - len(later)]:
            if run is None:
                if event == "start":
                    run = (at, False, 0, ms)
                continue
            started, cancelled, refused, _ = run
            if event in ENDS:
                yield Row(entity_id=key[0], state="cancelled" if cancelled else event, started=started, ended=at, refused=refused)
                run = None
            else:
                run = (started, cancelled or event == "cancel", refused + (event == "start"), ms)
        if run is not None and self.give_up is not None and run[3] + self.give_up <= now:
            yield Row(entity_id=key[0], state="cancelling" if run[1] else "running", started=run[0], ended=None, refused=run[2])
            run = None
        if run is not None:
            self.run.update(run)
            if self.give_up is not None:
                self.handle.registerTimer(run[3] + self.give_up)
        else:
            self.run.clear()
        self.waiting.clear()
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0])


def stream_sessions(events: DataFrame, delay: str, give_up: str | None = None) -> DataFrame:
    """L3 on a stream: ``(entity_id, ts, at, event)`` to one row per ended run ``(entity_id, state, started, ended, refused)``.

    The rules are those of ``run_sessions``. Events may arrive in any order within ``delay``; they are read by (``ts``, ``at``)
    once the watermark has passed them, and later ones are dropped. ``at`` is a whole number that no two events of
    an entity share. A run that ended leaves the state with all its events, so state holds open
    runs and the events of one delay. ``give_up``: a run without an event for so long leaves it too, with its open
    state and no end. Rows without an entity or time are left out.
    """
    use_keyed_state(events.sparkSession)
    out = "entity_id STRING, state STRING, started BIGINT, ended BIGINT, refused BIGINT"
    kept = events.filter(F.col("event").isin("start", "cancel", *ENDS) & F.col("entity_id").isNotNull() & F.col("at").isNotNull())
    kept = kept.select(
        F.col("entity_id").cast("string").alias("entity_id"), F.unix_millis("ts").alias("ms"), F.col("at").cast("bigint").alias("at"), "event", "ts"
    )
    timed = kept.filter("ts is not null").withWatermark("ts", delay)
    processor = _Sessions(None if give_up is None else _millis(give_up))
    return timed.groupBy("entity_id").transformWithState(processor, out, "Append", "eventTime")


class _States(StatefulProcessor):
    """First start, first end, first cancel and number of starts of a run, in any order of arrival."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        shape = "started BIGINT, ended BIGINT, event STRING, cancelled BIGINT, starts BIGINT, until BIGINT"
        self.seen = handle.getValueState("seen", shape)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        started, ended, event, cancelled, starts, until = self.seen.get() if self.seen.exists() else (None, None, None, None, 0, None)
        before = until
        for r in rows:
            if r["event"] == "start":
                starts += 1
                started = r["at"] if started is None else min(started, r["at"])
            elif r["event"] == "cancel":
                cancelled = r["at"] if cancelled is None else min(cancelled, r["at"])
            elif r["event"] in ENDS:
                if ended is None or (r["at"], r["event"]) < (ended, event):
                    ended, event = r["at"], r["event"]
                until = max(until or 0, r["ms"] + self.keep)
        self.seen.update((started, ended, event, cancelled, starts, until))
        if until != before:
            self.handle.registerTimer(until)
        if ended is None:
            state = "running" if cancelled is None else "cancelling"
        else:
            state = "cancelled" if cancelled is not None and cancelled < ended else event
        yield Row(run_id=key[0], state=state, started=started, ended=ended, refused=max(starts - 1, 0))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.seen.exists() and self.seen.get()[5] <= timerValues.getCurrentWatermarkInMs():
            self.seen.clear()
        return iter(())


def stream_states(events: DataFrame, delay: str, keep: str) -> DataFrame:
    """L3 on a stream: the state of each run from ``(run_id, ts, at, event)``, by the rules of ``run_states``, updated as events arrive.

    A run leaves the state when the watermark is ``keep`` past its last end event; events after that would begin it
    anew. Events later than ``delay`` are dropped. Rows without a run or time are left out.
    """
    use_keyed_state(events.sparkSession)
    rows = events.filter("run_id is not null and ts is not null and at is not null").select(
        F.col("run_id").cast("string").alias("run_id"), F.unix_millis("ts").alias("ms"), F.col("at").cast("bigint").alias("at"), "event", "ts"
    )
    out = "run_id STRING, state STRING, started BIGINT, ended BIGINT, refused BIGINT"
    return rows.withWatermark("ts", delay).groupBy("run_id").transformWithState(_States(_millis(keep)), out, "Update", "eventTime")


class _Latest(StatefulProcessor):
    def __init__(self, names: list[str], shape: T.StructType, entity: str, order: str):
        self.names, self.shape, self.entity, self.place = names, shape, entity, names.index(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", self.shape)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = tuple(self.held.get()) if self.held.exists() else None
        newest = held
        for r in rows:
            if newest is None or r[self.names[self.place]] > newest[self.place]:
                newest = tuple(r[n] for n in self.names)
        if newest is not None and newest is not held:
            self.held.update(newest)
            yield Row(**{self.entity: key[0]}, **dict(zip(self.names, newest, strict=True)))


def stream_latest(runs: DataFrame, entity: str = "entity_id", order: str = "seq") -> DataFrame:
    """W4 on a stream: a row whenever a newer successful result of an entity arrives.

    State is the newest result of each entity; results that arrive after a newer one are refused, failed and cancelled runs
    replace nothing, equal ``order`` values keep the one that came first. Rows without an entity or order are left out.
    """
    use_keyed_state(runs.sparkSession)
    names = [c for c in runs.columns if c != entity]
    shape = T.StructType([runs.schema[n] for n in names])
    whole = T.StructType([runs.schema[entity], *shape.fields])
    done = runs.filter((F.col("state") == "result") & F.col(entity).isNotNull() & F.col(order).isNotNull())
    return done.groupBy(entity).transformWithState(_Latest(names, shape, entity, order), whole, "Update", "None")
