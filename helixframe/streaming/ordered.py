"""Operators on ordered rows as streams: each key's rows are taken in the order of their time, with state from one row to the next.

A row waits until the watermark has passed it, so rows that come late, but within the delay, are still taken in their place; then it
is sent out with its result. State of a key: what the fold carries, and the rows that wait. Rows later than the delay are dropped, as by
every operator of the engine with a watermark. Streams need the RocksDB state store (see `state_store`).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor


def state_store(spark: SparkSession) -> None:
    """Sets the state store that keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _InOrder(StatefulProcessor):
    """fold(state, row) -> (state, result) over each key's rows by time, then by the tie columns; rows are dicts, states tuples.

    Rows of a batch wait as one pickled list, and are touched again only when a timer finds the first of them due.
    """

    def __init__(self, columns: list[str], order: list[str], state: T.StructType, start: tuple, fold: Callable):
        self.columns, self.order, self.state_schema, self.start, self.fold = columns, order, state, start, fold

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.state = handle.getValueState("state", self.state_schema)

    def _wait(self, rows: list[tuple], write: Callable) -> None:
        write(pickle.dumps(rows))
        at = self.columns.index(MICROS)
        self.handle.registerTimer(-(-min(r[at] for r in rows) // 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # A row that is due already meets its timer at the end of the same batch.
        self._wait([tuple(r[c] for c in self.columns) for r in rows], lambda b: self.waiting.appendValue((b,)))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [dict(zip(self.columns, r, strict=True)) for (b,) in self.waiting.get() for r in pickle.loads(b)]
        due = sorted((r for r in rows if r[MICROS] <= limit), key=lambda r: tuple(r[c] for c in self.order))
        if not due:
            return
        rest = [tuple(r.values()) for r in rows if r[MICROS] > limit]
        if rest:
            self._wait(rest, lambda b: self.waiting.put([(b,)]))
        else:
            self.waiting.clear()
        state = self.state.get()
        state = self.start if state is None else tuple(state)
        out = Row(*self.columns, "__result")
        for r in due:
            state, result = self.fold(state, r)
            yield out(*r.values(), result)
        self.state.update(state)

    def close(self) -> None:
        pass


MICROS = "__micros"
WAITING = T.StructType([T.StructField("rows", T.BinaryType())])


def in_order(rows: DataFrame, key: str, ts: str, ties: list[str], late: str, state: str, start: tuple, fold: Callable, name: str, kind: T.DataType) -> DataFrame:
    """A stream's rows with `name`, the result of the fold over the rows of the same key so far. ts: UTC timestamps, never null; watermarks
    count milliseconds, so a row waits until the whole millisecond of its time has passed. The fold sees no ts."""
    slim = rows.withWatermark(ts, late).withColumn(MICROS, F.unix_micros(ts))
    fields = [*(f for f in rows.schema.fields if f.name != ts), T.StructField(MICROS, T.LongType())]
    processor = _InOrder([f.name for f in fields], [MICROS, *ties], T.StructType.fromDDL(state), start, fold)
    out = T.StructType([*fields, T.StructField("__result", kind)])
    found = slim.groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=out, outputMode="append", timeMode="eventtime")
    return found.select(*(F.timestamp_micros(MICROS).alias(ts) if c == ts else c for c in rows.columns), F.col("__result").alias(name))


def carried_forward(rows: DataFrame, key: str, ts: str, ties: list[str], value: str, name: str, default: str, late: str = "1 hour") -> DataFrame:
    """The last text of the column `value` that was not null, up to the row itself, by key."""

    def fold(state: tuple, row: dict) -> tuple[tuple, str]:
        last = state[0] if row[value] is None else row[value]
        return (last,), default if last is None else last

    return in_order(rows, key, ts, ties, late, "last string", (None,), fold, name, T.StringType())


def backtrack_chunks(rows: DataFrame, key: str, ts: str, ties: list[str], value: str, direction: str, tolerance: float, late: str = "1 hour") -> DataFrame:
    """The chunk, from 1: a row begins a new one if it goes back against the direction of the row before by more than the tolerance (the
    row's own direction counts where the one before has none)."""

    def fold(state: tuple, row: dict) -> tuple[tuple, int]:
        before, way, chunk = state
        way = way if way in ("+", "-") else row[direction]
        if before is None:
            chunk += 1
        elif row[value] is not None:
            chunk += (row[value] - before if way == "-" else before - row[value]) > tolerance
        return (row[value], row[direction], chunk), chunk

    return in_order(rows, key, ts, ties, late, "before double, way string, chunk long", (None, None, 0), fold, "chunk", T.LongType())
