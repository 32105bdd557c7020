"""Keyed state with event-time timers: folds over each key's events in the order of their times, whatever order they arrive in.

A key's events wait in state until the watermark has passed them, so that none
can come before; then they are folded in the order of time (ties by the other
columns) and leave. What a fold keeps between times, and what it gives out, is
one small row. Replays that deal the same events to other files or batches
leave the same rows, as long as none is later than the watermark allows.
"""

from __future__ import annotations

import itertools
import json
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, StructField, StructType

GATHER = 500_000  # events that a task gathers by key at a time
PACK = 1000  # events in an entry of the store, rows in a row that leaves
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ordered(StatefulProcessor):
    """``step(kept, event, until)`` gets what is kept of a key (or None), its next event (or None: nothing before ``until`` is left) and a time in microseconds; it gives what to keep, and rows to emit.

    ``wake(kept)`` is the time at which the fold has to be asked again although
    no event came, or None.
    """

    def __init__(self, event: str, kept: str, step: Callable[[tuple | None, tuple | None, int], tuple[tuple | None, list[tuple]]], wake: Callable[[tuple | None], int | None], names: list[str]) -> None:
        self.event, self.kept, self.step, self.wake, self.names = event, kept, step, wake, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")  # an entry holds many events: one call to the store, not one for each
        self.held = handle.getValueState("held", self.kept)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        seen = timerValues.getCurrentWatermarkInMs() * 1000  # what is not after it came later than the stream allows, and its place in the order may be folded
        first, end = len(key), len(key) + len(self.event.split(", "))
        new = [e for r in rows for e in zip(*r[first:end]) if e[0] > seen]
        if new:
            self.waiting.appendList(self._packed(new))
            self._wake(min(e[0] for e in new))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(r for (part,) in self.waiting.get() for r in pickle.loads(part))
        ready = [r for r in waiting if r[0] <= until]
        before = self.held.get()
        kept, out = before, []
        for event in [*ready, None]:
            kept, given = self.step(kept, event, until)
            out += given
        left = waiting[len(ready) :]
        if left:
            self.waiting.put(self._packed(left))
        elif waiting:
            self.waiting.clear()
        if kept is not None:
            self.held.update(kept)
        elif before is not None:
            self.held.clear()
        times = [t for t in (left[0][0] if left else None, self.wake(kept)) if t is not None]
        if times:
            self._wake(min(times), expiredTimerInfo.getExpiryTimeInMs())
        for i in range(0, len(out), PACK):
            yield Row(**dict(zip(self.names, key)), rows=json.dumps([dict(zip(self.names[len(key) :], r)) for r in out[i : i + PACK]]))

    def _packed(self, events: list[tuple]) -> list[tuple]:
        return [(pickle.dumps(events[i : i + PACK]),) for i in range(0, len(events), PACK)]

    def _wake(self, micros: int, over: int = -1) -> None:
        """At the end of the millisecond, as timers of Spark count these; ``over`` is the timer that goes off just now, and is still listed."""
        at = micros // 1000 + 1
        if not any(t <= at for t in self.handle.listTimers() if t != over):
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def gathered(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """A key's events of up to ``GATHER`` rows as one row: a list for each column, and the last time (the first column is the time)."""
    held, n = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            n += batch.num_rows
        if n >= GATHER or (n and batch is None):
            rows = pa.Table.from_batches(held).group_by(keys, use_threads=False).aggregate([*((c, "list") for c in columns), (columns[0], "max")])
            yield from rows.select([*keys, *(f"{c}_list" for c in columns), f"{columns[0]}_max"]).rename_columns([*keys, *columns, "last"]).to_batches()
            held, n = [], 0


def folded(stream: DataFrame, keys: list[str], time: str, late: str, processor: Ordered, schema: str) -> DataFrame:
    """The rows that a fold emits over a stream with event time ``time``; ``processor.event`` names the other columns that it needs, the time in microseconds first.

    Rows cost the state operator more than keys do; so a key's events are dealt to one task and gathered into few rows before it.
    """
    stream.sparkSession.conf.set(STORE, ROCKSDB)
    columns = [c.split()[0] for c in processor.event.split(", ")]
    given = stream.select(*keys, F.unix_micros(F.col(time)).alias(columns[0]), *columns[1:]).repartition(*keys)
    lists = StructType([given.schema[k] for k in keys] + [StructField(c, ArrayType(given.schema[c].dataType)) for c in columns]).add("last", "long")
    given = given.mapInArrow(lambda batches: gathered(batches, keys, columns), lists).withColumn(time, F.timestamp_micros("last")).drop("last")
    fields = StructType.fromDDL(schema).fields
    packed, rows = StructType(fields[: len(keys)]).add("rows", "string"), ArrayType(StructType(fields[len(keys) :]))
    given = given.withWatermark(time, late).groupBy(*keys).transformWithState(statefulProcessor=processor, outputStructType=packed, outputMode="Append", timeMode="EventTime")
    return given.select(*keys, F.inline(F.from_json("rows", rows)))
