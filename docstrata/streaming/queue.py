"""Batches that are released after quiet or at an age, and the work queue's rows, as folds over keyed state."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .counts import folder, source_of
from .keyed import Ordered, folded

MICROS = 1_000_000
QUEUED, DONE, DEAD, ATTEMPTS = "queued", "done", "dead", 3


def batched(quiet: int, age: int) -> Ordered:
    """A key's events in batches: one is released ``quiet`` seconds after its last event, or ``age`` seconds after its first. Its kinds are kept once each."""

    def release(kept: tuple) -> int:
        return min(kept[1] + quiet * MICROS, kept[0] + age * MICROS)

    def step(kept: tuple | None, event: tuple | None, until: int) -> tuple[tuple | None, list[tuple]]:
        out = []
        if kept and release(kept) <= (event[0] if event else until):
            out.append((kept[0], kept[1], release(kept), kept[2], kept[3]))
            kept = None
        if event:
            t, kind = event
            kinds = set(kept[3].split(",")) if kept else set()
            kept = (kept[0] if kept else t, t, (kept[2] if kept else 0) + 1, ",".join(sorted(kinds | {kind})))
        return kept, out

    names = ["key", "first", "last", "released", "n", "kinds"]
    return Ordered("t long, kind string", "first long, last long, n long, kinds string", step, lambda kept: release(kept) if kept else None, names)


def queued() -> Ordered:
    """A path's row in the work queue after each of its events.

    enqueue: new, or reset to queued with no attempts if the size changed; an
    unchanged row stays as it is, but a queued one takes the new priority.
    boost: a queued row goes to class 0. done, fail: of a queued row; the
    third failure is its last. Other events change nothing.
    """

    def step(kept: tuple | None, event: tuple | None, until: int) -> tuple[tuple | None, list[tuple]]:
        if event is None:
            return kept, []
        t, kind, size, prio = event
        if kept is None:
            if kind != "enqueue":
                return None, []
            kept = (QUEUED, prio, size, 0, t, 0)
        else:
            state, own, old, attempts, since, n = kept
            if kind == "enqueue" and size != old:
                state, own, old, attempts, since = QUEUED, prio, size, 0, t
            elif state == QUEUED and kind == "enqueue":
                own = prio
            elif state == QUEUED and kind == "boost":
                own = 0
            elif state == QUEUED and kind == "done":
                state = DONE
            elif state == QUEUED and kind == "fail":
                attempts += 1
                state = DEAD if attempts >= ATTEMPTS else QUEUED
            kept = (state, own, old, attempts, since, n + 1)
        return kept, [(*kept, t)]

    names = ["key", "state", "prio", "size", "attempts", "since", "seq", "at"]
    return Ordered("t long, kind string, size long, prio int", "state string, prio int, size long, attempts int, since long, seq long", step, lambda kept: None, names)


def run_closed(spark: SparkSession, path: str, columns: list[Column], processor: Ordered, schema: str, late: str, name: str) -> DataFrame:
    """What a fold leaves of the event files at ``path`` after all timers have fired: one micro-batch takes all files there are, so that no event can come late
    however their times are dealt to files, and a last event that moves the watermark past them; the next one has no data and fires the timers.

    The last event is any other at a far time; it is never folded, since the watermark stays behind it. Rows without key or time take no part: a null key
    would turn the keys beside it to floating point in pandas.
    """
    seen = spark.read.parquet(path)
    needed = lambda rows: rows.withColumn("ts", F.col("ts").cast("timestamp")).select(*columns, "ts").where("key IS NOT NULL AND ts IS NOT NULL")
    top = needed(seen).agg(F.max("ts")).first()[0]
    if top is None:
        return spark.createDataFrame([], schema)
    beat, out, state = (folder(spark, f"{name}-{x}") for x in ("beat", "out", "state"))
    last = needed(seen).limit(1).withColumn("ts", F.lit(top + datetime.timedelta(days=3650)))
    last.write.parquet(beat)
    events = needed(spark.readStream.schema(seen.schema).parquet(source_of(spark, path))).union(spark.readStream.schema(last.schema).parquet(beat))
    run = folded(events, ["key"], "ts", late, processor, schema).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(schema).parquet(out)
