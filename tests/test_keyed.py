"""Folds over keyed state: replays of the same events in other files and orders leave the same rows."""

import datetime
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docstrata.streaming import keyed
from docstrata.streaming.queue import batched, queued, run_closed

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
SCHEMA = "ts timestamp, user_id long, kind string, size long, prio int"


def events():
    r = random.Random(5)
    return [(START + datetime.timedelta(seconds=r.randrange(4000)), r.randrange(4), r.choice(["enqueue", "enqueue", "boost", "done", "fail", "fail", "other"]), r.choice([1, 1, 1, 2]), r.choice([1, 2])) for _ in range(160)]


def replay(spark, folder, rows, files, processor, schema, columns):
    for k in range(files):
        spark.createDataFrame(rows[k::files], SCHEMA).coalesce(1).write.parquet(f"{folder}/part-{k}.parquet/x")
    path = f"{folder}/all.parquet"
    for k in range(files):
        spark.read.parquet(f"{folder}/part-{k}.parquet/x").write.mode("append").parquet(path)
    return sorted(tuple(x) for x in run_closed(spark, path, columns, processor, schema, "2 hours", "test").collect())


KEY = "user_id AS key"


def test_batches(spark, tmp_path):
    rows = events()
    want = []
    for user in range(4):
        mine, open_ = sorted((int(t.timestamp() * 10**6), k) for t, u, k, _, _ in rows if u == user), []
        for t, k in mine:
            if open_ and t >= min(open_[-1][0] + 60_000_000, open_[0][0] + 200_000_000):
                want.append((user, open_))
                open_ = []
            open_ = [*open_, (t, k)]
        want.append((user, open_))
    want = sorted((u, b[0][0], b[-1][0], min(b[-1][0] + 60_000_000, b[0][0] + 200_000_000), len(b), ",".join(sorted({k for _, k in b}))) for u, b in want)
    schema = "key long, first long, last long, released long, n long, kinds string"
    for k, files in enumerate((1, 5)):
        random.Random(k).shuffle(rows)
        assert replay(spark, tmp_path / str(k), rows, files, batched(60, 200), schema, [F.expr(KEY), "kind"]) == want


def test_queue(spark, tmp_path):
    rows = events()
    schema = "key long, state string, prio int, size long, attempts int, since long, seq long, at long"
    got = []
    for k, files in enumerate((1, 4)):
        random.Random(k).shuffle(rows)
        got.append(replay(spark, tmp_path / str(k), rows, files, queued(), schema, [F.expr(KEY), "kind", "size", "prio"]))
    assert got[0] == got[1] and len(got[0]) > 100 and {r[1] for r in got[0]} >= {"queued", "done"}


@pytest.mark.parametrize(
    ("events", "want"),
    [
        ([("boost", 1, 1)], None),
        ([("enqueue", 1, 2)], ("queued", 2, 1, 0)),
        ([("enqueue", 1, 2), ("boost", 1, 1)], ("queued", 0, 1, 0)),
        ([("enqueue", 1, 2), ("done", 1, 1), ("enqueue", 1, 1)], ("done", 2, 1, 0)),
        ([("enqueue", 1, 2), ("done", 1, 1), ("enqueue", 2, 1)], ("queued", 1, 2, 0)),
        ([("enqueue", 1, 2), ("fail", 1, 1), ("fail", 1, 1), ("enqueue", 1, 1)], ("queued", 1, 1, 2)),
        ([("enqueue", 1, 2), ("fail", 1, 1), ("fail", 1, 1), ("fail", 1, 1), ("boost", 1, 1)], ("dead", 2, 1, 3)),
        ([("enqueue", 1, 2), ("fail", 1, 1), ("fail", 1, 1), ("fail", 1, 1), ("enqueue", 3, 1)], ("queued", 1, 3, 0)),
    ],
)
def test_queue_steps(events, want):
    kept = None
    for t, e in enumerate(events):
        kept, _ = queued().step(kept, (t, *e), t)
    assert (kept[:4] if kept else None) == want


BATCHES = "key long, first long, last long, released long, n long, kinds string"


def one_each(t, user):
    """A batch of one event, released after a minute."""
    at = int(t.timestamp() * 10**6)
    return (user, at, at, at + 60_000_000, 1, "x")


def test_many_files_with_the_newest_first(spark, tmp_path):
    rows = [(START + datetime.timedelta(hours=h), h % 2, "x") for h in range(60)] + [(START + datetime.timedelta(minutes=2 * m), 7, "x") for m in range(2500)]
    path = str(tmp_path / "all.parquet")
    for k in range(35, -1, -1):
        spark.createDataFrame([r for r in rows if (r[0] - START).total_seconds() // 8400 == k], "ts timestamp, user_id long, kind string").coalesce(1).write.mode("append").parquet(path)
    got = sorted(tuple(r) for r in run_closed(spark, path, [F.expr(KEY), "kind"], batched(60, 200), BATCHES, "1 minute", "test").collect())
    assert got == sorted(one_each(t, u) for t, u, _ in rows)


def test_rows_without_key_take_no_part(spark, tmp_path):
    rows = [(START + datetime.timedelta(hours=h), u, "x") for h in range(3) for u in (None, *range(40))] + [(None, 3, "x")]
    path = str(tmp_path / "all.parquet")
    spark.createDataFrame(rows, "ts timestamp, user_id long, kind string").coalesce(1).write.parquet(path)
    got = sorted(tuple(r) for r in run_closed(spark, path, [F.expr(KEY), "kind"], batched(60, 200), BATCHES, "2 days", "test").collect())
    assert got == sorted(one_each(t, u) for t, u, _ in rows if t and u is not None)


def test_gathered(monkeypatch):
    monkeypatch.setattr(keyed, "GATHER", 4)
    schema = pa.schema([("key", pa.int64()), ("t", pa.int64()), ("kind", pa.string())])
    given = [pa.RecordBatch.from_pydict({"key": [k % 2 for k in part], "t": list(part), "kind": [None if k == 3 else str(k) for k in part]}, schema) for part in (range(3), range(3, 6), range(6, 7), range(7, 7))]
    got = [r for b in keyed.gathered(iter(given), ["key"], ["t", "kind"]) for r in b.to_pylist()]
    assert [r["last"] for r in got] == [4, 5, 6]
    assert sorted((t, r["key"]) for r in got for t in r["t"]) == [(k, k % 2) for k in range(7)] and {t: k for r in got for t, k in zip(r["t"], r["kind"])} == {k: None if k == 3 else str(k) for k in range(7)}
