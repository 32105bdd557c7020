"""Scratch tables in the cluster's shared folder, and small column helpers."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}


def _file_system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme; one without belongs to the cluster's default file system."""
    p, fs = _file_system(spark, path)
    return fs.makeQualified(p).toString()


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where the setting is absent (local sessions, tests) one temporary folder a
    session is used; on a cluster the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return qualified(spark, named)
    own = spark.conf.get("docstrata.scratch", None)
    if not own:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="docstrata-")
        spark.conf.set("docstrata.scratch", own)
    return own


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _file_system(spark, path)
    fs.delete(p, True)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; its folder goes with the cluster's own clean-up
            pass


def table_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/docstrata-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def small_batches(spark: SparkSession) -> None:
    """Rows hold whole texts, so Spark's own 10000 rows an Arrow batch are too many; a session's own setting stays."""
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def saved(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends here, and lost executors cost no recomputation.

    ``batch`` is the number of rows an Arrow batch while ``df`` is written, for rows that are large.
    """
    spark = df.sparkSession
    small_batches(spark)
    path, usual = table_path(spark, name), spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, batch or usual)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, usual)
    out = spark.read.schema(df.schema).parquet(path)
    out._docstrata_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables written by :func:`saved` that no later step reads."""
    for t in tables:
        path = getattr(t, "_docstrata_path", None)
        if path and path in _written:
            _delete(_written.pop(path), path)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker hands freed memory back: workers live on between tasks, and what they hold adds to their executor's."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


def bucket_of_id(col: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; null ids give null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def held_out(col: str, mod: int) -> Column:
    return F.coalesce(bucket_of_id(col, mod) == 1, F.lit(False))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


FEW, FEW_BYTES = 250_000, 2 << 20  # rows, and bytes as written, of a table that may be broadcast


def few(table: DataFrame) -> DataFrame:
    """A table written by :func:`saved`, marked for broadcast if it is small in rows and in bytes; a larger one is joined by shuffle, and AQE splits its hot keys."""
    p, fs = _file_system(table.sparkSession, table._docstrata_path)
    if fs.getContentSummary(p).getLength() > FEW_BYTES or table.count() > FEW:
        return table
    return F.broadcast(table)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one made from it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_length(lists: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, matrix) of the vectors of each length in an Arrow column without nulls."""
    flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    size = np.diff(at)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield int(d), rows, flat[(at[rows][:, None] + np.arange(d)[None]).reshape(-1)].reshape(len(rows), d)
