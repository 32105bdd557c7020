"""Structured Streaming over event files."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors both write: under spark.checkpoint.dir, else (local sessions only) a temporary one. It goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.gettempdir()
    path = f"{base}/docstrata-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session is gone, and the folder goes with the cluster's own clean-up
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def daily(stream: DataFrame) -> DataFrame:
    """Counts by event-time day and kind, late rows accepted for two days."""
    day = F.window(F.col("ts"), "1 day")
    return stream.withWatermark("ts", "2 days").groupBy(day, "event_type").agg(F.count("*").alias("n"))


def bursts(stream: DataFrame, gap: str) -> DataFrame:
    """Sessions of each user, closed after ``gap`` of quiet."""
    return stream.withWatermark("ts", gap).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def source_of(spark: SparkSession, path: str) -> str:
    """A path as streams read it: a folder, or a pattern that fits the one file alone."""
    above, name = path.rsplit("/", 1)
    return path if len(spark.read.parquet(path).inputFiles()) > 1 else f"{above}/[{name[0]}]{name[1:]}"


def streamed_counts(spark: SparkSession, path: str) -> DataFrame:
    """Runs the daily counts over all files there are, a micro-batch at a time, and returns the table they left."""
    seen = spark.read.parquet(path)
    out = folder(spark, "daily")
    kind = seen.schema["ts"].dataType
    stream = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 16).parquet(source_of(spark, path)).withColumn("ts", F.col("ts").cast("timestamp"))

    def keep(batch: DataFrame, _: int) -> None:
        batch.select(F.col("window.start").cast(kind).alias("day"), "event_type", "n").write.mode("overwrite").parquet(out)

    run = daily(stream).writeStream.outputMode("complete").option("checkpointLocation", folder(spark, "stream")).foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out)
