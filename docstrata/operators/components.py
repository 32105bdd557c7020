"""Connected components of a link table: least label, and labels of labels, until none changes."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, which ends its lineage there; local sessions without one get a temporary folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="docstrata-"))
    return df.checkpoint()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of ``links`` (a, b), of any type that has an order; component: the smallest id reachable.

    Labels spread along links, and each then takes its label's own label, so
    the rounds grow with the logarithm of a path rather than with its length.
    A hub's links are summed up before they are shuffled. Links with a null end
    are left out.
    """
    one = links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    both = cut(one.union(one.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "id")
        hooked = labels.join(near, "id").select("id", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jumped = hooked.join(labels.select(F.col("id").alias("to"), F.col("label").alias("further")), "to").select("id", F.least("to", "further").alias("label"), "was")
        step = cut(jumped)
        labels = step.select("id", "label")
        if not step.where("label <> was").limit(1).count():
            return labels.withColumnRenamed("label", "component")
