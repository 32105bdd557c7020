"""Exclusive times of nested and overlapping spans: a sweep over their edges in which the deepest active span wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exclusive(spans: DataFrame, keys: list[str], rest: str = "overhead") -> DataFrame:
    """keys, name, time: how long each name was the deepest one active; what no span covers between the first edge and the last goes to ``rest``.

    spans: keys, name, depth, start, stop (whole numbers). Of equal depths the
    smaller name wins. Levels (depth, name) are a few constants of what is
    timed, and each has a running count of open spans along the edges, so no
    span is compared with another, and a key's edges stream through a sort
    that may spill. Spans with a null edge, or that end before they start,
    take no part; empty ones only set an edge.
    """
    real = spans.where(F.col("start") <= F.col("stop"))
    levels = [(r["depth"], r["name"]) for r in real.select("depth", "name").distinct().orderBy("depth", F.desc("name")).collect()]
    step = F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("stop").alias("t"), F.lit(-1).alias("d")))
    edges = real.select(*keys, "depth", "name", F.explode(step).alias("e"))
    opened = [F.sum(F.when((F.col("depth") == d) & (F.col("name") == n), F.col("e.d")).otherwise(0)).alias(f"_o{i}") for i, (d, n) in enumerate(levels)]
    each = edges.groupBy(*keys, F.col("e.t").alias("t")).agg(*opened)
    w = Window.partitionBy(*keys).orderBy("t")
    active = F.lit(rest)
    for i, (_, name) in enumerate(levels):  # from shallow to deep: the last that is open counts
        active = F.when(F.sum(f"_o{i}").over(w) > 0, name).otherwise(active)
    parts = each.select(*keys, active.alias("name"), (F.lead("t").over(w) - F.col("t")).alias("time")).where("time > 0")
    return parts.groupBy(*keys, "name").agg(F.sum("time").alias("time"))
