"""Sections of marked-up text, by windows over its lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADING = r"^(#{1,3}) +(.+)$"
FENCE = r"^\s*(```|~~~)"


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section, heading_path, first_line, text) of texts (doc_id, text).

    A heading of level 1 to 3 opens a section; lines inside code fences open
    none. The path holds the nearest heading of each level above that no
    heading of a lower level has closed since.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    line = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    fence = line.withColumn("inside", F.sum(F.col("line").rlike(FENCE).cast("int")).over(w) % 2)
    level = F.when((F.col("inside") == 0) & F.col("line").rlike(HEADING), F.length(F.regexp_extract("line", HEADING, 1))).otherwise(0)
    d = fence.withColumn("level", level).withColumn("title", F.trim(F.regexp_extract("line", HEADING, 2)))
    d = d.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(w))
    for k in (1, 2, 3):  # the last heading of this level, with its place
        d = d.withColumn(f"h{k}", F.last(F.when(F.col("level") == k, F.struct("pos", "title")), ignorenulls=True).over(w))
    h1, h2, h3 = (F.col(f"h{k}") for k in (1, 2, 3))
    after = lambda x, *up: F.when(F.greatest(F.lit(-1), *(F.coalesce(u["pos"], F.lit(-1)) for u in up)) < x["pos"], x["title"])
    d = d.withColumn("path", F.array_join(F.array_compact(F.array(h1["title"], after(h2, h1), after(h3, h1, h2))), " > "))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return d.groupBy("doc_id", "section").agg(F.max_by("path", "pos").alias("heading_path"), F.min("pos").alias("first_line"), body.alias("text"))
