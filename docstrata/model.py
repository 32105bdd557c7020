"""The library model over the given tables: sources, versions, chunks, vectors.

The SQL twins are common table expressions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_status(source: Column) -> Column:
    """Lifecycle of a source by the number in its name: revoked, missing or active."""
    n = F.substring(source, 4, 10).cast("int") % 10
    return F.when(n == 0, "REVOKED").when(n == 1, "MISSING").otherwise("ACTIVE")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version per document, with its status and its source's."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    status = F.when(F.col("toxic") == 1, "FAILED").when(F.col("quality") == 0, "TEXT_READY").otherwise("READY")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.col("source").alias("source_id"), "lang", "text", "n_chars", status.alias("status"), source_status(F.col("source")).alias("source_status"))


VERSIONS = """ver AS (SELECT d.doc_id, d.source AS source_id, d.lang, d.text, d.n_chars,
  CASE WHEN l.toxic = 1 THEN 'FAILED' WHEN l.quality = 0 THEN 'TEXT_READY' ELSE 'READY' END AS status,
  CASE CAST(substr(d.source, 4) AS INTEGER) % 10 WHEN 0 THEN 'REVOKED' WHEN 1 THEN 'MISSING' ELSE 'ACTIVE' END AS source_status
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def keyword_eligible(v: DataFrame) -> DataFrame:
    return v.where((F.col("source_status") == "ACTIVE") & F.col("status").isin("READY", "TEXT_READY"))


def vector_eligible(v: DataFrame) -> DataFrame:
    return v.where((F.col("source_status") == "ACTIVE") & (F.col("status") == "READY"))


KEYWORD_OK = "source_status = 'ACTIVE' AND status IN ('READY', 'TEXT_READY')"
VECTOR_OK = "source_status = 'ACTIVE' AND status = 'READY'"


def windows(docs: DataFrame, size: int = 200, overlap: int = 40) -> DataFrame:
    """Sliding word windows: (doc_id, ordinal, start, words); one window if the text fits, else a stride of size - overlap until the end is covered."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    d = docs.select("doc_id", words.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - overlap - 1, F.lit(0))
    d = d.select("doc_id", "w", F.posexplode(F.sequence(F.lit(0), last, F.lit(size - overlap))).alias("ordinal", "start"))
    return d.select("doc_id", "ordinal", "start", F.slice("w", F.col("start") + 1, F.lit(size)).alias("words"))


def windows_sql(name: str = "win", size: int = 200, overlap: int = 40) -> str:
    return rf"""{name}_w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents),
{name}_s AS (SELECT doc_id, w, unnest(generate_series(0, greatest(len(w) - {overlap} - 1, 0), {size - overlap})) AS start FROM {name}_w WHERE len(w) > 0),
{name} AS (SELECT doc_id, start // {size - overlap} AS ordinal, start, w[start + 1:start + {size}] AS words FROM {name}_s)"""
