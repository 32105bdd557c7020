"""Corpus pipeline over the documents table.

quality: documents that the byte classifier rejects go. lines: repeated and
near-repeated lines go, and with them documents of which nothing is left.
near_duplicates: one document stays of each group of texts linked by word
5-gram Jaccard similarity of 0.8 or more. mixing: documents are kept, dropped
or repeated so that domain token totals meet the target shares; what is more
likely clean than not stays. tokens: the texts as SentencePiece ids.

Every stage but the last returns the columns it got, whatever their names; all
work on doc_id and text (the first and the fourth read the table labels too).

Edge cases: rows with null ids are judged by the first stage alone and pass
the others. A null or empty text is judged by its score, has no lines and no
near duplicates, and no tokens. Repeated rows stay together until one is kept
by near_duplicates, ties going to the smallest id; rows that share an id but
not the text are documents of their own until then. Very long texts pass
whole. Empty tables, and an empty labels table, give empty stages or stages
without a verdict (a score of 0.5 keeps, all rates are 1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm import line_dedup, mixing, ngram_join, pieces, quality
from docstrata.llm.queries import SHARES
from docstrata.llm.shared import dropped, free_name, read, saved


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = free_name(docs, "gone")
    out = line_dedup.deduplicated(docs, positions=gone)
    out = out.where(F.col(gone).isNull() | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, n=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resampled(docs, mixing.domain_of(read(spark, sf_dir, "labels")), SHARES, anchor="clean")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs, pieces.Vocabulary.load(), check=False).select("doc_id", "n_tokens", "ids")


STAGES = [("quality", keep_quality), ("lines", drop_lines), ("near_duplicates", drop_near_duplicates), ("mixing", mix), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir), name)
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
