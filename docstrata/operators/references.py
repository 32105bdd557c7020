"""References from one document to another: containment of title tokens, a date, a party in common, and one target only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that say nothing about which document a title means.
COMMON = "the a an of and agreement contract inc llc corp corporation company ltd co".split()


def title_tokens(title: Column) -> Column:
    found = F.regexp_extract_all(F.lower(title), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda t: ~t.isin(COMMON)))


def candidates(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """ref, doc: documents that a reference may mean.

    refs: ref, want (tokens), day (or null), parties. docs: doc, have (tokens),
    day, parties. A document must hold all tokens of the reference, share a
    party with it, and be of the day it names; a reference without a day needs
    tokens of its own, one without tokens a day.

    The sets meet by an equality join on a party and the reference's rarest
    token, so a common word or a party of many documents alone brings nobody
    together; the whole set is tested after that.
    """
    held = docs.select("doc", F.explode("have").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    asked = refs.select("ref", "want", F.explode_outer("want").alias("token")).join(held, "token", "left")
    rare = asked.groupBy("ref", "want").agg(F.coalesce(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")), F.lit("")).alias("token"))
    left = refs.join(rare, ["ref", "want"]).select("ref", "want", F.col("day").alias("asked_day"), "token", F.explode(F.array_distinct("parties")).alias("party"))
    right = docs.select("doc", "have", "day", F.explode(F.array_distinct("parties")).alias("party"))
    right = right.withColumn("token", F.explode(F.concat("have", F.array(F.lit("")))))
    met = left.join(right, ["party", "token"]).where(F.size(F.array_except("want", "have")) == 0)
    dated = F.col("asked_day").isNotNull() & (F.col("day") == F.col("asked_day"))
    plain = F.col("asked_day").isNull() & (F.size("want") > 0)
    return met.where(dated | plain).select("ref", "doc").distinct()


def resolved(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """ref, doc for the references that mean one document; ambiguous ones have no row."""
    return candidates(refs, docs).groupBy("ref").agg(F.count("*").alias("n"), F.min("doc").alias("doc")).where("n = 1").select("ref", "doc")
