"""Names in texts: keys of a name, word windows of a question, look-up of the longest ones, and entities that share a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, SUFFIXES, core_name, normal_name
from .components import components

WORDS = 6  # of the longest window
RAW = r"[\p{L}\p{N}][\p{L}\p{N}'’&.\-]*"


def usable(key: Column) -> Column:
    """Whether a key is distinctive: three characters at least, four where it is one word, and not made of stop words and corporate suffixes alone."""
    words = F.split(key, " ")
    common = F.forall(words, lambda w: w.isin(STOPWORDS) | w.isin(SUFFIXES))
    return (F.length(key) >= 3) & ~common & ((F.size(words) > 1) | (F.length(key) >= 4))


def keys_of(name: Column) -> Column:
    """The usable keys of a name: as written, and without corporate suffixes."""
    return F.filter(F.array_distinct(F.array(normal_name(name), core_name(name))), usable)


def word_windows(question: Column, sizes: list[int] | None = None) -> Column:
    """(key, start, stop, capital) of every run of one to six words (or of ``sizes`` words), by word positions from 0; a written word with inner marks may be several."""
    raw = F.regexp_extract_all(question, F.lit(RAW), F.lit(0))
    flat = F.flatten(F.transform(raw, lambda r: F.transform(F.filter(F.split(normal_name(r), " "), lambda w: w != ""), lambda w: F.struct(w.alias("w"), r.rlike(r"\A\p{Lu}").alias("up")))))
    lengths = F.array(*map(F.lit, range(1, WORDS + 1) if sizes is None else sizes)).cast("array<int>")

    def at(ws: Column) -> Column:
        run = lambda i, k: F.struct(F.array_join(F.transform(F.slice(ws, i + 1, k), lambda x: x["w"]), " ").alias("key"), i.alias("start"), (i + k).alias("stop"), F.get(ws, i)["up"].alias("capital"))
        each = lambda i: F.transform(F.filter(lengths, lambda k: k <= F.size(ws) - i), lambda k: run(i, k))
        return F.when(F.size(ws) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.size(ws) - 1), each)))

    return F.transform(F.array(flat), at)[0]


def named(questions: DataFrame, variants: DataFrame) -> DataFrame:
    """id, entity, key, start, stop: the names of ``variants`` (key, entity) in ``questions`` (id, text), of which none lies in a longer one. A single word in lower case is no name.

    Windows meet variants by an equality join. A window is inside a longer one
    if one that starts at most five words earlier ends no sooner, so a sliding
    maximum of ends decides, and no question's names are compared in pairs.
    Only windows of as many words as some variant has are made.
    """
    sizes = sorted(r["n"] for r in variants.select(F.size(F.split("key", " ")).alias("n")).where(F.col("n") <= WORDS).distinct().collect())  # six at most
    w = questions.select("id", F.explode(word_windows(F.col("text"), sizes)).alias("w")).select("id", "w.*").where(usable(F.col("key")))
    hits = w.where((F.col("stop") - F.col("start") > 1) | F.col("capital")).join(variants.select("key").distinct(), "key", "left_semi")
    by_start = Window.partitionBy("id").orderBy("start")
    before = F.max("stop").over(by_start.rangeBetween(1 - WORDS, -1))
    same = F.max("stop").over(by_start.rangeBetween(0, 0))
    kept = hits.withColumn("_b", before).withColumn("_s", same).where((F.coalesce("_b", F.lit(0)) < F.col("stop")) & (F.col("_s") == F.col("stop")))
    return kept.join(variants, "key").select("id", "entity", "key", "start", "stop")


def entities(names: DataFrame) -> DataFrame:
    """key, entity for the keys of ``names`` (holder, name): one entity for all names that hang together by a holder or a key.

    The id comes from the smallest key of all, so it is the same whatever the
    order of names, and stays as long as that key does.
    """
    each = names.select("holder", F.explode(keys_of(F.col("name"))).alias("key")).distinct()
    # Holders stand for the links between all of their keys; a mark keeps them apart from keys.
    links = each.select(F.concat(F.lit("￿"), F.col("holder").cast("string")).alias("a"), F.col("key").alias("b"))
    found = components(links).where(~F.col("id").startswith("￿"))
    return found.select(F.col("id").alias("key"), F.concat(F.lit("ent_"), F.left(F.sha2("component", 256), F.lit(24))).alias("entity"))
