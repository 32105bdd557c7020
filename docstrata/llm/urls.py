"""URL filter: rules by place first, then naive Bayes over the words of host and path.

Names in a host are written without spaces, so each is split into the words
that are likeliest under unigram counts (Viterbi over all cuts). The counts
are of all words of all pages. What is learned from is weak supervision: a URL
whose host holds one of ``blocked`` as a word of its own counts as an example
of what is to be blocked, every other URL as one of what is not. A multinomial
naive Bayes over host words and path words then scores every URL, so words
that keep such company weigh as well. Rules say where, not what, and so do not
teach.

Only distinct hosts, names and URLs are split and scored. Nothing whole is
broadcast or gathered: word and token tables are joined, by broadcast where
they are small as written, else by shuffle.

Edge cases: a null URL, or one without ``://``, has an empty host and path, no
words, and the score of the priors alone; repeated pages, null page ids
included, each give a row; a name longer than ``RUN`` characters (none that
DNS allows is) is split in runs of that length; runs of digits in a path count
as one token; words of the pages over ``LONGEST`` letters are not counted;
text in any script is lower-cased and split as letters and digits; an empty
table gives an empty result; other columns of the pages are ignored, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, few, saved

# Rules (host, path, verdict), and words that mark a host as one to block.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
BLOCKED = (
    "adult", "ads", "bet", "bets", "betting", "casino", "crack", "escort", "gamble", "gambling", "jackpot", "keygen", "loan", "loans", "lottery", "malware", "nude", "phish",
    "phishing", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "torrent", "track", "tracker", "viagra", "warez", "xxx",
)
LONGEST, RUN = 24, 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNSEEN = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Between the first ``://`` and the next of ``/ ? #``, with A-Z lower-cased; then up to ``?`` or ``#``."""
    cut = lambda k: F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(cut(1), UPPER, LOWER), cut(2)


def ruled(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does. A rule fits its host and what lies below it."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def word_counts(html: DataFrame, col: str = "html") -> DataFrame:
    """word, c: over the visible words of all rows."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(col, UNSEEN, " ")), F.lit(r"\p{L}+"), F.lit(0))
    return html.select(F.explode(words).alias("word")).where(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("c"))


def names(host: Column) -> Column:
    """The runs of letters and digits of a host."""
    runs = F.filter(F.split(host, r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.flatten(F.transform(runs, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / RUN).cast("int")), lambda i: F.substring(x, i * RUN + 1, F.lit(RUN)))))


def cheapest(name: str, known: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """The words of least total cost; ``known``: cost by (start, length), other words cost ``unknown`` and one a letter. Ties go to the longer last word."""
    cost, last = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - LONGEST), end):
            c = cost[start] + known.get((start, end - start), unknown + end - start)
            if c < cost[end]:
                cost[end], last[end] = c, start
    out, end = [], len(name)
    while end:
        out.append(name[last[end] : end])
        end = last[end]
    return out[::-1]


def segmented(given: DataFrame, counts: DataFrame) -> DataFrame:
    """name, words: each distinct ``name`` of ``given`` split into the likeliest words. ``counts``: written by :func:`saved`."""
    every = given.select("name").distinct()
    total = counts.agg(F.sum("c")).first()[0] or 1  # one number
    size = F.length("name")
    at = every.select("name", F.explode(F.sequence(F.lit(1), size)).alias("at"))
    at = at.select("name", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), size - F.col("at") + 1))).alias("n"))
    hits = at.withColumn("word", F.substring("name", F.col("at"), F.col("n"))).join(few(counts), "word")
    hits = hits.select("name", F.struct((F.col("at") - 1).alias("start"), "n", (math.log10(total) - F.log10("c")).alias("cost")).alias("hit"))
    lists = every.select("name", F.lit(None).cast(hits.schema["hit"].dataType).alias("hit")).union(hits).groupBy("name").agg(F.collect_list("hit").alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [cheapest(n, {(h["start"], h["n"]): h["cost"] for h in hs}, math.log10(total)) for n, hs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    return lists.mapInArrow(run, "name string, words array<string>")


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """host, words: the distinct hosts with their words in order."""
    every = hosts.select("host").distinct()
    places = every.select("host", F.posexplode(names(F.col("host"))).alias("pos", "name"))
    split = saved(segmented(places, counts), "names")
    words = places.join(few(split), "name").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"])).alias("words"))
    return words


def path_words(path: Column) -> Column:
    """Letters and digits of a path, marked as a path's; numbers are all one token."""
    runs = F.regexp_extract_all(F.lower(path), F.lit(r"\p{L}+|\p{N}+"), F.lit(0))
    return F.transform(runs, lambda x: F.concat(F.lit("/"), F.regexp_replace(x, r"^\p{N}+$", "0")))


def tokens(pages: DataFrame, blocked: Iterable[str] = BLOCKED) -> DataFrame:
    """host, path, n, words, tokens, bad: the distinct URLs of ``pages`` (url, html) and how many rows have each; bad: a host word is one of ``blocked``."""
    host, path = host_and_path(F.col("url"))
    urls = saved(pages.select(host.alias("host"), path.alias("path")).groupBy("host", "path").agg(F.count("*").alias("n")), "urls")
    counts = saved(word_counts(pages), "words")
    hosts = saved(host_words(urls, counts), "hosts")
    none = F.array().cast("array<string>")
    out = urls.join(few(hosts), "host", "left").withColumn("words", F.coalesce("words", none))
    return out.withColumns({"tokens": F.concat("words", path_words(F.col("path"))), "bad": F.arrays_overlap("words", F.array(*(F.lit(w) for w in sorted(blocked))))})


def token_weights(urls: DataFrame) -> tuple[DataFrame, float]:
    """token, weight: log likelihood ratio of a token, block against allow, with one added to each count; and the log ratio of the priors. Where one side has no examples, tokens weigh nothing."""
    n = lambda bad: F.coalesce(F.sum(F.when(F.col("bad") == bad, F.col("n"))), F.lit(0)).alias("block" if bad else "allow")
    prior = urls.agg(n(True), n(False)).first()
    counts = saved(urls.select(F.explode("tokens").alias("token"), "n", "bad").groupBy("token").agg(n(True), n(False)), "tokens")
    total = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("block"), F.lit(0)).alias("block"), F.coalesce(F.sum("allow"), F.lit(0)).alias("allow")).first()
    share = lambda c: F.log((F.col(c) + 1) / F.lit(float(total[c] + total["v"])))
    weight = share("block") - share("allow") if prior["block"] and prior["allow"] else F.lit(0.0)
    weights = saved(counts.select("token", weight.alias("weight")), "weights")
    dropped(counts)
    return weights, math.log((prior["block"] + 1) / (prior["allow"] + 1))


def judged(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, blocked: Iterable[str] = BLOCKED) -> DataFrame:
    """page_id, host, path, rule, verdict, words, score for every row of ``pages`` (page_id, url, html); score: log odds of block."""
    urls = saved(tokens(pages, blocked), "tokens")
    weights, prior = token_weights(urls)
    each = urls.select("host", "path", "words", F.explode_outer("tokens").alias("token")).join(few(weights), "token", "left")
    scores = each.groupBy("host", "path").agg((F.lit(prior) + F.coalesce(F.sum("weight"), F.lit(0.0))).alias("score"), F.first("words").alias("words"))
    host, path = host_and_path(F.col("url"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    out = rows.join(few(saved(scores, "scores")), ["host", "path"], "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), F.array_join("words", " ").alias("words"), "score")
