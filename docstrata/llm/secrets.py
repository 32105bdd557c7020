"""Secret scan: fixed patterns, and a randomness test battery, in DataFrame functions only.

Patterns give the base spans. Every other long run of token characters that is
not plain letters is a candidate. Its encoding is inferred (decimal, hex,
base32, letters, base64); a chi-squared test of uniform use of the alphabet, a
runs test and a lag-one serial correlation test are combined by Fisher's
method into the probability that a uniformly random string looks as uneven.

Runs of plain letters show how natural text scores: in each length class their
tail gives the share of candidates that text alone would put past a threshold,
and the threshold is the loosest with an estimated false-discovery rate of at
most ``fdr``. Length classes with few plain runs use those of all lengths.

Runs of plain letters are that sample of natural text and never candidates
themselves; the runs and serial tests number characters as the inferred
encoding does.

Edge cases: a null text is empty; an empty text has no spans; repeated rows
and ids and null ids are reported row by row; a candidate that overlaps a base
span is left out, and a p-value of exactly the threshold's bin passes, so
there are no ties; work on a text of n matches grows with n to the 1.5 at
most; an empty table gives an empty result; columns other than doc_id and
text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved

# The patterns of the base spans.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the whole run of 20 characters or more
HEX = r"[0-9a-f]{24,}"
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"[A-Za-z0-9+/_=-]"
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
BASE64 = LETTERS.upper() + LETTERS + DIGITS + "+/-_="
LENGTHS = (24, 32, 48, 64)  # upper ends of the length classes
BINS = 60

SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each place of an array of ints the fold of all values before it; op is associative.

    Values are folded in about sqrt(n) parts of that length, and then the parts,
    so no array of n values is copied n times.
    """
    start = F.struct(F.lit(zero).alias("all"), F.array().cast("array<int>").alias("at"))
    fold = lambda x: F.aggregate(x, start, lambda acc, v: F.struct(op(acc["all"], v).alias("all"), F.concat(acc["at"], F.array(acc["all"])).alias("at")))

    def cut(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda i: fold(F.slice(v, i * width + 1, width)))

    def joined(parts: Column) -> Column:
        offsets = fold(F.transform(parts, lambda x: x["all"]))["at"]
        return F.flatten(F.zip_with(parts, offsets, lambda x, o: F.transform(x["at"], lambda v: op(o, v))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(cut(v), joined)).otherwise(F.array().cast("array<int>")))


def clear_of(other: Column, base: Column) -> Column:
    """The spans of ``other`` that overlap none of ``base``: after sorting, the farthest end before a span and the next start after it decide."""
    fixed = lambda e: e["kind"] < len(KINDS) - 1
    most = lambda a, b: F.greatest(a, b)
    lowest = -(1 << 31) + 1

    def free(events: Column) -> Column:
        reach = running(F.transform(events, lambda e: F.when(fixed(e), e["end"]).otherwise(0)), most, 0)
        ahead = F.reverse(running(F.reverse(F.transform(events, lambda e: F.when(fixed(e), -e["start"]).otherwise(lowest))), most, lowest))
        told = F.zip_with(F.zip_with(events, reach, lambda e, r: F.struct(e.alias("e"), r.alias("reach"))), ahead, lambda x, a: F.struct(x["e"].alias("e"), x["reach"].alias("reach"), a.alias("ahead")))
        return F.transform(F.filter(told, lambda x: ~fixed(x["e"]) & (x["reach"] <= x["e"]["start"]) & (-x["ahead"] >= x["e"]["end"])), lambda x: x["e"])

    return F.when((F.size(other) > 0) & (F.size(base) > 0), let(F.array_sort(F.concat(base, other)), free)).otherwise(other)


def matches(text: Column, pattern: str, kind: int, value_group: int, maybe: Column) -> Column:
    """All leftmost matches of a pattern with their code-point positions.

    ``\\G`` makes each match begin where the last ended, so group 1 is the gap
    before the match, group 2 the match, and lengths add up to positions.
    """
    anchored = F.lit(rf"\G(?s:(.*?))({pattern})")
    part = lambda g: F.regexp_extract_all(text, anchored, F.lit(g))

    def spans(gap: Column) -> Column:
        before = running(F.zip_with(gap, part(2), lambda g, m: g + F.length(m)), lambda a, b: a + b, 0)
        placed = F.zip_with(F.zip_with(before, gap, lambda a, b: a + b), part(2), lambda s, m: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(m)).alias("end"), m.alias("value")))
        if value_group == 2:
            return placed
        return F.zip_with(placed, part(value_group), lambda s, v: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), v.alias("value")))

    found = let(F.transform(part(1), F.length), spans)
    return F.when(maybe, found).otherwise(F.array().cast(SPAN)).cast(SPAN)


def upper_tail(z: Column) -> Column:
    """Normal upper tail, by the logistic approximation."""
    cut = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    return let(cut, lambda x: F.greatest(1 / (1 + F.exp(1.5976 * x + 0.07056 * x * x * x)), F.lit(1e-12)))


def battery(token: Column) -> Column:
    """Combined p-value of the three tests for one token; small: uneven, unlike a random string."""
    size_of = lambda t: (
        F.when(t.rlike("^[0-9]+$"), 10.0)
        .when(t.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16.0)
        .when(t.rlike("^[a-z]+$|^[A-Z][a-z]+$|^[A-Z]+$"), 26.0)
        .when(t.rlike("^[A-Z2-7]+=*$"), 32.0)
        .otherwise(64.0)
    )
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x))

    def combined(size: Column, word: Column, away: Column) -> Column:
        """``away``: each character's number in the alphabet, less the token's mean."""
        n = F.size(away).cast("double")
        squares = total(F.array_distinct(F.split(word, "")), lambda c: F.pow(n - F.length(F.replace(word, c, F.lit(""))), F.lit(2.0)))
        z_chi = ((size / n) * squares - n - (size - 1)) / F.sqrt(2 * (size - 1))
        both = F.zip_with(F.slice(away, 1, F.size(away) - 1), F.slice(away, 2, F.size(away)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        high = total(away, lambda x: F.when(x >= 0, 1.0).otherwise(0.0))
        runs = 1 + total(both, lambda x: F.when((x["a"] >= 0) != (x["b"] >= 0), 1.0).otherwise(0.0))
        spread, along = total(away, lambda x: x * x), total(both, lambda x: x["a"] * x["b"])
        found = F.struct(z_chi.alias("chi"), (2 * high * (n - high) / n + 1).alias("expected"), runs.alias("runs"), spread.alias("spread"), along.alias("along"), n.alias("n"))
        return let(found, fisher)

    def fisher(x: Column) -> Column:
        variance = (x["expected"] - 1) * (x["expected"] - 2) / (x["n"] - 1)
        z_runs = F.when(variance > 0, F.abs(x["runs"] - x["expected"]) / F.sqrt(variance)).otherwise(8.0)
        z_serial = F.when(x["spread"] > 0, F.abs(x["along"] / x["spread"]) * F.sqrt(x["n"])).otherwise(8.0)
        half = -(F.log(upper_tail(x["chi"])) + F.log(2 * upper_tail(z_runs)) + F.log(2 * upper_tail(z_serial)))
        return let(F.greatest(half, F.lit(0.0)), lambda h: F.exp(-h) * (1 + h + h * h / 2))

    def placed(size: Column) -> Column:
        alphabet = F.when(size == 10.0, DIGITS).when(size == 16.0, DIGITS + "abcdef").when(size == 26.0, LETTERS).when(size == 32.0, LETTERS.upper() + "234567=").otherwise(BASE64)
        word = F.when(size.isin(16.0, 26.0), F.lower(token)).otherwise(token)
        numbers = lambda w, s: F.transform(F.split(w, ""), lambda c: F.instr(s, c).cast("double"))
        centred = lambda v: let(total(v, lambda x: x) / F.size(v), lambda m: F.transform(v, lambda x: x - m))
        return let(word, lambda w: let(alphabet, lambda s: let(let(numbers(w, s), centred), lambda away: combined(size, w, away))))

    return let(size_of(token), placed)


def length_class(n: Column) -> Column:
    out = F.lit(len(LENGTHS))
    for k in reversed(range(len(LENGTHS))):
        out = F.when(n <= LENGTHS[k], k).otherwise(out)
    return out


def cell(token: Column) -> Column:
    """Length class and binned -log10 p of a token, as one number."""
    p = F.least(F.floor(-4 * F.log10(F.greatest(battery(token), F.lit(1e-300)))), F.lit(BINS - 1))
    return (length_class(F.length(token)) * BINS + F.greatest(p, F.lit(0))).cast("int")


def found(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, base spans, other candidates with their cells, and the cells of plain letter runs, of each row."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text, low = F.col("text"), F.lower("text")
    named = low.contains(NAMES[0])
    for x in NAMES[1:]:
        named = named | low.contains(x)
    long_runs = F.filter(F.split("text", r"[^A-Za-z0-9+/_=-]+"), lambda x: F.length(x) >= least)
    d = d.withColumn("runs", long_runs)
    plain = lambda x: x.rlike("^[A-Za-z]+$")
    d = d.withColumn("letters", F.filter("runs", plain)).withColumn("mixed", F.exists("runs", lambda x: ~plain(x))).drop("runs")
    d = d.withColumn("assign", F.filter(matches(text, ASSIGN, 0, 3, named), lambda s: F.length(s["value"]) >= 6))
    d = d.withColumn("access", matches(text, ACCESS, 1, 2, text.contains("AKIA")))
    d = d.withColumn("hex", matches(text, HEX, 2, 2, F.col("mixed") | (F.size("letters") > 0)))
    d = d.withColumn("other", F.filter(matches(text, rf"{TOKEN}{{{least},}}", 3, 2, F.col("mixed")), lambda s: ~plain(s["value"])))
    base = F.array_sort(F.concat("assign", "access", "hex"))
    d = d.select("doc_id", base.alias("fixed"), "other", "letters")
    clear = clear_of(F.col("other"), F.col("fixed"))
    strip = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    tested = F.transform(clear, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), cell(s["value"]).alias("cell")))
    return d.select("doc_id", strip(F.col("fixed")).alias("base"), tested.alias("other"), F.transform("letters", cell).alias("nulls"))


def thresholds(rows: DataFrame, fdr: float, enough: int = 200) -> list[int]:
    """For each length class the highest bin of -log10 p that still counts as random (-1: none)."""
    shape = lambda c, kind: rows.select(F.explode(c).alias("cell")).groupBy("cell").count().withColumn("kind", F.lit(kind))
    table = shape(F.transform("other", lambda s: s["cell"]), 1).union(shape(F.col("nulls"), 0)).collect()  # at most 2 * classes * BINS rows
    classes = len(LENGTHS) + 1
    count = [[[0] * BINS for _ in range(classes)] for _ in range(2)]
    for r in table:
        count[r["kind"]][r["cell"] // BINS][r["cell"] % BINS] = r["count"]
    pooled = [sum(c[b] for c in count[0]) for b in range(BINS)]
    out = []
    for k in range(classes):
        null = count[0][k] if sum(count[0][k]) >= enough else pooled
        best, n0, n1, total0, total1 = -1, 0, 0, sum(null), sum(count[1][k])
        for b in range(BINS):
            n0, n1 = n0 + null[b], n1 + count[1][k][b]
            if n1 and (n0 + 1) / (total0 + 1) * total1 / n1 <= fdr:
                best = b
        out.append(best)
    return out


def digest(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, least: int = 20, fdr: float = 0.05) -> DataFrame:
    """doc_id, base and added spans (start, kind, end) of every row; kind indexes KINDS."""
    rows = saved(found(docs, least), "secrets")
    limit = F.array(*map(F.lit, thresholds(rows, fdr)))
    passes = F.filter("other", lambda s: s["cell"] % BINS <= F.element_at(limit, F.floor(s["cell"] / BINS).cast("int") + 1))
    added = F.transform(passes, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return rows.select("doc_id", "base", added.alias("added"))
