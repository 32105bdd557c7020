"""Calendar dates in texts, with their places: four ways of writing them, and of overlapping matches the earlier, then the longer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chunking import let

# Month names and their short forms, and the four ways of writing a date.
MONTHS = "january february march april may june july august september october november december".split()
MONTH = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
PATTERNS = (
    rf"(?i)\b{MONTH}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?\s*,?\s+(\d{{4}})\b",
    rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:day\s+)?(?:of\s+)?{MONTH}\.?\s*,?\s+(\d{{4}})\b",
    r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b",
    r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b",
)
AHEAD = ("[ADFJMNOSadfjmnos]", "[0-9]", "[0-9]", "[0-9]")  # what each may begin with, looked for first: at most places that alone decides
PLACES = ((3, 1, 2), (3, 2, 1), (1, 2, 3), (3, 1, 2))  # groups of year, month and day


def quick(k: int) -> str:
    flags = "(?i)" if PATTERNS[k].startswith("(?i)") else ""
    return f"{flags}(?={AHEAD[k]}){PATTERNS[k].removeprefix(flags)}"


def spans_of(text: Column, pattern: str) -> Column:
    """(m, start, stop) of all matches, by characters from 0: what lies between matches gives their places."""

    def placed(found: Column, between: Column) -> Column:
        begin = F.struct(F.array().cast("array<struct<m:string,start:int,stop:int>>").alias("out"), F.lit(0).alias("at"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["b"])
            stop = start + F.length(x["m"])
            return F.struct(F.array_append(acc["out"], F.struct(x["m"].alias("m"), start.alias("start"), stop.alias("stop"))).alias("out"), stop.alias("at"))

        return F.aggregate(F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.struct(m.alias("m"), b.alias("b"))), begin, step, lambda acc: acc["out"])

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: placed(found, F.split(text, pattern)))


def number_of(word: Column) -> Column:
    """The month a word or number stands for."""
    named = F.create_map(*(F.lit(x) for k, m in enumerate(MONTHS) for x in (m[:3], k + 1)))
    return F.coalesce(F.try_element_at(named, F.lower(F.left(word, F.lit(3)))), word.try_cast("int"))


def first_apart(spans: Column) -> Column:
    """Of overlapping spans (start, stop, ...) the earlier, then the longer: a fold over them in that order, which keeps one that begins where the last kept one ended, or later."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["stop"] - a["stop"]))
    begin = F.struct(F.filter(spans, lambda _: F.lit(False)).alias("kept"), F.lit(-1).alias("end"))

    def step(acc: Column, x: Column) -> Column:
        ok = x["start"] >= acc["end"]
        return F.struct(F.when(ok, F.array_append(acc["kept"], x)).otherwise(acc["kept"]).alias("kept"), F.when(ok, x["stop"]).otherwise(acc["end"]).alias("end"))

    return F.aggregate(order, begin, step, lambda acc: acc["kept"])


def dates_in(text: Column) -> Column:
    """(start, stop, iso) of every date of the calendar in a text, in order; a day that no month has is none. Null texts give none."""

    def of(text: Column, k: int) -> Column:
        part = lambda m, g: F.regexp_extract(m, PATTERNS[k], PLACES[k][g])
        two = lambda n: F.lpad(n, 2, "0")
        month = (lambda m: let(part(m, 1), number_of).cast("string")) if MONTH in PATTERNS[k] else (lambda m: part(m, 1))
        day = lambda m: F.concat(part(m, 0), F.lit("-"), two(month(m)), F.lit("-"), two(part(m, 2)))
        real = lambda d: F.when(d.try_cast("date").isNotNull() & ~d.startswith("0000"), d)
        made = F.transform(spans_of(text, quick(k)), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), let(day(x["m"]), real).alias("iso")))
        return F.filter(made, lambda x: x["iso"].isNotNull())

    none = F.array().cast("array<struct<start:int,stop:int,iso:string>>")
    return F.coalesce(let(let(text, lambda t: F.concat(*(of(t, k) for k in range(len(PATTERNS))))), first_apart), none)  # a text that is made by an expression is made once
