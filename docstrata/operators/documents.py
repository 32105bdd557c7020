"""Document cues as column functions: type, durations, fiscal years, dates, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chunking import let

# Ordered type cues; the first that holds wins.
TYPES = (
    ("amendment", r"(?i)\b(amendment|addendum)\b"),
    ("agreement", r"(?i)\b(agreement|contract|lease)\b"),
    ("invoice", r"(?i)\binvoice\b"),
    ("policy", r"(?i)\b(policy|procedure)\b"),
    ("report", r"(?i)\b(report|minutes|summary)\b"),
    ("letter", r"(?i)\bdear\b"),
)
# Number words, from which those up to ninety-nine are made.
ONES = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBERS = {w: k + 1 for k, w in enumerate(ONES)} | {w: 10 * k + 20 for k, w in enumerate(TENS)} | {f"{t}-{o}": 10 * k + 21 + j for k, t in enumerate(TENS) for j, o in enumerate(ONES[:9])}
CITATION = r"\[([^\[\]#]+) #([0-9a-f]{12})\]"


def doc_type(head: Column) -> Column:
    out = F.lit("other")
    for name, cue in reversed(TYPES):
        out = F.when(head.rlike(cue), name).otherwise(out)
    return out


UNITS = "day|week|month|year"
WORD = f"(?:{'|'.join(TENS)})[- ](?:{'|'.join(ONES[:9])})|{'|'.join(reversed(NUMBERS))}"  # longer words first
DURATION = rf"(?i)(?:\(([0-9]+)\)|\b([0-9]+)|\b({WORD}))(?:[ \t\n\r]+|-)({UNITS})s?\b"  # number in parentheses, digits or word, then the unit, after a space or hyphen
FISCAL = r"(?i)\bFY ?((?:20)?[0-9]{2})(?:-([0-9]{2}))?\b"
ISO = r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b"
SPELT = r"\b([0-9]{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{4})\b"

# What each pattern may begin with, looked for first: at most places of a text that alone decides.
AHEAD = {DURATION: "[(0-9" + "".join(sorted({c for w in NUMBERS for c in (w[0], w[0].upper())})) + "]", FISCAL: "[Ff]", ISO: "[0-9]", SPELT: "[0-9]"}


def quick(pattern: str) -> str:
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    return f"{flags}(?={AHEAD[pattern]}){pattern.removeprefix(flags)}"


def duration(text: Column) -> Column:
    """First duration as "60 days", number and unit from one place: "sixty (60) days" counts its digits, and numbers without a unit are passed over."""
    table = F.create_map(*(x for k, v in NUMBERS.items() for x in (F.lit(k), F.lit(str(v)))))

    def of(found: Column) -> Column:
        part = lambda k: F.nullif(F.regexp_extract(found, DURATION, k), F.lit(""))
        n = F.coalesce(part(1), part(2), F.try_element_at(table, F.replace(F.lower(part(3)), F.lit(" "), F.lit("-"))))
        return F.when(found != "", let(n, lambda n: F.concat(n, F.lit(" "), F.lower(part(4)), F.when(n == "1", "").otherwise("s"))))

    return let(F.regexp_extract(text, quick(DURATION), 0), of)  # the text is searched once, its parts are read from what was found


def fiscal_year(text: Column) -> Column:
    """First fiscal-year label in its long form: FY25-26 and FY 2025-26 become FY2025-26."""

    def of(found: Column) -> Column:
        first, second = F.regexp_extract(found, FISCAL, 1), F.regexp_extract(found, FISCAL, 2)
        year = F.when(F.length(first) == 2, F.concat(F.lit("20"), first)).otherwise(first)
        return F.when(found != "", F.concat(F.lit("FY"), year, F.when(second != "", F.concat(F.lit("-"), second)).otherwise("")))

    return let(F.regexp_extract(text, quick(FISCAL), 0), of)


def iso_dates(text: Column) -> Column:
    """Valid ISO and "5 March 2024" dates in order of form, without repeats."""
    iso, named = (F.regexp_extract_all(text, F.lit(quick(p)), F.lit(1)) for p in (ISO, SPELT))
    spelt = F.transform(named, lambda d: F.try_to_timestamp(d, F.lit("d MMMM yyyy")).cast("date"))
    return F.array_distinct(F.array_compact(F.concat(F.transform(iso, lambda d: d.try_cast("date")), spelt)))


def citation_ids(answer: Column) -> Column:
    """Short ids of the sources that an answer cites, first seen first."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(2)))
