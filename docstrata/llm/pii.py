"""Personal data: weak supervision over candidate spans.

Fixed patterns give the base spans, which always stay. Looser patterns give
further candidates. Five labelers (strict form, checksum, gazetteer, context,
boundary) each vote for, against or not at all on every span; the counts of
vote patterns over the whole corpus, a table of bounded size, reach the
driver. Expectation-maximisation estimates each labeler's reliability by kind
from these counts. A logistic span classifier then learns EM's posteriors as
soft labels from what the labelers do not see as such: the span's shape and
length, the characters around it and the words beside it. It decides which
candidates become spans.

Edge cases: a null text is empty; a text without spans gives empty arrays; a
long text, or a long run of digits, is scanned in time linear in its length;
spans of one kind do not overlap, and a looser span that touches a base span
of any kind is left out, so there are no ties; repeated rows and ids and null
ids are reported row by row; an empty table gives an empty result; columns
other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean, saved

KINDS = ("email", "ip", "card", "phone")
VOTES = 3  # against, for, none
LABELERS = ("form", "checksum", "gazetteer", "context", "boundary")

# Patterns. Runs are matched whole (possessively), so no start is tried twice.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]")
LOOSE = {
    0: re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?[A-Za-z]{2,24})+"),
    1: re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}){3}(?![0-9])"),
    2: re.compile(r"(?<![0-9])(?:[0-9]{13,19}|(?:[0-9]{4}[\x20-]){3}[0-9]{4})(?![0-9])"),
    3: re.compile(r"(?<![0-9+])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
}
# Gazetteers and context words.
TLDS = frozenset("com org net edu gov mil int info biz io co us uk de fr es it nl be ch at eu ca au jp cn in br example test".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38")
DIALLING = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
CUES = {
    0: re.compile(r"(?i)e-?mail|contact|write|mailto|reply|correo|courriel"),
    1: re.compile(r"(?i)\bip\b|address|host|server|login|client"),
    2: re.compile(r"(?i)card|visa|amex|credit|payment|karte|carte|tarjeta"),
    3: re.compile(r"(?i)phone|tel|call|mobile|fax|cell|llam"),
}
AGAINST = re.compile(r"(?i)order|invoice|isbn|version|build|serial|\bref\b|ticket")


def octet(digits: str) -> bool:
    """Whether a run of digits of any length is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or 0) < 256


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain: a match holds one @, so each @ is looked at once, with the run of local characters before it."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL_END.match(text[start - 1]):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(octet(x) for x in m[0].split("."))]
    cards = [(m, DIGITS.sub("", m[0])) for m in CARD.finditer(text) if m.end() - m.start() > 15]
    out += [(2, m.start(), m.end()) for m, d in cards if 16 <= len(d) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(DIGITS.sub("", m[0])) <= 15]
    return out


def votes(text: str, kind: int, start: int, end: int, base: bool) -> int:
    """The labelers' votes as one number in base VOTES."""
    span = text[start:end]
    digits = DIGITS.sub("", span)
    form = 1 if base else 2
    gaz = 2
    if kind == 0:
        last = re.split(r"[^A-Za-z]+", span.rstrip("-."))[-1].lower()
        check = 1 if base or last in TLDS else 0
        gaz = 1 if last in TLDS else 2
    elif kind == 1:
        parts = [p for p in re.split(r"[^0-9]+", span) if p]
        check = 1 if all(map(octet, parts)) else 0
        gaz = 1 if parts[0] not in ("0", "255") and len(set(parts)) > 1 else 0
    elif kind == 2:
        check = 1 if luhn(digits) and len(set(digits)) > 1 else 0
        gaz = 1 if digits.startswith(ISSUERS) else 2
    else:
        check = 1 if 8 <= len(digits) <= 15 else 0
        if span.startswith("+"):
            gaz = 1 if digits.startswith(DIALLING) else 0
    near = text[max(0, start - 40) : start]
    context = 1 if CUES[kind].search(near) else 0 if AGAINST.search(near) else 2
    around = text[max(0, start - 1) : start] + text[end : end + 1]
    edge = 0 if any(c.isalnum() for c in around) else 1
    out = 0
    for v in (form, check, gaz, context, edge):
        out = out * VOTES + v
    return out


HAS_DIGIT = re.compile("[0-9]")
SPOKEN = re.compile(r"[(\[{]|\x20dot\x20")
SHAPES = ((re.compile("[A-Z]+"), "A"), (re.compile("[a-z]+"), "a"), (re.compile("[0-9]+"), "9"))
WORD_BEFORE, WORD_AFTER = re.compile(r"([A-Za-z]+)[^A-Za-z]*$"), re.compile(r"[^A-Za-z]*([A-Za-z]+)")
# Places of a span's features in the classifier's weights: bias, shape, length, character before and after, word before and after.
PARTS = (1, 128, 32, 6, 6, 256, 128)
WEIGHTS = sum(PARTS)


def hashed(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % size


def char_class(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4 if c in ",.;:!?" else 5


def span_features(text: str, start: int, end: int) -> list[int]:
    """One place for each of PARTS: the span's shape and length, and what stands around it."""
    span = shape = text[start:end]
    for run, letter in SHAPES:
        shape = run.sub(letter, shape)
    before, after = WORD_BEFORE.search(text[max(0, start - 40) : start]), WORD_AFTER.match(text[end : end + 40])
    values = (0, hashed(shape, PARTS[1]), min(len(span), PARTS[2] - 1), char_class(text[start - 1 : start] if start else ""), char_class(text[end : end + 1]))
    values += (hashed(before[1].lower(), PARTS[5]) if before else 0, hashed(after[1].lower(), PARTS[6]) if after else 0)
    return [sum(PARTS[:k]) + v for k, v in enumerate(values)]


def candidates(text: str) -> list[tuple[int, int, int, bool, int, list[int]]]:
    """(kind, start, end, base, votes, features) of base spans and of looser ones that overlap none."""
    digits = HAS_DIGIT.search(text)
    hard = base_spans(text) if "@" in text or digits else []
    out = [(k, a, b, True) for k, a, b in hard]
    taken = sorted((a, b) for _, a, b in hard)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for kind, pattern in LOOSE.items():
        if "at" not in text if kind == 0 else not digits:  # no match without
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            k = bisect_left(starts, b)
            if k and ends[k - 1] > a:
                continue
            if kind == 0 and not SPOKEN.search(m[0]) and m[0].rsplit(".", 1)[-1].lower() not in TLDS:
                continue  # plain words with "at" between them and a full stop after
            out.append((kind, a, b, False))
    return [(k, a, b, base, votes(text, k, a, b, base), span_features(text, a, b)) for k, a, b, base in out]


SPANS = "array<struct<kind:int,start:int,end:int>>"
FOUND = "array<struct<kind:int,start:int,end:int,base:boolean,votes:int,features:array<int>>>"
NAMES = ("kind", "start", "end", "base", "votes", "features")


def spans_of(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.list_(pa.int32()))]))
        for b in batches:
            found = [[dict(zip(NAMES, s, strict=True)) for s in candidates(t or "")] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, shape)], ["doc_id", "spans"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, spans {FOUND}")


def ballots(n: int) -> np.ndarray:
    return np.array([(n // VOTES ** (len(LABELERS) - 1 - k)) % VOTES for k in range(len(LABELERS))])


def posteriors(table: np.ndarray, count: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """EM for one kind: P(true) of each vote pattern, and the table (labeler, class, vote) of estimated vote rates."""
    rate = np.full((len(LABELERS), 2, VOTES), 1 / 3)
    rate[:, 1] = (0.1, 0.6, 0.3)
    rate[:, 0] = (0.4, 0.2, 0.4)
    prior, p = 0.5, np.full(len(table), 0.5)
    for _ in range(rounds):
        like = np.log([[1 - prior], [prior]]) + np.array([sum(np.log(rate[k, c, table[:, k]]) for k in range(len(LABELERS))) for c in (0, 1)])
        p = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
        prior = float(np.clip((p @ count + 1) / (count.sum() + 2), 0.01, 0.99))
        for k in range(len(LABELERS)):
            for c, w in ((0, (1 - p) * count), (1, p * count)):
                seen = np.bincount(table[:, k], weights=w, minlength=VOTES) + np.array([(0.4, 0.2, 0.4), (0.1, 0.6, 0.3)][c]) * 4
                rate[k, c] = seen / seen.sum()
    return p, rate


def fitted(features: np.ndarray, target: np.ndarray, rounds: int = 400, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression of soft labels on one-hot features (rows of places), by Nesterov's accelerated gradient with a ridge."""
    w = ahead = np.zeros(WEIGHTS)
    rate = 1 / (len(PARTS) * 0.25 * max(len(target), 1) + ridge)
    flat = features.reshape(-1)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(ahead[features].sum(axis=1), -30, 30)))
        new = ahead + rate * (np.bincount(flat, weights=np.repeat(target - p, features.shape[1]), minlength=WEIGHTS) - ridge * ahead)
        ahead = new + t / (t + 3) * (new - w)
        w = new
    return w


def reliabilities(counts: list[tuple[int, int, int]]) -> dict[tuple[int, int], float]:
    """P(true) of every kind and vote pattern, by EM over the counts (kind, votes, count) of the whole corpus."""
    out = {}
    for kind in sorted({k for k, _, _ in counts}):
        own = sorted((v, n) for k, v, n in counts if k == kind)
        p, _ = posteriors(np.array([ballots(v) for v, _ in own]), np.array([n for _, n in own], float))
        out |= {(kind, v): float(x) for (v, _), x in zip(own, p, strict=True)}
    return out


def classifiers(spans: DataFrame, truth: dict[tuple[int, int], float], max_spans: int) -> list[np.ndarray]:
    """A span classifier for each kind, fitted on at most ``max_spans`` spans of it, those of smallest hash, with EM's posteriors as labels."""
    out = []
    for kind in range(len(KINDS)):
        mine = spans.where(F.col("kind") == kind).withColumn("o", F.xxhash64("h", "start"))
        pick = mine.select("o", "votes", "features").orderBy("o", "votes", "features").limit(max_spans).collect()
        features = np.array([r["features"] for r in pick], np.int64).reshape(len(pick), len(PARTS))
        out.append(fitted(features, np.array([truth[kind, r["votes"]] for r in pick], float)))
    return out


def find(docs: DataFrame, least: float = 0.5, max_spans: int = 5000) -> DataFrame:
    """doc_id, base and added spans (kind, start, end) of every row; kind indexes KINDS.

    Vote counts, and so the labelers' reliabilities, are those of all spans; the
    classifier learns from at most ``max_spans`` spans of a kind and judges all.
    """
    rows = saved(spans_of(docs), "spans")
    spans = rows.select(F.xxhash64("doc_id").alias("h"), F.explode("spans").alias("s")).select("h", "s.*")
    counts = spans.groupBy("kind", "votes").count().collect()  # at most kinds * VOTES**labelers rows
    nets = classifiers(spans, reliabilities([tuple(r) for r in counts]), max_spans)
    weights = F.array(*(F.lit(float(x)) for net in nets for x in net))
    bare = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    logit = lambda s: F.aggregate(s["features"], F.lit(0.0), lambda acc, i: acc + F.element_at(weights, s["kind"] * WEIGHTS + i + 1))
    bound = float(np.log(least / (1 - least)))
    base = F.array_sort(F.transform(F.filter("spans", lambda s: s["base"]), bare)).cast(SPANS)
    added = F.transform(F.filter("spans", lambda s: ~s["base"] & (logit(s) >= bound)), bare).cast(SPANS)
    return rows.select("doc_id", base.alias("base"), added.alias("added"))


def digest(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
