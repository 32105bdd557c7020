"""Line dedup by a deletion neighbourhood over words; the earliest line stays.

A line's words are what white space separates. A line of at least
``min_words`` words, or whose words have at least ``min_chars`` characters,
goes if an earlier line (by doc_id, then position) has the same words; one of
at least ``near_words`` words goes also if an earlier line of at least that
many is within one word edit (insertion, deletion or substitution). Blank and
shorter lines stay.

Every line emits its variants with one word deleted, and itself, as hashed
keys. Lines that share a key in the same role are all within the bound of each
other (same deleted position: a substitution) or of the one whole line (an
insertion), so the earliest of a key stands for its group: work is linear in
the number of variants however many lines share a key. Each line is then
compared with its earliest partner, word by word, before it goes.

Only lines that can have a partner emit variants: two lines within one edit
share their first or last half, so halves are counted first, by hash. Equal
lines are one row throughout, with the position of the first.

A key that many lines share is summed up before it is shuffled, and the lines
meet the result by a broadcast of bounded size or a join whose hot keys AQE
splits; no window gathers a key's lines.

Edge cases: null or empty texts stay as they are; rows with a null id stay
whole and take no part; rows that repeat an id and its text are one document
and keep or lose the same lines; rows that share an id but not the text are
documents of their own, in the order of a hash of the text; of equally early
lines there is one only, as a place is unique; lines of any length are hashed
and compared whole; an empty table stays empty; other columns, whatever their
names, pass through. A document whose lines all go keeps an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngram_join import INVERSE, mixed, powers, slices, word_hashes, words_at
from .shared import dropped, few, free_name, lean, saved

SPACE = r"[\x09-\x0D\x20]+"


def normal(line: Column) -> Column:
    """The line's words with one space between."""
    odd = line.contains("  ") | line.rlike(r"[\x09-\x0D]|^ | $")
    return F.when(odd, F.trim(F.regexp_replace(line, SPACE, " "))).otherwise(line)


LINE = "pos int, n int, c1 long, c2 long, halves array<long>"


def lines(docs: DataFrame, min_words: int, near_words: int, min_chars: int) -> DataFrame:
    """Document, position, number of words, 128-bit digest and half keys of every line that is long enough.

    Half keys are hashes of the first and last half for a shorter length of n
    and of n - 1, so two lines within one edit have one in common.
    """
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in slices(b, 1):
                data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
                h, start = words_at(data)
                breaks = np.flatnonzero(data == 10)
                line = np.searchsorted(breaks, start)
                n = np.bincount(line, minlength=len(breaks))
                doc_of_line = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), breaks, side="right")
                pos = np.arange(len(breaks)) - np.searchsorted(doc_of_line, doc_of_line)
                letters = np.r_[0, np.cumsum((data & 0xC0 != 0x80) & ((data < 9) | (data > 13)) & (data != 32))]  # characters begin at bytes that continue none
                ends = np.r_[0, breaks + 1]
                keep = np.flatnonzero((n >= min_words) | (letters[ends[1:]] - letters[ends[:-1]] >= min_chars))
                z = np.cumsum(n)[keep]
                n = n[keep]
                a = z - n
                up, down = powers("up", len(h)), powers("down", len(h) + 1)
                sums = [np.r_[np.uint64(0), np.cumsum(x * up)] for x in (h, mixed(h ^ np.uint64(0x5BF03635)))]
                run_hash = lambda s, x, y: (s[y] - s[x]) * down[x]  # noqa: E731  of the words from x to y, wherever they stand
                c = [mixed(run_hash(s, a, z) + n.astype(np.uint64)) for s in sums]
                halves = []
                for short in (n, n - 1):
                    half, tag = short // 2, short.astype(np.uint64) << np.uint64(1)
                    halves.append(mixed(run_hash(sums[0], a, a + half) ^ mixed(tag)))
                    halves.append(mixed(run_hash(sums[0], z - (short - half), z) ^ mixed(tag + np.uint64(1))))
                near = n >= near_words
                flat = np.stack(halves, axis=1)[near].reshape(-1).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(near * 4)].astype(np.int32)), pa.array(flat))
                cols = [part.column(0).take(pa.array(doc_of_line[keep])), pa.array(pos[keep].astype(np.int32)), pa.array(n.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in c), lists]
                yield pa.RecordBatch.from_arrays(cols, ["doc", "pos", "n", "c1", "c2", "halves"])

    return docs.select("doc", "text").mapInArrow(lean(run), f"doc {kind}, {LINE}")


def one_deleted(h: np.ndarray) -> np.ndarray:
    """Hashes of a word sequence with each one of its words left out."""
    up = powers("up", len(h))
    a = h * up
    before = np.cumsum(a) - a
    after = (np.sum(a) - before - a) * INVERSE  # later words move one place down
    return mixed(before + after)


def whole(h: np.ndarray) -> np.uint64:
    return mixed(np.array([np.sum(h * powers("up", len(h)))], np.uint64))[0]


def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, role, doc, pos) of each line (norm, doc, pos)."""
    for b in batches:
        for part in (b.slice(k, 256) for k in range(0, b.num_rows, 256)):
            texts = [t or b"" for t in part.column(0).cast(pa.binary()).to_pylist()]
            h, count = word_hashes(texts, fold=False)
            first = np.cumsum(count) - count
            keys, role, row = [], [], []
            for i, (f, n) in enumerate(zip(first, count, strict=True)):
                w = h[f : f + n]
                d = one_deleted(w)
                place = mixed(np.arange(n, dtype=np.uint64) + np.uint64(n << 32))
                keys += [d ^ place, d, np.array([whole(w)], np.uint64)]  # substitution at a place; insertion into d; the line itself
                role.append(np.r_[np.zeros(n, np.int32), np.full(n, 1, np.int32), 2].astype(np.int32))
                row.append(np.full(2 * n + 1, i))
            if keys:
                at = pa.array(np.concatenate(row))
                cols = [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(role))]
                yield pa.RecordBatch.from_arrays(cols + [part.column(c).take(at) for c in (1, 2)], ["key", "role", "doc", "pos"])


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether one word edit or none turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [within_one(x.split(" "), y.split(" ")) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield b.select(["c1", "c2"]).filter(pa.array(ok, pa.bool_()))


def document() -> Column:
    """What tells documents apart: rows may share an id but not their text."""
    return F.struct("doc_id", F.xxhash64("text").alias("h"))


def removed(docs: DataFrame, min_words: int = 5, near_words: int = 8, min_chars: int = 20) -> DataFrame:
    """doc_id, text hash (h) and the sorted positions (from 0) of the lines that go, for documents that lose any."""
    named = docs.where(F.col("doc_id").isNotNull()).select(document().alias("doc"), "text")
    kind = named.schema["doc"].dataType.simpleString()
    every = saved(lines(named, min_words, near_words, min_chars), "lines")
    # Equal lines are one class, with the places of its first and last line; a line's first place in its document is enough.
    keyed = every.select("c1", "c2", F.struct("doc", "pos").alias("at"), "halves")
    classes = saved(keyed.groupBy("c1", "c2").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.max("halves").alias("halves")), "classes")

    dealt = classes.where(F.size("halves") > 0).select("c1", "c2", "first", F.explode(F.array_distinct("halves")).alias("half"))
    both = saved(dealt.groupBy("half").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi")).where("lo <> hi").select("half"), "halves")
    alike = dealt.join(few(both), "half").select("first", "c1", "c2").distinct()
    # The words of these lines are read again where each first stands.
    wanted = saved(alike.select("first.doc", F.struct("first.pos", "c1", "c2").alias("w")).groupBy("doc").agg(F.collect_list("w").alias("w")), "wanted")
    texts = named.select("doc", F.split("text", "\n").alias("parts")).join(few(wanted), "doc")
    spread = texts.select("doc", "parts", F.explode("w").alias("w")).select(normal(F.get("parts", F.col("w.pos"))).alias("norm"), "w.c1", "w.c2", "doc", "w.pos")
    near = saved(spread, "near-lines")
    dropped(wanted, both)

    # kind 0: all are within one edit of the earliest. kind 1: the one whole line is within one edit of each grown line.
    keys = near.select("norm", "doc", "pos").mapInArrow(lean(variants), f"key long, role int, doc {kind}, pos int").select("key", "role", F.least("role", F.lit(1)).alias("kind"), F.struct("doc", "pos").alias("me"))
    groups = keys.groupBy("key", "kind").agg(F.min(F.when(F.col("role") != 1, F.col("me"))).alias("single"), F.min(F.when(F.col("role") == 1, F.col("me"))).alias("grown"), F.count("*").alias("k"))
    groups = saved(groups.where((F.col("k") > 1) & F.col("single").isNotNull()).drop("k"), "keys")
    met = keys.join(few(groups), ["key", "kind"]).withColumn("other", F.when(F.col("role") == 2, F.col("grown")).otherwise(F.col("single")))
    earlier = met.where(F.col("other") < F.col("me")).groupBy("me").agg(F.min("other").alias("other"))
    a, b = (near.select(F.struct("doc", "pos").alias(place), "c1", "c2", F.col("norm").alias(norm)) for place, norm in (("me", "norm"), ("other", "other_norm")))
    pairs = earlier.join(a, "me").join(b.drop("c1", "c2"), "other")
    close = pairs.select("c1", "c2", "norm", "other_norm").mapInArrow(lean(checked), "c1 long, c2 long").withColumn("near", F.lit(True))

    going = classes.join(close, ["c1", "c2"], "left").where(F.col("near") | (F.col("first") < F.col("last"))).select("c1", "c2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    going = saved(going, "going")
    at = every.select("c1", "c2", "doc", "pos").join(few(going), ["c1", "c2"])
    gone = at.where(F.col("near") | (F.col("first") < F.struct("doc", "pos")))
    out = saved(gone.groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias("gone")).select("doc.*", "gone"), "gone")
    dropped(every, classes, near, groups, going)
    return out


def deduplicated(docs: DataFrame, min_words: int = 5, near_words: int = 8, min_chars: int = 20, positions: str | None = None) -> DataFrame:
    """``docs``, all columns, with the lines that go taken out of the text; ``positions`` names a further array column of their places (null: none)."""
    doc, gone = free_name(docs, "doc"), positions or free_name(docs, "gone")
    found = few(removed(docs, min_words, near_words, min_chars)).select(F.struct("doc_id", "h").alias(doc), F.col("gone").alias(gone))
    out = docs.withColumn(doc, document()).join(found, doc, "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)
    return out.withColumn("text", text).select(*docs.columns, *([gone] if positions else []))
