"""N-gram Jaccard join over word shingles, by prefix trees.

A document is the set of its distinct word n-grams (64-bit hashes), put into
one global order: rare first, where rarity is a count per hash bucket over the
whole corpus. Two sets of Jaccard similarity t or more share one of their
first |S| - ceil(t|S|) + 1 elements, so the join is dealt out by these prefix
elements: the sets that hold an element stand, from it on, as ordered lists in
a prefix tree, and each walks the tree. Sets below a node share the overlap of
the path to it, and a subtree ends where the elements left, or its sizes,
cannot reach the needed overlap. Pairs that pass are decided on whole sets, in
prefix trees around one set of each (``verified``). An element of many sets is
dealt out in cells of two blocks of sets.

Equal sets are one class from the start. In a group of many sets that share an
element, each set is first compared with the group's middle set only; trees
are then walked over sets whose components differ. So large groups of near
copies cost comparisons in proportion to their size, and no link between
different components is lost.

Edge cases: null or empty texts have no set and are linked with nothing; fewer
than n words make the whole word sequence one element; a row with a null id
has its set's size and a null component, and is linked with nothing; repeated
rows are linked as any other equal texts; rows that share an id but not their
text count each their own set, and what either is linked with is linked; a
similarity of exactly the bound links; very long texts are one numpy pass each;
columns other than doc_id and text are ignored, whatever their names
(``one_of_each`` passes them through); empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected
from .shared import dropped, few, lean, saved

SLICE = 1 << 18  # bytes of text that one numpy pass works on (a longer text is one pass)
BUCKETS = 1 << 18  # cells of the rarity table; its size never grows
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
LOW, HIGH = np.frombuffer(bytes(range(65, 91)), np.uint8)[[0, -1]]
IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(kind: str, n: int) -> np.ndarray:
    p = _powers[kind]
    if len(p) < n:
        size = 1 << (n - 1).bit_length()
        p = _powers[kind] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, BASE if kind == "up" else INVERSE, np.uint64))])
    return p[:n]


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from each start to its end, wherever they stand."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers("up", len(data)), out=total[1:])
    return mixed((total[end] - total[start]) * powers("down", len(data))[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words_at(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text that ends in white space, and where they start; words are split at ASCII white space."""
    gap = IS_SPACE[data]
    start = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    end = np.flatnonzero(gap & np.r_[False, ~gap[:-1]])
    return run_hashes(data, start, end), start


def word_hashes(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased with ``fold``) and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if fold:
        data = np.where((data >= LOW) & (data <= HIGH), data + np.uint8(32), data)
    h, start = words_at(data)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.diff(np.searchsorted(start, np.r_[0, ends]))


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted, in one array; and the size of each set."""
    words, count = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), count)
    last = np.cumsum(count)
    k = len(words)
    h = np.zeros(k, np.uint64)
    for j in range(min(n, k)):
        h[: k - j] = h[: k - j] * np.uint64(0x100000001B3) + mixed(words[j:] + np.uint64(j + 1))
    whole = np.arange(k) + n <= last[doc]
    short = np.flatnonzero((count > 0) & (count < n))
    # A text of fewer than n words is one element: its words and their number.
    extra = np.array([int(mixed(np.array([sum(int(w) * (2 * i + 3) for i, w in enumerate(words[last[d] - count[d] : last[d]])) % (1 << 64) + int(count[d])], np.uint64))[0]) for d in short], np.uint64)
    doc, h = np.r_[doc[whole], short], np.r_[mixed(h[whole]), extra]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    return h[new], np.bincount(doc[new], minlength=len(texts))


def slices(batch: pa.RecordBatch, column: int, size: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch of at most ``size`` bytes of text each (a longer text alone), with their texts (null: empty); no more than a part is copied."""
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, a = np.cumsum(length), 0
    while a < len(length):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - length[a] + size, side="right")))
        part = batch.slice(a, b - a)
        yield part, [x or b"" for x in part.column(column).cast(pa.binary()).to_pylist()]
        a = b


def rarity(docs: DataFrame, n: int) -> np.ndarray:
    """How many documents' sets have an element in each hash bucket, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, texts in slices(b, 0):
                h, _ = shingle_sets(texts, n)
                cells += np.bincount((h >> np.uint64(46)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(cells[at])], ["cell", "n"])

    summed = docs.select("text").mapInArrow(lean(run), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[summed["cell"].to_numpy(np.int64)] = summed["n"]
    return np.minimum(out, (1 << 32) - 1).astype(np.uint32)


def ordered(h: np.ndarray, size: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """The elements of each set in the global order: by bucket count, then hash."""
    doc = np.repeat(np.arange(len(size)), size)
    return h[np.lexsort((h, rare[(h >> np.uint64(46)).astype(np.int64)], doc))]


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap with 100 * overlap >= percent * union."""
    return -(-(percent * (a + b)) // (100 + percent))


def prefixes(docs: DataFrame, rare: np.ndarray, n: int, percent: int) -> DataFrame:
    """doc_id, size, class (a 128-bit digest of the set) and prefix elements of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in slices(b, 1):
                h, size = shingle_sets(texts, n)
                first = np.r_[0, np.cumsum(size)]
                some = size > 0
                one, two = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
                if some.any():
                    one[some] = np.add.reduceat(mixed(h + np.uint64(1)), first[:-1][some])
                    two[some] = np.add.reduceat(mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first[:-1][some])
                h = ordered(h, size, rare)
                keep = np.where(size * (100 - percent) >= percent, size - -(-size * percent // 100) + 1, 0)  # smaller sets match equal sets only
                at = np.arange(len(h)) - np.repeat(first[:-1], size)
                pre = h[at < np.repeat(keep, size)].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(keep)].astype(np.int32)), pa.array(pre))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists], ["doc_id", "size", "c1", "c2", "prefix"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, size long, c1 long, c2 long, prefix array<long>")


def trie_matches(centre: np.ndarray, sets: list[np.ndarray], order: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of ``sets`` reach the similarity with ``centre``.

    Sets sorted by their ordered elements are the depth-first walk of a prefix
    tree; the depth that neighbours share is the path they share. ``order``
    holds sort keys of the same elements. Overlaps of the shared path are kept
    on a stack, and a branch ends where hits + elements left is below need.
    """
    walk = sorted(range(len(sets)), key=lambda i: order[i].tobytes())
    ok = np.zeros(len(sets), bool)
    mine = np.sort(centre)
    hits = np.zeros(1, np.int64)  # hits[d]: overlap of the first d elements on the current path
    done = np.zeros(0, np.uint64)
    misses = 0
    for i in walk:
        s = sets[i]
        need = int(needed(np.int64(len(s)), np.int64(len(centre)), percent))
        m = min(len(done), len(s))
        same = done[:m] == s[:m]
        depth = m if same.all() else int(same.argmin())
        spare = len(s) - need  # how many elements of s may be missing from the centre
        if spare < 0 or len(centre) < need:
            continue
        if depth - hits[depth] > spare:  # the shared path has too many misses already
            continue
        rest = s[depth:]
        at = np.searchsorted(mine, rest)
        hit = (at < len(mine)) & (mine[np.minimum(at, len(mine) - 1)] == rest)
        hits = np.concatenate([hits[: depth + 1], hits[depth] + np.cumsum(hit)])
        done = s
        ok[i] = hits[len(s)] >= need
    return ok


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose prefixes share enough for their sets to reach the similarity.

    A set that needs k of its s elements in the other may miss s - k; the
    prefix that ends first in the global order holds all shared elements up to
    there, so the prefixes share at least its length less those misses.
    """
    pairs = saved(pairs, "pairs")
    ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "ids")
    own = classes.select("rep", "size", "prefix").join(few(ids), "rep", "left_semi")
    one, two = (own.select(F.col("rep").alias(x), F.col("size").alias(f"{x}_size"), F.col("prefix").alias(f"{x}_prefix")) for x in "ab")
    need = F.ceil((F.col("a_size") + F.col("b_size")) * percent / (100 + percent))
    least = F.least(*(F.size(f"{x}_prefix") - (F.col(f"{x}_size") - need) for x in "ab"))
    return pairs.join(one, "a").join(two, "b").where(F.size(F.array_intersect("a_prefix", "b_prefix")) >= least).select("a", "b")


TREE, TREE_BYTES = 256, 8 << 20  # partners of a centre that share one tree, and the size of their sets
ROLES = 1024  # trees that one reading of a text serves
SETS_A_BATCH = 64  # whole sets that pass between Spark and Python at once


def verified(pairs: DataFrame, docs: DataFrame, rare: np.ndarray, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of document ids whose sets reach the similarity. Sets are made again from the texts of the documents in question."""
    pairs = saved(pairs, "candidates")
    trees = pairs.groupBy("a").agg(F.ceil(F.count("*") / TREE).cast("int").alias("trees"))
    dealt = pairs.join(trees, "a").withColumn("part", F.pmod(F.xxhash64("b"), "trees").cast("int"))
    centre = trees.select(F.col("a").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("part"), "a", F.lit(None).cast("long").alias("b"))
    every = saved(centre.unionByName(dealt.select(F.col("b").alias("doc_id"), "part", "a", "b")), "every-role")
    many = every.groupBy("doc_id").agg(F.ceil(F.count("*") / ROLES).cast("int").alias("readings"))
    every = every.join(many, "doc_id").withColumn("reading", F.pmod(F.xxhash64("a", "b"), "readings"))
    roles = saved(every.groupBy("doc_id", "reading").agg(F.collect_list(F.struct("a", "part", "b")).alias("roles")), "roles")
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few(roles), "doc_id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, text in slices(b, 0):
                h, size = shingle_sets(text, n)
                raw, first = ordered(h, size, rare).tobytes(), np.r_[0, np.cumsum(size)] * 8
                yield pa.RecordBatch.from_arrays([pa.array([raw[x:y] for x, y in zip(first, first[1:], strict=False)], pa.binary()), part.column(1)], ["elements", "roles"])

    sets = wanted.select("text", "roles").mapInArrow(lean(make), "elements binary, roles array<struct<a:long,part:int,b:long>>")
    both = sets.select(F.explode("roles").alias("r"), "elements").select("r.a", "r.part", "r.b", "elements")
    both = both.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, key, held, size = set(), None, [], 0

        def tree() -> pa.RecordBatch:
            nonlocal size
            els = [np.frombuffer(e, np.uint64) for _, e in held]
            order = [np.hstack([rare[(e >> np.uint64(46)).astype(np.int64)].astype(">u4").reshape(-1, 1).view(np.uint8), e.astype(">u8").reshape(-1, 1).view(np.uint8)]) for e in els]
            ok = np.any([trie_matches(np.frombuffer(c, np.uint64), els, order, percent) for c in centres], axis=0)
            got = [b for (b, _), y in zip(held, ok, strict=True) if y]
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(got), pa.int64()), pa.array(got, pa.int64())], ["a", "b"])

        for batch in batches:
            for a, p, b, e in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if held and ((a, p) != key or len(held) >= 2 * TREE or size >= TREE_BYTES):
                    yield tree()
                if (a, p) != key:
                    centres, key = set(), (a, p)
                if b is None:
                    centres.add(e)  # more than one only where rows share an id
                else:
                    held.append((b, e))
                    size += len(e)
        if held:
            yield tree()

    links = saved(both.mapInArrow(lean(judge), "a long, b long"), "links", SETS_A_BATCH)
    dropped(pairs, every, roles)
    return links


CELL = 512  # sets in a block of a cell of the tree join
MIXED = object()  # stands for more than one component


Member = tuple[int, int, int, int, list[int]]  # id, component, set size, place of the cell's element in the set, shared prefix elements from it on


class Node:
    """A node of a prefix tree: the members whose lists share the path to it, with bounds over them. Children come about when a walk gets here."""

    __slots__ = ("members", "most", "low", "high", "component", "below")

    def __init__(self, members: list[Member]) -> None:
        self.members = members
        sizes, components = [m[2] for m in members], {m[1] for m in members}
        self.most, self.low, self.high = max(len(m[4]) for m in members), min(sizes), max(sizes)
        self.component = components.pop() if len(components) == 1 else MIXED
        self.below: dict[int | None, Node] | None = None

    def children(self, depth: int) -> dict[int | None, Node]:
        if self.below is None:
            dealt: dict[int | None, list[Member]] = {}
            for m in self.members:
                dealt.setdefault(m[4][depth] if len(m[4]) > depth else None, []).append(m)
            self.below = {e: Node(ms) for e, ms in dealt.items()}
        return self.below


def walked(probes: list[Member], members: list[Member], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of ids of different components whose prefixes share enough, and first the cell's element.

    A set that needs k of its s elements in the other may miss s - k, so two
    prefixes share at least the shorter one's length less those misses. A path
    ends in a single member, whose remaining elements are counted at once, or
    in members of equal lists.
    """
    need = lambda a, b: -(-(percent * (a + b)) // (100 + percent))
    rest = lambda a: 1 - -(-percent * a // 100)  # noqa: E731  prefix length less set size
    root = Node(members)
    for i, component, size, pos, els in probes:
        mine = set(els)
        stack = [(root, 1, 1)]  # all share the cell's element
        while stack:
            node, depth, hits = stack.pop()
            if node.component == component or percent * node.low > 100 * size or percent * size > 100 * node.high:
                continue
            # What stands before the first shared element is missing from the other set, and the smallest set below asks for least.
            if pos > size - need(size, node.low):
                continue
            # For sets below that are no larger the smallest asks for least, for larger ones the largest (here without rounding up).
            least = min(need(size, node.low) + rest(size), percent * (size + node.high) / (100 + percent) - percent * node.high / 100)
            if hits + min(node.most - depth, len(mine) - hits) < least:
                continue
            if len(node.members) > 1 and node.most > depth:
                stack += [(child, depth + 1, hits + (e in mine)) for e, child in node.children(depth).items()]
                continue
            for j, other, n, where, theirs in node.members:
                both = need(size, n)
                if component != other and i != j and pos <= size - both and where <= n - both and hits + sum(e in mine for e in theirs[depth:]) >= both + rest(max(size, n)):
                    yield (i, j) if i < j else (j, i)


CELL_NAMES = ["e", "i", "j", "probe", "rep", "c", "size", "pos"]
CELL_KEY = "e long, i int, j int, probe boolean, rep long, c long, size long, pos int"


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows (without their keys) of each group, from rows sorted by the first ``keys`` columns."""
    now, held = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in range(b.num_columns)), strict=True):
            if row[:keys] != now:
                if held:
                    yield now, held
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield now, held


def tree_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) among sets (rep, c, size) that share an element (e, at place pos) and differ in component c."""
    blocks = shared.groupBy("e").agg(F.ceil(F.count("*") / CELL).cast("int").alias("n"))
    dealt = shared.join(blocks, "e").withColumn("mine", F.pmod(F.xxhash64("rep"), "n").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cells = dealt.select("e", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).alias("probe"), "rep", "c", "size", "pos")
    by_cell = lambda df: df.repartition("e", "i", "j").sortWithinPartitions("e", "i", "j")

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The members of cells that sizes and places leave a partner; the elements of all others need not be fetched."""
        kept: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = [list(x) for x in zip(*kept, strict=True)]
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], CELL_NAMES)

        for (e, i, j), rows in grouped(batches, 3):
            if len(rows) < 2:
                continue
            if len(rows) == 2 and i == j:  # as below, without arrays, as most cells are such
                (_, _, c1, s1, p1), (_, _, c2, s2, p2) = rows
                both = -(-(percent * (s1 + s2)) // (100 + percent))
                if c1 != c2 and s1 - p1 >= both and s2 - p2 >= both:
                    kept += [(e, i, j, *r) for r in rows]
                continue
            probe, _, c, size, pos = (np.array(x) for x in zip(*rows, strict=True))
            one, two = (np.arange(len(rows)),) * 2 if i == j else (np.flatnonzero(probe), np.flatnonzero(~probe))
            need = needed(size[one][:, None], size[two][None], percent)
            ok = (c[one][:, None] != c[two][None]) & ((size - pos)[one][:, None] >= need) & ((size - pos)[two][None] >= need)
            live = np.zeros(len(rows), bool)
            live[one[ok.any(axis=1)]] = live[two[ok.any(axis=0)]] = True
            kept += [(e, i, j, *rows[k]) for k in np.flatnonzero(live)]
            if len(kept) > 10_000:
                yield out()
        if kept:
            yield out()

    left = saved(by_cell(cells).mapInArrow(lean(hopeful), CELL_KEY), "cells")
    reps = saved(left.select("rep").distinct(), "reps")
    lists = shared.join(few(reps), "rep").groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "e"))), lambda x: x["e"]).alias("els"))
    onward = F.slice("els", F.array_position("els", F.col("e")).cast("int"), F.size("els"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in grouped(batches, 3):
            one, two = ([r[1:] for r in rows if i == j or r[0] == side] for side in (True, False))
            got = list(dict.fromkeys(walked(one, two, percent))) if one and two else []
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], ["a", "b"])

    found = by_cell(left.join(lists, "rep").select("e", "i", "j", "probe", "rep", "c", "size", "pos", onward.alias("els"))).mapInArrow(lean(join), "a long, b long")
    return found.distinct()


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) of every row."""
    rare = rarity(docs, n)
    rows = saved(prefixes(docs, rare, n, percent), "prefixes")
    named = rows.where((F.col("size") > 0) & F.col("doc_id").isNotNull())
    # Equal sets are one class from here on; its smallest id stands for it. Prefixes are shuffled of sets that stand more than once only.
    key = ["c1", "c2", "size"]
    many = saved(named.groupBy(*key).agg(F.count("*").alias("k")).where("k > 1").select(*key), "many")
    once = named.join(few(many), key, "left_anti").select(*key, F.col("doc_id").alias("rep"), "prefix")
    more = named.join(few(many), key, "left_semi").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min_by("prefix", "doc_id").alias("prefix"))
    classes = saved(once.unionByName(more), "classes")
    whole, rows = rows, saved(rows.select("doc_id", *key), "sizes")
    dropped(whole, many)
    els = classes.select("size", "rep", F.posexplode("prefix").alias("pos", "e"))
    often = saved(els.groupBy("e").agg(F.count("*").alias("k")).where("k > 1"), "often")
    met = saved(els.join(often.hint("merge"), "e"), "met")  # by shuffle at every size
    # The set whose prefix meets most others is nearest the middle of its group of near copies.
    small = met.join(met.groupBy("rep").agg(F.sum("k").alias("w")), "rep")
    # Sets of like size share a band in one of two bandings, half a step apart; each meets the middle set of its bands.
    place = F.log(F.col("size").cast("double")) / float(np.log(100 / percent))
    me = F.struct("w", "size", "pos", (-F.col("rep")).alias("neg"))
    banded = small.withColumn("band", F.explode(F.array(F.floor(place) * 2, F.floor(place + 0.5) * 2 + 1)))
    middle = saved(banded.groupBy("e", "band").agg(F.max(me).alias("m"), F.count("*").alias("k")).where("k > 1").drop("k"), "middle")
    banded = met.withColumn("band", F.explode(F.array(F.floor(place) * 2, F.floor(place + 0.5) * 2 + 1)))

    def near(x: str, y: str) -> Column:
        """Whether an element can be the first one shared by two sets that need it: at most |S| - needed elements come before it in each."""
        need = F.ceil((F.col(f"{x}size") + F.col(f"{y}size")) * percent / (100 + percent))
        return (F.col(f"{x}pos") <= F.col(f"{x}size") - need) & (F.col(f"{y}pos") <= F.col(f"{y}size") - need)

    centre = banded.join(few(middle), ["e", "band"])
    star = centre.where((F.col("rep") != -F.col("m.neg")) & near("", "m.")).select((-F.col("m.neg")).alias("a"), F.col("rep").alias("b")).distinct()
    links = verified(plausible(star, classes, percent), docs, rare, n, percent)
    comp = saved(connected(links), "stars")
    # Elements whose sets are all in one component need no more comparisons.
    with_c = met.join(few(comp).withColumnRenamed("id", "rep"), "rep", "left").select("e", "size", "pos", "rep", F.coalesce("component", "rep").alias("c"))
    open_e = saved(with_c.groupBy("e").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("e"), "open")
    left = saved(with_c.join(few(open_e), "e"), "left")
    rest = verified(tree_pairs(left, percent), docs, rare, n, percent)
    dropped(often, met, middle, open_e, left)
    comp = saved(connected(links.union(rest)), "components")
    named_c = classes.join(comp, F.col("rep") == F.col("id"), "left").select("c1", "c2", F.col("size").alias("_s"), F.coalesce("component", "rep").alias("component"))
    # A component's smallest id is that of its smallest class.
    out = rows.select("doc_id", "size", "c1", "c2").join(named_c.withColumnRenamed("_s", "size"), ["c1", "c2", "size"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with the document of smallest id of each group of linked texts; rows with a null id stay."""
    found = saved(join(docs, n, percent), "groups")
    again = found.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    gone = saved(found.where("doc_id <> component_id").select("doc_id"), "copies")
    kept = docs.join(few(gone), "doc_id", "left_anti").select(*docs.columns)
    if not again:
        return kept
    nulls = kept.where(F.col("doc_id").isNull())
    return kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]).unionByName(nulls)
