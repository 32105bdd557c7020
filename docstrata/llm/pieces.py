"""SentencePiece encoding and decoding (BPE models with byte fallback), by suffix-array matching.

A batch's text is cut where no piece can cross (a non-space followed by a
space), and its distinct words, concatenated, are indexed by a suffix array
(rank doubling up to the longest piece); a word that repeats is indexed once.
Every piece of the vocabulary is found by binary search, all pieces at once;
its occurrences become edges over text positions. Edges, sorted by position,
are relaxed left to right: a prefix of a word has one encoding, and an edge
extends it exactly if its piece and the last piece of the prefix stay apart
when their text is merged alone. That makes the result equal to merging pairs
by rank. Characters outside the vocabulary are borders too. Work grows in
proportion to a text's length, also where it has no spaces.

White space becomes U+2581 and a text starts with one, as the model's identity
normaliser asks. Words met before are kept in a table of bounded size in each
worker, by 64-bit hash; ``round_trip`` holds every text against its decoding.

Edge cases: a null or empty text has no tokens and decodes to an empty text;
characters outside the vocabulary become byte pieces; U+2581 in a text decodes
to a space; repeated rows and ids, and rows with a null id, are encoded each;
ties between merges go to the leftmost; an empty table stays empty; columns
other than doc_id and text are ignored, whatever their names. Long texts are
cut at words; only a word is held whole.
"""

from __future__ import annotations

import heapq
import re
import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_join import run_hashes, slices
from .shared import lean

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
MARK = SPACE.encode()
BATCH = 2 << 20  # bytes of text that are encoded together (a longer text alone)
UNIT = 1 << 19  # bytes that one numpy pass cuts into words
INDEXED = 1 << 17  # characters of one suffix array (a longer word has its own)
LONG = 2048  # characters; longer runs are relaxed one by one
PAIRS = 2_000_000  # answers on pairs of pieces that a worker remembers
KEPT = 500_000  # words that a worker remembers


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    plain: np.ndarray  # ordinary pieces, neither control nor byte
    first_byte: int
    whole: np.ndarray | None = None  # ordinary pieces that merging their own text gives
    state: dict = field(default_factory=dict, repr=False)

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        odd = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        v = cls([sp.id_to_piece(i) for i in range(n)], np.array([sp.get_score(i) for i in range(n)]), ~np.array(odd), sp.piece_to_id("<0x00>"))
        v.whole = np.array([i for i in range(n) if v.plain[i] and v.merged(v.pieces[i]) == [v.pieces[i]]])
        return v

    def __getstate__(self) -> dict:
        return self.__dict__ | {"state": {}}

    def rank(self) -> dict[str, float]:
        if "rank" not in self.state:
            self.state["rank"] = {p: -s for p, s, ok in zip(self.pieces, self.scores, self.plain, strict=True) if ok}
        return self.state["rank"]

    def merged(self, text: str) -> list[str]:
        """Pairs merged by rank, leftmost first; the definition that edges are checked against."""
        rank, parts = self.rank(), list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(rank[a + b], i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= len(parts) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, "", after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else len(parts)
                if y < len(parts) and parts[x] + parts[y] in rank:
                    heapq.heappush(heap, (rank[parts[x] + parts[y]], x, parts[x] + parts[y]))
        return [p for p in parts if p]

    @staticmethod
    def raw(text: str) -> bytes:
        """UTF-8; bytes that were no UTF-8 come back as they were."""
        try:
            return text.encode("utf-8", "surrogateescape")
        except UnicodeEncodeError:
            return text.encode("utf-8", "surrogatepass")

    def byte_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all pieces in one array, and the number and the first place of each piece's."""
        if "bytes" not in self.state:
            own = [bytes([i - self.first_byte]) if self.first_byte <= i < self.first_byte + 256 else p.replace(SPACE, " ").encode() if ok else b"" for i, (p, ok) in enumerate(zip(self.pieces, self.plain, strict=True))]
            width = np.array([len(x) for x in own])
            self.state["bytes"] = np.frombuffer(b"".join(own), np.uint8), width, np.cumsum(width) - width
        return self.state["bytes"]

    def stay_apart(self, a: str, b: str) -> bool:
        """Whether merging the joined text gives the two pieces again; surely so if no piece spans the border."""
        rank = self.rank()
        if not any(a[i:] + b[:j] in rank for i in range(len(a)) for j in range(1, len(b) + 1)):
            return True
        return self.merged(a + b) == [a, b]

    def apart(self, pairs: np.ndarray) -> np.ndarray:
        """Whether two pieces (coded a * len + b; len - 1 stands for an unknown character) stay apart; answers are remembered."""
        known = self.state.setdefault("known", np.zeros(0, np.int64))
        value = self.state.setdefault("value", np.zeros(0, bool))
        at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
        new = np.unique(pairs[known[at] != pairs] if len(known) else pairs)
        if len(known) + len(new) > PAIRS and len(known):
            self.state["known"], self.state["value"] = known[:0], value[:0]
            return self.apart(pairs)
        if len(new):
            n = len(self.pieces) + 1
            got = []
            for c in new:
                a, b = divmod(int(c), n)
                got.append(a == n - 1 or b == n - 1 or self.stay_apart(self.pieces[a], self.pieces[b]))
            to = np.searchsorted(known, new)
            known, value = self.state["known"], self.state["value"] = np.insert(known, to, new), np.insert(value, to, got)
            at = np.searchsorted(known, pairs)
        return value[at]

    def alphabet(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Sorted characters of all pieces, pieces as rows of character numbers (from 1), their lengths, and the longest."""
        if "alphabet" not in self.state:
            own = [self.pieces[i] for i in self.whole]
            chars = np.unique(np.array([ord(c) for p in own for c in p], np.uint32))
            length = np.array([len(p) for p in own])
            longest = max(4, 1 << (int(length.max()) - 1).bit_length())
            rows = np.zeros((len(own), longest), np.int64)
            for k, p in enumerate(own):
                rows[k, : len(p)] = np.searchsorted(chars, [ord(c) for c in p]) + 1
            self.state["alphabet"] = chars, rows, length, longest
        return self.state["alphabet"]


def suffix_array(text: np.ndarray, longest: int) -> np.ndarray:
    """Positions sorted by their next ``longest`` characters (a power of two), by rank doubling. text: numbers from 0."""
    padded = np.r_[text.astype(np.int64), np.zeros(4, np.int64)]
    packed, width = (padded[:-4] << 45) | (padded[1:-3] << 30) | (padded[2:-2] << 15) | padded[3:-1], 4  # character numbers are below 2**15
    order = np.argsort(packed)
    there = packed[order]
    rank = np.empty_like(packed)
    rank[order] = np.cumsum(np.r_[1, there[1:] != there[:-1]])
    while width < longest:
        later = np.zeros_like(rank)
        later[:-width] = rank[width:]
        pair = (rank << 32) | later
        order = np.argsort(pair)
        there = pair[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.r_[1, there[1:] != there[:-1]])
        width *= 2
    return order


def occurrences(text: np.ndarray, order: np.ndarray, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of suffixes that begin with each piece: one binary search for all pieces together, a character at a time."""
    padded = np.r_[text, np.zeros(rows.shape[1], text.dtype)]
    lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(order), np.int64)
    for depth in range(int(length.max())):
        live = np.flatnonzero((length > depth) & (lo < hi))
        for upper in (False, True):
            a, b = lo[live].copy(), hi[live].copy()
            while (go := a < b).any():
                mid = (a + b) // 2
                c = padded[order[np.minimum(mid, len(order) - 1)] + depth]
                right = (c <= rows[live, depth]) if upper else (c < rows[live, depth])
                a, b = np.where(go & right, mid + 1, a), np.where(go & ~right, mid, b)
            if upper:
                hi[live] = a
            else:
                first = a
        lo[live] = first
    return lo, hi


def relaxed(v: Vocabulary, start: np.ndarray, end: np.ndarray, piece: np.ndarray, head: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The last piece of the one encoding of every prefix (-1: none), and where that piece starts; head: where each edge's run begins."""
    unk = len(v.pieces)
    last, origin = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    step = end - head  # where in its run an edge ends
    long = np.zeros(size + 1, bool)
    long[head[step > LONG]] = True
    far = long[head]

    by = np.flatnonzero(far)
    by = by[np.argsort(end[by], kind="stable")]
    apart: dict[int, bool] = {}
    for s, e, p, h in zip(start[by].tolist(), end[by].tolist(), piece[by].tolist(), head[by].tolist(), strict=True):
        if s != h:
            before = int(last[s])
            if before < 0:
                continue
            if before != unk and p != unk:
                pair = before * (unk + 1) + p
                if pair not in apart:
                    apart[pair] = v.stay_apart(v.pieces[before], v.pieces[p])
                if not apart[pair]:
                    continue
        last[e], origin[e] = p, s

    # Runs of ordinary length go together, a position at a time.
    by = np.argsort(np.minimum(step, LONG + 1).astype(np.int16), kind="stable")
    by = by[~far[by]]
    start, end, piece, step, opening = start[by], end[by], piece[by], step[by], (start == head)[by]
    turns = np.flatnonzero(np.r_[True, step[1:] != step[:-1]]) if len(step) else np.zeros(0, np.int64)
    for a, b in zip(turns, np.r_[turns, len(step)][1:], strict=True):
        s, p = start[a:b], piece[a:b]
        ok = opening[a:b].copy()
        rest = np.flatnonzero(~ok & (last[s] >= 0))
        ok[rest] = v.apart(last[s[rest]] * (unk + 1) + p[rest])
        e = end[a:b][ok]
        last[e], origin[e] = p[ok], s[ok]
    return last, origin


def encode_words(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' token ids in one array, and the number of each word's."""
    chars, rows, length, longest = v.alphabet()
    joined = "\0".join(words) + "\0"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.minimum(np.searchsorted(chars, raw), len(chars) - 1)
    text = np.where(chars[at] == raw, at + 1, 0)
    size = np.array([len(w) for w in words])
    begin = np.cumsum(size + 1) - (size + 1)
    order = suffix_array(text, longest)
    lo, hi = occurrences(text, order, rows, length)
    n = hi - lo
    # Edges are many, so their arrays are of 32 bits.
    start = order.astype(np.int32)[np.arange(n.sum(), dtype=np.int32) + np.repeat((lo - (np.cumsum(n) - n)).astype(np.int32), n)]
    piece, end = np.repeat(v.whole.astype(np.int32), n), start + np.repeat(length.astype(np.int32), n)
    inside = np.zeros(len(text), bool)
    inside[begin + size] = True  # the separators
    unknown = np.flatnonzero((text == 0) & ~inside).astype(np.int32)
    unk = len(v.pieces)
    # No piece crosses an unknown character, so a run ends before it and another begins after it.
    opens = np.zeros(len(text) + 1, bool)
    opens[begin] = opens[unknown] = opens[unknown + 1] = True
    head = np.maximum.accumulate(np.where(opens, np.arange(len(opens), dtype=np.int32), np.int32(0)))
    start, end, piece = np.r_[start, unknown], np.r_[end, unknown + np.int32(1)], np.r_[piece, np.full(len(unknown), unk, np.int32)]
    last, origin = relaxed(v, start, end, piece, head[start], len(text))

    # A word's tokens, from its end back to its start, for all words at once.
    word, pos = np.flatnonzero(size > 0), (begin + size)[size > 0]
    path: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    broken = np.zeros(len(words), bool)
    while len(word):
        lost = last[pos] < 0
        if lost.any():
            broken[word[lost]] = True
            word, pos = word[~lost], pos[~lost]
        path.append((word, origin[pos], last[pos]))
        pos = origin[pos]
        go = pos > begin[word]
        word, pos = word[go], pos[go]
    word, pos, token = (np.concatenate(x) for x in zip(*path, strict=True)) if path else [np.zeros(0, np.int64)] * 3
    by = np.lexsort((pos, word))
    word, pos, token = word[by], pos[by], token[by]
    if (token == unk).any():
        odd, which = np.unique(raw[pos[token == unk]], return_inverse=True)
        own = [[v.first_byte + b for b in v.raw(chr(c))] for c in odd]
        wide = np.ones(len(token), np.int64)
        wide[token == unk] = np.array([len(x) for x in own])[which]
        first = np.cumsum(wide) - wide
        word, filled = np.repeat(word, wide), np.repeat(token, wide)
        flat, at = np.array([i for x in own for i in x]), np.cumsum([0, *map(len, own)])[:-1]
        many = wide[token == unk]
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        filled[np.repeat(first[token == unk], many) + inner] = flat[np.repeat(at[which], many) + inner]
        token = filled
    if broken.any():  # never seen: the pair test gives every text an encoding; merging is the definition
        ids = {p: i for i, p in enumerate(v.pieces) if v.plain[i]}
        keep, more = ~broken[word], [(w, i) for w in np.flatnonzero(broken) for p in v.merged(words[w]) for i in ([ids[p]] if p in ids else [v.first_byte + b for b in v.raw(p)])]
        word, token = np.r_[word[keep], [w for w, _ in more]], np.r_[token[keep], [i for _, i in more]]
        by = np.argsort(word, kind="stable")
        word, token = word[by], token[by]
    return token.astype(np.int32), np.bincount(word, minlength=len(words))


class Encoder:
    """Word table of one worker, and encoding of batches of texts."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.forget()

    def forget(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # word hashes, sorted, and their places
        self.flat, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    @classmethod
    def of_worker(cls, v: Vocabulary) -> Encoder:
        """The encoder of this process: tasks that a worker runs one after another share its tables."""
        shelf = sys.modules.setdefault("docstrata_worker", types.ModuleType("docstrata_worker"))
        key = (len(v.pieces), v.pieces[-1], float(v.scores.sum()))
        kept = getattr(shelf, "encoder", None)
        if kept is None or kept[0] != key:
            shelf.encoder = kept = (key, cls(v))
        return kept[1]

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        flat, counts, a = [self.flat], [], 0
        while a < len(words):
            b, size = a, 0
            while b < len(words) and (b == a or size + len(words[b]) < INDEXED):
                size += len(words[b]) + 1
                b += 1
            ids, count = encode_words(self.v, words[a:b])
            flat.append(ids)
            counts.append(count)
            a = b
        slot = len(self.first) - 1 + np.arange(len(words))
        self.flat = np.concatenate(flat)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(counts))])
        by = np.argsort(hashes)
        to = np.searchsorted(self.known, hashes[by])
        self.known, self.slot = np.insert(self.known, to, hashes[by]), np.insert(self.slot, to, slot[by])

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        return self.known[at] != hashes if len(self.known) else np.ones(len(hashes), bool)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All token ids in one array, and the number of tokens of each text (UTF-8)."""
        found, novel = [], {}
        for data, begin, owner in _runs(texts):
            space = data == 32
            opens = space & ~np.r_[False, space[:-1]]
            opens[begin] = True
            start = np.flatnonzero(opens)
            h, at, back = np.unique(run_hashes(data, start, np.r_[start[1:], len(data)]), return_index=True, return_inverse=True)
            new = np.flatnonzero(self.missing(h))
            if len(new):
                raw, end = data.tobytes(), np.r_[start[1:], len(data)]
                novel.update((int(h[k]), raw[start[at[k]] : end[at[k]]]) for k in new if int(h[k]) not in novel)
            found.append((h, back, owner[np.searchsorted(begin, start, side="right") - 1]))
        if novel:
            if len(self.known) + len(novel) > KEPT and len(self.known):
                self.forget()
                return self.encode(texts)
            self.learn(np.fromiter(novel, np.uint64, len(novel)), [w.decode("utf-8", "surrogateescape").replace(" ", SPACE) for w in novel.values()])
        ids, total = [], np.zeros(len(texts), np.int64)
        for h, back, owner in found:
            at = self.slot[np.searchsorted(self.known, h)][back]
            n = self.first[at + 1] - self.first[at]
            ids.append(self.flat[np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            total += np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64)
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), total


BORDER = re.compile(rb"[^ ] ")


def _runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts, each begun by a space and cut where words begin, in arrays of about UNIT bytes; where the parts begin, and whose they are."""
    held, owner, size = [], [], 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(held), np.uint8)
        begin = np.cumsum([0, *map(len, held)])[:-1]
        got = data, begin, np.array(owner)
        held.clear()
        owner.clear()
        return got

    for i, t in enumerate(texts):
        if t:
            t, a = b" " + t.replace(MARK, b" "), 0
            while a < len(t):
                m = BORDER.search(t, a + UNIT) if a + UNIT < len(t) else None
                b = m.start() + 1 if m else len(t)
                held.append(t[a:b])
                owner.append(i)
                size += b - a
                a = b
                if size >= UNIT:
                    yield out()
                    size = 0
    if held:
        yield out()


def same_bytes(v: Vocabulary, ids: np.ndarray, n: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Whether each text's tokens decode to it again: their bytes in one array, held against the texts' own."""
    table = v.byte_table()
    width = table[1][ids]
    at = np.repeat(table[2][ids] - (np.cumsum(width) - width), width) + np.arange(width.sum())
    got = table[0][at]
    whole = [b" " + t.replace(MARK, b" ") if t else b"" for t in texts]
    want = np.frombuffer(b"".join(whole), np.uint8)
    length = np.array([len(t) for t in whole])
    ends = np.r_[0, np.cumsum(width)][np.r_[0, np.cumsum(n)]]
    fits = np.diff(ends) == length
    if fits.all():
        wrong = np.r_[0, np.cumsum(got != want)]
        stop = np.r_[0, np.cumsum(length)]
        return wrong[stop[1:]] == wrong[stop[:-1]]
    return np.array([bool(f) and got[a:b].tobytes() == t for f, a, b, t in zip(fits, ends, ends[1:], whole, strict=False)])


def decode(v: Vocabulary, ids: list[int]) -> str:
    """The text of token ids; control and unknown ids give nothing."""
    flat, width, first = v.byte_table()
    at = np.array([i for i in ids if i is not None and 0 <= i < len(width)], np.int64)
    n = width[at]
    raw = flat[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()
    return raw.removeprefix(b" ").decode("utf-8", "replace")


def encoded(docs: DataFrame, v: Vocabulary, check: bool = True) -> DataFrame:
    """doc_id, ids, n_tokens and, with ``check``, whether decoding gives the text again, of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of_worker(v)
        for batch in batches:
            for part, texts in slices(batch, 1, BATCH):
                ids, n = enc.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(ids))
                same = same_bytes(enc.v, ids, n, texts) if check else np.ones(len(n), bool)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(n), pa.array(same)], ["doc_id", "ids", "n_tokens", "round_trip"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, ids array<int>, n_tokens long, round_trip boolean")


def decoded(tokens: DataFrame, v: Vocabulary) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give an empty text."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(v, x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(lean(run), f"doc_id {kind}, text string")
