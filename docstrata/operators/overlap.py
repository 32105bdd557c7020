"""Which windows of one recipe share the most runs of words with those of another, within each document."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

SPACE = re.compile("[ \t\n\x0b\f\r]+")  # what \s is to Spark


def runs(texts: Iterable[str | None], size: int, overlap: int, n: int) -> dict[int, set[tuple[str, ...]]]:
    """The distinct runs of ``n`` words in each window, by its ordinal; windows as ``model.windows`` makes them."""
    out = defaultdict(set)
    for text in texts:
        words = [w for w in SPACE.split(text or "") if w]
        each = list(zip(*(words[k:] for k in range(n)), strict=False))
        for ordinal, start in enumerate(range(0, max(len(words) - overlap - 1, 0) + 1, size - overlap)):
            out[ordinal].update(each[start : start + size - n + 1])
    return out


def best_overlaps(texts: Iterable[str | None], old: tuple[int, int], new: tuple[int, int], n: int) -> Iterator[tuple[int, int, int]]:
    """(old ordinal, new ordinal, shared runs) of the new window that shares most with each old one, the first of equals."""
    holders = defaultdict(list)
    for ordinal, held in runs(texts, *new, n).items():
        for run in held:
            holders[run].append(ordinal)
    for ordinal, held in runs(texts, *old, n).items():
        shared = Counter()
        for run in held:
            shared.update(holders.get(run, ()))
        if shared:
            best = max(shared, key=lambda k: (shared[k], -k))
            yield ordinal, best, shared[best]


def overlapping_windows(old: tuple[int, int], new: tuple[int, int], n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over batches of (doc_id, texts): a row for each old window that shares a run with a new one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for k, texts in enumerate(batch.column("texts")):
                each = list(best_overlaps(texts.as_py(), old, new, n))
                rows += [k] * len(each)
                found += each
            columns = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, "int64")), *map(pa.array, columns, (pa.int32(), pa.int32(), pa.int64()))], names=["doc_id", "old_ordinal", "new_ordinal", "shared"])

    return run
