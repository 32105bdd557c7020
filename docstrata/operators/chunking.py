"""Splitting and packing under a cap, table chunks with repeated headers, and page markers, each in one pass within the row.

Sizes are in characters: a token counts as ``CHARS`` of them (the counter that
stands in for a tokenizer). All functions are column expressions: a text never
leaves its row, so nothing is shuffled to be cut.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS = 3
SPACE = r"[ \t\n\r\f]"


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def fallen(unit: Column, cap: int | Column, splits: list) -> Column:
    """``unit`` alone if it fits, else what the first of ``splits`` makes of it, each part by the rest."""
    if not splits:
        return F.array(unit)
    parts = splits[0](unit)
    deeper = F.flatten(F.transform(parts, lambda x: fallen(x, cap, splits[1:])))
    return F.when(F.length(unit) <= cap, F.array(unit)).otherwise(deeper)


def split_lines(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))


def split_sentences(x: Column) -> Column:
    """After an end mark and the white space that follows it."""
    return F.split(x, rf"(?<=[.!?]{SPACE})")


def split_words(x: Column) -> Column:
    """Before each word; white space stays with the word before."""
    return F.split(x, rf"(?<={SPACE})(?=[^ \t\n\r\f])")


def split_runs(cap: int | Column):
    """Every ``cap`` characters."""
    last = lambda x: F.floor((F.length(x) - 1) / cap).cast("int")
    return lambda x: F.transform(F.sequence(F.lit(0), last(x)), lambda i: F.substring(x, (i * cap + 1).cast("int"), F.lit(cap) if isinstance(cap, int) else cap))


def pieces(text: Column, cap: int | Column) -> Column:
    """The text in pieces of at most ``cap`` characters: lines, or of lines that do not fit sentences, of these words, of these runs of characters. Joined they are the text."""
    whole = F.when(F.length(text) > 0, split_lines(text)).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(whole, lambda x: fallen(x, cap, [split_sentences, split_words, split_runs(cap)])))


def starts(sizes: Column, cap: int | Column) -> Column:
    """Where greedy packs begin (from 1): each takes parts in order while their sizes add up to ``cap`` at most. A part over the cap is a pack of its own."""
    begin = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("i"), F.lit(0).cast("long").alias("used"))

    def step(acc: Column, size: Column) -> Column:
        i = acc["i"] + 1
        new = (acc["i"] == 0) | (acc["used"] + size > cap)
        return F.struct(F.when(new, F.array_append(acc["at"], i)).otherwise(acc["at"]).alias("at"), i.alias("i"), F.when(new, size.cast("long")).otherwise(acc["used"] + size).alias("used"))

    return F.aggregate(sizes, begin, step, lambda acc: acc["at"])


def packs(parts: Column, sizes: Column, cap: int | Column) -> Column:
    """The parts in greedy packs: an array of arrays."""
    ends = lambda at: F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(parts) + 1))
    return let(starts(sizes, cap), lambda at: F.when(F.size(at) > 0, F.zip_with(at, ends(at), lambda a, b: F.slice(parts, a, b - a))).otherwise(F.array()))


def text_chunks(text: Column, cap: int | Column) -> Column:
    """Greedy chunks of at most ``cap`` characters; joined they are the text."""
    return let(pieces(text, cap), lambda p: F.transform(packs(p, F.transform(p, lambda x: F.length(x)), cap), lambda x: F.array_join(x, "")))


def prefixed_chunks(prefix: Column, text: Column, cap: int) -> Column:
    """Chunks that each begin with ``prefix``, which counts against the cap; of a prefix over half the cap only that much is repeated."""
    head = F.left(prefix, F.lit(cap // 2))
    return F.transform(text_chunks(text, F.lit(cap) - F.length(head)), lambda x: F.concat(head, x))


# --- tables -------------------------------------------------------------------


def row_line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))


def header_block(header: Column) -> Column:
    """The header row and the rule below it."""
    return F.concat(row_line(header), F.lit("\n"), row_line(F.transform(header, lambda _: F.lit("---"))), F.lit("\n"))


def padded(cells: Column, header: Column) -> Column:
    """The cells of a row filled up, with empty ones, or cut to the width of the header; what is cut off goes into the last cell."""
    n = F.size(header)
    more = F.greatest(n - F.size(cells), F.lit(0))
    last = F.array(F.array_join(F.slice(cells, n, F.greatest(F.size(cells), F.lit(1))), " "))
    return F.when(F.size(cells) <= n, F.concat(cells, F.array_repeat(F.lit(""), more))).otherwise(F.concat(F.slice(cells, F.lit(1), n - 1), last))


def cell_groups(header: Column, cells: Column, cap: int) -> Column:
    """A row that does not fit in parts of some of its cells, each under its own slice of the header; a cell that does not fit alone is cut into runs, each under its header (of one character at least, however long the header)."""
    alone = lambda h: F.greatest(F.lit(cap) - F.length(h) - 18, F.lit(1))  # noqa: E731  what a cell may have beside its header, the rule and the marks of three rows
    parts = lambda h, c: F.when(F.length(c) <= alone(h), F.array(c)).otherwise(split_runs(alone(h))(c))
    cut = F.flatten(F.zip_with(header, cells, lambda h, c: F.transform(parts(h, F.coalesce(c, F.lit(""))), lambda x: F.struct(h.alias("h"), x.alias("c")))))
    size = lambda x: F.length(x["h"]) + F.length(x["c"]) + 12  # noqa: E731  marks in three rows, and the rule
    each = let(cut, lambda xs: packs(xs, F.transform(xs, size), cap - 6))
    return F.transform(each, lambda g: F.concat(header_block(F.transform(g, lambda x: x["h"])), row_line(F.transform(g, lambda x: x["c"])), F.lit("\n")))


def table_chunks(header: Column, rows: Column, cap: int) -> Column:
    """A table in chunks of at most ``cap`` characters cut at row borders, the header and its rule repeated in each; a row that does not fit is cut by cells. Every cell stands once below its header."""
    block = header_block(header)

    def unit(row: Column) -> Column:
        full = lambda cells: let(F.concat(row_line(cells), F.lit("\n")), lambda line: F.struct(cells.alias("cells"), line.alias("line"), (F.length(block) + F.length(line) > cap).alias("over")))
        return let(padded(row, header), full)

    size = lambda u: F.when(u["over"], F.lit(cap + 1)).otherwise(F.length(u["line"]))
    each = let(F.transform(rows, unit), lambda us: packs(us, F.transform(us, size), F.lit(cap) - F.length(block)))
    whole = lambda us: F.array(F.concat(block, F.array_join(F.transform(us, lambda u: u["line"]), "")))
    return F.flatten(F.transform(each, lambda us: F.when(us[0]["over"], cell_groups(header, us[0]["cells"], cap)).otherwise(whole(us))))


# --- pages --------------------------------------------------------------------

ANCHOR = 32  # characters that an anchor has at least


def page_starts(text: Column, anchors: Column) -> Column:
    """Where each page begins in the text (from 1), by the first place of its anchor after the page before; null where it is too short or not found, and never backwards."""
    begin = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("last"))

    def step(acc: Column, anchor: Column) -> Column:
        found = F.when(F.length(anchor) >= ANCHOR, F.nullif(F.call_function("locate", anchor, text, acc["last"] + 1), F.lit(0)))
        return F.struct(F.array_append(acc["at"], found).alias("at"), F.coalesce(found, acc["last"]).alias("last"))

    return F.aggregate(anchors, begin, step, lambda acc: acc["at"])


def marked(text: Column, at: Column) -> Column:
    """The text with a marker ``<!--PAGE:n-->`` before each page that was found."""
    found = F.filter(F.transform(at, lambda p, i: F.struct(p.alias("p"), (i + 1).alias("page"))), lambda x: x["p"].isNotNull())
    end = F.length(text) + 1

    def whole(xs: Column) -> Column:
        ends = F.concat(F.transform(F.slice(xs, 2, F.size(xs)), lambda x: x["p"]), F.array(end))
        parts = F.zip_with(xs, ends, lambda x, e: F.concat(F.lit("<!--PAGE:"), x["page"].cast("string"), F.lit("-->\n"), F.substring(text, x["p"], e - x["p"])))
        return F.concat(F.substring(text, F.lit(1), xs[0]["p"] - 1), F.array_join(parts, ""))

    return let(found, lambda xs: F.when(F.size(xs) > 0, whole(xs)).otherwise(text))


MARKER = r"<!--PAGE:[0-9]+-->\n?"


def page_spans(chunks: Column) -> Column:
    """(text, page_start, page_end) of consecutive chunks of a marked text: the page of a chunk is that of the latest marker, carried on from chunk to chunk; markers are taken out."""
    begin = F.struct(F.array().cast("array<struct<text:string,page_start:int,page_end:int>>").alias("out"), F.lit(None).cast("int").alias("page"))

    def step(acc: Column, chunk: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(chunk, F.lit(r"<!--PAGE:([0-9]+)-->"), F.lit(1)), lambda x: x.cast("int"))
        end = F.when(F.size(numbers) > 0, F.element_at(numbers, -1)).otherwise(acc["page"])
        first = F.when(chunk.rlike(r"\A<!--PAGE:[0-9]+-->") | acc["page"].isNull(), F.coalesce(F.get(numbers, F.lit(0)), acc["page"])).otherwise(acc["page"])
        one = F.struct(F.regexp_replace(chunk, MARKER, "").alias("text"), first.alias("page_start"), end.alias("page_end"))
        return F.struct(F.array_append(acc["out"], one).alias("out"), end.alias("page"))

    return F.aggregate(chunks, begin, step, lambda acc: acc["out"])
