"""From page text to chunks: contents pages, headings, merging, size split, context line.

Everything here is narrow: a page becomes its chunks inside one task, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import is_blank, lines, or_unknown, strip
from gleaner.functions.words import slices
from gleaner.operators.models import Step
from gleaner.operators.prompts import CONTEXT_TEMPLATE, fill

# Fixed values of the splitting rules.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
SEPARATORS = ("\n## ", "\n### ", "\n\n", "\n|", "\n", " ", "")
MIN_MERGED = 400
MIN_CONTENT = 30
CONTENTS_SHARE = 0.3
# Fixed value: how the header rule joins the blocks of a section in its compact form.
COMPACT_JOIN = "  \n"

_FENCE = r"(?m)^[ \t]*(?=```|~~~)"
# Stands in front of a '#' inside a code fence while the page is cut.
_MASK = "\ue000"


def is_contents_page(text: Column) -> Column:
    """More than 30 % of the non-blank lines hold dot leaders. Texts without any are not cut up."""
    filled = F.filter(F.transform(lines(text), strip), lambda s: s != "")
    dotted = F.filter(filled, lambda s: s.contains(". . .") | s.contains("..."))
    has_dots = text.contains(". . .") | text.contains("...")
    share = F.when(has_dots, F.size(dotted) / F.size(filled))
    return F.coalesce(share > CONTENTS_SHARE, F.lit(False))


def without_blank_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(~is_blank(F.col("text")))


def with_content(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Keeps chunks with at least 30 characters besides outer blanks."""
    return chunks.filter(F.length(strip(F.col(text))) >= MIN_CONTENT)


def _mask_fences(text: Column) -> Column:
    """Hides '#' at line starts between an opening and a closing code fence.

    A fence closes only with the mark that opened it, and a line that holds both ends opens nothing.
    """
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        mark = F.regexp_extract(piece, r"^(```|~~~)", 1)
        own_line = F.length(F.regexp_extract(piece, r"^(?:```[^\n]*```|~~~[^\n]*~~~)", 0)) > 0
        opened = F.when((acc["open"] == "") & ~own_line, mark).when(acc["open"] == mark, F.lit("")).otherwise(acc["open"])
        hidden = F.when(opened != "", F.regexp_replace(piece, r"(?m)^([ \t]*)#", f"$1{_MASK}#")).otherwise(piece)
        return F.struct(opened.alias("open"), F.concat(acc["out"], F.array(hidden)).alias("out"))

    return F.array_join(F.aggregate(F.split(text, _FENCE), start, step, lambda acc: acc["out"]), "")


def sections(text: Column, compact: bool = False) -> Column:
    """``array<struct<body, h1, h2, h3>>``: the page cut before each heading of level 1 to 3.

    Headings stay in the body. ``compact`` trims lines and joins blank-separated blocks with two
    blanks and a line break.
    """
    has_fence = text.rlike(_FENCE)
    masked = F.when(has_fence, _mask_fences(text)).otherwise(text)
    cut = F.split(masked, r"(?m)(?=^[ \t]*#{1,3}(?:[ \t]|$))")
    cut = F.filter(cut, lambda s: ~is_blank(s))

    def parsed(s: Column) -> Column:
        head = r"^[ \t]*(#{1,3})(?:[ \t]+([^\n]*))?(?:\n|$)"
        return F.struct(
            F.length(F.regexp_extract(s, head, 1)).alias("level"),
            strip(F.regexp_extract(s, head, 2)).alias("title"),
            F.replace(s, F.lit(_MASK), F.lit("")).alias("body"),
        )

    def body(s: Column) -> Column:
        if not compact:
            return F.regexp_replace(s, r"\n+$", "")
        trimmed = F.array_join(F.transform(F.split(s, "\n"), strip), "\n")
        return F.regexp_replace(F.regexp_replace(trimmed, r"^\n+|\n+$", ""), r"\n{2,}", COMPACT_JOIN)

    none = F.lit(None).cast("string")
    start = F.struct(
        F.array().cast("array<struct<body:string,h1:string,h2:string,h3:string>>").alias("out"),
        none.alias("h1"), none.alias("h2"), none.alias("h3"),
    )

    def step(acc: Column, s: Column) -> Column:
        level, title = s["level"], s["title"]
        h1 = F.when(level == 1, title).otherwise(acc["h1"])
        h2 = F.when(level == 2, title).when(level == 1, none).otherwise(acc["h2"])
        h3 = F.when(level == 3, title).when(level.isin(1, 2), none).otherwise(acc["h3"])
        entry = F.struct(
            body(s["body"]).alias("body"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3")
        )
        return F.struct(
            F.concat(acc["out"], F.array(entry)).alias("out"),
            h1.alias("h1"), h2.alias("h2"), h3.alias("h3"),
        )

    return F.aggregate(F.transform(cut, parsed), start, step, lambda acc: acc["out"])


def merge_small(parts: Column, min_size: int = MIN_MERGED) -> Column:
    """Joins short neighbours of one page with an empty line until ``min_size`` is reached.

    The first part's headings win. A short rest joins the part before it, or stands alone.
    ``parts`` is an ``array<struct<body, h1, h2, h3>>``.
    """
    shape = "struct<body:string,h1:string,h2:string,h3:string>"

    def joined(a: Column, b: Column) -> Column:
        return F.struct(
            F.concat(a["body"], F.lit("\n\n"), b["body"]).alias("body"),
            a["h1"].alias("h1"), a["h2"].alias("h2"), a["h3"].alias("h3"),
        )

    start = F.struct(F.array().cast(f"array<{shape}>").alias("out"), F.lit(None).cast(shape).alias("held"))

    def step(acc: Column, part: Column) -> Column:
        held = F.when(acc["held"].isNull(), part).otherwise(joined(acc["held"], part))
        size = F.length(part["body"]) + F.coalesce(F.length(acc["held"]["body"]) + 2, F.lit(0))
        full = size >= min_size
        return F.struct(
            F.when(full, F.concat(acc["out"], F.array(held))).otherwise(acc["out"]).alias("out"),
            F.when(~full, held).alias("held"),
        )

    def finish(acc: Column) -> Column:
        out, held = acc["out"], acc["held"]
        kept = F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))
        attached = F.concat(kept, F.array(joined(F.get(out, F.size(out) - 1), held)))
        return (
            F.when(held.isNull(), out).when(F.size(out) == 0, F.array(held)).otherwise(attached)
        )

    return F.aggregate(parts, start, step, finish)


def _cuts(text: str, lo: int, hi: int, sep: str):
    """Borders of the pieces of ``text[lo:hi]``; a separator opens the piece behind it."""
    if not sep:
        return range(lo, hi + 1)
    borders, at = [lo], text.find(sep, lo, hi)
    while at >= 0:
        if at > lo:
            borders.append(at)
        at = text.find(sep, at + len(sep), hi)
    return [*borders, hi]


def _packed(borders, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Longest runs of whole pieces up to ``size``; the next run starts with the longest tail of at
    most ``overlap`` that leaves room for the coming piece."""
    first = 0
    for i in range(len(borders) - 1):
        begin, end = borders[i], borders[i + 1]
        if end - borders[first] > size:
            yield borders[first], begin
            while first < i and (begin - borders[first] > overlap or end - borders[first] > size):
                first += 1
    if len(borders) > 1:
        yield borders[first], borders[-1]


def _spans(text: str, lo: int, hi: int, level: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    while SEPARATORS[level] and text.find(SEPARATORS[level], lo, hi) < 0:
        level += 1
    borders = _cuts(text, lo, hi, SEPARATORS[level])
    run = 0
    for i in range(len(borders) - 1):
        if borders[i + 1] - borders[i] >= size:
            yield from _packed(borders[run : i + 1], size, overlap)
            if SEPARATORS[level]:
                yield from _spans(text, borders[i], borders[i + 1], level + 1, size, overlap)
            else:
                yield borders[i], borders[i + 1]
            run = i + 1
    yield from _packed(borders[run:], size, overlap)


def split_one(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator present."""
    pieces = (text[a:b].strip() for a, b in _spans(text, 0, len(text), 0, size, overlap))
    return [p for p in pieces if p]


def size_split(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """``array<string>``; only texts above ``size`` are sent to Python, in Arrow batches."""

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        # Texts and pieces are Python strings for one slice of the batch at a time.
        found, batch = [], pa.RecordBatch.from_arrays([texts], names=["text"])
        for part in slices(batch, "text"):
            pieces = [None if t is None else split_one(t, size, overlap) for t in part.column("text").to_pylist()]
            found.append(pa.array(pieces, pa.list_(pa.string())))
        return pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.string()))

    whole = F.filter(F.array(strip(text)), lambda t: t != "")
    return F.coalesce(cut(F.when(F.length(text) > size, text)), whole)


def windows(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """``array<struct<start, text>>``: fixed character windows, the split without any separator."""
    starts = F.sequence(
        F.lit(1), F.greatest(F.lit(1), F.length(text) - overlap), F.lit(size - overlap)
    )
    return F.transform(
        starts, lambda s: F.struct(s.alias("start"), F.substring(text, s, F.lit(size)).alias("text"))
    )


def chunk_id(*parts: str) -> Column:
    """Content hash: the same chunk gets the same id in every run."""
    return F.sha2(F.concat_ws("\u0001", *[or_unknown(F.col(p)) for p in parts]), 256)


def breadcrumb(source: Column, *headings: Column) -> Column:
    """Model-free context line: source and heading path."""
    return F.concat_ws(" > ", source, *[F.when(h != "", h) for h in headings])


def context_line(reply: Column) -> Column:
    """First line of the stripped reply, or an empty string."""
    return strip(F.coalesce(F.get(lines(strip(reply)), F.lit(0)), F.lit("")))


def prefixed(context: Column, body: Column) -> Column:
    return F.when(context != "", F.concat(context, F.lit("\n\n"), body)).otherwise(body)


def rule_context(df: DataFrame) -> DataFrame:
    return df.withColumn("reply", breadcrumb(F.col("source"), F.col("h1"), F.col("h2"), F.col("h3")))


def contextualize(chunks: DataFrame, step: Step = rule_context, template: str = CONTEXT_TEMPLATE) -> DataFrame:
    """Adds ``context_line`` and ``text`` to ``chunks(source, page_text, body, …)``."""
    prompt = fill(template, source=F.coalesce("source", F.lit("document inconnu")),
                  page=F.col("page_text"), chunk=F.col("body"))
    answered = step(chunks.withColumn("prompt", prompt))
    if "reply_error" in answered.columns:
        # A page is stored whole or stays pending: one failed line holds all its chunks back. Neither page text nor
        # prompt, which repeats it, crosses the exchange.
        answered = answered.withColumn("_page", F.xxhash64("source", "page", "page_text")).drop("prompt", "page_text")
        page = Window.partitionBy("_page", "source", "page")
        failed = F.count("reply_error").over(page)
        answered = answered.withColumn("_failed", failed).filter("_failed = 0").drop("_failed", "_page", "reply_error")
    return (
        answered.withColumn("context_line", context_line(F.col("reply")))
        .withColumn("text", prefixed(F.col("context_line"), F.col("body")))
        .drop("prompt", "reply", "page_text")
    )


def split_pages(pages: DataFrame, step: Step = rule_context, compact: bool = False) -> DataFrame:
    """``pages(source, page, text)`` to chunks: contents pages and blank pages out, heading sections,
    merging, size split, minimum content, context line, id."""
    text = F.col("text")
    # Inside the row rather than as filters, which would compute a derived text once more.
    left_out = is_blank(text) | is_contents_page(text)
    parts = F.when(~left_out, merge_small(sections(text, compact)))
    merged = pages.select(
        "source", "page", text.alias("page_text"), F.posexplode(parts).alias("part_no", "part")
    )
    bodies = merged.select(
        "source", "page", "page_text", "part_no", "part.h1", "part.h2", "part.h3",
        F.posexplode(size_split(F.col("part.body"))).alias("piece_no", "body"),
    )
    chunks = contextualize(with_content(bodies, "body"), step)
    return chunks.withColumn("chunk_id", chunk_id("source", "page", "part_no", "piece_no", "body"))
