"""Pieces of Markdown text, row by row: every function reads whole texts and shuffles nothing.

Cutting a text costs more than moving it, so a scan that comes in few tasks is better
dealt over the cores first (``sources.tables.spread``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.text import let, strip

# Named sections of an analysis text.
NAMED_SECTIONS = (
    ("summary", ("## Executive Summary", "## Summary", "# Executive Summary")),
    ("recommendations", ("## Recommendations", "## Recommendation", "# Recommendations")),
    ("insights", ("## Insights", "## Key Insights", "# Key Insights")),
)
# Fixed value: the length a sentence must exceed.
FALLBACK_LENGTH = 30


def text_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Headings (lines that start with #) and the text under each; a repeated heading keeps its last text."""
    # The text is cut in front of every heading line; the first piece is what comes before any.
    chunks = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n(?=#)")
    pieces = F.transform(
        F.slice(chunks, F.lit(2), F.greatest(F.size(chunks) - 1, F.lit(0))),
        lambda piece, i: F.struct(
            strip(F.regexp_replace(F.regexp_extract(piece, r"^([^\n]*)", 1), "^#*", "")).alias("heading"),
            strip(F.regexp_replace(piece, r"^[^\n]*", "")).alias("body"),
            F.contains(piece, F.lit("\n")).alias("closed"),
            i.alias("position"),
        ),
    )
    kept = F.filter(
        pieces,
        lambda p: (p.getField("heading") != "") & (p.getField("closed") | (p.getField("position") < F.size(chunks) - 2)),
    )
    # In order of heading and then from the last, the first of equal headings is the one that stays.
    ordered = F.array_sort(F.transform(kept, lambda p: F.struct(p.getField("heading").alias("heading"), (-p.getField("position")).alias("back"), p.getField("body").alias("body"))))
    fresh = lambda all_: F.filter(all_, lambda p, i: (i == 0) | (F.get(all_, i - 1).getField("heading") != p.getField("heading")))
    return docs.select(key, F.inline(let(ordered, fresh))).select(key, "heading", "body")


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), strip)


def text_list_items(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Numbered, bulleted and other plain lines, without their markers."""

    def item(line: Column) -> Column:
        unnumbered = F.regexp_replace(line, r"^[0-9]+\.\s+(?=.)", "")
        bullet = line.startswith("- ") | line.startswith("* ") | line.startswith("• ")
        return F.when(bullet, F.substr(line, F.lit(3))).when((line != "") & ~line.startswith("#"), unnumbered)

    items = F.array_compact(F.transform(_lines(F.col(text)), item))
    return docs.select(F.col(key), F.posexplode(items).alias("position", "item"))


def text_tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Cells of pipe-delimited lines; separator lines and tables under two rows are dropped."""
    rows = F.filter(_lines(F.col(text)), lambda line: F.contains(line, F.lit("|")) & ~line.startswith("|---"))

    def cells(line: Column) -> Column:
        inner = let(F.split(line, r"\|"), lambda all_: F.slice(all_, F.lit(2), F.greatest(F.size(all_) - 2, F.lit(0))))
        return F.transform(inner, strip)

    filled = F.filter(F.transform(rows, cells), lambda row: F.exists(row, lambda cell: cell != ""))
    tables = docs.select(F.col(key), filled.alias("_rows")).where(F.size("_rows") >= 2)
    return tables.select(key, F.posexplode("_rows").alias("row", "cells"))


def text_summary(docs: DataFrame, key: str, text: str, first: int | None = None) -> DataFrame:
    """The first paragraph that is not a heading, and the long sentences; ``first`` looks at that many sentences only."""
    paragraphs = F.filter(F.split(F.col(text), "\n\n"), lambda p: (strip(p) != "") & ~p.startswith("#"))
    return docs.select(
        F.col(key),
        strip(F.get(paragraphs, F.lit(0))).alias("summary"),
        _long_sentences(F.col(text), first).alias("sentences"),
    )


def _long_sentences(text: Column, first: int | None = None) -> Column:
    sentences = F.split(text, r"[.!?]\s+")
    if first is not None:
        sentences = F.slice(sentences, 1, first)
    long = F.filter(sentences, lambda s: (F.length(s) > FALLBACK_LENGTH) & ~s.startswith("#"))
    return F.transform(long, lambda s: F.concat(strip(s), F.lit(".")))


def named_sections(docs: DataFrame, key: str, text: str, fallback: bool = False) -> DataFrame:
    """Summary paragraphs, insights and recommendations of an analysis text, each numbered in order.

    With ``fallback`` a text without a summary is summed up by its long sentences.
    """
    marks = "|".join(h for _, headings in NAMED_SECTIONS for h in headings if not h.startswith("##"))
    # The text is cut in front of every heading line, so nothing is carried from line to line.
    # The first lookahead passes over lines without a # at once.
    chunks = F.transform(
        F.split(F.col(text), rf"(?dm)^(?=[^#\n]*+#)(?=[^\n]*(?:##|{marks}))"),
        lambda chunk: F.struct(
            _section_of(F.regexp_extract(chunk, r"^([^\n]*)", 1)).alias("section"),
            _lines(F.regexp_replace(chunk, r"^[^\n]*", "")).alias("lines"),
        ),
    )
    cut = docs.select(F.col(key), F.col(text).alias("_text"), chunks.alias("_chunks"))

    def entries(name: str) -> Column:
        found = _contents(F.col("_chunks"), name)
        if fallback and name == "summary":
            return let(found, lambda own: F.when(F.size(own) > 0, own).otherwise(_long_sentences(F.col("_text"))))
        return found

    contents = F.array(*[F.struct(F.lit(name).alias("section"), entries(name).alias("_contents")) for name, _ in NAMED_SECTIONS])
    listed = cut.select(key, F.inline(contents))
    return listed.select(key, "section", F.posexplode("_contents").alias("position", "content")).withColumn(
        "position", F.col("position") + 1
    )


def _section_of(heading: Column) -> Column:
    section = None
    for name, headings in NAMED_SECTIONS:
        hit = F.rlike(heading, F.lit("|".join(headings)))
        section = F.when(hit, name) if section is None else section.when(hit, name)
    return section


def _contents(chunks: Column, section: str) -> Column:
    """The entries of one section: plain lines of the summary, list items of the others."""
    numbered = lambda line: F.rlike(line, F.lit(r"^[0-9]+\.\s+\*\*"))
    bullet = lambda line: line.startswith("- ") | line.startswith("* ") | line.startswith("• ")

    def entry(line: Column) -> Column:
        if section == "summary":
            return F.when((line != "") & ~numbered(line) & ~bullet(line) & ~line.startswith("#"), line)
        unmarked = F.regexp_replace(line, r"\*\*([^*]+)\*\*:\s*", "$1: ")
        return F.when(numbered(line), F.regexp_replace(unmarked, r"^[0-9]+\.\s+", "")).when(
            bullet(line), strip(F.substr(line, F.lit(3)))
        )

    mine = F.filter(chunks, lambda chunk: chunk.getField("section") == section)
    return F.flatten(F.transform(mine, lambda chunk: F.array_compact(F.transform(chunk.getField("lines"), entry))))
