"""Column expressions on words, labels and names of files."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLOCK = "█"


def masked_word(word: Column) -> Column:
    """A block for each character, one at least; null stays null."""
    return F.when(word.isNotNull(), F.repeat(F.lit(BLOCK), F.greatest(F.char_length(word), F.lit(1))))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two half-open ranges share a character."""
    return F.greatest(a_start, b_start) < F.least(a_end, b_end)


def hit(start: Column, end: Column, spans: Column) -> Column:
    """Whether any span of an array overlaps the range; false without spans."""
    return F.coalesce(F.exists(spans, lambda s: overlaps(start, end, s["start_pos"], s["end_pos"])), F.lit(False))


def bio_tag(label: Column) -> Column:
    """The label without its B- or I- prefix."""
    return F.regexp_replace(label, "^[BI][-_]", "")


def output_path(path: Column) -> Column:
    """`<dir>/<stem>.anon.pdf` of a file."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(".anon.pdf"))


def stem(path: Column) -> Column:
    """The name of a file without folders and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
