"""From spans to redacted words: overlap, removal of duplicates, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docveil.functions import patterns
from docveil.functions.text import overlaps

#: What makes a word the same in the removal of duplicates: its page, its place and its text.
IDENTITY = ["doc", "page_no", "bbox", "text"]


def regex_spans(paragraphs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, start_pos, end_pos, label, engine of every match of the five patterns. Null and blank texts have none."""
    return paragraphs.select(*keys, F.explode(patterns.all_spans(F.col(text_col))).alias("s")).select(*keys, "s.*")


def covered_words(words: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """The words that a span of the same paragraph overlaps, by any character; each word row once.

    The join is on the paragraph, so that both sides are spread by it; a paragraph has few
    spans, and the left-semi form lets a word end its search at the first. Words without a
    range or paragraph are never covered.
    """
    w, s = words.alias("w"), spans.select(*keys, "start_pos", "end_pos").alias("s")
    same = [F.col(f"w.{k}") == F.col(f"s.{k}") for k in keys]
    return w.join(s, [*same, overlaps(F.col("w.start_pos"), F.col("w.end_pos"), F.col("s.start_pos"), F.col("s.end_pos"))], "left_semi")


def targets(words: DataFrame, ner_spans: DataFrame, regex: DataFrame, keys: list[str]) -> DataFrame:
    """Words to redact with the engine that is credited: all that ner finds, and those of regex that ner has not.

    Words of ner keep their duplicates; a word of regex is added once, and only if no word
    of ner has the same page, place and text.
    """
    ner = covered_words(words, ner_spans, keys).withColumn("engine", F.lit("ner"))
    own = covered_words(words, regex, keys).dropDuplicates(IDENTITY)
    new = own.alias("r").join(ner.select(*IDENTITY).distinct().alias("n"), [F.col(f"r.{c}").eqNullSafe(F.col(f"n.{c}")) for c in IDENTITY], "left_anti")
    return ner.unionByName(new.withColumn("engine", F.lit("regex")))


def counts(found: DataFrame) -> DataFrame:
    """Redacted words by document and engine."""
    return found.groupBy("doc", "engine").agg(F.count("*").alias("n_words"))
