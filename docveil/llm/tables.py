"""Preparation that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docveil.plans.lineage import checkpointed  # noqa: F401  (queries take it from here)


def latest(df: DataFrame, keys: list[str], columns: list[str], order: str = "loaded_at") -> DataFrame:
    """One row a key: the one loaded last, ties by the greatest values. Rows with a null key are dropped."""
    held = [c for c in dict.fromkeys([order, *columns]) if c not in keys]
    picked = df.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.max(F.struct(*held)).alias("last_row"))
    return picked.select(*keys, *[F.col(f"last_row.{c}").alias(c) for c in columns])


# Scripts that tell a language, and frequent words of those written in Latin letters.
SCRIPTS = [("ja", r"[\x{3041}-\x{30FF}]", 1), ("zh", r"[\x{4E00}-\x{9FFF}]", 2), ("ru", r"[\x{400}-\x{4FF}]", 2), ("el", r"[\x{370}-\x{3FF}]", 2), ("hi", r"[\x{900}-\x{97F}]", 1), ("ar", r"[\x{600}-\x{6FF}]", 1), ("th", r"[\x{E00}-\x{E7F}]", 1)]
FREQUENT = {
    "fr": "le|la|les|du|de|des|et|est|une|un|en|au|pour|dans|sur|avec|par",
    "en": "the|of|and|to|in|is|a|for|from|was|after|before|on|at|with",
    "de": "der|die|das|und|ist|den|im|ein|eine|für|mit|auf|von|nach|zu",
    "es": "el|la|los|las|y|en|es|una|un|del|por|para|con|al|que|se",
}


def guessed_lang(text) -> F.Column:
    """The language that a text without one looks to be in: by script if a tenth of it is in that script, else by frequent words; null if neither tells."""
    size = F.char_length(text)
    out = F.lit(None).cast("string")
    counts = {lang: F.regexp_count(F.lower(text), F.lit(rf"(?<![\p{{L}}])(?:{words})(?![\p{{L}}])")) for lang, words in FREQUENT.items()}
    best = F.greatest(*counts.values())
    for lang, n in counts.items():
        out = F.when((n == best) & (best > 0), F.lit(lang)).otherwise(out)
    for lang, pattern, weight in reversed(SCRIPTS):
        out = F.when(F.regexp_count(text, F.lit(pattern)) * weight * 5 > size, F.lit(lang)).otherwise(out)
    return out


def paragraphs_with_lang(paragraphs: DataFrame, *more: str) -> DataFrame:
    """The last row of each paragraph: doc, para_no, text, lang in lower case, guessed where it is null, and further columns."""
    out = latest(paragraphs, ["doc", "para_no"], ["text", "lang", *more])
    return out.withColumn("lang", F.coalesce(F.lower("lang"), guessed_lang(F.col("text"))))


def in_paragraphs(words: DataFrame) -> DataFrame:
    """doc, page_no, word_no, para_no, text of the words that stand in a paragraph; exact duplicates are still there."""
    return words.where("para_no is not null and doc is not null").select("doc", "page_no", "word_no", "para_no", "text")


def with_lang(words: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """words with the language of their paragraph (`paragraphs` as paragraphs_with_lang() gives them).

    The paragraphs' side is hashed, part by part, so that the many words need no sorting.
    """
    return words.join(paragraphs.select("doc", "para_no", "lang").hint("shuffle_hash"), ["doc", "para_no"], "left")


def main_lang(paragraphs: DataFrame) -> DataFrame:
    """doc and lang: the language that most paragraphs of the document are in; of equally many the last by name."""
    counts = paragraphs.where("lang is not null").groupBy("doc", "lang").agg(F.count("*").alias("n"))
    return counts.groupBy("doc").agg(F.max(F.struct("n", "lang")).alias("m")).select("doc", "m.lang")


def words_of(paragraphs: DataFrame) -> DataFrame:
    """source (the document), lang and text of every word of the paragraphs, which are their words joined by U+0020."""
    return paragraphs.select(F.col("doc").alias("source"), "lang", F.explode(F.split("text", " ")).alias("text"))


def strange_words_of(paragraphs: DataFrame, strange) -> DataFrame:
    """doc, para_no, source, lang, text of the distinct words of each paragraph for which strange(text) holds."""
    own = F.filter(F.array_distinct(F.split("text", " ")), strange)
    return paragraphs.where(strange(F.col("text"))).select("doc", "para_no", F.col("doc").alias("source"), "lang", F.explode(own).alias("text"))


def with_repairs(paragraphs: DataFrame, wrong: DataFrame) -> DataFrame:
    """paragraphs with `repairs`: text, restored and chain of its distinct wrong words that could be restored; null without any.

    A paragraph's words are bounded by its text, so the collected list is too.
    """
    own = wrong.where("restored is not null").groupBy("doc", "para_no").agg(F.collect_list(F.struct("text", "restored", "chain")).alias("repairs"))
    return paragraphs.join(own, ["doc", "para_no"], "left")
