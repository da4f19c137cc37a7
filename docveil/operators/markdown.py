"""Masked Markdown of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from docveil.functions.text import masked_word

# The texts of the export's head.
TITLE_MARK = " (anonymisé)"
NOTICE = "_Export généré automatiquement à partir du pipeline d'anonymisation. Les zones identifiées comme données personnelles ont été masquées (█)._"


def rendered(words: DataFrame, masked: DataFrame, word_key: list[str], paragraph: list[str], order: list[str]) -> DataFrame:
    """paragraph keys and their words in order, joined by a blank, masked ones as blocks; one row a paragraph.

    `masked` has the keys of redacted words. Only the words of one paragraph are gathered.
    """
    marks = masked.select(*word_key).distinct().withColumn("is_masked", F.lit(True))
    rows = words.join(marks, word_key, "left")
    shown = F.when(F.col("is_masked"), masked_word(F.col("text"))).otherwise(F.coalesce("text", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct(*order, shown.alias("shown"))))
    text = F.array_join(F.transform(parts, lambda p: p["shown"]), " ")
    return rows.groupBy(*paragraph).agg(F.trim(text).alias("rendered"), F.count("is_masked").alias("n_masked"))


def page_marks(paragraphs: DataFrame) -> DataFrame:
    """paragraphs (doc, para_no, page_no) with `mark`: the text that a change of page puts before a paragraph."""
    w = W.partitionBy("doc").orderBy("para_no")
    # a page that is not known neither marks nor counts as a change
    before = F.last("page_no", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    page = F.concat(F.lit("*Page "), F.col("page_no").cast("string"), F.lit("*\n\n"))
    mark = F.when(F.col("page_no").isNull(), "").when(before.isNull(), page).when(before != F.col("page_no"), F.concat(F.lit("\n---\n\n"), page)).otherwise("")
    return paragraphs.withColumn("mark", mark)


def export(paragraphs: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """doc and markdown of every document from (doc, para_no, page_no, is_heading, rendered).

    Blank paragraphs leave only their page mark. `names` gives (doc, name); without it the
    document's key is its name. The paragraphs of one document make one row, as the format
    is one file a document.
    """
    body = F.when(F.trim(F.coalesce("rendered", F.lit(""))) == "", F.lit("")).otherwise(F.concat(F.when(F.col("is_heading"), "## ").otherwise(""), F.trim("rendered"), F.lit("\n\n")))
    rows = page_marks(paragraphs).withColumn("piece", F.concat("mark", body))
    docs = rows.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_no", "piece"))), lambda x: x["piece"]), "").alias("body"))
    docs = docs.join(names.select("doc", "name"), "doc", "left") if names is not None else docs.withColumn("name", F.col("doc"))
    head = F.concat(F.lit("# "), F.coalesce("name", "doc"), F.lit(TITLE_MARK + "\n\n" + NOTICE + "\n\n---\n\n"))
    return docs.select("doc", F.concat(head, "body").alias("markdown"))
