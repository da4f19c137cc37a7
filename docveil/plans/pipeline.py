"""Whole pipelines: masking of texts, and redaction of documents from files to outputs."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, functions as F

from docveil.functions import patterns
from docveil.functions.arrays import let
from docveil.functions.text import masked_word, output_path, stem
from docveil.operators import layout, markdown, redaction
from docveil.plans.lineage import checkpointed
from docveil.sinks import pdf_writer
from docveil.sources import listing, pdf

log = logging.getLogger("docveil")


def masked_texts(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, masked_text, n_masked, n_spans: words (cut at blanks) that a span of any pattern overlaps become blocks.

    One scan without shuffle; all in expressions. A match knows the numbers of its words,
    so that the text is cut into words once and every word is touched once. Null text
    stays null with counts of 0.
    """
    text = F.col("masking_text")
    rows = df.select(*keys, F.col(text_col).alias("masking_text"))
    # a generator keeps the optimizer from repeating the search wherever its result is used
    rows = rows.withColumn("masking_found", F.explode(F.array(patterns.all_matches(text))))
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform("masking_found", lambda m: F.sequence(m["word"], m["last_word"])))))

    def shown(x):
        """Each masked word behind the words since the one before it; then the rest."""
        words, at = x["words"], x["at"]

        def part(w, k):
            before = F.coalesce(F.get(at, k - 1), F.lit(-1))
            word = F.get(words, w)
            return F.array_join(F.concat(F.slice(words, before + 2, w - before - 1), F.array(F.when(word == "", word).otherwise(masked_word(word)))), " ")

        last = F.element_at(at, -1)
        rest = F.slice(words, last + 2, F.size(words) - last - 1)
        return F.struct(F.array_join(F.concat(F.transform(at, part), rest), " ").alias("text"), F.size(F.filter(at, lambda w: F.get(words, w) != "")).alias("n"))

    some = F.coalesce(F.size("masking_found"), F.lit(0)) > 0
    masking = F.when(some, let(F.struct(F.split(text, " ", -1).alias("words"), numbers.alias("at")), shown))
    rows = rows.withColumn("masking", F.explode(F.array(masking)))
    return rows.select(
        *keys, F.when(some, F.col("masking.text")).otherwise(text).alias("masked_text"), F.coalesce(F.col("masking.n"), F.lit(0)).cast("long").alias("n_masked"),
        F.when(some, F.size("masking_found")).otherwise(0).cast("long").alias("n_spans"),
    )


def redact_files(files: DataFrame, ner=None, faces=None, doc_col: str = "path") -> dict[str, DataFrame]:
    """The whole way of PDF files: letters, layout, finds, targets, and both outputs.

    `ner` is a function from paragraphs (doc, para_no, text) to spans, `faces` one from
    files to (doc, obj_id, has_face, error); both are optional. Gives DataFrames: letters,
    words, paragraphs, spans, targets, counts, pdf (doc, content, ...), markdown (doc,
    markdown), errors (doc, stage, error).

    A file that can't be read, or that shows no letter, has no outputs: what isn't read
    can't be redacted. A failing model leaves its finds out, as the patterns' are still
    there, and has a row in errors. Files are read once: letters and targets are written
    to the shared folder.
    """
    read = checkpointed(pdf.letters(files, doc_col))
    letters = read.where("error is null")
    words, paragraphs = layout.paragraphs(letters)
    words, paragraphs = checkpointed(words), checkpointed(paragraphs)
    keys = ["doc", "para_no"]
    spans = redaction.regex_spans(paragraphs, keys)
    errors = read.where("error is not null").select("doc", F.lit("read").alias("stage"), "error")
    found = spans.limit(0)
    if ner is not None:
        found = checkpointed(ner(paragraphs))
        if "error" in found.columns:
            errors = errors.unionByName(found.where("error is not null").select("doc", F.lit("ner").alias("stage"), "error"))
    targets = checkpointed(redaction.targets(words, found.where("start_pos is not null"), spans, keys))
    sources = layout.word_sources(letters)
    letters_of = targets.join(sources, ["doc", "page_no", "word_no"]).select("doc", "page_no", "bbox", "letters")
    shown = markdown.rendered(words, targets, ["doc", "page_no", "word_no"], keys, ["block_ord", "line_no", "pos"])
    names = files.select(F.col(doc_col).alias("doc"), stem(F.col(doc_col)).alias("name"))
    purged = None
    if faces is not None:
        marked = checkpointed(faces(files))
        purged = marked.where("has_face").select("doc", "obj_id") if "has_face" in marked.columns else marked
        if "error" in marked.columns:
            errors = errors.unionByName(marked.where("error is not null").select("doc", F.lit("faces").alias("stage"), "error"))
    unread = read.where("error is not null").select(F.col("doc").alias(doc_col))
    return {
        "letters": letters, "words": words, "paragraphs": paragraphs, "spans": spans, "targets": targets, "counts": redaction.counts(targets),
        "pdf": pdf_writer.redacted(files.join(unread, doc_col, "left_anti"), letters_of, purged, doc_col),
        "markdown": markdown.export(paragraphs.join(shown, keys, "left"), names), "errors": errors,
    }


def run(spark, paths: list[str], ner=None, faces=None) -> dict[str, int]:
    """Redacts the pending files of folders and single files; writes `<stem>.anon.pdf` and `<stem>.anon.md` beside each."""
    return write(listing.with_content(listing.pending(listing.listed(spark, paths))), ner, faces)


def write(todo: DataFrame, ner=None, faces=None) -> dict[str, int]:
    """Both outputs of the given files, with the number of errors of all stages; each error is logged.

    Markdown first: a file counts as done by its PDF.
    """
    out = redact_files(todo, ner, faces)
    texts = out["markdown"].select(F.regexp_replace(output_path(F.col("doc")), r"\.pdf$", ".md").alias("path"), F.col("markdown").alias("content"))
    pdfs = out["pdf"].select(F.col("doc"), output_path(F.col("doc")).alias("path"), "content", "error")
    shown, saved = pdf_writer.write_files(texts), pdf_writer.write_files(pdfs)
    failed = pdf_writer.failures(shown, "markdown").unionByName(pdf_writer.failures(saved, "pdf"))
    errors = checkpointed(out["errors"].unionByName(failed))
    for r in errors.toLocalIterator():
        log.warning("%s: %s: %s", r["doc"], r["stage"], r["error"])
    return {"markdown": pdf_writer.written_files(shown), "pdf": pdf_writer.written_files(saved), "errors": errors.count()}
