"""Named queries over the test tables and their SQL equivalents.

Every query runs over its whole tables. Queries whose semantics SQL can't express have no
entry in ORACLE; they are tested against brute force or goldens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docveil.functions import patterns
from docveil.functions.text import bio_tag, hit, masked_word, output_path, stem
from docveil.operators import layout, markdown, ner, redaction
from docveil.plans import made_files, pipeline
from docveil.sources import listing

PARA = ["doc", "para_no"]
WORD = ["doc", "page_no", "word_no"]
# Label names of older finds that mean the same.
SAME_LABEL = {"PER": "PER", "PERSON": "PER", "NOM_PERSONNE": "PER", "TEL": "PHONE", "PHONE": "PHONE", "EMAIL": "EMAIL", "LOC": "LOC", "ADR": "LOC", "ID_NUM": "MISC", "MISC": "MISC", "URL": "URL", "DATE": "DATE", "ORG": "ORG"}


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan for costly expressions: one of fewer partitions than cores is dealt over them; larger ones stay without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def words_of(spark, d) -> DataFrame:
    return table(spark, d, "words").dropDuplicates(WORD)


def paragraphs_of(spark, d) -> DataFrame:
    """Of each paragraph the row loaded last; ties by the greatest values."""
    held = ["loaded_at", "text", "is_heading", "page_no", "lang", "detector_id"]
    last = table(spark, d, "paragraphs").where("doc is not null and para_no is not null").groupBy(*PARA).agg(F.max(F.struct(*held)).alias("last"))
    return last.select(*PARA, *[f"last.{c}" for c in held])


def spans_of(spark, d) -> DataFrame:
    return table(spark, d, "spans").dropDuplicates(["span_id"])


# Texts made of whole relational tables, in which every detector has matches.
def mails(spark, d):
    c = table(spark, d, "customer")
    text = F.concat(F.lit("# Jean "), F.col("c_mktsegment"), F.lit(" wrote to "), F.regexp_replace(F.lower("c_name"), "#", "."), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example, not to "), F.col("c_name"), F.lit("@x; see http://www."), F.lower("c_mktsegment"), F.lit(".fr/a?b="), F.col("c_custkey").cast("string"))
    return c.select("c_custkey", text.alias("text"))


MAILS = """(SELECT c_custkey, '# Jean ' || c_mktsegment || ' wrote to ' || replace(lower(c_name), '#', '.') || '@' || lower(c_mktsegment) || '.example, not to ' || c_name || '@x; see http://www.'
    || lower(c_mktsegment) || '.fr/a?b=' || CAST(c_custkey AS VARCHAR) AS text FROM customer)"""


def calls(spark, d):
    o = table(spark, d, "orders")
    k = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    text = F.concat(F.lit("ordered "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" or "), F.date_format("o_orderdate", "d-MM-yyyy"), F.lit(", call +33 6 "), F.substring(k, 1, 2), F.lit("."), F.substring(k, 3, 2), F.lit("-"), F.substring(k, 5, 2), F.lit(" "), F.substring(k, 7, 2), F.lit(" or 12 34, ref 01"), k, F.lit("x"))
    return o.select("o_orderkey", text.alias("text"))


CALLS = """(SELECT o_orderkey, 'ordered ' || strftime(o_orderdate, '%d/%m/%Y') || ' or ' || strftime(o_orderdate, '%-d-%m-%Y') || ', call +33 6 ' || k[1:2] || '.' || k[3:4] || '-' || k[5:6] || ' ' || k[7:8] || ' or 12 34, ref 01' || k || 'x' AS text
    FROM (SELECT *, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS k FROM orders))"""


def spans_sql(source: str, key: str, pattern: str, flags: str = "", lead: str = "") -> str:
    """SQL that gives the spans of a pattern by the lengths of matches and of the gaps between them."""
    p = pattern.replace("'", "''")
    opt = f", '{flags}'" if flags else ""
    split_p = f"(?{flags}){p}" if flags else p
    strip = "" if not lead else f" + length(regexp_extract(m[i], '{lead}'))"
    return f"""
        SELECT {key}, CAST(len_g + len_m{strip} AS INT) AS start_pos, CAST(len_g + len_m + length(m[i]) AS INT) AS end_pos
        FROM (SELECT {key}, m, i, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) AS BIGINT) AS len_g,
                     CAST(coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS len_m
              FROM (SELECT {key}, m, g, unnest(range(1, len(m) + 1)) AS i
                    FROM (SELECT {key}, regexp_extract_all(text, '{p}', 0{opt}) AS m, regexp_split_to_array(text, '{split_p}') AS g FROM {source})))
    """


def _spans(df: DataFrame, key: str, label: str) -> DataFrame:
    return df.select(key, F.explode(patterns.spans_of(F.col("text"), label)).alias("s")).select(key, "s.start_pos", "s.end_pos")


def email_spans(spark, d):
    return _spans(mails(spark, d), "c_custkey", "EMAIL")


def url_spans(spark, d):
    return _spans(mails(spark, d), "c_custkey", "URL")


def person_spans(spark, d):
    return _spans(mails(spark, d), "c_custkey", "NOM_PERSONNE")


def phone_spans(spark, d):
    return _spans(calls(spark, d), "o_orderkey", "PHONE")


def date_spans(spark, d):
    return _spans(calls(spark, d), "o_orderkey", "DATE")


def all_spans(spark, d):
    return redaction.regex_spans(mails(spark, d), ["c_custkey"]).select("c_custkey", "start_pos", "end_pos", "label", "engine")


def paragraph_spans(spark, d):
    return redaction.regex_spans(paragraphs_of(spark, d), PARA)


def spans_by_lang(spark, d):
    p = paragraphs_of(spark, d).select(*PARA, F.lower("lang").alias("lang"))
    rows = spans_of(spark, d).join(p, PARA)
    return rows.groupBy("lang", "engine").agg(F.count("*").alias("n_spans"), F.countDistinct("doc").alias("n_docs"))


def masked_documents(spark, d):
    """The flagship: words of every document that a detector's span overlaps, as blocks."""
    return pipeline.masked_texts(spread(table(spark, d, "documents").select("doc_id", "text")), ["doc_id"])


def _ascii(text):
    """Characters beyond ASCII as a letter: SQL's expressions know word boundaries in ASCII alone."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "x")


def masked_ascii_documents(spark, d):
    return pipeline.masked_texts(spread(table(spark, d, "documents").select("doc_id", _ascii(F.col("text")).alias("text"))), ["doc_id"])


def ascii_paragraph_spans(spark, d):
    return redaction.regex_spans(paragraphs_of(spark, d).select(*PARA, _ascii(F.col("text")).alias("text")), PARA)


def masked_orders(spark, d):
    return pipeline.masked_texts(calls(spark, d), ["o_orderkey"])


def word_targets(spark, d):
    found = redaction.covered_words(words_of(spark, d), spans_of(spark, d), PARA)
    return found.select(*WORD, "text")


def redaction_targets(spark, d):
    s = spans_of(spark, d)
    return redaction.targets(words_of(spark, d), s.where("engine = 'ner'"), s.where("engine = 'regex'"), PARA).select(*WORD, "text", "engine")


def redaction_counts(spark, d):
    s = spans_of(spark, d)
    return redaction.counts(redaction.targets(words_of(spark, d), s.where("engine = 'ner'"), s.where("engine = 'regex'"), PARA))


def first_pass_words(spark, d):
    w = layout.first_words(layout.first_pass(table(spark, d, "letters")))
    return w.select("doc", "page_no", F.col("word1").cast("long").alias("word1"), "text", "font_size", "baseline_y", F.col("bbox.x").alias("x"))


def second_pass_words(spark, d):
    w = layout.second_pass(table(spark, d, "letters"))
    return w.select(*WORD, "text", "font_size", "baseline_y", F.col("bbox.x").alias("x"), F.col("bbox.y").alias("y"), F.round("bbox.width", 6).alias("width"), F.round("bbox.height", 6).alias("height"))


def global_font(spark, d):
    return layout.global_font(table(spark, d, "letters")).select("doc", F.round("mean_font", 6).alias("mean_font"))


def greedy_blocks(spark, d):
    w = words_of(spark, d)
    return layout.blocks(w.select(*WORD, "text", "bbox", "font_size", "baseline_y")).select(*WORD, "block_no", "line_no", "pos")


def layout_paragraphs(spark, d):
    return layout.paragraphs(table(spark, d, "letters"))[1]


def layout_words(spark, d):
    return layout.paragraphs(table(spark, d, "letters"))[0].select(*WORD, "para_no", "start_pos", "end_pos", "text")


def word_ranges(spark, d):
    w = words_of(spark, d).where("para_no is not null").drop("start_pos", "end_pos")
    return layout.ranges(w, PARA, ["page_no", "word_no"]).select(*WORD, "start_pos", "end_pos")


def paragraph_texts(spark, d):
    w = words_of(spark, d).where("para_no is not null")
    parts = F.array_sort(F.collect_list(F.struct("page_no", "word_no", "text")))
    return w.groupBy(*PARA).agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def paragraph_segmentation(spark, d):
    p = paragraphs_of(spark, d).select("doc", F.col("para_no").alias("block_ord"), "text", "is_heading")
    return layout.segmented(p).select("doc", "block_ord", "para_no")


def heading_blocks(spark, d):
    w = words_of(spark, d).where("para_no is not null")
    mean = w.groupBy("doc").agg(F.avg("font_size").alias("mean_font"))
    own = w.groupBy(*PARA).agg(F.avg("font_size").alias("font"))
    return own.join(mean, "doc").select(*PARA, (F.col("font") > F.col("mean_font") * layout.HEADING).alias("heading"))


def page_breaks(spark, d):
    return markdown.page_marks(paragraphs_of(spark, d).select(*PARA, "page_no")).select(*PARA, "mark")


def markdown_export(spark, d):
    words = words_of(spark, d).where("para_no is not null")
    found = redaction.covered_words(words, spans_of(spark, d), PARA)
    shown = markdown.rendered(words, found, WORD, PARA, ["page_no", "word_no"])
    p = paragraphs_of(spark, d).select(*PARA, "page_no", "is_heading")
    return markdown.export(p.join(shown, PARA, "left"))


def pending_files(spark, d):
    return listing.pending(table(spark, d, "files").select("path").distinct())


def output_paths(spark, d):
    return table(spark, d, "files").where("path is not null").select("path").distinct().select("path", output_path(F.col("path")).alias("output"), stem(F.col("path")).alias("name"))


def pdf_plain_letters(spark, d):
    return made_files.plain_letters(words_of(spark, d))


def pdf_matrix_letters(spark, d):
    return made_files.matrix_letters(words_of(spark, d))


def pdf_spaced_letters(spark, d):
    return made_files.spaced_letters(words_of(spark, d))


def pdf_composite_letters(spark, d):
    return made_files.composite_letters(words_of(spark, d))


def pdf_redacted_letters(spark, d):
    return made_files.redacted_letters(words_of(spark, d))


def pdf_redaction_boxes(spark, d):
    return made_files.redaction_boxes(words_of(spark, d))


def pdf_face_marks(spark, d):
    return made_files.face_marks(spread(table(spark, d, "customer").select("c_custkey")))


def pdf_purged_images(spark, d):
    return made_files.purged_images(spread(table(spark, d, "customer").select("c_custkey")))


def ner_entities(spark, d):
    return made_files.entities(mails(spark, d), ["c_custkey"])


def ner_windows(spark, d):
    return made_files.long_entities(spread(mails(spark, d)), ["c_custkey"])


def decoder_glyphs(spark, d):
    f = table(spark, d, "font_decoders").dropDuplicates(["doc", "font_no"])
    g = f.select("doc", "font_no", "code_to_width", "default_width", F.explode("code_to_char").alias("code", "value"))
    return g.where("value is not null").select("doc", "font_no", "code", "value", F.coalesce(F.expr("try_element_at(code_to_width, code)"), "default_width").alias("width"))


def decoded_letters(spark, d):
    """Letters with the width that their font gives their size: the advance that the content stream would make."""
    letters = table(spark, d, "letters").dropDuplicates(["doc", "page_no", "seq"])
    fonts = table(spark, d, "font_decoders").dropDuplicates(["doc", "font_no"]).select("doc", "font_no", "default_width", "height_ratio", "y_offset_ratio")
    rows = letters.join(fonts, ["doc", "font_no"])
    return rows.groupBy("doc", "font_no").agg(
        F.count("*").alias("n_letters"), F.round(F.sum(F.col("font_size") * F.col("height_ratio")), 4).alias("ink_height"), F.round(F.min(F.col("baseline_y") + F.col("font_size") * F.col("y_offset_ratio")), 4).alias("lowest")
    )


def softmax_argmax(spark, d):
    """The classifier's own choice and confidence, each vector being the logits of a token."""

    def run(batches):
        for batch in batches:
            rows = [ner.predictions(np.asarray([x], np.float32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(c[0]) for c, _ in rows], pa.int32()), pa.array([float(p[0]) for _, p in rows], pa.float64())], names=["vec_id", "class", "confidence"])

    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return e.mapInArrow(run, "vec_id long, class int, confidence double").withColumn("confidence", F.round("confidence", 5))


def bio_split(spark, d):
    """Prefix and tag of labels as the decoder takes them."""

    def run(batches):
        for batch in batches:
            parts = [ner.bio(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in parts], pa.string()), pa.array([t for _, t in parts], pa.string())], names=["span_id", "prefix", "tag"])

    return spans_of(spark, d).where("label is not null").select("span_id", "label").mapInArrow(run, "span_id long, prefix string, tag string")


def trimmed_spans(spark, d):
    """Spans as the decoder trims them."""

    def run(batches):
        for batch in batches:
            ends = [ner.trimmed(*r) for r in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in ends], pa.int32()), pa.array([b for _, b in ends], pa.int32())], names=["span_id", "start_pos", "end_pos"])

    rows = spans_of(spark, d).where("start_pos is not null and end_pos is not null and start_pos < end_pos").join(paragraphs_of(spark, d).select(*PARA, "text"), PARA)
    return rows.where(F.col("start_pos") < F.char_length("text")).select("span_id", "text", "start_pos", "end_pos").mapInArrow(run, "span_id long, start_pos int, end_pos int")


def merged_spans(spark, d):
    kind = F.create_map(*[F.lit(x) for kv in SAME_LABEL.items() for x in kv])
    s = spans_of(spark, d).where("engine = 'ner' and label is not null and start_pos is not null and end_pos is not null")
    s = s.withColumn("label", F.coalesce(kind[F.upper(bio_tag(F.col("label")))], F.col("label")))
    out = ner.merge_adjacent(s, paragraphs_of(spark, d), PARA)
    return out.select(*PARA, "start_pos", "end_pos", "label", F.round("score", 4).alias("score"), "n_parts")


def covered_ranges(spark, d):
    """words with an array of their paragraph's spans, tested without a join of words and spans by range."""
    own = spans_of(spark, d).groupBy(*PARA).agg(F.collect_list(F.struct("start_pos", "end_pos")).alias("spans"))
    w = words_of(spark, d).where("para_no is not null").join(own, PARA, "left")
    return w.groupBy("doc").agg(F.count("*").alias("n_words"), F.sum(hit(F.col("start_pos"), F.col("end_pos"), F.col("spans")).cast("int")).alias("n_hit"))


def masked_words(spark, d):
    return words_of(spark, d).select(*WORD, masked_word(F.col("text")).alias("masked"))


QUERIES = {
    f.__name__: f
    for f in (
        email_spans, phone_spans, date_spans, url_spans, person_spans, all_spans, paragraph_spans, ascii_paragraph_spans, spans_by_lang, masked_documents, masked_ascii_documents, masked_orders, word_targets, redaction_targets,
        redaction_counts, covered_ranges, masked_words, first_pass_words, second_pass_words, global_font, greedy_blocks, layout_paragraphs, layout_words, word_ranges, paragraph_texts,
        paragraph_segmentation, heading_blocks, page_breaks, markdown_export, pending_files, output_paths, pdf_plain_letters, pdf_matrix_letters, pdf_spaced_letters, pdf_composite_letters, pdf_redacted_letters,
        pdf_redaction_boxes, pdf_face_marks, pdf_purged_images, ner_entities, ner_windows, decoder_glyphs, decoded_letters, softmax_argmax, bio_split,
        trimmed_spans, merged_spans,
    )
}

_NAME = "(?m)^(?:#+\\s*)?[A-Z][a-z]+(?:[-''][A-Z][a-z]+)?[ \\t]+(?:[A-Z]{3,}(?:[-''][A-Z]{2,})*|(?:[A-Z][ \\t]+){2,}[A-Z])\\b"
_PHONE = r"(?:(?:\+|00)33|0)\s*[1-9](?:[\s.-]*\d+)+\b"
_DATE = r"\b\d{2}[/-]\d{2}[/-]\d{4}\b"
_URL = r"(?:(?:https?:)?//)?(?:www\.)?[-a-zA-Z0-9@:%._+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b[-a-zA-Z0-9()@:%_+.~#?&/=]*"
_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
_WORDS = "(SELECT DISTINCT ON (doc, page_no, word_no) * FROM words)"
_PARAS = "(SELECT DISTINCT ON (doc, para_no) * FROM paragraphs ORDER BY doc, para_no, loaded_at DESC NULLS LAST, text DESC NULLS LAST, is_heading DESC NULLS LAST, page_no DESC NULLS LAST, lang DESC NULLS LAST, detector_id DESC NULLS LAST)"
_SPANS = "(SELECT DISTINCT ON (span_id) * FROM spans)"
_COVERED = "EXISTS (SELECT 1 FROM {s} s WHERE s.doc = w.doc AND s.para_no = w.para_no AND greatest(s.start_pos, w.start_pos) < least(s.end_pos, w.end_pos){more})"
_VISIBLE = r"(SELECT DISTINCT ON (doc, page_no, seq) * FROM letters WHERE value IS NOT NULL AND NOT regexp_full_match(value, '[\s\x{85}\p{Z}]*'))"


def _new(order: str) -> str:
    w = f"(PARTITION BY doc, page_no ORDER BY {order})"
    return f"""CASE WHEN abs(baseline_y - lag(baseline_y) OVER {w}) < lag(font_size) OVER {w} * 0.2
        AND bbox.x - lag(bbox.x + bbox.width) OVER {w} >= -2.0 AND bbox.x - lag(bbox.x + bbox.width) OVER {w} < lag(font_size) OVER {w} * 0.3 THEN 0 ELSE 1 END"""


_PASS1 = f"""
    l1 AS (SELECT *, row_number() OVER (PARTITION BY doc, page_no ORDER BY baseline_y DESC, seq) AS ord1, {_new('baseline_y DESC, seq')} AS new1 FROM {_VISIBLE}),
    m1 AS (SELECT *, sum(new1) OVER (PARTITION BY doc, page_no ORDER BY ord1) AS word1 FROM l1),
    w1 AS (SELECT doc, page_no, word1, string_agg(value, '' ORDER BY bbox.x, ord1) AS text, min(bbox.x) AS x,
                  arg_min(font_size, (bbox.x, ord1)) AS font_size, arg_min(baseline_y, (bbox.x, ord1)) AS baseline_y FROM m1 GROUP BY ALL)
"""
_TRIM = r"regexp_replace({}, '^[\s\x{{85}}\p{{Z}}]+|[\s\x{{85}}\p{{Z}}]+$', '', 'g')"
_MASK = "repeat('█', greatest(length({0}), 1))"
_NOTICE = markdown.NOTICE.replace("'", "''")

ORACLE: dict[str, str] = {
    "email_spans": spans_sql(MAILS, "c_custkey", _EMAIL, "i"),
    "url_spans": spans_sql(MAILS, "c_custkey", _URL, "i"),
    "person_spans": spans_sql(MAILS, "c_custkey", _NAME.replace("''", "'"), "", r"^[#\s]*"),
    "phone_spans": spans_sql(CALLS, "o_orderkey", _PHONE),
    "date_spans": spans_sql(CALLS, "o_orderkey", _DATE),
    "all_spans": " UNION ALL ".join(
        f"SELECT c_custkey, start_pos, end_pos, '{label}' AS label, 'regex' AS engine FROM ({spans_sql(MAILS, 'c_custkey', p, f, lead)})"
        for label, p, f, lead in (("NOM_PERSONNE", _NAME.replace("''", "'"), "", r"^[#\s]*"), ("EMAIL", _EMAIL, "i", ""), ("PHONE", _PHONE, "", ""), ("DATE", _DATE, "", ""), ("URL", _URL, "i", ""))
    ),
    "spans_by_lang": f"SELECT lower(lang) AS lang, engine, count(*) AS n_spans, count(DISTINCT s.doc) AS n_docs FROM {_SPANS} s JOIN {_PARAS} p ON s.doc = p.doc AND s.para_no = p.para_no GROUP BY ALL",
    "masked_orders": f"""
        WITH t AS (SELECT o_orderkey, text, string_split(text, ' ') AS ws FROM {CALLS}),
        w AS (SELECT o_orderkey, i, ws[i] AS w, CAST(coalesce(list_sum(list_transform(ws[1:i-1], lambda x: length(x) + 1)), 0) AS BIGINT) AS a FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM t)),
        s AS ({' UNION ALL '.join(f'SELECT * FROM ({spans_sql(CALLS, "o_orderkey", p, f)})' for p, f in ((_PHONE, ''), (_DATE, ''), (_EMAIL, 'i'), (_URL, 'i')))}),
        h AS (SELECT w.o_orderkey, w.i, w.w, EXISTS (SELECT 1 FROM s WHERE s.o_orderkey = w.o_orderkey AND greatest(s.start_pos, w.a) < least(s.end_pos, w.a + length(w.w))) AS hit FROM w)
        SELECT h.o_orderkey, string_agg(CASE WHEN hit THEN {_MASK.format('h.w')} ELSE h.w END, ' ' ORDER BY i) AS masked_text, count(*) FILTER (hit) AS n_masked,
               (SELECT count(*) FROM s WHERE s.o_orderkey = h.o_orderkey) AS n_spans FROM h GROUP BY h.o_orderkey
    """,
    "word_targets": f"SELECT doc, page_no, word_no, text FROM {_WORDS} w WHERE {_COVERED.format(s=_SPANS, more='')}",
    "redaction_targets": f"""
        WITH n AS (SELECT * FROM {_WORDS} w WHERE {_COVERED.format(s=_SPANS, more=" AND s.engine = 'ner'")}),
        r AS (SELECT * FROM {_WORDS} w WHERE {_COVERED.format(s=_SPANS, more=" AND s.engine = 'regex'")})
        SELECT doc, page_no, word_no, text, 'ner' AS engine FROM n UNION ALL
        SELECT doc, page_no, word_no, text, 'regex' FROM r WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc = r.doc AND n.page_no = r.page_no AND n.bbox = r.bbox AND n.text = r.text)
    """,
    "covered_ranges": f"""
        SELECT doc, count(*) AS n_words, CAST(sum(CAST({_COVERED.format(s=_SPANS, more='')} AS INT)) AS BIGINT) AS n_hit FROM {_WORDS} w WHERE para_no IS NOT NULL GROUP BY doc
    """,
    "masked_words": f"SELECT doc, page_no, word_no, {_MASK.format('text')} AS masked FROM {_WORDS}",
    "first_pass_words": f"WITH {_PASS1} SELECT doc, page_no, CAST(word1 AS BIGINT) AS word1, {_TRIM.format('text')} AS text, font_size, baseline_y, x FROM w1 WHERE {_TRIM.format('text')} <> ''",
    "second_pass_words": f"""
        WITH {_PASS1},
        j AS (SELECT m1.*, w1.baseline_y AS head_b, w1.x AS head_x FROM m1 JOIN w1 ON m1.doc = w1.doc AND m1.page_no = w1.page_no AND m1.word1 = w1.word1 WHERE {_TRIM.format('w1.text')} <> ''),
        l2 AS (SELECT *, row_number() OVER (PARTITION BY doc, page_no ORDER BY baseline_y DESC, bbox.x, head_b DESC, head_x, word1, ord1) AS ord2 FROM j),
        n2 AS (SELECT *, {_new('ord2')} AS new2 FROM l2),
        m2 AS (SELECT *, CAST(sum(new2) OVER (PARTITION BY doc, page_no ORDER BY ord2) AS INT) AS word2 FROM n2)
        SELECT doc, page_no, word2 AS word_no, string_agg(value, '' ORDER BY ord2) AS text, arg_min(font_size, ord2) AS font_size, arg_min(baseline_y, ord2) AS baseline_y, min(bbox.x) AS x, min(bbox.y) AS y,
               round(max(bbox.x + bbox.width) - min(bbox.x), 6) AS width, round(max(bbox.y + bbox.height) - min(bbox.y), 6) AS height FROM m2 GROUP BY doc, page_no, word2
    """,
    "global_font": f"WITH {_PASS1} SELECT doc, round(avg(font_size), 6) AS mean_font FROM w1 WHERE {_TRIM.format('text')} <> '' GROUP BY doc",
    "word_ranges": f"""
        SELECT doc, page_no, word_no, CAST(a AS INT) AS start_pos, CAST(a + length(text) AS INT) AS end_pos FROM (
            SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc, para_no ORDER BY page_no, word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM {_WORDS} WHERE para_no IS NOT NULL)
    """,
    "paragraph_texts": f"SELECT doc, para_no, string_agg(text, ' ' ORDER BY page_no, word_no) AS text FROM {_WORDS} WHERE para_no IS NOT NULL GROUP BY doc, para_no",
    "paragraph_segmentation": rf"""
        WITH b AS (SELECT doc, para_no AS block_ord, is_heading, lag(is_heading) OVER w AS before, regexp_matches(coalesce(lag(text) OVER w, ''), '[.:!][\s\x{{85}}\p{{Z}}]*$') AS closed
                   FROM {_PARAS} WINDOW w AS (PARTITION BY doc ORDER BY para_no))
        SELECT doc, block_ord, CAST(sum(CASE WHEN is_heading OR coalesce(before, true) OR closed THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY block_ord) - 1 AS INT) AS para_no FROM b
    """,
    "heading_blocks": f"""
        WITH w AS (SELECT * FROM {_WORDS} WHERE para_no IS NOT NULL), m AS (SELECT doc, avg(font_size) AS mean FROM w GROUP BY doc)
        SELECT w.doc, para_no, avg(font_size) > any_value(mean) * 1.25 AS heading FROM w JOIN m ON w.doc = m.doc GROUP BY w.doc, para_no
    """,
    "page_breaks": f"""
        SELECT doc, para_no, CASE WHEN page_no IS NULL THEN '' WHEN before IS NULL THEN '*Page ' || page_no || '*' || chr(10) || chr(10)
            WHEN before <> page_no THEN chr(10) || '---' || chr(10) || chr(10) || '*Page ' || page_no || '*' || chr(10) || chr(10) ELSE '' END AS mark
        FROM (SELECT *, last_value(page_no IGNORE NULLS) OVER (PARTITION BY doc ORDER BY para_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {_PARAS})
    """,
    "markdown_export": f"""
        WITH w AS (SELECT * FROM {_WORDS} WHERE para_no IS NOT NULL),
        r AS (SELECT doc, para_no, trim(string_agg(CASE WHEN {_COVERED.format(s=_SPANS, more='')} THEN {_MASK.format('w.text')} ELSE w.text END, ' ' ORDER BY page_no, word_no)) AS shown FROM w GROUP BY doc, para_no),
        p AS (SELECT *, last_value(page_no IGNORE NULLS) OVER (PARTITION BY doc ORDER BY para_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {_PARAS}),
        q AS (SELECT p.doc, p.para_no, CASE WHEN page_no IS NULL THEN '' WHEN before IS NULL THEN '*Page ' || page_no || '*' || chr(10) || chr(10)
                WHEN before <> page_no THEN chr(10) || '---' || chr(10) || chr(10) || '*Page ' || page_no || '*' || chr(10) || chr(10) ELSE '' END
              || CASE WHEN coalesce(shown, '') = '' THEN '' ELSE CASE WHEN is_heading THEN '## ' ELSE '' END || shown || chr(10) || chr(10) END AS piece
              FROM p LEFT JOIN r ON p.doc = r.doc AND p.para_no = r.para_no)
        SELECT doc, '# ' || doc || ' (anonymisé)' || chr(10) || chr(10) || '{_NOTICE}' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || string_agg(piece, '' ORDER BY para_no) AS markdown FROM q GROUP BY doc
    """,
    "pending_files": """
        WITH f AS (SELECT DISTINCT path FROM files WHERE path IS NOT NULL)
        SELECT path FROM f WHERE NOT ends_with(path, '.anon.pdf') AND regexp_replace(path, '\\.[^./]*$', '') || '.anon.pdf' NOT IN (SELECT path FROM f)
    """.replace("\\\\", "\\"),
    "output_paths": r"""
        SELECT DISTINCT path, regexp_replace(path, '\.[^./]*$', '') || '.anon.pdf' AS output, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') AS name FROM files WHERE path IS NOT NULL
    """,
    "decoder_glyphs": """
        SELECT doc, font_no, e.key AS code, e.value AS value, coalesce(list_extract(map_extract(code_to_width, e.key), 1), default_width) AS width
        FROM (SELECT *, unnest(map_entries(code_to_char)) AS e FROM (SELECT DISTINCT ON (doc, font_no) * FROM font_decoders)) WHERE e.value IS NOT NULL
    """,
    "decoded_letters": """
        SELECT l.doc, l.font_no, count(*) AS n_letters, round(sum(font_size * height_ratio), 4) AS ink_height, round(min(baseline_y + font_size * y_offset_ratio), 4) AS lowest
        FROM (SELECT DISTINCT ON (doc, page_no, seq) * FROM letters) l JOIN (SELECT DISTINCT ON (doc, font_no) * FROM font_decoders) f ON l.doc = f.doc AND l.font_no = f.font_no GROUP BY l.doc, l.font_no
    """,
    "softmax_argmax": """
        SELECT vec_id, CAST(len(embedding) - list_position(list_reverse(embedding), list_max(embedding)) AS INT) AS class,
               round(1 / list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE)))), 5) AS confidence FROM embeddings
    """,
    "bio_split": f"""
        SELECT span_id, CASE WHEN regexp_matches(label, '^[BI][-_]') THEN label[1:1] ELSE 'B' END AS prefix, regexp_replace(label, '^[BI][-_]', '') AS tag FROM {_SPANS} WHERE label IS NOT NULL
    """,
    "trimmed_spans": rf"""
        WITH o AS (SELECT span_id, start_pos, substring(text, start_pos + 1, greatest(end_pos - start_pos, 0)) AS own FROM {_SPANS} s JOIN {_PARAS} p ON s.doc = p.doc AND s.para_no = p.para_no
                   WHERE start_pos < end_pos AND start_pos < length(text)),
        t AS (SELECT *, length(regexp_extract(own, '^[\s\x{{85}}\p{{Z}}]*')) AS lead, regexp_replace({_TRIM.format('own')}, '[!-/:-@\[-`{{-~]+$', '') AS tail FROM o),
        u AS (SELECT *, regexp_replace(tail, '^[!-/:-@\[-`{{-~]+', '') AS head FROM t)
        SELECT span_id, CAST(start_pos + lead + length(tail) - length(head) AS INT) AS start_pos, CAST(start_pos + lead + length(tail) AS INT) AS end_pos FROM u
    """,
    "merged_spans": rf"""
        WITH k AS (SELECT s.doc, s.para_no, start_pos, end_pos, score, text, coalesce(MAP {{{', '.join(f"'{a}': '{b}'" for a, b in SAME_LABEL.items())}}}[upper(regexp_replace(label, '^[BI][-_]', ''))], label) AS label
                   FROM {_SPANS} s JOIN {_PARAS} p ON s.doc = p.doc AND s.para_no = p.para_no WHERE engine = 'ner' AND label IS NOT NULL AND start_pos IS NOT NULL AND end_pos IS NOT NULL),
        n AS (SELECT *, lag(label) OVER w AS l0, lag(end_pos) OVER w AS e0 FROM k WINDOW w AS (PARTITION BY doc, para_no ORDER BY start_pos, end_pos, label, score NULLS FIRST)),
        m AS (SELECT *, CASE WHEN l0 = label AND start_pos >= e0 AND regexp_full_match(substring(text, CAST(e0 AS BIGINT) + 1, CAST(start_pos - e0 AS BIGINT)), '[\s\x{{85}}\p{{Z}}]*') THEN 0 ELSE 1 END AS new FROM n),
        i AS (SELECT *, sum(new) OVER (PARTITION BY doc, para_no ORDER BY start_pos, end_pos, label, score NULLS FIRST ROWS UNBOUNDED PRECEDING) AS island FROM m)
        SELECT doc, para_no, min(start_pos) AS start_pos, arg_max(end_pos, (start_pos, end_pos)) AS end_pos, label,
               round(list_reduce(list(CAST(score AS DOUBLE) ORDER BY start_pos, end_pos, score), lambda a, x: (a + x) / 2), 4) AS score, CAST(count(*) AS INT) AS n_parts
        FROM i GROUP BY doc, para_no, island, label
    """,
}
# What the made files must show. A letter of a word stands behind the widths of those before it that show.
_LETTERS = r"""
    w AS (SELECT doc || '/' || page_no AS file, page_no AS page, word_no, bbox.x AS x0, baseline_y, font_size, text, row_number() OVER (PARTITION BY doc, page_no ORDER BY word_no) - 1 AS place FROM {words} WHERE {where}),
    c AS (SELECT *, substring(text, CAST(i AS BIGINT), 1) AS ch, unicode(substring(text, CAST(i AS BIGINT), 1)) AS u FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM w)),
    v AS (SELECT *, {width} AS em FROM c WHERE NOT (u < 32 OR u BETWEEN 127 AND 159 OR u IN (8203, 65279))),
    p AS (SELECT *, x0 + coalesce(sum(em * font_size) OVER (PARTITION BY file, word_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM v)
"""
_PLAIN = _LETTERS.format(words=_WORDS, where="text <> ''", width=r"CASE WHEN regexp_full_match(text, '[\x{20}-\x{FF}]*') THEN (300 + u % 200) / 1000.0 ELSE 0.45 END")
_SHOWN = """file, CAST(1 AS INT) AS page_no, {seq} ch AS value, round(x, 4) AS x, round(baseline_y + font_size * {low}, 4) AS y, round(font_size * em, 4) AS width, round(font_size * {high}, 4) AS height,
    round(font_size, 4) AS font_size, round(baseline_y, 4) AS baseline_y, CAST(NULL AS VARCHAR) AS error"""
_SEQ = "CAST(row_number() OVER (PARTITION BY file ORDER BY word_no, i) - 1 AS INT) AS seq,"
_SIZED = "(SELECT doc || '/' || page_no AS file, page_no AS page, word_no, bbox.x AS x0, baseline_y AS y0, font_size FROM " + _WORDS + ")"
ORACLE |= {
    "pdf_plain_letters": f"WITH {_PLAIN} SELECT {_SHOWN.format(seq=_SEQ, low=-0.2, high=0.9)} FROM p",
    "pdf_redacted_letters": f"WITH {_PLAIN} SELECT {_SHOWN.format(seq='', low=-0.2, high=0.9)} FROM p WHERE place % 3 <> 0",
    "pdf_redaction_boxes": f"""
        WITH {_PLAIN} SELECT file, round(min(x) - 1, 4) AS x, round(any_value(baseline_y + font_size * -0.2) - 1, 4) AS y, round(max(x + font_size * em) - min(x) + 2, 4) AS width, round(any_value(font_size) * 0.9 + 2, 4) AS height,
               CAST(1 AS DOUBLE) AS fill, CAST(0 AS DOUBLE) AS line, CAST(1 AS DOUBLE) AS line_width FROM p WHERE place % 3 = 0 GROUP BY file, word_no
    """,
    "pdf_matrix_letters": f"""
        WITH p AS (SELECT file, word_no, unnest([0, 1]) AS i, 0.5 + word_no % 4 * 0.5 AS a, 1.0 + page % 3 AS d, x0, y0, font_size FROM {_SIZED}),
        q AS (SELECT *, CASE i WHEN 0 THEN 'A' ELSE 'B' END AS ch, a * x0 + 7 AS x, d * (y0 - i * font_size) - 3 AS baseline_y, (300 + (65 + i) % 200) / 1000.0 AS em FROM p)
        SELECT {_SHOWN.format(seq=_SEQ, low=-0.2, high=0.9)} FROM q
    """,
    "pdf_spaced_letters": f"""
        WITH p AS (SELECT file, word_no, unnest(range(0, 5)) AS i, word_no % 9 * 100 - 300 AS kern, x0, y0, font_size FROM {_SIZED}),
        q AS (SELECT *, chr(CAST(65 + i AS INT)) AS ch, (300 + (65 + i) % 200) / 1000.0 AS em, y0 AS baseline_y,
                     x0 + font_size * (list_sum(list_transform(range(0, i), lambda k: (300 + (65 + k) % 200) / 1000.0)) - CASE WHEN i > 0 THEN kern / 1000.0 ELSE 0 END + CASE WHEN i > 1 THEN 0.2505 ELSE 0 END) AS x1 FROM p),
        r AS (SELECT *, coalesce(x1, x0) AS x FROM q)
        SELECT {_SHOWN.format(seq=_SEQ, low=-0.2, high=0.9)} FROM r
    """,
    "pdf_composite_letters": f"""
        WITH {_LETTERS.format(words=_WORDS, where="regexp_full_match(text, '[!-~]+')", width="(400 + 5 * (u - 32)) / 1000.0")},
        q AS (SELECT * REPLACE (CASE WHEN page % 2 = 0 THEN chr(CAST(945 + u - 33 AS INT)) ELSE ch END AS ch) FROM p)
        SELECT {_SHOWN.format(seq=_SEQ, low=-0.095, high=0.69)} FROM q
    """,
    "pdf_face_marks": """
        SELECT c_custkey, CAST(3 + k AS INT) AS obj_id, ((CASE k WHEN 0 THEN c_custkey % 256 ELSE 255 - c_custkey % 256 END - 127) / 128.0 + 1) / 2 > 0.7 AS has_face, CAST(NULL AS VARCHAR) AS error
        FROM (SELECT c_custkey, unnest([0, 1]) AS k FROM customer)
    """,
    "pdf_purged_images": """
        SELECT c_custkey, count(*) AS n_images, CAST(sum(CASE WHEN ((g - 127) / 128.0 + 1) / 2 > 0.7 THEN 0 ELSE 12 END) AS BIGINT) AS n_bytes
        FROM (SELECT c_custkey, unnest([c_custkey % 256, 255 - c_custkey % 256]) AS g FROM customer) GROUP BY c_custkey
    """,
}
_ENTITIES = f"""
    e AS (SELECT c_custkey, text, unnest([regexp_extract(text, 'Jean [A-Z]+'), regexp_extract(text, '[a-z.0-9]+@[a-z]+\\.example'), regexp_extract(text, 'Customer#[0-9]+@x'), regexp_extract(text, 'http.*$')]) AS found FROM {MAILS})
""".replace("\\\\", "\\")
ORACLE |= {
    "ner_entities": f"""
        WITH {_ENTITIES} SELECT c_custkey, CAST(strpos(text, found) - 1 AS INT) AS start_pos, CAST(strpos(text, found) - 1 + length(found) AS INT) AS end_pos, 'PER' AS label,
               round(CAST(exp(CAST(2 AS DOUBLE)) / (exp(CAST(2 AS DOUBLE)) + 3) AS DOUBLE), 4) AS score, CAST(NULL AS VARCHAR) AS error FROM e
    """,
    "ner_windows": f"SELECT c_custkey, true AS all_found, CAST({made_files.LONG} * (length(text) + 1) - 1 AS INT) AS last_end, CAST(2 AS INT) AS first_start FROM {MAILS}",
}
_FIVE = (("NOM_PERSONNE", _NAME.replace("''", "'"), "", r"^[#\s]*"), ("EMAIL", _EMAIL, "i", ""), ("PHONE", _PHONE, "", ""), ("DATE", _DATE, "", ""), ("URL", _URL, "i", ""))
_ASCII = r"regexp_replace(text, '[^\x{00}-\x{7F}]', 'x', 'g') AS text"
_ASCII_DOCS = f"(SELECT doc_id, {_ASCII} FROM documents)"
ORACLE["ascii_paragraph_spans"] = " UNION ALL ".join(f"SELECT doc, para_no, start_pos, end_pos, '{label}' AS label, 'regex' AS engine FROM ({spans_sql(f'(SELECT doc, para_no, {_ASCII} FROM {_PARAS})', 'doc, para_no', p, f, lead)})" for label, p, f, lead in _FIVE)
ORACLE["masked_ascii_documents"] = f"""
    WITH t AS (SELECT doc_id, text, string_split(text, ' ') AS ws FROM {_ASCII_DOCS}),
    w AS (SELECT doc_id, i, ws[i] AS w, CAST(coalesce(list_sum(list_transform(ws[1:i-1], lambda x: length(x) + 1)), 0) AS BIGINT) AS a FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM t)),
    s AS ({' UNION ALL '.join(f'SELECT * FROM ({spans_sql(_ASCII_DOCS, "doc_id", p, f, lead)})' for _, p, f, lead in _FIVE)}),
    h AS (SELECT w.doc_id, w.i, w.w, EXISTS (SELECT 1 FROM s WHERE s.doc_id = w.doc_id AND greatest(s.start_pos, w.a) < least(s.end_pos, w.a + length(w.w))) AS hit FROM w),
    m AS (SELECT doc_id, string_agg(CASE WHEN hit THEN {_MASK.format('w')} ELSE w END, ' ' ORDER BY i) AS masked_text, count(*) FILTER (hit) AS n_masked FROM h GROUP BY doc_id)
    SELECT d.doc_id, masked_text, coalesce(n_masked, 0) AS n_masked, (SELECT count(*) FROM s WHERE s.doc_id = d.doc_id) AS n_spans FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id
"""
ORACLE["redaction_counts"] = f"SELECT doc, engine, count(*) AS n_words FROM ({ORACLE['redaction_targets']}) GROUP BY doc, engine"
