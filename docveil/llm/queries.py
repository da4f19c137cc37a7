"""The pN_ queries, each over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from docveil.llm import consistent, encoding, mixing, mojibake, personal, pieces, sentences, shared_spans, tables

WORD = ["doc", "page_no", "word_no"]


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _last_paragraphs(spark, d):
    return tables.latest(table(spark, d, "paragraphs"), ["doc", "para_no"], ["text", "detector_id"])


def p1_found(spark, d):
    return pieces.oversized(_last_paragraphs(spark, d), table(spark, d, "detectors"), ["doc", "para_no"])


def p1_pieces(spark, d):
    return pieces.pieces(_last_paragraphs(spark, d), table(spark, d, "detectors"), ["doc", "para_no"])


def p1_checked(spark, d):
    """What must hold of the pieces of every paragraph, seen from the pieces: none above the limit, each repeating `overlap` units, nothing but blanks left out."""
    paragraphs = _last_paragraphs(spark, d)
    made = pieces.pieces(paragraphs, table(spark, d, "detectors"), ["doc", "para_no"])
    held = F.sort_array(F.collect_list(F.struct("piece_no", "start_pos", "end_pos", "size", F.col("text").alias("piece"))))
    rows = pieces.cut(paragraphs, table(spark, d, "detectors")).join(made.groupBy("doc", "para_no").agg(held.alias("p")), ["doc", "para_no"])
    units = lambda x: F.when(F.col("lim_unit") == "words", F.size(F.filter(F.split(x, " "), lambda w: w != ""))).otherwise(F.char_length(x))
    part = lambda a, b: F.substring(F.col("text"), a + 1, b - a)
    before = lambda i: F.get("p", i - 1)
    within = F.forall("p", lambda x: (x["size"] <= F.col("lim_size")) & (x["piece"] == part(x["start_pos"], x["end_pos"])) & (x["size"] == units(x["piece"])))
    repeated = F.forall(F.transform("p", lambda x, i: (i == 0) | (units(part(x["start_pos"], before(i)["end_pos"])) == F.col("lim_overlap"))), lambda x: x)
    new = F.aggregate(F.transform("p", lambda x, i: x["size"] - F.when(i == 0, F.lit(0)).otherwise(F.col("lim_overlap"))), F.lit(0), lambda a, n: a + n)
    return rows.select("doc", "para_no", units(F.col("text")).alias("n_units"), within.alias("within"), repeated.alias("repeated"), new.alias("n_new"))


def _words(spark, d):
    """Words of paragraphs, and the paragraphs, which tell their languages."""
    return tables.in_paragraphs(table(spark, d, "words")), tables.checkpointed(tables.paragraphs_with_lang(table(spark, d, "paragraphs")))


def _strange_words(words, paragraphs):
    """The words that may be wrong, with their language: the others need no join."""
    return tables.with_lang(words.where(mojibake.strange("text")), paragraphs).withColumn("source", F.col("doc"))


def _wrong_words(spark, d):
    words, paragraphs = _words(spark, d)
    return mojibake.repair(_strange_words(words, paragraphs), WORD, tables.checkpointed, tables.words_of(paragraphs))


def p2_found(spark, d):
    return _wrong_words(spark, d).select(*WORD)


def p2_repaired(spark, d):
    return _wrong_words(spark, d).select(*WORD, "text", "restored", "chain", "posterior")


def p2_glyphs(spark, d):
    return mojibake.wrong_glyphs(table(spark, d, "font_decoders"), table(spark, d, "letters"), _wrong_words(spark, d))


def _items(spark, d):
    paragraphs = tables.checkpointed(_repaired_paragraphs(spark, d))
    return paragraphs, personal.items(paragraphs, table(spark, d, "spans"), ["doc", "para_no"])


def p3_found(spark, d):
    return _items(spark, d)[1]


def p3_masked(spark, d):
    paragraphs, found = _items(spark, d)
    return personal.masked(paragraphs, found, ["doc", "para_no"])


def _changeable(text):
    """Whether a word has a character that isn't printable ASCII: no other is changed."""
    return F.regexp_like(text, F.lit(r"[^\x20-\x7E]"))


def p4_found(spark, d):
    words, paragraphs = _words(spark, d)
    # forms are made once for each distinct text of a language
    kinds = tables.words_of(paragraphs).where(_changeable("text")).select("lang", "text").distinct()
    changed = tables.checkpointed(consistent.consistent(kinds).where("plain <> text"))
    some = tables.with_lang(words.where(_changeable("text")), paragraphs)
    alike = some.alias("c").join(changed.alias("k"), mojibake.same_text("c", "k", False)).select("c.*").withColumn("source", F.col("doc"))
    wrong = mojibake.wrong_texts(_strange_words(words, paragraphs), tables.words_of(paragraphs), tables.checkpointed)
    return alike.alias("c").join(wrong.alias("w"), mojibake.same_text("c", "w"), "left_anti").select(*WORD).distinct()


def p4_words(spark, d):
    """Every word in its consistent form; a word outside paragraphs counts as of the language that most paragraphs of its document are in, if its letters allow that."""
    paragraphs = tables.checkpointed(tables.paragraphs_with_lang(table(spark, d, "paragraphs")))
    words = table(spark, d, "words").select(*WORD, "para_no", "text")
    inside = tables.with_lang(words.where("para_no is not null"), paragraphs)
    loose = words.where("para_no is null").join(tables.main_lang(paragraphs), "doc", "left")
    held = inside.select(*WORD, "text", "lang").unionByName(loose.select(*WORD, "text", consistent.shown_lang(F.col("text"), F.col("lang")).alias("lang")))
    own = held.groupBy(*WORD).agg(F.max(F.struct("text", "lang")).alias("w")).select(*WORD, "w.*")
    return consistent.consistent(own).select(*WORD, "text", "plain")


def _repaired_paragraphs(spark, d):
    """Paragraphs with their language and the repairs of their wrong words."""
    # the functions that follow take long for each row: all shuffle partitions are kept
    last = tables.paragraphs_with_lang(table(spark, d, "paragraphs"), "is_heading").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc", "para_no")
    paragraphs = tables.checkpointed(last)
    wrong = mojibake.repair(tables.strange_words_of(paragraphs, mojibake.strange), ["doc", "para_no", "text"], tables.checkpointed, tables.words_of(paragraphs))
    return tables.with_repairs(paragraphs, wrong.drop("lang"))


def p5_found(spark, d):
    return sentences.sentences(_repaired_paragraphs(spark, d), ["doc", "para_no"], repairs_col="repairs").drop("sentence_no")


def p6_ids(spark, d):
    return encoding.encode(table(spark, d, "documents"))


def _mix(spark, d):
    documents = table(spark, d, "documents")
    targets = table(spark, d, "mix_targets")
    listed = documents.join(targets.select("source").distinct(), "source", "left_semi")
    # sizes are counted once and written to the shared folder: three passes read them
    sized = tables.checkpointed(encoding.token_counts(listed, ["doc_id", "source"]))
    return mixing.mix(sized, targets)


def p7_mix(spark, d):
    return _mix(spark, d)[0]


def p7_report(spark, d):
    return _mix(spark, d)[1]


def p8_found(spark, d):
    return shared_spans.shared_pairs(table(spark, d, "documents"))


def p8_classes(spark, d):
    return shared_spans.shared_classes(table(spark, d, "documents"))


def p8_ranges(spark, d):
    return shared_spans.shared_ranges(table(spark, d, "documents"))


def p8_report(spark, d):
    return shared_spans.shared_report(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_checked, p2_found, p2_repaired, p2_glyphs, p3_found, p3_masked, p4_found, p4_words, p5_found, p6_ids, p7_mix, p7_report, p8_found, p8_classes, p8_ranges, p8_report)}

_P1 = """
        WITH det AS (SELECT * FROM detectors WHERE max_seq_len IS NOT NULL),
        p AS (SELECT doc, para_no, arg_max(text, loaded_at) AS text, arg_max(coalesce(detector_id, ''), loaded_at) AS det_id FROM paragraphs GROUP BY doc, para_no),
        q AS (SELECT p.*, coalesce(d.unit, b.unit) AS unit, coalesce(d.max_seq_len, b.max_seq_len) AS size
              FROM p LEFT JOIN det d ON p.det_id = d.detector_id CROSS JOIN (SELECT * FROM det WHERE is_default) b),
        n AS (SELECT *, CAST(CASE WHEN unit = 'words' THEN len(list_filter(string_split(text, ' '), lambda x: x <> '')) ELSE length(text) END AS INT) AS n_units FROM q WHERE text IS NOT NULL)
"""
ORACLE: dict[str, str] = {
    "p1_found": _P1 + "SELECT doc, para_no FROM n WHERE n_units > size",
    "p1_checked": _P1 + "SELECT doc, para_no, n_units, true AS within, true AS repeated, n_units AS n_new FROM n",
}
