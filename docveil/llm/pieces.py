"""Pieces of bounded size of texts that are too large, cut at natural boundaries.

A text is first written as a string of classes, one ASCII sign for each of its units: how
strong the boundary behind the unit is. One bounded-quantifier pattern per detector cuts
that string inside the engine's regular expressions; its alternatives are ordered by the
strength of the boundary (end of text, sentence end, clause end, blank, any unit), each
consumes as much as fits. All repetitions are of single signs of one width, so that the
expression engine loops over them and its stack doesn't grow with the limit. A piece
begins `overlap` units before its cut: the lookback is an offset. Positions are running
sums over arrays; pieces come out of one row by one generator, without a shuffle.

Sizes are in units: `words` are stretches between U+0020, `chars` are code points. A null
detector, or one that is not listed, means the default detector. Null texts have no
pieces, empty ones one empty piece, nor have blank ones more in words; in chars, blanks
are cut as any characters are. An overlap is cut to max_seq_len - 1, so
that every piece gets on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docveil.functions.arrays import let, running

# Marks that end a sentence, marks that end a clause, closing marks that may follow.
HARD_ENDS = "。！？｡।॥؟۔"
SOFT_ENDS = ".!?…"
CLAUSES = ",;:，、；：،؛·"
CLOSING = "\"'”’»」』）)]"
# Signs of the classes: a word behind which a sentence or a clause ends, any other word; and characters of each kind.
SENTENCE, CLAUSE, OTHER = "s", "c", "x"
HARD, SOFT, CLOSE, DIGIT, BLANK = "h", "e", "q", "9", " "


def _set(chars: str) -> str:
    return "".join("\\" + c if c in "\"'])." else c for c in chars)


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def cutting_pattern(unit: Column, size: Column, overlap: Column) -> Column:
    """The pattern whose matches on the classes, one after the other, are the new parts of the pieces."""

    def of(n: Column, first: bool) -> Column:
        """Half of what fits at least; the first piece holds at least what the second repeats."""
        half = F.greatest(F.lit(1), F.floor(n / 2))
        half = (F.greatest(half, overlap) if first else half).cast("int").cast("string")
        start, most = (r"\A" if first else ""), n.cast("string")
        some = _text(start, ".{", half, ",", most, "}")
        rest = _text(start, ".{1,", most, r"}\z|")
        words = _text(some, rf"(?<={SENTENCE})|", some, rf"(?<={CLAUSE})|", start, ".{", most, "}")
        chars = _text(
            some, rf"(?<={HARD}{CLOSE}{{0,2}})(?!{CLOSE})|", some, rf"(?<=[{HARD}{SOFT}]{CLOSE}{{0,2}})(?={BLANK})|", some, rf"(?<={CLAUSE})(?![{CLOSE}{DIGIT}])|", some, rf"(?={BLANK})|", start, ".{", most, "}",
        )
        return _text(rest, F.when(unit == "words", words).otherwise(chars))

    return _text(of(size, True), "|", of(size - overlap, False))


def classes(text: Column, unit: Column) -> Column:
    """One sign for each unit of the text."""
    ends = rf"[{_set(SOFT_ENDS + HARD_ENDS)}][{_set(CLOSING)}]{{0,2}}\z"
    kind = lambda w: F.when(F.regexp_like(w, F.lit(ends)), SENTENCE).when(F.regexp_like(w, F.lit(rf"[{_set(CLAUSES)}]\z")), CLAUSE).otherwise(OTHER)
    by_word = F.array_join(F.transform(_words(text), kind), "")
    known = HARD_ENDS + SOFT_ENDS + CLAUSES + CLOSING + "0123456789"
    signs = HARD * len(HARD_ENDS) + SOFT * len(SOFT_ENDS) + CLAUSE * len(CLAUSES) + CLOSE * len(CLOSING) + DIGIT * 10
    by_char = F.translate(F.regexp_replace(text, rf"[^ 0-9{_set(known[:-10])}]", OTHER), known, signs)
    return F.when(unit == "words", by_word).otherwise(by_char)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " ", -1), lambda w: w != "")


def limits(detectors: DataFrame) -> DataFrame:
    """detector_id, unit, size, overlap, is_default and the cutting pattern of each detector; of several rows the greatest."""
    one = detectors.where("max_seq_len is not null").groupBy("detector_id").agg(F.max(F.struct("max_seq_len", "overlap", "unit", "is_default")).alias("d")).select("detector_id", "d.*")
    size = F.greatest(F.col("max_seq_len"), F.lit(1)).cast("int")
    overlap = F.least(F.greatest(F.coalesce("overlap", F.lit(0)), F.lit(0)), size - 1).cast("int")
    every = one.select("detector_id", "unit", size.alias("size"), overlap.alias("overlap"), "is_default")
    return every.withColumn("cutter", cutting_pattern(F.col("unit"), F.col("size"), F.col("overlap")))


def cut(df: DataFrame, detectors: DataFrame, text_col: str = "text", detector_col: str = "detector_id") -> DataFrame:
    """df with lim_unit, lim_size, lim_overlap and `cuts`: how many units each piece adds, in order.

    One equi-join on the detector's id; the default detector is a single row and comes in
    as a scalar. Without any detector a text is one piece.
    """
    lim = limits(detectors)
    held = F.struct("unit", "size", "overlap", "cutter")
    default = lim.where("is_default").orderBy("detector_id").limit(1).select(held.alias("d")).scalar()
    known = lim.where("detector_id is not null").select(F.col("detector_id").alias("lim_detector_id"), held.alias("lim_known"))
    joined = df.join(known, F.col(detector_col) == F.col("lim_detector_id"), "left").withColumn("lim", F.coalesce("lim_known", default))
    unit, text = F.col("lim.unit"), F.col(text_col)
    found = F.transform(F.regexp_extract_all(classes(text, unit), F.col("lim.cutter"), F.lit(0)), F.char_length)
    one = F.array(F.when(unit == "words", F.size(_words(text))).otherwise(F.char_length(text)))
    cuts = F.when(text.isNull(), F.lit(None)).when(F.col("lim").isNull() | F.coalesce(F.size(found) == 0, F.lit(True)), one).otherwise(found)
    # a generator keeps the optimizer from repeating the search wherever its result is used
    return joined.select(*df.columns, F.col("lim.unit").alias("lim_unit"), F.col("lim.size").alias("lim_size"), F.col("lim.overlap").alias("lim_overlap"), F.explode(F.array(cuts)).alias("cuts"))


def pieces(df: DataFrame, detectors: DataFrame, keys: list[str], text_col: str = "text", detector_col: str = "detector_id") -> DataFrame:
    """keys, piece_no, start_pos, end_pos, size, text of every piece; a text within its limit is one piece.

    In words, a piece begins and ends with a word; in chars, pieces cover the text wholly.
    Every row is cut by itself.
    """
    rows = cut(df.select(*keys, text_col, detector_col), detectors, text_col, detector_col).where("cuts is not null")
    text, is_words = F.col(text_col), F.coalesce(F.col("lim_unit") == "words", F.lit(False))
    back = F.coalesce(F.col("lim_overlap"), F.lit(0))

    def ranges(x: Column) -> Column:
        """First unit and the one behind the last of every piece."""
        return F.transform(F.arrays_zip(x["cuts"].alias("n"), x["at"].alias("at")), lambda c: F.struct(F.greatest(c["at"] - back, F.lit(0)).cast("int").alias("a"), (c["at"] + c["n"]).cast("int").alias("b")))

    units = let(F.struct(F.col("cuts").alias("cuts"), running(F.col("cuts")).alias("at")), ranges)

    def by_word(x: Column) -> Column:
        parts, at, first = x["parts"], x["at"], x["first"]  # stretches between blanks, where each begins, and which of them are words

        def piece(u: Column) -> Column:
            i, j = F.get(first, u["a"]), F.get(first, u["b"] - 1)
            empty = u["b"] <= u["a"]
            return F.struct(
                F.when(empty, F.lit(0)).otherwise(F.get(at, i)).cast("int").alias("start_pos"), F.when(empty, F.lit(0)).otherwise(F.get(at, j) + F.char_length(F.get(parts, j))).cast("int").alias("end_pos"),
                (u["b"] - u["a"]).alias("size"), F.when(empty, F.lit("")).otherwise(F.array_join(F.slice(parts, i + 1, j - i + 1), " ")).alias("text"),
            )

        return F.transform(x["units"], piece)

    words = let(F.split(text, " ", -1), lambda p: F.struct(p.alias("parts"), running(F.transform(p, lambda w: F.char_length(w) + 1)).alias("at"), F.filter(F.transform(p, lambda w, i: F.when(w != "", i)), lambda i: i.isNotNull()).alias("first"), units.alias("units")))
    chars = lambda u: F.struct(u["a"].alias("start_pos"), u["b"].alias("end_pos"), (u["b"] - u["a"]).alias("size"), F.substring(text, u["a"] + 1, u["b"] - u["a"]).alias("text"))
    out = F.when(is_words, let(words, by_word)).otherwise(F.transform(units, chars))
    return rows.select(*keys, F.posexplode(out).alias("piece_no", "piece")).select(*keys, "piece_no", "piece.*")


def oversized(df: DataFrame, detectors: DataFrame, keys: list[str], text_col: str = "text", detector_col: str = "detector_id") -> DataFrame:
    """Keys of the rows that come out in more than one piece; each key has one row."""
    return cut(df.select(*keys, text_col, detector_col), detectors, text_col, detector_col).where(F.size("cuts") > 1).select(*keys)
