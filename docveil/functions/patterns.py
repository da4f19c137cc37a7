"""Patterns of the deterministic detectors, and spans of a pattern without a UDF.

Java patterns are Unicode-aware through (?U) and break lines at \\n only through (?d).
Repeated groups are possessive: those are looped over, while others recurse in the regular
expression engine, whose stack overflow would end the whole executor. A group that ends
at a word boundary can be possessive without a change of what is found.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docveil.functions.arrays import let, running

# Capitals, small letters and blanks of names; the five patterns.
UPPER, LOWER, BLANK = "A-ZÀ-ÖØ-Ý", "a-zà-öø-ÿ", r" \t\x{00A0}\x{202F}"
PERSON = (
    rf"(?m)^(?:#+\s*)?[{UPPER}][{LOWER}]+(?:[-'][{UPPER}][{LOWER}]+)?[{BLANK}]+"
    rf"(?:[{UPPER}]{{3,}}\b(?:[-'’][{UPPER}]{{2,}}\b)*+|[{UPPER}](?:[{BLANK}]++[{UPPER}]\b){{2,}}+)"
)
#: Without regard to case, these two also stand for a letter (long s, Kelvin sign); naming them is faster than the flag.
FOLDED = r"\x{017F}\x{212A}"
EMAIL = rf"\b[A-Za-z0-9._%+{FOLDED}-]+@[A-Za-z0-9.{FOLDED}-]+\.[A-Za-z{FOLDED}]{{2,}}\b"
PHONE = r"(?:(?:\+|00)33|0)\s*[1-9][\s.\d-]*\d\b"
DATE = r"\b\d{2}[/-]\d{2}[/-]\d{4}\b"
URL = (
    rf"(?:(?:[hH][tT][tT][pP][sS\x{{017F}}]?:)?//)?(?:[wW]{{3}}\.)?[-a-zA-Z0-9@:%._+~#={FOLDED}]{{1,256}}\."
    rf"[a-zA-Z0-9(){FOLDED}]{{1,6}}\b[-a-zA-Z0-9()@:%_+.~#?&/={FOLDED}]*"
)
#: In the order in which equal starts are listed.
DETECTORS = {"NOM_PERSONNE": PERSON, "EMAIL": EMAIL, "PHONE": PHONE, "DATE": DATE, "URL": URL}
#: What a text must contain at least for a match; saves the costlier search.
HINTS = {"EMAIL": "@", "URL": "."}


def java(pattern: str) -> str:
    return "(?U)(?d)" + pattern


def _length(x: Column) -> Column:
    return F.char_length(F.coalesce(x, F.lit("")))


def _blanks(x: Column) -> Column:
    return _length(x) - _length(F.replace(x, F.lit(" "), F.lit("")))


FOUND = "array<struct<start_pos:int,end_pos:int,label:string,word:int,last_word:int>>"


def matches_of(text: Column, label: str, pattern: str) -> Column:
    """Array of all matches (start_pos, end_pos in code points, label, word, last_word); null for null text.

    Matches and the gaps between them give positions by running sums, and those of blanks
    the numbers (from 0) of the first and last word, words being cut at U+0020. The pattern
    must not match the empty string. What a name begins with, number signs and white space,
    is left out.
    """
    matches = F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(0))
    pairs = F.arrays_zip(matches.alias("m"), F.split(text, java(pattern), -1).alias("g"))  # the last gap has no match

    def placed(pairs: Column) -> Column:
        ends = running(F.transform(pairs, lambda x: _length(x["m"]) + _length(x["g"])))
        words = running(F.transform(pairs, lambda x: _blanks(x["m"]) + _blanks(x["g"])))

        def one(x: Column) -> Column:
            lead = F.regexp_extract(x["pairs"]["m"], r"(?U)^[#\s]*", 0) if label == "NOM_PERSONNE" else F.lit("")
            start = x["ends"] + _length(x["pairs"]["g"])
            word = x["words"] + _blanks(x["pairs"]["g"])
            return F.struct(
                (start + _length(lead)).cast("int").alias("start_pos"), (start + _length(x["pairs"]["m"])).cast("int").alias("end_pos"), F.lit(label).alias("label"),
                (word + _blanks(lead)).cast("int").alias("word"), (word + _blanks(x["pairs"]["m"])).cast("int").alias("last_word"),
            )

        every = F.filter(F.arrays_zip(pairs.alias("pairs"), ends.alias("ends"), words.alias("words")), lambda x: x["pairs"]["m"].isNotNull())
        return F.filter(F.transform(every, one), lambda s: s["start_pos"] < s["end_pos"])

    empty = F.array().cast(FOUND)
    found = let(pairs, lambda x: F.when(F.size(x) > 1, placed(x)).otherwise(empty))
    hint = HINTS.get(label)
    return F.when(text.isNull(), F.lit(None)).when(F.contains(text, F.lit(hint)), found).otherwise(empty) if hint else F.when(text.isNotNull(), found)


def all_matches(text: Column) -> Column:
    """matches_of() of all five patterns ordered by start, then by pattern; overlaps stay. None for blank text, null for null."""
    parts = [matches_of(text, k, p) for k, p in DETECTORS.items()]
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(DETECTORS) for x in (k, i)])
    keyed = F.transform(F.concat(*parts), lambda s: F.struct(s["start_pos"].alias("a"), rank[s["label"]].alias("b"), s["end_pos"].alias("c"), s.alias("s")))
    ordered = F.transform(F.array_sort(keyed), lambda k: k["s"])
    return F.when(text.isNull(), F.lit(None)).when(F.regexp_like(text, F.lit(r"(?U)^\s*$")), F.array().cast(FOUND)).otherwise(ordered)


def _spans(matches: Column) -> Column:
    return F.transform(matches, lambda s: F.struct(s["start_pos"].alias("start_pos"), s["end_pos"].alias("end_pos"), s["label"].alias("label"), F.lit("regex").alias("engine")))


def spans_of(text: Column, label: str) -> Column:
    """Array of spans (start_pos, end_pos, label, engine) of one detector; null for null text."""
    return _spans(matches_of(text, label, DETECTORS[label]))


def all_spans(text: Column) -> Column:
    """Spans of all five detectors ordered by start, then by detector; overlaps stay. None for blank text, null for null."""
    return _spans(all_matches(text))
