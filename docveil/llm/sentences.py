"""Sentence ranges of texts in many languages, by a pushdown automaton.

The automaton runs over the marks of a text only (terminators, quotation marks, brackets,
line ends). Its stack holds open quotations, brackets and their kind; a terminator ends a
sentence at the bottom of the stack alone, so a quotation belongs to the sentence that
introduces it. An opening mark that is never closed is taken back and the text read again
from there without it. Before a full stop, a trie of abbreviations is walked backwards.
Which marks end a sentence depends on the script; in Thai a blank does.

Texts are read through a view: characters without width are left out, look-alikes and
characters from a wrong encoding stand in their plain form, and every position leads back
to the text as stored.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from docveil.llm import consistent, mojibake
from docveil.llm.scripts import LANGS, LATIN_EXTRA, native

REPAIRS = "array<struct<text:string,restored:string,chain:string>>"

# Abbreviations that a sentence doesn't end with, although a capital or a number may follow.
ABBREVIATIONS = {
    "fr": "M MM Mme Mlle Mgr Dr Pr Me St Ste cf env tél n no nos p pp art bât av bd réf vol chap fig app appt al ex éd",
    "en": "Mr Mrs Ms Dr Prof St No Nos ref sec p pp ph Apt cf e.g i.e approx vs fig vol ext tel art dept ca Rev Gen Sen",
    "de": "Dr Hr Fr Nr Nrn S vgl ca z Az bzw Abs Art Str Tel Prof z.B d.h u.a St Bd Kap Abb evtl ggf inkl",
    "es": "Sr Sra Srta Srs Dr Dra D Dña art pág págs núm tel ref Avda aprox p ej vol cap Ud Uds Prof",
    "ru": "г ул д кв пер стр см т гр им п ст тел рис корп обл р просп наб пл проф акад",
    "el": "κ κα κος βλ σελ αρ τηλ οδ λεωφ π.χ κεφ εικ",
    "hi": "क्र डॉ पृ सं",
    "ar": "د أ ص",
}
# What such an abbreviation may close a sentence after ("and so on").
FINAL_AFTER = {"ru": r"и\s+т\.\s+[дп]$"}
# Articles before which a number with a full stop is an ordinal, marks, and words that carry on after a quotation.
ORDINAL_AFTER = re.compile(r"\b(?:der|die|das|den|dem|des|zum|zur|am|im|vom|beim|ein|eine|einen|einem|einer)\s+\d{1,3}$", re.I)
HARD = "。！？｡।॥؟۔！？"
SOFT = ".!?…"
OPENING = {"«": "»", "‹": "›", "„": "“", "“": "”", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", '"': '"'}
CLOSING = set(OPENING.values()) | {'"'}
CARRIES_ON = {"ja": re.compile(r"\s*(?:と|を|に|が|は|の|も|で|、|。|など|という)"), "zh": re.compile(r"\s*(?:然后|并|而|的|地|就|后|，|、|。|；)")}
TIME_FIRST = re.compile(r"^\W*\w+\s+\d{1,2}(?:[:.]\d\d)?\s*[ap]\.\s*m$")
LIST_ITEM = re.compile(r"\s*(?:[-*•‣–]\s|\d{1,3}[.)]\s|[a-z][)]\s|#{1,6}\s|\n)")
MARKS = re.compile(r"[.!?…]+|[。！？｡।॥؟۔;;«»‹›„“”「」『』()（）\[\]【】《》\"\n]")


@lru_cache(None)
def trie(lang: str) -> dict:
    """Abbreviations of the language read backwards; the key '' ends one. An unknown language has those of all Latin ones."""
    root: dict = {}
    words = " ".join(ABBREVIATIONS[x] for x in LATIN_EXTRA) if lang not in LANGS else ABBREVIATIONS.get(lang, "")
    for word in words.split():
        node = root
        for c in reversed(word):
            node = node.setdefault(c, {})
        node[""] = {}
    return root


def abbreviated(text: str, dot: int, lang: str) -> bool:
    """Whether what stands before the full stop is an abbreviation or an initial."""
    node, i = trie(lang), dot - 1
    while i >= 0 and text[i] in node:
        node = node[text[i]]
        i -= 1
        if "" in node and (i < 0 or not (text[i].isalnum() or text[i] in ".-'’")):
            after = FINAL_AFTER.get(lang)
            return not (after and re.search(after, text[max(0, dot - 12) : dot]))
    if dot >= 1 and text[dot - 1] == "\ufffd" and not text[max(0, dot - 4) : dot].strip("\ufffd").strip() and text[max(0, dot - 4) : dot] != "\ufffd" * 4:
        return True  # up to three lost letters
    if dot >= 1 and text[dot - 1].isupper() and (dot < 2 or not (text[dot - 2].isalnum() or text[dot - 2] in "-_")):
        return True  # an initial
    return lang == "de" and dot > 0 and text[dot - 1].isdigit() and bool(ORDINAL_AFTER.search(text[max(0, dot - 14) : dot]))


def begins(text: str, i: int) -> bool:
    """Whether what follows position i can begin a sentence."""
    n = len(text)
    while i < n and (text[i].isspace() or text[i] in "«„“\"'(‹¿¡「[*_"):
        i += 1
    return i >= n or not text[i].islower()


def split(text: str, lang: str) -> list[tuple[int, int]]:
    """Sentence ranges of a plain text, without surrounding white space."""
    cuts: list[int] = []
    ignored: set[int] = set()
    n, full = len(text), len(text.rstrip())
    at, start = 0, 0
    stack: list[tuple[int, str, int, int]] = []  # position, closing mark, number of cuts and start then
    last_end = -1  # end of the last terminator inside a quotation

    def cut(pos: int) -> None:
        nonlocal start
        cuts.append(pos)
        start = pos

    while True:
        found = MARKS.search(text, at)
        if found is None:
            if not stack:
                break
            # marks that stay open are no quotations after all
            pos, _, n_cuts, start = stack[0]
            ignored.update(x[0] for x in stack)
            del cuts[n_cuts:]
            stack.clear()
            at = pos + 1
            continue
        mark, i, at = found[0], found.start(), found.end()
        top = stack[-1][1] if stack else ""
        if mark == "\n":
            if LIST_ITEM.match(text, at) and not stack:
                cut(at)
        elif mark == top:
            ends = last_end >= stack[-1][0] and text[last_end:i].strip() == ""
            opened = stack.pop()[0]
            if not stack and ends and last_end > opened:
                on = CARRIES_ON.get(lang)
                if on is not None:
                    if not on.match(text, at):
                        cut(at)
                elif at >= n or text[at].isspace() and begins(text, at):
                    cut(at)
        elif mark in OPENING:
            if i not in ignored and not (mark == '"' and top and any(s[1] == '"' for s in stack)):
                stack.append((i, OPENING[mark], len(cuts), start))
        elif mark in CLOSING:
            # closes an outer mark: what was opened inside it stays open no longer
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][1] == mark:
                    del stack[depth:]
                    break
        elif mark[0] in HARD or (mark in ";;" and lang == "el"):
            while at < n and text[at] in HARD + SOFT:
                at += 1
            last_end = at
            if not stack:
                cut(at)
        elif mark[0] in SOFT:
            if lang in ("th", "ja", "zh") and mark == "." and at < full:
                continue
            while at < n and text[at] in HARD:
                at += 1
            following = text[at] if at < n else " "
            if following.isspace() or at >= n:
                if mark == "." and at < full and abbreviated(text, i, lang):
                    continue
                if mark == "." and i - start < 60 and TIME_FIRST.match(text[start:i]):
                    continue
                if not begins(text, at):
                    continue
                last_end = at
                if not stack:
                    cut(at)
            elif following in CLOSING:
                last_end = at
            elif mark in ".!?" and following.isupper() and i > 1 and (text[i - 1].islower() or text[i - 1].isdigit() or text[i - 1] in ")»"):
                # a blank is missing, unless this is a name of a site or mailbox
                left, right = text.rfind(" ", 0, i) + 1, text.find(" ", at)
                token = text[left : right if right >= 0 else n]
                rest = token[at - left :]
                if "@" not in token[1:] and not token.lower().startswith(("www.", "http")) and len(rest) > 1 and (rest[1].islower() or rest[1] in "'’.") and (text[i - 1] in ")»" or text[i - 1].isdigit() or text[i - 2].islower()):
                    last_end = at
                    if not stack:
                        cut(at)
    if lang == "th":
        cuts = sorted({*cuts, *(m.start() for m in re.finditer(r"\s+", text))})
    out = []
    for a, b in zip([0, *cuts], [*cuts, n]):
        piece = text[a:b]
        short = piece.strip()
        if short:
            lead = a + len(piece) - len(piece.lstrip())
            out.append((lead, lead + len(short)))
    return out


@lru_cache(1)
def plain_tables() -> tuple[dict, dict, dict]:
    """Translation of look-alike characters one to one: for Latin text, for Russian and for Greek words."""
    width, start, values, _ = consistent.expansions()
    script, _, to = consistent.letters()
    ones = np.flatnonzero((width[1] == 1) & (values[start[1]] != np.arange(0x110000)))
    common = {int(c): int(values[start[1, c]]) for c in ones}
    tables = []
    for target in (consistent.LATIN, consistent.CYRILLIC, consistent.GREEK):
        changed = np.flatnonzero(to[target] != np.arange(0x110000))
        tables.append(common | {int(c): int(to[target, c]) for c in changed})
    return tuple(tables)


NO_WIDTH = frozenset(map(chr, consistent.NO_WIDTH))


def sizes(reading: str, chain: str, length: int) -> list[int]:
    """Positions in the stored token of the characters of its restored form, then its length."""
    steps = chain.split(">")
    out = []
    for c in reading:
        n = 1
        if c > "\x7f":
            try:
                n = len(c.encode(steps[0])) * 2 ** (len(steps) // 2 - 1)
            except UnicodeEncodeError:
                n = 1
        out.append(n)
    ends = np.cumsum([0, *out])
    if ends[-1] != length:  # where the bytes don't tell, positions are spread evenly
        ends = np.round(np.linspace(0, length, len(reading) + 1)).astype(int)
    return ends.tolist()


@lru_cache(1)
def unremarkable() -> np.ndarray:
    """native(), and what a look-alike table replaces."""
    known = native().copy()
    for table in plain_tables():
        known[:, list(table)] = True
    known[:, consistent.NO_WIDTH] = True
    return known


@lru_cache(200_000)
def likely_reading(token: str, lang: str) -> tuple[str, str] | tuple[()]:
    """The first reading of a token with strange characters that has none, and its chain: for texts of which no posterior is known."""
    number = LANGS.index(lang) if lang in LANGS else len(LANGS)
    if all(c < "\x80" or unremarkable()[number, ord(c)] for c in token):
        return ()
    known, latin = native()[number], lang in LATIN_EXTRA or lang not in LANGS
    for name, reading in mojibake.readings(token, (lang,) if lang in LANGS else tuple(LANGS)).items():
        if all(c < "\x80" or known[ord(c)] for c in reading) and (name.startswith("utf-8") or not latin and not mojibake.has_latin_name(token)):
            return reading, name
    return ()


@lru_cache(200_000)
def plain_token(token: str, lang: str, restored: str | None = None, chain: str | None = None) -> tuple[str, tuple[int, ...]]:
    """The token's plain form and, for each of its characters, the position in the token; then the length."""
    at = list(range(len(token) + 1))
    text = token
    if restored is not None:
        text, at = restored, sizes(restored, chain or "", len(token))
    if any(c in NO_WIDTH for c in text):
        kept = [i for i, c in enumerate(text) if c not in NO_WIDTH]
        text, at = "".join(text[i] for i in kept), [*(at[i] for i in kept), at[-1]]
    if any(c in MARKING for c in text):
        text, at = joined_marks(text, at)
    latin, russian, greek = plain_tables()
    if lang in ("ja", "zh"):
        return "".join(chr(EAST[ord(c)]) if ord(c) in EAST else c for c in text), tuple(at)
    table = latin
    if lang in ("ru", "el"):
        low, high = (0x400, 0x52F) if lang == "ru" else (0x370, 0x3FF)
        if sum(low <= ord(c) <= high for c in text) * 2 >= sum(c.isalpha() for c in text):
            table = russian if lang == "ru" else greek
    return text.translate(table), tuple(at)


MARKING = frozenset(map(chr, range(0x300, 0x370)))
# Wide letters, digits and signs that ASCII ones stand for in Japanese and Chinese, and mathematical letters.
EAST = {c: c - 0xFEE0 for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), 0xFF0E, 0xFF20, 0xFF0D, 0xFF0F, 0xFF3F, 0xFF0B)}
EAST |= {c: ord(unicodedata.normalize("NFKC", chr(c))) for c in range(0x1D400, 0x1D7FF) if len(unicodedata.normalize("NFKC", chr(c))) == 1}
EAST |= {c: 0x20 for c in consistent.BLANKS}


def joined_marks(text: str, at: list[int]) -> tuple[str, list[int]]:
    """Marks composed with the letter before them; the pair keeps the letter's position."""
    out, where = [], []
    for c, p in zip(text, at):
        if c in MARKING and out:
            one = unicodedata.normalize("NFC", out[-1] + c)
            if len(one) == 1:
                out[-1] = one
                continue
        out.append(c)
        where.append(p)
    return "".join(out), [*where, at[-1]]


TOKEN = re.compile(r"[^ \n]+|[ \n]+")


def view(text: str, lang: str, repairs: dict[str, tuple[str, str]] | None = None) -> tuple[str, list[int]]:
    """The plain form of a text and the stored position of each of its characters, and of its end.

    repairs: by wrong word, what it was and the chain that spoilt it; every other word is
    right. Without repairs, None, a strange word is read by likely_reading().
    """
    if text.isascii():
        return text, list(range(len(text) + 1))
    out, at = [], []
    for m in TOKEN.finditer(text):
        token, base = m[0], m.start()
        if token.isascii():
            out.append(token)
            at.extend(range(base, m.end()))
        else:
            t, p = plain_token(token, lang, *(likely_reading(token, lang) if repairs is None else repairs.get(token, ())))
            out.append(t)
            at.extend(base + x for x in p[:-1])
    return "".join(out), [*at, len(text)]


def repairs_of(rows) -> dict[str, tuple[str, str]]:
    """The argument of view() from an Arrow cell of repairs, where null means that no word is wrong."""
    return {r["text"]: (r["restored"], r["chain"]) for r in rows or ()}


def sentence_ranges(text: str | None, lang: str | None, heading: bool = False, repairs: dict | None = None) -> list[tuple[int, int]]:
    """Ranges in the text as stored. Null, empty and blank texts have none; a heading is one sentence."""
    if not text or not text.strip():
        return []
    if heading:
        lead = len(text) - len(text.lstrip())
        return [(lead, len(text.rstrip()))]
    plain, at = view(text, lang or "", repairs)
    out = []
    ranges = split(plain, lang or "") or [(0, len(plain))]
    last = 0
    for k, (_, b) in enumerate(ranges):
        first = last  # what the view leaves out belongs to the sentence behind it
        last = len(text) if k == len(ranges) - 1 else at[b]
        piece = text[first:last]
        short = piece.strip()
        if short:
            lead = first + len(piece) - len(piece.lstrip())
            out.append((lead, lead + len(short)))
    return out


def sentences(df: DataFrame, keys: list[str], text_col: str = "text", lang_col: str = "lang", heading_col: str | None = "is_heading", repairs_col: str | None = None) -> DataFrame:
    """keys, sentence_no, start_pos, end_pos of every sentence of every row; one scan, no shuffle."""
    heading = F.coalesce(F.col(heading_col), F.lit(False)) if heading_col else F.lit(False)
    repairs = F.col(repairs_col) if repairs_col else F.lit(None).cast(REPAIRS)
    taken = df.select(*keys, F.col(text_col).alias("s_text"), F.lower(lang_col).alias("s_lang"), heading.alias("s_heading"), repairs.alias("s_repairs"))
    n = len(keys)

    def run(batches):
        for batch in batches:
            found = [sentence_ranges(t, lang, h, repairs_of(r) if repairs_col else None) for t, lang, h, r in zip(*(batch.column(n + k).to_pylist() for k in range(4)))]
            counts = np.array([len(x) for x in found], np.int64)
            row = pa.array(np.repeat(np.arange(len(found)), counts))
            flat = [r for x in found for r in x]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(row) for k in range(n)), pa.array([i for c in counts for i in range(c)], pa.int32()), pa.array([a for a, _ in flat], pa.int32()), pa.array([b for _, b in flat], pa.int32())],
                names=[*keys, "sentence_no", "start_pos", "end_pos"],
            )

    schema = T.StructType([*(taken.schema[k] for k in keys), *(T.StructField(c, T.IntegerType()) for c in ("sentence_no", "start_pos", "end_pos"))])
    return taken.mapInArrow(run, schema)
