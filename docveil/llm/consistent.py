"""One consistent form for text that looks the same.

Arrow text is copied into one array of code points; replacements are gathers from lookup
tables, one-to-many replacements use expansion offsets, characters without width are
masked out, and combining marks are composed pair by pair over the whole array at once.
No string of a single row is touched.

Which script a word's look-alike letters belong to is decided for each word from its
letters that have no look-alike, and from the language of its paragraph.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from docveil.llm.codepoints import flat, groups, ragged, strings
from docveil.llm.scripts import LANGS, lang_index

CHUNK = 1 << 20

# Characters without width, blanks, and signs that look like ASCII ones.
NO_WIDTH = [0xAD, 0x34F, 0x61C, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0xFEFF]
BLANKS = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SIGNS = {"‐": "-", "‑": "-", "‒": "-", "−": "-", "﹣": "-", "․": ".", "⁄": "/", "∕": "/", "ʼ": "'", "ʹ": "'", "∶": ":", "꞉": ":", "։": ":", "ǃ": "!"}
# Letters of other scripts that look like a Latin, Russian or Greek one.
CYRILLIC_LATIN = "аa вB еe іi јj оo рp сc уy хx ѕs һh ԁd ԛq ԝw ӏl АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ԌG"
GREEK_LATIN = "οo νv ρp ιi κk υu χx ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX"
LATIN_CYRILLIC = "aа eе oо pр cс yу xх AА BВ EЕ KК MМ HН OО PР CС TТ YУ XХ"
GREEK_CYRILLIC = "οо ρр χх ΑА ΒВ ΕЕ ΚК ΜМ ΗН ΟО ΡР ΤТ ΥУ ΧХ"
LATIN_GREEK = "oο vν AΑ BΒ EΕ ZΖ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ YΥ XΧ aα pρ iι kκ uυ xχ"
CYRILLIC_GREEK = "оο рρ хχ АΑ ВΒ ЕΕ КΚ МΜ НΗ ОΟ РΡ ТΤ УΥ ХΧ ІΙ"
#: Pairs of signs of one script that look like a third.
LOOKS_LIKE_ONE = {(0xE40, 0xE40): 0xE41, (0xE4D, 0xE32): 0xE33, (0x905, 0x93E): 0x906, (0x905, 0x94B): 0x913, (0x905, 0x94C): 0x914}
ARABIC = "یي کك ہه"
#: Code point ranges whose compatibility forms are look-alikes; wide punctuation is normal in Japanese and Chinese.
COMPATIBLE = [(0x2102, 0x2115), (0x2119, 0x211D), (0x2124, 0x2139), (0x2160, 0x217F), (0x249C, 0x24E9), (0x2F00, 0x2FD5), (0xF900, 0xFAFF), (0xFB00, 0xFB06), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC), (0xFF01, 0xFF9F), (0xFFE0, 0xFFE6), (0x1D400, 0x1D7FF)]
WIDE_NORMAL = [0xFF01, 0xFF08, 0xFF09, 0xFF0C, 0xFF1A, 0xFF1B, 0xFF1F, 0xFF5E, 0xFF05]
LATIN, CYRILLIC, GREEK = range(3)


def _pairs(text: str) -> dict[int, int]:
    return {ord(p[0]): ord(p[1]) for p in text.split()}


@lru_cache(1)
def expansions() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: how many characters it becomes, and where they stand in the values; one set for East Asian text."""
    width = np.ones(0x110000, np.int64)
    start = np.arange(0x110000, dtype=np.int64)
    extra: list[int] = []

    def put(c: int, to: str) -> None:
        width[c] = len(to)
        start[c] = 0x110000 + len(extra)
        extra.extend(map(ord, to))

    for c in (*range(0x80, 0x323B0), *range(0xE0000, 0xE0200)):
        s = chr(c)
        if unicodedata.normalize("NFC", s) != s:
            put(c, unicodedata.normalize("NFC", s))
    for lo, hi in COMPATIBLE:
        for c in range(lo, hi + 1):
            to = unicodedata.normalize("NFKC", chr(c))
            if to != chr(c):
                put(c, to)
    # half-width voicing marks become combining ones, which the composition takes up
    put(0xFF9E, "゙")
    put(0xFF9F, "゚")
    for c, to in SIGNS.items():
        put(ord(c), to)
    for c in BLANKS:
        put(c, " ")
    width[NO_WIDTH] = 0
    wide = width.copy()
    wide_start = start.copy()
    wide[WIDE_NORMAL] = 1
    wide_start[WIDE_NORMAL] = WIDE_NORMAL
    return np.stack([width, wide]), np.stack([start, wide_start]), np.concatenate([np.arange(0x110000), np.array(extra)]).astype(np.uint32), np.array([lang in ("ja", "zh") for lang in LANGS] + [True])


@lru_cache(1)
def letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: its script (3: none), whether another script has a look-alike, and the replacement in each script."""
    script = np.full(0x110000, 3, np.uint8)
    for c in range(0x250):
        if chr(c).isalpha() and c not in (0xAA, 0xBA):
            script[c] = LATIN
    script[0x1E00:0x1F00] = LATIN
    script[0x370:0x400], script[0x1F00:0x2000] = GREEK, GREEK
    script[0x400:0x530] = CYRILLIC
    to = np.tile(np.arange(0x110000, dtype=np.uint32), (3, 1))
    for target, lists in ((LATIN, (CYRILLIC_LATIN, GREEK_LATIN)), (CYRILLIC, (LATIN_CYRILLIC, GREEK_CYRILLIC)), (GREEK, (LATIN_GREEK, CYRILLIC_GREEK))):
        for text in lists:
            for a, b in _pairs(text).items():
                to[target, a] = b
    to[LATIN, ord("в")] = ord("в")  # only its capital looks like a Latin letter
    for a, b in _pairs(ARABIC).items():
        to[:, a] = b
    alike = (to != np.arange(0x110000)).any(0)
    return script, alike, to


def shown_lang(text: F.Column, lang: F.Column) -> F.Column:
    """lang for a word that stands alone; null for Russian and Greek where the word has no letter that only their script has, as marks are often Latin there."""
    script, alike, _ = letters()
    own = {k: "[" + "".join(rf"\x{{{c:X}}}" for c in np.flatnonzero((script == s) & ~alike)) + "]" for k, s in (("ru", CYRILLIC), ("el", GREEK))}
    out = F.when(~lang.isin(list(own)), lang)
    for k, letter in own.items():
        out = out.when((lang == k) & F.regexp_like(text, F.lit(letter)), lang)
    return out


@lru_cache(1)
def compositions() -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (first << 21 | second) and the composed character."""
    found = {}
    for c in range(0xC0, 0x30000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", chr(c)) == chr(c):
            found[int(parts[0], 16) << 21 | int(parts[1], 16)] = c
    for (a, b), c in LOOKS_LIKE_ONE.items():
        found[a << 21 | b] = c
    keys = np.array(sorted(found), np.int64)
    return keys, np.array([found[k] for k in keys.tolist()], np.uint32)


def expanded(cp: np.ndarray, offsets: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blanks, signs, compatible forms and characters without width replaced."""
    width, start, values, east = expansions()
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    side = east[lang].astype(np.int64)[row]
    n = width[side, cp]
    out = values[np.repeat(start[side, cp], n) + ragged(n)]
    ends = np.concatenate([[0], np.cumsum(n)])
    return out, ends[offsets]


def scripted(cp: np.ndarray, offsets: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Look-alike letters put into the script of their word."""
    script, alike, to = letters()
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    home = np.array([CYRILLIC if x == "ru" else GREEK if x == "el" else LATIN for x in LANGS] + [LATIN])[lang]
    s, same = script[cp], alike[cp]

    def number(mask: np.ndarray) -> np.ndarray:
        return np.bincount(row, mask, minlength=rows)

    digit = number((cp >= 0x30) & (cp <= 0x39)) > 0
    own = s == home[row]
    sure_home, home_all = number(own & ~same), number(own)
    sure_latin, latin_all = number((s == LATIN) & ~same), number(s == LATIN)
    sure_strange = number((s < 3) & (s != LATIN) & ~own & ~same)
    other = home != LATIN
    # in Russian and Greek text a word is of the home script unless its sure letters are Latin, or it is a code of letters and digits
    latin_word = other & ((sure_latin > sure_home) | ((sure_home == 0) & (sure_latin == 0) & ((home_all < latin_all) & digit)) | ((sure_latin == sure_home) & (sure_home > 0) & (latin_all > home_all)))
    target = np.where(latin_word, LATIN, home)
    # a word with sure letters of a third script, or of Russian or Greek in Latin text, is left as it is
    leave = sure_strange > 0
    return np.where(leave[row], cp, to[target[row], cp])


def composed(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks composed with the letter before them, again and again until none is left that can be."""
    keys, result = compositions()
    first = np.zeros(len(cp) + 1, bool)
    first[offsets] = True
    while len(cp) > 1:
        key = cp[:-1].astype(np.int64) << 21 | cp[1:].astype(np.int64)
        maybe = np.flatnonzero(~first[1 : len(cp)] & ((cp[1:] >= 0x300) | (cp[1:] == 0)))
        at = np.searchsorted(keys, key[maybe])
        at[at == len(keys)] = 0
        hit = keys[at] == key[maybe]
        i, c = maybe[hit], result[at[hit]]
        if not len(i):
            break
        # of pairs that overlap only the first counts in this round
        keep = np.concatenate([[True], np.diff(i) > 1])
        i, c = i[keep], c[keep]
        cp = cp.copy()
        cp[i] = c
        stay = np.ones(len(cp), bool)
        stay[i + 1] = False
        before = np.concatenate([[0], np.cumsum(stay)])
        cp, offsets = cp[stay], before[offsets]
        first = np.zeros(len(cp) + 1, bool)
        first[offsets] = True
    return cp, offsets


def plain(texts: pa.Array, lang: np.ndarray) -> pa.Array:
    """The consistent form of every text; null stays null."""
    cp, offsets = flat(texts)
    out = []
    for i, j in groups(offsets, CHUNK):
        own = offsets[i : j + 1] - offsets[i]
        c, o = expanded(cp[offsets[i] : offsets[j]], own, lang[i:j])
        c, o = composed(c, o)
        c, o = composed(scripted(c, o, lang[i:j]), o)
        out.append(strings(c, o).cast(pa.string()))
    done = pa.concat_arrays(out) if out else pa.array([], pa.string())
    if texts.null_count:
        done = pa.compute.if_else(texts.is_valid(), done, pa.scalar(None, pa.string()))
    return done


def consistent(df: DataFrame, text_col: str = "text", lang_col: str = "lang", into: str = "plain") -> DataFrame:
    """df with the consistent form of text_col in a new column. Empty stays empty, null stays null, an unknown language counts as Latin."""
    names = df.columns

    def run(batches):
        for batch in batches:
            lang = lang_index(batch.column(names.index(lang_col)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, plain(batch.column(names.index(text_col)), lang)], names=[*names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.StringType())]))
