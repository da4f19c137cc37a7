"""What the operators know of languages: letters, scripts and punctuation."""

from __future__ import annotations

import numpy as np

LANGS = ["fr", "en", "de", "es", "ru", "el", "ja", "zh", "hi", "ar", "th"]
#: Index of an unknown language.
UNKNOWN = len(LANGS)

# Letters that the languages use beside ASCII, and code point ranges of the other scripts.
LATIN_EXTRA = {
    "fr": "àâæçéèêëîïôœùûüÿÀÂÆÇÉÈÊËÎÏÔŒÙÛÜŸ«»’…",
    "en": "’“”‘…é",
    "de": "äöüßÄÖÜ„“‚‘…",
    "es": "áéíóúüñÁÉÍÓÚÜÑ¿¡«»ºª…",
}
#: Letters found in names of any Latin-script language.
LATIN_NAMES = "áàâäæçéèêëíîïñóôöøœßúùûüÿÁÀÂÄÆÇÉÈÊËÍÎÏÑÓÔÖØŒÚÙÛÜ"
RANGES = {
    "ru": [(0x410, 0x44F), (0x401, 0x401), (0x451, 0x451), (0xAB, 0xAB), (0xBB, 0xBB), (0x2116, 0x2116), (0x2013, 0x2014)],
    "el": [(0x384, 0x3CE), (0xAB, 0xAB), (0xBB, 0xBB)],
    "ja": [(0x3001, 0x303F), (0x3041, 0x30FF), (0x4E00, 0x9FFF), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF5E, 0xFF5E)],
    "zh": [(0x3001, 0x303F), (0x4E00, 0x9FFF), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0x201C, 0x201D), (0x2018, 0x2019)],
    "hi": [(0x900, 0x97F)],
    "ar": [(0x60C, 0x60C), (0x61B, 0x61B), (0x61F, 0x61F), (0x621, 0x652), (0x660, 0x66C), (0x671, 0x6D3)],
    "th": [(0xE01, 0xE3A), (0xE3F, 0xE5B)],
}


def native_table() -> np.ndarray:
    """(language, code point) -> whether the language's plain text uses it. The unknown language uses what any uses."""
    table = np.zeros((len(LANGS) + 1, 0x110000), bool)
    table[:, 0x20:0x7F] = True
    for i, lang in enumerate(LANGS):
        if lang in LATIN_EXTRA:
            table[i, [ord(c) for c in LATIN_EXTRA[lang] + LATIN_NAMES]] = True
        for lo, hi in RANGES.get(lang, []):
            table[i, lo : hi + 1] = True
    table[UNKNOWN] = table[:UNKNOWN].any(0)
    return table


_native: list[np.ndarray] = []


def native() -> np.ndarray:
    if not _native:
        _native.append(native_table())
    return _native[0]


def lang_index(langs) -> np.ndarray:
    """Index of each language name in any case; UNKNOWN for null and others."""
    known = {lang: i for i, lang in enumerate(LANGS)}
    return np.array([known.get((x or "").lower(), UNKNOWN) for x in langs], np.int64)
