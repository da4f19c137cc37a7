"""Personal items in free text, by a semi-Markov conditional random field.

A text is read through the view of sentences.py (plain characters, repaired encodings).
Candidate segments of each type come from generators of high recall: runs of groups with
digits, address-like and name-like runs of words, mailbox forms. Features describe whole
segments: their shape, their words, what stands before and behind. The model is

    p(segmentation) ~ exp(sum of the scores of its segments)

over all sets of segments that don't overlap, text outside having score 0; bounded-entity
dynamic programming gives its normalizer, marginals and the best set. Weights are learned
from the finds of an older detector run: a bounded sample of SAMPLE labelled paragraphs a
language, taken by hash. As those finds have gaps, the model is fitted twice, the second
time with its own finds added. Everything else covers all rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from docveil.llm.sentences import REPAIRS, abbreviated, repairs_of, view

#: Labelled paragraphs a language that the model is fitted on; epochs, step size and weight of the penalty.
SAMPLE, EPOCHS, STEP, PENALTY = 320, 7, 0.25, 1e-4
#: Longer texts (code points) are not taken into the sample.
SAMPLE_CHARS = 20_000
#: Epochs of the models that only complete the finds, and the folds they are fitted across.
FEW, FOLDS = 4, 4
#: Languages written without capitals.
UNCASED = ("ja", "zh", "th", "hi", "ar")
TYPES = ["EMAIL", "PHONE", "ID", "ADDRESS", "NAME"]
#: Bounds of candidate segments in characters, by type; only a mailbox has none. Words, groups and digits aren't counted.
MOST = {"PHONE": 60, "ID": 60, "ADDRESS": 160, "NAME": 60}
#: Of scripts without blanks every stretch is offered as a name, up to these bounds; longer ones only where a mark or title limits them.
HAN_NAME, THAI_NAME = 10, 20
# Label names of older finds.
LABELS = {
    "EMAIL": "EMAIL", "PHONE": "PHONE", "TEL": "PHONE", "ID_NUM": "ID", "MISC": "ID", "ADR": "ADDRESS", "LOC": "ADDRESS", "I-LOC": "ADDRESS", "B-LOC": "ADDRESS",
    "PER": "NAME", "B-PER": "NAME", "I-PER": "NAME", "PERSON": "NAME", "NOM_PERSONNE": "NAME",
}
ROW = "doc string, para_no int, text string, lang string, repairs " + REPAIRS

LATIN = "A-Za-zÀ-ÖØ-öø-ÿĀ-ſ"
MAIL = re.compile(rf"[{LATIN}0-9][{LATIN}0-9._%+\-]*\s?(?:@|\(at\)|\[at\]|\(@\))\s?[{LATIN}0-9\-]+(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)[{LATIN}0-9\-]+)+", re.I)
GROUP = re.compile(r"\+?\d+(?:[A-Z](?![a-zà-ÿ]))?|\(\+?\d+\)|[A-ZΑ-ΩА-Я]{1,5}\d[\dA-Z]*|[A-ZΑ-Ω]{1,2}(?![A-Za-zα-ωΑ-Ω])")
# letters and digits of a code, and what may stand between its parts
CODE = re.compile(rf"[{LATIN}Α-Ωα-ωА-Яа-яЁё\d]+")
JOINTS = ("", " ", ".", "-", "/", "–")
LETTER = r"(?:[^\W\d_]|[\u0300-\u036f\u064b-\u0652\u0900-\u0963])"
WORD = re.compile(rf"{LETTER}+(?:['’\-]{LETTER}+)*|\d+[a-z]?(?![^\W_])|\d+|[^\w\s]|\w")
HAN = re.compile(r"[々〇一-鿿ぁ-んァ-ヴー]+")
PARTICLES = {"de", "della", "van", "von", "di", "du", "der", "del", "da", "le", "la", "dos", "den", "zu", "ter", "el", "al", "y"}
# letters of scripts without blanks: words in Latin letters end at them
UNSPACED = re.compile(r"[々〇㐀-鿿ぁ-ゖァ-ヺー฀-๿]")
PLACE_ZH = re.compile(r"[一-鿿]{2,40}\d+[号號弄巷栋幢](?:\d+(?:单元|室|楼|栋|层|号))*")
PLACE_JA = re.compile(r"(?:〒?\d{3}-?\d{4})?[々一-鿿ぁ-んァ-ヴー]{2,40}\d+(?:丁目|番地|番|号|[-−]\d+|\d+)*")
THAI = re.compile(r"[฀-๏๚-๿]+")
# where a Thai syllable may begin: a consonant without a vowel written before it, or such a vowel
THAI_START = re.compile(r"(?<![เแโใไ])[ก-ฮ]|[เแโใไ]")


def shape(s: str) -> str:
    """Digits as 9, letters by kind, equal neighbours of letters once."""
    out = re.sub(r"\d", "9", s)
    out = re.sub(r"[^\W\d_]+", lambda m: "X" if m[0].isupper() and len(m[0]) > 1 else "A" if m[0].isupper() else "Xx" if m[0][0].isupper() else "x", out)
    return out


def tokens(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m[0]) for m in WORD.finditer(text)]


def codes(text: str) -> set[tuple[int, int, int]]:
    """Identity numbers that are mostly or partly letters: 6 or more letters and digits, one digit at least.

    Small letters without a digit are a part only where no blank parts them from the rest.
    """
    found: set[tuple[int, int, int]] = set()
    parts = [(m.start(), m.end(), any(c.isdigit() for c in m[0]), m[0].isupper()) for m in CODE.finditer(text)]
    for i, (a, *_) in enumerate(parts):
        size, digit = 0, False
        for j in range(i, len(parts)):
            start, b, number, upper = parts[j]
            if j > i and b - a > MOST["ID"]:
                break
            if j > i:
                _, end, last_number, last_upper = parts[j - 1]
                gap = text[end:start]
                if gap not in JOINTS or gap == " " and not ((number or upper) and (last_number or last_upper)):
                    break
            size, digit = size + b - start, digit or number
            if digit and size >= 6:
                found.add((a, b, 2))
    return found


def han(text: str, lang: str) -> set[tuple[int, int, int]]:
    """Addresses and names in Japanese and Chinese: runs before a house number, and every short stretch that begins with a Han character or is Katakana."""
    found: set[tuple[int, int, int]] = set()
    for m in (PLACE_JA if lang == "ja" else PLACE_ZH).finditer(text):
        span = m[0]
        firsts = [k for k in range(0, max(1, len(span) - 4)) if not k or not span[k].isdigit() and span[k] != "-"]
        ends = sorted({len(span), *(e.end() for e in re.finditer(r"号|室|楼|单元|番地|\d+(?=$)", span))})
        for k in firsts:
            for e in ends:
                if e - k >= 5 and any(c.isdigit() for c in span[k:e]):
                    found.add((m.start() + k, m.start() + e, 3))
    for m in HAN.finditer(text):
        run = m[0]
        for i in range(len(run)):
            if "一" <= run[i] <= "鿿":
                for n in range(2, min(HAN_NAME, len(run) - i) + 1):
                    found.add((m.start() + i, m.start() + i + n, 4))
    for m in re.finditer(r"[ァ-ヴー]+(?:[・=＝·][ァ-ヴー]+)*|[一-鿿]+(?:[·・][一-鿿]+)+", text):
        found.add((m.start(), m.end(), 4))
    return found


def thai(text: str) -> set[tuple[int, int, int]]:
    """Addresses and names in Thai, where no blank parts words: they begin and end where a syllable may, or at the limits of runs and numbers."""
    found: set[tuple[int, int, int]] = set()
    for m in re.finditer(r"นางสาว|นาย|นาง|คุณ|โทรหา", text):
        for n in range(2, MOST["NAME"] + 1):
            e = m.end() + n
            if e > len(text) or not ("฀" <= text[e - 1] <= "๿"):
                break
            found.add((m.end(), e, 4))
    runs = [(m.start(), m.end(), [x.start() for x in THAI_START.finditer(text, m.start(), m.end())]) for m in THAI.finditer(text)]
    for k, (a, b, starts) in enumerate(runs):
        for s in starts:
            found.update((s, e, 4) for e in (*starts, b) if 2 <= e - s <= THAI_NAME)
            if b - s <= THAI_NAME and k + 1 < len(runs) and text[b : runs[k + 1][0]] == " ":
                _, end, more = runs[k + 1]
                found.update((s, e, 4) for e in (*more, end) if 2 <= e - b - 1 <= THAI_NAME)
    # from a number or the run before it, to a number or the run behind it
    parts = [(m.start(), m.end(), m[0][0].isdigit()) for m in re.finditer(r"\d+(?:[/\-]\d+)*|" + THAI.pattern, text)]
    inner = {a: starts for a, _, starts in runs}
    for i, (a, b, number) in enumerate(parts):
        digit = False
        for j in range(i, len(parts)):
            s, e, last = parts[j]
            if j > i and e - a > MOST["ADDRESS"]:
                break
            if j > i and text[parts[j - 1][1] : s] not in ("", " ", ",", ", "):
                break
            if digit or last:
                if j > i:
                    found.add((a, e, 3))
                    if not number and last:
                        found.update((x, e, 3) for x in inner[a] if b - x <= 24)
                    if not last:
                        found.update((a, x, 3) for x in inner[s] if 2 <= x - s <= 24)
            digit |= last
    return found


def candidates(text: str, lang: str) -> list[tuple[int, int, int]]:
    """(start, end, type) of every segment that may be an item."""
    found: set[tuple[int, int, int]] = set()
    for m in MAIL.finditer(text):
        found.add((m.start(), m.end(), 0))
    # groups with digits, one sign apart
    runs: list[list[re.Match]] = []
    for m in GROUP.finditer(text):
        if runs and (gap := text[runs[-1][-1].end() : m.start()]) is not None and (gap == "" or gap in (" ", ".", "-", "/", "–", ") ", " (")) and m.start() - runs[-1][-1].end() <= 2:
            runs[-1].append(m)
        else:
            runs.append([m])
    for run in runs:
        for i in range(len(run)):
            digits = 0
            for j in range(i, len(run)):
                if j > i and run[j].end() - run[i].start() > MOST["PHONE"]:
                    break
                digits += sum(c.isdigit() for c in run[j][0])
                if digits >= 6:
                    found.add((run[i].start(), run[j].end(), 1))
                if digits and sum(c.isalnum() for part in run[i : j + 1] for c in part[0]) >= 6:
                    found.add((run[i].start(), run[j].end(), 2))
    found.update(codes(text))
    if lang in ("ja", "zh"):
        found |= han(text, lang)
    elif lang == "th":
        found |= thai(text)
    toks = tokens(UNSPACED.sub("。", text) if lang in ("ja", "zh", "th") else text)
    kinds = []
    for a, _, w in toks:
        kinds.append("9" if w[0].isdigit() else "X" if w[0].isupper() and len(w) > 1 else "I" if w[0].isupper() else "x" if w[0].isalpha() else w)
    n = len(toks)
    if lang in ("hi", "ar"):  # no capitals to go by: short runs of words
        for i in range(n):
            if kinds[i] in "9x":
                digit = False
                for j in range(i, n):
                    if j > i and toks[j][1] - toks[i][0] > MOST["ADDRESS"]:
                        break
                    if kinds[j] in ("।", ".", "؟", "?", ":", "@", "(", ")"):
                        break
                    digit |= kinds[j] == "9"
                    if kinds[j] in "9x":
                        if digit and j > i:
                            found.add((toks[i][0], toks[j][1], 3))
                        if not digit and toks[j][1] - toks[i][0] <= MOST["NAME"] // 2 and all(k == "x" for k in kinds[i : j + 1]):
                            found.add((toks[i][0], toks[j][1], 4))
    if lang in UNCASED:  # what is written in Latin letters there follows the rules below
        kinds = ["" if k == "x" and w.lower() == w.upper() else k for k, (_, _, w) in zip(kinds, toks)]
    for i in range(n):
        a, _, w = toks[i]
        if kinds[i] and kinds[i] in "XI" or w.startswith(("O'", "D'", "d'")):
            length = 0
            j = i
            while j < n and (j == i or toks[j][1] - a <= MOST["NAME"]):
                k, t = kinds[j], toks[j][2]
                if k and k in "XI":
                    end = toks[j][1]
                    if k == "I" and j + 1 < n and toks[j + 1][2] == ".":
                        found.add((a, end + 1, 4))
                        j += 1
                    else:
                        found.add((a, end, 4))
                elif not (t.lower() in PARTICLES and length):
                    break
                length += 1
                j += 1
                if j < n and text[toks[j - 1][1] : toks[j][0]].strip(" ") != "":
                    break
        # addresses: from a number, a capital, or a word before one; up to a number or a capital
        street = kinds[i] == "x" and i + 1 < n and len(w) <= 10
        if kinds[i] and kinds[i] in "9XI" or street:
            digit, letter, lower = False, False, 0
            for j in range(i, n):
                if j > i and toks[j][1] - a > MOST["ADDRESS"]:
                    break
                k, t = kinds[j], toks[j][2]
                if k and k in "9XI":
                    lower = 0
                    digit |= k == "9"
                    letter |= k != "9"
                    if digit and letter and j > i:
                        found.add((a, toks[j][1], 3))
                elif k == "x":
                    lower += 1
                    if lower > 3 or t in ("et", "and", "y", "wohnt", "demeure", "vive", "lives", "и"):
                        break
                elif t == ".":
                    if not abbreviated(text, toks[j][0], lang):
                        break
                elif not k or t not in ",/'’-":
                    break
    return sorted(found)


def context(text: str, toks: list[tuple[int, int, str]], starts: list[int], ends: list[int], s: int, e: int, lang: str) -> tuple[str, str, str, str]:
    """Words before and behind, digits as 0."""
    if lang in ("ja", "zh", "th"):
        return text[max(0, s - 2) : s], text[max(0, s - 4) : s], text[e : e + 2], text[e : e + 4]
    i = bisect_right(ends, s) - 1
    j = bisect_right(starts, e - 1)
    word = lambda k: "0" if toks[k][2][0].isdigit() else toks[k][2].lower()
    p1 = word(i) if i >= 0 else "^"
    p2 = word(i - 1) if i >= 1 else "^"
    p3 = word(i - 2) if i >= 2 else "^"
    n1 = word(j) if j < len(toks) else "$"
    n2 = word(j + 1) if j + 1 < len(toks) else "$"
    return p1, f"{p3} {p2} {p1}" if not p1.isalpha() else f"{p2} {p1}", n1, f"{n1} {n2}"


def kind_of(c: str) -> str:
    return "9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c


def features(text: str, lang: str, cands: list[tuple[int, int, int]]) -> list[list[str]]:
    toks = tokens(text)
    starts, ends = [t[0] for t in toks], [t[1] for t in toks]
    out = []
    memory: dict = {}
    # how far the run of digits goes decides whether a group is only part of a number
    for s, e, t in cands:
        key = (s, e)
        if key not in memory:
            p1, p2, n1, n2 = context(text, toks, starts, ends, s, e, lang)
            span = text[s:e]
            words = [toks[k][2] for k in range(bisect_right(starts, s - 1), bisect_right(starts, e - 1))]
            memory[key] = p1, p2, n1, n2, span, words
        p1, p2, n1, n2, span, words = memory[key]
        g = f"{t}{lang}"
        before, behind = kind_of(text[s - 1]) if s else "^", kind_of(text[e]) if e < len(text) else "$"
        far = kind_of(text[e + 1]) if e + 1 < len(text) else "$"
        f = [f"{t}b", f"{g}b", f"{t}p{p1}", f"{g}P{p2}", f"{t}n{n1}", f"{g}N{n2}", f"{t}c{before}|{behind}{far}", f"{g}w{kind_of(text[s - 2]) if s > 1 else '^'}{before}|{kind_of(span[0])}"]
        if t in (1, 2):
            sh = re.sub(r"[ .\-/]", "_", re.sub(r"\d", "9", span))
            digits = sum(c.isdigit() for c in span)
            f += [f"{t}s{shape(span)}", f"{g}s{sh}", f"{t}d{digits}", f"{g}d{digits}", f"{g}2{span[:2]}", f"{t}1{span[:1]}", f"{g}p{p1}{digits}", f"{t}r{p1}{sh[:2]}"]
        elif t == 3:
            sh = shape(span)
            f += [f"{t}l{len(words)}", f"{g}l{min(len(words), 12)}", f"{g}f{(words[0] if not words[0].isdigit() else '9').lower()}" if words else "3f", f"{g}e{kind_of(span[-1])}{behind}{far}", f"{t}q{span.count(',')}", f"{g}k{re.sub(r'9+', '9', sh)}",
                  f"{g}z{'p' if re.search(r'(?<![0-9])[0-9]{5,6}(?![0-9])', span) else 'n'}{kind_of(span[-1])}", f"{g}L{words[-1].lower() if words and words[-1].isalpha() else '9'}"]
            f += [f"{t}i{w.lower()}" for w in set(words) if w.isalpha()]
            if lang in ("ja", "zh"):
                f += [f"{g}a{span[:2]}", f"{g}y{span[-2:] if not span[-1].isdigit() else '99'}", f"{g}m{len(span) // 3}"]
        elif t == 4:
            f += [f"{g}l{len(words)}", f"{t}s{shape(span)}", f"{g}k{shape(span)}"]
            f += [f"{t}i{w.lower()}" for w in words] + [f"{t}f{words[0].lower()}" if words else "4f", f"{t}e{words[-1].lower()}" if words else "4e"]
            f += [f"{t}j{p.lower()}" for w in words for p in (w.split("-") if "-" in w else ())]
            f += [f"{t}u{w[-3:].lower()}" for w in words if len(w) > 4]
            if lang in ("ja", "zh", "th"):
                f += [f"{g}S{span}", f"{g}h{span[:2]}", f"{g}o{span[:1]}", f"{g}m{len(span)}", f"{g}y{span[-2:]}"]
        else:
            f += [f"{t}s{'(' in span}{'[' in span}{' ' in span}"]
        out.append(f)
    return out


def plain_view(text: str, lang: str, repairs: dict | None) -> tuple[str, list[int]]:
    """The view of the text; without blanks in Japanese and Chinese, where line ends leave them."""
    plain, at = view(text, lang, repairs)
    if lang in ("ja", "zh"):
        keep = [i for i, c in enumerate(plain) if c != " "]
        return "".join(plain[i] for i in keep), [*(at[i] for i in keep), len(text)]
    return plain, at


INVISIBLE = "­​‌‍⁠﻿"


def stored(text: str, at: list[int], s: int, e: int) -> tuple[int, int]:
    a, b = at[s], at[e]
    while b > a and (text[b - 1].isspace() or text[b - 1] in INVISIBLE):
        b -= 1
    return a, b


def order(cands: list[tuple[int, int, int]]) -> tuple[np.ndarray, list[int]]:
    """Positions sorted by end, and for each the number of earlier ones that end at or before its start."""
    by_end = sorted(range(len(cands)), key=lambda k: (cands[k][1], cands[k][0]))
    ends = [cands[k][1] for k in by_end]
    return np.array(by_end, np.int64), [bisect_right(ends, cands[k][0]) for k in by_end]


def best(scores: list[float], before: list[int]) -> list[int]:
    """The set of segments that don't overlap with the greatest sum, as positions in the order by end."""
    n = len(scores)
    total, take = [0.0] * (n + 1), [False] * n
    for k in range(n):
        with_k = total[before[k]] + scores[k]
        take[k] = with_k > total[k]
        total[k + 1] = with_k if take[k] else total[k]
    out, k = [], n - 1
    while k >= 0:
        if take[k]:
            out.append(k)
            k = before[k] - 1
        else:
            k -= 1
    return out


def marginals(scores: np.ndarray, before: list[int]) -> np.ndarray:
    """Probability of each segment (in the order by end), by forward and backward sums."""
    n = len(scores)
    if n == 0:
        return scores
    s = scores.tolist()
    fwd = [0.0] * (n + 1)
    for k in range(n):
        a, b = fwd[k], fwd[before[k]] + s[k]
        top = a if a > b else b
        fwd[k + 1] = top + log1p(exp(-abs(a - b)))
    grad = [0.0] * (n + 1)
    grad[n] = 1.0
    p = [0.0] * n
    for k in range(n - 1, -1, -1):
        flow = grad[k + 1]
        if flow:
            p[k] = flow * exp(min(0.0, fwd[before[k]] + s[k] - fwd[k + 1]))
            grad[before[k]] += p[k]
            grad[k] += flow - p[k]
    return np.array(p)


def prepared(text, lang, repairs):
    lang = lang or ""
    plain, at = plain_view(text, lang, repairs)
    cands = candidates(plain, lang)
    return plain, at, cands, features(plain, lang, cands)


def fit(rows: list[tuple], rounds: int = 4) -> dict[str, float]:
    """Weights from (text, lang, repairs, finds), finds being (start, end, type or None) as stored."""
    index: dict[str, int] = {}
    examples = []
    for text, lang, repairs, finds in rows:
        _, at, cands, feats = prepared(text, lang, repairs)
        if not cands:
            continue
        by_end, before = order(cands)
        ids = np.array([index.setdefault(f, len(index)) for k in by_end for f in feats[k]], np.int32)
        places = [(*stored(text, at, cands[k][0], cands[k][1]), cands[k][2]) for k in by_end]
        known = {(a, b, t) for a, b, t in finds if t is not None}
        loose = {(a, b) for a, b, t in finds if t is None}
        gold = np.array([p in known or (p[:2] in loose and p[2] != 2) for p in places], float)
        lens = np.array([len(feats[k]) for k in by_end])
        examples.append([ids, np.concatenate([[0], np.cumsum(lens)[:-1]]), lens, before, clean(gold, before), np.array([p[2] for p in places])])
    for _ in range(rounds - 1):
        complete(examples, len(index))
    w = trained(examples, len(index))
    return {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}


def trained(examples: list[list], size: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by stochastic ascent of the likelihood with steps adapted to each feature."""
    w, seen = np.zeros(size), np.full(size, 1e-6)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            flat, cut, lens, before, gold, _ = examples[k]
            delta = gold - marginals(np.add.reduceat(w[flat], cut), before)
            on = np.abs(delta) > 1e-3
            if not on.any():
                continue
            value = np.repeat(np.where(on, delta, 0.0), lens)
            hit = value != 0
            at, g = np.unique(flat[hit], return_inverse=True)
            g = np.bincount(g, value[hit]) - PENALTY * w[at]
            seen[at] += g * g
            w[at] += STEP * g / np.sqrt(seen[at])
    return w


def complete(examples: list[list], size: int) -> None:
    """Adds to the finds of each fold what a model of the other folds finds in it.

    The share of the items that the finds hold is estimated for each type from the other
    folds' probabilities of the finds; it lowers the threshold by as much.
    """
    folds = [examples[k::FOLDS] for k in range(FOLDS)]
    models = [trained([ex for j, fold in enumerate(folds) if j != k for ex in fold], size, FEW) for k in range(FOLDS)]
    for fold, w in zip(folds, models):
        scored = [np.add.reduceat(w[ex[0]], ex[1]) for ex in fold]
        chances = [marginals(x, ex[3]) for x, ex in zip(scored, fold)]
        shift = np.zeros(len(TYPES))
        for t in range(len(TYPES)):
            own = [p[(ex[4] > 0) & (ex[5] == t)] for p, ex in zip(chances, fold)]
            held = np.concatenate(own) if own else np.zeros(0)
            if len(held):
                share = float(np.clip(np.mean(held), 0.05, 0.95)) / 2
                shift[t] = np.log((1 - share) / share)
        for x, ex in zip(scored, fold):
            x = x + shift[ex[5]]
            p = marginals(x, ex[3])
            sure = np.zeros(len(x))
            sure[best(x.tolist(), ex[3])] = 1
            ex[4] = clean(np.maximum(ex[4] * (p > 0.1), sure * (p > 0.5)), ex[3], p)


def clean(gold: np.ndarray, before: list[int], rank: np.ndarray | None = None) -> np.ndarray:
    """Of marked segments that overlap only the best ones stay, so that the marks are a segmentation."""
    score = np.where(gold > 0, 1.0 if rank is None else 1.0 + rank, -1.0)
    out = np.zeros(len(gold))
    out[best(score.tolist(), before)] = 1
    return out


def find(text: str | None, lang: str | None, repairs: dict | None, weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """Items of a text as stored. Null, empty and blank texts have none."""
    if not text or not text.strip():
        return []
    _, at, cands, feats = prepared(text, lang, repairs)
    if not cands:
        return []
    by_end, before = order(cands)
    get = weights.get
    scores = [sum(get(f, 0.0) for f in feats[k]) for k in by_end]
    return sorted((*stored(text, at, cands[by_end[k]][0], cands[by_end[k]][1]), TYPES[cands[by_end[k]][2]]) for k in best(scores, before))


def labelled(paragraphs: DataFrame, finds: DataFrame) -> DataFrame:
    """The bounded sample: text, lang, repairs and finds (start_pos, end_pos, type) of SAMPLE paragraphs a language that have finds."""
    kind = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    own = finds.where("start_pos is not null and end_pos is not null").withColumn("type", kind[F.upper("label")])
    own = own.where(F.col("type").isNotNull() | F.col("label").isNull()).select("doc", "para_no", F.struct("start_pos", "end_pos", "type").alias("f")).distinct()
    own = own.groupBy("doc", "para_no").agg(F.collect_list("f").alias("finds"))
    pick = W.partitionBy("lang").orderBy(F.xxhash64("doc", "para_no"), "doc", "para_no")
    return paragraphs.where(F.char_length("text") <= SAMPLE_CHARS).join(own, ["doc", "para_no"]).withColumn("pick", F.row_number().over(pick)).where(F.col("pick") <= SAMPLE).select("text", "lang", "repairs", "finds")


def learned(paragraphs: DataFrame, finds: DataFrame) -> tuple[pa.Array, pa.Array]:
    """Features and their weights, fitted from the bounded sample in one task, so that only the weights come to the driver."""
    number = {t: i for i, t in enumerate(TYPES)}

    def run(batches):
        rows = [r for batch in batches for r in batch.to_pylist()]
        rows.sort(key=lambda r: (r["lang"] or "", r["text"]))
        w = fit([(r["text"], r["lang"], repairs_of(r["repairs"]), [(f["start_pos"], f["end_pos"], number.get(f["type"])) for f in r["finds"]]) for r in rows if r["text"]])
        yield pa.RecordBatch.from_arrays([pa.array(list(w), pa.string()), pa.array(list(w.values()), pa.float64())], names=["feature", "weight"])

    found = labelled(paragraphs, finds).repartition(1).mapInArrow(run, "feature string, weight double").toArrow().combine_chunks()
    return tuple(pa.concat_arrays(c.chunks) if c.chunks else pa.array([], c.type) for c in found.columns)


def items(paragraphs: DataFrame, finds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start_pos, end_pos, label of every item; paragraphs has text, lang and repairs, one row a key."""
    weights = paragraphs.sparkSession.sparkContext.broadcast(learned(paragraphs, finds))
    taken = paragraphs.select(*keys, "text", "lang", "repairs")
    n = len(keys)

    def run(batches):
        w = dict(zip(*(x.to_pylist() for x in weights.value)))
        for batch in batches:
            found = [find(t, lang, repairs_of(r), w) for t, lang, r in zip(*(batch.column(n + k).to_pylist() for k in range(3)))]
            row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]).astype(np.int64))
            flat = [x for f in found for x in f]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(row) for k in range(n)), pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.string())],
                names=[*keys, "start_pos", "end_pos", "label"],
            )

    schema = T.StructType([*(taken.schema[k] for k in keys), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType()), T.StructField("label", T.StringType())])
    return taken.mapInArrow(run, schema)


def masked(paragraphs: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """keys and masked_text: every item replaced by its label in brackets, all else as it was. Null stays null."""
    own = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "label"))).alias("items"))
    rows = paragraphs.select(*keys, "text").join(own, keys, "left")
    text = F.expr("""
        aggregate(items, named_struct('at', 0, 'out', array('')),
            (a, x) -> named_struct('at', x.end_pos, 'out', concat(a.out, array(substring(text, a.at + 1, x.start_pos - a.at), concat('[', x.label, ']')))),
            a -> concat(array_join(a.out, ''), substring(text, a.at + 1, char_length(text))))
    """)
    return rows.select(*keys, F.when(F.col("items").isNull(), F.col("text")).otherwise(text).alias("masked_text"))
