"""Character bigram models of each language in tables of fixed size, counted over the whole corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docveil.llm.codepoints import flat
from docveil.llm.scripts import LANGS, UNKNOWN, lang_index, native
from docveil.llm.window_hash import mixed

PAIRS, SINGLES = 1 << 20, 1 << 17
U = np.uint64
#: Weights of the backoff and of the ground: strength of the less specific estimate, in counts.
BACK, GROUND = 4.0, 40.0


def kinds(cp: np.ndarray) -> np.ndarray:
    """0 blank and other, 1 lower case letter, 2 capital, 3 digit, 4 letter without case."""
    return _kind_table()[cp]


_kinds: list[np.ndarray] = []


def _kind_table() -> np.ndarray:
    if not _kinds:
        t = np.zeros(0x110000, np.uint8)
        for c in range(0x30000):
            s = chr(c)
            if s.isdigit():
                t[c] = 3
            elif s.islower():
                t[c] = 1
            elif s.isupper():
                t[c] = 2
            elif s.isalpha():
                t[c] = 4
        _kinds.append(t)
    return _kinds[0]


def pair_slot(lang, prev, cur):
    return (mixed(lang.astype(U) << U(48) | prev.astype(U) << U(24) | cur.astype(U)) % U(PAIRS)).astype(np.int64)


def single_slot(lang, kind, cur):
    return (mixed(lang.astype(U) << U(40) | kind.astype(U) << U(32) | cur.astype(U)) % U(SINGLES)).astype(np.int64) + PAIRS


def total_slot(lang, kind):
    return PAIRS + SINGLES + lang.astype(np.int64) * 8 + kind


SIZE = PAIRS + SINGLES + (len(LANGS) + 1) * 8


def padded(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Previous and current character of every step, a blank before and behind each text; and the row."""
    lens = np.diff(offsets)
    row = np.repeat(np.arange(len(lens)), lens + 1)
    cur = np.full(len(cp) + len(lens), 0x20, np.int64)
    ends = offsets[1:] + np.arange(len(lens))
    inside = np.ones(len(cur), bool)
    inside[ends] = False
    cur[inside] = cp
    prev = np.empty_like(cur)
    prev[1:] = cur[:-1]
    prev[:1] = 0x20
    return prev, cur, row


class CharModel:
    """Log probabilities of texts; `counts` is one array of SIZE numbers."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.float64)

    def steps(self, lang, prev, cur):
        kind = kinds(prev)
        c, known = self.counts, native()[lang, cur]
        ground = np.where(known, 1e-4, 1e-7)
        near = (c[single_slot(lang, kind, cur)] + GROUND * ground) / (c[total_slot(lang, kind)] + GROUND)
        # how often prev came at all: as a current character after any kind
        before = sum(c[single_slot(lang, np.full(len(prev), k), prev)] for k in range(5))
        return np.log((c[pair_slot(lang, prev, cur)] + BACK * near) / (before + BACK))

    def score(self, cp: np.ndarray, offsets: np.ndarray, lang: np.ndarray, skip: int = -1) -> np.ndarray:
        """Log probability of each text in its language; steps from or to the character `skip` count nothing."""
        if len(offsets) == 1:
            return np.zeros(0)
        prev, cur, row = padded(cp, offsets)
        gain = self.steps(lang[row], prev, cur)
        return np.bincount(row, np.where((prev == skip) | (cur == skip), 0.0, gain), minlength=len(offsets) - 1)


def count(words: DataFrame) -> np.ndarray:
    """Counts over (text, lang, n) rows; texts with a character foreign to their language are left out, n weighs the rest."""

    def run(batches):
        for batch in batches:
            cp, offsets = flat(batch.column(0))
            lang = lang_index(batch.column(1).to_pylist())
            n = batch.column(2).to_numpy()
            lens = np.diff(offsets)
            foreign = np.bincount(np.repeat(np.arange(len(lens)), lens), ~native()[np.repeat(lang, lens), cp], minlength=len(lens)) > 0
            keep = ~foreign & (lang != UNKNOWN) & (lens > 0)
            prev, cur, row = padded(cp, offsets)
            on = keep[row]
            prev, cur, row = prev[on], cur[on], row[on]
            kind = kinds(prev)
            slot = np.concatenate([pair_slot(lang[row], prev, cur), single_slot(lang[row], kind, cur), total_slot(lang[row], kind)])
            total = np.bincount(slot, np.tile(n[row], 3).astype(np.float64), minlength=SIZE)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.float64())], names=["slot", "n"])

    got = words.mapInArrow(run, "slot long, n double").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SIZE, np.float32)
    counts[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return counts
