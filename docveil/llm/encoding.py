"""Encoding of texts with a public byte-level BPE vocabulary.

Texts are cut into the pieces that the vocabulary's split pattern defines by gathers on a
table of character classes; equal pieces of a batch are encoded once: pieces in the
lexicon (see lexicon.py) by walking the transducer, others by exact merging. Scaling is
by documents alone: one scan, no shuffle, no driver-side work that grows with the data.

Null and empty texts have no ids. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
import tempfile
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from docveil.llm.codepoints import flat, groups, ragged
from docveil.llm.lexicon import Lexicon
from docveil.llm.window_hash import WindowHash
from docveil.plans.lineage import shared_folder

TOKENIZERS = os.environ.get("DOCVEIL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
CHUNK = 1 << 19
#: Merged pieces that a worker remembers; the memory is emptied when full, results don't depend on it.
REMEMBER = 400_000
#: The split pattern of the vocabulary, and the characters that \s stands for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = range(4)


@lru_cache(1)
def classes() -> np.ndarray:
    table = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    table[SPACES] = SPACE
    return table


def pieces(cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces of the split pattern; no piece crosses a text."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[cp]
    cut = np.zeros(n + 1, bool)
    cut[1:n] = kind[1:] != kind[:-1]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    cut |= first
    cut[n] = first[n] = True
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    run = kind[start]
    piece = cut[:n].copy()
    # white space before something: its last character stands alone or, if a blank, joins what follows
    before = (run == SPACE) & ~first[end]
    last = end[before] - 1
    piece[last] = True
    piece[end[before][cp[last] == 0x20]] = False
    # an apostrophe that no blank precedes, and the endings of the pattern
    apostrophe = (run == OTHER) & (end - start == 1) & (cp[start] == 0x27) & piece[start] & ~first[end]
    at = end[apostrophe]
    if len(at):
        pad = np.concatenate([cp, np.zeros(2, cp.dtype)])
        a, b = pad[at], pad[at + 1]
        inside = ~first[np.minimum(at + 1, n)]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = inside & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        piece[at[one | two]] = False
        after = np.concatenate([at[one] + 1, at[two] + 2])
        after = after[after < n]
        piece[after] = True
    return np.flatnonzero(piece)


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


@lru_cache(2)
def merger(path: str):
    import tiktoken

    return tiktoken.Encoding("docveil", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def vocabulary_words(path: str) -> dict[str, list[int]]:
    """Entries of the vocabulary that are whole pieces by themselves, the frequent words of its making, with their id."""
    words = {}
    for raw, rank in ranks(path).items():
        try:
            word = raw.decode()
        except UnicodeDecodeError:
            continue
        words[word] = [rank]
    joined = "".join(words)
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    cp = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    starts = pieces(cp, offsets)
    whole = np.bincount(np.searchsorted(offsets, starts, "right") - 1, minlength=len(words)) == 1
    return {w: i for (w, i), one in zip(words.items(), whole) if one}


def build_folder(spark: SparkSession) -> str:
    """Where the driver writes the lexicon before addFile() hands it to the executors: in the shared folder if the driver can write there as in a file system, else beside the driver alone."""
    named = shared_folder(spark)
    return named.removeprefix("file://").removeprefix("file:") if named.startswith("file:") or "://" not in named else tempfile.mkdtemp(prefix="docveil-")


_shipped: dict[tuple, str] = {}


def ship_lexicon(spark: SparkSession, path: str, extra: dict[str, list[int]] | None = None) -> str:
    """Compiles the lexicon, hands its file to all executors and gives its name. Its size is that of the vocabulary and `extra`."""
    key = (spark.sparkContext.applicationId, path, None if extra is None else tuple(sorted(extra)))
    if key not in _shipped:
        entries = vocabulary_words(path) | (extra or {})
        file = Lexicon.of(entries).save(os.path.join(build_folder(spark), "docveil"))
        spark.sparkContext.addFile(file)
        _shipped[key] = os.path.basename(file)
    return _shipped[key]


def equal_pieces(cp: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each set of equal pieces, and for every piece which one; a piece that only has another's hash stands for itself."""
    _, first, back = np.unique(WindowHash(cp).at(starts, sizes), return_index=True, return_inverse=True)
    model = first[back]
    other = sizes != sizes[model]
    inside, offset = ragged(sizes), np.repeat(np.where(other, 0, starts[model] - starts), sizes)
    own = np.repeat(starts, sizes) + inside
    differs = np.add.reduceat(cp[own] != cp[own + offset], np.cumsum(sizes) - sizes) > 0
    alone = np.flatnonzero(other | differs)
    if len(alone):
        back = back.copy()
        back[alone] = len(first) + np.arange(len(alone))
        first = np.concatenate([first, alone])
    return first, back


class Encoder:
    """Encodes batches; one for each worker and lexicon."""

    def __init__(self, path: str, lexicon: Lexicon):
        self.path, self.lexicon = path, lexicon
        self.memory: dict[str, list[int]] = {}

    def merged(self, word: str) -> list[int]:
        ids = self.memory.get(word)
        if ids is None:
            if len(self.memory) >= REMEMBER:
                self.memory.clear()
            ids = self.memory[word] = merger(self.path).encode_ordinary(word)
        return ids

    def distinct(self, cp: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their offsets for distinct pieces."""
        lex = self.lexicon
        number = lex.number(cp, start, size)
        known = number >= 0
        lens = np.zeros(len(start), np.int64)
        lens[known] = np.diff(lex.id_offsets)[number[known]]
        fresh = np.flatnonzero(~known)
        rest: list[list[int]] = []
        if len(fresh):
            at = start[fresh], size[fresh]
            text = cp[np.repeat(at[0], at[1]) + ragged(at[1])].astype("<u4").tobytes().decode("utf-32-le", "replace")
            ends = np.cumsum(at[1]).tolist()
            rest = [self.merged(text[i:j]) for i, j in zip([0, *ends], ends)]
            lens[fresh] = [len(x) for x in rest]
        offsets = np.concatenate([[0], np.cumsum(lens)])
        ids = np.empty(offsets[-1], np.int32)
        for which, values in ((np.flatnonzero(known), None), (fresh, rest)):
            to = np.repeat(offsets[which], lens[which]) + ragged(lens[which])
            if values is None:
                first = lex.id_offsets[number[which]]
                ids[to] = lex.ids[np.repeat(first, lens[which]) + ragged(lens[which])]
            elif len(which):
                ids[to] = np.fromiter(chain.from_iterable(values), np.int32, len(to))
        return ids, offsets

    def __call__(self, cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
        """Flat ids of all texts and their offsets."""
        starts = pieces(cp, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        sizes = np.diff(np.append(starts, len(cp)))
        first, back = equal_pieces(cp, starts, sizes)
        ids, at = self.distinct(cp, starts[first], sizes[first])
        lens = np.diff(at)[back]
        out = ids[np.repeat(at[:-1][back], lens) + ragged(lens)]
        total = np.concatenate([[0], np.cumsum(lens)])
        return out, total[np.searchsorted(starts, offsets, "left")]

    def counts(self, cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of ids of each text, without writing them out."""
        starts = pieces(cp, offsets)
        if not len(starts):
            return np.zeros(len(offsets) - 1, np.int64)
        sizes = np.diff(np.append(starts, len(cp)))
        first, back = equal_pieces(cp, starts, sizes)
        _, at = self.distinct(cp, starts[first], sizes[first])
        total = np.concatenate([[0], np.cumsum(np.diff(at)[back])])
        return np.diff(total[np.searchsorted(starts, offsets, "left")])


@lru_cache(2)
def worker_encoder(path: str, file: str) -> Encoder:
    return Encoder(path, Lexicon.load(SparkFiles.get(file)))


def _path(folder: str, vocabulary: str) -> str:
    return os.path.join(folder, f"{vocabulary}.tiktoken")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids array<int>) for every row; duplicate rows are kept as they come."""
    path = _path(folder, vocabulary)
    file = ship_lexicon(docs.sparkSession, path)

    def run(batches):
        encoder = worker_encoder(path, file)
        for batch in batches:
            cp, offsets = flat(batch.column(1))
            for i, j in groups(offsets, CHUNK):
                ids, at = encoder(cp[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(docs: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """Columns `keep` and n_tokens (long) for every row."""
    path = _path(folder, vocabulary)
    file = ship_lexicon(docs.sparkSession, path)
    taken = docs.select(*keep, F.col(text_col).cast("string").alias("text_to_count"))

    def run(batches):
        encoder = worker_encoder(path, file)
        for batch in batches:
            cp, offsets = flat(batch.column(batch.num_columns - 1))
            n = [encoder.counts(cp[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in groups(offsets, CHUNK)]
            counted = np.concatenate(n) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counted, pa.int64())], names=[*keep, "n_tokens"])

    schema = taken.drop("text_to_count").schema.add("n_tokens", "long")
    return taken.mapInArrow(run, schema)
