"""Token classification: windows, inference, decoding to entities, merging.

The model is a pluggable scorer: a function from (ids, mask) arrays of shape (windows,
MAX_TOKENS) to logits (windows, MAX_TOKENS, labels). `onnx_scorer` makes one from a model
folder; tests give their own. Inference errors leave a paragraph without entities and put
the message in `error`.
"""

from __future__ import annotations

import json
import os
import string
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

# Tokens a window, the label that is dropped.
MAX_TOKENS = 512
DROPPED = "ORG"
OUTSIDE = "O"
PUNCTUATION = set(string.punctuation)
#: Rows of entities that are handed on together, about.
BATCH_ROWS = 20_000
ENTITY = "start_pos int, end_pos int, label string, score float, error string"


def labels_of(config: str) -> list[str]:
    """Labels of a model's configuration, in the order of their numbers; entries without a number are left out."""
    table = json.loads(config).get("id2label") or {}
    numbered = [(int(k), v) for k, v in table.items() if str(k).lstrip("-").isdigit() and isinstance(v, str)]
    return [v for _, v in sorted(numbered)]


def bio(label: str) -> tuple[str, str]:
    """("B" or "I", tag). A label without such a prefix begins an entity."""
    for sign in "-_":
        head, found, tag = label.partition(sign)
        if found and head in ("B", "I"):
            return head, tag
    return "B", label


def predictions(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and confidence (softmax) of each token; of equal logits the last class."""
    if logits.shape[-1] == 0:
        return np.zeros(len(logits), np.int64), np.zeros(len(logits), np.float32)
    last = logits.shape[-1] - 1 - np.argmax(logits[:, ::-1], 1)
    top = logits.max(1, keepdims=True)
    return last, (1 / np.exp(logits - top).sum(1)).astype(np.float32)


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without white space at its ends, then without ASCII punctuation behind, then before."""
    if start >= len(text) or end <= start:
        return start, end
    end = min(end, len(text))
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    while end > start and text[end - 1] in PUNCTUATION:
        end -= 1
    while start < end and text[start] in PUNCTUATION:
        start += 1
    return start, end


@lru_cache(16)
def _tags(labels: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Of each label, and of OUTSIDE behind them: whether it makes an entity, whether it goes on with one, the number of its tag; and the tags."""
    parts = [bio(x) for x in (*labels, OUTSIDE)]
    tags = list(dict.fromkeys(t for _, t in parts))
    makes = [x != OUTSIDE and t != DROPPED for x, (_, t) in zip((*labels, OUTSIDE), parts)]
    return np.array(makes), np.array([p == "I" for p, _ in parts]), np.array([tags.index(t) for _, t in parts]), tags


def _means(scores: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Mean of each range of scores, those of equal length together."""
    out, sizes = np.zeros(len(low), np.float32), high - low
    for n in np.unique(sizes):
        own = np.flatnonzero(sizes == n)
        out[own] = scores[low[own, None] + np.arange(n)].mean(1)
    return out


def decode_window(text: str, tokens: list[str], offsets: list[tuple[int, int]], special: list[bool], classes, scores, labels: list[str]) -> list[tuple[int, int, str, float]]:
    """Entities (start, end, label, score) of one window.

    While an entity is open, a token that touches the one before it extends it, whatever
    its label; only then do labels count. Special tokens neither extend nor close. So of
    each chain of tokens that touch, the first one with a tag decides: it opens an entity
    that begins with the chain, or goes on with that of the chain before if it is the
    chain's first and inside of the same tag; the rest of the chain belongs to it.
    """
    n = len(offsets)
    if not n:
        return []
    at = np.asarray(offsets, np.int64).reshape(n, 2)
    low, high = at[:, 0], at[:, 1]
    hidden = np.array(special, bool)
    for i in np.flatnonzero((low == 0) & (high == 0) & ~hidden):
        hidden[i] = tokens[i].startswith("[")
    touching = np.zeros(n, bool)
    touching[1:] = ~hidden[:-1] & (high[:-1] == low[1:])
    makes, inside, number, tags = _tags(tuple(labels))
    kind = np.minimum(np.asarray(classes, np.int64), len(labels))
    first = np.flatnonzero(~touching)
    chain = np.cumsum(~touching) - 1
    hit = np.flatnonzero(makes[kind] & ~hidden)
    if not len(hit):
        return []
    hit = hit[np.diff(chain[hit], prepend=-1) > 0]
    own = chain[hit]
    tag, place = number[kind[hit]], np.cumsum(~hidden[first])[own]
    on = (hit == first[own]) & inside[kind[hit]]
    on &= (np.diff(place, prepend=-1) == 1) & (np.diff(tag, prepend=-1) == 0)
    begin = np.flatnonzero(~on)
    last = np.append(begin[1:], len(hit)) - 1
    starts, ends = hit[begin], np.append(first[1:], n)[own[last]]
    tops = np.maximum.reduceat(np.append(np.where(hidden, 0, high), 0), np.stack([starts, ends], 1).ravel())[::2]
    seen = np.flatnonzero(~hidden)
    means = _means(np.asarray(scores, np.float32)[seen], np.searchsorted(seen, starts), np.searchsorted(seen, ends))
    out = []
    for a, b, t, score in zip(low[first[own[begin]]].tolist(), tops.tolist(), tag[begin].tolist(), means.tolist()):
        a, b = trimmed(text, a, b)
        if b > a:
            out.append((a, b, tags[t], score))
    return out


def merged(text: str, entities: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Neighbours of one label with only white space or nothing between them made one; scores are averaged pair by pair."""
    out: list[tuple[int, int, str, float]] = []
    for start, end, label, score in entities:
        if out and out[-1][2] == label and start >= out[-1][1] and not text[out[-1][1] : start].strip():
            a, _, _, before = out[-1]
            out[-1] = (*trimmed(text, a, end), label, (before + score) / 2)
        else:
            out.append((start, end, label, score))
    return out


@lru_cache(2)
def onnx_scorer(folder: str) -> tuple[Callable, object, list[str]]:
    """(scorer, tokenizer, labels) of a model folder; opened once for each Python worker."""
    import onnxruntime
    from tokenizers import Tokenizer

    session = onnxruntime.InferenceSession(os.path.join(folder, "model.onnx"), providers=["CPUExecutionProvider"])
    names = {i.name for i in session.get_inputs()}
    tokenizer = Tokenizer.from_file(os.path.join(folder, "tokenizer.json"))
    with open(os.path.join(folder, "config.json"), encoding="utf-8") as f:
        labels = labels_of(f.read())

    def score(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        feed = {"input_ids": ids, "attention_mask": mask}
        if "token_type_ids" in names:
            feed["token_type_ids"] = np.zeros_like(ids)
        return session.run(None, feed)[0]

    return score, tokenizer, labels


def analyze(text: str, tokenizer, score: Callable, labels: list[str]) -> list[tuple[int, int, str, float]]:
    """Entities of a text: windows of MAX_TOKENS tokens without overlap, padded with zeros. Blank texts have none."""
    if not text or not text.strip():
        return []
    enc = tokenizer.encode(text)
    n = len(enc.ids)
    windows = -(-n // MAX_TOKENS)
    ids, mask = np.zeros((windows, MAX_TOKENS), np.int64), np.zeros((windows, MAX_TOKENS), np.int64)
    ids.ravel()[:n], mask.ravel()[:n] = enc.ids, enc.attention_mask
    logits = np.asarray(score(ids, mask), np.float32)
    # each of these makes a list of all tokens anew
    tokens, offsets, special = enc.tokens, enc.offsets, enc.special_tokens_mask
    found: list[tuple[int, int, str, float]] = []
    for k in range(windows):
        own = slice(k * MAX_TOKENS, min(n, (k + 1) * MAX_TOKENS))
        size = own.stop - own.start
        classes, scores = predictions(logits[k, :size])
        found += decode_window(text, tokens[own], offsets[own], special[own], classes, scores, labels)
    return merged(text, found)


def ner_spans(paragraphs: DataFrame, keys: list[str], load: Callable[[], tuple[Callable, object, list[str]]]) -> DataFrame:
    """keys, start_pos, end_pos, label, score, error of each paragraph's entities.

    `load` gives (scorer, tokenizer, labels) in the worker. A paragraph whose inference
    fails gives one row with the message and null positions.
    """
    taken = paragraphs.select(*keys, "text")
    n = len(keys)

    def made(batch, place: list[int], rows: list[tuple]):
        at = pa.array(place, pa.int64())
        values = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string(), pa.float32(), pa.string()))]
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(n)), *values], names=[*keys, "start_pos", "end_pos", "label", "score", "error"])

    def run(batches):
        score, tokenizer, labels = load()
        for batch in batches:
            place, rows = [], []
            for i, text in enumerate(batch.column(n)):
                try:
                    own = [(*e, None) for e in analyze(text.as_py(), tokenizer, score, labels)]
                except Exception as e:  # the document goes on without the model's finds
                    own = [(None, None, None, None, repr(e))]
                rows += own
                place += [i] * len(own)
                if len(rows) >= BATCH_ROWS:
                    yield made(batch, place, rows)
                    place, rows = [], []
            if rows:
                yield made(batch, place, rows)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[:-1]), ENTITY])
    return taken.mapInArrow(run, schema)


def merge_adjacent(spans: DataFrame, paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """merged() as window functions over a table of spans: keys, start_pos, end_pos, label, score, n_parts.

    Spans are taken in the order of start, end, label, score within a paragraph; positions
    are assumed to be trimmed.
    """
    rows = spans.select(*keys, "start_pos", "end_pos", "label", "score").join(paragraphs.select(*keys, "text"), keys)
    w = W.partitionBy(*keys).orderBy("start_pos", "end_pos", "label", "score")
    end, label = F.lag("end_pos").over(w), F.lag("label").over(w)
    between = F.substring(F.col("text"), end + 1, F.col("start_pos") - end)
    joined = label.eqNullSafe(F.col("label")) & (F.col("start_pos") >= end) & F.regexp_like(between, F.lit(r"(?U)^\s*$"))
    rows = rows.withColumn("new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    parts = F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "score")))
    out = rows.groupBy(*keys, "island", "label").agg(F.min("start_pos").alias("start_pos"), F.max_by("end_pos", F.struct("start_pos", "end_pos")).alias("end_pos"), parts.alias("parts"))
    scores = F.transform("parts", lambda p: p["score"].cast("double"))
    mean = F.aggregate(F.slice(scores, 2, F.size(scores)), F.get(scores, F.lit(0)), lambda a, x: (a + x) / 2)
    return out.select(*keys, "start_pos", "end_pos", "label", mean.alias("score"), F.size("parts").alias("n_parts"))
