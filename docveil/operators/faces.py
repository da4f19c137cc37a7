"""Images with faces: preparation, classification by a pluggable scorer, and the mark to purge."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from docveil.plans.lineage import shared_folder
from docveil.sinks import pdf_writer

# Size of the model's picture, its scaling, and the score above which a box is a face.
WIDTH, HEIGHT = 320, 240
MEAN, SCALE = 127.0, 128.0
THRESHOLD = 0.7
#: Pictures whose answers a task remembers, so that equal ones are scored once; then it begins anew.
REMEMBERED = 100_000


@lru_cache(64)
def triangle(size_in: int, size_out: int) -> np.ndarray:
    """Weights (out, in) of a resize with the triangle filter, widened when it makes smaller."""
    ratio = size_in / size_out
    reach = max(1.0, ratio)
    centre = (np.arange(size_out) + 0.5) * ratio
    place = np.arange(size_in) + 0.5
    weights = np.clip(1 - np.abs(place[None, :] - centre[:, None]) / reach, 0, None)
    return weights / weights.sum(1, keepdims=True)


def tensor(rgb: np.ndarray) -> np.ndarray:
    """(1, 3, HEIGHT, WIDTH) float32 from a picture (height, width, 3) of bytes."""
    h, w, _ = rgb.shape
    parts = "yh,hwc,xw->yxc", triangle(h, HEIGHT), rgb.astype(np.float64), triangle(w, WIDTH)
    small = np.einsum(*parts, optimize=_path(h, w))
    small = np.clip(np.rint(small), 0, 255)
    return ((small - MEAN) / SCALE).transpose(2, 0, 1)[None].astype(np.float32)


@lru_cache(64)
def _path(h: int, w: int) -> list:
    """The order of products that is best for pictures of this size."""
    return np.einsum_path("yh,hwc,xw->yxc", np.empty((HEIGHT, h)), np.empty((h, w, 3)), np.empty((WIDTH, w)), optimize="greedy")[0]


def has_face(scores: np.ndarray) -> bool:
    """Whether any box of scores (1, boxes, 2) is a face; fewer than three dimensions mean none."""
    return scores.ndim >= 3 and bool((scores.reshape(-1, 2)[:, 1] > THRESHOLD).any())


@lru_cache(1)
def onnx_faces(folder: str) -> Callable[[np.ndarray], np.ndarray]:
    """Scorer of a model folder; opened once for each Python worker."""
    import onnxruntime

    session = onnxruntime.InferenceSession(os.path.join(folder, "model.onnx"), providers=["CPUExecutionProvider"])
    name = session.get_inputs()[0].name
    return lambda x: session.run(None, {name: x})[0]


def from_image_source(images: DataFrame, load: Callable[[], Callable], folder: str | None = None) -> DataFrame:
    """marked() for image files that the engine's own image source can decode, JPEG and PNG among them.

    The contents are written to a new folder below the shared one and read back as pixels.
    What the source can't decode counts as without a face.
    """
    folder = folder or f"{shared_folder(images.sparkSession)}/faces-{uuid.uuid4().hex}"
    name = F.concat(F.sha2(F.col("doc"), 256), F.lit("-"), F.col("obj_id").cast("string"), F.lit(".img"))
    rows = images.where("content is not null").select("doc", "obj_id", "content", name.alias("name"))
    os.makedirs(folder.removeprefix("file://").removeprefix("file:"), exist_ok=True)
    pdf_writer.write_files(rows.select(F.concat(F.lit(folder + "/"), "name").alias("path"), "content"))
    read = images.sparkSession.read.format("image").option("dropInvalid", "false").load(folder)
    pixels = read.select(F.regexp_extract("image.origin", "([^/]*)$", 1).alias("name"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")

    def run(batches):
        score = load()
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                try:
                    if r.height <= 0:
                        raise ValueError("no image")
                    bgr = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.channels)
                    rgb = bgr[:, :, 2::-1] if r.channels >= 3 else np.repeat(bgr, 3, 2)
                    out.append((r.name, has_face(np.asarray(score(tensor(rgb)))), None))
                except Exception as e:
                    out.append((r.name, False, repr(e)))
            yield pd.DataFrame(out, columns=["name", "has_face", "error"])

    found = pixels.mapInPandas(run, "name string, has_face boolean, error string")
    every = images.select("doc", "obj_id", name.alias("name")).join(found, "name", "left")
    return every.select("doc", "obj_id", F.coalesce("has_face", F.lit(False)).alias("has_face"), F.when(F.col("has_face").isNull(), F.lit("no content")).otherwise(F.col("error")).alias("error"))


def marked(images: DataFrame, load: Callable[[], Callable], decode: Callable[[bytes], np.ndarray]) -> DataFrame:
    """images (doc, obj_id, content) as doc, obj_id, has_face, error.

    `decode` turns the bytes of an image file into (height, width, 3). What can't be
    decoded or scored counts as without a face and carries the message. Equal contents are
    scored once in a task; a failure isn't remembered.
    """

    def run(batches):
        score, known = load(), {}
        for batch in batches:
            rows = []
            for doc, obj, content in batch.itertuples(index=False):
                try:
                    raw = bytes(content)
                    key = hashlib.sha256(raw).digest()
                    if key not in known:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[key] = has_face(np.asarray(score(tensor(decode(raw)))))
                    rows.append((doc, obj, known[key], None))
                except Exception as e:
                    rows.append((doc, obj, False, repr(e)))
            yield pd.DataFrame(rows, columns=["doc", "obj_id", "has_face", "error"])

    return images.select("doc", "obj_id", "content").mapInPandas(run, "doc string, obj_id int, has_face boolean, error string")
