"""Redacted PDF files: text erased at its source, boxes over it, images with faces emptied."""

from __future__ import annotations

import os
import zlib
from collections import defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docveil.plans.lineage import checkpointed
from docveil.sources.pdf import operations
from docveil.sources.pdf_objects import Document, Keyword, Name, Ref, Stream, save, written

# Margin and line width of a box, its fill and its line.
MARGIN, LINE = 1.0, 1.0
FILL, BORDER = [1.0, 1.0, 1.0], [0.0, 0.0, 0.0]

OUT_ARROW = pa.schema([("doc", pa.string()), ("content", pa.binary()), ("n_pages", pa.int32()), ("n_images", pa.int32()), ("error", pa.string())])
OUT = "doc string, content binary, n_pages int, n_images int, error string"


def erased(content: bytes, letters: list[dict]) -> bytes:
    """The content stream with the bytes of the given letters (their src) set to zero."""
    by_op: dict[int, list[dict]] = defaultdict(list)
    for x in letters:
        by_op[x["op_index"]].append(x)
    out = []
    for k, (name, args, start, end) in enumerate(operations(content)):
        if k not in by_op:
            out.append(content[start:end].strip(b"\r\n\t "))
            continue
        for x in by_op[k]:
            holder, place = (args[0], int(x["array_item"])) if x["array_item"] is not None and args and isinstance(args[0], list) else (args, -1)
            if holder and -1 <= place < len(holder) and isinstance(holder[place], bytes):
                raw = bytearray(holder[place])
                first, n = x["byte_start"], x["byte_len"]
                raw[first : first + n] = bytes(len(raw[first : first + n]))
                holder[place] = bytes(raw)
        out.append(b" ".join([*map(written, args), written(Keyword(name))]))
    return b"\n".join(out)


def boxes(words: list[dict]) -> bytes:
    """Operators that draw a filled and bordered box over each word's bbox."""
    out = []
    for b in words:
        rect = [b["x"] - MARGIN, b["y"] - MARGIN, b["width"] + 2 * MARGIN, b["height"] + 2 * MARGIN]
        for args, op in (([], "q"), ([LINE], "w"), (FILL, "rg"), (BORDER, "RG"), (rect, "re"), ([], "B"), ([], "Q")):
            out.append(b" ".join([*(written(float(a)) for a in args), op.encode()]))
    return b"\n".join(out)


def redact(data: bytes, targets: list[dict], faces: list[int] = ()) -> bytes:
    """The file rewritten. targets: page_no, bbox and letters (src) of each word; faces: object numbers of images.

    Only pages with targets get new content; metadata, annotations and form fields stay.
    """
    doc = Document(data)
    changed: dict[int, object] = {}
    fresh = max(doc.places, default=0) + 1
    by_page: dict[int, list[dict]] = defaultdict(list)
    for t in targets:
        by_page[int(t["page_no"])].append(t)
    for n, (num, page) in enumerate(doc.pages(), 1):
        words = by_page.get(n)
        if not words:
            continue
        content = erased(doc.content(page), [x for w in words for x in w["letters"]])
        body = b"q\n" + content + b"\nQ\n" + boxes([w["bbox"] for w in words]) + b"\n"
        changed[fresh] = compressed(body)
        own = doc.get(Ref(num)) if num else page
        changed[num] = {**own, "Contents": Ref(fresh)}
        fresh += 1
    for num in faces:
        image = doc.get(Ref(int(num)))
        if isinstance(image, Stream):
            empty = compressed(b"")
            changed[int(num)] = Stream({**{k: v for k, v in image.dict.items() if k != "DecodeParms"}, **empty.dict}, empty.data)
    return save(doc, changed)


def compressed(body: bytes) -> Stream:
    return Stream({"Filter": Name("FlateDecode")}, zlib.compress(body))


def redacted(files: DataFrame, targets: DataFrame, faces: DataFrame | None = None, doc_col: str = "path", content_col: str = "content") -> DataFrame:
    """OUT rows: the new content of every file. A file that can't be read has null content and a message.

    targets: doc, page_no, bbox, letters array<struct<op_index,array_item,byte_start,byte_len>>;
    faces: doc, obj_id. They are gathered per document, which the format makes one unit.
    """
    own = targets.groupBy("doc").agg(F.collect_list(F.struct("page_no", "bbox", "letters")).alias("targets"))
    rows = files.select(F.col(doc_col).alias("doc"), F.col(content_col).alias("content")).join(own, "doc", "left")
    if faces is not None:
        rows = rows.join(faces.groupBy("doc").agg(F.collect_set("obj_id").alias("faces")), "doc", "left")
    else:
        rows = rows.withColumn("faces", F.lit(None).cast("array<int>"))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                words, images = r["targets"] or [], r["faces"] or []
                try:
                    if r["content"] is None:
                        raise ValueError("no content")
                    out.append({"doc": r["doc"], "content": redact(r["content"], words, images), "n_pages": len({w["page_no"] for w in words}), "n_images": len(images)})
                except Exception as e:
                    out.append({"doc": r["doc"], "n_pages": 0, "n_images": 0, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(out, schema=OUT_ARROW)

    return rows.mapInArrow(run, OUT)


def write_files(rows: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Writes binary or text content to the paths of the rows, each by a temporary name first. Gives path and error, null where the file was written.

    Tasks write where their worker sees the path: a shared file system on a cluster. A
    task that runs twice writes the same bytes. A row without content isn't written and
    hands on its own `error`. The state of every file is kept in the shared folder, so that
    nothing is written again when it is read.
    """
    message = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")

    def run(batches):
        for batch in batches:
            out = []
            for path, content, error in batch.itertuples(index=False):
                if path is None:
                    continue
                if content is None:
                    out.append((path, error or "no content"))
                    continue
                place = path.removeprefix("file://").removeprefix("file:")
                part = f"{place}.{os.getpid()}.part"
                try:
                    with open(part, "wb") as f:
                        f.write(content.encode("utf-8") if isinstance(content, str) else bytes(content))
                    os.replace(part, place)
                    out.append((path, None))
                except OSError as e:
                    out.append((path, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "error"])

    return checkpointed(rows.select(path_col, content_col, message.alias("error")).mapInPandas(run, "path string, error string"))


def failures(state: DataFrame, stage: str) -> DataFrame:
    """doc (the path that couldn't be written), stage and error."""
    return state.where("error is not null").select(F.col("path").alias("doc"), F.lit(stage).alias("stage"), "error")


def written_files(state: DataFrame) -> int:
    return state.where("error is null").count()
