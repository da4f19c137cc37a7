"""`spark.read.format("pdf_letters")`: letters of PDF files as a data source."""

from __future__ import annotations

import glob
import os

from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docveil.sources.listing import OUTPUT
from docveil.sources.pdf import LETTERS, document_letters

NULLS = (None,) * 7
#: Bytes of files that a partition takes together.
TARGET = 64 << 20


class PdfLetters(DataSource):
    """Option `path`: a folder (read at any depth), a file or a pattern. Small files share a partition."""

    @classmethod
    def name(cls) -> str:
        return "pdf_letters"

    def schema(self) -> str:
        return LETTERS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options.get("path", ""))


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        """Files in the order of their paths, packed up to TARGET bytes. The listing holds names and sizes alone, as every file index does."""
        fs, place = FileSystem.from_uri(uri(self.path)) if "*" not in self.path else (None, None)
        if fs is None:
            found = [(p, os.path.getsize(p)) for p in glob.glob(self.path.removeprefix("file://").removeprefix("file:"), recursive=True)]
        elif fs.get_file_info(place).type == FileType.Directory:
            found = [(x.path, x.size) for x in fs.get_file_info(FileSelector(place, recursive=True)) if x.type == FileType.File and x.path.endswith(".pdf")]
        else:
            found = [(x.path, x.size) for x in [fs.get_file_info(place)] if x.type == FileType.File]
        packs, room = [[]], TARGET
        for path, size in sorted(found):
            if path.endswith(OUTPUT):
                continue
            if packs[-1] and size > room:
                packs.append([])
                room = TARGET
            packs[-1].append(path)
            room -= size
        return [_Files(p) for p in packs]

    def read(self, partition):
        for path in partition.paths:
            yield from self.letters(path)

    def letters(self, path: str):
        try:
            fs = FileSystem.from_uri(uri(self.path))[0] if "*" not in self.path else LocalFileSystem()
            with fs.open_input_stream(path) as f:
                rows = document_letters(f.read())
        except Exception as e:  # one bad file must not end the job
            yield (path, *NULLS, f"{type(e).__name__}: {e}")
            return
        for x in rows:
            src = x["src"]
            yield (
                path, x["page_no"], x["seq"], x["value"], tuple(x["bbox"][k] for k in ("x", "y", "width", "height")), x["font_size"], x["baseline_y"],
                (src["op_index"], src["array_item"], src["byte_start"], src["byte_len"]), None,
            )


def uri(path: str) -> str:
    """A path as pyarrow's file systems take it: with a scheme, or absolute."""
    if path.startswith("file:") and not path.startswith("file://"):
        return "file://" + path.removeprefix("file:")
    return path if "://" in path else os.path.abspath(path)


def register(spark) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(PdfLetters)
