"""Files to work on: folders and single files, without outputs and without what is done already."""

from __future__ import annotations

import os

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, functions as F

from docveil.functions.text import output_path

# What names of outputs end with, and the files that make a model folder.
OUTPUT = ".anon.pdf"
MODEL_FILES = ["model.onnx", "tokenizer.json", "config.json"]


FILE = "path string, modificationTime timestamp, length long"


def outermost(paths: list[str]) -> tuple[list[str], list[str]]:
    """(folders, files) of the given paths, without those that lie in another folder or come twice, so that nothing is listed twice."""
    every = list(dict.fromkeys(os.path.realpath(p) for p in paths))
    folders = [p for p in every if os.path.isdir(p)]
    inside = lambda p: any(p != f and os.path.commonpath([p, f]) == f for f in folders)
    return [f for f in folders if not inside(f)], [p for p in every if p not in folders and not (p.endswith(".pdf") and inside(p))]


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """FILE of the PDF files below folders, at any depth, and of named files of any extension; no content is read."""
    folders, files = outermost(paths)
    out = spark.createDataFrame([], FILE)
    if folders:
        out = out.unionByName(spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folders).drop("content"))
    if files:
        out = out.unionByName(spark.read.format("binaryFile").load(files).drop("content"))
    return out


def with_content(files: DataFrame) -> DataFrame:
    """path and content of listed files (path, length), dealt by size so that a task reads about as much as a task of a file scan.

    Contents are read in the tasks, after everything that needs paths alone; they are never
    shuffled. A file that can't be opened has null content.
    """
    spark = files.sparkSession
    size = files.agg(F.sum("length"), F.count("*")).first()
    # the setting comes as a number of bytes with "b" behind it, or with a unit
    target = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    tasks = max(1, min(size[1], max(spark.sparkContext.defaultParallelism, -(-int(size[0] or 0) // target))))

    def read(batches):
        for batch in batches:
            for path in batch["path"]:
                try:
                    fs, place = FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:"))
                    with fs.open_input_stream(place) as f:
                        content = f.read()
                except (OSError, pa.ArrowException):
                    content = None
                yield pd.DataFrame({"path": [path], "content": [content]})

    return files.select("path").repartition(tasks).mapInPandas(read, "path string, content binary")


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and content of all files that listed() gives."""
    return with_content(listed(spark, paths))


def pending(files: DataFrame, listed: DataFrame | None = None, path_col: str = "path") -> DataFrame:
    """files that are no outputs and whose output isn't listed. Null paths are left out.

    `listed` is the listing that outputs are looked for in, by default files itself. A
    left anti join on the output's path; nothing is collected.
    """
    outputs = (listed if listed is not None else files).where(F.col(path_col).endswith(OUTPUT)).select(F.col(path_col).alias("done_path")).distinct()
    inputs = files.where(F.col(path_col).isNotNull() & ~F.col(path_col).endswith(OUTPUT))
    return inputs.join(outputs, output_path(F.col(path_col)) == F.col("done_path"), "left_anti")


def model_folder(start: str, installed: str | None = None) -> str | None:
    """The `models` folder that has the files of a text model: the installed one, else the first of the parents of `start`."""
    def complete(folder: str) -> bool:
        return all(os.path.isfile(os.path.join(folder, "pii", f)) for f in MODEL_FILES)

    if installed and complete(os.path.join(installed, "models")):
        return os.path.join(installed, "models")
    at = os.path.abspath(start)
    while True:
        if complete(os.path.join(at, "models")):
            return os.path.join(at, "models")
        above = os.path.dirname(at)
        if above == at:
            return None
        at = above
