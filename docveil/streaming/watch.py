"""Folders watched for new files, as a stream of files through the same pipeline."""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docveil.plans import pipeline
from docveil.sources import listing

#: Files taken at once, and the delay between looks at the folder.
FILES_AT_ONCE, EVERY = 4, "200 milliseconds"
log = logging.getLogger("docveil")
FILE = "path string, modificationTime timestamp, length long, content binary"


def files(spark: SparkSession, folder: str, at_once: int = FILES_AT_ONCE) -> DataFrame:
    """A stream of the folder's PDF files, not of those below it; outputs are left out."""
    stream = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", at_once).load(folder)
    return stream.where(~stream.path.endswith(listing.OUTPUT))


def start(spark: SparkSession, folder: str | None, checkpoint: str, ner=None, faces=None, once: bool = False, handle=None) -> StreamingQuery | None:
    """Catches up with what lies in the folder, at any depth, then redacts every new file.

    Gives None, and only a warning, for a folder that isn't set or isn't there. Files whose
    output exists already are passed over, so a batch that runs again does no harm. Files
    should be moved into the folder when they are whole.
    """
    if not folder or not os.path.isdir(folder):
        log.warning("no folder to watch: %s", folder)
        return None
    handle = handle or (lambda todo: pipeline.write(todo, ner, faces))
    handle(listing.with_content(listing.pending(listing.listed(spark, [folder]))))

    def batch(df: DataFrame, _: int) -> None:
        outputs = spark.read.format("binaryFile").option("pathGlobFilter", "*" + listing.OUTPUT).load(folder).select("path")
        handle(listing.pending(df, outputs).select("path", "content"))

    writer = files(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).queryName("docveil")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=EVERY)).start()


def masked_stream(stream: DataFrame, keys: list[str]) -> DataFrame:
    """masked_texts() of a stream of texts; no state is kept."""
    return pipeline.masked_texts(stream, keys)
