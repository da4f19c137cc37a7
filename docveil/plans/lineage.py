"""Cutting of lineage by the shared folder of the session."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A session without one gets a temporary folder if its executors are threads of this process; else this is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = _own.get(spark.sparkContext.applicationId)
    if found is None:
        found = _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="docveil-")
    return found


_own: dict[str, str] = {}


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and cuts its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
