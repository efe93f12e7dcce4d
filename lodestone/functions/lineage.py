"""Cutting the lineage of a table that several branches of a plan read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The reliable folder of ``spark.checkpoint.dir``; a temp folder only on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint."""
    folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the checkpoint folder.

    A checkpoint keeps the size that the planner guessed for its plan, and a loop of joins
    multiplies these guesses; a table has the size of its files.
    """
    path = f"{folder(df.sparkSession)}/lodestone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
