"""Append-only logs as streams: the latest row of each key, and what is new since the last run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_stream(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key of a stream, as an aggregate whose state is one row a key."""
    rest = [c for c in log.columns if c not in (key, order)]
    return log.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in (order, *rest)])


def deduplicated_stream(log: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Rows of a stream without repeated keys; keys are forgotten behind the watermark."""
    return log.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(log: DataFrame, time: str, by: list[str], size: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Rows per window and group, complete once the watermark has passed a window."""
    return log.withWatermark(time, delay).groupBy(F.window(time, size).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Process all that is available into a memory table and stop; progress stays in the checkpoint."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
