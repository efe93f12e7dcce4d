"""Streams with late data: sessions, joins of two streams, and tables that are brought up to date batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.lineage import folder


def read(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream of its files, with the table's own schema.

    A stream takes one file only where a pattern names it, so the last letter stands in brackets.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def sessions(events: DataFrame, time: str, by: list[str], gap: str = "30 minutes", delay: str = "1 hour", **totals) -> DataFrame:
    """``by, start, end, n`` and the named totals of each session that the watermark has passed.

    A session ends where nothing has come for ``gap``; what is later than ``delay`` behind the
    latest event is dropped, and the state holds open sessions only.
    """
    rows = events.withWatermark(time, delay).groupBy(*by, F.session_window(time, gap).alias("s"))
    return rows.agg(F.count("*").alias("n"), *[c.alias(n) for n, c in totals.items()]).select(*by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", *totals)


def within(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, gap: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Pairs of a left row and a right row of the same group at most ``gap`` after it, from two streams.

    Both sides have watermarks and the join bounds their times, so that rows that can meet nothing
    any more leave the state. Column names have to differ but for ``by``.
    """
    a, b = left.withWatermark(left_time, delay), right.withWatermark(right_time, delay)
    same = None
    for c in by:
        both = a[c] == b[c]
        same = both if same is None else same & both
    near = F.col(right_time).between(F.col(left_time), F.col(left_time) + F.expr(f"INTERVAL {gap}"))
    met = a.join(b, near if same is None else same & near)
    return met.select(*[a[c] for c in left.columns], *[b[c] for c in right.columns if c not in by])


def append_once(df: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process all that is available and return the table that the stream has appended so far.

    Files and progress are in the shared folder, so a second run goes on where the first one ended.
    """
    spark = df.sparkSession
    path = path or f"{folder(spark)}/lodestone-stream-{uuid.uuid4().hex}"
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint or f"{path}-progress").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


class Upserts:
    """A table of the latest row of each key, brought up to date by batches of a stream.

    A batch makes the version ``v=<its number>`` out of the last whole version below it. A batch
    that comes again, after a crash or because its progress was lost, overwrites its own version
    from the same base, so nothing counts twice. A version is whole once Spark's writer has
    committed it; readers take the last whole one. ``keep`` older versions stay.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, keep: int = 2):
        self.spark, self.path, self.key, self.order, self.keep = spark, path, key, order, keep

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        jvm, root, fs = self._fs()
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        whole = [n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in whole)

    def table(self) -> DataFrame | None:
        found = self.versions()
        return self.spark.read.parquet(f"{self.path}/v={found[-1]}") if found else None

    def apply(self, rows: DataFrame, batch: int) -> None:
        """Rows of equal order: the later column values win, so that the result doesn't depend on their sequence."""
        rest = [c for c in rows.columns if c not in (self.key, self.order)]
        before = [v for v in self.versions() if v < batch]
        if before:
            rows = rows.unionByName(self.spark.read.parquet(f"{self.path}/v={before[-1]}"))
        last = rows.groupBy(self.key).agg(F.max(F.struct(self.order, *rest)).alias("x"))
        last.select(self.key, "x.*").select(*rows.columns).write.mode("overwrite").parquet(f"{self.path}/v={batch}")
        jvm, _, fs = self._fs()
        for old in before[: -self.keep]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={old}"), True)

    def run(self, stream: DataFrame, checkpoint: str | None = None) -> DataFrame | None:
        """Process all that is available and return the table."""
        out = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint or f"{self.path}-progress").trigger(availableNow=True)
        out.start().awaitTermination()
        return self.table()
