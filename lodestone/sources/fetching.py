"""Pages from the web as a Python data source that a plan can read, and a store that is filled run by run.

The addresses to fetch are a table that Spark deals out by host, a file per task, so that one host's
pages are fetched one after the other with a pause, and hosts side by side. Each file is a
partition of the source.
"""

from __future__ import annotations

import datetime
import importlib
import re
import time
import uuid
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.functions.lineage import folder
from lodestone.sources.tables import remaining

#: Scheme and host of an address.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*"
SCHEMA = "key string, url string, html string, error string, tries int, fetched_at timestamp"


def _opened(path: str):
    """The file system of a path and the path within it, for any scheme pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else re.sub("^file:", "", path))


class _File(InputPartition):
    pass


class PageSource(DataSource):
    """``spark.read.format("web_pages")`` with these options.

    ``urls``: folder of Parquet files with ``key`` and ``url``; ``client``: ``module:function``, a
    function (of ``argument``, where one is set) that gives a function from an address to its page; ``delay``: seconds
    between two requests to a host; ``tries``; ``wait``: seconds before a second try, growing with each.
    """

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.urls, self.client, self.argument = options["urls"], options["client"], options.get("argument")
        self.delay, self.tries, self.wait = float(options.get("delay", "1")), int(options.get("tries", "3")), float(options.get("wait", "3"))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, base = _opened(self.urls)
        found = files.get_file_info(fs.FileSelector(base, recursive=True))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".parquet") and f.size] or [_File(None)]

    def read(self, partition) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        if partition.value is None:
            return
        module, _, name = self.client.partition(":")
        get, free_at = getattr(importlib.import_module(module), name)(*([self.argument] if self.argument else [])), {}
        files, _ = _opened(self.urls)
        with files.open_input_file(partition.value) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=256, columns=["key", "url"]):
                for key, url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    host = (re.match(HOST, url or "") or [""])[0]
                    time.sleep(max(0.0, free_at.get(host, 0.0) - time.monotonic()))
                    yield (key, url, *self.fetched(get, url))
                    free_at[host] = time.monotonic() + self.delay

    def fetched(self, get: Callable[[str], str], url: str) -> tuple:
        """The page, or null and the last error; only what may pass by itself is tried again."""
        error = None
        for n in range(1, self.tries + 1):
            try:
                return get(url), None, n, datetime.datetime.now(datetime.UTC)
            except OSError as e:
                error = f"{type(e).__name__}: {e}"
                if n < self.tries:
                    time.sleep(self.wait * n)
        return None, error, self.tries, datetime.datetime.now(datetime.UTC)


def web_client(timeout: float = 30.0) -> Callable[[str], str]:
    """A client of the standard library."""
    from urllib.request import urlopen

    def get(url: str) -> str:
        with urlopen(url, timeout=timeout) as answer:
            return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")

    return get


def fetch(tasks: DataFrame, store: str, client: str = "lodestone.sources.fetching:web_client", argument: str = "", slices: int = 8, hosts_at_once: int = 64, limit: int | None = None, only: list[str] | None = None, delay: float = 1.0, tries: int = 3, wait: float = 3.0, order: Column | None = None) -> DataFrame:
    """Fetch what the store doesn't have yet and append it, slice by slice; the store comes back.

    A host's pages are fetched by ``order``, an expression of ``url``, where one is set.

    ``tasks`` has ``key`` and ``url``; ``only`` names the keys that may be fetched, ``limit`` the
    most per run, in key order. What a slice has fetched stays when a later one fails, and the next
    run fetches the rest. Pages that failed are tried again by the next run and aren't stored. A
    stored page keeps its first download date, as it is never fetched again.
    """
    spark = tasks.sparkSession
    spark.dataSource.register(PageSource)
    rows = tasks.select(F.col("key").cast("string").alias("key"), "url").dropDuplicates(["key"])
    if only is not None:
        rows = rows.where(F.col("key").isin(only))
    known = stored_pages(spark, store)
    rows = rows if known is None else remaining(rows, known, "key")
    if limit is not None:
        rows = rows.orderBy("key").limit(limit)
    plan = f"{folder(spark)}/lodestone-urls-{uuid.uuid4().hex}"
    host = F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 0)
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int")).repartition(hosts_at_once, "slice", host)
    if order is not None:
        dealt = dealt.sortWithinPartitions("slice", order)
    dealt.write.partitionBy("slice").parquet(plan)
    jvm = spark._jvm
    for i in range(slices):
        part = jvm.org.apache.hadoop.fs.Path(f"{plan}/slice={i}")
        if part.getFileSystem(spark._jsc.hadoopConfiguration()).exists(part):
            options = {"urls": f"{plan}/slice={i}", "client": client, "argument": argument, "delay": str(delay), "tries": str(tries), "wait": str(wait)}
            spark.read.format("web_pages").options(**options).load().where(F.col("error").isNull()).write.mode("append").parquet(store)
    return stored_pages(spark, store)


def stored_pages(spark: SparkSession, store: str) -> DataFrame | None:
    """The stored pages; of a key that two runs have fetched side by side, the first download."""
    p = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    rows = spark.read.schema(SCHEMA).parquet(store)
    return rows.groupBy("key").agg(F.min(F.struct("fetched_at", "url", "html", "error", "tries")).alias("x")).select("key", "x.url", "x.html", "x.error", "x.tries", "x.fetched_at")


# ---------------------------------------------------------------- a site that lies in tables


#: Pages of a file of a site: a client reads a file for one of them.
FILE_PAGES = 256


def sited(pages: DataFrame, path: str, files: int | None = None, url: str = "url", html: str = "html") -> str:
    """Write pages as a site, dealt over files by the checksum of their address; returns the argument of :func:`site_client`.

    There are as many files as hold about ``FILE_PAGES`` pages each, unless ``files`` is set.
    """
    files = files or max(1, -(-pages.count() // FILE_PAGES))
    rows = pages.select(F.col(url).alias("url"), F.col(html).alias("html"), _bucket(F.col(url), files).alias("bucket"))
    rows.repartition(min(files, 256), "bucket").write.partitionBy("bucket").parquet(path)
    return f"{files} {path}"


def _bucket(url: Column, files: int) -> Column:
    return F.pmod(F.crc32(url), F.lit(files)).cast("int")


def site_order(site: str) -> Column:
    """The order of addresses in which a client of :func:`sited` pages reads each file once."""
    return _bucket(F.col("url"), int(site.partition(" ")[0]))


def site_client(site: str) -> Callable[[str], str]:
    """A client of the addresses of :func:`sited` pages; an address that the site doesn't have is an error."""
    import pyarrow.dataset as ds

    count, _, path = site.partition(" ")
    held: dict = {}

    def get(url: str) -> str:
        bucket = f"{path}/bucket={zlib.crc32(url.encode()) % int(count)}"
        if bucket not in held:
            files, base = _opened(bucket)
            if len(held) >= 8:
                held.pop(next(iter(held)))
            table = ds.dataset(base, filesystem=files, format="parquet").to_table(columns=["url", "html"])
            held[bucket] = dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))
        if url not in held[bucket]:
            raise FileNotFoundError(url)
        return held[bucket][url]

    return get
