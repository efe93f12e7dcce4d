"""Sources and sinks: JSON Lines, runs, result upserts, retrieval-benchmark exports, CSV reports."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as st

RUN_SCHEMA = "qid string, ranking array<struct<doc_id:string,score:double>>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines with a given schema; blank lines are no rows, a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_lenient(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON Lines without malformed lines and lines that lack the key (a log cut off by a crash)."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col(key).isNotNull())


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    """CSV with a header and doubles rounded to so many digits, in one file: for reports."""
    rounded = [F.format_string(f"%.{digits}f", c).alias(c) if isinstance(df.schema[c].dataType, st.DoubleType) else F.col(c) for c in df.columns]
    df.select(*rounded).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def load_yaml(path: str, base: str | None = None) -> dict:
    """A YAML file, looked for in ``base`` too."""
    import yaml

    if not os.path.exists(path) and base:
        path = os.path.join(base, path)
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def fetched(client, url: str, tries: int = 4, wait: float = 3.0, sleep=None) -> str:
    """A page's text from a client with ``get(url)``, tried again after growing pauses."""
    import time

    for n in range(1, tries + 1):
        try:
            return client.get(url)
        except Exception:
            if n == tries:
                raise
            (sleep or time.sleep)(wait * n)
    raise AssertionError


def save_run(run: DataFrame, path: str, depth: int = 100, by: tuple[str, ...] = ()) -> None:
    """A run as a long table, scores rounded to five digits, one folder per value of ``by``."""
    out = run.where(F.col("rank") <= depth).withColumn("score", F.round("score", 5))
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def load_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def nested_run(run: DataFrame, depth: int = 100) -> DataFrame:
    """One row per query with its ranking as an array, as run files have it."""
    top = run.where(F.col("rank") <= depth).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", F.round("score", 5).alias("score")))).alias("x"))
    return top.select("qid", F.transform("x", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["score"].alias("score"))).alias("ranking"))


def flat_run(nested: DataFrame) -> DataFrame:
    return nested.select("qid", F.posexplode("ranking").alias("p", "x")).select("qid", F.col("x.doc_id").alias("doc_id"), F.col("x.score").alias("score"), (F.col("p") + 1).cast("long").alias("rank"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows, and the old ones of groups that the new rows don't have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def remaining(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Tasks whose key isn't done yet."""
    return tasks.join(done.select(key).distinct(), key, "left_anti")


# The code and the slice of the external query set.
EXTERNAL_CODE, EXTERNAL_SLICE = "tk", "tk_rf_rag"


def external_queries(raw: DataFrame, code: str = EXTERNAL_CODE, slice_name: str = EXTERNAL_SLICE) -> DataFrame:
    """Questions with article numbers to evaluation queries; those without articles are left out."""
    docs = F.transform("articles", lambda a: F.concat(F.lit(f"{code}-"), a.cast("string")))
    rows = raw.where(F.size("articles") > 0).withColumn("__d", docs)
    return rows.select(
        F.concat(F.lit("ext-"), F.col("id").cast("string")).alias("qid"),
        F.col("question").alias("text"),
        F.lit("external").alias("split"),
        F.lit(slice_name).alias("slice"),
        F.lit("external").alias("qtype"),
        F.lit(code).alias("code"),
        F.get("__d", F.lit(0)).alias("doc_id"),
        F.map_from_arrays(F.array_distinct("__d"), F.transform(F.array_distinct("__d"), lambda _: F.lit(1))).alias("qrels"),
    )


def query_sets(spark: SparkSession, folder: str, names: list[str], schema: str) -> dict[str, DataFrame]:
    """The query sets of a folder that exist, by name."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = {}
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.jsonl")
        if path.getFileSystem(conf).exists(path):
            out[name] = read_jsonl(spark, f"{folder}/{name}.jsonl", schema)
    return out


def content_key(df: DataFrame, identity: str, key: str, text: str, by: list[str] | None = None) -> DataFrame:
    """A key of the texts of each group, which changes when any of them does: ``cache_key`` and ``n``.

    Rows are hashed (key and text), rows of one hash range are hashed together in order of
    their hashes, and the ranges' hashes make the key: no task holds more than a range. There
    are 4096 ranges, by the first three hexadecimal digits of a row's hash.
    """
    row = F.md5(F.concat(F.col(key).cast("string"), F.lit("\0"), F.coalesce(F.col(text), F.lit(""))))
    rows = df.select(*(by or []), row.alias("h"))
    parts = rows.groupBy(*(by or []), F.substring("h", 1, 3).alias("r")).agg(F.md5(F.array_join(F.array_sort(F.collect_list("h")), "")).alias("p"), F.count("*").alias("n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "p"))), lambda x: x["p"]), "")
    return parts.groupBy(*(by or [])).agg(F.md5(F.concat(F.lit(identity), F.lit("\0"), whole)).alias("cache_key"), F.sum("n").alias("n"))


def export_queries(rows: DataFrame) -> DataFrame:
    """Queries of an export: ``_id, text, slice, qtype, code, split``."""
    return rows.select(F.col("qid").alias("_id"), "text", F.coalesce("slice", F.lit("train")).alias("slice"), "qtype", "code", "split")


def export_qrels(rows: DataFrame) -> DataFrame:
    """Relevance of an export, by default the query's own document: ``query-id, corpus-id, score, split``."""
    own = F.create_map(F.col("doc_id"), F.lit(1))
    rel = F.when(F.col("qrels").isNotNull() & (F.size("qrels") > 0), F.col("qrels")).otherwise(own)
    return rows.select(F.col("qid").alias("query-id"), "split", F.explode(rel).alias("corpus-id", "score")).select("query-id", "corpus-id", F.col("score").cast("long").alias("score"), "split")


def export_train(first: DataFrame, titles: DataFrame, both: DataFrame | None = None) -> DataFrame:
    """Training rows of an export: those of both generation passes if there are any, else of the first; and the title pairs."""
    return (first if both is None else both).unionByName(titles, allowMissingColumns=True).withColumn("split", F.lit("train"))


def export_benchmark(docs: DataFrame, chunks: DataFrame, queries: DataFrame, path: str) -> DataFrame:
    """Write corpus, chunks, queries, qrels and the counts per split; the counts come back."""
    write_jsonl(docs.select(F.col("doc_id").alias("_id"), "title", "text", "code"), f"{path}/corpus")
    write_jsonl(chunks.select(F.col("chunk_id").alias("_id"), "doc_id", "text"), f"{path}/chunks")
    q, r = export_queries(queries), export_qrels(queries)
    for df, name in ((q, "queries"), (r, "qrels")):
        df.write.mode("overwrite").partitionBy("split").json(f"{path}/{name}")
    counts = export_counts(q, r)
    write_jsonl(counts, f"{path}/stats")
    return counts


def export_counts(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    a = queries.groupBy("split").agg(F.count("*").alias("queries"))
    b = qrels.groupBy("split").agg(F.count("*").alias("qrels"))
    return a.join(b, "split", "full").select("split", F.coalesce("queries", F.lit(0)).alias("queries"), F.coalesce("qrels", F.lit(0)).alias("qrels"))


def markdown(df: DataFrame, columns: list[str], order: Column | None = None, digits: int = 3, limit: int = 100) -> str:
    """A bounded report as a Markdown table."""
    rows = (df.orderBy(order) if order is not None else df).select(*columns).limit(limit).collect()
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v)
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *["| " + " | ".join(map(show, r)) + " |" for r in rows]])


def shown_p(p: Column, floor: float = 0.001) -> Column:
    return F.when(p < floor, F.lit(f"<{floor}")).otherwise(F.format_string("%.3f", p))
