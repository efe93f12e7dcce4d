"""Generation tasks: which texts go to a model, with which prompt, and what came back.

The model is any callable ``(system, user, seed) -> str``; one is made per task by a
picklable factory. What isn't done yet is found by an anti-join on the log of answers.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.chunking import parts_of
from lodestone.sources.tables import remaining


def train_tasks(docs: DataFrame, most: int = 4000) -> DataFrame:
    """One task per part of a training document: ``key, doc_id, part, header, text``."""
    rows = docs.select("doc_id", "header", F.posexplode(parts_of(F.col("text"), most)).alias("part", "text"))
    return rows.select(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("part").cast("string")).alias("key"), "doc_id", F.col("part").cast("long").alias("part"), "header", "text")


def eval_tasks(items: DataFrame, docs: DataFrame, most: int = 4000, salt: str = "") -> DataFrame:
    """One task per evaluation item, with one part of its document picked by the key's hash."""
    own = docs.select("doc_id", "header", parts_of(F.col("text"), most).alias("__p"))
    rows = items.join(own, "doc_id")
    pick = (T.stable_seed(F.concat(F.lit(salt), F.col("doc_id").cast("string"))) % F.size("__p")).cast("int")
    return rows.withColumn("part", pick.cast("long")).withColumn("text", F.get("__p", pick)).withColumn("key", F.col("doc_id").cast("string")).drop("__p")


def hard_tasks(docs: DataFrame, dev: DataFrame, held: DataFrame, min_chars: int = 150, types: tuple[str, ...] = ("everyday", "search"), most: int = 4000) -> DataFrame:
    """Further test tasks for every long enough document that isn't a dev one, for each type."""
    rows = docs.where(F.length("text") >= min_chars).join(dev.select("doc_id").distinct(), "doc_id", "left_anti")
    rows = rows.join(held.select("doc_id").distinct().withColumn("__h", F.lit(True)), "doc_id", "left")
    items = rows.select("doc_id", F.when(F.col("__h"), "unseen_articles").otherwise("seen").alias("slice"), F.explode(F.array(*[F.lit(t) for t in types])).alias("qtype"))
    tasks = eval_tasks(items, docs, most, "tkhard")
    return tasks.withColumn("key", F.concat_ws("|", F.lit("tkhard"), F.col("doc_id").cast("string"), "qtype")).withColumn("split", F.lit("tk_hard"))


def limited(tasks: DataFrame, n: int, key: str = "key", salt: str = "0") -> DataFrame:
    """A sample of at most ``n`` tasks by hash order; 0 takes all."""
    return tasks.orderBy(T.hash_order(F.col(key), salt), key).limit(n) if n else tasks


def prompt(template: str, **values: Column) -> Column:
    """A template with ``{name}`` places filled from columns, in one pass over the template."""
    import string

    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(values[name].cast("string"))
    return F.concat(*parts) if parts else F.lit("")


#: What may pass by itself: a connection that breaks, a service that fails, a body that is cut off or malformed.
TRANSIENT = (OSError, RuntimeError, KeyError, IndexError, ValueError)


def answered(tasks: DataFrame, model: Callable[[], Callable[[str, str, int], str]], system: str, user: Column, name: str, version: str = "v1", tries: int = 3, wait: float = 2.0, workers: int = 4, transient: tuple = TRANSIENT) -> DataFrame:
    """Ask the model for each task: ``raw``, ``error`` and ``seconds`` are added.

    A task asks ``workers`` questions at a time. After a transient error it waits, longer each
    time, and asks again; where every try failed ``raw`` is null and ``error`` says why. Other
    errors end the job. ``output`` stays to be parsed (``filters.parsed_output``), so a bad
    answer is a row too.
    """
    rows = tasks.withColumn("__user", user).withColumn("__seed", T.stable_seed(F.col("key")))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = model()

        def one(text: str, seed: int) -> tuple[str | None, str | None, float]:
            began, error = time.monotonic(), None
            for n in range(tries):
                try:
                    return call(system, text, seed), None, time.monotonic() - began
                except transient as e:
                    error = f"{type(e).__name__}: {e}"
                    if n < tries - 1:
                        time.sleep(wait * (n + 1))
            return None, error, time.monotonic() - began

        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                got = list(pool.map(one, b["__user"], map(int, b["__seed"])))
                raw, error, seconds = zip(*got, strict=True) if got else ((), (), ())
                yield b.drop(columns=["__user", "__seed"]).assign(raw=list(raw), error=list(error), seconds=list(seconds))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.schema)
    out = rows.mapInPandas(ask, f"{fields}, raw string, error string, seconds double")
    return out.withColumn("model", F.lit(name)).withColumn("prompt_version", F.lit(version))


def run_tasks(tasks: DataFrame, path: str, ask: Callable[[DataFrame], DataFrame], slices: int = 20, key: str = "key") -> DataFrame:
    """Answer what the log at ``path`` doesn't have yet and append it, slice by slice; the log comes back.

    What a slice has answered stays when a later one fails, and the next run goes on from there.
    Failed answers (``raw`` null) aren't logged, so that they are asked again.
    """
    spark = tasks.sparkSession
    for i in range(slices):
        own = tasks.where(F.pmod(F.xxhash64(key), F.lit(slices)) == i)
        if _exists(spark, path):
            own = remaining(own, spark.read.parquet(path), key)
        ask(own).where(F.col("raw").isNotNull()).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def verdicts(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """``answerable`` of a judge's answers: yes, no, or invalid for all else."""
    said = F.lower(F.get_json_object(F.col(raw), "$.answerable"))
    return answers.withColumn("answerable", F.when(said.isin("yes", "no"), said).otherwise(F.lit("invalid")))
