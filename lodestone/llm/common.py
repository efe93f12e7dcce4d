"""Shared helpers: the folder that driver and executors share, written tables, column checks."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

WHITESPACE = " \t\n\r\x0b\x0c"
#: Rows and bytes of one Arrow batch. Texts can be long, so both are kept small.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20
_LOCAL: dict[str, str] = {}
_APART = itertools.count()


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, a temp folder, on a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(spark.sparkContext.applicationId)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = _LOCAL[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def dropped(df: DataFrame | None) -> None:
    """Delete the files of a table made by :func:`written`, once nothing reads it any more."""
    path = getattr(df, "_lodestone_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def apart(df: DataFrame, *used: str):
    """The table with its further columns under names that no operator uses, and a function that gives their names back."""
    k = next(_APART)  # an operator may call another one
    names = {c: f"further {k} {i}" for i, c in enumerate(df.columns) if c not in used}
    return df.withColumnsRenamed(names), lambda out: out.withColumnsRenamed({v: k for k, v in names.items()})


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers: long texts come in small Arrow batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
