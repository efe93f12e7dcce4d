"""Fusion of rankings. A run is a table ``qid, doc_id, rank`` with ranks from 1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The weights that are tried.
GRID = (0.0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0)


def tagged(runs: list[DataFrame], depth: int = 100) -> DataFrame:
    """All runs in one table, with each one's place in ``run``."""
    parts = [r.where(F.col("rank") <= depth).select("qid", "doc_id", "rank", F.lit(i).alias("run")) for i, r in enumerate(runs)]
    return reduce(DataFrame.unionByName, parts)


def _fused(rows: DataFrame, weight, k: int, depth: int, by: list[str]) -> DataFrame:
    # sums of doubles depend on their order: runs are added in order
    part = F.transform(F.array_sort(F.collect_list(F.struct("run", (weight / (k + F.col("rank"))).alias("s")))), lambda x: x["s"])
    score = F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
    out = rows.groupBy(*by, "qid", "doc_id").agg(score.alias("score"), F.min(F.struct("run", "rank")).alias("__first"))
    order = Window.partitionBy(*by, "qid").orderBy(F.desc("score"), "__first")
    return out.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= depth).drop("__first")


def rrf(runs: list[DataFrame], weights: list[float] | None = None, k: int = 60, depth: int = 100) -> DataFrame:
    """Weighted reciprocal-rank fusion: ``qid, doc_id, score, rank``.

    A document of any run takes part, with score 0 too. Of equal scores the one that comes
    first by (run, rank) is first.
    """
    weights = weights or [1.0] * len(runs)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("run") + 1)
    return _fused(tagged(runs, depth), w, k, depth, [])


def rrf_grid(first: DataFrame, second: DataFrame, weights: tuple[float, ...] = GRID, k: int = 60, depth: int = 100) -> DataFrame:
    """The fusions of two runs for each weight of the first: ``w`` beside the fused rows."""
    rows = tagged([first, second], depth).withColumn("w", F.explode(F.array(*[F.lit(float(x)) for x in weights])))
    return _fused(rows, F.when(F.col("run") == 0, F.col("w")).otherwise(F.lit(1.0)), k, depth, ["w"])


def best_weight(means: DataFrame, metric: str) -> DataFrame:
    """The weight of the best mean; of equal means the smallest weight."""
    return means.agg(F.max_by("w", F.struct(metric, -F.col("w"))).alias("w"), F.max(metric).alias(metric))


def candidate_pool(runs: list[DataFrame], gold: DataFrame, k: int = 5, depth: int = 100) -> DataFrame:
    """Runs in turn, depth by depth, without the gold document, until ``k`` documents: ``qid, doc_id, source, place``."""
    rows = tagged(runs, depth).join(gold.select("qid", F.col("doc_id").alias("__g")), "qid").where(F.col("doc_id") != F.col("__g"))
    first = rows.groupBy("qid", "doc_id").agg(F.min(F.struct("rank", "run")).alias("x"))
    order = Window.partitionBy("qid").orderBy("x")
    return first.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k).select("qid", "doc_id", F.col("x.run").alias("source"), "place")
