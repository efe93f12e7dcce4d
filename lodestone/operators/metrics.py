"""Ranking metrics and their summaries as joins and aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("ndcg_10", "recall_5", "recall_10", "mrr_10")


def per_query(run: DataFrame, qrels: DataFrame, queries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """nDCG@10, recall@5, recall@10 and MRR@10 of each query; all 0 without a relevant document.

    ``run``: qid, doc_id, rank (from 1); ``qrels``: qid, doc_id, rel; ``queries``: qid and any
    further columns, which are kept. ``by`` names columns of ``run`` that tell runs apart.
    """
    good = qrels.where("rel > 0")
    gain = lambda rel, place: (F.pow(F.lit(2.0), rel) - 1) / F.log2(place + 1)
    best = good.withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")))
    ideal = best.groupBy("qid").agg(F.sum(F.when(F.col("i") <= 10, gain(F.col("rel"), F.col("i")))).alias("idcg"), F.count("*").alias("n_rel"))
    hits = run.where("rank <= 10").join(good, ["qid", "doc_id"]).groupBy(*by, "qid").agg(
        F.sum(gain(F.col("rel"), F.col("rank"))).alias("dcg"),
        F.count(F.when(F.col("rank") <= 5, 1)).alias("h5"),
        F.count("*").alias("h10"),
        F.min("rank").alias("first"),
    )
    base = queries.crossJoin(run.select(*by).distinct()) if by else queries
    rows = base.join(ideal, "qid", "left").join(hits, [*by, "qid"], "left")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return rows.select(
        *by,
        *queries.columns,
        zero(F.col("dcg") / F.col("idcg")).alias("ndcg_10"),
        zero(F.col("h5") / F.col("n_rel")).alias("recall_5"),
        zero(F.col("h10") / F.col("n_rel")).alias("recall_10"),
        zero(1 / F.col("first")).alias("mrr_10"),
    )


def mean_metrics(rows: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row of means; NaN where there are no rows."""
    return rows.agg(*[F.coalesce(F.avg(m), F.lit(float("nan"))).alias(m) for m in metrics], F.count("*").alias("n"))


def summary(rows: DataFrame, facets: tuple[str, ...] = ("slice", "qtype"), by: tuple[str, ...] = (), metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Means over all rows and over each value of each facet, in one pass of grouping sets."""
    means = [F.avg(m).alias(m) for m in metrics]
    sets = [[*map(F.col, by)], *[[*map(F.col, by), F.col(f)] for f in facets]]
    out = rows.groupingSets(sets, *by, *facets).agg(*means, F.count("*").alias("n"), *[F.grouping(f).alias(f"__{f}") for f in facets])
    name = F.lit("all")
    for f in facets:
        name = F.when(F.col(f"__{f}") == 0, F.concat(F.lit(f"{f}="), F.col(f).cast("string"))).otherwise(name)
    return out.select(*by, name.alias("facet"), *metrics, "n")


def sliced_table(rows: DataFrame, by: list[str], facet: str, values: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Means per group, with further columns for the means of some values of a facet."""
    more = [F.avg(F.when(F.col(facet) == v, F.col(m))).alias(f"{m}_{v}") for v in values for m in ("ndcg_10", "recall_10")]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics], *more)


def breakdown(rows: DataFrame, by: str, facet: str, values: list, metric: str = "ndcg_10") -> DataFrame:
    """A pivot: one row per group, one column per value. The values are given, so no pass looks for them."""
    return rows.groupBy(by).pivot(facet, values).agg(F.avg(metric))


def ema(df: DataFrame, series: str, order: str, value: str, alpha: float = 0.15) -> DataFrame:
    """Exponential smoothing of each series from its first value: one pass over its ordered points.

    A series is the log of one run. Null values are left out.
    """
    kind = df.schema[series].dataType.simpleString()
    points = df.where(F.col(value).isNotNull()).select(series, F.col(order).cast("long").alias(order), F.col(value).cast("double").alias(value))

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        out, last = [], None
        for v in pdf[value].tolist():
            last = v if last is None else alpha * v + (1 - alpha) * last
            out.append(last)
        return pdf.assign(ema=out)

    return points.groupBy(series).applyInPandas(smooth, f"`{series}` {kind}, `{order}` long, `{value}` double, ema double")


def latency(df: DataFrame, by: list[str], ms: str) -> DataFrame:
    """Exact p50 and p95 by linear interpolation, and queries per second."""
    return df.groupBy(*by).agg(F.percentile(ms, 0.5).alias("p50"), F.percentile(ms, 0.95).alias("p95"), (F.count("*") * 1000.0 / F.sum(ms)).alias("queries_per_s"))


def seed_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n"))


def gap_closed(df: DataFrame, by: list[str], name: str, value: str, model: str, base: str, ref: str) -> DataFrame:
    """The share of the gap between a base and a reference that a model closes, and its ratio to either."""
    of = lambda x: F.max(F.when(F.col(name) == x, F.col(value)))
    g = df.groupBy(*by).agg(of(model).alias("m"), of(base).alias("b"), of(ref).alias("r"))
    gap = F.when(F.col("r") != F.col("b"), (F.col("m") - F.col("b")) / (F.col("r") - F.col("b")))
    return g.select(*by, gap.alias("gap_closed"), (F.col("m") / F.col("b")).alias("to_base"), (F.col("m") / F.col("r")).alias("to_ref"))


def chosen(stages: DataFrame, stage: str, name: str, score: str) -> DataFrame:
    """Best run of each stage (the first by name of equals), kept only if strictly better than all stages before."""
    best = stages.groupBy(stage).agg(F.max(score).alias("best"))
    named = stages.join(best, stage).where(F.col(score) == F.col("best")).groupBy(stage).agg(F.min(name).alias("chosen"), F.first("best").alias("best"))
    before = F.max("best").over(Window.orderBy(stage).rowsBetween(Window.unboundedPreceding, -1))
    return named.withColumn("kept", F.coalesce(F.col("best") > before, F.lit(True)))
