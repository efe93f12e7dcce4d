"""Bootstrap statistics of groups of any size.

A resample of ``n`` values is made of draws from shards of the group. How many each shard
gives is a multinomial draw that every shard repeats from the same seed, and a shard then
draws so many of its own values. So the resamples are those of drawing from the whole group
with replacement, though no task ever holds more than a shard. What is shuffled is one sum
per shard and resample; quantiles and counts over resamples are plain aggregates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.joins import matched
from lodestone.functions.lineage import cut
from lodestone.operators.splits import ranked

#: Values of a shard, and values that a task draws at a time.
SHARD, DRAWS = 1 << 16, 1 << 22
RESAMPLES = 10_000
#: Most values (some tens of MB) that draws meet by broadcast.
BROADCAST_VALUES = 1 << 20


def shard_sums(values: np.ndarray, sizes: list[int], shard: int, resamples: int, seed: int) -> np.ndarray:
    """Of each resample, the sum of what this shard gives to it."""
    shares = np.asarray(sizes, float) / sum(sizes)
    given = np.random.default_rng([seed, 0]).multinomial(sum(sizes), shares, size=resamples)[:, shard]
    rng, out, at = np.random.default_rng([seed, 1, shard]), np.zeros(resamples), 0
    ends = np.cumsum(given)
    while at < resamples:
        # as many resamples as fit a block of draws, at least one
        last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + DRAWS, "right")))
        own = given[at:last]
        drawn = values[rng.integers(0, len(values), size=own.sum())]
        out[at:last] = np.bincount(np.repeat(np.arange(len(own)), own), weights=drawn, minlength=len(own))
        at = last
    return out


def resampled_means(rows: DataFrame, by: list[str], value: str, key: str = "qid", resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """The groups' columns, ``resample`` and ``mean``. Null values count as no rows."""
    rows = rows.where(F.col(value).isNotNull()).select(*by, F.col(key).alias("__key"), F.col(value).cast("double").alias("__v"))
    # the shards' number is known from the counts of many small ones, which are joined up to SHARD rows
    part = rows.withColumn("__p", F.pmod(F.xxhash64("__key"), F.lit(4096)).cast("int"))
    counts = part.groupBy(*by, "__p").agg(F.count("*").alias("__n"))
    run = F.sum("__n").over(Window.partitionBy(*by).orderBy("__p"))
    counts = counts.withColumn("__s", F.floor((run - F.col("__n")) / SHARD).cast("int"))
    sizes = counts.groupBy(*by, "__s").agg(F.sum("__n").alias("__n"))
    lists = sizes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__s", "__n"))).alias("__l"))
    lists = lists.select(*by, F.col("__l.__s").alias("__shards"), F.col("__l.__n").alias("__sizes"))
    placed = matched(counts.drop("__n"), lists, by)
    dealt = matched(part, placed, [*by, "__p"]).drop("__p")

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        values = pdf.sort_values(["__key", "__v"])["__v"].to_numpy()
        shard = list(first["__shards"]).index(first["__s"])
        out = pd.DataFrame({"resample": np.arange(resamples), "sum": shard_sums(values, list(first["__sizes"]), shard, resamples, seed), "n": int(sum(first["__sizes"]))})
        return out.assign(**{c: first[c] for c in by})[[*by, "resample", "sum", "n"]]

    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.select(*by).dtypes), "resample int, sum double, n long"])
    given = dealt.groupBy(*by, "__s").applyInPandas(sums, schema)
    return given.groupBy(*by, "resample").agg((F.sum("sum") / F.first("n")).alias("mean"))


def counter_means(rows: DataFrame, by: list[str], value: str, key: str = "qid", resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """The groups' columns, ``resample`` and ``mean``, with draws that any engine can repeat.

    The values of a group of n have places from 0 in the md5 order of ``boot<seed>`` and their
    key. Draw ``i`` (0 to n - 1) of resample ``r`` takes the place that the first 15 hex digits of
    md5(``seed|r|i``) name, modulo n. Draws are rows that are made in parallel and meet their
    values by an equi-join, by broadcast while the values are few; sums are combined in the
    tasks. Means are rounded to 12 digits, so that the order of a sum doesn't show.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*by, F.col(key).alias("__key"), F.col(value).cast("double").alias("__v"))
    placed = cut(ranked(rows, by, "__key", f"boot{seed}").select(*by, (F.col("__r") - 1).alias("__i"), "__v"))
    sizes = placed.groupBy(*by).agg(F.count("*").alias("__n"))
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / SHARD)))
    draws = sizes.select(*by, "__n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample")).select(*by, "__n", "resample", blocks.alias("__b"))
    # short rows of much work: a number of tasks that adaptive execution leaves alone
    draws = draws.repartition(tasks, *by, "resample", "__b")
    place = F.explode(F.sequence(F.col("__b") * SHARD, F.least((F.col("__b") + 1) * SHARD, F.col("__n")) - 1))
    draws = draws.select(*by, "__n", "resample", place.alias("__d"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("resample"), F.col("__d"))), 1, 15), 16, 10).cast("long") % F.col("__n")
    values = F.broadcast(placed) if placed.count() <= BROADCAST_VALUES else placed
    met = matched(draws.select(*by, "__n", "resample", drawn.alias("__i")), values, [*by, "__i"])
    return met.groupBy(*by, "resample").agg(F.round(F.sum("__v") / F.first("__n"), 12).alias("mean"))


def _bounds(alpha: float) -> list:
    return [F.percentile("mean", F.lit(q)).alias(name) for q, name in ((alpha / 2, "ci_low"), (1 - alpha / 2, "ci_high"))]


def mean_ci(rows: DataFrame, by: list[str], value: str, key: str = "qid", resamples: int = RESAMPLES, seed: int = 0, alpha: float = 0.05, means=resampled_means) -> DataFrame:
    """Number, mean and bootstrap interval of the mean of each group."""
    rows = cut(rows.select(*by, key, value))
    plain = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    limits = means(rows, by, value, key, resamples, seed).groupBy(*by).agg(*_bounds(alpha))
    return matched(plain, limits, by)


def paired(a: DataFrame, b: DataFrame, metric: str, by: str | None = None) -> DataFrame:
    """``group, qid, a, b, diff`` over all queries and over each value of ``by``; both must have the same queries, once each."""
    left = a.select("qid", F.col(metric).alias("a"), *([F.col(by).cast("string").alias("__by")] if by else []))
    joined = cut(left.join(b.select("qid", F.col(metric).alias("b")), "qid", "full"))
    bad = joined.groupBy("qid").agg(F.count("*").alias("n"), F.count("a").alias("na"), F.count("b").alias("nb")).where("n <> 1 or na <> 1 or nb <> 1")
    if not bad.isEmpty() or joined.isEmpty():
        raise ValueError("the two runs have different queries, or none")
    groups = [F.lit("all"), F.concat(F.lit(f"{by}="), "__by")] if by else [F.lit("all")]
    rows = joined.select("qid", "a", "b", (F.col("a") - F.col("b")).alias("diff"), F.explode(F.array(*groups)).alias("group"))
    return rows.where("group is not null")


def compared(a: DataFrame, b: DataFrame, metric: str = "ndcg_10", by: str | None = None, resamples: int = RESAMPLES, seed: int = 0, alpha: float = 0.05, means=resampled_means) -> DataFrame:
    """Per group: ``n, mean_a, mean_b, delta``, its interval, the two-sided ``p_value`` and ``resamples``.

    The p-value is twice the lesser share of resampled differences on either side of zero,
    one being added to each count, and 1 at most.
    """
    rows = paired(a, b, metric, by)
    plain = rows.groupBy("group").agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("diff").alias("delta"))
    side = lambda cond: F.count(F.when(cond, 1))
    least = F.least(side(F.col("mean") <= 0), side(F.col("mean") >= 0))
    tests = means(rows, ["group"], "diff", "qid", resamples, seed).groupBy("group").agg(
        *_bounds(alpha), F.least(F.lit(1.0), 2 * (least + 1) / F.lit(resamples + 1)).alias("p_value"), F.count("*").alias("resamples")
    )
    return matched(plain, tests, ["group"])
