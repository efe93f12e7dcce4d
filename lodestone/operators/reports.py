"""Report tables: per-model means with intervals, runs, and what is looked up from other reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.joins import matched
from lodestone.operators import metrics, resampling


def main_table(rows: DataFrame, by: list[str], facet: str, values: list[str], score: str = "ndcg_10") -> DataFrame:
    """Means of each group and of some values of a facet, with the bootstrap interval of the score's mean."""
    means = metrics.sliced_table(rows, by, facet, values)
    limits = resampling.mean_ci(rows, by, score).select(*by, "ci_low", "ci_high")
    return matched(means, limits, by, "left")


def looked_up(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with a value from another report; rows for which it has none are left out."""
    found = table.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value))
    return rows.drop(value).join(found, key)


def learning_curve(runs: DataFrame, scores: DataFrame, base: str, sets: dict[str, str], metric: str = "ndcg_10") -> DataFrame:
    """Scores of runs by the questions that they were trained on; the base, which had none, comes first.

    ``runs``: name, train_questions; ``scores``: name, set, metric. ``sets`` names a column for each set.
    """
    points = runs.select("name", "train_questions").where(F.col("name") != base)
    points = points.unionByName(scores.where(F.col("name") == base).select("name").distinct().withColumn("train_questions", F.lit(0).cast("long")))
    pivot = scores.groupBy("name").agg(*[F.max(F.when(F.col("set") == s, F.col(metric))).alias(c) for c, s in sets.items()])
    return points.join(pivot, "name").orderBy("train_questions", "name")


def before_after(means: DataFrame, name: str, facet: str, models: dict[str, str], metric: str = "ndcg_10") -> DataFrame:
    """One row per facet that both the base and the tuned model have, one column per model, and the count of the base's queries.

    ``models`` names the columns; its first two are the base and the tuned model.
    """
    base, tuned = list(models)[:2]
    of = [F.max(F.when(F.col(name) == m, F.col(metric))).alias(c) for c, m in models.items()]
    count = F.max(F.when(F.col(name) == models[base], F.col("n"))).alias("n")
    return means.groupBy(facet).agg(count, *of).where(F.col(base).isNotNull() & F.col(tuned).isNotNull())


def ablation(means: DataFrame, name: str, facet: str, full: str, metric: str = "ndcg_10") -> DataFrame:
    """Each model's score beside that of the full one, and the difference, per facet."""
    whole = means.where(F.col(name) == full).select(facet, F.col(metric).alias("full"))
    return means.where(F.col(name) != full).join(whole, facet).select(name, facet, F.col(metric), "full", (F.col(metric) - F.col("full")).alias("delta"))


# The words of a run's label, and the names of runs that repeat an experiment with a further seed.
PREFIX, TEACHER, TEACHER_SAID = "^train_", "_teacher$", " + teacher"
RANK_SAID, FORMAT_SAID = ", noise filter top-", ", format aug "
REPEATS, REPEAT_OF = "_s4[34]$", "E3"


def data_label(sources: Column, file: Column, versions: Column, rank: Column, augmented: Column) -> Column:
    """What a run was trained on: its sources joined by a plus, or its prepared file with the filters that were set."""
    name = F.regexp_replace(F.regexp_replace(F.coalesce(file, F.lit("?")), PREFIX, ""), TEACHER, TEACHER_SAID)
    more = [
        F.when(F.size(versions) > 0, F.concat(F.lit(" ("), F.array_join(versions, ","), F.lit(")"))),
        F.when(rank > 0, F.concat(F.lit(RANK_SAID), rank.cast("string"))),
        F.when(augmented > 0, F.concat(F.lit(FORMAT_SAID), F.regexp_replace(augmented.cast("string"), r"\.0$", ""))),
    ]
    return F.when(F.size(sources) > 0, F.array_join(sources, "+")).otherwise(reduce(F.concat, [F.coalesce(x, F.lit("")) for x in more], name))


def train_runs(steps: DataFrame, runs: DataFrame, metric: str = "ndcg_10", repeats: str = REPEATS, repeat_of: str = REPEAT_OF) -> DataFrame:
    """One row per training run: its label, the base score (step 0), the best step, its epoch and score, and the minutes taken.

    ``steps``: run, step, metric; ``runs``: run, experiment, base_model, sources, train_file,
    versions, filter_rank, format_aug, steps_per_epoch, seconds. Of equal scores the earliest
    step is best. Runs that repeat another with a further seed belong to the experiment ``repeat_of``.
    """
    best = steps.groupBy("run").agg(F.max_by("step", F.struct(metric, -F.col("step"))).alias("best_step"), F.max(metric).alias("best"), F.max(F.when(F.col("step") == 0, F.col(metric))).alias("base"))
    label = data_label(F.col("sources"), F.col("train_file"), F.col("versions"), F.col("filter_rank"), F.col("format_aug"))
    return runs.join(best, "run").select(
        "run",
        F.when(F.col("run").rlike(repeats), F.lit(repeat_of)).otherwise(F.coalesce("experiment", F.lit(""))).alias("experiment"),
        F.element_at(F.split("base_model", "/"), -1).alias("base_model"),
        label.alias("data"),
        "base", "best", "best_step",
        F.round(F.col("best_step") / F.col("steps_per_epoch"), 2).alias("best_epoch"),
        F.round(F.col("seconds") / 60, 2).alias("minutes"),
    )
