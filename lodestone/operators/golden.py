"""Golden sets from annotation logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("ok", "fix", "drop")


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; rows of the same order go by their values."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def invalid_annotations(log: DataFrame, items: DataFrame) -> DataFrame:
    """Annotations of unknown questions, of unknown status, or that name documents outside the pool."""
    joined = log.join(items.select("qid", F.col("candidates").alias("__c")), "qid", "left")
    reason = (
        F.when(F.col("__c").isNull(), "unknown_question")
        .when(~F.col("question_status").isin(*STATUSES), "unknown_status")
        .when(F.size(F.array_except(F.coalesce("extra_relevant", F.array().cast("array<bigint>")), "__c")) > 0, "unknown_candidate")
    )
    return joined.withColumn("reason", reason).where("reason is not null").drop("__c")


def adjudicated(items: DataFrame, annotations: DataFrame) -> DataFrame:
    """All items with their outcome: ``reason`` (null if kept), ``text`` as fixed, and ``qrels``.

    ``items``: qid, text, gold; ``annotations`` (one per qid): question_status, fixed_text,
    gold_relevant, extra_relevant.
    """
    x = items.join(annotations, "qid", "left")
    extra = F.coalesce("extra_relevant", F.array().cast("array<bigint>"))
    relevant = F.array_distinct(F.concat(extra, F.when(F.col("gold_relevant"), F.array("gold")).otherwise(F.array().cast("array<bigint>"))))
    reason = F.when(F.col("question_status").isNull(), "not_annotated").when(F.col("question_status") == "drop", "question_drop").when(F.size(relevant) == 0, "dropped_no_relevant")
    fixed = (F.col("question_status") == "fix") & (F.coalesce("fixed_text", F.lit("")) != "")
    rows = x.withColumn("reason", reason).withColumn("text", F.when(fixed, F.col("fixed_text")).otherwise(F.col("text")))
    return rows.withColumn("qrels", F.when(F.col("reason").isNull(), F.map_from_arrays(relevant, F.transform(relevant, lambda _: F.lit(1)))))


def report(rows: DataFrame) -> DataFrame:
    """Counts and shares of an adjudicated set; judged are those annotated and not dropped."""
    judged = F.col("question_status").isin("ok", "fix")
    n = F.greatest(F.count(F.when(judged, 1)), F.lit(1))
    extra = F.size(F.coalesce("extra_relevant", F.array().cast("array<bigint>")))
    kept = F.col("reason").isNull()
    return rows.agg(
        F.count("*").alias("items"),
        F.count("question_status").alias("annotated"),
        F.count(F.when(kept, 1)).alias("golden_queries"),
        F.count(F.when(F.col("question_status") == "drop", 1)).alias("question_drop"),
        F.round(1 - F.count(F.when(judged & ~F.col("gold_relevant"), 1)) / n, 4).alias("share_gold_relevant"),
        F.round(F.count(F.when(judged & (extra > 0), 1)) / n, 4).alias("share_with_extra_relevant"),
        F.round(F.coalesce(F.sum(F.when(judged, extra)), F.lit(0)) / n, 4).alias("mean_extra_relevant"),
        F.round(F.coalesce(F.sum(F.when(kept, F.size("qrels"))), F.lit(0)) / F.greatest(F.count(F.when(kept, 1)), F.lit(1)), 4).alias("mean_relevant_per_query"),
    )


def listed(items: DataFrame, annotations: DataFrame) -> DataFrame:
    """Every question with whether it is annotated: ``qid``, its other columns but for the candidates, ``done``."""
    done = annotations.select("qid").distinct().withColumn("done", F.lit(True))
    rows = items.drop("candidates", "gold").join(done, "qid", "left")
    return rows.withColumn("done", F.coalesce("done", F.lit(False)))


def item(items: DataFrame, annotations: DataFrame, qid) -> DataFrame:
    """One question with its candidates and its latest annotation (null if there is none)."""
    own = annotations.where(F.col("qid") == qid).select("qid", F.struct(*[c for c in annotations.columns if c != "qid"]).alias("annotation"))
    return items.where(F.col("qid") == qid).join(own, "qid", "left")
