"""Hard negatives and teacher labels from score tables.

``units``: qid, gold (the query's document), unit_id, doc_id, score, rank — a run of units
cut at the depth that is asked for (see ``similarity.maxp(per="unit")``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import similarity

TOP_K, MARGIN = 50, 0.95


def _classified(units: DataFrame, positives: DataFrame, margin: float, top_k: int) -> DataFrame:
    """Each candidate with ``same`` (of the gold document) and ``close`` (within the margin of the positive)."""
    rows = units.where(F.col("rank") <= top_k).join(positives.select("qid", F.col("score").alias("pos")), "qid")
    return rows.withColumn("same", F.col("doc_id") == F.col("gold")).withColumn("close", F.col("score") >= F.lit(margin) * F.col("pos"))


def _picked(rows: DataFrame) -> DataFrame:
    by_margin = F.when(~F.col("same") & ~F.col("close"), F.struct("rank", "unit_id", "doc_id"))
    fallback = F.when(~F.col("same"), F.struct("rank", "unit_id", "doc_id"))
    return rows.groupBy("qid").agg(
        F.min(by_margin).alias("margin"),
        F.max(fallback).alias("last"),
        F.count(F.when(F.col("same"), 1)).alias("n_same"),
        F.count(F.when(~F.col("same") & F.col("close"), 1)).alias("n_close"),
    )


def hard_negatives(units: DataFrame, positives: DataFrame, margin: float = MARGIN, top_k: int = TOP_K) -> DataFrame:
    """The best unit of another document below the margin, else the lowest unit of another, else none (-1)."""
    x = _picked(_classified(units, positives, margin, top_k))
    rule = F.when(F.col("margin").isNotNull(), "margin").when(F.col("last").isNotNull(), "fallback").otherwise("none")
    unit = F.coalesce("margin.unit_id", "last.unit_id", F.lit(-1)).cast("long")
    return x.select("qid", unit.alias("neg_unit_id"), rule.alias("rule"), "n_same", "n_close")


def mining_counters(negatives: DataFrame) -> DataFrame:
    count = lambda r: F.count(F.when(F.col("rule") == r, 1))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return negatives.agg(
        total("n_same").alias("candidates_same_document"),
        total("n_close").alias("candidates_too_close"),
        count("margin").alias("negative_by_margin_rule"),
        count("fallback").alias("negative_by_fallback"),
        count("none").alias("queries_without_negative"),
    )


def title_pairs_mined(pairs: DataFrame, bodies: DataFrame, k: int = TOP_K, margin: float = MARGIN, skip_self: bool = False) -> DataFrame:
    """Negatives for title queries: candidates are units' texts without headers, as the positives are.

    ``pairs``: qid, doc_id (the title's own), embedding, pos_score; ``bodies``: unit_id, doc_id, embedding.
    """
    run = similarity.maxp(pairs, bodies, k, per="unit", skip_self=skip_self).join(pairs.select("qid", F.col("doc_id").alias("gold")), "qid")
    return hard_negatives(run, pairs.select("qid", F.col("pos_score").alias("score")), margin, k)


def with_negative_text(rows: DataFrame, negatives: DataFrame, units: DataFrame, title: Column) -> DataFrame:
    """Join negatives' texts; rows for which ``title`` holds take the body without its header."""
    u = units.select(F.col("unit_id").alias("neg_unit_id"), F.col("text").alias("__t"), F.col("body").alias("__b"))
    joined = rows.join(negatives.select("qid", "neg_unit_id"), "qid", "left").join(u, "neg_unit_id", "left")
    return joined.withColumn("neg_text", F.when(title, F.col("__b")).otherwise(F.col("__t"))).drop("__t", "__b")


def gold_rank(docs: DataFrame) -> DataFrame:
    """1 + the documents that score strictly higher than the gold one. ``docs``: qid, gold, doc_id, score."""
    gold = docs.where("doc_id = gold").select("qid", F.col("score").alias("__g"))
    return docs.join(gold, "qid").groupBy("qid").agg((F.count(F.when(F.col("score") > F.col("__g"), 1)) + 1).alias("gold_rank"))


def gold_ranks(golds: DataFrame, better: DataFrame) -> DataFrame:
    """The same from the documents that beat the gold one (``similarity.beating``): ``golds`` has the qids."""
    n = better.groupBy("qid").agg(F.count("*").alias("__n"))
    return golds.select("qid").join(n, "qid", "left").select("qid", (F.coalesce("__n", F.lit(0)) + 1).alias("gold_rank"))


def label_means(lists: DataFrame, labels: str = "labels") -> DataFrame:
    """Mean label of the positives, and mean over rows of the mean label of their candidates."""
    rest = F.slice(labels, F.lit(2), F.size(labels))
    mean = F.when(F.size(rest) > 0, F.aggregate(rest, F.lit(0.0), lambda a, x: a + x) / F.size(rest))
    return lists.agg(F.count("*").alias("rows"), F.avg(F.get(labels, F.lit(0))).alias("labels_mean"), F.avg(mean).alias("cands_mean"))


def two_views(lists: DataFrame, other: DataFrame) -> DataFrame:
    """Lists of :func:`listwise` with the same documents' units and labels in a second view, in the same order.

    ``lists`` has ``gold`` and ``cand_doc_ids``; ``other``: qid, doc_id, unit_id, score. A
    document that the second view lacks has null there.
    """
    order = lists.select("qid", F.posexplode(F.concat(F.array("gold"), "cand_doc_ids")).alias("p", "doc_id"))
    found = order.join(other.select("qid", "doc_id", "unit_id", "score"), ["qid", "doc_id"], "left")
    own = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("p", "unit_id", "score"))).alias("x"))
    return lists.join(own, "qid").withColumns({"unit_ids_b": F.col("x.unit_id"), "labels_b": F.col("x.score")}).drop("x")


def rank_report(ranks: DataFrame, bounds: tuple[int, ...] = (1, 5, 10, 20, 50, 100)) -> DataFrame:
    return ranks.agg(F.count("*").alias("rows"), *[F.avg((F.col("gold_rank") <= k).cast("double")).alias(f"le_{k}") for k in bounds])


def listwise(docs: DataFrame, n: int = 7) -> DataFrame:
    """The best units of the ``n`` best other documents, and labels with the positive's score first."""
    others = docs.where("doc_id <> gold")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    top = others.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    lists = top.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("r", "unit_id", "score", "doc_id"))).alias("x"))
    pos = docs.where("doc_id = gold").select("qid", "gold", F.col("unit_id").alias("pos_unit_id"), F.col("score").alias("__p"))
    return pos.join(lists, "qid", "left").select(
        "qid", "pos_unit_id", F.coalesce(F.col("x.unit_id"), F.array().cast("array<bigint>")).alias("cand_unit_ids"),
        F.concat(F.array("__p"), F.coalesce(F.col("x.score"), F.array().cast("array<double>"))).alias("labels"),
        "gold", F.coalesce(F.col("x.doc_id"), F.array().cast("array<bigint>")).alias("cand_doc_ids"),
    )


def teacher_negatives(units: DataFrame, docs: DataFrame, margin: float = MARGIN, top_k: int = TOP_K) -> DataFrame:
    """Margin rule, else the lowest unit of another document in the top k, else the best other document's best unit."""
    pos = docs.where("doc_id = gold").select("qid", "score")
    near = _picked(_classified(units, pos, margin, top_k))
    best = docs.where("doc_id <> gold").groupBy("qid").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("d"), "unit_id")).alias("b"))
    rule = F.when(F.col("margin").isNotNull(), "margin").when(F.col("last").isNotNull(), "fallback").otherwise("best_other_document")
    return best.join(near, "qid", "left").select("qid", F.coalesce("margin.unit_id", "last.unit_id", "b.unit_id").alias("neg_unit_id"), rule.alias("rule"))
