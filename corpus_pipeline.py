"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but
the last return the columns of ``documents``, whatever they are called: operators' own columns
don't clash with them. Texts may be of any length. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontamination, language_id, line_dedup, near_dup, packing
from lodestone.llm.common import apart, dropped, table, written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language the model rejects; ``lang`` becomes the prediction.

    Null texts and texts without a letter have no language and go with them. Repeated rows are
    judged alike; rows whose ``lang`` is null teach nothing and are predicted like any other.
    """
    held, back = apart(docs, "doc_id", "text", "lang")
    out = language_id.identify(held, language_id.train_on(held)).where(~F.col("rejected"))
    return back(out.withColumn("lang", F.col("lang_pred")).select(*held.columns))


def lines_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete blocks that an earlier document has; documents of which nothing is left go.

    The earlier document is that of the smaller id, null ids first. Rows that repeat id and text
    are one document and lose the same. Texts that had no words before stay as they are.
    """
    held, back = apart(docs, "doc_id", "text", "n_chars")
    out = line_dedup.deduplicated(held)
    left = out.where((F.col("n_removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return back(left.withColumn("n_chars", F.length("text").cast("long")).select(*held.columns))


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates: five-word shingles, similarity 0.8.

    It is the row of the smallest id, of rows of one id (null is the last) that of the least text
    hash. Texts without words are no one's duplicate.
    """
    return near_dup.deduplicated(docs, k=5, percent=80, by_row=True)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten words in a row of a benchmark item, or a whole shorter item.

    Null and empty texts hold none and stay; repeated rows go or stay alike.
    """
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into windows of 2048 tokens; null and empty texts are one end token, every row is packed."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identified),
    ("line_dedup", lines_deduplicated),
    ("near_dedup", near_deduplicated),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: A trained model, minhashes and patience diff have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        after = written(stage(spark, docs, sf_dir), name)
        dropped(docs)
        docs = after
    return docs
