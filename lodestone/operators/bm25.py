"""BM25 by scoring units where they lie.

Document frequencies and the mean length come from one pass. The query set's weights are
broadcast in blocks of a checked size, and each task scores its units against a block and
keeps, of each batch, only the best documents of each query: what is shuffled is k rows per
query and batch, never a row per posting or per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.similarity import ranked

#: Entries (queries times their terms) of the weights of one block.
BLOCK_ENTRIES = 4 << 20
#: Scores are rounded to so many digits, so that equal texts have equal scores wherever they lie.
DIGITS = 9


def statistics(units: DataFrame, words, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document frequencies of the terms used, units and mean length of the corpus)."""
    rows = units.select(words.alias("w"))
    kinds = rows.select(F.explode(F.array_distinct("w")).alias("term")).join(used, "term", "left_semi")
    return kinds.groupBy("term").agg(F.count("*").alias("df")), rows.agg(F.count("*").alias("n_units"), F.avg(F.size("w")).alias("avgdl"))


def _blocks(weights: DataFrame) -> Iterator[tuple[np.ndarray, dict[str, int], np.ndarray]]:
    """Query ids, the places of their terms and the weights (terms by queries), a block at a time."""
    ids: list = []
    terms: dict[str, int] = {}
    cells: list[tuple[int, int, float]] = []

    def block() -> tuple:
        matrix = np.zeros((len(terms), len(ids)))
        for t, q, w in cells:
            matrix[t, q] = w
        out = (np.array(ids), dict(terms), matrix)
        ids.clear(), terms.clear(), cells.clear()
        return out

    grouped = weights.groupBy("qid").agg(F.collect_list(F.struct("term", "weight")).alias("x"))
    for r in grouped.toLocalIterator():
        if ids and (len(terms) + len(r.x)) * (len(ids) + 1) > BLOCK_ENTRIES:
            yield block()
        ids.append(r.qid)
        cells += [(terms.setdefault(x.term, len(terms)), len(ids) - 1, x.weight) for x in r.x]
    if ids:
        yield block()


def ranked_whole(scores: DataFrame, k: int) -> DataFrame:
    """Ranked by rounded scores; the scores themselves stay whole, so that they can be rounded to fewer digits."""
    by = scores.withColumn("__whole", F.col("score")).withColumn("score", F.round("score", DIGITS))
    return ranked(by, k).withColumn("score", F.col("__whole")).drop("__whole")


def search(queries: DataFrame, units: DataFrame, k: int = 100, k1: float = 1.5, b: float = 0.75, unit: str = "unit_id", doc: str | None = None, text: str = "text", token: str = T.TOKEN, stems=None, fill: bool = False) -> DataFrame:
    """The ``k`` best documents (or units) of each query: ``qid, doc_id, score, rank``.

    ``queries`` has ``qid`` and ``text``. A query's repeated tokens count each time. With
    ``fill``, documents that match nothing follow with score 0, by id, as far as ``k`` reaches.
    A document of the global top k has its best unit in some batch, where at most k - 1
    documents are better: a batch's top k is enough.
    """
    spark = units.sparkSession
    cut = lambda w: stems(w) if stems else w
    q = queries.select("qid", F.explode(cut(T.words("text", token))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    words = cut(T.words(text, token))
    frequencies, stats = statistics(units, words, q.select("term").distinct())
    n_units, avgdl = stats.first()
    idf = F.log(1 + (F.lit(n_units) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = q.join(frequencies, "term").select("qid", "term", (F.col("qtf") * idf).alias("weight"))
    rows = units.select(F.col(doc or unit).cast("long").alias("doc_id"), words.alias("w"))
    scores = None
    for block in _blocks(weights):
        held = spark.sparkContext.broadcast(block)

        def best(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, places, matrix = held.value
            for batch in batches:
                docs = batch["doc_id"].to_numpy()
                for at in range(0, len(docs), 256):
                    own = docs[at : at + 256]
                    tf, dl = np.zeros((len(own), len(places))), np.zeros(len(own))
                    for i, w in enumerate(batch["w"].iloc[at : at + 256]):
                        dl[i] = len(w)
                        kinds, counts = np.unique([p for x in w if (p := places.get(x)) is not None], return_counts=True)
                        tf[i, kinds.astype(int)] = counts
                    part = tf / (tf + k1 * (1 - b + b * dl[:, None] / (avgdl or 1)) + (tf == 0))
                    whole = part @ matrix
                    got = np.round(whole, DIGITS)
                    out = []
                    for j, s in enumerate(got.T):
                        hit = np.flatnonzero(s > 0)
                        order = hit[np.lexsort((own[hit], -s[hit]))]
                        if doc is not None:
                            order = order[np.sort(np.unique(own[order], return_index=True)[1])]
                        order = order[:k]
                        out.append(pd.DataFrame({"qid": ids[j], "doc_id": own[order], "score": whole[order, j]}))
                    yield pd.concat(out)

        kind = weights.schema["qid"].dataType.simpleString()
        part = rows.mapInPandas(best, f"qid {kind}, doc_id long, score double")
        scores = part if scores is None else scores.unionByName(part)
    if scores is None:
        scores = queries.select("qid", F.lit(0).cast("long").alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
    scores = ranked_whole(scores.groupBy("qid", "doc_id").agg(F.max("score").alias("score")), k)
    if fill:
        # of each query at most k documents without a match can be reached: 2k smallest ids hold k unmatched or all
        ids = units.select(F.col(doc or unit).alias("doc_id")).distinct().orderBy("doc_id").limit(2 * k)
        rest = queries.select("qid").crossJoin(F.broadcast(ids)).join(scores.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
        scores = ranked_whole(scores.drop("rank").unionByName(rest.withColumn("score", F.lit(0.0))), k)
    return scores
