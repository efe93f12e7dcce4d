"""A postings index for BM25, with block maxima and exact early termination.

Documents are dealt by hash into segments of about ``SEGMENT`` documents. A row of the index is a
term in a segment: the documents that have it, with their part of the score, and the largest of
these parts. So a frequent term is as many short rows as there are segments, and no list grows
with the corpus.

A search reads the maxima first. Summed over a query's terms they bound what any document of a
segment can score. The segments with the best bounds are scored, the k-th best score found there
is the score to beat, and further segments are scored only if their bound reaches it. Nothing is
left out that could be among the k best. The index is a table: a second query set reads it and
no text.

A segment's postings meet the queries that ask for it in one task, which sends the best documents
of each query there: no score per query, term and document is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.lineage import stored
from lodestone.operators import bm25

#: Documents of a segment, and segments that a query scores before it knows a score to beat.
SEGMENT, FIRST_SEGMENTS = 256, 4
#: Scores are compared by so many digits, so that equal texts have equal scores wherever they lie.
DIGITS = 9
#: Units of a segment that are scored at once, and the id that stands for a null one.
UNITS, NO_ID = 4096, np.iinfo(np.int64).min


@dataclass
class Postings:
    """``rows``: ``term, segment, top, postings`` (documents and parts); ``terms``: ``term, idf``; ``docs``: ``doc_id``."""

    rows: DataFrame
    terms: DataFrame
    docs: DataFrame
    token: str = T.TOKEN
    stems: object = None

    def words(self, text: str) -> Column:
        w = T.words(text, self.token)
        return self.stems(w) if self.stems else w


def build(units: DataFrame, k1: float = 1.5, b: float = 0.75, unit: str = "unit_id", doc: str | None = None, text: str = "text", token: str = T.TOKEN, stems=None, segment: int = SEGMENT) -> Postings:
    """Index the units' texts, each a document or one of the documents ``doc``.

    Null and empty texts are units without terms. A document's units are in one segment, so a
    segment's bound holds for its best unit. Repeated units are units of their own.
    """
    out = Postings(None, None, None, token, stems)
    n, avgdl = units.select(F.size(out.words(text)).alias("dl")).agg(F.count("*"), F.avg("dl")).first()
    segments = max(1, -(-n // segment))
    rows = units.select(F.monotonically_increasing_id().alias("u"), F.col(doc or unit).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # texts are dealt by segment once, and all further groups lie within a segment
    dealt = rows.withColumn("segment", F.pmod(F.xxhash64("doc_id"), F.lit(segments))).repartition("segment").withColumn("w", out.words("text"))
    counts = dealt.select("segment", "u", "doc_id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("segment", "u", "doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    part = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl or 1.0)))
    parts = counts.select("segment", "term", F.struct("u", "doc_id", part.alias("part")).alias("p"))
    out.rows = stored(parts.groupBy("segment", "term").agg(F.max("p.part").alias("top"), F.collect_list("p").alias("postings")).sortWithinPartitions("segment", "term"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    out.terms = stored(out.rows.groupBy("term").agg(F.sum(F.size("postings")).alias("df")).select("term", idf.alias("idf")))
    out.docs = units.select(F.col(doc or unit).cast("long").alias("doc_id"))
    return out


def saved(index: Postings, path: str) -> None:
    index.rows.write.parquet(f"{path}/rows")
    index.terms.write.parquet(f"{path}/terms")
    index.docs.distinct().write.parquet(f"{path}/docs")


def loaded(spark: SparkSession, path: str, token: str = T.TOKEN, stems=None) -> Postings:
    return Postings(*[spark.read.parquet(f"{path}/{x}") for x in ("rows", "terms", "docs")], token, stems)


def weights(queries: DataFrame, index: Postings) -> DataFrame:
    """``qid, term, weight``: how often a query has a term, times the term's idf."""
    q = queries.select("qid", F.explode(index.words("text")).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("n"))
    return q.join(index.terms, "term").select("qid", "term", (F.col("n") * F.col("idf")).alias("weight"))


def bounds(weighted: DataFrame, index: Postings) -> DataFrame:
    """``qid, segment, bound``: no document of the segment scores more for the query."""
    met = index.rows.select("segment", "term", "top").join(weighted, "term")
    return met.groupBy("qid", "segment").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"))


def _best_of(held, k: int):
    """Of a segment's postings the best ``k`` documents of each query that asks for it and is in the block ``held``."""

    def best(asked: pa.Table, rows: pa.Table) -> pa.Table:
        ids, places, matrix = held.value
        place = {q: i for i, q in enumerate(ids.tolist())}
        own = [(place[q], bar) for q, bar in zip(asked["qid"].to_pylist(), asked["least"].to_pylist(), strict=True) if q in place]
        unit, doc, part = (x.combine_chunks() for x in pa.table({"p": pc.list_flatten(rows["postings"])}).flatten().columns)
        term = np.repeat([places.get(t, -1) for t in rows["term"].to_pylist()], pc.list_value_length(rows["postings"]).to_numpy()).astype(int)
        met = np.flatnonzero(term >= 0)
        found: list[tuple] = []
        if own and len(met):
            doc, part = pc.fill_null(doc, int(NO_ID)).to_numpy(zero_copy_only=False)[met], part.to_numpy(zero_copy_only=False)[met]
            _, first, unit = np.unique(unit.to_numpy(zero_copy_only=False)[met], return_index=True, return_inverse=True)
            terms, term = np.unique(term[met], return_inverse=True)
            weight = matrix[terms][:, [i for i, _ in own]]
            docs, at = np.unique(doc[first], return_inverse=True)
            top = np.zeros((len(docs), len(own)))
            for a in range(0, len(first), UNITS):
                here = (unit >= a) & (unit < a + UNITS)
                parts = np.zeros((min(UNITS, len(first) - a), len(terms)))
                parts[unit[here] - a, term[here]] = part[here]
                np.maximum.at(top, at[a : a + UNITS], parts @ weight)
            scores = np.round(top, DIGITS)
            for j, (i, bar) in enumerate(own):
                hit = np.flatnonzero((top[:, j] > 0) & (scores[:, j] >= (0 if bar is None else bar - 2 * 10**-DIGITS)))
                hit = hit[np.lexsort((docs[hit], -scores[hit, j]))][:k]
                found.append((np.full(len(hit), i), docs[hit], top[hit, j]))
        q, d, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        named = asked.schema.field("qid").type
        return pa.table({"qid": pa.array(ids[q].tolist() if len(q) else [], named), "doc_id": pa.array(d, pa.int64(), mask=d == NO_ID), "score": pa.array(s, pa.float64())})

    return best


def _scores(segments: DataFrame, weighted: DataFrame, index: Postings, k: int) -> DataFrame:
    """The best ``k`` documents of the queries' segments; where ``least`` isn't null, those that score as much."""
    spark, kind = weighted.sparkSession, weighted.schema["qid"].dataType.simpleString()
    schema = f"qid {kind}, doc_id long, score double"
    rows = index.rows.join(weighted.select("term").distinct(), "term", "left_semi").select("segment", "term", "postings")
    asked = segments.select("qid", "segment", "least")
    out = None
    for block in bm25._blocks(weighted):
        part = asked.groupBy("segment").cogroup(rows.groupBy("segment")).applyInArrow(_best_of(spark.sparkContext.broadcast(block), k), schema)
        out = part if out is None else out.unionByName(part)
    return _ranked(spark.createDataFrame([], schema) if out is None else out, k)


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    """Ranked by rounded scores; the scores themselves stay whole, so that they can be rounded to fewer digits."""
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", DIGITS)), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def search(queries: DataFrame, index: Postings, k: int = 100, first: int = FIRST_SEGMENTS, fill: bool = False) -> DataFrame:
    """The ``k`` best documents of each query: ``qid, doc_id, score, rank``, as ``bm25.search`` gives them.

    ``queries`` has ``qid`` and ``text``; a query's repeated tokens count each time. Ties go to
    the smaller id. With ``fill``, documents that match nothing follow with score 0, by id.
    """
    weighted = stored(weights(queries, index))
    known = stored(bounds(weighted, index))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "segment"))
    known = known.withColumn("place", place)
    found = stored(_scores(known.where(F.col("place") <= first).withColumn("least", F.lit(None).cast("double")), weighted, index, k).drop("rank"))
    least = _ranked(found, k).where(F.col("rank") == k).select("qid", F.round("score", DIGITS).alias("least"))
    # bounds are sums in another order, so they get a little slack
    rest = known.where(F.col("place") > first).join(least, "qid", "left").where(F.col("least").isNull() | (F.col("bound") + 1e-6 >= F.col("least")))
    out = _ranked(found.unionByName(_scores(rest, weighted, index, k).drop("rank")), k)
    if fill:
        # of each query at most k documents without a match can be reached: 2k smallest ids hold k unmatched or all
        ids = index.docs.distinct().orderBy("doc_id").limit(2 * k)
        rest = queries.select("qid").crossJoin(F.broadcast(ids)).join(out.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
        out = _ranked(out.drop("rank").unionByName(rest.withColumn("score", F.lit(0.0))), k)
    return out


def scored_share(queries: DataFrame, index: Postings, k: int, first: int = FIRST_SEGMENTS) -> float:
    """Of the pairs of a query and a segment that shares a term with it, the share that a search scores."""
    weighted = stored(weights(queries, index))
    known = stored(bounds(weighted, index)).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "segment")))
    least = _ranked(_scores(known.where(F.col("place") <= first).withColumn("least", F.lit(None).cast("double")), weighted, index, k), k).where(F.col("rank") == k).select("qid", F.round("score", DIGITS).alias("least"))
    read = known.join(least, "qid", "left").agg(F.avg(((F.col("place") <= first) | F.col("least").isNull() | (F.col("bound") + 1e-6 >= F.col("least"))).cast("double")))
    return read.first()[0] or 0.0
