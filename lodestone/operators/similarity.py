"""Vector search and similarity joins.

Scores are exact dot products in double precision. A query set is broadcast in blocks of a
checked size and each task keeps, of the units it reads, only the best documents of each
query: what is shuffled is k rows per query and task, never a score per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors that one broadcast may hold; a larger query set goes in several passes.
BROADCAST_BYTES = 64 << 20
#: Rows of results that a task keeps over its batches, and queries that it scores against a batch at once.
HELD_ROWS, AT_ONCE = 1 << 18, 256
#: Rows of one side of a block in a similarity join.
BLOCK = 4096


def vectors(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def _blocks(queries: DataFrame, qid: str, emb: str, *more: str, results: int = 0) -> Iterator[tuple]:
    """Query ids, vectors and further columns, at most BROADCAST_BYTES at a time, streamed through the driver.

    ``results`` is the rows that a task keeps of a query; a block's are at most HELD_ROWS.
    """
    cols: list[list] = [[] for _ in range(2 + len(more))]
    held = 0

    def block() -> tuple:
        out = (np.array(cols[0]), np.stack(cols[1]), *map(np.array, cols[2:]))
        for c in cols:
            c.clear()
        return out

    for r in queries.select(qid, emb, *more).toLocalIterator():
        for c, v in zip(cols, r, strict=True):
            c.append(v)
        cols[1][-1] = np.asarray(r[1], np.float64)
        held += cols[1][-1].nbytes
        if held >= BROADCAST_BYTES or len(cols[0]) * results >= HELD_ROWS:
            yield block()
            held = 0
    if cols[0]:
        yield block()


def carried(parts: list[pd.DataFrame], k: int, per: str = "doc") -> pd.DataFrame:
    """Of rows ``qid, doc_id, unit_id, score`` each query's ``k`` best documents by their best unit, or its ``k`` best units."""
    rows = pd.concat(parts, ignore_index=True).sort_values(["qid", "score", "unit_id"], ascending=[True, False, True], kind="stable")
    if per == "doc":
        rows = rows.drop_duplicates(["qid", "doc_id"]).sort_values(["qid", "score", "doc_id"], ascending=[True, False, True], kind="stable")
    return rows.groupby("qid", sort=False).head(k)


def maxp(queries: DataFrame, units: DataFrame, k: int = 100, qid: str = "qid", unit: str = "unit_id", doc: str = "doc_id", emb: str = "embedding", skip_self: bool = False, per: str = "doc") -> DataFrame:
    """The ``k`` best documents of each query by the best of their units: ``qid, doc_id, unit_id, score, rank``.

    ``per="unit"`` ranks units instead. Ties go to the smaller id. ``skip_self`` leaves out
    the unit whose id is the query's. A document of the global top k has its best unit in
    some task, where at most k - 1 documents are better: a task's top k is enough.
    """
    spark = units.sparkSession
    out = None
    cols = units.select(F.col(unit).cast("long").alias("unit_id"), F.col(doc).cast("long").alias("doc_id"), F.col(emb).alias("embedding"))
    for block in _blocks(queries, qid, emb, results=k):
        held = spark.sparkContext.broadcast(block)

        def best(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, q = held.value
            # what a task sends is k rows per query, over all its batches
            names = ("qid", "doc_id", "unit_id", "score")
            top, new, rows = None, [], 0

            def merged() -> pd.DataFrame:
                made = pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*new, strict=True)), strict=True)))
                return carried([made] if top is None else [top, made], k, per)

            for b in batches:
                if not len(b):
                    continue
                u, d, v = b["unit_id"].to_numpy(), b["doc_id"].to_numpy(), vectors(b["embedding"]).T
                for i, s in ((at + n, s) for at in range(0, len(ids), AT_ONCE) for n, s in enumerate(q[at : at + AT_ONCE] @ v)):
                    own = np.flatnonzero(u != ids[i]) if skip_self else np.arange(len(u))
                    order = own[np.lexsort((u[own], -s[own]))]
                    if per == "doc":
                        _, first = np.unique(d[order], return_index=True)
                        order = order[np.sort(first)]
                        order = order[np.lexsort((d[order], -s[order]))]
                    order = order[:k]
                    new.append((np.full(len(order), ids[i]), d[order], u[order], s[order]))
                    rows += len(order)
                    if rows > HELD_ROWS:
                        top, new, rows = merged(), [], 0
            if new:
                top = merged()
            if top is not None:
                yield top

        part = cols.mapInPandas(best, "qid long, doc_id long, unit_id long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "qid long, doc_id long, unit_id long, score double, rank long")
    if per == "doc":
        top = F.max(F.struct("score", (-F.col("unit_id")).alias("u")))
        out = out.groupBy("qid", "doc_id").agg(top.alias("t")).select("qid", "doc_id", (-F.col("t.u")).alias("unit_id"), F.col("t.score").alias("score"))
    return ranked(out, k, "doc_id" if per == "doc" else "unit_id")


def ranked(scores: DataFrame, k: int, tie: str = "doc_id") -> DataFrame:
    """The ``k`` best rows of each query with their rank; ties go to the smaller id."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), tie)
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def with_empty_docs(run: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """A run in which documents without units stand last, with score -inf, if ``k`` reaches them.

    Each query needs at most ``k`` such documents, so only the ``k`` smallest ids are paired.
    """
    few = docs.orderBy("doc_id").limit(k)
    fill = queries.select("qid").crossJoin(F.broadcast(few)).select("qid", "doc_id", F.lit(float("-inf")).alias("score"))
    return ranked(run.select("qid", "doc_id", "score").unionByName(fill), k)


def beating(queries: DataFrame, units: DataFrame, qid: str = "qid", gold: str = "gold", score: str = "score", doc: str = "doc_id", emb: str = "embedding", skip_self: str | None = None) -> DataFrame:
    """``qid, doc_id`` for each document other than the query's own with a unit that scores higher than the query's ``score``.

    ``queries`` has the query's own document (``gold``) and the score to beat; only what beats it comes out.
    """
    spark = units.sparkSession
    cols = units.select(F.col(doc).cast("long").alias("doc_id"), F.col(emb).alias("embedding"), F.col(skip_self or doc).cast("long").alias("unit"))
    out = None
    for ids, q, own, least in _blocks(queries, qid, emb, gold, score):
        held = spark.sparkContext.broadcast((ids, q, own, least.astype(float)))

        def better(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, q, own, least = held.value
            for b in batches:
                if not len(b):
                    continue
                d, u = b["doc_id"].to_numpy(), b["unit"].to_numpy()
                v = vectors(b["embedding"]).T
                for at in range(0, len(ids), AT_ONCE):
                    some = slice(at, at + AT_ONCE)
                    hit = (q[some] @ v > least[some, None]) & (d[None, :] != own[some, None])
                    if skip_self:
                        hit &= u[None, :] != ids[some, None]
                    i, j = np.nonzero(hit)
                    yield pd.DataFrame({"qid": ids[some][i], "doc_id": d[j]}).drop_duplicates()

        part = cols.mapInPandas(better, "qid long, doc_id long")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "qid long, doc_id long") if out is None else out.distinct()


def encoded(df: DataFrame, model, text: str = "text", prompt: str = "", out: str = "embedding", batch: int = 64, kind: str = "float") -> DataFrame:
    """Add unit vectors of texts from a pluggable encoder, of ``kind`` float or double; null texts are empty ones.

    ``model()`` is called once per task and gives a callable from a list of texts to an array
    of vectors. Texts get the prompt before them and go in batches of similar length, the
    longest first; vectors that are all zero stay so.
    """

    @F.pandas_udf(f"array<{kind}>")
    def vectors_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model()
        for texts in parts:
            said = [prompt + (t or "") for t in texts]
            order = sorted(range(len(said)), key=lambda i: -len(said[i]))
            rows: list = [None] * len(said)
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                v = np.asarray(encode([said[i] for i in own]), np.float64)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                for i, x in zip(own, v / np.where(norm > 0, norm, 1), strict=True):
                    rows[i] = x.astype(np.float32 if kind == "float" else np.float64)
            yield pd.Series(rows, index=texts.index)

    return df.withColumn(out, vectors_of(F.col(text)))


def near_dup_within(df: DataFrame, threshold: float, key: str = "vec_id", order: str = "vec_id", emb: str = "embedding") -> DataFrame:
    """All rows with ``is_dup``: some row earlier in the order has a cosine of at least the threshold.

    Rows are dealt into blocks by hash and every pair of blocks meets once, in one task.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(order).cast("long").alias("ord"), F.col(emb).alias("embedding"))
    n = max(1, -(-df.count() // BLOCK))
    own = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        a, b = pdf[pdf["b"] == i], pdf[pdf["b"] == j]
        if not len(a) or not len(b):
            return pd.DataFrame({"id": pd.Series([], dtype="int64")})
        like = vectors(a["embedding"]) @ vectors(b["embedding"]).T >= threshold
        first = a["ord"].to_numpy()[:, None] < b["ord"].to_numpy()[None, :]
        later = a["ord"].to_numpy()[:, None] > b["ord"].to_numpy()[None, :]
        hit = [b["id"].to_numpy()[(like & first).any(0)], a["id"].to_numpy()[(like & later).any(1)]]
        return pd.DataFrame({"id": np.concatenate(hit)})

    pairs = own.select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "id", "ord", "embedding")
    return _marked(df, pairs.groupBy("i", "j").applyInPandas(test, "id long"), key)


def near_dup_against(df: DataFrame, refs: DataFrame, threshold: float, key: str = "vec_id", emb: str = "embedding") -> DataFrame:
    """All rows with ``is_dup``: some reference row has a cosine of at least the threshold.

    Every block of rows meets every block of references in one task.
    """
    side = lambda x: x.select(F.col(key).cast("long").alias("id"), F.col(emb).alias("embedding"))
    n, m = (max(1, -(-x.count() // BLOCK)) for x in (df, refs))
    block = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = side(df).select(block(n).alias("i"), every(m).alias("j"), F.lit(0).alias("side"), "id", "embedding")
    b = side(refs).select(every(n).alias("i"), block(m).alias("j"), F.lit(1).alias("side"), "id", "embedding")

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        own, ref = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(own) or not len(ref):
            return pd.DataFrame({"id": pd.Series([], dtype="int64")})
        return pd.DataFrame({"id": own["id"].to_numpy()[(vectors(own["embedding"]) @ vectors(ref["embedding"]).T >= threshold).any(1)]})

    return _marked(df, a.unionByName(b).groupBy("i", "j").applyInPandas(test, "id long"), key)


def _marked(df: DataFrame, found: DataFrame, key: str) -> DataFrame:
    flagged = found.distinct().select(F.col("id").alias(key), F.lit(True).alias("is_dup"))
    return df.join(flagged, key, "left").withColumn("is_dup", F.coalesce("is_dup", F.lit(False)))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of all rows of two arrays, each summed in the order of the columns: equal vectors have equal scores wherever they lie."""
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T, strict=True):
        out += np.multiply.outer(x, y)
    return out


def best_own_unit(queries: DataFrame, units: DataFrame, qid: str = "qid", doc: str = "doc_id", unit: str = "unit_id", emb: str = "embedding", skip_self: bool = False) -> DataFrame:
    """The best unit of each query's own document; of equal scores the first unit.

    Queries are broadcast in blocks, and a task keeps one unit of each query. No pair of a query and a unit is a row.
    """
    spark, out = units.sparkSession, None
    q = queries.select(F.col(qid).cast("long").alias("qid"), F.col(doc).cast("long").alias("doc_id"), F.col(emb).alias("embedding")).where("qid IS NOT NULL AND doc_id IS NOT NULL AND embedding IS NOT NULL")
    cols = units.select(F.col(doc).cast("long").alias("doc_id"), F.col(unit).cast("long").alias("unit_id"), F.col(emb).alias("embedding")).where("doc_id IS NOT NULL AND unit_id IS NOT NULL AND embedding IS NOT NULL")
    for block in _blocks(q, "qid", "embedding", "doc_id", results=1):
        held = spark.sparkContext.broadcast(block)

        def best(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, q, asked = held.value
            by = np.argsort(asked, kind="stable")
            score, found = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)
            met = np.zeros(len(ids), bool)
            for b in batches:
                b = b.sort_values(["doc_id", "unit_id"], kind="stable")
                d, u, v = b["doc_id"].to_numpy(), b["unit_id"].to_numpy(), vectors(b["embedding"])
                for key in np.unique(d):
                    own = by[slice(*np.searchsorted(asked[by], [key, key + 1]))]
                    here = slice(*np.searchsorted(d, [key, key + 1]))
                    for at in range(0, len(own), AT_ONCE):
                        i = own[at : at + AT_ONCE]
                        s = dots(q[i], v[here])
                        free = u[here][None, :] != ids[i][:, None] if skip_self else np.ones(s.shape, bool)
                        s[~free] = -np.inf
                        j = s.argmax(1)  # of equal scores the first unit
                        top, first, any_ = s[np.arange(len(i)), j], u[here][j], free.any(1)
                        better = any_ & (~met[i] | (top > score[i]) | ((top == score[i]) & (first < found[i])))
                        score[i[better]], found[i[better]], met[i[better]] = top[better], first[better], True
            yield pd.DataFrame({"qid": ids[met], "doc_id": asked[met], "unit_id": found[met], "score": score[met]})

        part = cols.mapInPandas(best, "qid long, doc_id long, unit_id long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "qid long, doc_id long, unit_id long, score double")
    top = F.max(F.struct("score", (-F.col("unit_id")).alias("u")))
    return out.groupBy(F.col("qid").alias(qid), F.col("doc_id").alias(doc)).agg(top.alias("t")).select(qid, doc, (-F.col("t.u")).alias(unit), F.col("t.score").alias("score"))
