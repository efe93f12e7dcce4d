"""Inverted-file index over vectors: approximate and exact search, and pruned threshold joins.

Cells are those of a spherical k-means that is fitted on a bounded sample; every row is indexed.
Scores are exact. Of each cell the
index keeps how far its vectors reach from the centre, as an angle, and their norms. By the
triangle inequality no vector of a cell scores above

    |x| |y| cos(max(0, angle(x, centre) - reach)),

so an exact search probes a few cells first and then those only whose bound reaches the score to
beat, and a threshold join lets a vector visit only cells whose bound reaches the threshold.

Neighbouring cells make a region, of about a ``REGIONS``-th of the rows. What visits cells is sent
once to each region that has one of them, with a bit for each cell of the region, and is scored
against those cells only: the count of cells, which grows with the rows, decides how much is
scored, but not how much is sent. Regions of any size are dealt into shards of a block, and the rows
that visit one into blocks of as many: a task holds one of each, and ``TILE`` scores. Equal vectors
are one class before any are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.lineage import cut
from lodestone.operators.similarity import ranked, vectors

#: Bound of the sample that cells are fitted on, in rows and bytes, and most cells.
SAMPLE_ROWS, SAMPLE_BYTES, MOST_CELLS = 65_536, 64 << 20, 4096
#: Most rows, and bytes in double precision, of a shard of a region and of a block of visitors; scores that a task holds at once.
BLOCK, BLOCK_BYTES, TILE = 65_536, 32 << 20, 1 << 22
#: About how many regions there are as long as blocks aren't full, and the rows that a region has at least.
REGIONS, REGION_ROWS = 16, 64
#: Rows whose bounds a task holds at once.
AT_ONCE = 1024
#: Slack of bounds against rounding.
SLACK = 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def fit(rows: DataFrame, cells: int | None = None, emb: str = "embedding", rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centres of a spherical k-means on a sample in hash order of at most ``SAMPLE_ROWS`` rows and ``SAMPLE_BYTES``.

    ``cells`` is about the square root of the count by default. Any centres give right
    results; these decide how much is read. Without rows there is one centre of no direction.
    """
    known = rows.where(F.col(emb).isNotNull())
    n, width = known.agg(F.count("*"), F.max(F.size(emb))).first()
    if not n:
        return np.zeros((1, 1))
    most = min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // (8 * width)))
    share = int(min(1.0, most / n) * (2**31 - 1))
    some = known.where(F.shiftrightunsigned(F.xxhash64(emb), 33) <= share).select(F.col(emb).alias("v")).limit(most).toArrow()
    x = _unit(vectors(some.column("v").to_pylist())) if some.num_rows else _unit(vectors([known.select(emb).first()[0]]))
    x = x[np.lexsort(x.T[::-1])]
    k = max(1, min(MOST_CELLS, len(x), cells or int(np.sqrt(n))))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 8192] @ centres.T).argmax(1) for i in range(0, len(x), 8192)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.bincount(own, minlength=k) == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        centres = _unit(sums)
    return centres


@dataclass
class Index:
    """``rows`` has a ``cell`` column; per cell: count, reach (an angle), least and largest norm."""

    rows: DataFrame
    centres: np.ndarray
    count: np.ndarray
    reach: np.ndarray
    least: np.ndarray
    most: np.ndarray
    emb: str = "embedding"

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """No vector of a cell (column) scores more against a row of ``x``; -inf for empty cells."""
        angle = np.arccos(np.clip(_unit(x) @ self.centres.T, -1, 1))
        cos = np.cos(np.maximum(0, angle - self.reach - SLACK))
        top = np.linalg.norm(x, axis=1)[:, None] * np.where(cos >= 0, self.most, self.least) * cos
        return np.where(self.count > 0, top + SLACK, -np.inf)

    def block(self) -> int:
        """Rows of a block."""
        return max(1, min(BLOCK, BLOCK_BYTES // (8 * self.centres.shape[1])))

    def starts(self) -> np.ndarray:
        """The first cell of each region, and the count of cells. A region is no larger than a block, unless one cell is."""
        most = min(self.block(), max(REGION_ROWS, -(-int(self.count.sum()) // REGIONS)))
        out, held = [0], 0
        for cell, n in enumerate(self.count):
            if held and held + n > most:
                out.append(cell)
                held = 0
            held += n
        return np.array([*out, len(self.count)])

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the ``region`` of their cell and its place there, ``bit``."""
        starts = self.starts()
        cells = [(c, r, c - int(a)) for r, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)) for c in range(a, b)]
        return rows.join(F.broadcast(rows.sparkSession.createDataFrame(cells, "cell int, region int, bit int")), "cell")  # a row a cell


def build(rows: DataFrame, centres: np.ndarray | None = None, cells: int | None = None, emb: str = "embedding") -> Index:
    """Index every row that has a vector by its nearest centre; all columns are kept, ``cell`` is added."""
    spark = rows.sparkSession
    centres = fit(rows, cells, emb) if centres is None else centres
    held = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("cell int, angle double, norm double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"cell": [], "angle": [], "norm": []})
        x = vectors(v)
        dots = _unit(x) @ held.value.T
        own = dots.argmax(1)
        return pd.DataFrame({"cell": own, "angle": np.arccos(np.clip(dots[np.arange(len(own)), own], -1, 1)), "norm": np.linalg.norm(x, axis=1)})

    known = rows.where(F.col(emb).isNotNull()).withColumn("__n", nearest(F.col(emb)))
    known = cut(known.select(*rows.columns, F.col("__n.cell").alias("cell"), F.col("__n.angle").alias("__angle"), F.col("__n.norm").alias("__norm")))
    stats = known.groupBy("cell").agg(F.count("*"), F.max("__angle"), F.min("__norm"), F.max("__norm")).collect()  # a row a cell
    k = len(centres)
    out = [np.zeros(k) for _ in range(4)]
    for cell, *values in stats:
        for a, v in zip(out, values, strict=True):
            a[cell] = v
    return Index(known.drop("__angle", "__norm"), centres, *out, emb)


def saved(index: Index, path: str) -> None:
    """Write the rows, ordered by cell so that a scan of few cells skips the rest, and the cells."""
    spark = index.rows.sparkSession
    index.rows.repartitionByRange("cell").sortWithinPartitions("cell").write.parquet(f"{path}/rows")
    cells = [(i, c.tolist(), *map(float, s)) for i, (c, *s) in enumerate(zip(index.centres, index.count, index.reach, index.least, index.most, strict=True))]
    spark.createDataFrame(cells, "cell int, centre array<double>, n double, reach double, least double, most double").coalesce(1).write.parquet(f"{path}/cells")


def loaded(spark: SparkSession, path: str, emb: str = "embedding") -> Index:
    c = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    return Index(spark.read.parquet(f"{path}/rows"), np.array([r.centre for r in c]), *[np.array([r[i] for r in c]) for i in range(2, 6)], emb)


def _met(visits: DataFrame, rows: DataFrame, index: Index, test, schema: str) -> DataFrame:
    """``test(visitors, members)`` for every block of a region's visitors and every shard of its members.

    ``visits`` are those of :func:`_probed`, ``rows`` have ``cell``; both have ``key``. A side is
    repeated once for each block of the other side in its region, and for nothing else.
    """
    rows, block = index.placed(rows), index.block()
    sizes = visits.groupBy("region").agg(F.ceil(F.count("*") / block).alias("vb")).join(rows.groupBy("region").agg(F.ceil(F.count("*") / block).alias("rb")), "region")
    sizes = F.broadcast(cut(sizes))  # a row a region

    def dealt(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        df = df.select(*[F.col(c).alias(c) for c in df.columns])  # both sides may come from one table
        return df.join(sizes, "region").withColumn(mine, F.pmod(F.xxhash64("key"), F.col(own))).withColumn(theirs, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).drop("vb", "rb")

    a, b = dealt(visits, "vb", "rb", "v", "r"), dealt(rows, "rb", "vb", "r", "v")
    return a.groupBy("region", "v", "r").cogroup(b.groupBy("region", "v", "r")).applyInPandas(test, schema)


def _picked(held: tuple, cells, v: pd.Series, more: pd.Series) -> Iterator[np.ndarray]:
    """``cells(bounds, centre scores, extra)``, a boolean matrix of rows and cells, for ``AT_ONCE`` rows at a time."""
    index = Index(None, *held)
    for at in range(0, len(v), AT_ONCE):
        some = slice(at, at + AT_ONCE)
        if not index.count.any():
            yield np.zeros((len(v[some]), len(index.count)), bool)
            continue
        x = vectors(v[some])
        yield cells(index.bounds(x), np.where(index.count > 0, _unit(x) @ index.centres.T, -np.inf), more[some].to_numpy())


def _probed(queries: DataFrame, index: Index, cells, extra: str = "") -> DataFrame:
    """``queries`` once for each region that has a cell picked by ``cells``: adds ``region`` and ``picks``, a bit for each cell of the region."""
    held = queries.sparkSession.sparkContext.broadcast((index.centres, index.count, index.reach, index.least, index.most))
    starts = index.starts().tolist()

    @F.pandas_udf("array<struct<region:int,picks:binary>>")
    def pick(v: pd.Series, more: pd.Series) -> pd.Series:
        out: list[list] = []
        for m in _picked(held.value, cells, v, more):
            own: list[list] = [[] for _ in m]
            for region, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                bits = np.packbits(m[:, a:b], axis=1)
                for i in np.flatnonzero(bits.any(1)):
                    own[i].append({"region": region, "picks": bits[i].tobytes()})
            out += own
        return pd.Series(out, dtype=object)

    rows = queries.withColumn("__p", F.explode(pick(F.col("q"), F.col(extra) if extra else F.lit(0.0))))
    return rows.select(*queries.columns, "__p.region", "__p.picks")


def _share(queries: DataFrame, index: Index, cells, weights: np.ndarray) -> float:
    """The mean over ``queries`` of the weights of the cells that ``cells`` picks."""
    held = queries.sparkSession.sparkContext.broadcast((index.centres, index.count, index.reach, index.least, index.most))

    @F.pandas_udf("double")
    def share(v: pd.Series, more: pd.Series) -> pd.Series:
        return pd.Series([s for m in _picked(held.value, cells, v, more) for s in m @ weights], dtype=float)

    return queries.agg(F.avg(share(F.col("q"), F.lit(0.0)))).first()[0] or 0.0


def _sides(visitors: pd.DataFrame, members: pd.DataFrame) -> tuple:
    """Vectors of both sides, the bits that each visitor picked, members in the order of their cells, and each cell's bit and slice of them."""
    members = members.sort_values("bit", kind="stable")
    bits, first = np.unique(members["bit"].to_numpy(), return_index=True)
    cells = [(c, slice(a, b)) for c, a, b in zip(bits, first, [*first[1:], len(members)], strict=True)]
    picks = np.unpackbits(np.stack([np.frombuffer(p, np.uint8) for p in visitors["picks"]]), axis=1).astype(bool)
    return vectors(visitors["q"]), vectors(members["embedding"]), picks, members, cells


def _tiles(x: np.ndarray, y: np.ndarray, picks: np.ndarray, cells: list) -> Iterator[tuple]:
    """Visitors' positions, a slice of members and their scores, at most about ``TILE`` at once, of every cell against those that picked it."""
    for cell, own in cells:
        came, step = np.flatnonzero(picks[:, cell]), max(1, TILE // (own.stop - own.start))
        for at in range(0, len(came), step):
            i = came[at : at + step]
            yield i, own, x[i] @ y[own].T


def first_cells(scores: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` best cells of each row, as a boolean matrix."""
    order = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
    out = np.zeros(scores.shape, bool)
    np.put_along_axis(out, order, True, 1)
    return out & np.isfinite(scores)


def _scored(visits: DataFrame, rows: DataFrame, index: Index, k: int, per: str, skip_self: bool) -> DataFrame:
    def best(q: pd.DataFrame, u: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qid": np.zeros(0, int), "doc_id": np.zeros(0, int), "unit_id": np.zeros(0, int), "score": np.zeros(0)})
        if not len(q) or not len(u):
            return empty
        x, y, picks, u, cells = _sides(q, u)
        ids, unit, doc, bit = q["key"].to_numpy(), u["key"].to_numpy(), u["doc_id"].to_numpy(), u["bit"].to_numpy()
        parts, step = [empty], max(1, TILE // len(u))
        for at in range(0, len(q), step):
            some, scores = picks[at : at + step], np.empty((len(picks[at : at + step]), len(u)))
            for cell, own in cells:
                came = np.flatnonzero(some[:, cell])
                scores[came, own] = x[at + came] @ y[own].T
            for i, s in enumerate(scores, at):
                free = picks[i, bit]
                own = np.flatnonzero(free & (unit != ids[i]) if skip_self else free)
                order = own[np.lexsort((unit[own], -s[own]))]
                if per == "doc":
                    order = order[np.sort(np.unique(doc[order], return_index=True)[1])]
                    order = order[np.lexsort((doc[order], -s[order]))]
                order = order[:k]
                parts.append(pd.DataFrame({"qid": ids[i], "doc_id": doc[order], "unit_id": unit[order], "score": s[order]}))
        return pd.concat(parts)

    return _met(visits.select("region", "picks", "key", "q"), rows, index, best, "qid long, doc_id long, unit_id long, score double")


def _top(scores: DataFrame, k: int, per: str) -> DataFrame:
    if per == "doc":
        top = F.max(F.struct("score", (-F.col("unit_id")).alias("u")))
        scores = scores.groupBy("qid", "doc_id").agg(top.alias("t")).select("qid", "doc_id", (-F.col("t.u")).alias("unit_id"), F.col("t.score").alias("score"))
    return ranked(scores, k, "doc_id" if per == "doc" else "unit_id")


def search(queries: DataFrame, index: Index, k: int = 10, probes: int = 8, exact: bool = False, qid: str = "qid", unit: str = "unit_id", doc: str = "doc_id", emb: str = "embedding", skip_self: bool = False, per: str = "doc") -> DataFrame:
    """The ``k`` best documents (or units) of each query: ``qid, doc_id, unit_id, score, rank``, as ``similarity.maxp`` gives them.

    Each query is scored against all rows of its ``probes`` nearest cells. With ``exact`` the
    k-th best score found there decides which further cells are read: all that could hold a
    better or equal one. Rows and queries without a vector are left out; ties go to the smaller id.
    """
    q = queries.where(F.col(emb).isNotNull()).select(F.col(qid).cast("long").alias("key"), F.col(emb).alias("q"))
    rows = index.rows.select("cell", F.col(unit).cast("long").alias("key"), F.col(doc).cast("long").alias("doc_id"), F.col(index.emb).alias("embedding"))
    near = _probed(q, index, lambda bound, score, _: first_cells(score, probes))
    found = _scored(near, rows, index, k, per, skip_self)
    if not exact:
        return _top(found, k, per)
    # a document's best unit may lie in a cell that isn't read yet, so what was found is kept before it is ranked
    found = cut(found)
    least = _top(found, k, per).where(F.col("rank") == k).select(F.col("qid").alias("key"), F.col("score").alias("least"))
    rest = q.join(least, "key", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    more = _probed(rest, index, lambda bound, score, least: (bound >= least[:, None]) & np.isfinite(bound) & ~first_cells(score, probes), "least")
    return _top(found.unionByName(_scored(more, rows, index, k, per, skip_self)), k, per)


def read_share(queries: DataFrame, index: Index, probes: int, emb: str = "embedding") -> float:
    """The mean share of the indexed rows that a query is scored against."""
    q = queries.where(F.col(emb).isNotNull()).select(F.col(emb).alias("q"))
    return _share(q, index, lambda bound, score, _: first_cells(score, probes), index.count / max(1, index.count.sum()))


def recall(found: DataFrame, exact: DataFrame, k: int) -> float:
    """The share of the exact top ``k`` (``qid, doc_id, rank``) that was found, over all queries."""
    want = exact.where(F.col("rank") <= k).select("qid", "doc_id")
    hit = found.where(F.col("rank") <= k).select("qid", "doc_id", F.lit(1).alias("hit"))
    return want.join(hit, ["qid", "doc_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]


def tuned_probes(queries: DataFrame, index: Index, k: int = 10, target: float = 0.95, most: int = 512, qid: str = "qid", unit: str = "unit_id", emb: str = "embedding", **more) -> int:
    """The fewest probes with which a sample of the queries finds a share of ``target`` of its exact top ``k``.

    The sample is the first ``most`` queries in hash order. It is searched exactly once; the
    place of the cell of each right result in the query's order of cells tells the probes it takes.
    """
    some = cut(queries.where(F.col(emb).isNotNull()).orderBy(F.xxhash64(qid)).limit(most))
    exact = search(some, index, k, 8, True, qid=qid, unit=unit, emb=emb, **more).select("qid", F.col("unit_id").alias("__u"))
    held = queries.sparkSession.sparkContext.broadcast((index.centres, index.count))

    @F.pandas_udf("array<int>")
    def order(v: pd.Series) -> pd.Series:
        centres, count = held.value
        return pd.Series(list(np.argsort(-np.where(count > 0, _unit(vectors(v)) @ centres.T, -np.inf), axis=1, kind="stable")) if len(v) else [], dtype=object)

    asked = some.select(F.col(qid).cast("long").alias("qid"), order(F.col(emb)).alias("order"))
    cells = index.rows.select(F.col(unit).cast("long").alias("__u"), "cell")
    places = exact.join(asked, "qid").join(cells, "__u").select(F.array_position("order", F.col("cell")).alias("place"))
    by = sorted(places.groupBy("place").count().collect())  # at most a row a cell
    total, met = sum(n for _, n in by), 0
    for place, n in by:
        met += n
        if met >= target * total:
            return int(place)
    return 1


# ---------------------------------------------------------------- threshold joins


def _classes(df: DataFrame, emb: str, order: str | None) -> DataFrame:
    """One row for equal vectors: ``embedding``, the least of their places in the order, and a ``key`` that is fixed once the rows are."""
    v = df.where(F.col(emb).isNotNull()).select(F.col(emb).alias("embedding"), (F.col(order).cast("long") if order else F.lit(0).cast("long")).alias("ord"))
    return v.groupBy("embedding").agg(F.min("ord").alias("ord")).withColumn("key", F.monotonically_increasing_id())


def visits_within(index: Index, threshold: float) -> DataFrame:
    """``key, q, ord, own, region, picks``: the cells from its own on that each class could have a partner in, by region."""
    rows = index.rows.select("key", F.col("embedding").alias("q"), "ord", F.col("cell").alias("own"))
    return _probed(rows, index, lambda bound, _, own: (bound >= threshold) & (np.arange(bound.shape[1])[None, :] >= own[:, None].astype(int)), "own")


def near_dup_within(df: DataFrame, threshold: float, order: str = "vec_id", emb: str = "embedding", cells: int | None = None) -> DataFrame:
    """All rows with ``is_dup``: some row earlier in the order has a dot product of at least the threshold.

    Every pair of cells that could hold such a pair meets once. Rows without a vector are no duplicates.
    """
    return near_dups_within(df, [threshold], order, emb, cells).drop("threshold")


def near_dups_within(df: DataFrame, thresholds: list[float], order: str = "vec_id", emb: str = "embedding", cells: int | None = None) -> DataFrame:
    """All rows once for each ``threshold``, with ``is_dup`` as :func:`near_dup_within` gives it, from one pass for the lowest.

    What a task sends of a class is its key and the least place among its partners, never its vector.
    """
    at, far = sorted(thresholds), int(np.iinfo(np.int64).max)
    index = build(cut(_classes(df, emb, order)), cells=cells)
    place = F.coalesce("ord", F.lit(far)).alias("ord")
    visits = visits_within(index, at[0]).select("region", "picks", "key", "q", place)
    members = index.rows.select("cell", "key", place, "embedding")

    def test(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"key": np.zeros(0, int), "t": np.zeros(0, int), "first": np.zeros(0, int)})]
        if not len(a) or not len(b):
            return parts[0]
        *both, b, cells = _sides(a, b)
        x, y = a["ord"].to_numpy(), b["ord"].to_numpy()
        # the least place among the partners of each, both ways; later copies of a class may come after a partner that it precedes
        found = [(np.full(len(a), far), np.full(len(b), far)) for _ in at]
        for came, own, scores in _tiles(*both, cells):
            i, j = np.nonzero(scores >= at[0])
            scores, i, j = scores[i, j], came[i], own.start + j
            for (rows, cols), t in zip(found, at, strict=True):
                like = scores >= t
                np.minimum.at(rows, i[like], y[j[like]])
                np.minimum.at(cols, j[like], x[i[like]])
        for t, sides in enumerate(found):
            for side, first in zip((a, b), sides, strict=True):
                own = first < far
                parts.append(pd.DataFrame({"key": side["key"].to_numpy()[own], "t": t, "first": first[own]}))
        return pd.concat(parts)

    met = _met(visits, members, index, test, "key long, t int, first long")
    # copies of a vector are partners of each other where its own square reaches the threshold
    own = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.when(_square("embedding") >= t, F.col("ord")).alias("first")) for i, t in enumerate(at)]))
    first = met.unionByName(index.rows.select("key", own.alias("x")).select("key", "x.t", "x.first"))
    first = first.groupBy("key").agg(*[F.min(F.when(F.col("t") == i, F.col("first"))).alias(f"__first_{i}") for i in range(len(at))])
    return _flagged(df, index.rows.select("key", "embedding").join(first, "key"), emb, {t: F.col(f"__first_{i}") < F.col(order) for i, t in enumerate(at)})


def _square(emb: str):
    return F.aggregate(emb, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def _flagged(df: DataFrame, classes: DataFrame, emb: str, flags: dict) -> DataFrame:
    """All rows of ``df`` once for each ``threshold`` of ``flags``, with its ``is_dup`` by what ``classes`` have of the row's vector."""
    found = classes.drop("key").withColumnRenamed("embedding", "__e")
    each = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.coalesce(hit, F.lit(False)).alias("is_dup")) for t, hit in flags.items()]))
    return df.join(found, df[emb] == F.col("__e"), "left").select(*df.columns, each.alias("__x")).select(*df.columns, "__x.threshold", "__x.is_dup")


def near_dup_against(df: DataFrame, refs: DataFrame, threshold: float, emb: str = "embedding", cells: int | None = None) -> DataFrame:
    """All rows with ``is_dup``: some reference row has a dot product of at least the threshold.

    References are indexed, and a vector visits the cells that could hold one. Rows without a vector are no duplicates.
    """
    return near_dups_against(df, refs, [threshold], emb, cells).drop("threshold")


def near_dups_against(df: DataFrame, refs: DataFrame, thresholds: list[float], emb: str = "embedding", cells: int | None = None) -> DataFrame:
    """All rows once for each ``threshold``, with ``is_dup`` as :func:`near_dup_against` gives it, from one pass for the lowest.

    What a task sends of a class is its key and its best score.
    """
    least = min(thresholds)
    index = build(cut(_classes(refs, emb, None)), cells=cells)
    rows = cut(_classes(df, emb, None))
    visits = _probed(rows.select("key", F.col("embedding").alias("q")), index, lambda bound, *_: bound >= least)

    def test(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"key": np.zeros(0, int), "best": np.zeros(0)})
        *both, _, cells = _sides(a, b)
        best = np.full(len(a), -np.inf)
        for came, _, scores in _tiles(*both, cells):
            best[came] = np.fmax(best[came], np.fmax.reduce(scores, axis=1))
        hit = best >= least
        return pd.DataFrame({"key": a["key"].to_numpy()[hit], "best": best[hit]})

    met = _met(visits, index.rows.select("cell", "key", "embedding"), index, test, "key long, best double")
    best = rows.select("key", "embedding").join(met.groupBy("key").agg(F.max("best").alias("__best")), "key")
    return _flagged(df, best, emb, {t: F.col("__best") >= t for t in thresholds})


def met_share(index: Index, threshold: float) -> float:
    """Of all pairs of a class and a cell, the share in which the bound reaches the threshold."""
    rows, held = index.rows.select(F.col("embedding").alias("q")), index.count > 0
    return _share(rows, index, lambda bound, *_: bound >= threshold, held / max(1, held.sum()))
