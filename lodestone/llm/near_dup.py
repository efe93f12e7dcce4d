"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes its set of distinct word shingles (64-bit hashes). Equal sets are one
   class, stood for by its smallest id; a group of copies costs one row from here on.
2. Each class has a signature of ``BANDS * ROWS`` minhashes. Classes whose signatures agree
   in a whole band are candidates. Within a band's bucket every class is compared with the
   bucket's smallest id, never with all others.
3. A candidate's signatures are compared batch by batch. After each batch the posterior of
   the similarity (uniform prior) bounds what can still reach the threshold: a pair whose
   probability of doing so is below ``MISS`` is pruned. Survivors are verified on full sets.
4. Verified links are joined to components. In buckets that still hold several components,
   the classes outside the component of the bucket's smallest id are compared with all
   others, in blocks of bounded size, and of the surviving pairs each block returns a
   spanning forest over components. The components that these join form groups, and in each
   group all classes outside the largest component are verified against all others on full
   sets, again in blocks that return a forest. So a large group of near copies costs about
   as many rows as it has members, and no link is lost to a cap.

Links, components and candidates are tables all the way; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import apart, dropped, small_batches, written

#: A pair of similarity 0.8 is missed by all bands with probability (1 - 0.8 ** 5) ** 32 = 3e-6.
BANDS, ROWS = 32, 5
#: Signature entries compared between two looks at the posterior, and the miss probability at each look.
BATCH, MISS = 32, 1e-6
#: Members of one side of a block of a bucket, and shingles of one side of a block of full sets (16 MB; a larger set is a block by itself).
BLOCK, BLOCK_SHINGLES = 2048, 2 << 20
#: Words whose hashes a worker keeps (about 8 MB), and the bytes of the longest such word; others are hashed each time.
KEPT_WORDS, KEPT_BYTES = 1 << 16, 32
#: Rounds of :func:`components`; each halves what is left at least, so that more is an error.
ROUNDS = 60
_UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RNG = np.random.default_rng(20240229)
_ODD = (_RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_XOR = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


class _WordHashes(dict):
    """64-bit hashes of words, the same in every process; a worker keeps those of ``KEPT_WORDS`` short ones at most."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = out
        return out


_HASHES = _WordHashes()


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's ``k``-word shingles; of all its words if it has fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def signature(sets: np.ndarray) -> np.ndarray:
    """The minhashes of a set that isn't empty, as 32-bit values."""
    out = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), 512):
        part = sets[at : at + 512]
        np.minimum(out, ((part[None, :] ^ _XOR[:, None]) * _ODD[:, None]).min(1), out=out)
    return (out >> np.uint64(32)).astype("<u4")


@lru_cache
def least_matches(threshold: float) -> tuple[tuple[int, int], ...]:
    """(entries compared, fewest matches not pruned) for each look.

    With a uniform prior and m of n matches, P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    looks = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        below, m = 0.0, -1
        while below < MISS:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        looks.append((n, m))
    return tuple(looks)


def survives(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of two arrays of signatures, row by row: which pairs no look prunes, and their matches."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in least_matches(threshold):
        matches[alive] += (a[alive, done:n] == b[alive, done:n]).sum(1)
        alive, done = alive[matches[alive] >= least], n
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out, matches


def _signed(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            ids, n, hi, lo, sigs = [], [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(text, k)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                ids.append(doc), n.append(len(s))
                hi.append((d >> 64) - (1 << 63)), lo.append((d & ((1 << 64) - 1)) - (1 << 63))
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "hi", "lo", "sig"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(rows, "doc_id long, n_shingles long, hi long, lo long, sig binary")


def _bands(classes: DataFrame) -> DataFrame:
    size = 4 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(F.substring(F.col("sig"), b * size + 1, F.lit(size))))
    return classes.select("rep", F.posexplode(keys).alias("band", "key"))


def _pruned(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) pairs whose signatures survive all looks."""
    own = sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"), F.col("n_shingles").alias("n_a"))
    other = sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"), F.col("n_shingles").alias("n_b"))
    # sizes alone bound the similarity: the smaller set over the larger
    sized = F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b") - 1e-9
    joined = pairs.join(other, "b").join(own, "a").where(sized)

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(s), "<u4").reshape(len(s), BANDS * ROWS) for s in (a, b))
        return pd.Series(survives(x, y, threshold)[0])

    return joined.where(alike("sig_a", "sig_b")).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on full sets."""
    joined = pairs.join(sets.select(F.col("rep").alias("b"), F.col("s").alias("s_b")), "b").join(sets.select(F.col("rep").alias("a"), F.col("s").alias("s_a")), "a")
    both = F.size(F.array_intersect("s_a", "s_b"))
    either = F.size("s_a") + F.size("s_b") - both
    return joined.where(100 * both >= percent * either).select("a", "b")


def components(edges: DataFrame, limit: int = ROUNDS) -> DataFrame:
    """(node, component): each node of undirected (a, b) edges and the smallest node it reaches.

    Alternates large stars and small stars, which leaves every node linked to its
    component's smallest after a logarithmic number of rounds. An error is raised if ``limit``
    rounds aren't enough: no result is ever taken from links that still change.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    for _ in range(limit):
        # large star: every larger neighbour of a node is linked to the node's least neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours are linked to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        dropped(edges)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components still change after {limit} rounds")
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out._lodestone_path = edges._lodestone_path
    return out


def _blocked(members: DataFrame, group: list[str], extra: list[str], test, schema: str, by_size: bool = False) -> DataFrame:
    """``test`` on every outsider of a group against the group's members, in blocks of bounded size.

    ``members`` has the group's columns, ``rep, component, lead, n_shingles`` and ``extra``; an
    outsider is a member whose component isn't ``lead``. A group is dealt into blocks of
    outsiders (side 0) and of members (side 1), and a task holds one of each: about ``BLOCK``
    rows, and where ``by_size`` about ``BLOCK_SHINGLES`` shingles.
    """
    outside = F.col("component") != F.col("lead")
    sizes = members.groupBy(*group).agg(F.count("*").alias("n"), F.count(F.when(outside, 1)).alias("out"), F.sum("n_shingles").alias("weight"), F.sum(F.when(outside, F.col("n_shingles"))).alias("out_weight"))
    m = members.join(sizes.where("out > 0"), group)

    def blocks(rows: str, shingles: str) -> Column:
        by_rows, by_shingles = F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES)
        return (F.least(F.greatest(by_rows, by_shingles), F.col(rows)) if by_size else by_rows).cast("int")

    rows, outs = blocks("n", "weight"), blocks("out", "out_weight")
    deal = F.xxhash64("rep")
    cols = [*group, "i", "j", "side", "rep", "component", *extra]
    left = m.where("component <> lead").withColumn("side", F.lit(0)).withColumn("i", F.pmod(deal, outs).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), rows - 1)))
    right = m.withColumn("side", F.lit(1)).withColumn("j", F.pmod(deal, rows).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), outs - 1)))
    return left.select(*cols).unionByName(right.select(*cols)).groupBy(*group, "i", "j").applyInPandas(test, schema)


def _forest(pdf: pd.DataFrame, found) -> pd.DataFrame:
    """A spanning forest, over components, of the (outsider, member) pairs that ``found`` gives for each outsider.

    Once two components are joined, further pairs between them add nothing and aren't asked for.
    """
    pdf = pdf.sort_values("rep")
    own, rest = pdf[pdf["side"] == 0].reset_index(drop=True), pdf[pdf["side"] == 1].reset_index(drop=True)
    comps, index = np.unique(np.concatenate([own["component"], rest["component"]]), return_inverse=True)
    a, b = index[: len(own)], index[len(own) :]
    label, out = np.arange(len(comps)), []
    if len(rest):
        test = found(own, rest)
        for r in range(len(own)):
            at = np.flatnonzero(label[b] != label[a[r]])
            if not len(at):
                continue
            hit = test(r, at)
            for x in hit[np.sort(np.unique(label[b[hit]], return_index=True)[1])]:
                out.append((int(own["rep"][r]), int(rest["rep"][x])))
                label[label == label[b[x]]] = label[a[r]]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _suspects(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs of classes of different components of a bucket whose signatures survive: a forest of each block."""

    def found(own: pd.DataFrame, rest: pd.DataFrame):
        sig = np.frombuffer(b"".join(rest["sig"]), "<u4").reshape(len(rest), BANDS * ROWS)
        n = rest["n_shingles"].to_numpy()

        def test(r: int, at: np.ndarray) -> np.ndarray:
            k = own["n_shingles"][r]
            at = at[np.minimum(n[at], k) >= threshold * np.maximum(n[at], k) - 1e-9]
            x = np.broadcast_to(np.frombuffer(own["sig"][r], "<u4"), (len(at), BANDS * ROWS))
            return at[survives(x, sig[at], threshold)[0]]

        return test

    return _blocked(members, ["band", "key"], ["n_shingles", "sig"], lambda pdf: _forest(pdf, found), "a long, b long")


def _late_links(members: DataFrame, percent: int) -> DataFrame:
    """Verified links between components of a suspect group: a forest of each block, on full sets."""

    def found(own: pd.DataFrame, rest: pd.DataFrame):
        sizes = rest["s"].map(len).to_numpy()
        owner = np.repeat(np.arange(len(rest)), sizes)
        values = np.concatenate([np.asarray(x, np.int64) for x in rest["s"]])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]

        def test(r: int, at: np.ndarray) -> np.ndarray:
            mine = np.asarray(own["s"][r], np.int64)
            lo, hi = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
            n = hi - lo
            # the places lo..hi-1 of every shingle, one after another
            places = np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            both = np.bincount(owner[places], minlength=len(rest))[at]
            return at[100 * both >= percent * (len(mine) + sizes[at] - both)]

        return test

    return _blocked(members, ["grp"], ["s"], lambda pdf: _forest(pdf, found), "a long, b long", by_size=True)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``n_shingles``, ``component_id``, ``kept`` (it is the component's smallest id).

    Documents are linked if 100 * intersection >= percent * union of their shingle sets.
    Null texts and texts without words have the empty set and are linked with nothing. Rows
    of the same id are one node each time they occur: each row is returned, with the id's
    component. Rows whose id is null are returned, unlinked and kept. Columns of other names
    are left out; an empty table gives an empty table. Texts may be of any length; a text's set
    has to fit a task.
    """
    small_batches(docs.sparkSession)
    threshold = percent / 100
    signed = written(_signed(docs, k, id_col, text_col), "signed")
    known = signed.where("n_shingles > 0 and doc_id is not null")
    # equal sets are one class; the signature is the same throughout it
    classes = written(known.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("members")), "classes")
    sigs = classes.select("rep", "sig", "n_shingles")

    bands = _bands(classes)
    lead = bands.groupBy("band", "key").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1")
    shared = written(bands.join(lead, ["band", "key"]).select("band", "key", "rep", "lead", "n"), "buckets")
    star = shared.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    alive = written(_pruned(star, sigs, threshold), "pairs")

    # full sets of the classes that any pair may need: those in a surviving pair or in a bucket of three and more
    needed = alive.select(F.col("a").alias("rep")).unionByName(alive.select(F.col("b").alias("rep"))).unionByName(shared.where("n > 2").select("rep")).distinct()

    @F.pandas_udf("array<long>")
    def full(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, k).view(np.int64) for t in texts])

    own = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("t"))
    sets = written(own.join(needed, "rep", "left_semi").dropDuplicates(["rep"]).select("rep", full("t").alias("s")), "sets")

    edges = written(_verified(alive, sets, percent), "links")
    dropped(alive)
    linked_ = components(edges)
    comps = written(linked_, "components")
    dropped(linked_)

    def of(df: DataFrame, col: str, name: str) -> DataFrame:
        """The component of a class as another column; a class without links is its own."""
        joined = df.join(comps.select(F.col("node").alias(col), F.col("component").alias("__c")), col, "left")
        return joined.withColumn(name, F.coalesce("__c", col)).drop("__c")

    # a bucket of two has been compared; a larger one with several components may hold more links
    placed = of(of(shared.where("n > 2"), "rep", "component"), "lead", "lead_c").drop("lead").withColumnRenamed("lead_c", "lead")
    mixed_buckets = placed.groupBy("band", "key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("band", "key")
    doubtful = placed.join(mixed_buckets, ["band", "key"]).select("band", "key", "rep", "component", "lead").join(sigs, "rep")
    suspects = written(_suspects(doubtful, threshold), "suspects")
    if not suspects.isEmpty():
        # groups of components that survivors join: all of a group's members meet, in blocks
        between = of(of(suspects, "a", "x"), "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        joined = components(between)
        groups = joined.select(F.col("node").alias("component"), F.col("component").alias("grp"))
        groups = groups.unionByName(groups.select(F.col("grp").alias("component"), "grp")).distinct()
        inside = of(sets.withColumn("n_shingles", F.size("s")), "rep", "component").join(groups, "component")
        most = inside.groupBy("grp", "component").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("component", F.struct("n", "component")).alias("lead"))
        late = written(_late_links(inside.join(most, "grp"), percent), "links")
        dropped(joined)
        if not late.isEmpty():
            dropped(comps)
            comps = components(edges.unionByName(late))
        dropped(late)

    place = written(classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("hi", "lo", F.coalesce("component", "rep").alias("c")), "places")
    for done in (classes, shared, sets, edges, suspects, comps):
        dropped(done)
    # an id whose rows differ in text belongs to each of its texts' classes; ids are unique in a corpus
    out = signed.join(place, ["hi", "lo"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(linked, F.col("c")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keyed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows that repeat neither id and text, with ``__row``: unique, and in order of ids (null ids last)."""
    rows = docs.dropDuplicates([id_col, text_col])
    rows = rows.orderBy(F.col(id_col).cast("long").asc_nulls_last(), F.xxhash64(text_col))
    # fixed once the table is written
    return written(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", by_row: bool = False) -> DataFrame:
    """The documents' own columns without those whose id isn't the smallest of its near duplicates.

    Rows that repeat a kept id or have none all stay, unless ``by_row`` is set: then each row is a
    document of its own, one row of each group is left, and of rows that repeat both id and text
    one. Where ids are unique and none is null both give the same.
    """
    docs, back = apart(docs, id_col, text_col)
    if by_row:
        ids = docs.groupBy(id_col).agg(F.count("*").alias("n"))
        if not ids.where((F.col("n") > 1) | F.col(id_col).isNull()).isEmpty():
            return back(deduplicated(keyed_rows(docs, id_col, text_col), k, percent, "__row", text_col).drop("__row"))
    gone = near_duplicates(docs, k, percent, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias("__id")).distinct()
    return back(docs.join(gone, docs[id_col].cast("long") == gone["__id"], "left_anti"))
