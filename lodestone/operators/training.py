"""Preparation of training rows: filters, augmentation, wide rows and conflict-free batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.lineage import cut, stored
from lodestone.operators.splits import ranked


def kept_rows(df: DataFrame, versions: list[str] | None = None, rank: int | None = None, version_col: str = "prompt_version", rank_col: str = "teacher_gold_rank") -> DataFrame:
    if versions:
        df = df.where(F.col(version_col).isin(*versions))
    return df if rank is None else df.where(F.col(rank_col) <= rank)


def filled_negatives(rows: DataFrame, units: DataFrame, key: str = "qid", doc: str = "doc_id", neg: str = "neg_unit_id", salt: str = "fill") -> DataFrame:
    """Rows without a negative get a unit of another document, picked by hash.

    Units have places in their hash order. A row starts at the place that its own hash names and
    takes the first unit of another document from there on, among the places that share their
    upper bits; if there is none, the first unit of another document of all. Without such a unit
    the row stays without.
    """
    placed = cut(ranked(units.select("unit_id", doc), [], "unit_id", salt).withColumn("place", F.col("__r") - 1).drop("__r"))
    n = placed.agg(F.count("*").alias("__n"))
    after = Window.partitionBy(F.shiftright("place", 16)).orderBy("place")
    # where the next unit of yet another document stands: the first of the next run of one document
    runs = placed.withColumn("__start", F.coalesce(F.lag(doc).over(after) != F.col(doc), F.lit(False)))
    back = Window.partitionBy(F.shiftright("place", 16)).orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    first = F.last(F.when(F.col("__start"), F.col("unit_id")), ignorenulls=True).over(back)
    nxt = runs.select("place", F.col("unit_id").alias("__u"), F.col(doc).alias("__d"), first.alias("__next"))
    # of two documents' first units one is of another document
    firsts = placed.groupBy(doc).agg(F.min(F.struct("place", "unit_id")).alias("p")).orderBy("p").limit(2)
    firsts = firsts.agg(F.array_sort(F.collect_list(F.struct("p", F.col(doc).alias("d")))).alias("__firsts"))
    lost = rows.where(F.col(neg).isNull()).crossJoin(F.broadcast(n)).withColumn("place", T.hash_order(F.col(key), salt) % F.col("__n"))
    got = lost.join(nxt, "place", "left").crossJoin(F.broadcast(firsts))
    other = F.get(F.filter("__firsts", lambda x: x["d"] != F.col(doc)), F.lit(0))["p"]["unit_id"]
    pick = F.when(F.col("__d") != F.col(doc), F.col("__u")).otherwise(F.coalesce("__next", other))
    return rows.where(F.col(neg).isNotNull()).unionByName(got.withColumn(neg, pick).select(*rows.columns))


def augmented(df: DataFrame, pairs: dict[str, str], p: float, key: str = "qid", salt: str = "format") -> DataFrame:
    """With probability ``p``, by hash of the key, a row takes its columns from their other view; adds ``augmented``."""
    hit = T.hash_uniform(F.col(key), salt) < p
    return df.withColumns({a: F.when(hit, F.col(b)).otherwise(F.col(a)) for a, b in pairs.items()} | {"augmented": hit})


def wide(df: DataFrame, n: int, temperature: float, cands: str = "cand_texts", labels: str = "labels") -> DataFrame:
    """One column per candidate, and labels divided by the temperature."""
    return df.select("*", *[F.get(cands, F.lit(i)).alias(f"cand_{i}") for i in range(n)], F.transform(labels, lambda x: x / F.lit(temperature)).alias("label"))


def row_keys(doc: Column, neg_unit: Column | None = None) -> Column:
    """The documents that a row touches: its own and that of its negative (what stands before #)."""
    return F.array(doc) if neg_unit is None else F.array_distinct(F.array_compact(F.array(doc, F.substring_index(neg_unit, "#", 1))))


def batches_of(keys: list, size: int, drop_last: bool = False) -> list[list[int]]:
    """Cut rows, in their order, into batches in which no key occurs twice.

    A row that conflicts waits for the next batch; only when all rows left conflict is a
    batch filled up from those that wait. The count of batches is that of plain cutting.
    """
    out, waiting, fresh = [], [], iter(range(len(keys)))
    for _ in range(len(keys) // size if drop_last else -(-len(keys) // size)):
        batch, used, still = [], set(), []
        for i in waiting:
            if len(batch) < size and used.isdisjoint(keys[i]):
                batch.append(i)
                used.update(keys[i])
            else:
                still.append(i)
        while len(batch) < size and (i := next(fresh, None)) is not None:
            if used.isdisjoint(keys[i]):
                batch.append(i)
                used.update(keys[i])
            else:
                still.append(i)
        fill = size - len(batch)
        out.append(batch + still[:fill])
        waiting = still[fill:]
    return out


def conflict_free(df: DataFrame, keys: str, size: int, key: str = "qid", seed: int = 0, shards: int = 1, drop_last: bool = False) -> DataFrame:
    """``shard, batch, place`` for each row; the order within a shard is by hash of seed and key.

    Each of the ``shards`` (one per trainer) is cut by a task of its own, which holds keys only.
    """
    rows = df.select(key, F.col(keys).alias("__k"), T.hash_order(F.col(key), str(seed)).alias("__o"))
    rows = rows.withColumn("shard", F.pmod(F.col("__o"), F.lit(shards)).cast("long"))
    kind = df.schema[key].dataType.simpleString()

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__o", key]).reset_index(drop=True)
        at = batches_of([frozenset(k) for k in pdf["__k"]], size, drop_last)
        index = np.array([i for b in at for i in b], dtype=int)
        return pd.DataFrame({key: pdf[key].to_numpy()[index], "shard": int(pdf["shard"].iloc[0]), "batch": [n for n, b in enumerate(at) for _ in b], "place": [p for b in at for p in range(len(b))]})

    return rows.groupBy("shard").applyInPandas(cut, f"{key} {kind}, shard long, batch long, place long")


#: Round from which on rows may take the place of others.
EVICT_FROM = 5


def dealt_batches(df: DataFrame, keys: str, size: int, key: str = "qid", seed: int = 0, shards: int = 1, rounds: int = 40) -> DataFrame:
    """``key, shard, batch, place``: batches of at most ``size`` rows in which no key occurs twice, found in parallel.

    There are as many batches as plain cutting gives. At first the rows of each first key are dealt
    to consecutive batches. Then, round by round, the rows without a batch each propose one that
    has room (by hash); of proposals that share a key, with each other or with a row that has its
    place, the placed row or else the one first in hash order wins, and a batch takes no more than
    it has room for. So each round adds an independent set of the graph of rows that share keys.
    Later on, every other round lets rows propose full batches too, which then lose a row by hash:
    where only batches with a conflict have room, rows change places.
    What has found no place after ``rounds`` fills the room that is left, with conflicts, as when a
    key has more rows than there are batches. Batches go to ``shards`` trainers in turn. No task
    holds more than the proposals of one batch or of one key in it. ``key`` has to be unique.
    """
    name = F.col(key)
    rows = df.select(name.alias("r"), F.coalesce(keys, F.array()).alias("k"), T.hash_order(name, f"deal{seed}").alias("o"))
    rows = stored(ranked(rows.withColumn("first", F.coalesce(F.get("k", F.lit(0)).cast("string"), F.col("r").cast("string"))), ["first"], "r", f"deal{seed}").withColumnRenamed("__r", "at"))
    n = rows.count()
    batches = max(1, -(-n // size))
    order = F.struct("o", "r")

    def accepted(asked: DataFrame, placed: DataFrame | None) -> DataFrame:
        """Of ``r, k, o, b, room`` those that win."""
        each = asked.select("r", "o", "b", F.explode(F.array_distinct("k")).alias("key"))
        lost = each.join(each.groupBy("b", "key").agg(F.min(order).alias("best")), ["b", "key"]).where(order != F.col("best")).select("r")
        if placed is not None:
            held = placed.select("b", F.explode("k").alias("key"))
            lost = lost.unionByName(each.join(held, ["b", "key"], "left_semi").select("r"))
        left = asked.join(lost.distinct(), "r", "left_anti")
        return left.withColumn("q", F.row_number().over(Window.partitionBy("b").orderBy("o", "r"))).where(F.col("q") <= F.col("room")).select("r", "k", "o", "b")

    start = F.pmod(F.xxhash64("first", F.lit(seed)) + F.col("at"), F.lit(batches))
    placed = stored(accepted(rows.select("r", "k", "o", start.alias("b"), F.lit(size).alias("room")), None))
    all_ = df.sparkSession.range(batches).select(F.col("id").alias("b"))
    for turn in range(rounds):
        waiting = stored(rows.join(placed, "r", "left_anti").select("r", "k", "o"))
        if waiting.isEmpty():
            break
        evict = turn >= EVICT_FROM and turn % 2 == 1
        left = F.lit(size) - F.coalesce("n", F.lit(0))
        room = all_.join(placed.groupBy("b").agg(F.count("*").alias("n")), "b", "left").select("b", (F.greatest(left, F.lit(1)) if evict else left).alias("room")).where("room > 0")
        room = stored(ranked(room, [], "b", str(turn)).withColumnRenamed("__r", "slot"))
        free = room.count()
        asked = waiting.withColumn("slot", F.pmod(F.xxhash64("r", F.lit(turn), F.lit(seed)), F.lit(free)) + 1).join(room, "slot").select("r", "k", "o", "b", "room")
        now = placed.withColumn("old", F.lit(1)).unionByName(accepted(asked, placed).withColumn("old", F.lit(0)))
        if evict:
            now = now.withColumn("q", F.row_number().over(Window.partitionBy("b").orderBy("old", F.xxhash64("r", F.lit(turn)), "r"))).where(F.col("q") <= size)
        placed = stored(now.select("r", "k", "o", "b"))
    waiting = rows.join(placed, "r", "left_anti")
    room = all_.join(placed.groupBy("b").agg(F.count("*").alias("n")), "b", "left").select("b", F.explode(F.sequence(F.lit(1), F.lit(size) - F.coalesce("n", F.lit(0)).cast("int"))).alias("s")).where("s > 0")
    room = ranked(room.withColumn("x", F.concat_ws("|", "b", "s")), [], "x", "room").select(F.col("__r").alias("slot"), "b")
    last = ranked(waiting.select("r", "k", "o"), [], "r", "last").join(room, F.col("__r") == F.col("slot")).select("r", "k", "o", "b")
    out = placed.unionByName(last).withColumn("place", (F.row_number().over(Window.partitionBy("b").orderBy("o", "r")) - 1).cast("long"))
    return out.select(F.col("r").alias(key), (F.col("b") % shards).cast("long").alias("shard"), F.col("b").cast("long").alias("batch"), "place")


def evaluated(views: DataFrame, step: str = "step", metric: str = "ndcg_10") -> DataFrame:
    """Mean over views at each step, and whether it is strictly better than all steps before."""
    means = views.groupBy(step).agg(F.avg(metric).alias(metric))
    before = F.max(metric).over(Window.orderBy(step).rowsBetween(Window.unboundedPreceding, -1))
    return means.withColumn("is_best", F.coalesce(F.col(metric) > before, F.lit(True)))
