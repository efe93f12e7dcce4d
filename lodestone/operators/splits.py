"""Samples and leak-free splits by hash order: the same rows in every run, engine and partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.joins import matched
from lodestone.functions.lineage import cut


def ranked(df: DataFrame, strata: list[str], key: str, salt: str, sizes: DataFrame | None = None) -> DataFrame:
    """Add ``__r``, the rank of each row in its stratum's hash order, from 1; null is a stratum too.

    Hashes are cut into 65,536 ranges; a row's rank is what its stratum has in the ranges before,
    plus its rank within its own, so that no task ever ranks a whole stratum. With ``sizes`` (the
    strata and ``__k``) only the first ``__k`` rows are kept, and ranges beyond aren't ranked at all.
    """
    h = T.hash_order(F.col(key), salt)
    rows = df.withColumn("__b", F.shiftright(h, 16))
    before = F.sum("__n").over(Window.partitionBy(*strata).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    ranges = rows.groupBy(*strata, "__b").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(before, F.lit(0)))
    if sizes is not None:
        ranges = matched(ranges, sizes, strata).where("__before < __k")
    joined = matched(rows, ranges.drop("__n"), [*strata, "__b"])
    own = F.row_number().over(Window.partitionBy(*strata, "__b").orderBy(h, F.col(key)))
    out = joined.withColumn("__r", F.col("__before") + own)
    return (out if sizes is None else out.where("__r <= __k").drop("__k")).drop("__b", "__before")


def half_even(x: Column) -> Column:
    return F.rint(x).cast("long")


def stratified_sample(df: DataFrame, strata: list[str], key: str, fraction: float, salt: str = "") -> DataFrame:
    """Of each stratum, its share rounded half to even."""
    sizes = df.groupBy(*strata).agg(half_even(F.count("*") * F.lit(fraction)).alias("__k"))
    return ranked(df, strata, key, salt, sizes).drop("__r")


def proportional_sample(df: DataFrame, strata: list[str], key: str, n: int, salt: str = "") -> DataFrame:
    """About ``n`` rows, of each stratum in proportion to its size (half to even, at most all)."""
    sizes = df.groupBy(*strata).agg(F.count("*").alias("__n"))
    total = Window.partitionBy()
    sizes = sizes.withColumn("__k", F.least(F.col("__n"), half_even(F.lit(n) * F.col("__n") / F.sum("__n").over(total))))
    return ranked(df, strata, key, salt, sizes.drop("__n")).drop("__r")


def balanced_types(df: DataFrame, groups: list[str], key: str, types: tuple[str, ...] = ("everyday", "search", "legal"), salt: str = "") -> DataFrame:
    """Add ``qtype``: types in turn along a hash order, so counts differ by one at most."""
    at = ((F.col("__r") - 1) % len(types) + 1).cast("int")
    return ranked(df, groups, key, salt).withColumn("qtype", F.element_at(F.array(*[F.lit(t) for t in types]), at)).drop("__r")


def stratified_pick(df: DataFrame, strata: list[str], key: str, n: int, salt: str = "") -> DataFrame:
    """The same number of each stratum: ``n`` divided by the count of strata, rounded down."""
    found = df.groupBy(*strata).agg(F.count("*").alias("__n"))
    sizes = found.withColumn("__k", F.floor(F.lit(n) / F.count("*").over(Window.partitionBy()))).drop("__n")
    return ranked(df, strata, key, salt, sizes).drop("__r")


def nested_fraction(df: DataFrame, key: str, fraction: float, salt: str = "") -> DataFrame:
    """A share of the rows; that of a smaller fraction lies inside that of a larger: the rows of least hash."""
    return stratified_sample(df, [], key, fraction, salt)


def make_splits(docs: DataFrame, code: str = "code", key: str = "doc_id", group: str = "group", text: str = "text", seed: int = 42, held_out: float = 0.10, test: tuple[int, int] = (300, 220), dev: tuple[int, int] = (225, 75), min_chars: int = 150) -> DataFrame:
    """One row per use of a document: ``split`` (held_out, train, test, dev), ``slice`` and ``qtype``.

    A share of each in-domain code is held out; the rest trains. Test is drawn before dev
    from seen and held-out documents of enough length, and dev from what test left. All
    long enough documents of other groups are test documents of unseen codes.
    """
    # texts stay where they are: what is ranked and joined are keys
    rows = cut(docs.select(key, code, group, (F.length(text) >= min_chars).alias("__long")))
    inside = rows.where(F.col(group) == "in_domain")
    sizes = inside.groupBy(code).agg(half_even(F.count("*") * F.lit(held_out)).alias("__k"))
    inside = cut(matched(ranked(inside, [code], key, f"{seed}held"), sizes, [code]).withColumn("__held", F.col("__r") <= F.col("__k")).drop("__r", "__k"))
    free = inside.where("__long").withColumn("slice", F.when(F.col("__held"), "unseen_articles").otherwise("seen"))
    items = None
    for split, (seen, unseen) in (("test", test), ("dev", dev)):
        sizes = free.groupBy("slice", code).agg(F.count("*").alias("__n"))
        wanted = F.when(F.col("slice") == "seen", F.lit(seen)).otherwise(F.lit(unseen)) * F.col("__n") / F.sum("__n").over(Window.partitionBy("slice"))
        sizes = sizes.select("slice", code, F.least(F.col("__n"), half_even(wanted)).alias("__k"))
        free = cut(matched(ranked(free, ["slice", code], key, f"{seed}{split}"), sizes, ["slice", code]).withColumn("__hit", F.col("__r") <= F.col("__k")).drop("__r", "__k"))
        one = free.where("__hit").select(key, F.lit(split).alias("split"), "slice")
        items = one if items is None else items.unionByName(one)
        free = free.where("not __hit").drop("__hit")
    beyond = rows.where((F.col(group) != "in_domain") & F.col("__long"))
    items = items.unionByName(beyond.select(key, F.lit("test").alias("split"), F.lit("unseen_codes").alias("slice")))
    items = balanced_types(items, ["split", "slice"], key, salt=f"{seed}type")
    rest = inside.select(key, F.when(F.col("__held"), "held_out").otherwise("train").alias("split"))
    return items.unionByName(rest, allowMissingColumns=True)


def split_stats(splits: DataFrame) -> DataFrame:
    return splits.groupBy("split", "slice").agg(F.count("*").alias("n"))


def leaks(splits_: DataFrame, docs: DataFrame, text: Column, code: str = "code", group: str = "group", key: str = "doc_id") -> DataFrame:
    """Counts of what must not happen between splits: ``check`` and ``n``, 0 where all is well.

    Training rows of held-out documents or of other groups; documents of both dev and test;
    slices that don't fit their document; evaluation documents whose normalised text (``text``)
    a training document has, too.
    """
    d = docs.select(key, F.col(group).alias("__g"), text.alias("__t"))
    rows = splits_.join(d, key)
    of = lambda *names: rows.where(F.col("split").isin(*names))
    held = of("held_out").select(key)
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    place = F.when(F.col("__g") != "in_domain", "unseen_codes").when(F.col("__h").isNotNull(), "unseen_articles").otherwise("seen")
    evals = of("dev", "test").join(held.withColumn("__h", F.lit(1)), key, "left")
    checks = [
        count("train_held_out", of("train").join(held, key, "left_semi")),
        count("train_other_group", of("train").where(F.col("__g") != "in_domain")),
        count("dev_and_test", of("dev").select(key).join(of("test"), key, "left_semi")),
        count("slice_differs", evals.where(F.col("slice") != place)),
        count("text_in_train", of("dev", "test").join(of("train").select("__t").distinct(), "__t", "left_semi")),
    ]
    return reduce(DataFrame.unionByName, checks)
