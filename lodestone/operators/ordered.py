"""Operations along an order that no task sees whole: as-of joins, interval joins, smoothing.

Rows are dealt out by ranges of their groups and order, so that a group of any size is cut into
parts. Each part is worked on by itself, and what it takes over from the parts before comes from
a table with one row per part and group.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.joins import matched
from lodestone.functions.lineage import cut


def _parted(df: DataFrame, by: list[str], order: list[str], parts: int | None) -> DataFrame:
    """Fixed ranges, numbered in ``__p``; rows of equal group and order share one."""
    keys = [F.asc_nulls_first(c) for c in [*by, *order]]
    dealt = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    return cut(dealt.withColumn("__p", F.spark_partition_id()))


def asof(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, tie: str, parts: int | None = None) -> DataFrame:
    """All rows of ``left``, with ``matched``: of the rows of ``right`` in the same group, the last one at or before it.

    ``matched`` is a struct of the right columns, null without such a row or if the left row's
    time is null; of rows at the same time it is the one with the largest ``tie``. Null is a
    group like others; right rows without a time are left out. A hot group is cut by time.
    """
    names = left.columns
    row = F.struct(*[F.col(c) for c in right.columns])
    none = F.lit(None)
    a = left.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], F.col(left_on).alias("__t"), F.lit(1).alias("__side"), none.cast(right.schema[tie].dataType).alias("__tie"), F.struct(*names).alias("__l"), none.cast(right.select(row.alias("r")).schema["r"].dataType).alias("__r"))
    b = right.where(F.col(right_on).isNotNull()).select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], F.col(right_on).alias("__t"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), none.cast(left.select(F.struct(*names).alias("l")).schema["l"].dataType).alias("__l"), row.alias("__r"))
    groups = [f"__g{i}" for i in range(len(by))]
    rows = _parted(a.unionByName(b), groups, ["__t"], parts)
    own = Window.partitionBy(*groups, "__p").orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # what each part hands on is its last right row; a group has at most one row per part
    last = rows.where("__side = 0").groupBy(*groups, "__p").agg(F.max(F.struct("__t", "__tie", "__r")).alias("__x"))
    parts_ = rows.select(*groups, "__p").distinct().join(last.withColumnsRenamed({g: f"{g}x" for g in groups} | {"__p": "__q"}), _same(groups, F.col("__p") == F.col("__q")), "left").select(*groups, "__p", F.col("__x.__r").alias("__x"))
    before = Window.partitionBy(*groups).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts_.withColumn("__x", F.last("__x", ignorenulls=True).over(before))
    out = matched(rows.withColumn("__own", F.last("__r", ignorenulls=True).over(own)).where("__side = 1"), carry, [*groups, "__p"])
    found = F.when(F.col("__t").isNotNull(), F.coalesce("__own", "__x"))
    return out.select("__l.*", found.alias("matched"))


def _same(groups: list[str], more: Column) -> Column:
    out = more
    for g in groups:
        out = out & F.col(g).eqNullSafe(F.col(f"{g}x"))
    return out


def overlaps(left: DataFrame, right: DataFrame, by: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int = 1024, factor: int = 8, levels: int = 16) -> DataFrame:
    """All pairs of a left and a right row of one group whose closed intervals of integers overlap.

    ``left`` and ``right`` must differ in all column names but ``by``. An interval's level is the
    least whose bins, ``width * factor ** level`` long, aren't shorter than it; at any level from
    its own on it touches at most two bins. A pair meets at the larger of both levels, in the bin
    where the later of the two begins, so once, and no interval is cut into many bins however long
    it is. Rows with a null end, an end before the start or a null group meet nothing.
    """

    def binned(df: DataFrame, span: tuple[str, str], side: str) -> DataFrame:
        start, end = (F.col(c).cast("long") for c in span)
        rows = df.where(start <= end)
        level = F.lit(levels)
        for k in range(levels - 1, -1, -1):
            level = F.when(end - start < width * factor**k, k).otherwise(level)
        rows = rows.withColumn(f"__{side}", level)
        rows = rows.withColumn("__c", F.explode(F.sequence(F.col(f"__{side}"), F.lit(levels))))
        # the top level is one bin
        bin_ = lambda x: F.when(F.col("__c") < levels, F.floor(x / (F.lit(width) * F.pow(F.lit(factor), F.col("__c"))))).otherwise(F.lit(0)).cast("long")
        rows = rows.withColumn(f"__b{side}", bin_(start))
        return rows.withColumn("__b", F.explode(F.sequence(F.col(f"__b{side}"), bin_(end))))

    a, b = binned(left, left_span, "l"), binned(right, right_span, "r")
    # only levels that the other side has can be met
    met = a.join(b, [*by, "__c", "__b"])
    met = met.where((F.col("__c") == F.greatest("__l", "__r")) & (F.col("__b") == F.greatest("__bl", "__br")))
    met = met.where((F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(right_span[0]) <= F.col(left_span[1])))
    return met.select(*left.columns, *[c for c in right.columns if c not in by])


def smoothed(df: DataFrame, series: str, order: str, value: str, alpha: float = 0.15, parts: int | None = None) -> DataFrame:
    """Exponential smoothing of each series from its first value, by a prefix scan.

    A step maps the last value y to ``alpha * x + (1 - alpha) * y``, an affine map, and so does a
    part of a series. Parts are folded to their maps, the maps of a series are composed one
    after the other (a row per part), and all parts are then finished side by side. Null values
    are left out; places have to be unique within a series; null is a series like others.
    """
    kind, place = df.schema[series].dataType.simpleString(), df.schema[order].dataType.simpleString()
    rows = df.where(F.col(value).isNotNull()).select(F.col(series).alias("s"), F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    rows = _parted(rows, ["s"], ["o"], parts)

    def smooth(v: pd.Series, last: float) -> pd.Series:
        return pd.concat([pd.Series([last]), v]).ewm(alpha=alpha, adjust=False).mean().iloc[1:]

    def folded(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o", kind="stable")
        return pd.DataFrame({"s": [pdf["s"].iloc[0]], "__p": [pdf["__p"].iloc[0]], "first": [pdf["v"].iloc[0]], "end": [smooth(pdf["v"], 0.0).iloc[-1]], "keep": [(1 - alpha) ** len(pdf)]})

    maps = rows.groupBy("s", "__p").applyInPandas(folded, f"s {kind}, __p int, first double, end double, keep double")

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__p")
        last, out = pdf["first"].iloc[0], []
        for end, keep in zip(pdf["end"], pdf["keep"], strict=True):
            out.append(last)
            last = end + keep * last
        return pdf[["s", "__p"]].assign(last=out)

    carry = maps.groupBy("s").applyInPandas(composed, f"s {kind}, __p int, last double")

    def finished(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o", kind="stable")
        return pdf[["s", "o", "v"]].assign(ema=smooth(pdf["v"], pdf["last"].iloc[0]).to_numpy())

    out = matched(rows, carry, ["s", "__p"]).groupBy("s", "__p").applyInPandas(finished, f"s {kind}, o {place}, v double, ema double")
    return out.select(F.col("s").alias(series), F.col("o").alias(order), F.col("v").alias(value), "ema")
