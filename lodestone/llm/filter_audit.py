"""Filter interaction audit by direct relational replay.

Every document, with one boolean a filter, meets all orders of the filters (120 of five), which
are a broadcast table. Each pair gives the step of its first failing filter, and a row a step;
conditional counts over these rows are combined in the tasks before anything is shuffled, so
that what leaves a task is at most one row a part, order and step.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import dropped, written

WORD_EDGE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Orders are a broadcast table of n! rows.
MOST_FILTERS = 6
#: The most frequent texts, whose rows don't move to meet their first holder.
FREQUENT = 1000


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_EDGE), "")


def flagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per row: ``doc_id``, ``part`` and whether it fails A to E.

    A: under 200 words; B: fewer than half of the words are distinct; C: more than 3 % of the
    code points are A-Z; D: holds one of ``#$%&*|``; E: a smaller id has the same text. Null and
    empty texts are equal and have no words; a null part is the empty string; a null id is
    neither smaller nor larger than another; repeated rows fail alike. Texts may be of any length.
    Texts are read once and stay where they are: what meets is their digest.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t"), words(text).alias("w"))
    upper = F.length("t") - F.length(F.translate("t", UPPER, ""))
    rows = rows.select(
        "doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"),
        (F.size("w") < 200).alias("A"),
        (100 * F.size(F.array_distinct("w")) < 50 * F.size("w")).alias("B"),
        (100 * upper.cast("long") > 3 * F.length("t").cast("long")).alias("C"),
        F.col("t").rlike(r"[#$%&*|]").alias("D"),
    )
    rows = written(rows, "flags")
    # only texts that occur again have a first holder; the most frequent ones, which may be a third of all rows, are broadcast
    again = written(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "copies")
    most = F.broadcast(again.orderBy(F.desc("n"), "digest").limit(FREQUENT).select("digest", "first"))
    rest = again.join(most, "digest", "left_anti").select("digest", "first")
    out = rows.join(most, "digest").unionByName(rows.join(most, "digest", "left_anti").join(rest, "digest", "left"))
    out = out.select("doc_id", "part", *"ABCD", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"))
    out = written(out, "flags-of-copies")
    dropped(rows)
    dropped(again)
    return out


def replayed(rows: DataFrame, filters: list[str], part_col: str = "part", outcomes: dict[str, Column] | None = None) -> DataFrame:
    """One row per part, order of the filters and step, with counts of the part's rows.

    ``filters`` are names of boolean columns of one letter each, true where a row fails (null is
    no failure); ``outcomes`` names conditions that are counted among the rows removed at a step.
    ``kept``: rows that pass all steps up to this one; ``removed``: rows whose first failure it
    is; ``redundant``: rows that fail its filter and were removed before; ``unique_fails``: rows
    that fail its filter only; ``shapley``: rows that its filter removes, over all orders.
    Repeated rows count each; a null part is a part; no rows give no rows.
    """
    if not 0 < len(filters) <= MOST_FILTERS or any(len(x) != 1 for x in filters):
        raise ValueError(f"from 1 to {MOST_FILTERS} filters of one letter")
    n, bit = len(filters), {x: 1 << i for i, x in enumerate(filters)}
    steps = [f"b{i}" for i in range(1, n + 1)]
    orders = rows.sparkSession.createDataFrame([("".join(p), *(bit[x] for x in p)) for p in permutations(filters)], "filter_order string, " + ", ".join(f"{s} int" for s in steps))
    names = list(outcomes or {})
    fails = sum((F.when(F.col(x), bit[x]).otherwise(0) for x in filters), F.lit(0))
    few = rows.select(F.col(part_col).alias("part"), fails.alias("fails"), *[F.coalesce(c, F.lit(False)).alias(f"is_{x}") for x, c in (outcomes or {}).items()])
    met = few.crossJoin(F.broadcast(orders))
    first = F.lit(n + 1)
    for i in range(n, 0, -1):
        first = F.when(F.col("fails").bitwiseAND(F.col(f"b{i}")) != 0, i).otherwise(first)
    met = met.withColumn("first", first)
    each = F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"b{i}").alias("own")) for i in range(1, n + 1)])
    each = met.select("part", "filter_order", "fails", "first", *[f"is_{x}" for x in names], F.inline(each))
    here = F.col("first") == F.col("step")
    counts = each.groupBy("part", "filter_order", "step").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"),
        F.count_if(here).alias("removed"),
        F.count_if((F.col("first") < F.col("step")) & (F.col("fails").bitwiseAND(F.col("own")) != 0)).alias("redundant"),
        F.count_if(F.col("fails") == F.col("own")).alias("unique_fails"),
        *[F.count_if(here & F.col(f"is_{x}")).alias(x) for x in names],
    )
    # a part has n! rows a filter
    own = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return counts.withColumn("shapley", F.sum("removed").over(own))


def audited(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """:func:`replayed` of :func:`flagged`, with what is lost of the rows that ``labels`` calls good or toxic.

    An id with several labels is good, or toxic, where one of them says so; labels of ids that
    the table doesn't have count nowhere.
    """
    said = labels.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    rows = flagged(docs, id_col, text_col, part_col).join(said, "doc_id", "left")
    return replayed(rows, list("ABCDE"), outcomes={"good_lost": F.col("good"), "toxic_lost": F.col("bad")})
