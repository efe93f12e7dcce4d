"""Filters of generated questions, with one reason column instead of counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.lineage import cut


def question_type(key: Column, types: tuple[str, ...] = ("everyday", "search", "legal")) -> Column:
    """A type for each key, in turn."""
    return F.element_at(F.array(*[F.lit(t) for t in types]), (key % len(types) + 1).cast("int"))


def first_reason(question: Column, qtype: Column, copied: Column | None = None, citations: tuple[str, ...] = (T.ARTICLE_REF, T.META_PHRASES), token: str = T.TOKEN, space: str = r"\s") -> Column:
    """Why a question is dropped, null if it isn't: empty, then length, then citation, then copy."""
    out = F.when(question.isNull() | (T.stripped(question, space) == ""), "empty").when(T.length_broken(question, qtype, token, space), "length").when(T.cites(question, citations), "article_ref")
    return out if copied is None else out.when(copied, "copy_ngram")


def copied_from_own(question: Column, source: Column, n: int = 6, token: str = T.TOKEN) -> Column:
    """True if a question shares ``n`` words in a row with the source in its own row."""
    return F.arrays_overlap(T.ngrams(T.words(question, token), n), T.ngrams(T.words(source, token), n))


def copy_semi(docs: DataFrame, sources: DataFrame, text_col: str = "text", source_col: str = "text", n: int = 6, token: str = T.TOKEN, how: str = "left_semi") -> DataFrame:
    """Rows that do (``left_semi``) or don't (``left_anti``) share an n-gram with any source.

    Rows' n-grams are looked up as 64-bit hashes, beside the md5 of the row's text; the n-grams of
    the few that are found are compared as texts. The sources' n-grams are made distinct first.
    Null texts share nothing. No text is written or shuffled but those of rows that may be found.
    """
    rows = docs.withColumn("__m", F.md5(text_col))
    grams = T.ngrams(T.words(text_col, token), n)
    other = cut(sources.select(F.explode(T.ngrams(T.words(source_col, token), n)).alias("g")).distinct().withColumn("h", F.xxhash64("g")))
    seen = rows.select("__m", F.explode(F.transform(grams, lambda g: F.xxhash64(g))).alias("h"))
    maybe = cut(seen.join(other.select("h").distinct(), "h", "left_semi").select("__m").distinct())
    sure = rows.join(maybe, "__m", "left_semi").select("__m", F.explode(grams).alias("g")).join(other, "g", "left_semi").select("__m").distinct()
    return rows.join(sure, "__m", how).drop("__m")


def exact_duplicates(df: DataFrame, order: str, text_col: str = "text", token: str = T.TOKEN) -> DataFrame:
    """Add ``is_dup``: the normalised text was seen earlier in the order.

    The first row of a text is found by aggregation, so a text that a third of all rows
    share isn't gathered in one task. Normalised texts are compared by their 128-bit hashes.
    """
    keyed = df.withColumn("__n", F.md5(T.normalized(text_col, token)))
    first = keyed.groupBy("__n").agg(F.min(order).alias("__first"))
    return keyed.join(first, "__n").withColumn("is_dup", F.col(order) > F.col("__first")).drop("__n", "__first")


def judged(df: DataFrame, verdicts: DataFrame, key: str, verdict: str) -> DataFrame:
    """Add ``reason`` from a verdict table: ``missing`` without one, ``unanswerable`` unless it is yes."""
    joined = df.join(verdicts.select(key, F.col(verdict).alias("__v")), key, "left")
    reason = F.when(F.col("__v").isNull(), "missing").when(F.col("__v") != "yes", F.concat(F.lit("judge_"), F.col("__v")))
    return joined.withColumn("reason", reason).drop("__v")


def funnel(df: DataFrame, reason: str = "reason", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows per reason; kept ones count under ``kept``. The counts add up to the rows."""
    return df.groupBy(*by, F.coalesce(F.col(reason), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def unpivoted(df: DataFrame, columns: list[str], keys: list[str], name: str = "qtype", value: str = "text") -> DataFrame:
    """One row per column of each row."""
    return df.unpivot(keys, columns, name, value)


def parsed_output(df: DataFrame, raw: str = "raw", schema: str = "everyday string, search string, legal string") -> DataFrame:
    """``output`` from a JSON string and ``reason`` = invalid_json where it can't be parsed."""
    out = F.from_json(F.col(raw), schema)
    valid = F.try_parse_json(F.col(raw)).isNotNull() & (F.substring(F.trim(F.col(raw)), 1, 1) == "{")
    return df.withColumn("output", F.when(valid, out)).withColumn("reason", F.when(~F.coalesce(valid, F.lit(False)), F.lit("invalid_json")))


def lexical_overlap(questions: DataFrame, docs: DataFrame, key: str, groups: list[str], question: str = "question", text: str = "text", stems=None, token: str = T.TOKEN) -> DataFrame:
    """Per group: rows, mean and median share of a question's words that its document has, mean words."""
    stems = stems or (lambda x: x)
    own = docs.select(key, F.array_distinct(stems(T.words(text, token))).alias("__d"))
    q = questions.withColumn("__q", F.array_distinct(stems(T.words(question, token)))).where(F.size("__q") > 0)
    joined = q.join(own, key).withColumn("overlap", F.size(F.array_intersect("__q", "__d")) / F.size("__q"))
    return joined.groupBy(*groups).agg(F.count("*").alias("n"), F.avg("overlap").alias("overlap_mean"), F.median("overlap").alias("overlap_median"), F.avg(F.size("__q")).alias("words_mean"))


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
