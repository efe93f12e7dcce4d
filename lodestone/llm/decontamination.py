"""Benchmark decontamination in SQL functions only.

The test items' normalised windows are a broadcast hash table; a bit set of their hashes, sized
to their number, travels with the plan. Documents are scanned once: every window of a document
is hashed and tested, and of the few that pass, the words themselves are looked up in the table,
which verifies every hit. Neither words nor texts of documents are shuffled, only one row per
document and one per window that hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import let
from lodestone.llm.common import apart, written

N = 10
#: Up to so many distinct test windows are broadcast (about 25 MB); more are joined by shuffling.
BROADCAST_WINDOWS = 200_000
#: Bits per window, and the most words of 64 bits in the bit set (1 MB: 8 bits for each of a million windows).
BITS_EACH, MOST_WORDS = 64, 1 << 17
#: Words of a text before A-Z are lowered; lowering them moves no edge of a word.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0))


def _hashes(w: Column) -> Column:
    # lower() also lowers other letters than A-Z: what is equal stays equal, the join tells the rest apart
    return F.transform(w, lambda x: F.xxhash64(F.lower(x)))


def _starts(w: Column, n: int) -> Column:
    return F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))


def _window(w: Column, at: Column, n: int | Column) -> Column:
    return F.translate(F.array_join(F.slice(w, at, n), " "), _UPPER, _LOWER)


def test_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", n: int = N) -> DataFrame:
    """Distinct windows: ``window``, its words ``len``, its hash ``h`` and the ``items`` that hold it.

    Items of fewer than ``n`` words, but not none, are one window. Null texts have none.
    """
    w = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.lit(n), F.size("w"))
    rows = w.select("item", "w", size.alias("len"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"))
    rows = rows.select("item", "len", _window(F.col("w"), F.col("at"), F.col("len")).alias("window"), F.xxhash64(_hashes(F.slice("w", F.col("at"), F.col("len")))).alias("h"))
    return rows.groupBy("window", "len").agg(F.min("h").alias("h"), F.collect_set("item").alias("items"))


test_windows.__test__ = False  # pytest: not a test


def _bit_set(windows: DataFrame, count: int) -> tuple[Column, int]:
    size = 64
    while size < MOST_WORDS and size * 64 < count * BITS_EACH:
        size *= 2
    bit = F.pmod("h", F.lit(size * 64))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
    rows = windows.select(F.floor(bit / 64).cast("int").alias("k"), one.alias("b")).groupBy("k").agg(F.bit_or("b").alias("b")).collect()
    held = dict(rows)
    literal = ",".join(str(held.get(i, 0)) for i in range(size))
    return F.expr(f"cast(split('{literal}', ',') as array<bigint>)"), size * 64


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """Per row of ``docs``: ``n_words``, ``hits`` (1-based places of hit words, ascending) and ``items``.

    Repeated rows and rows of the same id (null too) give one row each; ``text_hash`` tells
    texts apart. Null and empty texts have no words; texts may be of any length. An empty
    benchmark hits nothing, an empty table gives no rows. Further columns are left out.
    """
    windows = written(test_windows(benchmark, n=n), "windows")
    sizes = windows.groupBy("len").count().collect()  # at most n rows
    count = sum(r["count"] for r in sizes)
    w_type = "array<struct<at:int,len:int,window:string>>"
    empty = F.array().cast(w_type)
    if count:
        bits, n_bits = _bit_set(windows, count)

        def passing(w: Column, h: Column, size: int) -> Column:
            def places(slots: Column) -> Column:
                def test(i: Column) -> Column:
                    slot = F.get(slots, i - 1)
                    return F.call_function("shiftright", F.get(bits, F.shiftright(slot, 6)), F.pmod(slot, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1

                return F.filter(_starts(w, size), test)

            slots = F.transform(_starts(w, size), lambda i: F.pmod(F.xxhash64(F.slice(h, i, size)), F.lit(n_bits)).cast("int"))
            return F.transform(let(slots, places), lambda i: F.struct(i.alias("at"), F.lit(size).alias("len"), _window(w, i, size).alias("window")))

        def found(w: Column) -> Column:
            return let(_hashes(w), lambda h: F.struct(F.size(w).alias("n_words"), F.concat(*[passing(w, h, r["len"]) for r in sizes]).cast(w_type).alias("found")))

        scanned = let(words(F.col(text_col)), found)
    else:
        scanned = F.struct(F.size(words(F.col(text_col))).alias("n_words"), empty.alias("found"))
    # one row for the document itself, one for each window that passed
    own = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("len"), F.lit("").alias("window")))
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), scanned.alias("x"))
    rows = rows.select("__row", "doc_id", "text_hash", F.col("x.n_words").alias("n_words"), F.inline(F.concat(own, "x.found")))
    tests = windows.select("window", "len", "items")
    if count <= BROADCAST_WINDOWS:
        tests = F.broadcast(tests)
    rows = rows.join(tests, ["window", "len"], "left").where((F.col("len") == 0) | F.col("items").isNotNull())
    hit = F.when(F.col("items").isNotNull(), F.struct("at", "len"))
    per = rows.groupBy("__row", "doc_id", "text_hash").agg(F.max("n_words").cast("long").alias("n_words"), F.collect_set(hit).alias("hit"), F.collect_set("items").alias("items"))
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("hit", lambda x: F.sequence(x["at"], x["at"] + x["len"] - 1)))))
    return per.select("doc_id", "text_hash", "n_words", places.alias("hits"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, how: str = "documents", id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """The documents' own columns without contaminated documents, or without their hit words.

    ``how="documents"`` drops every row that has a hit; ``how="spans"`` keeps all rows and
    cuts the hit words, with what lies between two of them, out of their texts. Null and
    empty texts stay as they are; repeated rows are treated alike.
    """
    docs, back = apart(docs, id_col, text_col)
    marks = scan(docs, benchmark, id_col, text_col, n).where(F.size("hits") > 0).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("hits").alias("__hits")).dropDuplicates(["__id", "__hash"])
    same = docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__hash"))
    if how == "documents":
        return back(docs.join(marks, same, "left_anti"))
    gaps = F.split(F.col(text_col), _WORD)

    def kept(w: Column) -> Column:
        def cut(gone: Column) -> Column:
            def piece(i: Column) -> Column:
                word = F.when(F.array_contains(gone, i), F.lit("")).otherwise(F.get(w, i - 1))
                gap = F.when(F.array_contains(gone, i) & F.array_contains(gone, i + 1), F.lit("")).otherwise(F.get(F.col("__gaps"), i))
                return F.concat(word, gap)

            return F.concat(F.get(F.col("__gaps"), F.lit(0)), F.array_join(F.transform(_starts(w, 1), piece), ""))

        return let(F.col("__hits"), cut)

    joined = docs.join(marks, same, "left").withColumn("__gaps", F.when(F.col("__hits").isNotNull(), gaps))
    text = F.when(F.col("__hits").isNull(), F.col(text_col)).otherwise(let(words(F.col(text_col)), kept))
    return back(joined.withColumn(text_col, text).select(*docs.columns))
