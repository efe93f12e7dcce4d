from lodestone.functions import text as T
from lodestone.functions.stemmer import stem
from lodestone.operators import filters
from pyspark.sql import functions as F


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr.alias("x")).first().x


def test_words_and_normal_form(spark):
    assert one(spark, T.words("t"), t="Ёлки-Палки, ЗАЁМ 2024") == ["елки", "палки", "заем", "2024"]
    assert one(spark, T.normalized("t"), t="  Срок,  ИСПЫТАНИЯ! ") == "срок испытания"
    assert spark.sql("select cast(null as string) t").select(T.words("t").alias("x")).first().x == []


def test_ngrams(spark):
    grams = T.ngrams(F.split("t", " "), 2)
    assert one(spark, grams, t="a b a b") == ["a b", "b a"]
    assert one(spark, grams, t="a") == []


def test_length_limits(spark):
    broken = T.length_broken(F.col("q"), F.col("k"))
    cases = [("everyday", "x" * 19, True), ("everyday", "x" * 20, False), ("everyday", "x" * 401, True), ("search", "увольнение по собственному", False), ("search", "увольнение", True), ("search", "а б в г д е ж з и к", True), ("legal", " " + "x" * 20 + " ", False), ("title", "x", False)]
    for kind, q, want in cases:
        assert one(spark, broken, q=q, k=kind) is want, (kind, q)


def test_citations(spark):
    for q, want in [("Что говорит статья 81?", True), ("по ст. 22.1 ТК", True), ("СТАТЬЕ № 5", True), ("что в данной статье", True), ("настоящий кодекс о чём", True), ("статус работника 5 лет", False), ("как уволиться", False)]:
        assert one(spark, T.cites(F.col("q")), q=q) is want, q


def test_reason_order(spark):
    reason = filters.first_reason(F.col("q"), F.col("k"), F.lit(True))
    assert one(spark, reason, q="  ", k="everyday") == "empty"
    assert one(spark, reason, q="ст. 5", k="everyday") == "length"
    assert one(spark, reason, q="что сказано в ст. 5 кодекса", k="everyday") == "article_ref"
    assert one(spark, reason, q="как уволиться по своему желанию", k="everyday") == "copy_ngram"
    assert one(spark, filters.first_reason(F.col("q"), F.col("k")), q="как уволиться по своему желанию", k="everyday") is None


def test_copy_needs_six_words_in_a_row(spark):
    copied = filters.copied_from_own(F.col("q"), F.col("s"))
    assert one(spark, copied, q="x a b c d e F y", s="a, b c d e f g") is True
    assert one(spark, copied, q="a b c d e", s="a b c d e f") is False


def test_exact_duplicates_keep_the_first(spark):
    df = spark.createDataFrame([(3, "Да!"), (1, "да"), (2, "нет"), (4, "ДА.")], "ord long, text string")
    got = {r.ord: r.is_dup for r in filters.exact_duplicates(df, "ord").collect()}
    assert got == {1: False, 2: False, 3: True, 4: True}


def test_funnel_adds_up(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, "b")], "k long, reason string")
    assert {r.reason: r.n for r in filters.funnel(df).collect()} == {"a": 2, "b": 1, "kept": 1}


def test_judge_and_json(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k long")
    verdicts = spark.createDataFrame([(1, "yes"), (2, "no"), (3, "invalid")], "k long, v string")
    assert {r.k: r.reason for r in filters.judged(rows, verdicts, "k", "v").collect()} == {1: None, 2: "judge_no", 3: "judge_invalid", 4: "missing"}
    raw = spark.createDataFrame([(1, '{"everyday": "a"}'), (2, "{oops"), (3, None), (4, "[1]")], "k long, raw string")
    got = {r.k: r for r in filters.parsed_output(raw).collect()}
    assert got[1].output.everyday == "a" and got[1].reason is None
    assert [got[i].reason for i in (2, 3, 4)] == ["invalid_json"] * 3


def test_unpivot_and_paths(spark):
    df = spark.createDataFrame([(1, "a", "b")], "k long, everyday string, legal string")
    assert {(r.qtype, r.text) for r in filters.unpivoted(df, ["everyday", "legal"], ["k"]).collect()} == {("everyday", "a"), ("legal", "b")}
    p = "/kodeks/SK-RF/razdel-i/glava-1/statja-1/"
    assert one(spark, T.slug("p"), p=p) == "statja-1"
    assert one(spark, T.page_file_name("p"), p=p) == "razdel-i__glava-1__statja-1.html"
    assert one(spark, T.without_code(F.col("h")), h="ТК РФ, Статья 1. Цели, задачи") == "Статья 1. Цели, задачи"
    assert one(spark, T.without_code(F.col("h")), h="без запятой") == "без запятой"


def test_hash_seed_is_md5(spark):
    import hashlib

    want = 42 + int(hashlib.md5(b"tk-81").hexdigest()[:8], 16) % 1_000_000
    assert one(spark, T.stable_seed(F.col("k")), k="tk-81") == want


def test_stemmer_pairs():
    # pairs of the published sample vocabulary
    pairs = {"важная": "важн", "вагоны": "вагон", "важнейшие": "важн", "вдохновенье": "вдохновен", "вечерами": "вечер", "молодость": "молод", "говорила": "говор", "падающий": "пада", "испытания": "испытан", "увольнение": "увольнен", "работника": "работник", "день": "ден"}
    assert {w: stem(w) for w in pairs} == pairs
