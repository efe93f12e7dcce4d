import random

import pytest
from lodestone.functions import text as T
from lodestone.operators import chunking, pages
from pyspark.sql import functions as F


def test_pieces_by_hand():
    assert chunking.pieces("", 10) == []
    assert chunking.pieces("aaa\n\nbbb\nccc", 7) == ["aaa\nbbb", "ccc"]
    assert chunking.pieces("aaa\nbbb\nccc", 7, 3) == ["aaa\nbbb", "bbb\nccc"]
    assert chunking.pieces("aaa\nbbb\ncccccc", 7, 3) == ["aaa\nbbb", "cccccc"]  # the overlap would not fit
    assert chunking.pieces("One two. Three four! Five", 10) == ["One two.", "Three", "four!\nFive"]
    assert chunking.pieces("x" * 15, 10) == ["x" * 15]
    for size, overlap in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            chunking.pieces("a", size, overlap)


def plain_pieces(text, size, overlap):
    """The rule stated plainly: close a piece when the next unit doesn't fit; carry whole units back."""
    out, now = [], []
    for u in chunking.units(text, size):
        if now and len("\n".join([*now, u])) > size:
            out.append(now)
            back = []
            for x in now[::-1]:
                if len("\n".join([x, *back])) > overlap:
                    break
                back = [x, *back]
            now = back if len("\n".join([*back, u])) <= size else []
        now = [*now, u]
    return ["\n".join(p) for p in [*out, now] if p]


def test_pieces_against_the_plain_rule():
    rng = random.Random(1)
    for _ in range(300):
        text = "\n".join(" ".join("w" * rng.randint(1, 9) + rng.choice(["", ".", ";"]) for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(0, 6)))
        size = rng.randint(5, 60)
        overlap = rng.randint(0, size - 1)
        got = chunking.pieces(text, size, overlap)
        assert got == plain_pieces(text, size, overlap)
        assert all(len(p) <= size or "\n" not in p and " " not in p for p in got)


def test_parts():
    assert chunking.parts("x" * 4000) == ["x" * 4000]
    text = "\n".join("y" * 99 for _ in range(100))
    got = chunking.parts(text)
    assert len(got) == 3 and "\n".join(got) == text


def test_chunks_and_titles(spark):
    df = spark.createDataFrame([(1, "aaa\nbbb", "T1"), (2, "", "T2"), (3, None, "T3")], "doc_id long, text string, title string")
    df = df.withColumn("header", T.header(F.lit("ТК РФ"), F.col("doc_id").cast("string"), F.col("title")))
    chunks = chunking.chunks(df, F.col("header"), 4, 0)
    got = {r.chunk_id: r for r in chunks.collect()}
    assert set(got) == {"1#0", "1#1", "2#0", "3#0"}
    assert got["1#1"].text == "ТК РФ, Статья 1. T1\nbbb" and got["2#0"].body == "ТК РФ, Статья 2. T2"
    assert [(r.qid, r.pos_text) for r in chunking.title_pairs(chunks, df).collect()] == [("title-1", "aaa")]


def blocks(spark, *rows):
    return spark.createDataFrame([(1, i, k, t) for i, (k, t) in enumerate(rows)], "page long, pos int, kind string, text string")


def articles(spark, *rows):
    return [(r.number, r.title, r.chapter, r.text, r.status) for r in pages.sections(blocks(spark, *rows)).orderBy("seq").collect()]


def test_sections_headings_and_bodies(spark):
    got = articles(spark, ("center", "Раздел I"), ("p", "Глава 1. Общие"), ("p", "Статья 1. Цели"), ("p", "Текст\xa0один"), ("center", "§ 2"), ("p", "2. Утратил силу. - Закон"), ("p", "Два"), ("p", "Статья 22.1. Другая"), ("p", "Три"))
    assert got == [("1", "Цели", "1", "Текст один\nДва", "active"), ("22.1", "Другая", "1", "Три", "active")]


def test_sections_chapter_closes_and_carries(spark):
    got = articles(spark, ("p", "Глава II. Б"), ("p", "Статья 5. А"), ("p", "x"), ("center", "ГЛАВА 3. В"), ("p", "вне статьи"), ("p", "Статья 6. Б"), ("p", "y"))
    assert got == [("5", "А", "II", "x", "active"), ("6", "Б", "3", "y", "active")]


def test_sections_stop_only_while_an_article_is_open(spark):
    got = articles(spark, ("right", "Президент"), ("p", "Статья 1. А"), ("p", "x"), ("right", "Президент"), ("p", "Статья 2. Б"), ("p", "y"))
    assert got == [("1", "А", "", "x", "active")]
    got = articles(spark, ("p", "Статья 1. А"), ("p", "Глава 2. Б"), ("stop", ""), ("p", "Статья 2. В"), ("p", "y"))
    assert [g[0] for g in got] == ["1", "2"]


def test_status(spark):
    cases = [("Утратила силу", "", "repealed"), ("Статья 149, статья 150. Утратили силу", "", "repealed"), ("А", "Утратил силу. " + "x" * 400, "active"), ("А", "Утратил силу", "repealed"), ("А", "", "empty"), ("А", "<*> сноска\n<**> ещё", "empty"), ("А", "<*> сноска\nтекст", "active"), ("Утрата силы", "x", "active")]
    df = spark.createDataFrame(cases, "title string, body string, want string")
    for r in df.select("want", pages.status(F.col("title"), F.col("body")).alias("got"), "title").collect():
        assert r.got == r.want, r.title


PAGE = """<html><h1>Кодекс (ред. от 01.01.2024) (ред.&nbsp;от 02.02.2025)</h1><div class="x"><p>outside</p></div>
<div class="main-center-block"><p class="pCenter">Глава 1</p><p class="pBoth">Статья&nbsp;1. <b>Цели</b><br>и задачи<p>два<script>var t="</p>"</script></p><div class="pb-2"><p>teaser</p></div><p class="pRight">Подпись</p></div></html>"""


def test_page_blocks(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<p>no root</p>"), (3, None)], "page_id long, html string")
    got = {r.page_id: r.x for r in df.select("page_id", pages.page_parts(F.col("html")).alias("x")).collect()}
    assert [(b.kind, b.text) for b in got[1].blocks] == [("center", "Глава 1"), ("p", "Статья 1. Цели и задачи"), ("p", "два"), ("stop", ""), ("p", "teaser"), ("right", "Подпись")]
    assert got[2].blocks is None and got[3].blocks is None
    assert spark.range(1).select(pages.edition(F.lit(got[1].h1)).alias("x")).first().x == "ред. от 01.01.2024; ред. от 02.02.2025"
    assert spark.range(1).select(pages.edition(F.lit("Кодекс")).alias("x")).first().x == "Кодекс"


def test_single_article_pages(spark):
    html = '<div class="main-center-block-crambs"><a>Главная</a><a>Глава 3. Дети</a></div><h1>Статья 7. Имя</h1><div class="main-center-block-article-text"><p>a</p><p>Утратил силу. - Закон</p><p>b</p><p class="pRight">П</p><p>c</p></div>'
    df = spark.createDataFrame([("/k/glava-22/statja-7/", html), ("/k/", "<h1>Другое</h1>"), ("/k/glava-9/s/", "<h1>Статья 8. Без</h1>")], "url string, html string")
    got = {r.number: (r.title, r.chapter, r.chapter_title, r.text, r.status) for r in pages.single_articles(df).collect()}
    assert got == {"7": ("Имя", "3", "Дети", "a\nb", "active"), "8": ("Без", "9", "", "", "empty")}


def test_links_in_first_seen_order(spark):
    df = spark.createDataFrame([(1, '<a href="/k/TK/statja-2/">x</a><a class="y" href="/k/TK/statja-1/">x</a><a href="/k/TK/statja-2/"></a><a href="/k/SK/statja-1/"></a>')], "page_id long, html string")
    got = pages.links(df, "^/k/TK/.*statja-[^/]+/$").orderBy("pos").collect()
    assert [r.href for r in got] == ["/k/TK/statja-2/", "/k/TK/statja-1/"]


def test_unique_keys(spark):
    df = spark.createDataFrame([(1,), (2,)], "k long")
    assert pages.assert_unique(df, "k") is df
    with pytest.raises(ValueError, match="1"):
        pages.assert_unique(df.unionByName(df), "k")


def test_no_law_gathers_its_texts_in_one_task(spark, monkeypatch):
    docs = spark.createDataFrame([(str(i), "en", "t") for i in range(20)], "doc_id string, code string, text string")
    laws = spark.createDataFrame([("en", "EN")], "code string, name string").distinct()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = pages.union_of([docs], laws)
        assert "SortMergeJoin" not in both._jdf.queryExecution().toString()
        assert both.where("name = 'EN'").count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pages_are_read_in_small_batches(spark):
    # an Arrow batch was of 10,000 pages of any length
    df = spark.range(1000).select(F.concat(F.lit("<p>a"), F.col("id"), F.lit("</p><p class=pCenter>b")).alias("html")).coalesce(1)
    got = df.select(pages.page_parts(F.col("html"), None).alias("x"))
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.where("x.blocks[1].kind = 'center' AND x.h1 IS NULL AND size(x.crumbs) = 0").count() == 1000
    assert sorted(r[0] for r in got.select("x.blocks.text").limit(3).collect())[0] == ["a0", "b"]
