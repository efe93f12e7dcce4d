"""Pages to documents: HTML blocks, headings, sections, status."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

# Headings, notices of repeal, footnotes and editions.
ARTICLE = r"^Статья\s+(\d+(?:[.\-]\d+)*)\s*\.?\s*(.*)$"
CHAPTER = r"^Глава\s+(\d+(?:[.\-]\d+)*|[IVXLC]+)\s*\.?\s*(.*)$"
REPEALED = r"^\(?\s*(Утратил[аи]? силу|Исключен[аы]?)"
REPEALED_TITLE = r"(^|[,.]\s*)(Утратил[аи]?\s+силу|Исключен[аы]?)"
REPEAL_LINE = r"^[\d.\s\-–)]*(Стать[яи]\s+[\d.\s\-–]+\.\s*)?(Утратил\w*\s+силу|Исключен\w*)"
FOOTNOTE = r"^<\*+>"
EDITION = r"\((ред\.[^)]*)\)"

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SKIP = {"script", "style", "template"}
BLOCKS = "array<struct<pos:int,kind:string,text:string>>"
PARTS = "h1 string, crumbs array<string>, blocks array<struct<pos:int,kind:string,text:string>>"


class _Reader(HTMLParser):
    """One pass over a page that gathers the texts of chosen elements.

    ``root`` is the class of the div whose ``p`` and ``div.pb-2`` elements are blocks; null
    takes the whole page. Scripts and styles aren't text. What is open is counted by tag and by
    what it means, and of each kind of sink only the last one that was opened takes text, so that a
    page of any depth takes time in proportion to its length.
    """

    def __init__(self, root: str | None):
        super().__init__(convert_charrefs=True)
        self.root, self.open, self.blocks = root, [], []
        self.tags: Counter = Counter()
        self.skipped = self.rooted = self.in_crumbs = 0
        self.sinks: dict[str, list[str]] = {}
        self.h1: list[str] | None = None
        self.crumbs: list[list[str]] = []
        self.found = root is None

    def enter(self, tag: str, root: bool, crumbs: bool, sink: list | None) -> None:
        if tag in _VOID:
            return
        self.open.append((tag, root, crumbs, sink))
        self.tags[tag] += 1
        self.rooted += root
        self.in_crumbs += crumbs
        self.skipped += tag in _SKIP
        if sink is not None:
            self.sinks[tag] = sink

    def leave(self) -> str:
        tag, root, crumbs, sink = self.open.pop()
        self.tags[tag] -= 1
        self.rooted -= root
        self.in_crumbs -= crumbs
        self.skipped -= tag in _SKIP
        if sink is not None and self.sinks.get(tag) is sink:
            del self.sinks[tag]
        return tag

    def handle_starttag(self, tag, attrs):
        classes = (dict(attrs).get("class") or "").split()
        if tag == "p":  # an open paragraph ends where the next one starts
            while self.tags["p"]:
                self.leave()
        root, sink = False, None
        if tag == "div" and self.root and self.root in classes and not self.found:
            root = self.found = True
        elif tag in ("p", "div") and (self.root is None or self.rooted):
            if tag == "div" and "pb-2" in classes:
                self.blocks.append(("stop", []))
            elif tag == "p":
                sink = []
                self.blocks.append(("center" if "pCenter" in classes else "right" if "pRight" in classes else "p", sink))
        if tag == "h1" and self.h1 is None:
            sink = self.h1 = []
        if tag == "a" and self.in_crumbs:
            sink = []
            self.crumbs.append(sink)
        self.enter(tag, root, "main-center-block-crambs" in classes, sink)

    def handle_endtag(self, tag):
        if self.tags[tag]:
            while self.leave() != tag:
                pass

    def handle_data(self, data):
        if not self.skipped:
            for s in self.sinks.values():
                s.append(data)


def read_page(html: str | None, root: str | None) -> tuple:
    r = _Reader(root)
    r.feed(html or "")
    r.close()
    said = lambda parts: re.sub(r"[\s\xa0]+", " ", " ".join(parts)).strip()
    blocks = [(i, kind, said(t)) for i, (kind, t) in enumerate(r.blocks)] if r.found else None
    return (None if r.h1 is None else said(r.h1)), [said(c) for c in r.crumbs], blocks


def page_parts(html: Column, root: str | None = "main-center-block") -> Column:
    """Heading, breadcrumb links and blocks of a page; blocks are null where the root is missing.

    A row at a time and without Arrow, whose batches are of 10,000 pages: a worker holds a hundred at most.
    """
    return F.udf(lambda page: read_page(page, root), PARTS, useArrow=False)(html)


def heading(text: Column, pattern: str, group: int, flags: str = "(?U)") -> Column:
    return F.trim(F.regexp_extract(text, flags + pattern, group))


def is_repeal_line(text: Column) -> Column:
    return text.rlike(f"(?iuU){REPEAL_LINE}") & (F.length(text) < 300)


def status(title: Column, body: Column) -> Column:
    """``repealed`` by title or by a short body's start, ``empty`` without lines or of footnotes only, else ``active``."""
    gone = title.rlike(f"(?iuU){REPEALED}") | title.rlike(f"(?U){REPEALED_TITLE}") | (body.rlike(f"(?iuU){REPEALED}") & (F.length(body) < 400))
    lines = F.filter(F.split(body, "\n"), lambda x: T.stripped(x) != "")
    return F.when(gone, "repealed").when(F.forall(lines, lambda x: x.rlike(FOOTNOTE)), "empty").otherwise("active")


def sections(blocks: DataFrame, page: str = "page", pos: str = "pos", kind: str = "kind", text: str = "text", article: str = ARTICLE, chapter: str = CHAPTER) -> DataFrame:
    """Articles of ordered blocks: ``page, seq, number, title, chapter, chapter_title, text, status``.

    A chapter heading closes the open article and is carried to those after it; an article
    heading opens one. A ``right`` or ``stop`` block while an article is open ends the page.
    Centred blocks and repeal lines aren't text. Two windows over a page: what is open, and
    whether the end was seen.
    """
    t = T.cleaned(text)
    rows = blocks.select(F.col(page).alias("page"), F.col(pos).alias("pos"), F.col(kind).alias("kind"), t.alias("t"))
    ends = F.col("kind").isin("right", "stop")
    head = F.when(~ends & (F.col("t") != ""), F.when(F.col("t").rlike(f"(?iuU){chapter}"), "chapter").when(F.col("t").rlike(f"(?U){article}"), "article"))
    # a signature's block can be a heading too, as long as no article is open
    loose = F.when(ends & (F.col("t") != ""), F.when(F.col("t").rlike(f"(?iuU){chapter}"), "chapter").when(F.col("t").rlike(f"(?U){article}"), "article"))
    w = Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("head", F.coalesce(head, loose))
    rows = rows.withColumn("open", F.last("head", ignorenulls=True).over(before))
    rows = rows.withColumn("over", F.max(F.coalesce(ends & (F.col("open") == "article"), F.lit(False))).over(w)).where(~F.col("over"))
    rows = rows.withColumn("seq", F.count(F.when(F.col("head") == "article", 1)).over(w)).withColumn("now", F.last("head", ignorenulls=True).over(w))
    rows = rows.withColumn("ch", F.last(F.when(F.col("head") == "chapter", F.col("t")), ignorenulls=True).over(w))
    inside = rows.where("now = 'article'")
    line = F.when(F.col("head").isNull() & (F.col("t") != "") & (F.col("kind") != "center") & ~is_repeal_line(F.col("t")), F.struct("pos", "t"))
    title = F.max(F.when(F.col("head") == "article", F.col("t")))
    got = inside.groupBy("page", "seq").agg(title.alias("h"), F.max("ch").alias("ch"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("text"))
    of = lambda c, p, g, f="(?U)": F.coalesce(heading(F.col(c), p, g, f), F.lit(""))
    out = got.select("page", F.col("seq").cast("long").alias("seq"), of("h", article, 1).alias("number"), of("h", article, 2).alias("title"), of("ch", chapter, 1, "(?iuU)").alias("chapter"), of("ch", chapter, 2, "(?iuU)").alias("chapter_title"), "text")
    return out.withColumn("status", status(F.col("title"), F.col("text")))


def single_articles(pages: DataFrame, html: str = "html", href: str = "url", root: str = "main-center-block-article-text") -> DataFrame:
    """Articles of pages that hold one each: heading from ``h1``, chapter from the path or the breadcrumb."""
    rows = pages.withColumn("__t", page_parts(F.col(html), root))
    h1 = F.col("__t.h1")
    rows = rows.where(h1.isNotNull() & h1.rlike(f"(?U){ARTICLE}"))
    blocks = F.coalesce(F.col("__t.blocks"), F.array().cast(BLOCKS))
    end = F.array_position(F.transform(blocks, lambda b: b["kind"]), "right")
    own = F.when(end > 0, F.slice(blocks, F.lit(1), (end - 1).cast("int"))).otherwise(blocks)
    lines = F.filter(F.transform(own, lambda b: b["text"]), lambda t: (t != "") & ~is_repeal_line(t))
    crumb = F.element_at(F.filter(F.concat(F.array(F.lit("")), F.coalesce(F.col("__t.crumbs"), F.array().cast("array<string>"))), lambda c: (c == "") | c.rlike(f"(?iuU){CHAPTER}")), -1)
    path = F.regexp_extract(F.col(href), "/glava-([^/]+)/", 1)
    out = rows.select(
        *[c for c in pages.columns if c != html],
        heading(h1, ARTICLE, 1).alias("number"),
        heading(h1, ARTICLE, 2).alias("title"),
        F.when(crumb != "", heading(crumb, CHAPTER, 1, "(?iuU)")).otherwise(path).alias("chapter"),
        F.when(crumb != "", heading(crumb, CHAPTER, 2, "(?iuU)")).otherwise(F.lit("")).alias("chapter_title"),
        F.array_join(lines, "\n").alias("text"),
    )
    return out.withColumn("status", status(F.col("title"), F.col("text")))


def articles_of(pages: DataFrame, laws: DataFrame, code: str = "code", html: str = "html", href: str = "url", root: str = "main-center-block") -> DataFrame:
    """Articles of pages by the layout of their law: ``full`` pages hold a whole law, others an article each.

    ``laws``: code, layout and whatever else goes with every article (group, name, edition,
    download date). A full page without the root is an error that names the page.
    """
    rows = pages.join(F.broadcast(laws.select(code, "layout")), code)  # a row a law
    full = rows.where("layout = 'full'").select(code, href, page_parts(F.col(html), root).alias("__x"))
    blocks = F.when(F.col("__x.blocks").isNull(), F.raise_error(F.concat(F.lit(f"no {root} on page "), F.col(href)))).otherwise(F.col("__x.blocks"))
    cut = sections(full.select(F.struct(code, href).alias("page"), F.inline(blocks)))
    whole = cut.select(F.col(f"page.{code}").alias(code), F.col(f"page.{href}").alias(href), *[c for c in cut.columns if c not in ("page", "seq")])
    single = single_articles(rows.where("layout <> 'full'").select(code, href, html), html, href)
    found = whole.unionByName(single.select(*whole.columns))
    key = F.concat_ws("-", code, "number")
    return union_of([found.withColumn("doc_id", key)], laws, code)


def raw_heading(html: Column) -> Column:
    """The first closed ``h1`` as it is written, tags inside it too, with ``&lt;``, ``&gt;`` and ``&amp;`` decoded; empty without one, null of a null page."""
    found = F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1)
    for name, sign in (("lt", "<"), ("gt", ">"), ("amp", "&")):
        found = F.replace(found, F.lit(f"&{name};"), F.lit(sign))
    return found


def edition(h1: Column, space: str = r"[\s\xa0]") -> Column:
    """All editions named in a heading, or the whole heading; empty without one."""
    found = F.regexp_extract_all(h1, F.lit(f"(?U){EDITION}"), F.lit(1))
    return F.coalesce(F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda x: T.cleaned(x, space)), "; ")).otherwise(T.cleaned(h1, space)), F.lit(""))


def links(pages: DataFrame, pattern: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """Distinct link targets of each page that match, in first-seen order: ``key, href, pos``."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r"<a\s[^>]*?href=\"([^\"]*)\""), F.lit(1))
    rows = pages.select(key, F.posexplode(hrefs).alias("pos", "href")).where(F.col("href").rlike(pattern))
    return rows.groupBy(key, "href").agg(F.min("pos").cast("long").alias("pos"))


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """The table, if its key is unique; else an error that names some keys that aren't."""
    twice = df.groupBy(key).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"{key} isn't unique: {[r[0] for r in twice]}")
    return df


def union_of(parts: list[DataFrame], laws: DataFrame, code: str = "code") -> DataFrame:
    """Articles of all laws with the laws' own columns (group, display name, layout)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.join(F.broadcast(laws), code, "left")  # a row a law


def status_counts(df: DataFrame, code: str = "code") -> DataFrame:
    return df.groupBy(code, "status").agg(F.count("*").alias("n"))
