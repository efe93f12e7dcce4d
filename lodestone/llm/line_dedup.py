"""Line deduplication by pairwise alignment of documents.

Lines are hashed, and the places of each hash in all documents are counted. A line of
fewer than ``min_words`` words is hashed with its neighbours: from each line on, and back from
each line, the shortest run (blank lines don't count) that has as many words. Documents overlap
where they share such a hash. A rare one, of at most ``RARE`` places, proposes each of its
pairs of documents. A more frequent one may stand in a third of all documents: it proposes the
pairs of its first holder with every later one, as many rows as it has occurrences, and so needs
no cap.

Within a pair the shared runs are joined to blocks, maximal in both documents, and patience
diff aligns them: blocks that overlap no other one in either document are anchors, their
longest common order is kept, and between two anchors what is unique there is aligned in turn.
Blocks outside that order are moved or repeated passages, and are aligned each by itself.
Aligned blocks are deleted from the later document.

Since a passage of ``min_words`` words or more that an earlier document holds is a union of
runs, each with a first holder, all of it is aligned with one partner or another.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WHITESPACE, apart, dropped, small_batches, written

#: Words of a block below which it stays, such as a shared heading.
MIN_WORDS = 5
#: Places of a run up to which each pair of the documents that hold it is aligned.
RARE = 4
#: A run's hash in two parts, its document, and its place and length in lines that aren't blank.
KEY = "h1 long, h2 int, doc_id long, text_hash long, at int, n int"
SPANS = "array<struct<at:int,n:int,moved:boolean>>"


def run_keys(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, int, int]]:
    """(first hash, second hash, place, lines) of the shortest runs of ``min_words`` words."""
    import xxhash

    digests, ends = [], [0]
    for line in text.split("\n"):
        line = line.strip(WHITESPACE)
        if line:
            raw = line.encode("utf-8", "surrogatepass")
            digests.append(xxhash.xxh3_128_digest(raw))
            ends.append(ends[-1] + len(raw.split()))
    spans = set()
    for i in range(len(digests)):
        j = bisect_left(ends, ends[i] + min_words)
        if j < len(ends):
            spans.add((i, j))
        j = bisect_right(ends, ends[i + 1] - min_words) - 1
        if j >= 0:
            spans.add((j, i + 1))
    out = []
    for i, j in sorted(spans):
        h = xxhash.xxh3_128_intdigest(b"".join(digests[i:j]))
        out.append(((h >> 64) - (1 << 63), (h & 0xFFFFFFFF) - (1 << 31), i, j - i))
    return out


Block = tuple[int, int, int]


def blocks(runs: list[Block]) -> list[Block]:
    """(place, place in the partner, lines) of maximal blocks: runs on one diagonal that meet or touch are one."""
    out: list[list[int]] = []
    for d, at, n in sorted((at - other, at, n) for at, other, n in runs):
        if out and out[-1][0] == d and at <= out[-1][1] + out[-1][2]:
            out[-1][2] = max(out[-1][2], at + n - out[-1][1])
        else:
            out.append([d, at, n])
    return sorted((at, at - d, n) for d, at, n in out)


def _lone(spans: list[tuple[int, int]]) -> list[bool]:
    """Which of the (place, length) spans overlap no other one."""
    order = sorted(range(len(spans)), key=spans.__getitem__)
    out, reach, last = [True] * len(spans), -1, -1
    for k in order:
        at, n = spans[k]
        if at < reach:
            out[k] = out[last] = False
        if at + n > reach:
            reach, last = at + n, k
    return out


def _longest_order(own: list[Block]) -> list[Block]:
    """A longest common order of blocks that come by place and overlap nowhere."""
    tops, at, before = [], [], [-1] * len(own)
    for i, (_, x, _) in enumerate(own):
        k = bisect_left(tops, x)
        before[i] = at[k - 1] if k else -1
        tops[k : k + 1], at[k : k + 1] = [x], [i]
    i, out = at[-1] if at else -1, []
    while i >= 0:
        out.append(own[i])
        i = before[i]
    return out[::-1]


def patience(found: list[Block]) -> tuple[list[Block], list[Block]]:
    """Of blocks by place: those in the common order, and the others, which are moved or repeated."""
    kept: set[Block] = set()
    gaps = [found]
    while gaps:
        own = gaps.pop()
        lone = zip(own, _lone([(b[0], b[2]) for b in own]), _lone([(b[1], b[2]) for b in own]), strict=True)
        anchors = _longest_order([b for b, x, y in lone if x and y])
        if not anchors:
            continue
        kept.update(anchors)
        # what lies between two anchors on both sides is aligned by itself
        starts, inside = [a[0] for a in anchors], [[] for _ in range(len(anchors) + 1)]
        for b in own:
            k = bisect_right(starts, b[0])
            low, high = anchors[k - 1] if k else (0, 0, 0), anchors[k] if k < len(anchors) else None
            after = low[0] + low[2] <= b[0] and low[1] + low[2] <= b[1]
            if after and (high is None or (b[0] + b[2] <= high[0] and b[1] + b[2] <= high[1])):
                inside[k].append(b)
        gaps += [x for x in inside if x]
    return [b for b in found if b in kept], [b for b in found if b not in kept]


def without_blocks(text: str, spans) -> tuple[str, int, int, int]:
    """The text without (place, lines, moved) blocks; lines and words deleted, and lines of moved blocks only."""
    lines = text.split("\n")
    at = [i for i, x in enumerate(lines) if x.strip(WHITESPACE)]
    straight, moved = set(), set()
    for first, n, off in spans:
        (moved if off else straight).update(at[first : first + n])
    gone = straight | moved
    words = sum(len(lines[i].encode("utf-8", "surrogatepass").split()) for i in gone)
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone), words, len(moved - straight)


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Per later document with any: ``spans``, its blocks aligned with earlier documents.

    ``at`` and ``n`` are places and lengths in lines that aren't blank; ``moved`` blocks are
    outside the common order of their pair.
    """
    small_batches(docs.sparkSession)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in KEY.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        for b in batches:
            rows = []
            for doc, h, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += [(h1, h2, doc, h, at, n) for h1, h2, at, n in run_keys(text, min_words)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=names)

    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), F.xxhash64(text_col).alias("th"), text_col)
    runs = written(texts.mapInArrow(keyed, KEY), "runs")
    doc = F.struct("doc_id", "text_hash")
    first = runs.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_hash", "at")).alias("first"), F.max(doc).alias("last"), F.count("*").alias("places"))
    first = first.select("h1", "h2", F.struct("first.doc_id", "first.text_hash").alias("lead"), F.col("first.at").alias("lead_at"), "last", "places").where(F.col("lead") != F.col("last"))
    # as a table of its own the join's sides are plain exchanges, and a hot run's partition can be split
    first = written(first.drop("last"), "first-runs")
    met = written(runs.join(first, ["h1", "h2"]), "shared-runs")
    shared = met.where(doc != F.col("lead")).select("doc_id", "text_hash", "at", "n", "lead", "lead_at")
    # rare runs meet their other holders too, at the first place there
    rare = met.where(F.col("places") <= RARE)
    earlier = rare.where(doc != F.col("lead")).groupBy("h1", "h2", doc.alias("by")).agg(F.min("at").alias("by_at"))
    others = rare.join(earlier, ["h1", "h2"]).where(F.col("by") < doc).select("doc_id", "text_hash", "at", "n", F.col("by").alias("lead"), F.col("by_at").alias("lead_at"))
    shared = shared.unionByName(others)
    pairs = shared.groupBy("doc_id", "text_hash", "lead").agg(F.collect_set(F.struct("at", "lead_at", "n")).alias("x"))

    @F.pandas_udf(SPANS)
    def spans(at: pd.Series, other: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for a, b, c in zip(at, other, n, strict=True):
            straight, moved = patience(blocks(list(zip(a.tolist(), b.tolist(), c.tolist(), strict=True))))
            out.append([{"at": x, "n": k, "moved": off} for own, off in ((straight, False), (moved, True)) for x, _, k in own])
        return pd.Series(out)

    found = pairs.select("doc_id", "text_hash", spans("x.at", "x.lead_at", "x.n").alias("s"))
    out = written(found.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("s")).alias("spans")), "aligned")
    for done in (runs, first, met):
        dropped(done)
    return out


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with their columns, the text without the blocks that are aligned with earlier documents.

    ``n_removed_lines``, ``n_removed_words`` and ``n_moved_lines`` (of the lines removed, those
    that only moved blocks hold) are added; columns of these names are replaced. The later
    document is that with the larger id (nulls come first; among equal ids the texts' hashes
    decide). Rows that repeat both id and text are one document: all of them lose the same
    blocks, but none because of each other. Passages that repeat inside one document only stay.
    Null texts stay null, empty ones empty, and lose nothing; a text may be of any length. No
    rows give no rows.
    """
    counts = ["n_removed_lines", "n_removed_words", "n_moved_lines"]
    docs, back = apart(docs.drop(*counts), id_col, text_col)
    marks = aligned(docs, id_col, text_col, min_words)
    marks = marks.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__th"), F.col("spans.at").alias("__at"), F.col("spans.n").alias("__n"), F.col("spans.moved").alias("__m"))
    same = docs[id_col].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__th"))
    # by one plan at every size: the marks grow with the corpus
    joined = docs.join(marks.hint("merge"), same, "left")

    @F.pandas_udf("text string, lines long, words long, moved long")
    def cut(texts: pd.Series, at: pd.Series, n: pd.Series, moved: pd.Series) -> pd.DataFrame:
        rows = [(None, 0, 0, 0) if t is None or a is None else without_blocks(t, zip(a, b, c, strict=True)) for t, a, b, c in zip(texts, at, n, moved, strict=True)]
        return pd.DataFrame(rows, columns=["text", "lines", "words", "moved"])

    # else a filter on what is left is pushed below it, and each text is cut twice, by two workers of a task
    cut = cut.asNondeterministic()
    # texts of documents that share nothing don't go to Python
    c = cut(F.when(F.col("__at").isNotNull(), F.col(text_col)), F.col("__at"), F.col("__n"), F.col("__m"))
    out = joined.withColumn("__c", c).withColumn(text_col, F.coalesce(F.col("__c.text"), F.col(text_col)))
    return back(out.select(*docs.columns, *[F.col(f"__c.{x}").alias(y) for x, y in zip(("lines", "words", "moved"), counts, strict=True)]))
