"""Table functions for SQL: ``chunk_text`` and ``sectioned``.

    SELECT d.doc_id, c.* FROM docs d, LATERAL chunk_text(d.text, 600, 90) c
    SELECT * FROM sectioned(TABLE(blocks) PARTITION BY page ORDER BY pos, article => '^Art (.*)$')

``chunk_text`` cuts a text into overlapping pieces. ``sectioned`` reads the ordered blocks of a
page one by one and gives an article when the next one starts, so it holds one article at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lodestone.operators.chunking import pieces


class ChunkText:
    """``position, body`` of the pieces of a text; a null or empty text has none."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        yield from enumerate(pieces(text or "", size, overlap))


class Sectioned:
    """``page, seq, heading, body``: the articles of a page's blocks, in order.

    The table has ``page`` (of any type), ``pos`` and ``text``. A block that matches ``article``
    opens an article; what stands before the first one is in none. Pages are told apart by the
    partitioning, and a page's blocks have to come by ``pos``: both are checked by ``analyze``.
    """

    def __init__(self):
        self.page, self.seq, self.heading, self.body, self.pattern = None, 0, None, [], None

    @staticmethod
    def analyze(blocks: AnalyzeArgument, article: AnalyzeArgument) -> AnalyzeResult:
        if not blocks.isTable or not {"page", "text"} <= set(blocks.dataType.names):
            raise ValueError("sectioned needs a table with the columns page and text")
        if article.value is None:
            raise ValueError("the pattern of articles has to be a literal")
        re.compile(article.value)
        schema = StructType().add("page", blocks.dataType["page"].dataType).add("seq", LongType()).add("heading", StringType()).add("body", StringType())
        return AnalyzeResult(schema)

    def eval(self, blocks: Row, article: str) -> Iterator[tuple]:
        self.pattern = self.pattern or re.compile(article)
        self.page, text = blocks["page"], blocks["text"] or ""
        if self.pattern.search(text):
            yield from self.closed()
            self.seq, self.heading, self.body = self.seq + 1, text, []
        elif text:
            self.body.append(text)

    def closed(self) -> Iterator[tuple]:
        if self.heading is not None:
            yield self.page, self.seq, self.heading, "\n".join(self.body)

    def terminate(self) -> Iterator[tuple]:
        yield from self.closed()


def register(spark: SparkSession) -> None:
    """Make both functions known to the session's SQL."""
    spark.udtf.register("chunk_text", udtf(ChunkText, returnType="position int, body string"))
    spark.udtf.register("sectioned", udtf(Sectioned))
