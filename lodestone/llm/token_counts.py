"""Token counts by a map-side two-tier lookup: no pre-token is ever shuffled.

Tier one is a table of the lengths of the pre-tokens that are frequent in a bounded sample of
rows, broadcast to all workers; its size is bounded by ``TABLE_ENTRIES``. Tier two is each worker's own cache of what it has
encoded since. Counts are the library's own on every text (see :mod:`.tokens`).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import small_batches
from lodestone.llm.tokens import PieceCache

#: Entries of the table; rows that it is counted on, and pre-tokens of each of these.
TABLE_ENTRIES, SAMPLE_ROWS, EACH = 20_000, 4096, 128
_CACHES: dict = {}


def frequent_lengths(docs: DataFrame, text_col: str = "text", tokenizer: str = "piece_bpe_32k.model", entries: int = TABLE_ENTRIES, sample_rows: int = SAMPLE_ROWS) -> dict[str, int]:
    """Token lengths of the most frequent pre-tokens in a sample of about ``sample_rows`` rows of the whole table.

    Tasks send the most frequent pre-tokens of each sampled text, at most ``EACH``, straight to
    the driver, which adds them up: none is shuffled, and the driver gets ``sample_rows * EACH``
    rows at most. Any table gives the same token counts; this one only saves encoding.
    """
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = [x for t in b.column(0).to_pylist() for x in Counter(p for p in t.split(" ") if 0 < len(p) <= 16).most_common(EACH)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in most], pa.string()), pa.array([n for _, n in most], pa.int64())], names=["p", "n"])

    some = docs.select(F.col(text_col)).where(F.col(text_col).isNotNull())
    share = sample_rows / max(1, docs.count())
    met: Counter = Counter()
    for p, n in (some if share >= 1 else some.sample(share, seed=7)).mapInArrow(counted, "p string, n long").collect():
        met[p] += n
    cache = PieceCache(tokenizer, len)
    return {p: cache[p] for p, _ in sorted(met.items(), key=lambda x: (-x[1], x[0]))[:entries] if PieceCache.MARK not in p}


def count_tokens(docs: DataFrame, text_col: str = "text", tokenizer: str = "piece_bpe_32k.model", table: dict[str, int] | None = None, out: str = "n_tokens") -> DataFrame:
    """Add ``out`` (bigint): the tokens of each whole text, without added special tokens.

    A null or empty text has 0. All other columns are kept as they are, repeated rows and
    nulls too; a column that is already called ``out`` is replaced. One pass, no shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tier = spark.sparkContext.broadcast(frequent_lengths(docs, text_col, tokenizer) if table is None else table)

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        key = (tokenizer, tier.id if hasattr(tier, "id") else len(tier.value))
        if key not in _CACHES:
            _CACHES.clear()
            _CACHES[key] = PieceCache(tokenizer, len, tier.value)
        values = _CACHES[key].values
        return pd.Series([sum(values(t)) if t else 0 for t in texts], dtype="int64")

    return docs.withColumn(out, tokens(F.col(text_col)))


def over_limit(n: str | Column, limit: int) -> Column:
    return (F.col(n) if isinstance(n, str) else n) > limit
