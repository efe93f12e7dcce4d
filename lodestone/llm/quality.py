"""Quality rules on tokeniser fertility.

Text that public vocabularies cut into unusually short or long pieces, that falls back to
bytes, or whose tokens repeat too much or too little is unlike prose of its script. Two
vocabularies measure characters per token: pieces with byte fallback, whose fallback and
entropy count too, and a byte-level one of many languages. The fixed bands are parameters per
script (or per language where a language column is given), wide enough for any natural text
of that script; text without letters has a band of its own.

Within them, bands are fitted to the corpus: per language (or script) and length, from the
quartiles over all rows, since both measures depend on both. They are right as long as less
than a quarter of a language's texts of a length are junk of one kind.
"""

from __future__ import annotations

import math
from array import array
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import apart, WHITESPACE, small_batches
from lodestone.llm.tokens import PieceCache, ranked_count

#: script or language: least and most characters per token, most byte-fallback share, least and most token entropy in
#: bits for texts of at least MIN_TOKENS tokens. Entropy is over the text's token ids. ``none`` is text without letters.
BANDS = {
    "latin": (1.4, 12.0, 0.20, 2.0, 11.5),
    "cyrillic": (1.0, 10.0, 0.20, 2.0, 11.5),
    "other": (0.25, 10.0, 0.95, 1.5, 12.5),
    "none": (1.4, 12.0, 0.20, 2.0, 11.5),
}
MIN_TOKENS = 32
#: Fitted bands: interquartile ranges beyond the quartiles, least texts of a group, and per measure the
#: histogram's step and the least interquartile range taken.
SPREAD, MIN_TEXTS = 3, 30
STEPS = {"chars_per_token": (0.005, 0.05), "chars_per_token_b": (0.005, 0.05), "token_entropy": (0.01, 0.1)}
#: Rows of fitted bands up to which they are broadcast.
BROADCAST_FITS = 50_000
SYMBOLS = "#*$%&|<>"
_WEIGHTS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(8)], dtype=np.uint64)
_CACHES: dict = {}
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, chars_per_token_b double, byte_share double, token_entropy double, script string"


def script_of(text: str) -> str:
    """The script of most letters: ``latin``, ``cyrillic`` or ``other``; ``none`` without letters.

    Letters are counted by code point range: U+0250 to U+1FFF and U+2C00 upwards, without
    the CJK punctuation block, stand for the letters of all further scripts.
    """
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = c | 32
    latin = int(((low - 97 < 26) | ((c - 0xC0 < 0x190) & (c != 0xD7) & (c != 0xF7))).sum())
    rest = 0 if text.isascii() else int(((c - 0x250 < 0x1DB0) | ((c >= 0x2C00) & (c - 0x3000 >= 0x40))).sum())
    if latin >= rest:
        return "latin" if latin else "none"
    return "cyrillic" if int((c - 0x400 < 0x100).sum()) * 2 >= latin + rest else "other"


def repeated_words(words: list, n: int = 8) -> int:
    """Words inside windows of ``n`` words that occur at least twice in the text."""
    if len(words) <= n:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    codes = (codes ^ (codes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    m = len(words) - n + 1
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h += codes[k : k + m] * _WEIGHTS[k]
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    if len(counts) == m:
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(counts[inverse] > 1)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + n, -1)
    return int((np.cumsum(edges) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines and words in repeated windows."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, WHITESPACE))
    lines = [x for x in text.split("\n") if x.strip(WHITESPACE)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


class _Fertility:
    """Token count, byte-fallback tokens and token entropy of texts, by parts of texts."""

    def __init__(self, name: str):
        self.parts = PieceCache(name, lambda ids: array("H", ids).tobytes())
        lib = self.parts.library
        self.bytes = np.array([lib.is_byte(i) for i in range(lib.get_piece_size())])

    def of(self, text: str) -> tuple[int, float, float]:
        ids = np.frombuffer(b"".join(self.parts.values(text)), np.uint16)
        n = len(ids)
        if not n:
            return 0, 0.0, 0.0
        kinds, counts = np.unique(ids, return_counts=True)
        c = counts.astype(np.float64)
        fallback = c[self.bytes[kinds]].sum()
        # a line feed has no piece in this vocabulary: it says nothing on the text's fertility
        fallback -= min(fallback, text.count("\n"))
        return n, float(fallback / n), float(math.log2(n) - (c * np.log2(c)).sum() / n)


def fertility(docs: DataFrame, text_col: str = "text", tokenizer: str = "piece_bpe_32k.model", ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Add the base counts and the fertility measures of each whole text in one pass.

    Null and empty texts have zeros and the script ``none``. Other columns are kept;
    columns that already have one of the new names are replaced. Texts may be of any length;
    repeated rows have equal results; no rows give no rows. No shuffle.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf(SCHEMA)
    def measured(texts):
        import pandas as pd

        if tokenizer not in _CACHES:
            _CACHES[tokenizer] = _Fertility(tokenizer)
        rows = []
        for t in texts:
            t = t or ""
            base, (n, share, bits), m = base_counts(t), _CACHES[tokenizer].of(t), ranked_count(t, ranks)
            rows.append((*base, n, len(t) / n if n else 0.0, len(t) / m if m else 0.0, share, bits, script_of(t)))
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pd.DataFrame(rows, columns=names)

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    rows, back = apart(docs.drop(*names), text_col)
    return back(rows.withColumn("__m", measured(F.col(text_col))).select(*rows.columns, "__m.*"))


def _failed(min_words: int, repeat_percent: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def _grouped(measured: DataFrame, lang_col: str | None) -> DataFrame:
    """``__key``, the language or script (null without letters), and ``__size``, the power of two of the tokens."""
    key = F.col("script") if lang_col is None else F.coalesce(F.col(lang_col), F.col("script"))
    size = F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int")
    return measured.withColumn("__key", F.when(F.col("script") != "none", key)).withColumn("__size", size)


def fitted(measured: DataFrame, lang_col: str | None = None, min_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """Bands from the quartiles of all texts that pass the base rules: ``key, size, measure, low, high``.

    Groups are language (or script) by length in powers of two; characters per token have a
    band over all lengths too, with size -1. Groups of less than ``MIN_TEXTS`` texts have none.
    Texts with the same measures are one text, so that copies don't make a band. Quartiles are
    those of histograms, which are all that is shuffled after that.
    """
    rows = _grouped(measured, lang_col).where(~_failed(min_words, repeat_percent) & (F.col("n_tokens") > 0) & F.col("__key").isNotNull())
    rows = rows.select(F.col("__key").alias("key"), F.col("__size").alias("size"), "n_words", "word_chars", "n_tokens", *STEPS).distinct()

    def value(size: Column, measure: str) -> Column:
        return F.struct(size.alias("size"), F.lit(measure).alias("measure"), F.floor(F.col(measure) / STEPS[measure][0]).cast("int").alias("bucket"))

    size, chars = F.col("size"), [m for m in STEPS if m != "token_entropy"]
    held = F.array(*[value(x, m) for m in chars for x in (size, F.lit(-1))], F.when(F.col("n_tokens") >= MIN_TOKENS, value(size, "token_entropy")))
    counts = rows.select("key", F.explode(held).alias("v")).where("v is not null").groupBy("key", "v.size", "v.measure", "v.bucket").agg(F.count("*").alias("n"))
    group = Window.partitionBy("key", "size", "measure")
    run = counts.withColumn("cum", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group)).where(F.col("total") >= MIN_TEXTS)
    first = [F.min(F.when(4 * F.col("cum") >= q * F.col("total"), F.col("bucket"))).alias(f"q{q}") for q in (1, 3)]
    step, least = (F.when(F.col("measure") == "token_entropy", STEPS["token_entropy"][i]).otherwise(STEPS["chars_per_token"][i]) for i in (0, 1))
    width = F.greatest((F.col("q3") + 1 - F.col("q1")) * step, least) * SPREAD
    return run.groupBy("key", "size", "measure").agg(*first).select("key", "size", "measure", (F.col("q1") * step - width).alias("low"), ((F.col("q3") + 1) * step + width).alias("high"))


def judged(measured: DataFrame, bands: dict[str, tuple] = BANDS, lang_col: str | None = None, min_words: int = 20, repeat_percent: int = 30, fits: DataFrame | None = None) -> DataFrame:
    """Add ``base_failed``, ``reason`` (null if kept) and ``kept`` to :func:`fertility`'s rows.

    The band of a row is that of its language, if ``lang_col`` is given and ``bands`` has it,
    else that of its script. Chars per token and byte share count for every text that has
    tokens, entropy only from ``MIN_TOKENS`` tokens on. The first broken rule is the reason.

    ``fits`` are the bands of :func:`fitted`; a text has to be in those too. Of the bands of
    characters per token at its length and at all lengths the wider ends count. Both
    vocabularies' characters per token have to be in their bands.
    """
    key = F.col("script") if lang_col is None else F.when(F.col(lang_col).isin(*bands) & (F.col("script") != "none"), F.col(lang_col)).otherwise(F.col("script"))

    def bound(i: int):
        out = F.lit(float(bands["other"][i]))
        for name, band in bands.items():
            out = F.when(key == name, F.lit(float(band[i]))).otherwise(out)
        return out

    lows = {m: bound(3 if m == "token_entropy" else 0) for m in STEPS}
    highs = {m: bound(4 if m == "token_entropy" else 1) for m in STEPS}
    rows = measured
    if fits is not None:
        name = lambda measure, size: F.concat_ws(" ", measure, size.cast("string"))
        own = fits.groupBy(F.col("key").alias("__key")).agg(F.map_from_entries(F.collect_list(F.struct(name(F.col("measure"), F.col("size")), F.struct("low", "high")))).alias("__fit"))
        if fits.limit(BROADCAST_FITS + 1).count() <= BROADCAST_FITS:
            own = F.broadcast(own)
        rows = _grouped(measured, lang_col).join(own, "__key", "left")
        # greatest and least leave out nulls, which are groups without a band
        for m in STEPS:
            at, all_ = F.col("__fit")[name(F.lit(m), F.col("__size"))], F.col("__fit")[name(F.lit(m), F.lit(-1))]
            lows[m] = F.greatest(lows[m], F.least(at["low"], all_["low"]))
            highs[m] = F.least(highs[m], F.greatest(at["high"], all_["high"]))

    n = F.col("n_tokens")
    base = _failed(min_words, repeat_percent)
    any_ = lambda broken: (n > 0) & reduce(lambda a, b: a | b, [broken(m) for m in STEPS if m != "token_entropy"])
    reason = (
        F.when(base, "base")
        .when(any_(lambda m: F.col(m) < lows[m]), "low_chars_per_token")
        .when(any_(lambda m: F.col(m) > highs[m]), "high_chars_per_token")
        .when(F.col("byte_share") > bound(2), "byte_fallback")
        .when((n >= MIN_TOKENS) & (F.col("token_entropy") < lows["token_entropy"]), "low_entropy")
        .when((n >= MIN_TOKENS) & (F.col("token_entropy") > highs["token_entropy"]), "high_entropy")
    )
    out = rows.withColumn("base_failed", base).withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())
    return out.select(*measured.columns, "base_failed", "reason", "kept")
