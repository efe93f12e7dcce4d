"""Text functions as column expressions: everything here runs inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits that make a token; a parameter wherever tokens are cut.
TOKEN = "[0-9a-zа-яё]+"

# Length limits in characters by question type, and words of a search query.
LENGTH_LIMITS = {"everyday": (20, 400), "search": (8, 120), "legal": (20, 400)}
SEARCH_WORDS = (2, 9)

# Citations of an article, and phrases that speak of the text itself.
ARTICLE_REF = r"(\bстат(ь[яеиюй]|ей|ьям)\s*№?\s*\d)|(\bст\.\s*\d)|(\bч\.\s*\d)|(\bп\.\s*\d)|(\bгл(\.|ав[аеыу])\s*\d)"
META_PHRASES = (
    r"(согласно\s+(данной\s+|этой\s+)?стать)|(в\s+(данной|этой|настоящей)\s+стать)|(по\s+(данной|этой)\s+стать)"
    r"|(данн(ая|ой)\s+стать)|(настоящ(ий|его)\s+кодекс)|(в\s+тексте\s+(статьи|закона))"
)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once a row, however often lambdas read it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column | str, token: str = TOKEN) -> Column:
    """Lower-case tokens in order, with ё written as е; null text has none."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(f"(?iu){token}"), F.lit(0))
    return F.transform(found, lambda w: F.replace(F.lower(w), F.lit("ё"), F.lit("е")))


def normalized(text: Column | str, token: str = TOKEN) -> Column:
    """The tokens joined by single spaces: the key of exact duplicates."""
    return F.array_join(words(text, token), " ")


def ngrams(tokens: Column, n: int) -> Column:
    """The distinct runs of ``n`` tokens; none if there are fewer tokens."""

    def runs(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))

    return let(tokens, runs)


def cleaned(text: Column | str, space: str = r"[\s\xa0]") -> Column:
    """Runs of any white space, no-break spaces too, become one space; none at the ends. ``space`` is a class of what is white space."""
    return F.trim(F.regexp_replace(col(text), f"(?U){space}+", " "))


def stripped(text: Column | str, space: str = r"\s") -> Column:
    """The text without white space at its ends; ``space`` is a class of the characters that are, by default all of Unicode's."""
    return F.regexp_replace(col(text), rf"(?U)^{space}+|{space}+\z", "")


def length_broken(question: Column, qtype: Column, token: str = TOKEN, space: str = r"\s") -> Column:
    """True if a question's length is outside the limits of its type; unknown types pass."""
    chars = F.length(stripped(question, space))
    out = F.lit(False)
    for name, (low, high) in LENGTH_LIMITS.items():
        broken = ~chars.between(low, high)
        if name == "search":
            broken = broken | ~F.size(words(question, token)).between(*SEARCH_WORDS)
        out = F.when(qtype == name, broken).otherwise(out)
    return out


def cites(question: Column, patterns: tuple[str, ...] = (ARTICLE_REF, META_PHRASES)) -> Column:
    """True if a question cites an article or speaks of the text itself."""
    out = F.lit(False)
    for p in patterns:
        out = out | question.rlike(f"(?iuU){p}")
    return out


def hash_uniform(key: Column, salt: str = "") -> Column:
    """A number in [0, 1) from the md5 of a key: the same in every run and every engine."""
    return hash_order(key, salt).cast("double") / F.lit(4294967296.0)


def hash_order(key: Column, salt: str = "") -> Column:
    """A 32-bit order key from the md5 of a salted key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 8), 16, 10).cast("long")


def stable_seed(key: Column, base: int = 42) -> Column:
    """The seed of a key: base plus its hash modulo a million."""
    return F.lit(base) + hash_order(key) % 1_000_000


def header(display: Column, number: Column, title: Column) -> Column:
    return F.concat(display, F.lit(", Статья "), number, F.lit(". "), title)


def without_code(head: Column) -> Column:
    """A header without what stands before its first comma."""
    at = F.instr(head, ", ")
    return F.when(at > 0, F.substring(head, at + 2, F.length(head))).otherwise(head)


def slug(path: Column | str) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(F.regexp_replace(col(path), "^/+|/+$", ""), "/"), -1)


def page_file_name(path: Column | str) -> Column:
    """A page's file name: the path's parts from the third on, joined by two underscores."""
    parts = F.split(F.regexp_replace(col(path), "^/+|/+$", ""), "/")
    return F.concat(F.array_join(F.slice(parts, F.lit(3), F.size(parts)), "__"), F.lit(".html"))
