"""The Snowball stemmer for Russian, from its published description, and a vectorised UDF."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = set("аеиоуыэюя")

# Endings of the published algorithm. Those of the first groups follow а or я.
_GERUND_1, _GERUND_2 = ("вшись", "вши", "в"), ("ившись", "ывшись", "ивши", "ывши", "ив", "ыв")
_ADJECTIVE = ("ими", "ыми", "его", "ого", "ему", "ому", "ее", "ие", "ые", "ое", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею")
_PARTICIPLE_1, _PARTICIPLE_2 = ("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ")
_REFLEXIVE = ("ся", "сь")
_VERB_1 = ("ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть", "ешь", "нно")
_VERB_2 = ("ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ило", "ыло", "ено", "ят", "ует", "уют", "ит", "ыт", "ены", "ить", "ыть", "ишь", "ую", "ю")
_NOUN = ("а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой", "ий", "й", "иям", "ям", "ием", "ем", "ам", "ом", "о", "у", "ах", "иях", "ях", "ы", "ь", "ию", "ью", "ю", "ия", "ья", "я")
_DERIVATIONAL = ("ост", "ость")
_SUPERLATIVE = ("ейш", "ейше")


def _regions(word: str) -> tuple[int, int]:
    """Where RV and R2 start."""
    rv = next((i + 1 for i, c in enumerate(word) if c in VOWELS), len(word))

    def after(start: int) -> int:
        for i in range(start + 1, len(word)):
            if word[i] not in VOWELS and word[i - 1] in VOWELS:
                return i + 1
        return len(word)

    return rv, after(after(0))


def _ending(word: str, start: int, plain: tuple[str, ...], after_a: tuple[str, ...] = ()) -> int | None:
    """The length of the longest ending inside a region; those of ``after_a`` need а or я before them, also inside."""
    best, blocked = 0, False
    for e in sorted({*plain, *after_a}, key=len, reverse=True):
        if not word.endswith(e) or len(word) - len(e) < start:
            continue
        if e in plain:
            best = len(e)
            break
        at = len(word) - len(e) - 1
        if at >= start and word[at] in "ая":
            best = len(e)
        else:
            blocked = True
        break
    return best if best and not blocked else None


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    word = word.replace("ё", "е")
    rv, r2 = _regions(word)
    if n := _ending(word, rv, _GERUND_2, _GERUND_1):
        word = word[:-n]
    else:
        if n := _ending(word, rv, _REFLEXIVE):
            word = word[:-n]
        if n := _ending(word, rv, _ADJECTIVE):
            word = word[:-n]
            if n := _ending(word, rv, _PARTICIPLE_2, _PARTICIPLE_1):
                word = word[:-n]
        elif (n := _ending(word, rv, _VERB_2, _VERB_1)) or (n := _ending(word, rv, _NOUN)):
            word = word[:-n]
    if _ending(word, rv, ("и",)):
        word = word[:-1]
    if n := _ending(word, max(rv, r2), _DERIVATIONAL):
        word = word[:-n]
    if _ending(word, rv, ("нн",)):
        return word[:-1]
    if n := _ending(word, rv, _SUPERLATIVE):
        word = word[:-n]
        return word[:-1] if _ending(word, rv, ("нн",)) else word
    return word[:-1] if _ending(word, rv, ("ь",)) else word


def stems(words: Column) -> Column:
    """The stems of a column of token arrays, in order."""

    @F.pandas_udf("array<string>")
    def of(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda ws: None if ws is None else [stem(w) for w in ws])

    return of(words)
