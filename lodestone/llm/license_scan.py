"""License scans by an exact set-similarity join, in SQL functions only.

The blocks of a text are windows of words, each overlapping the next by half, so that every
passage of up to half a window lies whole in one. A template meets a block that contains at
least ``threshold`` of its distinct words. Words are ordered by the number of documents that
have them, rarest first, over the whole corpus. A template of n words of which k have to be
there shares one of its n - k + 1 rarest (its prefix) with every block it meets: only blocks
around these words leave their text. They are joined with the templates' prefix words; the
count of template words in the block (length) and what can still follow in both from the common
word on (position) drop most pairs, and the others' overlap is counted, so that no pair is lost.

A template that is a phrase has to stand in the block as it is: its words are then looked for
one after the other, and every place counts.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import let
from lodestone.llm.common import dropped, written
from lodestone.llm.decontamination import words

#: Most distinct words of all templates: they are literals of the plan and a broadcast table.
MOST_WORDS = 5000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TEXT_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: the words have to stand one after the other; base phrases make base labels
    phrase: bool = False
    base: bool = False

    def words(self) -> list[str]:
        return _TEXT_WORD.findall(self.text.translate(str.maketrans(_UPPER, _LOWER)))


# The base phrases and their labels.
BASE = [
    Template("gpl", "gnu general public license", True, True),
    Template("apache", "apache license", True, True),
    Template("cc-by", "cc by", True, True),
    Template("mit", "mit license", True, True),
]
#: Notices that licences ask for, or that projects use.
NOTICES = [
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    Template("lgpl", "GNU Lesser General Public License", phrase=True),
    Template("agpl", "GNU Affero General Public License", phrase=True),
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc", "Creative Commons Attribution NonCommercial", phrase=True),
    Template("cc-by-sa", "Creative Commons Attribution ShareAlike", phrase=True),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("all-rights-reserved", "All rights reserved", phrase=True),
]
TEMPLATES = BASE + NOTICES
THRESHOLD = 0.8


def stride_of(templates: list[Template]) -> int:
    """Half a block, in words: no template is longer."""
    return max(32, *(len(t.words()) for t in templates))


def needed(template: Template, threshold: float) -> int:
    """How many of a template's distinct words a block has to contain; all of a phrase's."""
    n = len(set(template.words()))
    return n if template.phrase else max(1, math.ceil(threshold * n - 1e-9))


def _plain(word: Column) -> Column:
    return F.translate(word, _UPPER, _LOWER)


def _among(w: Column, kinds: list[str]) -> Column:
    # lower() also lowers other letters than A-Z, so what it lets pass is held against the words exactly later
    return F.filter(w, lambda x: F.lower(x).isin(kinds))


def frequencies(docs: DataFrame, kinds: list[str], text_col: str = "text") -> dict[str, int]:
    """The number of documents that have each of the given words, over the whole table; at most a row a word."""
    met = docs.select(F.explode(F.array_distinct(F.transform(_among(words(F.col(text_col)), kinds), _plain))).alias("word")).where(F.col("word").isin(kinds))
    return {r.word: r.n for r in met.groupBy("word").agg(F.count("*").alias("n")).collect()}


def scanned(docs: DataFrame, prefix: list[str], stride: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id, n_words`` and the ``blocks`` (number and words) that hold a prefix word."""

    def blocks(w: Column) -> Column:
        n = F.size(w)
        last = F.greatest(F.lit(0), F.ceil((n - 2 * stride) / F.lit(stride)).cast("int"))
        hits = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.lower(F.get(w, i)).isin(prefix))
        of = F.transform(hits, lambda i: F.floor(i / F.lit(stride)).cast("int"))
        kinds = F.array_distinct(F.concat(F.transform(of, lambda k: F.least(k, last)), F.transform(of, lambda k: F.least(F.greatest(k - 1, F.lit(0)), last))))
        made = F.transform(kinds, lambda k: F.struct(k.alias("block"), F.transform(F.slice(w, k * stride + 1, 2 * stride), _plain).alias("words")))
        # a text without words gives no sequence
        none = F.array().cast("array<struct<block:int,words:array<string>>>")
        return F.struct(n.cast("long").alias("n_words"), F.when(n > 0, made).otherwise(none).alias("blocks"))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), let(words(F.col(text_col)), blocks).alias("x"))
    return rows.select("row", "doc_id", "x.n_words", "x.blocks")


def joined(blocks: DataFrame, templates: list[Template], ranks: dict[str, int], threshold: float) -> DataFrame:
    """The pairs of a block (its ``words``) and a template that meet: ``template`` (its place in the list) and ``containment``.

    All other columns of ``blocks`` are kept. A pair may come once for each common prefix word.
    """
    spark = blocks.sparkSession
    ordered = sorted(ranks, key=ranks.__getitem__)
    known = [sorted({ranks[w] for w in t.words()}) for t in templates]
    need = [needed(t, threshold) for t in templates]
    index = [(own[i], k, i, len(own), need[k], own) for k, own in enumerate(known) for i in range(len(own) - need[k] + 1)]
    prefixes = F.broadcast(spark.createDataFrame(index, "token int, template int, at int, size int, need int, tokens array<int>"))
    place = F.array(*[F.lit(w) for w in ordered])
    # the block's template words as ranks, rarest first; words that no template has can't be common
    own = F.array_sort(F.array_distinct(F.transform(F.filter("words", lambda x: x.isin(ordered)), lambda x: (F.array_position(place, x) - 1).cast("int"))))
    keep = [c for c in blocks.columns]
    rows = blocks.withColumn("own", own).select(*keep, "own", F.posexplode("own").alias("own_at", "token"))
    can = 1 + F.least(F.col("size") - F.col("at") - 1, F.size("own") - F.col("own_at") - 1)
    pairs = rows.join(prefixes, "token").where((F.size("own") >= F.col("need")) & (can >= F.col("need")))
    common = F.size(F.array_intersect("own", "tokens"))
    return pairs.where(common >= F.col("need")).select(*keep, "template", (common / F.col("size")).alias("containment"))


def matches(docs: DataFrame, templates: list[Template] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All rows (``row, doc_id, n_words``), and what they hold: ``row, doc_id, template, label, base, at, containment``.

    A row each for a block and a template that isn't a phrase (``at``: the block's first word),
    and for every place of a phrase (``at``: its first word), counted from 0. Null and empty
    texts have no words; texts may be of any length; repeated rows are found each; further
    columns are left out; no rows give no rows.
    """
    kinds = sorted({w for t in templates for w in t.words()})
    if not kinds or len(kinds) > MOST_WORDS or not all(t.words() for t in templates):
        raise ValueError(f"templates need words, and at most {MOST_WORDS} distinct ones")
    stride = stride_of(templates)
    seen = frequencies(docs, kinds, text_col)
    ranks = {w: i for i, w in enumerate(sorted(kinds, key=lambda w: (seen.get(w, 0), w)))}
    prefix: set[str] = set()
    for t in templates:
        own = sorted(set(t.words()), key=ranks.__getitem__)
        prefix.update(own[: len(own) - needed(t, threshold) + 1])
    rows = written(scanned(docs, sorted(prefix), stride, id_col, text_col), "scanned")
    blocks = rows.select("row", "doc_id", F.inline("blocks"))
    pairs = joined(blocks, templates, ranks, threshold)
    listed = [(k, t.label, t.base, t.words() if t.phrase else None) for k, t in enumerate(templates)]
    pairs = pairs.join(F.broadcast(pairs.sparkSession.createDataFrame(listed, "template int, label string, base boolean, phrase array<string>")), "template")
    size = F.size("phrase")
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - size), lambda p: F.slice("words", p + 1, size) == F.col("phrase"))
    # a phrase of repeated words may be longer than a block that has them all
    found = F.when(F.col("phrase").isNull(), F.array(F.lit(0))).when(F.size("words") >= size, starts)
    out = pairs.select("row", "doc_id", "template", "label", "base", "containment", "block", F.explode(found).alias("p"))
    out = out.select("row", "doc_id", "template", "label", "base", (F.col("block") * stride + F.col("p")).cast("long").alias("at"), "containment")
    return rows.select("row", "doc_id", "n_words"), out.dropDuplicates(["row", "template", "at"])


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``n_words``, ``n_base`` places of base phrases with ``first_word`` and ``last_word``, labels and ``score``.

    ``base_labels`` and ``labels`` are distinct, sorted and joined by commas; ``score`` is the
    largest containment of a template that meets one of the row's blocks, 0 without any. See
    :func:`matches` for nulls, empty and long texts, and repeated rows.
    """
    rows, found = matches(docs, templates, threshold, id_col, text_col)
    base = F.col("base")
    # by label first, so that a text of any number of places is a few rows
    by = found.groupBy("row", "label").agg(
        F.count_if(base).alias("n"), F.min(F.when(base, F.col("at"))).alias("first"), F.max(F.when(base, F.col("at"))).alias("last"), F.max("containment").alias("score")
    )
    per = by.groupBy("row").agg(
        F.sum("n").alias("n_base"), F.min("first").alias("first_word"), F.max("last").alias("last_word"), F.max("score").alias("score"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("n") > 0, F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
    )
    out = rows.join(per, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
