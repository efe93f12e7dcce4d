"""Chunks and sections as table functions of SQL."""

import pytest
from lodestone.functions import table_functions
from lodestone.operators.chunking import pieces
from pyspark.errors import AnalysisException


def test_chunks_and_sections_in_sql(spark):
    table_functions.register(spark)
    texts = {1: "One. Two three. " * 20, 2: None, 3: "", 4: "w" * 500}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = spark.sql("SELECT d.doc_id, c.position, c.body FROM {docs} d, LATERAL chunk_text(d.text, 100, 20) c", docs=docs).collect()
    want = [(d, i, b) for d, t in texts.items() for i, b in enumerate(pieces(t or "", 100, 20))]
    assert sorted((r.doc_id, r.position, r.body) for r in got) == sorted(want)
    lines = [("a", 0, "lost"), ("a", 1, "Art 1"), ("a", 2, "x"), ("a", 3, None), ("a", 4, "y"), ("a", 5, "Art 2"), ("b", 0, "no article"), (None, 1, "Art 9"), (None, 2, "z")]
    blocks = spark.createDataFrame(lines[::-1], "page string, pos int, text string")
    got = spark.sql("SELECT * FROM sectioned(TABLE({blocks}) PARTITION BY page ORDER BY pos, article => '^Art ')", blocks=blocks)
    assert {tuple(r) for r in got.collect()} == {("a", 1, "Art 1", "x\ny"), ("a", 2, "Art 2", ""), (None, 1, "Art 9", "z")}
    with pytest.raises(AnalysisException, match="page and text"):
        spark.sql("SELECT * FROM sectioned(TABLE({docs}) PARTITION BY doc_id, article => 'x')", docs=docs)
