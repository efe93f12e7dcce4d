"""Queries against their SQL over small tables with odd rows."""

from collections import Counter

import __spark_entry__ as entry
import duckdb
import pytest


def differing(spark, at, name: str, **tables):
    """Rows that only the query gives and rows that only its SQL gives, over tables of (schema, rows)."""
    db = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{at}/{table}.parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{at}/{table}.parquet/*.parquet')")
    got = entry.queries()[name](spark, str(at))
    sql = db.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in sql.description]
    a, b = Counter(tuple(r) for r in got.select(*cols).collect()), Counter(sql.fetchall())
    return list((a - b).elements()), list((b - a).elements())


CONVERSATIONS = "conv_id long, turn int, role string, text string"
QUESTIONS = [
    "this is en éxtion of the words",
    "this is éen nation of all the words",
    "this is the nationé of all the words",
    "this is en nation of all the words",
    "this is the nation of all the words",
    "  ",
    " a question of nineteen",
    " \t\r\n",
    "a question of twenty  \x85",
    None,
]


@pytest.mark.parametrize("name", ["question_filters", "first_reason_funnel"])
def test_questions(spark, tmp_path, name):
    rows = [(3 * i, 0, "user", t) for i, t in enumerate(QUESTIONS)]
    assert differing(spark, tmp_path, name, conversations=(CONVERSATIONS, rows)) == ([], [])


def test_editions(spark, tmp_path):
    rows = [
        "<h1>a token = &quot;7702&amp; &amp;lt; &lt;b&gt;</h1><h1>b</h1>",
        "<h1 class=x>cut &amp</h1>",
        "<h1>two\xa0words\n <b>and</b> more </h1>",
        "<h1>never closed",
        "no heading",
        None,
    ]
    assert differing(spark, tmp_path, "page_editions", pages=("page_id long, html string", list(enumerate(rows)))) == ([], [])


def test_encoded_texts(spark, tmp_path):
    # float vectors gave 0.5414 for the first; the last shares are written with an exponent by a plain cast
    counts = [(46, 149, 37, 12), (1, 0, 0, 0), (0, 0, 0, 0), (5000, 3, 1, 1), (32, 1, 0, 0), *[(a, a + 7, 3 * a % 31, 11) for a in range(400)]]
    rows = [(i, "".join(c * n for c, n in zip("aein", x))) for i, x in enumerate(counts)] + [(-1, None)]
    assert differing(spark, tmp_path, "encoded_texts", documents=("doc_id long, text string", rows)) == ([], [])
