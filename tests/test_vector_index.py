"""The inverted-file index and pruned joins against brute force."""

import numpy as np
import pytest
from lodestone.operators import similarity, vector_index
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
SCHEMA = "unit_id long, doc_id long, embedding array<float>"


def clustered(n=3000, groups=60, width=32, noise=0.12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    x = centres[rng.integers(0, groups, n)] + noise * rng.normal(size=(n, width)) * np.sqrt(width) / 2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, i % 700, v.astype(np.float32).tolist()) for i, v in enumerate(x)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(clustered(), SCHEMA).repartition(4).cache()


def asked(rows):
    return rows.where("unit_id % 50 = 0").select(F.col("unit_id").alias("qid"), "embedding")


def as_set(run):
    return {(r.qid, r.doc_id, r.unit_id, r["rank"]): r.score for r in run.collect()}


@pytest.mark.parametrize("per", ["doc", "unit"])
def test_exact_search_is_brute_force(spark, rows, per):
    index = vector_index.build(rows)
    want = as_set(similarity.maxp(asked(rows), rows, 10, skip_self=True, per=per))
    got = as_set(vector_index.search(asked(rows), index, 10, 3, exact=True, skip_self=True, per=per))
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_recall_and_rows_read(spark, rows, tmp_path):
    index = vector_index.build(rows)
    exact = similarity.maxp(asked(rows), rows, 10, skip_self=True)
    probes = vector_index.tuned_probes(asked(rows), index, 10, 0.95, skip_self=True)
    found = vector_index.search(asked(rows), index, 10, probes, skip_self=True)
    assert vector_index.recall(found, exact, 10) >= 0.9
    assert vector_index.read_share(asked(rows), index, probes) < 0.1
    vector_index.saved(index, str(tmp_path / "index"))
    again = vector_index.search(asked(rows), vector_index.loaded(spark, str(tmp_path / "index")), 10, probes, skip_self=True)
    assert as_set(again).keys() == as_set(found).keys()


def test_recall_over_the_given_vectors(spark):
    from lodestone.plans import queries

    exact = queries.doc_run(spark, SMALL, 10)
    assert vector_index.recall(queries.ivf_topk(spark, SMALL), exact, 10) >= 0.9


def brute_within(rows, t):
    x = np.array([v for _, _, v in rows], np.float32).astype(float)
    s = x @ x.T >= t
    return {i for i in range(len(rows)) if s[i, :i].any()}


@pytest.mark.parametrize("block", [4096, 64])
def test_threshold_joins_are_brute_force(spark, monkeypatch, block):
    # small blocks deal cells and their visitors into shards; a third of the rows are copies of one vector
    monkeypatch.setattr(vector_index, "BLOCK", block)
    rows = clustered(600, 30)
    rows = [(i, d, rows[7][2] if i % 3 == 0 else [2 * c for c in v] if i % 7 == 0 else v) for i, d, v in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    for t in (0.2, 0.8, 0.97, 1.5):
        got = {r.unit_id for r in vector_index.near_dup_within(df, t, "unit_id").collect() if r.is_dup}
        assert got == brute_within(rows, t)
        refs, own = rows[:100], rows[100:]
        x, y = (np.array([v for _, _, v in side], np.float32).astype(float) for side in (own, refs))
        want = {r[0] for r, hit in zip(own, (x @ y.T >= t).any(1), strict=True) if hit}
        got = vector_index.near_dup_against(df.where("unit_id >= 100"), df.where("unit_id < 100"), t)
        assert {r.unit_id for r in got.collect() if r.is_dup} == want


def test_pruning_meets_few_cells(spark, rows):
    index = vector_index.build(vector_index._classes(rows, "embedding", "unit_id"))
    assert vector_index.met_share(index, 0.95) < 0.3 < vector_index.met_share(index, -1.0) + 1e-9
    assert abs(vector_index.met_share(index, -1.0) - 1) < 1e-9


def test_odd_vectors(spark):
    rows = [(0, 0, [1.0, 0.0]), (1, 0, None), (2, 0, [0.0, 0.0]), (3, None, [1.0, 0.0]), (3, None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = vector_index.near_dup_within(df, 0.9, "unit_id")
    assert [(r.unit_id, r.is_dup) for r in got.orderBy("unit_id").collect()] == [(0, False), (1, False), (2, False), (3, True), (3, True)]
    assert vector_index.near_dup_within(df.limit(0), 0.9, "unit_id").collect() == []
    none = vector_index.near_dup_against(df, df.limit(0), 0.9)
    assert [r.is_dup for r in none.collect()] == [False] * 5
    index = vector_index.build(df.limit(0))
    assert vector_index.search(df.select(F.col("unit_id").alias("qid"), "embedding"), index, 3, exact=True).collect() == []
    index = vector_index.build(df, cells=8)
    got = vector_index.search(df.where("unit_id = 0").select(F.col("unit_id").alias("qid"), "embedding"), index, 9, 1, exact=True, per="unit")
    assert [(r.unit_id, r.score) for r in got.orderBy("rank").collect()] == [(0, 1.0), (3, 1.0), (3, 1.0), (2, 0.0)]


def test_visits_go_to_regions_not_cells(spark, rows):
    # where nothing can be pruned, each row went to half of the 300 cells
    index = vector_index.build(vector_index._classes(rows, "embedding", "unit_id"), cells=300)
    n, most = index.count.sum(), 2 * vector_index.REGIONS + 1
    assert n < vector_index.visits_within(index, -1.0).count() <= n * most
    starts = index.starts()
    assert len(starts) - 1 <= most and starts[0] == 0 and starts[-1] == 300 and (np.diff(starts) > 0).all()


@pytest.mark.parametrize("tile", [1 << 22, 100])
def test_thresholds_of_one_pass(spark, monkeypatch, tile):
    # small tiles: a task goes through its scores in many steps
    monkeypatch.setattr(vector_index, "TILE", tile)
    made = clustered(400, 20)
    rows = [(None if i == 5 else i, d, v if i % 3 else made[-1 - i][2]) for i, d, v in made]
    df = spark.createDataFrame(rows, SCHEMA)
    at = [0.9, 0.2, 0.6]
    x = np.array([v for _, _, v in rows], np.float32).astype(float)
    for t in at:
        like = x @ x.T >= t
        want = {i for i, _, _ in rows if i is not None and any(j is not None and j < i and like[i, j] for j, _, _ in rows)}
        got = [r for r in vector_index.near_dups_within(df, at, "unit_id").collect() if r.threshold == t]
        assert len(got) == 400 and {r.unit_id for r in got if r.is_dup} == want
        got = [r for r in vector_index.near_dups_against(df.where("unit_id >= 100"), df.where("unit_id < 100"), at).collect() if r.threshold == t]
        want = {i for i, _, _ in rows if i is not None and i >= 100 and any(j is not None and j < 100 and like[i, j] for j, _, _ in rows)}
        assert len(got) == 300 and {r.unit_id for r in got if r.is_dup} == want


def test_a_query_of_two_thresholds_indexes_once(spark, monkeypatch):
    from lodestone.plans import queries

    built = []
    build = vector_index.build
    monkeypatch.setattr(vector_index, "build", lambda *a, **k: built.append(build(*a, **k)) or built[-1])
    got = queries.near_dup_against_pruned(spark, SMALL)
    assert len(built) == 1 and {r.threshold for r in got.select("threshold").distinct().collect()} == {0.3, 0.5}
