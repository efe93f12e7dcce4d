import math

import numpy as np
import pytest
from lodestone.operators import bm25, golden, metrics, mining, ranking, reports, resampling, similarity, training
from pyspark.sql import functions as F

UNITS = [(0, 10, [1.0, 0.0]), (1, 10, [0.6, 0.8]), (2, 20, [0.0, 1.0])]


def units(spark, rows=UNITS):
    return spark.createDataFrame(rows, "unit_id long, doc_id long, embedding array<double>")


def queries(spark, rows=((7, 10, [0.6, 0.8]),)):
    return spark.createDataFrame(list(rows), "qid long, doc_id long, embedding array<double>")


def test_maxp_by_hand(spark):
    got = [(r.doc_id, r.unit_id, round(r.score, 6), r["rank"]) for r in similarity.maxp(queries(spark), units(spark)).orderBy("rank").collect()]
    assert got == [(10, 1, 1.0, 1), (20, 2, 0.8, 2)]
    best = similarity.best_own_unit(queries(spark), units(spark)).first()
    assert (best.unit_id, round(best.score, 6)) == (1, 1.0)


def test_maxp_is_brute_force_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", 200)
    rng = np.random.default_rng(0)
    e = rng.integers(-2, 3, (120, 4)).astype(float)  # many ties
    rows = [(i, i % 9, e[i].tolist()) for i in range(120)]
    q = [(i, 0, e[i].tolist()) for i in range(0, 120, 11)]
    got = {}
    for r in similarity.maxp(queries(spark, q), units(spark, rows).repartition(7), 4, skip_self=True).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.doc_id, r.unit_id, r.score))
    for i, _, v in q:
        best = {}
        for u, d, w in rows:
            if u != i:
                s = float(np.dot(v, w))
                if d not in best or s > best[d][0]:
                    best[d] = (s, u)
        order = sorted(best, key=lambda d: (-best[d][0], d))[:4]
        assert sorted(got[i]) == [(n + 1, d, best[d][1], best[d][0]) for n, d in enumerate(order)]


def test_empty_documents_rank_last(spark):
    run = similarity.maxp(queries(spark), units(spark))
    got = similarity.with_empty_docs(run, queries(spark), spark.createDataFrame([(5,), (30,)], "doc_id long"), 3).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got][2] == (5, float("-inf")) and len(got) == 3


def test_near_dup_within_and_against(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 2)
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.999, 0.0447]), (3, [0.0, 1.0]), (4, [0.7, 0.714])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.vec_id: r.is_dup for r in similarity.near_dup_within(df, 0.99).collect()} == {0: False, 1: False, 2: True, 3: True, 4: False}
    got = similarity.near_dup_against(df.where("vec_id > 1"), df.where("vec_id = 0"), 0.99)
    assert {r.vec_id: r.is_dup for r in got.collect()} == {2: True, 3: False, 4: False}


def run_of(spark, rows):
    return spark.createDataFrame([(1, d, r + 1) for r, d in enumerate(rows)], "qid long, doc_id string, rank long")


def test_beating_and_encoding(spark):
    units_ = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 2, [0.9, 0.1]), (2, 2, [0.95, 0.0]), (3, 3, [0.0, 1.0])], "unit_id long, doc_id long, embedding array<float>")
    q = spark.createDataFrame([(0, 3, 0.5, [1.0, 0.0]), (9, 1, 1.0, [1.0, 0.0])], "qid long, gold long, score double, embedding array<float>")
    assert sorted(tuple(r) for r in similarity.beating(q, units_).collect()) == [(0, 1), (0, 2)]
    assert sorted(tuple(r) for r in similarity.beating(q, units_, skip_self="unit_id").collect()) == [(0, 2)]
    assert similarity.beating(q.limit(0), units_).count() == 0

    def model():
        return lambda texts: [[len(t), 0.0 if t == "p:" else 1.0] for t in texts]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["abc", "", None, "x" * 99])], "i long, text string").coalesce(1)
    got = {r.i: r.embedding for r in similarity.encoded(df, model, prompt="p:", batch=2).collect()}
    assert np.allclose(got[0], np.array([5, 1]) / 26**0.5) and np.allclose(got[1], [1, 0]) and got[1] == got[2] and np.allclose(got[3], np.array([101, 1]) / (101**2 + 1) ** 0.5)
    assert similarity.encoded(df.limit(0), model).count() == 0


def test_rrf(spark):
    a, b = run_of(spark, "ab"), run_of(spark, "bc")
    got = [(r.doc_id, r.score) for r in ranking.rrf([a, b]).orderBy("rank").collect()]
    assert [d for d, _ in got] == ["b", "a", "c"] and got[0][1] == pytest.approx(1 / 62 + 1 / 61)
    zero = [(r.doc_id, r.score) for r in ranking.rrf([a, b], [0.0, 1.0]).orderBy("rank").collect()]
    assert zero == [("b", 1 / 61), ("c", 1 / 62), ("a", 0.0)]
    tie = [r.doc_id for r in ranking.rrf([run_of(spark, "xy"), run_of(spark, "yx")]).orderBy("rank").collect()]
    assert tie == ["x", "y"]


def test_weights_and_pool(spark):
    means = spark.createDataFrame([(0.0, 0.5), (0.1, 0.7), (0.2, 0.7)], "w double, m double")
    assert ranking.best_weight(means, "m").first().w == 0.1
    gold = spark.createDataFrame([(1, "b")], "qid long, doc_id string")
    got = ranking.candidate_pool([run_of(spark, "abcd"), run_of(spark, "eac")], gold, 3).orderBy("place").collect()
    assert [(r.doc_id, r.source) for r in got] == [("a", 0), ("e", 1), ("c", 0)]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "а б б"), (2, "а в"), (3, "г")], "unit_id long, text string")
    q = spark.createDataFrame([(1, "б"), (2, "б Б а"), (3, "нет"), (4, "")], "qid long, text string")
    got = {(r.qid, r.doc_id): r.score for r in bm25.search(q, docs).collect()}
    n, avg = 3, 2.0
    w = lambda df, tf, dl: math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got == {(1, 1): pytest.approx(w(1, 2, 3)), (2, 1): pytest.approx(2 * w(1, 2, 3) + w(2, 1, 3)), (2, 2): pytest.approx(w(2, 1, 2))}
    filled = bm25.search(q, docs, 3, fill=True).where("qid >= 3").orderBy("qid", "rank").collect()
    assert [(r.qid, r.doc_id, r.score) for r in filled] == [(k, d, 0.0) for k in (3, 4) for d in (1, 2, 3)]


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate("xaybz")] + [(2, "q", 1)], "qid long, doc_id string, rank long")
    rel = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "n", 0), (3, "m", 1)], "qid long, doc_id string, rel int")
    q = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    got = {r.qid: r for r in metrics.per_query(run, rel, q).collect()}
    dcg = 1 / math.log2(3) + 3 / math.log2(5)
    assert got[1].ndcg_10 == pytest.approx(dcg / (3 + 1 / math.log2(3)))
    assert (got[1].recall_5, got[1].recall_10, got[1].mrr_10) == (1.0, 1.0, 0.5)
    assert all(got[k][m] == 0 for k in (2, 3) for m in metrics.METRICS)
    assert math.isnan(metrics.mean_metrics(metrics.per_query(run, rel, q).where("qid > 9")).first().ndcg_10)


def test_summary_facets(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 0.0), ("b", None, 0.5)], "slice string, qtype string, ndcg_10 double")
    got = {r.facet: (r.ndcg_10, r.n) for r in metrics.summary(rows, metrics=("ndcg_10",)).collect()}
    assert got == {"all": (0.5, 3), "slice=a": (0.5, 2), "slice=b": (0.5, 1), "qtype=x": (1.0, 1), "qtype=y": (0.0, 1), None: (0.5, 1)}


def test_shards_give_whole_resamples():
    sizes = [3, 500, 97]
    parts = [resampling.shard_sums(np.ones(n), sizes, k, 300, 7) for k, n in enumerate(sizes)]
    assert (sum(parts) == 600).all()  # every resample has as many draws as there are values
    rng = np.random.default_rng(1)
    values = [rng.random(n) + k for k, n in enumerate(sizes)]
    means = sum(resampling.shard_sums(v, sizes, k, 4000, 7) for k, v in enumerate(values)) / 600
    whole = np.concatenate(values)
    assert abs(means.mean() - whole.mean()) < 4 * whole.std() / 600**0.5 / 4000**0.5
    assert means.std() == pytest.approx(whole.std() / 600**0.5, rel=0.05)


@pytest.mark.parametrize("shard", [1 << 16, 40])
def test_bootstrap(spark, monkeypatch, shard):
    monkeypatch.setattr(resampling, "SHARD", shard)
    monkeypatch.setattr(resampling, "DRAWS", 1000)
    rng = np.random.default_rng(1)
    b = rng.random(300)
    df = lambda x: spark.createDataFrame([(i, float(v), "st"[i % 2] if i else None) for i, v in enumerate(x)], "qid long, ndcg_10 double, slice string")
    same = resampling.compared(df(b), df(b), resamples=200).first()
    assert (same.n, same.delta, same.p_value, same.ci_low, same.ci_high) == (300, 0, 1, 0, 0)
    far = resampling.compared(df(b + 0.2), df(b), resamples=500).first()
    assert far.p_value == pytest.approx(2 / 501) and far.ci_low <= 0.2 + 1e-12 and 0.2 <= far.ci_high + 1e-12
    rows = {r.group: r for r in resampling.compared(df(b), df(b[::-1]), by="slice", resamples=2000).collect()}
    assert set(rows) == {"all", "slice=s", "slice=t"} and rows["all"].n == 300 and rows["slice=t"].n == 150
    diff = b - b[::-1]
    half = 1.96 * diff.std() / 300**0.5
    assert rows["all"].ci_high - rows["all"].ci_low == pytest.approx(2 * half, rel=0.15)
    assert resampling.compared(df(b), df(b[::-1]), resamples=300).collect() == resampling.compared(df(b).repartition(7), df(b[::-1]), resamples=300).collect()
    ci = {r.slice: r for r in resampling.mean_ci(df(b), ["slice"], "ndcg_10", resamples=500).collect()}
    assert ci[None].n == 1 and ci[None].ci_low == ci[None].ci_high == b[0] and ci["s"].ci_low < ci["s"]["mean"] < ci["s"].ci_high
    for other in (df(b[:2]), df([]), df(b).union(df(b))):
        with pytest.raises(ValueError):
            resampling.compared(df(b), other)


def test_report_tables(spark):
    means = spark.createDataFrame([("base", "all", 0.5, 9), ("tuned", "all", 0.7, 9), ("ref", "all", 0.8, 9), ("base", "slice=x", 0.4, 3)], "name string, facet string, ndcg_10 double, n long")
    assert [tuple(r) for r in reports.before_after(means, "name", "facet", {"base": "base", "tuned": "tuned", "ref": "ref"}).collect()] == [("all", 9, 0.5, 0.7, 0.8)]
    assert sorted((r.name, round(r.delta, 6)) for r in reports.ablation(means.where("facet = 'all'"), "name", "facet", "tuned").collect()) == [("base", -0.2), ("ref", 0.1)]
    speed = spark.createDataFrame([("base", "cpu", 1.0), ("none", "cpu", 2.0)], "name string, device string, ms double")
    table = spark.createDataFrame([("base", 0.5), ("null", None)], "name string, ndcg_10 double")
    assert [(r.name, r.ms, r.ndcg_10) for r in reports.looked_up(speed, table, "name", "ndcg_10").collect()] == [("base", 1.0, 0.5)]
    runs = spark.createDataFrame([("full", 100), ("half", 50)], "name string, train_questions long")
    scores = spark.createDataFrame([(n, s, v) for n, a, b in (("base", 0.1, 0.2), ("half", 0.3, 0.4), ("full", 0.5, 0.6)) for s, v in (("dev", a), ("test", b))], "name string, set string, ndcg_10 double")
    curve = reports.learning_curve(runs, scores, "base", {"dev_score": "dev", "test_score": "test"}).collect()
    assert [tuple(r) for r in curve] == [("base", 0, 0.1, 0.2), ("half", 50, 0.3, 0.4), ("full", 100, 0.5, 0.6)]
    steps = spark.createDataFrame([(r, s, v) for r in ("a", "b_s43") for s, v in ((0, 0.1), (10, 0.4), (20, 0.4))], "run string, step long, ndcg_10 double")
    config = spark.createDataFrame(
        [("a", None, "x/small", ["llm", "titles"], None, [], 0, 0.0, 8, 90.0), ("b_s43", "E1", "small", [], "train_llm_teacher", ["v1", "v2"], 10, 0.5, 8, 60.0)],
        "run string, experiment string, base_model string, sources array<string>, train_file string, versions array<string>, filter_rank int, format_aug double, steps_per_epoch long, seconds double",
    )
    got = {r.run: tuple(r)[1:] for r in reports.train_runs(steps, config).collect()}
    assert got["a"] == ("", "small", "llm+titles", 0.1, 0.4, 10, 1.25, 1.5)
    assert got["b_s43"] == ("E3", "small", "llm + teacher (v1,v2), noise filter top-10, format aug 0.5", 0.1, 0.4, 10, 1.25, 1.0)


def test_small_statistics(spark):
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate([1, 3, 2])], "k string, i long, v double")
    got = [r.ema for r in metrics.ema(df, "k", "i", "v", 0.5).orderBy("i").collect()]
    assert got == [1.0, 2.0, 2.0]
    r = metrics.seed_stats(df, ["k"], "v").first()
    assert (r["mean"], r["std"], r.n) == (2.0, 1.0, 3)
    lat = metrics.latency(df, ["k"], "v").first()
    assert (lat.p50, round(lat.p95, 6), lat.queries_per_s) == (2.0, 2.9, 500.0)
    runs = spark.createDataFrame([("A", "x", 0.5), ("A", "y", 0.6), ("B", "z", 0.6), ("C", "w", 0.7)], "stage string, name string, dev double")
    assert [(r.stage, r.chosen, r.kept) for r in metrics.chosen(runs, "stage", "name", "dev").orderBy("stage").collect()] == [("A", "y", True), ("B", "z", False), ("C", "w", True)]


def candidate_rows(spark, scores):
    return spark.createDataFrame([(1, 10, u, d, s, i + 1) for i, (u, d, s) in enumerate(scores)], "qid long, gold long, unit_id long, doc_id long, score double, rank long")


def test_hard_negatives(spark):
    pos = spark.createDataFrame([(1, 1.0)], "qid long, score double")
    one = lambda rows, k=50: mining.hard_negatives(candidate_rows(spark, rows), pos, top_k=k).first()
    r = one([(0, 10, 1.0), (1, 20, 0.97), (2, 30, 0.9), (3, 30, 0.5)])
    assert (r.neg_unit_id, r.rule, r.n_same, r.n_close) == (2, "margin", 1, 1)
    r = one([(0, 10, 1.0), (1, 20, 0.99), (2, 30, 0.97)])
    assert (r.neg_unit_id, r.rule) == (2, "fallback")
    r = one([(0, 10, 1.0), (1, 20, 0.5)], 1)
    assert (r.neg_unit_id, r.rule) == (-1, "none")
    counts = mining.mining_counters(mining.hard_negatives(candidate_rows(spark, [(0, 10, 1.0), (1, 20, 0.5)]), pos)).first()
    assert (counts.negative_by_margin_rule, counts.candidates_same_document) == (1, 1)


def test_teacher_operators(spark):
    docs = spark.createDataFrame([(1, 10, 10, 0.8, 5), (1, 10, 20, 0.9, 6), (1, 10, 30, 0.8, 7), (1, 10, 40, 0.1, 8)], "qid long, gold long, doc_id long, score double, unit_id long")
    assert mining.gold_rank(docs).first().gold_rank == 2
    r = mining.listwise(docs, 2).first()
    assert (r.pos_unit_id, r.cand_unit_ids, r.labels) == (5, [6, 7], [0.8, 0.9, 0.8])
    golds = spark.createDataFrame([(1, 10), (2, 20)], "qid long, gold long")
    assert {r.qid: r.gold_rank for r in mining.gold_ranks(golds, spark.createDataFrame([(1, 20), (1, 30)], "qid long, doc_id long")).collect()} == {1: 3, 2: 1}
    lists = mining.listwise(docs, 2)
    means = mining.label_means(lists).first()
    assert (means.rows, means.labels_mean, round(means.cands_mean, 6)) == (1, 0.8, 0.85)
    other = spark.createDataFrame([(1, 20, 60, 0.3), (1, 10, 50, 0.2), (1, 40, 80, 0.9)], "qid long, doc_id long, unit_id long, score double")
    r = mining.two_views(lists, other).first()
    assert (r.unit_ids_b, r.labels_b) == ([50, 60, None], [0.2, 0.3, None])
    only_own = candidate_rows(spark, [(5, 10, 0.8)])
    r = mining.teacher_negatives(only_own, docs).first()
    assert (r.neg_unit_id, r.rule) == (6, "best_other_document")
    assert mining.rank_report(mining.gold_rank(docs)).first().le_5 == 1.0


def test_batches_have_no_conflicts():
    keys = [frozenset(k) for k in ("a", "a", "ab", "c", "b", "d", "e", "f")]
    got = training.batches_of(keys, 3)
    assert sorted(i for b in got for i in b) == list(range(8)) and [len(b) for b in got] == [3, 3, 2]
    assert got[0] == [0, 3, 4]
    assert len(training.batches_of(keys, 3, drop_last=True)) == 2
    same = training.batches_of([frozenset("a")] * 4, 2)
    assert same == [[0, 1], [2, 3]]  # nothing but conflicts: filled all the same


def test_training_rows(spark):
    rows = spark.createDataFrame([(i, i % 3, None if i % 2 else 99) for i in range(20)], "qid long, doc_id long, neg_unit_id long")
    pool = spark.createDataFrame([(100 + 7 * i, 0 if i < 6 else i % 3) for i in range(9)], "unit_id long, doc_id long")
    owner = {r.unit_id: r.doc_id for r in pool.collect()}
    got = training.filled_negatives(rows, pool).collect()
    assert len(got) == 20 and all(r.neg_unit_id == 99 or owner[r.neg_unit_id] != r.doc_id for r in got)
    alone = training.filled_negatives(rows, pool.where("doc_id = 0")).where("doc_id = 0 and qid % 2 = 1").collect()
    assert alone and all(r.neg_unit_id is None for r in alone)  # there is no unit of another document
    batches = training.conflict_free(rows.withColumn("k", training.row_keys(F.col("doc_id").cast("string"))), "k", 3, shards=2).collect()
    assert sorted(r.qid for r in batches) == list(range(20))
    steps = spark.createDataFrame([(1, 0.5), (1, 0.7), (2, 0.6), (3, 0.9)], "step long, ndcg_10 double")
    assert [r.is_best for r in training.evaluated(steps).orderBy("step").collect()] == [True, False, True]
    wide = training.wide(spark.createDataFrame([(["a", "b"], [1.0, 0.5])], "cand_texts array<string>, labels array<double>"), 3, 0.5).first()
    assert (wide.cand_0, wide.cand_2, wide.label) == ("a", None, [2.0, 1.0])


def test_golden_sets(spark):
    items = spark.createDataFrame([(i, f"q{i}", 10, [11, 12]) for i in range(6)], "qid long, text string, gold long, candidates array<long>")
    log = spark.createDataFrame(
        [(0, 1, "ok", "", True, []), (1, 1, "ok", "", True, []), (1, 2, "fix", "better", False, [11]), (2, 1, "drop", "", True, []), (3, 1, "ok", "", False, []), (4, 1, "fix", "", True, [10, 12]), (9, 1, "ok", "", True, []), (0, 0, "odd", "", True, []), (4, 0, "ok", "", True, [99])],
        "qid long, n long, question_status string, fixed_text string, gold_relevant boolean, extra_relevant array<long>",
    )
    bad = {(r.qid, r.reason) for r in golden.invalid_annotations(log.where("n < 2 and qid in (0, 4, 9)"), items).collect()}
    assert bad == {(9, "unknown_question"), (0, "unknown_status"), (4, "unknown_candidate")} | {(4, "unknown_candidate")}
    rows = golden.adjudicated(items, golden.latest(log, "qid", "n"))
    got = {r.qid: (r.reason, r.text, r.qrels) for r in rows.collect()}
    assert got[0] == (None, "q0", {10: 1}) and got[1] == (None, "better", {11: 1})
    assert got[2][0] == "question_drop" and got[3][0] == "dropped_no_relevant" and got[5][0] == "not_annotated"
    assert got[4] == (None, "q4", {10: 1, 12: 1})
    r = golden.report(rows).first()
    assert (r["items"], r.annotated, r.golden_queries, r.share_gold_relevant) == (6, 5, 3, 0.5)


def test_best_own_unit_makes_no_row_of_a_pair(spark, monkeypatch):
    """In blocks of few queries the best unit by brute force, equal vectors included; no pair is joined."""
    monkeypatch.setattr(similarity, "HELD_ROWS", 7)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[100:200] = v[:100]
    u = spark.createDataFrame([(i, i % 3, v[i].tolist()) for i in range(300)], "unit_id long, doc_id long, embedding array<float>")
    q = spark.createDataFrame([(i, i % 3, v[i].tolist()) for i in range(0, 300, 10)] + [(1000, 77, v[0].tolist())], "qid long, doc_id long, embedding array<float>")
    got = similarity.best_own_unit(q, u.repartition(5), skip_self=True)
    assert "Join" not in got._jdf.queryExecution().toString()
    x = v.astype(float)
    want = {}
    for i in range(0, 300, 10):
        own = [j for j in range(300) if j % 3 == i % 3 and j != i]
        scores = [sum(a * b for a, b in zip(x[i], x[j], strict=True)) for j in own]
        want[i] = (own[int(np.argmax(scores))], max(scores))
    assert {r.qid: (r.unit_id, r.score) for r in got.collect()} == want


def test_what_a_search_holds_is_bounded(spark, monkeypatch):
    """A block has no more queries than their results may be held for; in blocks the result is the same."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(200, 4)).astype(np.float32)
    u = spark.createDataFrame([(i, i % 9, v[i].tolist()) for i in range(200)], "unit_id long, doc_id long, embedding array<float>")
    q = u.where("unit_id % 5 = 0").select(F.col("unit_id").alias("qid"), "embedding")
    want = [similarity.maxp(q, u, 6, skip_self=True, per=p).orderBy("qid", "rank").collect() for p in ("doc", "unit")]
    monkeypatch.setattr(similarity, "HELD_ROWS", 30)
    assert max(len(b[0]) for b in similarity._blocks(q, "qid", "embedding", results=6)) == 5
    assert [similarity.maxp(q, u, 6, skip_self=True, per=p).orderBy("qid", "rank").select(w[0].__fields__).collect() for p, w in zip(("doc", "unit"), want, strict=True)] == want
