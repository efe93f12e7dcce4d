"""Ordered operations, counter-based draws, dealt batches and postings against brute force."""

import random
import time

import pytest
from lodestone.operators import bm25, ordered, pages, postings, resampling, training
from pyspark.sql import functions as F


@pytest.mark.parametrize("parts", [None, 7])
def test_asof_is_brute_force(spark, parts):
    rng = random.Random(2)
    # one hot group, ties in time, nulls in groups and times
    left = [(i, rng.choice(["a"] * 8 + ["b", None]), rng.choice([*range(60), None])) for i in range(300)]
    right = [(i, rng.choice(["a"] * 8 + ["b", "c", None]), rng.choice([*range(60), None]), f"v{i}") for i in range(80)]
    l, r = spark.createDataFrame(left, "l long, g string, t long"), spark.createDataFrame(right, "r long, g string, u long, v string")  # noqa: E741
    got = {x.l: x.matched and x.matched.v for x in ordered.asof(l, r, ["g"], "t", "u", "r", parts).collect()}
    want = {}
    for i, g, t in left:
        own = [(u, k, v) for k, h, u, v in right if h == g and t is not None and u is not None and u <= t]
        want[i] = max(own)[2] if own else None
    assert got == want
    assert all(x.matched is None for x in ordered.asof(l, r.limit(0), ["g"], "t", "u", "r").collect())
    assert ordered.asof(l.limit(0), r, ["g"], "t", "u", "r").collect() == []


def test_overlaps_are_brute_force(spark):
    rng = random.Random(3)

    def made(n):
        return [(i, rng.choice(["a"] * 5 + ["b", None]), s := rng.randint(-5000, 5000), rng.choice([None, s - 1, s, s + 3, s + 40, s + 9000, s + 10**12])) for i in range(n)]

    a, b = made(120), made(120)
    got = ordered.overlaps(spark.createDataFrame(a, "x long, g string, s long, e long"), spark.createDataFrame(b, "y long, g string, u long, v long"), ["g"], ("s", "e"), ("u", "v"), width=4, factor=4, levels=5)
    want = sorted((i, j) for i, g, s, e in a for j, h, u, v in b if g is not None and g == h and None not in (e, v) and s <= e and u <= v and s <= v and u <= e)
    assert sorted((r.x, r.y) for r in got.collect()) == want and want


@pytest.mark.parametrize("parts", [None, 1, 9])
def test_smoothing_in_parts(spark, parts):
    rng = random.Random(4)
    rows = [(s, i, rng.choice([None, rng.random()])) for s in ("a", None) for i in range(200)] + [("one", 0, 3.0)]
    want = {}
    for s, i, v in rows:
        if v is not None:
            last = want.get((s, "last"))
            want[s, "last"] = want[s, i] = v if last is None else 0.15 * v + 0.85 * last
    df = spark.createDataFrame(rows, "s string, i int, v double")
    got = {(r.s, r.i): r.ema for r in ordered.smoothed(df, "s", "i", "v", parts=parts).collect()}
    assert got.keys() == {k for k in want if k[1] != "last"} and all(abs(v - want[k]) < 1e-12 for k, v in got.items())
    assert ordered.smoothed(df.limit(0), "s", "i", "v").collect() == []


def test_counter_draws_are_brute_force(spark, monkeypatch):
    import hashlib

    h = lambda x, n: int(hashlib.md5(x.encode()).hexdigest()[:n], 16)
    rows = [(f"q{i}", "a" if i % 3 else None, i / 7) for i in range(50)] + [("none", "a", None)]
    df = spark.createDataFrame(rows, "qid string, g string, x double")
    want = {}
    for g in ("a", None):
        own = [v for _, v in sorted((h(f"boot5{q}", 8), q, v)[::2] for q, x, v in rows if x == g and v is not None)]
        for r in range(40):
            want[g, r] = round(sum(own[h(f"5|{r}|{i}", 15) % len(own)] for i in range(len(own))) / len(own), 12)
    got = {(r.g, r.resample): r["mean"] for r in resampling.counter_means(df, ["g"], "x", resamples=40, seed=5).collect()}
    assert got.keys() == want.keys() and all(abs(v - want[k]) < 2e-12 for k, v in got.items())
    # draws in blocks that meet their values by shuffling are the same
    monkeypatch.setattr(resampling, "SHARD", 7)
    monkeypatch.setattr(resampling, "BROADCAST_VALUES", 0)
    assert {(r.g, r.resample): r["mean"] for r in resampling.counter_means(df, ["g"], "x", resamples=40, seed=5).collect()} == got


def conflicts(rows, keys):
    by = {}
    for r in rows:
        by.setdefault(r.batch, []).append(r.qid)
    twice = 0
    for own in by.values():
        all_ = [k for q in own for k in keys[q]]
        twice += len(all_) - len(set(all_))
    return by, twice


def test_dealt_batches_have_no_conflicts(spark):
    rng = random.Random(8)
    keys = {i: sorted({f"d{rng.randrange(60)}", f"d{rng.randrange(60)}"}) for i in range(100)}
    df = spark.createDataFrame([(i, k) for i, k in keys.items()], "qid long, k array<string>")
    rows = training.dealt_batches(df, "k", 8, shards=2).collect()
    by, twice = conflicts(rows, keys)
    # as many batches as plain cutting gives, all rows once, no key twice
    assert sorted(r.qid for r in rows) == sorted(keys) and len(by) == 13 and max(map(len, by.values())) <= 8 and twice == 0
    assert all(r.shard == r.batch % 2 for r in rows) and all(sorted(r.place for r in rows if r.batch == b) == list(range(len(own))) for b, own in by.items())


def test_dealt_batches_of_hot_keys_and_odd_rows(spark):
    df = spark.createDataFrame([(i, ["hot"] if i % 3 == 0 else None if i % 3 == 1 else []) for i in range(30)], "qid long, k array<string>")
    rows = training.dealt_batches(df, "k", 3, rounds=6).collect()
    keys = {i: ["hot"] if i % 3 == 0 else [] for i in range(30)}
    by, twice = conflicts(rows, keys)
    assert len(rows) == 30 and len(by) == 10 and twice == 0
    # a key with more rows than batches conflicts, and all rows are placed all the same
    one = spark.createDataFrame([(i, ["k"]) for i in range(4)], "qid long, k array<string>")
    by, twice = conflicts(training.dealt_batches(one, "k", 2, rounds=2).collect(), {i: ["k"] for i in range(4)})
    assert sorted(map(len, by.values())) == [2, 2] and twice == 2
    assert training.dealt_batches(df.limit(0), "k", 3).collect() == []


def test_postings_are_the_plain_search(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 200}"
    rows = [(i, i // 3, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(900)] + [(900, 300, None), (901, 300, "")]
    units = spark.createDataFrame(rows, "unit_id long, doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(word() for _ in range(4))) for i in range(15)] + [(99, "nothing"), (98, None)], "qid long, text string")
    for doc in (None, "doc_id"):
        index = postings.build(units, doc=doc, segment=20)
        for fill in (False, True):
            want = {(r.qid, r["rank"]): (r.doc_id, round(r.score, 7)) for r in bm25.search(asked, units, 7, doc=doc, fill=fill).collect()}
            assert {(r.qid, r["rank"]): (r.doc_id, round(r.score, 7)) for r in postings.search(asked, index, 7, first=2, fill=fill).collect()} == want
    # the fewer documents are asked for, the more segments can't reach the score to beat
    assert 0 < postings.scored_share(asked, index, 1, 2) < postings.scored_share(asked, index, 7, 2) < 1
    postings.saved(index, str(tmp_path / "index"))
    again = postings.loaded(spark, str(tmp_path / "index"))
    found = postings.search(asked, again, 7)
    # a second query set reads no text
    assert "text" not in {f.name for f in again.rows.schema.fields} and found.count() > 0
    assert postings.search(asked, postings.build(units.limit(0)), 7).collect() == []


def test_pages_of_unclosed_tags_take_linear_time():
    for unit in ("<b>", "<p>x", "<div class='main-center-block-crambs'><a>q", "<h1>a"):
        began = time.monotonic()
        pages.read_page("<div class='main-center-block'>" + unit * 20_000, "main-center-block")
        assert time.monotonic() - began < 5
    html = "<h1>T <b>x</b></h1><div class=main-center-block-crambs><a>one</a><a>two<a>three</a></div><div class=main-center-block><p class=pCenter>c<p>a<script>s</script>b</p>t<div class=pb-2></div></div><p>out"
    assert pages.read_page(html, "main-center-block") == ("T x", ["one", "two", "three"], [(0, "center", "c"), (1, "p", "a b"), (2, "stop", "")])


def test_postings_shuffle_no_score_per_term_and_document(spark):
    """Every query has a word that all documents have: what is shuffled stays within the documents' own words and results."""
    rng = random.Random(6)
    units = spark.createDataFrame([(i, "all " + " ".join(f"w{rng.randint(0, 50)}" for _ in range(5))) for i in range(2000)], "unit_id long, text string")
    asked = spark.createDataFrame([(i, f"all w{i % 50}") for i in range(300)], "qid long, text string")
    index = postings.build(units, segment=100)
    stages = lambda: spark.sparkContext._jsc.sc().statusStore()

    def shuffled() -> int:
        found = stages().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))

    before = shuffled()
    got = {(r.qid, r["rank"]): r.doc_id for r in postings.search(asked, index, 3).collect()}
    assert shuffled() - before < 300_000  # 300 queries times 2000 documents were 600000 before their terms
    assert got == {(r.qid, r["rank"]): r.doc_id for r in bm25.search(asked, units, 3).collect()}
